"""Words and rolling hashes of columns of text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; a longer document is handled alone.
SLICE = 1 << 20
U = np.uint64
#: The same with ASCII marks other than letters and digits.
MARKS = SPACE | np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n - 1, modulo 2 ** 64."""
    if "up" not in _cache or len(_cache["up"]) < n:
        size = max(n, SLICE + 1)
        for name, by in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, by, U)
            steps[0] = 1
            _cache[name] = np.cumprod(steps)
    return _cache["up"][:n], _cache["down"][:n]


def forget() -> None:
    """Drop the powers that were computed."""
    _cache.clear()


def text_slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of whole texts of about SLICE bytes; row i has bytes[bounds[i]:bounds[i + 1]]."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, side="right")) - 1)
        yield at, whole[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers of the base, from which span_hashes() takes any span's hash."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(U))


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word_bounds) of the words of each text; text i has the words word_bounds[i] to word_bounds[i + 1].
    between: for every byte, whether it stands between words."""
    solid = ~between[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    edges = bounds[:-1][bounds[:-1] < len(data)]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[edges] = solid[edges]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = edges[edges > 0] - 1
    closes[last] = solid[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() with a 64-bit hash of each word."""
    starts, ends, word_bounds = words(data, bounds)
    return starts, ends, word_bounds, span_hashes(prefix_sums(BYTE_VALUES[data]), starts, ends)


def row_numbers(bounds: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
