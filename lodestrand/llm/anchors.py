"""Content-defined anchors: every window of a given length holds one, at the same place in every copy."""

from __future__ import annotations

import numpy as np

from lodestrand.llm.words import U, prefix_sums, row_numbers, span_hashes

#: Low bits of a hash that give way to a position, so that minima are unique and the leftmost wins a tie.
PLACE = 26


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values: the running minima of blocks from both ends meet in one comparison."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram hash, place, first window, last window) of the anchors of each text.

    A window's anchor is its gram with the smallest hash, the leftmost of equals: it depends on the window's symbols
    alone, so equal windows have equal anchors at the same distance. More than 2 ** PLACE symbols are looked at in
    overlapping pieces, as a place has PLACE bits. Consecutive windows mostly share theirs; an anchor
    stands for the windows that start from `first window` to `last window`. Places count from the start of symbols.
    """
    none = np.zeros(0, np.int64)
    n = len(symbols)
    if n < window:
        return none, np.zeros(0, U), none, none, none
    sums = prefix_sums(symbols)
    at = np.arange(n - gram + 1)
    hashes = span_hashes(sums, at, at + gram)
    low, width = U((1 << PLACE) - 1), window - gram + 1
    pieces = []
    for start in range(0, n - window + 1, (1 << PLACE) - width + 1):
        piece = hashes[start : start + (1 << PLACE)]
        pieces.append((sliding_minimum((piece & ~low) | at[: len(piece)].astype(U), width) & low).astype(np.int64) + start)
    best = np.concatenate(pieces)
    row = row_numbers(bounds)
    valid = np.flatnonzero(bounds[1:][row[: len(best)]] - np.arange(len(best)) >= window)
    if not len(valid):
        return none, np.zeros(0, U), none, none, none
    best = best[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[valid][1:] != row[valid][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return row[valid[first]], hashes[best[first]], best[first], valid[first], valid[last]
