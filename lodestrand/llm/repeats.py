"""What substring and suffix deduplication share: candidate windows, parcels of texts, and the removal itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.anchors import anchors
from lodestrand.llm.words import U, mix, text_slices

#: Raw bytes of text in one parcel run, anchors in one run, and bytes of text that one part holds, about.
PARCEL = 16 << 20
ANCHORS = 1 << 19
PART_BYTES = 32 << 20
#: A gram that as many anchors have is hot.
HOT = 256
#: Symbols of a text slice and the bounds of each text in them.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed blob."""
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())
    size = len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little")
    return size + head + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    head, body = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    flat, at, out = pa.Codec("zstd").decompress(blob[12 + head :], body, asbytes=True), 0, {}
    for part in blob[12 : 12 + head].decode().split(";"):
        name, kind, n = part.split(",")
        kind = np.dtype(kind)
        out[name] = np.frombuffer(flat, kind, int(n), at)
        at += int(n) * kind.itemsize
    return out


def cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of data, end to end."""
    return np.concatenate([data[x : x + n] for x, n in zip(starts.tolist(), sizes.tolist(), strict=True)])


def gathered(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Blobs with the same arrays, put end to end."""
    parts = [unpack(b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, text): _key tells apart rows that repeat an id with another text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col), text).alias("_key"), text.alias("text"))


def part_count(rows: DataFrame) -> int:
    """How many parts all texts are dealt into: as many as their bytes ask for, and no fewer than a shuffle has tasks. A
    part is held in memory by one task, so it must not grow with the input."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(U)) % U(parts)).astype(np.int64)


@dataclass(frozen=True)
class Windows:
    """Windows of `length` symbols, found by grams of `gram` symbols; parts is the number of tasks of a shuffle, and of
    the ranges of gram hashes, or buckets, each of which is held in memory by itself. A gram that `hot` anchors have is
    hot."""

    symbols: Symbols
    length: int
    gram: int
    parts: int
    hot: int = HOT

    @property
    def buckets(self) -> int:
        return self.parts

    @property
    def span_type(self) -> type:
        """Fits the number of windows that can share an anchor."""
        return np.uint8 if self.length - self.gram < 256 else np.uint32


def anchor_runs(rows: DataFrame, windows: Windows) -> DataFrame:
    """(bucket, blob): the anchors of all texts, dealt by ranges of their gram's hash."""
    symbols, length, gram, buckets = windows.symbols, windows.length, windows.gram, windows.buckets

    def run(batches):
        def flush(held):
            ids, keys, row, hashes, first, last = (np.concatenate(c) for c in zip(*held, strict=True))
            # an anchor has the smallest hash of its window, so most lie in the lowest ranges; mixed once more they are even
            hashes = mix(hashes)
            high = (hashes >> U(32)).astype(np.int64)
            bucket = high * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            made = [(b, order[x:y]) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
            blobs = []
            for _, at in made:
                docs, index = np.unique(row[at], return_inverse=True)
                count = np.bincount(index, minlength=len(docs))
                # rows keep their order, so places rise within a text and pack well
                blobs.append(
                    pack(
                        id=ids[docs], key=keys[docs], count=count.astype(np.uint32), hash=lead(hashes[at]),
                        first=np.diff(first[at], prepend=0).astype(np.int32), span=(last[at] - first[at]).astype(windows.span_type),
                    )
                )
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        held, size, base = [], 0, 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, data, bounds in text_slices(batch.column(2)):
                items, start = symbols(data, bounds)
                row, hashes, _, first, last = anchors(items, start, length, gram)
                n = len(bounds) - 1
                held.append((ids[at : at + n], keys[at : at + n], row + base, hashes, first - start[row], last - start[row]))
                base, size = base + n, size + len(row)
                if size >= ANCHORS:
                    yield flush(held)
                    held, size, base = [], 0, 0
        if size:
            yield flush(held)

    return rows.mapInArrow(run, "bucket int, blob binary")


def lead(hashes: np.ndarray) -> np.ndarray:
    """What of a gram's hash travels: 32 bits, besides the bucket's range. Chance equals are only candidates."""
    return (hashes & U(0xFFFFFFFF)).astype(np.uint32)


def candidates(runs: DataFrame, windows: Windows, samples: int = 0) -> DataFrame:
    """(part, blob): anchors whose gram some other document has too, dealt by document, with a route: equal grams have
    one. It is the hash of the smallest id that has the gram, the anchor's reference, so neighbouring anchors mostly
    share it; an anchor whose gram is hot has the gram's own hash. If samples are asked for, anchors keep the gram's
    code instead, and part -1 holds, for every bucket, so many places of its sorted anchors with the symbols that lie
    between them."""
    parts, length = windows.parts, windows.length

    def run(key, table):
        bucket = key[0].as_py()
        held = [unpack(b) for b in table.column("blob").to_pylist()]
        ids, keys, count, span = (np.concatenate([h[c] for h in held]) for c in ("id", "key", "count", "span"))
        first = np.concatenate([np.cumsum(h["first"], dtype=np.int32) for h in held])
        # while anchors are sorted, a document is a number of four bytes, rising with its id
        by = np.argsort(ids, kind="stable")
        number = np.empty(len(by), np.uint32)
        number[by] = np.arange(len(by))
        ids, keys = ids[by], keys[by]
        codes = np.concatenate([h["hash"] for h in held]).astype(U)
        held.clear()
        codes <<= U(32)
        codes |= np.repeat(number, count)
        order = np.argsort(codes)
        codes = codes[order]
        h, doc = (codes >> U(32)).astype(np.uint32), codes.astype(np.uint32)
        del codes
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        least, shared = ids[doc[start]], ids[doc[start]] != ids[doc[start + size - 1]]
        keep = np.repeat(shared, size)
        order, doc, size, least = order[keep], doc[keep], size[shared], least[shared]
        code = (U(bucket) << U(32)) | h[start[shared]].astype(U)
        out = []
        if len(order):
            first, span = first[order], span[order]
            del order, keep, h
            if samples:
                weight = np.cumsum(span.astype(np.int64) + length)
                at = np.unique(np.searchsorted(weight, np.linspace(0, weight[-1], samples + 1)[1:]))
                out.append((-1, pack(code=np.repeat(code, size)[at], id=ids[doc[at]], weight=np.diff(weight[at], prepend=0))))
                own = {"code": np.repeat(code, size)}
            else:
                many = size >= windows.hot
                route = mix(np.where(many, code + U(17), least.astype(U)) ^ many.astype(U))
                own = {"route": np.repeat(route, size), "hot": np.repeat(many.astype(np.uint8), size)}
            part = part_of(keys, parts)
            by = np.lexsort((keys, part))
            number[by] = np.arange(len(by))
            places = number[doc].astype(U)
            places <<= U(32)
            places |= first.astype(np.uint32)
            place = np.argsort(places)
            del places
            # the documents of each part are numbered in a row
            cuts = np.append(0, np.cumsum(np.bincount(part[doc], minlength=parts)))
            for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if x < y:
                    w = place[x:y]
                    out.append((p, pack(key=keys[doc[w]], id=ids[doc[w]], first=first[w], span=span[w], **{k: v[w] for k, v in own.items()})))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    return dealt(runs, parts, "bucket").applyInArrow(run, "part int, blob binary")


def dealt(df: DataFrame, parts: int, key: str = "part"):
    """df by key, with as many tasks as there are parts: tasks, like the groups they hold, do not grow with the input."""
    return df.repartition(parts, key).groupBy(key)


def parcels(rows: DataFrame, parts: int) -> DataFrame:
    """(part, blob): whole texts with ids and keys, compressed, dealt by document; a null id has flag 0."""

    def run(batches):
        def flush(held):
            ids, keys, known, sizes = (np.concatenate([h[i] for h in held]) for i in range(4))
            data = np.concatenate([h[4] for h in held])
            starts = np.cumsum(sizes) - sizes
            part = part_of(keys, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if x < y:
                    w = order[x:y]
                    text = np.concatenate([data[starts[i] : starts[i] + sizes[i]] for i in w])
                    out.append((p, pack(id=ids[w], key=keys[w], known=known[w], size=sizes[w], text=text)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "blob"])

        held, size = [], 0
        for batch in batches:
            known = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.uint8)
            ids, keys = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(1).to_numpy()
            for at, data, bounds in text_slices(batch.column(2)):
                s = slice(at, at + len(bounds) - 1)
                held.append((ids[s], keys[s], known[s], np.diff(bounds), data))
                size += len(data) + 64
                if size >= PARCEL:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "part int, blob binary")


def texts_of(blobs: list[bytes]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(ids, keys and so on, bounds) of each parcel; the bytes are under "text"."""
    for blob in blobs:
        p = unpack(blob)
        yield p, np.concatenate([[0], np.cumsum(p["size"])])


def removed_ranges(marks: dict[str, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """key -> starts and ends of its marks."""
    if not marks:
        return {}
    order = np.argsort(marks["key"], kind="stable")
    keys, at = np.unique(marks["key"][order], return_index=True)
    cuts = np.append(at, len(order))
    return {int(k): (marks["start"][order[x:y]], marks["end"][order[x:y]]) for k, x, y in zip(keys, cuts[:-1], cuts[1:], strict=True)}


def covered(n: int, ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of n items the ranges cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, ranges[0], 1)
    np.add.at(steps, ranges[1], -1)
    return np.cumsum(steps[:-1]) > 0
