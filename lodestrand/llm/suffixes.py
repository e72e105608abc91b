"""Repeated word windows by range-partitioned suffix sorting."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.repeats import Windows, anchor_runs, candidates, covered, cut, dealt, gathered, keyed, pack, parcels, part_count, part_of, removed_ranges, texts_of
from lodestrand.llm.tables import materialize, small_batches
from lodestrand.llm.words import U, mix, prefix_sums, span_hashes, word_hashes, words

#: Words of suffixes in one sort bucket, and places sampled for splitters, which go to the driver, in all.
BUCKET_WORDS, MOST_SAMPLES = 1 << 19, 1 << 20


def word_symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, word_bounds, hashes = word_hashes(data, bounds)
    return hashes, word_bounds


def multikey_quicksort(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Group numbers of the suffixes at starts by their first `depth` tokens; a suffix unlike all others has -1.

    Bentley and Sedgewick's three-way partition, all groups of a level at once: a group's pivot is its middle suffix's
    token, suffixes with a smaller or larger token stay at their depth, those with the same go one deeper. A group that
    agrees on a token is not moved, and one of a single suffix is done.
    """
    out = np.full(len(starts), -1, np.int64)
    order, at = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    size = np.array([len(starts)]) if len(starts) > 1 else np.zeros(0, np.int64)
    if len(starts) < 2:
        return out
    done = 0
    while len(size):
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        token = tokens[starts[order] + at]
        pivot = token[first + size // 2][group]
        side = (token > pivot).astype(np.int8) - (token < pivot) + 1
        mixed = np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first)
        key = group * 3 + side
        if mixed.any():
            move = np.flatnonzero(mixed[group])
            to = move[np.argsort(key[move], kind="stable")]
            order[move], at[move], side[move], key[move] = order[to], at[to], side[to], key[to]
        at = at + (side == 1)
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edge, len(key)))
        full = at[edge] == depth
        if full.any():
            ended = np.repeat(full, size)
            many = full & (size > 1)
            number = np.cumsum(many) - 1 + done
            named = np.repeat(np.where(many, number, -1), size)
            out[order[ended]] = named[ended]
            done += int(many.sum())
        going = np.repeat(~full & (size > 1), size)
        order, at, size = order[going], at[going], size[~full & (size > 1)]
    return out


def _runs(key: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at place, as the fewest (key, start, end) ranges."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], place[first], place[last] + length


def _marks(key: np.ndarray, place: np.ndarray, length: int, parts: int) -> list[tuple[int, bytes]]:
    if not len(key):
        return []
    key, start, end = _runs(key, place, length)
    part = part_of(key, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, pack(key=key[order[x:y]], start=start[order[x:y]], end=end[order[x:y]])) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})


def splitters(sample: list[bytes], wanted_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor's hash, id) at which a bucket of about wanted_words words ends, from the sampled places."""
    if not sample:
        return np.zeros(0, U), np.zeros(0, np.int64)
    s = gathered(sample)
    order = np.lexsort((s["id"], s["code"]))
    total = np.cumsum(s["weight"][order])
    buckets = max(1, int(-(-total[-1] // wanted_words)))
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, buckets) / buckets))
    return s["code"][order[at]], s["id"][order[at]]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Remove every word covered by a window of words that also starts in a document with a smaller id.

    1. Every window holds an anchor, chosen by content alone; anchors whose gram only one document has are dropped:
       their windows cannot repeat. No repeat is lost.
    2. What is left are suffixes, in runs that start around an anchor. Places sampled from the sorted anchors give
       splitters, and (anchor's hash, id) range-partitions the suffixes, so a hot anchor is many buckets. This departs
       from the method: the key is the hash of the anchor gram, which may stand anywhere in a window, and not the
       suffix's own leading words. Buckets are in no order of text; equal windows share an anchor and so a key.
    3. A bucket sorts its suffixes by multikey quicksort to the window's depth. In a class of equal windows all but
       those of the smallest id are marked.
    4. Anchors that a splitter cuts lie in several buckets: each of those sends one row per class, its smallest id, and
       the classes are compared across the boundaries.
    5. Marks go to their documents, which are cut and hashed whole.

    Windows are judged on the input and never cross documents. Words are [^\\x20\\x09-\\x0D]+, unchanged, and equal if
    their 64-bit hashes are. Null, empty and short texts lose nothing. A row with a null id loses nothing and takes
    nothing. Rows that repeat an id do not take from each other. An empty table gives an empty result. Other columns
    are not read. All occurrences of a repeated gram meet in one task as about ten bytes each.

    Returns doc_id, n_words, n_removed, kept_sha256.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    parts = part_count(rows)
    windows = Windows(word_symbols, window, gram, parts)
    found = materialize(candidates(anchor_runs(rows, windows), windows, samples=max(1, min(128, MOST_SAMPLES // windows.buckets))))
    cut_code, cut_id = splitters([r["blob"] for r in found.where("part < 0").select("blob").collect()], bucket_words)
    straddling = np.unique(cut_code)
    texts = materialize(parcels(rows, parts))

    def suffix_rows(key, left, right):
        """Runs of suffixes around the candidate anchors of a part's documents, by bucket."""
        c = gathered(right.column("blob").to_pylist())
        out: list[tuple[int, bytes]] = []
        if c and left.num_rows:
            order = np.lexsort((c["first"], c["key"]))
            c = {k: v[order] for k, v in c.items()}
            names, at = np.unique(c["key"], return_index=True)
            upto = np.append(at[1:], len(order))
            where = {int(k): (x, y) for k, x, y in zip(names, at, upto, strict=True)}
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for p, bounds in texts_of(left.column("blob").to_pylist()):
                starts, ends, word_bounds = words(p["text"], bounds)
                picked, base = [], []
                seen = set()
                for i, k in enumerate(p["key"].tolist()):
                    if k in where and p["known"][i] and k not in seen:
                        seen.add(k)
                        x, y = where[k]
                        picked.append(np.arange(x, y))
                        base.append(np.full(y - x, word_bounds[i]))
                if not picked:
                    continue
                w, base = np.concatenate(picked), np.concatenate(base)
                a = base + c["first"][w]
                lo, hi = starts[a], ends[a + c["span"][w].astype(np.int64) + window - 1]
                held.append((w, hi - lo, cut(p["text"], lo, hi - lo)))
            if held:
                # one blob for each bucket, not for each parcel too: parcels, parts and buckets all grow with the input
                w, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                start = np.cumsum(size) - size
                code, ids = c["code"][w], c["id"][w]
                bucket = np.searchsorted(cut_code, code, side="left")
                # among splitters with this anchor, the first whose id is not smaller
                high = np.searchsorted(cut_code, code, side="right")
                for i in np.flatnonzero(high > bucket):
                    bucket[i] += np.searchsorted(cut_id[bucket[i] : high[i]], ids[i])
                by = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
                for x, y in zip(edge, np.append(edge[1:], len(by)), strict=True):
                    s = by[x:y]
                    out.append((int(bucket[s[0]]), pack(key=c["key"][w[s]], id=ids[s], code=code[s], first=c["first"][w[s]], span=c["span"][w[s]], size=size[s], text=cut(text, start[s], size[s]))))
        return _table(out)

    def sort_bucket(key, table):
        b = gathered(table.column("blob").to_pylist())
        bounds = np.concatenate([[0], np.cumsum(b["size"])])
        _, _, word_bounds, hashes = word_hashes(b["text"], bounds)
        _, tokens = np.unique(hashes, return_inverse=True)
        each = b["span"].astype(np.int64) + 1
        run = np.repeat(np.arange(len(each)), each)
        step = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
        starts = word_bounds[run] + step
        ids, keys, place = b["id"][run], b["key"][run], b["first"][run].astype(np.int64) + step
        group = multikey_quicksort(tokens, starts, window)
        least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        known = group >= 0
        np.minimum.at(least, group[known], ids[known])
        later = np.zeros(len(run), bool)
        later[known] = ids[known] > least[group[known]]
        out = _marks(keys[later], place[later], window, parts)
        # what a splitter cuts is compared across boundaries: the rows that hold a class's smallest id here
        edge = np.isin(b["code"], straddling)[run] & ~later
        if edge.any():
            sums = prefix_sums(hashes)
            d1 = span_hashes(sums, starts[edge], starts[edge] + window)
            d2 = span_hashes(prefix_sums(mix(hashes + U(41))), starts[edge], starts[edge] + window)
            part = (d1 % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            cols = {"d1": d1, "d2": d2, "id": ids[edge], "key": keys[edge], "place": place[edge]}
            out += [(-1 - q, pack(**{k: v[order[x:y]] for k, v in cols.items()})) for q, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
        return _table(out)

    def across(key, table):
        c = gathered(table.column("blob").to_pylist())
        order = np.lexsort((c["id"], c["d2"], c["d1"]))
        d1, d2, ids = c["d1"][order], c["d2"][order], c["id"][order]
        new = np.ones(len(order), bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = order[ids > least]
        return _table(_marks(c["key"][later], c["place"][later], window, parts))

    def finish(key, left, right):
        ranges = removed_ranges(gathered(right.column("blob").to_pylist()))
        ids, known, n, removed, digest = [], [], [], [], []
        for p, bounds in texts_of(left.column("blob").to_pylist()):
            whole = p["text"].tobytes()
            for i, k in enumerate(p["key"].tolist()):
                own = whole[bounds[i] : bounds[i + 1]].split()
                gone = ranges.get(k) if p["known"][i] else None
                kept = own
                if gone is not None:
                    kept = list(compress(own, ~covered(len(own), gone)))
                n.append(len(own))
                removed.append(len(own) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            ids += p["id"].tolist()
            known += p["known"].tolist()
        return pa.table({"doc_id": pa.array([i if k else None for i, k in zip(ids, known, strict=True)], pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    shape = "part int, blob binary"
    suffixes = dealt(texts, parts).cogroup(dealt(found.where("part >= 0"), parts)).applyInArrow(suffix_rows, shape)
    sorted_ = materialize(dealt(suffixes, max(parts, len(cut_code) + 1)).applyInArrow(sort_bucket, shape))
    marks = sorted_.where("part >= 0").unionAll(dealt(sorted_.where("part < 0"), parts).applyInArrow(across, shape))
    return dealt(texts, parts).cogroup(dealt(marks, parts)).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
