"""Repeated byte strings by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.automata import SuffixAutomaton
from lodestrand.llm.repeats import HOT, Windows, anchor_runs, candidates, covered, cut, dealt, gathered, keyed, pack, parcels, part_count, part_of, removed_ranges, texts_of, unpack
from lodestrand.llm.tables import materialize, small_batches
from lodestrand.llm.words import BYTE_VALUES, U, mix, prefix_sums, span_hashes

#: Bytes of reference text in one automaton.
SHARD_BYTES = 160_000
#: Bytes of runs that are hashed at once, and windows whose hashes are held at once, about; both bound a task's memory.
SLICE = 1 << 18
HELD = 1 << 20


def byte_symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], bounds


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})


def slices(sizes: np.ndarray, starts: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    """Whole groups, each of sizes[i] bytes and starting at starts[i], in slices of about SLICE bytes."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + SLICE, side="right")))
        yield int(starts[at]), int(starts[to]) if to < len(starts) else end
        at = to


def repeated_windows(text: np.ndarray, sizes: np.ndarray, route: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the longest pieces of each run whose windows all have a hash that another id's run of the same
    route has too: what else a run holds, such as the text around a passage, cannot repeat, and is neither streamed nor
    added. Chance equals stay in; the automata decide. More than HELD windows take several passes, each over a share of
    the hashes, so that only the bytes themselves grow with a group.
    """
    first, count = np.cumsum(sizes) - sizes, sizes - window + 1
    before = np.cumsum(count) - count
    pieces = list(slices(sizes, np.arange(len(sizes)), len(sizes)))
    passes = int(-(-count.sum() // HELD))
    keep = np.zeros(int(count.sum()), bool)

    def rows(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of every window of the runs i to j, and the window's place in the run."""
        row = np.repeat(np.arange(i, j), count[i:j])
        return row, np.arange(before[i], before[i] + len(row)) - before[row]

    for p in range(passes):
        held = []
        for i, j in pieces:
            row, place = rows(i, j)
            start = first[row] - first[i] + place
            hashes = span_hashes(prefix_sums(BYTE_VALUES[text[first[i] : first[j - 1] + sizes[j - 1]]]), start, start + window) ^ mix(route)[row]
            at = np.flatnonzero(hashes % U(passes) == U(p))
            held.append((hashes[at], at + before[i], ids[row[at]]))
        hashes, at, who = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(hashes):
            order = np.argsort(hashes)
            h, who = hashes[order], who[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            many = np.minimum.reduceat(who, new) != np.maximum.reduceat(who, new)
            keep[at[order]] = np.repeat(many, np.diff(np.append(new, len(h))))
    out = []
    for i, j in pieces:
        row, place = rows(i, j)
        kept = keep[before[i] : before[i] + len(row)]
        opens, closes = kept.copy(), kept.copy()
        opens[1:] &= ~kept[:-1] | (row[1:] != row[:-1])
        closes[:-1] &= ~kept[1:] | (row[1:] != row[:-1])
        out.append((row[opens], place[opens], place[closes] + window))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def meeting(texts: list[bytes], route: np.ndarray, window: int) -> list[bool]:
    """For every text, whether it may share a window with another text of its route that is not the very same."""
    number: dict[tuple[int, bytes], int] = {}
    code = [number.setdefault(k, len(number)) for k in zip(route.tolist(), texts, strict=True)]
    if not code:
        return []
    sizes = np.array([len(t) for _, t in number])
    found, _, _ = repeated_windows(np.frombuffer(b"".join(t for _, t in number), np.uint8), sizes, np.array([r for r, _ in number], U), np.arange(len(number)), window)
    flags = np.zeros(len(number), bool)
    flags[found] = True
    return flags[code].tolist()


def stream_group(ids: np.ndarray, texts: list[bytes], window: int, shard_bytes: int, met: list[bool] | None = None) -> list[list[tuple[int, int]]]:
    """For every text of a group, the ranges [a, b) of its windows' starts that some text of a smaller id holds.

    ids must not fall. Each text is streamed through the automata of the reference shards of all smaller ids; then what
    they did not hold joins the newest shard, or a new one if that is full, when the next text has to be streamed. A text
    that meets no other text but its own copies needs neither.
    """
    shards: list[SuffixAutomaton] = []
    waiting: list[bytes] = []
    whole: set[bytes] = set()
    out: list[list[tuple[int, int]]] = []
    at = 0
    while at < len(texts):
        end = at
        while end < len(texts) and ids[end] == ids[at]:
            end += 1
        fresh: list[bytes] = []
        for i, text in enumerate(texts[at:end], at):
            n = len(text) - window + 1
            if text in whole:  # a smaller id has the very same text
                out.append([(0, n)])
                continue
            if met and not met[i]:
                out.append([])
                continue
            for held in waiting:
                if not shards or shards[-1].size >= shard_bytes:
                    shards.append(SuffixAutomaton())
                shards[-1].add(held)
            waiting.clear()
            if not shards:
                fresh.append(text)
                out.append([])
                continue
            found = [(a - window + 1, b - window + 1) for s in shards for a, b in s.matched(text, window)]
            if len(shards) > 1 and len(found) > 1:
                flags = covered(n, (np.array([a for a, _ in found]), np.array([b for _, b in found])))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                found = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            out.append(found)
            here = 0
            for a, b in [*found, (n, n)]:
                if a > here:
                    fresh.append(text[here : a + window - 1])
                here = b
        whole.update(texts[at:end])
        waiting += fresh
        at = end
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 20, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a string of `window` bytes that also starts in a document with a smaller id.

    1. Every window holds an anchor, chosen by content alone; anchors whose gram only one document has are dropped:
       their windows cannot repeat. No repeat is lost.
    2. The first document with a gram is the reference of its anchors. A document's neighbouring anchors with one
       reference are a run of text; equal windows share a gram, hence a reference, so runs are routed to the shard of
       their reference. All documents are reference here, so routing takes the place of a broadcast, which would grow
       with the input.
    3. An anchor whose gram is hot, one of a passage that very many documents share, is a run by itself and routed by its
       gram, so such a passage is spread over many shards. Of equal runs of that kind in one part only the one of the
       smallest id travels; the others are marked at once, as that id has all of their windows.
    4. A shard cuts the runs of one route to the windows whose hash a run of another id has. It takes the pieces by rising
       id: it streams each through the suffix automata of smaller ids,
       whose matching statistics of at least `window` bytes are the repeats, then adds what they lacked. An automaton
       holds shard_bytes of text at most, give or take a run; a full one is followed by another. Copies of a whole piece
       are known by their bytes, and pieces that meet nothing but their copies are not added.
    5. Marks go to their documents, which are cut and hashed whole.

    Texts are UTF-8 bytes; strings are judged on the input and never cross documents. Null, empty and short texts lose
    nothing. A row with a null id loses nothing and takes nothing. Rows that repeat an id do not take from each other.
    An empty table gives an empty result. Other columns are not read. Parts, of texts, grams and routes alike, are as many
    as the texts' bytes ask for. All occurrences of a gram meet in one task as about ten bytes each.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    parts = part_count(rows)
    windows = Windows(byte_symbols, window, gram, parts, hot)
    found = candidates(anchor_runs(rows, windows), windows)
    texts = materialize(parcels(rows, parts))
    shards = parts * 4

    def runs(key, left, right):
        """Runs of candidate text of a part's documents, by shard, and marks that are certain already."""
        c = gathered(right.column("blob").to_pylist())
        out: list[tuple[int, bytes]] = []
        if not c or not left.num_rows:
            return _table(out)
        order = np.lexsort((c["first"], c["key"]))
        keys, first, span, route, hot = (c[k][order] for k in ("key", "first", "span", "route", "hot"))
        end = first + span
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (route[1:] != route[:-1]) | (first[1:] != end[:-1] + 1) | (hot[1:] > 0)
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(keys)) - 1
        keys, first, route, hot, end = keys[at], first[at], route[at], hot[at] > 0, end[to] + window
        shard = part_of(route, shards)
        names, low = np.unique(keys, return_index=True)
        where = {int(k): (x, y) for k, x, y in zip(names, low, np.append(low[1:], len(keys)), strict=True)}
        equal: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for p, bounds in texts_of(left.column("blob").to_pylist()):
            picked, base, owner, seen = [], [], [], set()
            whole = p["text"].tobytes()
            for i, k in enumerate(p["key"].tolist()):
                if k in where and p["known"][i] and k not in seen:
                    seen.add(k)
                    x, y = where[k]
                    picked.append(np.arange(x, y))
                    base.append(np.full(y - x, bounds[i]))
                    owner.append(np.full(y - x, p["id"][i]))
            if not picked:
                continue
            w, base, owner = np.concatenate(picked), np.concatenate(base), np.concatenate(owner)
            often = np.flatnonzero(hot[w])
            spots = zip(route[w[often]].tolist(), (base[often] + first[w[often]]).tolist(), (base[often] + end[w[often]]).tolist(), owner[often].tolist(), w[often].tolist(), strict=True)
            for r, x, y, who, j in spots:
                equal.setdefault((r, whole[x:y]), []).append((who, j))
            w, base, owner = w[~hot[w]], base[~hot[w]], owner[~hot[w]]
            if not len(w):
                continue
            held.append((w, owner, cut(p["text"], base + first[w], end[w] - first[w])))
        if held:
            # one blob for each shard, not for each parcel too: parcels, parts and shards all grow with the input
            w, owner, text = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = end[w] - first[w]
            start = np.cumsum(size) - size
            by = np.argsort(shard[w], kind="stable")
            edge = np.flatnonzero(np.diff(shard[w][by], prepend=-1) != 0)
            for x, y in zip(edge, np.append(edge[1:], len(by)), strict=True):
                s = by[x:y]
                r = w[s]
                out.append((int(shard[r[0]]), pack(key=keys[r], id=owner[s], route=route[r], first=first[r], size=size[s], text=cut(text, start[s], size[s]))))
        sent: dict[int, list] = {}
        gone: list[int] = []
        for (r, text), rows_ in equal.items():
            least = min(rows_)[0]
            gone += [j for who, j in rows_ if who != least]
            for who, j in rows_:
                if who == least:
                    sent.setdefault(int(shard[j]), []).append((who, j, text))
        for q, rows_ in sent.items():
            j, text = np.array([x[1] for x in rows_]), np.frombuffer(b"".join(x[2] for x in rows_), np.uint8)
            out.append((q, pack(key=keys[j], id=np.array([x[0] for x in rows_], np.int64), route=route[j], first=first[j], size=end[j] - first[j], text=text)))
        if gone:
            g = np.array(gone)
            out.append((int(key[0].as_py()) % shards, pack(mark=keys[g], start=first[g].astype(np.int64), end=end[g].astype(np.int64))))
        return _table(out)

    def stream(key, table):
        blobs = [unpack(x) for x in table.column("blob").to_pylist()]
        made = [b for b in blobs if "mark" in b]
        marks = [tuple(np.concatenate([b[c] for b in made]) for c in ("mark", "start", "end"))] if made else []
        blobs = [b for b in blobs if "mark" not in b]
        if blobs:
            b = {k: np.concatenate([x[k] for x in blobs]) for k in blobs[0]}
            del blobs
            bounds = np.concatenate([[0], np.cumsum(b["size"])])
            order = np.lexsort((b["first"], b["key"], b["id"], b["route"]))
            route = b["route"][order]
            edge = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            size = b["size"].astype(np.int64)[order]
            found: list[tuple[int, int, int]] = []
            for x, y in slices(np.add.reduceat(size, edge), edge, len(order)):
                g = order[x:y]
                text = cut(b["text"], bounds[g], size[x:y])
                which, a, z = repeated_windows(text, size[x:y], route[x:y], b["id"][g], window)
                if not len(which):  # only grams are shared here
                    continue
                at = np.append(0, np.cumsum(size[x:y]))[which]
                whole = text.tobytes()
                to = route[x:y][which]
                new = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
                texts_ = [whole[u:v] for u, v in zip((at + a).tolist(), (at + z).tolist(), strict=True)]
                met = meeting(texts_, to, window)
                for i, j in zip(new, np.append(new[1:], len(which)), strict=True):
                    got = stream_group(b["id"][g][which[i:j]], texts_[i:j], window, shard_bytes, met[i:j])
                    for m, ranges in enumerate(got, i):
                        if ranges:
                            k, start = int(b["key"][g[which[m]]]), int(b["first"][g[which[m]]] + a[m])
                            found += [(k, start + u, start + v + window - 1) for u, v in ranges]
            marks += [tuple(np.array(m, np.int64) for m in zip(*found, strict=True))] if found else []
        if not marks:
            return _table([])
        k, start, end = (np.concatenate(m) for m in zip(*marks, strict=True))
        part = part_of(k, parts)
        order = np.lexsort((start, k, part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        return _table([(p, pack(key=k[order[x:y]], start=start[order[x:y]], end=end[order[x:y]])) for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y])

    def finish(key, left, right):
        ranges = removed_ranges(gathered(right.column("blob").to_pylist()))
        cols: list[list] = [[], [], [], [], []]
        for p, bounds in texts_of(left.column("blob").to_pylist()):
            text = p["text"]
            for i, k in enumerate(p["key"].tolist()):
                own = text[bounds[i] : bounds[i + 1]]
                gone = ranges.get(k) if p["known"][i] else None
                spans = removed = 0
                kept = own
                if gone is not None:
                    mask = covered(len(own), gone)
                    removed = int(mask.sum())
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = own[~mask]
                row = (int(p["id"][i]) if p["known"][i] else None, len(own), removed, spans, hashlib.sha256(kept.tobytes()).hexdigest())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = (*[pa.int64()] * 4, pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    shape = "part int, blob binary"
    routed = dealt(texts, parts).cogroup(dealt(found, parts)).applyInArrow(runs, shape)
    marks = dealt(routed, shards).applyInArrow(stream, shape)
    return dealt(texts, parts).cogroup(dealt(marks, parts)).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
