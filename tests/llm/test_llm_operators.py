"""Each operator against a plain version, on rows made to be awkward."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import automata, chat, embeddings, exact_dedup, graph, jaccard, mixing, packing, quality, repeats, substrings, suffixes, toxicity
from lodestrand.llm.anchors import anchors, sliding_minimum
from lodestrand.llm import labelled as labelled_rows
from lodestrand.llm.labelled import fold

SPACE = re.compile("[\x20\x09-\x0d]+")
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _key int, n int, token string, component_id int, _salt int, size int, part int"


def make_rows():
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    shared = say(70)
    texts = [None, None, "", " \t\n ", "one", "One", "two words", say(120), say(400), say(3000)]
    for k in range(4):
        base = say(150)
        texts += [base, base, base.replace(" ", "  ", 3), base + " more", " ".join(base.split()[3:]), base.upper()]
        edited = base.split()
        for i in range(0, 150, 30 + 10 * k):
            edited[i] = "edit"
        texts.append(" ".join(edited))
    texts += [f"{say(20)} {shared} {say(20)}" for _ in range(6)] + [shared, "é ñ ß " * 40, "é ñ ß " * 41, "ab" * 80, "ab" * 60, "x" * 49, "x" * 50, "x" * 51]
    order = rng.permutation(len(texts))
    rows = [(int(order[i]), t, "en", [None, "b", "a", "é"][i % 4], None if i % 5 else i, 1, 2, 3, "t", 4, 5, 6, 7) for i, t in enumerate(texts)]
    return [*rows, rows[10], (None, texts[10], *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_dedup(docs, plain, none):
    groups = {}
    for i, t, _ in plain:
        groups.setdefault(SPACE.sub(" ", t), []).append(i)
    expected = []
    for i, t, _ in plain:
        t = SPACE.sub(" ", t)
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        expected.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert table(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)
    assert exact_dedup.exact_dedup(none).isEmpty()


def components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def linked(plain, n, percent):
    """(id, set size, component) by comparing all pairs."""

    def shingles(t):
        w = [x for x in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, _ in plain]
    ids = [i for i, _, _ in plain]
    least = {}
    links = [
        (a, b)
        for a in range(len(ids))
        for b in range(a)
        if None not in (ids[a], ids[b]) and (ids[a] == ids[b] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    ]
    label = components(len(ids), links)
    for i, k in zip(ids, label, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return sorted(((i, len(s), None if i is None else least[k]) for i, s, k in zip(ids, sets, label, strict=True)), key=repr)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard(docs, plain, none, n, percent):
    expected = linked(plain, n, percent)
    settings = jaccard.Settings(words=n, percent=percent, sketch_bits=12, filter_bits=8)
    assert table(jaccard.jaccard_components(docs, settings), "doc_id", "n_shingles", "component_id") == expected
    assert jaccard.jaccard_components(none, settings).isEmpty()


def test_jaccard_within_a_group_of_one_prefix(spark):
    """Letterheads: sets with equal sizes and prefixes that link with each other, but not with the head of their group."""
    rng = np.random.default_rng(8)
    fresh = itertools.count()
    say = lambda k: " ".join(f"x{next(fresh)}" for _ in range(k))
    head, bodies = f"{say(22)} S", [say(70), say(65), say(5), say(5)]
    a, b, c, d = bodies
    texts = [f"{head} {a}", f"{head} {b} {c}", f"{head} {b} {d}", *(x for x in bodies for _ in range(10))]
    pieces = [say(12) for _ in range(14)]
    for _ in range(3):
        head = say(24)
        for _ in range(40):
            chosen = list(rng.choice(14, 6, replace=False))
            texts.append(" ".join([head, *(pieces[k] for k in chosen)]))
            words = texts[-1].split()
            words[-rng.integers(1, 6)] = say(1)
            texts.append(" ".join(words))
    texts += [p for p in pieces for _ in range(60)]
    order = rng.permutation(len(texts) - 3) + 4
    plain = [(i + 1 if i < 3 else int(order[i - 3]), t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in plain], "doc_id long, text string")
    for percent in (85, 80, 60):
        expected = linked(plain, 4, percent)
        assert table(jaccard.jaccard_components(docs, jaccard.Settings(percent=percent)), "doc_id", "n_shingles", "component_id") == expected
        assert percent != 85 or (3, 90, 2) in expected


def removed(items, windows, length):
    flags = np.zeros(len(items), bool)
    for p in windows:
        flags[p : p + length] = True
    return flags


@pytest.mark.parametrize("bucket", [1 << 20, 60])
def test_suffixes(docs, plain, none, bucket):
    words = [t.encode().split() for _, t, _ in plain]
    first = {}
    for (i, _, _), w in zip(plain, words, strict=True):
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p : p + 50])
                first[k] = min(i, first.get(k, i))
    expected = []
    for (i, _, _), w in zip(plain, words, strict=True):
        gone = removed(w, [p for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i], 50)
        expected.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert sum(e[2] for e in expected) > 500
    assert table(suffixes.suffix_dedup(docs, bucket_words=bucket), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    assert suffixes.suffix_dedup(none).isEmpty()


@pytest.mark.parametrize(("shard", "hot"), [(160_000, 256), (100, 256), (160_000, 2), (100, 5)])
def test_substrings(docs, plain, none, shard, hot):
    first = {}
    for i, t, _ in plain:
        b = t.encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    expected = []
    for i, t, _ in plain:
        b = t.encode()
        gone = removed(b, [p for p in range(len(b) - 49) if i is not None and first[b[p : p + 50]] < i], 50)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert table(substrings.substring_dedup(docs, shard_bytes=shard, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)
    assert substrings.substring_dedup(none).isEmpty()


def test_grams_in_common_without_a_window(spark):
    """Texts that share bytes, but no whole window: shards get candidates of which none repeats."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = text(49)
    rows = [(i, text(200) + shared + text(200)) for i in range(3)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(got) == [(i, len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]


def test_repeated_windows_and_meeting(monkeypatch):
    """The pieces of runs whose windows another id's run of the route has, and texts that meet others: as found plainly,
    in one pass and in many."""
    rng = np.random.default_rng(11)
    for slice_bytes in (1 << 20, 40):
        monkeypatch.setattr(substrings, "SLICE", slice_bytes)
        monkeypatch.setattr(substrings, "HELD", slice_bytes)
        runs = [bytes(rng.integers(97, 99, rng.integers(6, 14)).astype(np.uint8)) for _ in range(60)]
        route, ids = np.sort(rng.integers(0, 5, 60)).astype(np.uint64), rng.integers(0, 30, 60)
        sizes = np.array([len(r) for r in runs])
        which, a, z = substrings.repeated_windows(np.frombuffer(b"".join(runs), np.uint8), sizes, route, ids, 6)
        got = sorted((int(i), int(w)) for i, x, y in zip(which, a, z, strict=True) for w in range(x, y - 5))
        windows = [(i, w) for i, r in enumerate(runs) for w in range(len(r) - 5)]
        has = lambda i, w, other: any(route[j] == route[i] and other(j) and runs[i][w : w + 6] in runs[j] for j in range(60))
        assert got == [(i, w) for i, w in windows if has(i, w, lambda j, i=i: ids[j] != ids[i])] and 0 < len(got) < len(windows)
        met = [any(has(i, w, lambda j, i=i: runs[j] != runs[i]) for w in range(len(runs[i]) - 5)) for i in range(60)]
        assert substrings.meeting(runs, route, 6) == met


def test_copies_need_no_automaton(monkeypatch):
    """Automata are built when a text that is no copy has to be streamed, and only of texts that meet others."""
    added = []
    monkeypatch.setattr(substrings.SuffixAutomaton, "add", lambda self, text, f=substrings.SuffixAutomaton.add: (added.append(text), f(self, text))[1])
    ids, a, b = np.arange(4), b"abcdefgh", b"xcdefgz"
    assert substrings.stream_group(ids[:3], [a] * 3, 4, 100) == [[], [(0, 5)], [(0, 5)]] and not added
    texts = [b"0123456789", a, a, b]
    assert substrings.stream_group(ids, texts, 4, 100, substrings.meeting(texts, np.zeros(4, np.uint64), 4)) == [[], [], [(0, 5)], [(1, 3)]]
    assert added == [a]


def test_runs_travel_once_for_each_shard(spark, monkeypatch):
    """A part sends a shard one row, however many parcels its texts came in: parcels, parts and shards all grow."""
    routed = []
    monkeypatch.setattr(substrings, "dealt", lambda df, parts, key="part", f=substrings.dealt: (routed.append((df, parts)), f(df, parts, key))[1])
    text = F.concat(F.repeat(F.sha2(F.floor(F.col("id") / 2).cast("string"), 512), 1), F.col("id").cast("string"))
    substrings.substring_dedup(spark.range(0, 2000, 1, 10).select(F.col("id").alias("doc_id"), text.alias("text")))
    df, shards = next((d, n) for d, n in routed if n == 4 * routed[0][1])
    assert shards < df.count() <= routed[0][1] * shards


def test_anchors_are_dealt_evenly(spark):
    """Anchors are minima of hashes; their buckets hold equal shares all the same, as a task holds one in memory."""
    rng = np.random.default_rng(5)
    rows = [(i, i, "".join(map(chr, rng.integers(97, 123, 4000)))) for i in range(60)]
    windows = repeats.Windows(substrings.byte_symbols, 50, 20, 8)
    made = repeats.anchor_runs(spark.createDataFrame(rows, "_id long, _key long, text string").coalesce(1), windows).collect()
    sizes = collections.Counter()
    for r in made:
        sizes[r["bucket"]] += len(repeats.unpack(r["blob"])["hash"])
    assert len(sizes) == windows.buckets and max(sizes.values()) < 1.5 * sizes.total() / windows.buckets


def test_suffixes_travel_once_for_each_bucket(spark, monkeypatch):
    """A part sends a sort bucket one row, however many parcels its texts came in."""
    routed = []
    monkeypatch.setattr(suffixes, "dealt", lambda df, parts, key="part", f=suffixes.dealt: (routed.append((df, parts)), f(df, parts, key))[1])
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.hash(F.floor(F.col("id") / 2), i).cast("string")))
    suffixes.suffix_dedup(spark.range(0, 2000, 1, 10).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert 0 < routed[2][0].count() <= routed[0][1]


def test_automaton_matches_find():
    rng = np.random.default_rng(1)
    for _ in range(200):
        texts = [bytes(rng.choice([97, 98, 99], rng.integers(1, 14)).tolist()) for _ in range(4)]
        a = automata.SuffixAutomaton()
        for t in texts[1:]:
            a.add(t)
        for n in (1, 2, 3, 5):
            got = {p for x, y in a.matched(texts[0], n) for p in range(x - n + 1, y - n + 1)}
            assert got == {p for p in range(len(texts[0]) - n + 1) if any(texts[0][p : p + n] in t for t in texts[1:])}


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 50, 500):
        tokens = rng.integers(0, 3, size + 5)
        starts = np.arange(size)
        group = suffixes.multikey_quicksort(tokens, starts, 5)
        keys = [tuple(tokens[s : s + 5]) for s in starts]
        for i in range(size):
            same = [j for j in range(size) if keys[j] == keys[i]]
            assert (group[i] == -1) == (len(same) == 1)
            assert len(same) == 1 or all((group[j] == group[i]) == (keys[j] == keys[i]) for j in range(size))


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, 300).astype(np.uint64)
    assert (sliding_minimum(x, 7) == [x[i : i + 7].min() for i in range(294)]).all()
    bounds = np.array([0, 3, 120, 120, 300])
    row, _, place, first, last = anchors(x, bounds, 20, 4)
    seen = {(r, p) for r, a, b in zip(row, first, last, strict=True) for p in range(a, b + 1)}
    assert seen == {(r, p) for r in range(4) for p in range(bounds[r], bounds[r + 1] - 19)}
    assert ((place >= last) & (place <= first + 16)).all()


def test_anchors_of_more_symbols_than_a_place_can_number(monkeypatch):
    x = np.random.default_rng(17).integers(0, 1000, 1000).astype(np.uint64)
    for bounds in ([0, 1000], [0, 3, 300, 300, 1000], [0, 256, 512, 1000]):
        whole = anchors(x, np.array(bounds), 20, 4)
        monkeypatch.setattr("lodestrand.llm.anchors.PLACE", 8)
        for a, b in zip(whole, anchors(x, np.array(bounds), 20, 4), strict=True):
            assert (a == b).all()
        monkeypatch.undo()


def test_packing(docs, plain, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=256).toPandas()
    expected = []
    for i, t, _ in plain:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        expected += [(i, p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.pack(none, path).isEmpty()


def test_fill_plan_uses_every_piece():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300):
        counts = np.bincount(rng.integers(1, 101, n), minlength=101)
        used = np.zeros(101, int)
        for pattern, times in packing.fill_plan(counts, 100):
            assert sum(a * k for a, k in pattern) <= 100
            for a, k in pattern:
                used[a] += k * times
        assert (used == counts).all()
    assert packing.SumIndex(np.bincount([30, 30, 40], minlength=101)).exact(100) == (40, 30, 30)
    assert packing.SumIndex(np.bincount([50], minlength=101)).exact(100) == ()


def test_sum_index_against_all_combinations():
    """While counts fall, a single, a pair or a triple is found exactly where there is one."""
    rng = np.random.default_rng(6)
    for size in (3, 8, 25):
        index = packing.SumIndex(np.bincount(rng.integers(1, 41, size), minlength=41))
        while any(index.free):
            here = [n for n, k in enumerate(index.free) for _ in range(k)]
            for total in rng.permutation(41)[:20].tolist():
                for r, found in ((2, index.pair(total)), (3, index.triple(total))):
                    sums = {sum(c) for c in itertools.combinations(here, r)}
                    assert (total in sums) == bool(found), (here, total, found)
                    assert not found or sum(found) == total and not collections.Counter(found) - collections.Counter(here)
            index.free[rng.choice(here)] -= 1


def test_packing_with_any_tokenizer():
    """Chunks where the tokenizer allows them, whole texts with any other; a memo that is emptied all the time."""
    import public_tokenizers

    marks = "aB'sSt 0129.,-_|<>\n\t\x00\x1c\x85\u3000\xa0éÉßİΣσςŒ中²½ǅé"
    rng = random.Random(3)
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "IT'S don't we'LL ''s", None, ""]
    for name, chunks in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        for memo in (3, 1000):
            own = packing.ChunkEncoder(public_tokenizers.path(name))
            own.chunks.most = own.pieces.most = memo
            assert own.by_chunk == chunks
            for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_mixing(docs, plain, none):
    got = mixing.mix_sources(docs, block_words=8, shard_words=500).toPandas()
    sizes = {}
    for _, t, s in plain:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, opened = {}, 1.5 * sum(sizes.values()), set(names)
    while opened:
        level = left / sum(weight[s] for s in opened)
        over = {s for s in opened if weight[s] * level > 2 * sizes[s]}
        for s in over or opened:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        opened = opened - over if over else set()
    assert sorted(got.groupby("source_no").target.first().round(6)) == sorted(round(t, 6) for t in target.values())
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all() and len(got) == len(plain)
    by = got.groupby("source_no").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((by.t - by.k).abs() <= 0.05 * by.t + 16).all()
    again = mixing.mix_sources(docs.repartition(5), block_words=8, shard_words=500).toPandas()
    assert sorted(map(repr, got.itertuples(index=False))) == sorted(map(repr, again.itertuples(index=False)))
    assert mixing.mix_sources(none).isEmpty()


def test_sainte_lague_gives_the_highest_quotients(spark):
    votes = [(i, float(v), 10**6) for i, v in enumerate([340, 280, 160, 60, 15, 0])]
    got = {r.k: r.quota for r in mixing.sainte_lague(spark.createDataFrame(votes, "k int, v double, m long"), ["k"], "v", F.lit(7).cast("long"), "m").collect()}
    seats = dict.fromkeys(range(6), 0)
    for _ in range(7):
        best = max(range(6), key=lambda i: votes[i][1] / (2 * seats[i] + 1))
        seats[best] += 1
    assert got == seats


@pytest.mark.parametrize("settings", [embeddings.Settings(), embeddings.Settings(cell_rows=10, home_rows=7, guest_rows=9)])
def test_embeddings(spark, settings):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    v = [(b + rng.normal(size=8) * s).tolist() for b in base for s in (0, 0.03, 0.1, 0.2)]
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [], 1), (104, [None, *v[0][1:]], 1)]
    rows += [(105, v[0][:5], 1), (106, v[0][:5], 1), (3, v[0], 1), (None, v[0], 1), (107, [1e300 * x for x in v[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")

    def usable(x):
        return bool(x) and None not in x and all(map(np.isfinite, x)) and any(x)

    def linked(a, b):
        if a[0] == b[0] or None in (a[0], b[0]) or not usable(a[1]) or not usable(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(z) / np.abs(z).max() for z in (a[1], b[1]))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95

    n, edges = {}, []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if linked(a, b):
                n[a[0]] = n.get(a[0], 0) + 1
                edges.append((i, j))
            elif a[0] is not None and a[0] == b[0]:
                edges.append((i, j))
    label, least = components(len(rows), edges), {}
    for r, k in zip(rows, label, strict=True):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    expected = sorted(((r[0], n.get(r[0], 0), None if r[0] is None else least[k]) for r, k in zip(rows, label, strict=True)), key=repr)
    assert table(embeddings.range_join(df, settings), "vec_id", "n_links", "component_id") == expected
    assert embeddings.range_join(df.limit(0), settings).isEmpty()


def test_pivots_that_nearly_coincide_exclude_nothing_within_reach():
    """Copies of one vector that differ by float32 rounding, as pivots and around them."""
    rng = np.random.default_rng(16)
    reach = np.sqrt(2 - 2 * 0.95)
    for _ in range(20):
        base = rng.normal(size=64)
        copies = [(base * k).astype(np.float32).astype(np.float64) / k for k in (1, 1.1, 3, 0.7, 13)] + [rng.normal(size=64)]
        made = embeddings._pivots([{"v": list(c)} for c in copies], 6)[64]
        assert len(made) == 2
        m = base / np.linalg.norm(base) + rng.normal(size=(100, 64)) * 0.01
        m /= np.linalg.norm(m, axis=1)[:, None]
        linked = m @ m.T >= 0.95
        for pivots in (made, np.array([c / np.linalg.norm(c) for c in copies])):
            home, near = embeddings._guests(m, pivots, reach)
            assert near[:, home][linked.T].all()


def test_pivots_come_from_usable_vectors(spark):
    assert embeddings._pivots([{"v": [0.0, 0.0]}, {"v": [None, 1.0]}, {"v": [float("nan"), 1.0]}], 3) == {}
    bad = ([0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [])
    rows = [(i, bad[i % 5]) for i in range(40)] + [(40, [1.0, 0.1]), (41, [1.0, 0.0]), (42, [0.0, 1.0])]
    got = embeddings.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    links = {40: (1, 40), 41: (1, 40)}
    assert table(got, "vec_id", "n_links", "component_id") == sorted(((i, *links.get(i, (0, i))) for i in range(43)), key=repr)


def test_components_of_stars_and_paths(spark):
    edges = [(i, i + 1) for i in range(30)] + [(90, k) for k in range(50, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys([*range(50, 60), 90], 50)}


def test_chat(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "same turn"), (1, None, None, "lost"), (1, 1, "ann", "hi"),
        (2, 0, "system", "alone"), (None, 0, "ann", "no id"), (3, 1, "é", "ü" * 2000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = chat.rotate_perspectives(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(chat.OP6_SQL).df()
    show = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).astype(str).values.tolist()))
    assert show(got.astype({"conv_id": "Int64"})) == show(want.astype({"conv_id": "Int64"})) and len(got) == 5
    ann = got[(got.conv_id == 1) & (got.perspective == "ann")].iloc[0]
    spans = [ann.text[int(a) : int(b)] for a, b in (s.split(":") for s in ann.mask_spans.split(","))]
    assert spans == ["hi<|end|>", "hi<|end|>", "same turn<|end|>"]
    short = chat.rotate_perspectives(df, part_turns=2).where("conv_id = 1 and perspective = 'ann'").toPandas().sort_values("part")
    assert "".join(short.text) == ann.text and list(short.n_turns) == [2, 2, 2]
    assert chat.rotate_perspectives(df.limit(0)).isEmpty()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(900):
        words = rng.choice(WORDS[:200], 40).tolist()
        toxic, bad = i % 6 == 0, i % 5 == 0
        if toxic:
            words[int(rng.integers(0, 40))] = "vile" + str(rng.choice(["er", "st", "ly", "ness"]))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        docs.append((i, text, len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, None, None), (5000, "", 0), (5001, None, None), (0, docs[0][1], 3)]
    labels += [(None, 1, 1), (5000, None, None), (7, 3, 3), (9999, 1, 1), (0, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels, fold("doc_id", 5) != 0).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[[not pd.isna(i) and i < 900 and zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in got.doc_id]]
    assert ((held.score >= 0.5) == (held.doc_id % 6 == 0)).mean() > 0.97
    assert got[got.doc_id.isin([5000, 5001])].score.nunique() == 1
    assert set(toxicity.toxicity(docs, labels.limit(0), F.lit(True)).toPandas().score < 0.01) == {True}
    assert toxicity.toxicity(docs.limit(0), labels, F.lit(True)).isEmpty()
    again = toxicity.toxicity(docs.repartition(7), labels, fold("doc_id", 5) != 0).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.score, strict=True)) == sorted(zip(again.doc_id.fillna(-1), again.score, strict=True))


def test_toxicity_keeps_columns(labelled):
    docs, labels = labelled
    clash = ["text", "n_chars", "_text", "score", "_id", "label", "held_out", "predicted", "c0", "c1", "found"]
    wide = docs.select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in clash[2:] if c != "score"))
    got = toxicity.toxicity(wide, labels, F.lit(True), keep=clash, score_col="toxic score")
    assert set(got.columns) == {"doc_id", *clash, "toxic score"} and table(got, "doc_id", *clash) == table(wide, "doc_id", *clash)


def test_a_sample_is_bounded_and_takes_an_id_once(labelled):
    docs, labels = labelled
    sample = lambda most: labelled_rows.gathered_rows(labelled_rows.training_rows(docs.unionByName(docs), labels, "toxic", F.lit(True), most).withColumn("text", F.encode("text", "utf-8")), "text")
    rows, data, spans = sample(10_000)
    few = sample(50)[0]
    text = dict(docs.where("text is not null").select("doc_id", "text").collect())
    assert all(data[a:b].decode() == text[r["_id"]] for r, (a, b) in zip(rows, spans, strict=True))
    assert len(rows) == 900 and len({r["_id"] for r in rows}) == 900
    assert [r["_id"] for r in few] == [r["_id"] for r in rows[:50]]


def test_packed_features():
    rng = np.random.default_rng(4)
    for bits in (12, 16, 20):
        found = [np.unique(rng.integers(0, 1 << bits, n)) for n in (0, 1, 50, 3000)]
        blobs = [toxicity.packed(f, bits) for f in found]
        ends = np.cumsum([len(b) for b in blobs]).tolist()
        again = toxicity.Packed(b"".join(blobs), list(zip([0, *ends[:-1]], ends, strict=True)), bits)
        assert all((a == b).all() for a, b in zip(found, again, strict=True)) and len(again) == 4


def test_ftrl_against_a_plain_loop():
    """Every coordinate by itself, as the published algorithm states it."""
    rng = np.random.default_rng(14)
    settings = toxicity.Settings(bits=8, l1=0.4, epochs=3)
    texts = [np.unique(rng.integers(0, 256, 12)) for _ in range(60)]
    labels = np.array([float(t[0] % 3 == 0) for t in texts])
    z, n = [0.0] * 256, [0.0] * 256
    bias, bias_n = math.log(labels.mean() / (1 - labels.mean())), 1.0

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return -(z[i] - math.copysign(settings.l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    order = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for k in order.permutation(len(labels)):
            w = {i: weight(i) for i in texts[k].tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[k]
            if labels[k]:
                g *= settings.weight_of_1
            for i, wi in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
            bias_n += g * g
            bias -= settings.alpha / (settings.beta + math.sqrt(bias_n)) * g
    m = toxicity.fit(texts, labels, settings)
    expected = np.array([weight(i) for i in range(256)])
    assert np.allclose(m.dense(), expected, atol=1e-6) and np.isclose(m.bias, bias)
    assert 0 < len(m.index) < 256


def test_quality(labelled):
    docs, labels = labelled
    got = quality.quality(docs, labels, fold("doc_id", 3) != 1).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[[not pd.isna(i) and i < 900 and zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in got.doc_id]]
    assert ((held.score >= 0.5) == (held.doc_id % 5 != 0)).mean() > 0.97
    assert quality.quality(docs, labels.limit(0), F.lit(True)).count() == docs.count()
    assert quality.quality(docs.limit(0), labels, F.lit(True)).isEmpty()


def test_factorisation_machine_fit_against_a_plain_loop():
    """One epoch of AdaGrad with gradients taken numerically from the loss over all pairs."""
    rng = np.random.default_rng(15)
    stats, bits, rank = len(quality.STATISTICS), 3, 2
    words = 1 << bits
    settings = quality.Settings(bits=bits, rank=rank, epochs=1, batch=4, l2=1e-3)
    texts = [(b := np.unique(rng.integers(0, words, 4)), rng.random(len(b))) for _ in range(8)]
    table_, labels = rng.normal(size=(8, stats)), np.array([0, 1, 1, 0, 1, 0, 0, 1.0])
    got = quality.fit(texts, table_, labels, settings)

    draw, size = np.random.default_rng(settings.seed), words + stats
    mean, spread = table_.mean(axis=0), table_.std(axis=0) + 1e-6
    w, v, bias = np.zeros(size), draw.normal(0, 0.05, (size, rank)), math.log(labels.mean() / (1 - labels.mean()))
    x = np.zeros((8, size))
    for i, (b, share) in enumerate(texts):
        x[i, b] = share
    x[:, words:] = np.clip((table_ - mean) / spread, -4, 4)

    def loss(part, bias, w, v):
        total = 0.0
        for i in part:
            out = bias + w @ x[i] + sum(v[a] @ v[b] * x[i, a] * x[i, b] for a in range(size) for b in range(a))
            total += math.log1p(math.exp(out)) - labels[i] * out
        return total / len(part)

    def slope(f, at):
        out = np.zeros_like(at)
        for k in np.ndindex(at.shape):
            up, down = at.copy(), at.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            out[k] = (f(up) - f(down)) / 2e-5
        return out

    seen_w, seen_v, seen_b, scale = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6, np.where(np.arange(size) < words, words**0.25, 1.0)
    order = draw.permutation(8)
    for at in (0, 4):
        part = order[at : at + 4]
        gw = slope(lambda z: loss(part, bias, z, v), w) + settings.l2 * w
        gv = slope(lambda z: loss(part, bias, w, z), v) + settings.l2 * v
        gb = slope(lambda z: loss(part, z[0], w, v), np.array([bias]))[0] * len(part)
        shown = np.concatenate([np.isin(np.arange(words), np.concatenate([texts[i][0] for i in part])), np.ones(stats, bool)])
        gw, gv = gw * shown, gv * shown[:, None]
        seen_w += gw * gw
        seen_v += gv * gv
        w -= settings.rate * scale * gw / np.sqrt(seen_w)
        v -= settings.rate * gv / np.sqrt(seen_v)
        seen_b += (gb / len(part)) ** 2
        bias -= settings.rate * gb / len(part) / seen_b**0.5
    assert np.allclose(got.w, w, atol=2e-3) and np.allclose(got.v, v, atol=2e-3) and np.isclose(got.bias, bias, atol=2e-3)


def test_pairs_cost_linear_time():
    """The sum-of-squares identity equals the sum over all pairs."""
    rng = np.random.default_rng(9)
    words, stats = 16, len(quality.STATISTICS)
    m = quality.Model(0.3, rng.normal(size=words + stats), rng.normal(size=(words + stats, 3)), np.zeros(stats), np.ones(stats))
    bucket, x, z = np.array([1, 4, 9]), np.array([0.2, 0.5, 0.3]), rng.normal(size=(1, stats)).clip(-4, 4)
    index, value = np.concatenate([bucket, words + np.arange(stats)]), np.concatenate([x, z[0]])
    pairs = sum(m.v[i] @ m.v[j] * a * b for p, (i, a) in enumerate(zip(index, value, strict=True)) for j, b in list(zip(index, value, strict=True))[:p])
    assert np.isclose(quality.scores(m, np.zeros(3, int), bucket, x, z)[0][0], 0.3 + m.w[index] @ value + pairs)
