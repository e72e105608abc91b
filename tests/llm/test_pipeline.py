"""Every stage against a plain version of what it decides, on all that the stage before it kept."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import jaccard, mixing, packing, words

SPACE = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    words = [f"t{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(160):
        w = rng.choice(words, 60).tolist()
        if i % 8 == 0:
            w[5] = "rotten"
        docs.append((i, " ".join(w), "en", ["a", "b", None][i % 3], 1))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(200 + i, docs[i][1].replace(" ", "  ", 1), "en", "a", 1) for i in range(1, 30, 3)]
    docs += [(300 + i, docs[i][1].rsplit(" ", 2)[0] + " tail end", "en", "b", 1) for i in range(2, 40, 5)]
    docs += [(400, None, "en", "a", 1), (401, "", "en", None, 1), (402, " ", None, "a", None), (None, "alone here", "en", "a", 1), docs[3]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def near(texts):
    """Groups of ids whose sets of five-word shingles have a Jaccard similarity of 0.8, by the smallest id."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := (t or "").lower().split())}
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = {name: [r.doc_id for r in rows] for name, rows in out.items()}
    kept = set(ids["toxicity"])
    assert not kept & set(range(0, 160, 8)) and kept >= {i for i in range(160) if i % 8} | {400, 401, 402, None}
    first = {}
    for r in out["toxicity"]:
        key = SPACE.sub(" ", r.text or "")
        if r.doc_id is not None:
            first[key] = min(r.doc_id, first.get(key, r.doc_id))
    assert set(ids["exact_dedup"]) == set(first.values()) | {None}
    label = near({r.doc_id: r.text for r in out["exact_dedup"] if r.doc_id is not None})
    assert set(ids["ngram_jaccard"]) == {i for i, k in label.items() if i == k} | {None}
    assert len(label) > len(set(label.values()))
    taken, sizes = Counter(ids["source_mixing"]), {r.doc_id: len((r.text or "").split()) for r in out["ngram_jaccard"]}
    assert set(taken) <= {i for i, n in sizes.items() if n} and max(taken.values()) <= 4
    words = sum(sizes[i] * n for i, n in taken.items())
    assert abs(words - 1.5 * sum(sizes.values())) < 0.1 * 1.5 * sum(sizes.values())
    packed = out["best_fit_packing"]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)


CLASHES = ["score", "_score", "_text", "times", "_times", "_n", "copy", "kept", "_kept", "held_out", "predicted", "_id", "label", "n", "token", "size", "taken", "shard", "component_id"]


def test_stages_with_clashing_columns(spark, folder):
    """Further columns come through unchanged, whatever they are called."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *(F.concat_ws(":", F.lit(c), "doc_id", "text").alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, made = stage(spark, docs, folder), stage(spark, wide, folder)
        assert made.columns == wide.columns, name
        assert Counter(r.doc_id for r in made.collect()) == Counter(r.doc_id for r in plain.collect()), name
        assert made.where(" or ".join(f"`{c}` <> concat_ws(':', '{c}', doc_id, text)" for c in CLASHES)).isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()


@pytest.mark.parametrize("texts", [[], [None], ["", None, " "], ["long " * 400_000 + "end", "long " * 400_000 + "end", "rotten"]])
def test_stages_on_few_rows(spark, folder, texts):
    """No rows, empty ones, and a text of two million characters with its copy; none has a label, so none is toxic."""
    docs = spark.createDataFrame([(7000 + i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        counts.append(docs.count())
    if not texts or not any(t and t.strip() for t in texts):
        assert counts[0] == len(texts) and counts[1] == len({" " if t == " " else "" for t in texts}) and counts[3:] == [0, 0]
    else:
        assert counts[:3] == [3, 2, 2] and counts[3] in (1, 2, 3)
        assert docs.where("doc_id = 7000").agg(F.sum("length")).first()[0] % 400_002 == 0


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and sum(r.length for r in rows) > 0 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize(("length", "shard_words"), [(250, 1_000_000), (3000, 1_000_000), (3000, 2000)])
def test_sources_meet_their_targets_in_whole_documents(spark, length, shard_words):
    """Documents of many blocks: a source's documents must not all round the same way."""
    rng = np.random.default_rng(21)
    many = {"a": 60, "b": 60, "c": 60, "d": 12, "e": 12, "f": 12}
    rows = [(i, "w " * int(rng.integers(length // 2, length * 3 // 2)), s) for i, s in enumerate(s for s, n in many.items() for _ in range(n))]
    rows.append((len(rows), "w " * 12 * length, "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, shard_words=shard_words).cache()
    source_of, size_of = {i: s for i, _, s in rows}, {i: len(t.split()) for i, t, _ in rows}
    targets = {source_of[r.doc_id]: r.target for r in mixed.collect()}
    if shard_words == 1_000_000:
        times = Counter(r.doc_id for r in corpus_pipeline.mix(spark, docs, "").collect())
    else:
        times = {r.doc_id: r.times for r in mixing.whole_documents(mixed).collect()}
    assert max(times.values()) <= 2
    got = Counter()
    for i, n in times.items():
        got[source_of[i]] += n * size_of[i]
    assert len({round(t / sum(size_of[i] for i in size_of if source_of[i] == s), 2) for s, t in targets.items()}) > 2
    for s, target in targets.items():
        slack = length * 3 / 4 + 64 + (64 * many[s] if shard_words == 2000 else 0)
        assert abs(got[s] - target) <= slack, (s, got[s], target)


def test_an_id_in_several_sources_counts_once(spark):
    rows = [(i, "w " * 300, "abc"[i % 3]) for i in range(90)] + [(0, "w " * 300, "b"), (None, "w " * 300, "a"), (None, "w " * 300, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs)
    times = {r.doc_id: r.times for r in mixing.whole_documents(mixed).collect()}
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 2
    words = sum(300 * times[r[0]] for r in rows)
    assert abs(words - 1.5 * 300 * len(rows)) <= 3 * 150 + 64 * 3


def test_workers_forget_the_tokenizer(spark, folder):
    """A worker that has cut texts into tokens keeps neither the tokenizer nor what it remembered."""

    def held(batches):
        import gc

        n = sum(type(o).__name__ in ("Memo", "ChunkEncoder") for o in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [n] * batch.num_rows})

    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(16)
    path = public_tokenizers.path("word_bpe_49k.json")
    packing.token_pieces(docs, "doc_id", "text", path, 4096, 1).write.format("noop").mode("overwrite").save()
    now = spark.range(64).repartition(16).mapInArrow(held, "n long").collect()
    assert len(now) == 64 and not any(r["n"] for r in now)


def test_a_task_drops_its_powers(spark, monkeypatch):
    """Powers of the base are kept for a task's batches, not after it."""
    docs = spark.createDataFrame([(1, "a b c d e")], "_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, shape: run)
    run = jaccard.prefix_rows(docs, np.zeros(1 << 22, np.uint8), jaccard.Settings())
    made = list(run(iter([pa.RecordBatch.from_pydict({"_id": [1], "text": ["a b c d e"]})])))
    assert [b.num_rows for b in made] == [1] and not words._cache


@pytest.mark.parametrize("rows", [0, 40])
def test_sketch_counts_every_shingle(spark, rows):
    """The sketch's classes are those of a plain count, and no block of it is over 16 KB a task."""
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(i % 9)) for i in range(rows)]
    settings = jaccard.Settings()
    got = jaccard.frequency_classes(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), settings)
    slots = np.zeros(1 << settings.sketch_bits, int)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        for s in jaccard.shingle_hashes(data, np.array([0, len(data)]), settings.words)[1]:
            slots[int(s) >> (64 - settings.sketch_bits)] += 1
    want = np.round(jaccard.CLASSES * np.log2(slots + 1.0))
    assert np.array_equal(got, want if rows else 0 * want)
    assert 2 << jaccard.BLOCK_BITS <= 16 << 10
