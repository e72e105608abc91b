"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.labelled import fold, gathered_rows, training_rows
from lodestrand.llm.tables import small_batches
from lodestrand.llm.words import U, mix, row_numbers, text_slices, word_hashes

#: Labelled documents that a model is fitted on at most.
MOST_ROWS = 12_000
#: Statistics of a text, in this order.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "same_as_last", "top_word", "upper", "digits", "marks", "marked_words",
    "ends_marked_alike", "non_ascii", "lines", "line_length", "sentence_ends", "bars", "log_n_chars", "chars_by_bytes",
)


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    rank: int = 8
    rate: float = 0.05
    l2: float = 1e-5
    epochs: int = 8
    batch: int = 64
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """First-order weights and factors, words first and then statistics, and how statistics are scaled."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def _class(test) -> np.ndarray:
    return np.array([test(c) for c in range(256)])


UPPER, DIGIT = _class(lambda c: 65 <= c <= 90), _class(lambda c: 48 <= c <= 57)
MARK = _class(lambda c: 33 <= c < 127 and not chr(c).isalnum())
HIGH, LINE, BAR, STOP = _class(lambda c: c >= 128), _class(lambda c: c == 10), _class(lambda c: c == 124), _class(lambda c: c in b".?!")


def features(data: np.ndarray, bounds: np.ndarray, n_chars: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word bucket, share of the text's words) with every bucket of a text once, and the statistics' table."""
    starts, ends, word_bounds, hashes = word_hashes(data, bounds)
    rows, n = row_numbers(word_bounds), len(bounds) - 1
    key, inverse, count = np.unique(rows << bits | (mix(hashes + U(3)) >> U(64 - bits)).astype(np.int64), return_inverse=True, return_counts=True)
    row, bucket = key >> bits, key & ((1 << bits) - 1)
    n_words = np.maximum(np.diff(word_bounds), 1)
    share = count / n_words[row]
    size = np.diff(bounds)
    bytes_ = np.maximum(size, 1)

    def of(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[bounds[1:]] - total[bounds[:-1]]) / bytes_

    def by_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(rows, flag, n) / n_words

    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = MARK[last]
    alike = np.zeros(len(rows), bool)
    alike[1:] = marked[1:] & (last[1:] == last[:-1]) & (rows[1:] == rows[:-1])
    top = np.zeros(n)
    np.maximum.at(top, row, share)
    lines = of(LINE) * bytes_ + 1
    chars = np.maximum(n_chars, 0)
    table = np.stack(
        [
            np.log1p(size), np.log1p(np.diff(word_bounds)), np.bincount(rows, ends - starts, n) / n_words, np.bincount(row, minlength=n) / n_words,
            by_word(again), top, of(UPPER), of(DIGIT), of(MARK), by_word(marked), by_word(alike), of(HIGH), np.log(lines), np.log1p(bytes_ / lines),
            of(STOP), of(BAR), np.log1p(chars), np.minimum(chars / bytes_, 4),
        ], axis=1,
    )
    return row, bucket, share, table


def scores(model: Model, row: np.ndarray, bucket: np.ndarray, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each text, and the factor sums S. Pairs cost linear time:
    sum over i < j of <v_i, v_j> x_i x_j = half the sum over factors of S^2 - sum of (v_i x_i)^2."""
    n, words = len(table), len(model.w) - len(STATISTICS)
    z = np.clip((table - model.mean) / model.spread, -4, 4)
    out = model.bias + np.bincount(row, model.w[bucket] * x, n) + z @ model.w[words:]
    vs = model.v[words:]
    sums, squares = z @ vs, (z * z) @ (vs * vs)
    for f in range(model.v.shape[1]):
        vx = model.v[bucket, f] * x
        sums[:, f] += np.bincount(row, vx, n)
        squares[:, f] += np.bincount(row, vx * vx, n)
    return out + 0.5 * (sums * sums - squares).sum(axis=1), sums


def fit(texts: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, labels: np.ndarray, settings: Settings) -> Model:
    """Logistic loss by AdaGrad on small batches, in a seeded order.

    texts: the buckets and shares of each text. Without texts of both labels the model is constant.
    """
    random = np.random.default_rng(settings.seed)
    size = (1 << settings.bits) + len(STATISTICS)
    if not len(labels) or labels.min() == labels.max():
        flat = np.zeros(len(STATISTICS))
        return Model(10.0 if len(labels) and labels[0] else -10.0, np.zeros(size), np.zeros((size, settings.rank)), flat, flat + 1)
    mean, spread = table.mean(axis=0), table.std(axis=0) + 1e-6
    rate = labels.mean()
    m = Model(float(np.log(rate / (1 - rate))), np.zeros(size), random.normal(0, 0.05, (size, settings.rank)), mean, spread)
    seen_w, seen_v = np.full(size, 1e-6), np.full((size, settings.rank), 1e-6)
    words, bias, seen_b = size - len(STATISTICS), m.bias, 1e-6
    scale = words**0.25  # shares are small beside scaled statistics
    for _ in range(settings.epochs):
        order = random.permutation(len(labels))
        for at in range(0, len(order), settings.batch):
            part = order[at : at + settings.batch]
            row = np.repeat(np.arange(len(part)), [len(texts[i][0]) for i in part])
            bucket = np.concatenate([texts[i][0] for i in part])
            x = np.concatenate([texts[i][1] for i in part])
            m = Model(bias, m.w, m.v, mean, spread)
            out, sums = scores(m, row, bucket, x, table[part])
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[part]) / len(part)
            z = np.clip((table[part] - mean) / spread, -4, 4)
            index, where = np.unique(bucket, return_inverse=True)
            gw = np.bincount(where, g[row] * x, len(index))
            gx = g[row] * x
            gv = np.stack([np.bincount(where, gx * (sums[row, f] - m.v[bucket, f] * x), len(index)) for f in range(settings.rank)], axis=1)
            zs = z * g[:, None]
            ws = np.concatenate([gw, zs.sum(axis=0)])
            vs = np.concatenate([gv, zs.T @ sums - (zs * z).sum(axis=0)[:, None] * m.v[words:]])
            index = np.concatenate([index, np.arange(words, size)])
            ws, vs = ws + settings.l2 * m.w[index], vs + settings.l2 * m.v[index]
            seen_w[index] += ws * ws
            seen_v[index] += vs * vs
            step = settings.rate * np.where(index < words, scale, 1.0)
            m.w[index] -= step * ws / np.sqrt(seen_w[index])
            m.v[index] -= settings.rate * vs / np.sqrt(seen_v[index])
            seen_b += g.sum() ** 2
            bias -= settings.rate * g.sum() / seen_b**0.5
    return Model(bias, m.w, m.v, mean, spread)


def _counts(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)


def train(sample: DataFrame, settings: Settings) -> Model:
    """Fit on (_id, text, n_chars, label), one row for each _id. Features are made on the executors; a row's buckets and
    shares, each bucket once, come to the driver."""

    def extract(batches):
        for batch in batches:
            chars = _counts(batch.column(2))
            for first, data, bounds in text_slices(batch.column(1)):
                n = len(bounds) - 1
                row, bucket, share, table = features(data, bounds, chars[first : first + n], settings.bits)
                cuts = np.searchsorted(row, np.arange(n + 1))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                part = slice(first, first + n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        batch.column(3)[part],
                        pa.array([bucket[a:b].astype("<u4").tobytes() + share[a:b].astype("<f4").tobytes() for a, b in spans], pa.binary()),
                        pa.array([t.tobytes() for t in table], pa.binary()),
                    ],
                    names=["_id", "label", "found", "stats"],
                )

    shape = "_id string, label int, found binary, stats binary"
    made = sample.select(F.col("_id").cast("string"), "text", "n_chars", "label").mapInArrow(extract, shape)
    rows, data, spans = gathered_rows(made, "found")
    texts = []
    for a, b in spans:
        n = (b - a) // 8
        texts.append((np.frombuffer(data, "<u4", n, a).astype(np.int32), np.frombuffer(data, "<f4", n, a + 4 * n)))
    tables, labels = [np.frombuffer(r["stats"]) for r in rows], [r["label"] for r in rows]
    return fit(texts, np.array(tables).reshape(-1, len(STATISTICS)), np.array(labels, float), settings)


def quality(docs: DataFrame, labels: DataFrame, may_train, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", most_rows: int = MOST_ROWS) -> DataFrame:
    """Score every document's quality with a factorisation machine learned from labels.quality.

    Features are hashed words (their share of the text), statistics of the text's structure and the n_chars column
    (null or absent: unknown). A model has (2 ** bits + statistics) * (rank + 1) numbers, which bounds what is
    broadcast. Only rows for which may_train holds are learned from: at most most_rows labelled ids, the first by a hash
    of the id, each with all its buckets, at most 2 ** bits of eight bytes, which the driver holds.

    Null and empty texts are scored by their statistics. Labels other than 0 and 1 are not used; without labels of
    both kinds the score is constant. Rows that repeat an id are scored one by one and learned from once. An empty
    table gives an empty result. Texts are read whole.

    Returns the id and score.
    """
    small_batches(docs.sparkSession)
    chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars"))
    model = train(training_rows(rows, labels, "quality", may_train, most_rows, id_col, ("text", "n_chars")), settings)
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.spread))
    bits = settings.bits

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            chars = _counts(batch.column(2))
            out = np.zeros(batch.num_rows)
            for first, data, bounds in text_slices(batch.column(1)):
                part = slice(first, first + len(bounds) - 1)
                out[part] = scores(own, *features(data, bounds, chars[part], bits))[0]
            value = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=[id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality(docs, labels, fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
