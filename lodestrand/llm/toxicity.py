"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.labelled import fold, gathered_rows, training_rows
from lodestrand.llm.tables import small_batches
from lodestrand.llm.words import BYTE_VALUES, MARKS, U, mix, prefix_sums, row_numbers, span_hashes, text_slices, words
from lodestrand.llm.workers import settled

#: Labelled documents that a model is fitted on at most.
MOST_ROWS = 16_000
#: (words apart, salt): neighbours, and pairs with one or two words between them.
PAIRS = ((1, 0x1001), (2, 0x2003), (3, 0x3007))

STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    weight_of_1: float = 2.0
    epochs: int = 4
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """Nonzero weights by feature number, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def features(data: np.ndarray, bounds: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, sorted: a text's words, their stems, word pairs and skip-grams, hashed.

    A stem is a longer word's first STEMS bytes: it stands for all its endings, most of which no label has shown.
    wanted: which features matter; the others are dropped before sorting.
    """
    starts, ends, word_bounds = words(data, bounds, MARKS)
    sums = prefix_sums(BYTE_VALUES[data])
    whole = span_hashes(sums, starts, ends)
    rows, shift = row_numbers(word_bounds), U(64 - bits)
    made = [(rows, whole + U(7))]
    for n in STEMS:
        long = ends - starts > n
        made.append((rows[long], span_hashes(sums, starts[long], starts[long] + n) + U(n << 8)))
    for apart, salt in PAIRS:
        same = rows[apart:] == rows[:-apart]
        made.append((rows[apart:][same], whole[:-apart][same] * U(0x9E3779B97F4A7C15) + whole[apart:][same] + U(salt)))
    keys = []
    for here, found in made:
        found = (mix(found) >> shift).astype(np.int64)
        if wanted is not None:
            keep = wanted[found]
            here, found = here[keep], found[keep]
        keys.append(here.astype(np.int64) << bits | found)
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


def packed(found: np.ndarray, bits: int) -> bytes:
    """Sorted feature numbers in two bytes each: how many begin with each prefix, then their last 16 bits."""
    blocks = 1 << max(0, bits - 16)
    return np.bincount(found >> 16, minlength=blocks).astype("<u4").tobytes() + (found & 0xFFFF).astype("<u2").tobytes()


class Packed(Sequence):
    """Texts' feature numbers, unpacked one text at a time."""

    def __init__(self, data: bytes | bytearray, spans: list[tuple[int, int]], bits: int):
        self.data, self.spans, self.blocks = data, spans, 1 << max(0, bits - 16)

    def __len__(self) -> int:
        return len(self.spans)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = self.spans[i]
        counts = np.frombuffer(self.data, "<u4", self.blocks, a)
        low = a + 4 * self.blocks
        return np.repeat(np.arange(self.blocks) << 16, counts) + np.frombuffer(self.data, "<u2", (b - low) // 2, low)


def fit(texts: Sequence[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """FTRL-proximal: every coordinate has its own learning rate and L1 keeps most weights at exactly zero.

    texts: the feature numbers of each text. Texts are visited in a seeded order. The bias is not regularised. Without
    texts of both labels the model is the constant 0 (no label 1 seen) or 1.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 10.0 if len(labels) and labels[0] else -10.0, settings.bits)
    z, n = np.zeros(1 << settings.bits), np.zeros(1 << settings.bits)
    rate = labels.mean()
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0
    random = np.random.default_rng(settings.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        out = (np.sign(zi) * settings.l1 - zi) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        out[np.abs(zi) <= settings.l1] = 0
        return out

    for _ in range(settings.epochs):
        for i in random.permutation(len(labels)):
            at = texts[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - labels[i]
            g *= settings.weight_of_1 if labels[i] else 1.0
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= settings.alpha / (settings.beta + bias_n**0.5) * g
    used = np.flatnonzero(np.abs(z) > settings.l1)
    w = weights(used)
    return Model(used[w != 0], w[w != 0].astype(np.float32), bias, settings.bits)


def train(sample: DataFrame, settings: Settings) -> Model:
    """Fit on (_id, text, label), one row for each _id. Features are made on the executors; a row's feature numbers, two
    bytes each and each number once, come to the driver."""

    def extract(batches):
        for batch in batches:
            for first, data, bounds in text_slices(batch.column(1), lower=True):
                rows, found = features(data, bounds, settings.bits)
                cuts = np.searchsorted(rows, np.arange(len(bounds)))
                blobs = [packed(found[a:b], settings.bits) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                part = slice(first, first + len(blobs))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(2)[part], pa.array(blobs, pa.binary())], names=["_id", "label", "found"])

    made = sample.select(F.col("_id").cast("string"), "text", "label").mapInArrow(settled(extract), "_id string, label int, found binary")
    rows, data, spans = gathered_rows(made, "found")
    return fit(Packed(data, spans, settings.bits), np.array([r["label"] for r in rows], float), settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """docs' id and `keep` columns with `score_col`: the model's probability of label 1 for the whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias, model.bits))
    has_text = text_col in (keep or [])  # travels once
    kept = [id_col, *(c for c in keep or [] if c != text_col)]
    inside = [f"c{i}" for i in range(len(kept))]  # whatever the columns are called

    def run(batches):
        index, weight, bias, bits = held.value
        dense = Model(index, weight, bias, bits).dense()
        wanted = dense != 0
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, data, bounds in text_slices(batch.column(0), lower=True):
                rows, found = features(data, bounds, bits, wanted)
                out[first : first + len(bounds) - 1] = np.bincount(rows, dense[found], len(bounds) - 1)
            value = 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))
            columns = batch.columns[1:] + batch.columns[:1] * has_text
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=names)

    rows = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(i) for c, i in zip(kept, inside, strict=True)))
    fields = rows.schema.fields[1:] + rows.schema.fields[:1] * has_text
    names = [*(f.name for f in fields), "score"]
    scored = rows.mapInArrow(settled(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", score double")
    return scored.toDF(*kept, *[text_col] * has_text, score_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, may_train, settings: Settings = Settings(), keep: list[str] | None = None, most_rows: int = MOST_ROWS, score_col: str = "score",
) -> DataFrame:
    """Score every document for toxicity with weights learned from labels.toxic.

    Only rows for which may_train holds are learned from: at most most_rows labelled ids, the first by a hash of the id,
    each with all the features of its text. A text has at most 2 ** bits features of two bytes each, and the driver
    holds those of the sample. Inputs of a score are the lower-cased words alone. A feature counts once for a text, so
    that length does not add up; only features with a weight are looked up, in time linear in the text. Weights are
    sparse and have at most 2 ** bits entries, so they are safe to broadcast.

    Null and empty texts get the score of the bias. Labels other than 0 and 1 and labels without a document are not
    used; without labels of both kinds the score is constant. Rows that repeat an id are scored one by one and learned
    from once. An empty table gives an empty result. `keep` columns may have any name; if one is called like score_col,
    give that another name.

    Returns the id, `keep` and score_col.
    """
    small_batches(docs.sparkSession)
    return score(docs, train(training_rows(docs, labels, "toxic", may_train, most_rows), settings), keep=keep, score_col=score_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, labels, fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
