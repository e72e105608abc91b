"""Bounded samples of labelled documents, and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, may_train: Column, most: int, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(_id, columns, label) of documents with one of at most `most` labelled ids, the first by a hash of the id.

    Rows without a label or with another label than 0 and 1 are left out. Of labels that repeat an id the largest
    counts. The ids, at most `most` of them, are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & may_train)
    chosen = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), *columns)
    return rows.join(F.broadcast(chosen), "_id")


def gathered_rows(made: DataFrame, blob: str) -> tuple[list, bytearray, list[tuple[int, int]]]:
    """(rows, bytes, spans): rows of features on the driver, one for each _id and in the order of its hash, whichever tasks
    made them. Their `blob` columns lie in one run of bytes, at spans.

    Of rows that repeat an id the least counts, decided on the executors, so there are no more rows than ids.
    """
    rest = [c for c in made.columns if c != "_id"]
    once = made.groupBy("_id").agg(F.min(F.struct(*rest)).alias("_r")).select(F.xxhash64("_id").alias("_at"), "_id", "_r.*")
    kept, data = [], bytearray()
    for r in once.toLocalIterator():
        kept.append(((r["_at"], r["_id"]), tuple(r[c] for c in rest if c != blob), (len(data), len(data) + len(r[blob]))))
        data += r[blob]
    kept.sort(key=lambda k: k[0])
    names = [c for c in rest if c != blob]
    return [dict(zip(names, values, strict=True), _id=at[1]) for at, values, _ in kept], data, [span for _, _, span in kept]
