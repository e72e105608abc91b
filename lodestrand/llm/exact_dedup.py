"""Exact duplicates by a tree merge of digest runs. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import materialize, salt

SPACES = r"[\x20\x09-\x0D]+"
KEY = ["text_sha256", "_bytes", "_check"]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, leaves: int) -> DataFrame:
    """One row per document: its id, its digest key and the leaf run it belongs to."""
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id",
        F.sha2("_text", 256).alias("text_sha256"),
        F.octet_length("_text").alias("_bytes"),
        F.xxhash64("_text").alias("_check"),
        salt("_id", leaves).alias("_run"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, fan_in_bits: int = 2) -> DataFrame:
    """Mark all but the smallest id among equal texts.

    Documents are dealt into 2 ** (rounds * fan_in_bits) runs; a run holds each of its digests once, with the smallest
    id and the number of rows. In each round the runs whose numbers differ only in the lowest remaining bits are
    exchanged (a binomial tree, 2 ** fan_in_bits of them at a time) and merged in order of digest and id: of equal
    digests, neighbours in that order, the first goes on and the counts add up. A run travels as rows spread by digest,
    so no level, the last included, is one task, and a text held by a third of all rows brings at most fan-in rows to
    any merge. The answer goes back down the same tree, so the join on a hot digest is spread over the runs too.

    Verified: a key is the SHA-256 with the text's length and an independent 64-bit hash, so texts that share a digest
    but not those are kept apart at every level.

    Null text counts as empty. Rows that repeat an id are one document each in group_size and get the same answer; a
    null id loses to any other and stays only where the whole group has none. Only the id and text are read, so other
    columns may have any name. An empty table gives an empty result. Texts of any length are read whole.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    base = materialize(digest_runs(docs, id_col, text_col, 1 << rounds * fan_in_bits))
    leaf = base.groupBy(*KEY, "_run").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    level = leaf
    in_order = Window.partitionBy(*KEY, "_run").orderBy(F.col("keep_id").asc_nulls_last())
    for _ in range(rounds):
        met = level.withColumn("_run", F.shiftright("_run", fan_in_bits))
        whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = met.withColumns({"_place": F.row_number().over(in_order), "group_size": F.sum("group_size").over(whole)})
        level = merged.where("_place = 1").drop("_place")
    answers = leaf.select(*KEY, "_run").join(level.drop("_run"), KEY)
    return base.join(answers, [*KEY, "_run"]).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM plain
"""
