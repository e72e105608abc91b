"""Inverted-index search: units that share most tokens with a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import UNICODE_WORD, code_tokens

#: Query tokens at most; the longest are kept.
QUERY_TOKENS = 30


def postings(units: DataFrame, id_col: str, code_col: str, word: str = UNICODE_WORD) -> DataFrame:
    """(token, unit_id), each pair once: units are assumed to have an id of their own, so no pair needs a shuffle."""
    return units.select(F.col(id_col).alias("unit_id"), F.explode(code_tokens(F.col(code_col), word)).alias("token")).select("token", "unit_id")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def query_tokens(queries: DataFrame, id_col: str, code_col: str, word: str = UNICODE_WORD, cap: int = QUERY_TOKENS) -> DataFrame:
    """(query_id, token): a query's tokens, of more than cap the longest, ties by token."""
    tokens = code_tokens(F.col(code_col), word)
    ranked = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    kept = F.transform(F.slice(ranked, 1, cap), lambda s: s["t"])
    return queries.select(F.col(id_col).alias("query_id"), F.explode(kept).alias("token"))


def hits(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, unit_id, hit_count): how many query tokens a unit has.

    The query side is small, so Spark broadcasts it when its size allows and postings are then counted where they lie,
    with partial sums before the only shuffle.
    """
    return index.join(tokens, "token").groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("hit_count"))


def top_hits(found: DataFrame, k: int) -> DataFrame:
    """The k units with most hits of each query, with their place; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("hit_count").desc(), "unit_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
