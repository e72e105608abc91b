"""Ordering, de-duplication and adaptive cut-offs of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How verdicts rank.
PRIORITY = {"VULNERABLE": 3, "UNKNOWN": 2, "PATCHED": 1, "MISMATCH": 0}


def priority(verdict: Column) -> Column:
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(verdict == name, rank).otherwise(out)
    return out


def best_per_target(candidates: DataFrame, target: list[str], seq: str) -> DataFrame:
    """One candidate for each target: the highest verdict, then the highest confidence, then the first."""
    order = Window.partitionBy(*target).orderBy(priority(F.col("verdict")).desc(), F.col("confidence").desc(), seq)
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ranked(candidates: DataFrame, group: str, ties: list[str]) -> DataFrame:
    """Place of each VULNERABLE candidate in its group by confidence, from 0; -1 for all others."""
    vulnerable = F.col("verdict") == "VULNERABLE"
    order = Window.partitionBy(group, vulnerable).orderBy(F.col("confidence").desc(), *ties)
    return candidates.withColumn("rank", F.when(vulnerable, F.row_number().over(order) - 1).otherwise(-1))


def shortlist(rows: DataFrame, group: str, ties: list[str], most: int = 10) -> DataFrame:
    """The first candidates of each group by rank; unranked ones come last."""
    order = Window.partitionBy(group).orderBy(F.when(F.col("rank") < 0, 999).otherwise(F.col("rank")), *ties)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def adaptive_threshold(rows: DataFrame, group: str, order: list[str], safe: Column, confidence: str, start: float = 0.4, step: float = 0.1) -> DataFrame:
    """Walk each group in order: a row below the threshold is skipped; one that is taken and safe raises it by step.

    A group's rows, a shortlist in use, are folded inside one row by built-in functions.
    """
    item = F.struct(*order, F.col(confidence).cast("double").alias("_c"), safe.alias("_safe"))
    first = F.struct(F.lit(start).alias("t"), F.lit(0).alias("taken"), F.lit(0).alias("skipped"))

    def walk(acc: Column, x: Column) -> Column:
        skip = x["_c"] < acc["t"]
        return F.struct(
            F.when(~skip & x["_safe"], F.round(acc["t"] + step, 6)).otherwise(acc["t"]).alias("t"),
            (acc["taken"] + F.when(skip, 0).otherwise(1)).alias("taken"),
            (acc["skipped"] + F.when(skip, 1).otherwise(0)).alias("skipped"),
        )

    folded = rows.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list(item)), first, walk).alias("_f"))
    return folded.select(group, F.col("_f.t").alias("threshold"), F.col("_f.taken").alias("taken"), F.col("_f.skipped").alias("skipped"))


def peers(candidates: DataFrame, file: str, func: str, most: int = 200, same: tuple[str, ...] = ()) -> DataFrame:
    """For every candidate the others of its file with another function, and with the same values of `same`, such as tag
    and version; at most `most`, the first by name."""
    keys = [file, *same]
    rows = candidates.select(*keys, func).distinct()
    both = rows.join(rows.withColumnRenamed(func, "peer"), keys).where(F.col(func) != F.col("peer"))
    order = Window.partitionBy(*keys, func).orderBy("peer")
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
