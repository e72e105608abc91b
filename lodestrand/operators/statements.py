"""Statements: source lines joined while a parenthesis is open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import line_number, strip_comments
from lodestrand.operators.lookup import lines


def statements(units: DataFrame, id_col: str, text_col: str, markers: bool = False) -> DataFrame:
    """(unit_id, statement, first_line, n_lines, text, line_nos): comments go, blank lines go, and a line joins the one
    before while that leaves a parenthesis open. Literals do not count, and depth never falls below zero.

    markers: lines may start with the number in their file, [n], which is then theirs. Clamped depth is the running sum
    less its running minimum below zero, so it needs windows, not a loop.
    """
    bare = units.select(F.col(id_col), strip_comments(F.col(text_col)).alias(text_col))
    rows = lines(bare, id_col, text_col).withColumn("_no", F.col("line_no"))
    if markers:
        told = line_number(F.col("line"))
        rows = rows.withColumn("_no", F.when(told >= 0, told).otherwise(F.col("line_no"))).withColumn("line", F.regexp_replace("line", r"^\[\s*\d+\]", ""))
    rows = rows.where(F.trim("line") != "")
    plain = F.regexp_replace("line", r"\"[^\"]*\"|'[^']*'", "")
    delta = F.length(F.regexp_replace(plain, r"[^(]", "")) - F.length(F.regexp_replace(plain, r"[^)]", ""))
    order = Window.partitionBy("unit_id").orderBy("line_no")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_s", F.sum(delta).over(upto))
    depth = summed.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto)))
    grouped = depth.withColumn("statement", F.coalesce(F.sum(F.when(F.col("_d") == 0, 1).otherwise(0)).over(before), F.lit(0)))
    packed = grouped.groupBy("unit_id", "statement").agg(F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("t"), "_no"))).alias("_p"))
    return packed.select(
        "unit_id", "statement", F.col("_p")[0]["_no"].alias("first_line"), "n_lines",
        F.array_join(F.transform("_p", lambda s: s["t"]), " ").alias("text"), F.transform("_p", lambda s: s["_no"]).alias("line_nos"),
    )
