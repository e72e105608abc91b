"""Unified diffs as rows: files, hunks and lines."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = re.compile(r"@@ -(?P<a>\d+)(?:,(?P<n>\d+))? \+(?P<b>\d+)(?:,(?P<m>\d+))? @@")
HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def ignorable(line: Column) -> Column:
    """Whether a changed line, without its sign, is blank or comment-like.

    A line that opens a block comment counts unless code follows its end. A line that starts with a star counts if it
    goes on like a comment: alone, before white space, at a comment's end, or stars and slashes only.
    """
    s = F.trim(line)
    return (s == "") | s.startswith("//") | s.rlike(r"^/\*(?:(?!\*/).)*$|^/\*(?:(?!\*/).)*\*/\s*$") | s.rlike(r"^\*/|^\*$|^\*[ \t]|^[*/]+$") & s.startswith("*")


def hunk_lines(diffs: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """(diff_id, hunk, i, sign, body, old_no, new_no): the lines below each hunk header, numbered on both sides.

    A hunk's number is a running count of headers; a side's number is its start and the lines of that side before.
    """
    cut = diffs.select(F.col(id_col).alias("diff_id"), F.posexplode(F.split(F.col(diff_col), "\n")).alias("i", "line"))
    order = Window.partitionBy("diff_id").orderBy("i")
    head = F.col("line").rlike(HEADER)
    numbered = cut.withColumn("hunk", F.sum(head.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_hunk = Window.partitionBy("diff_id", "hunk")
    starts = [F.max(F.when(head, F.regexp_extract("line", HEADER, g).cast("int"))).over(in_hunk) for g in (1, 2)]
    before = in_hunk.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sign = F.substring("line", 1, 1)
    old, new = (F.coalesce(F.sum(F.when(~head & (sign != skip), 1).otherwise(0)).over(before), F.lit(0)) for skip in ("+", "-"))
    rows = numbered.where("hunk > 0").select(
        "diff_id", "hunk", "i", "line", sign.alias("sign"), F.expr("substring(line, 2)").alias("body"), (starts[0] + old).cast("int").alias("old_no"), (starts[1] + new).cast("int").alias("new_no")
    )
    return rows.where(~head)


def noise_hunks(lines: DataFrame) -> DataFrame:
    """Every hunk with whether all it adds and deletes is noise."""
    real = F.col("sign").isin("+", "-") & ~ignorable(F.col("body"))
    return lines.groupBy("diff_id", "hunk").agg((F.count_if(real) == 0).alias("noise"))


def cleaned(lines: DataFrame) -> DataFrame:
    """The diffs' hunks without noise, as text in order: hunks that change nothing else are left out."""
    kept = lines.join(noise_hunks(lines).where("not noise"), ["diff_id", "hunk"])
    return kept.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("text"))


def changed_lines(lines: DataFrame) -> DataFrame:
    """Deleted lines by their old number and added ones by their new number, without comments and blank lines."""
    real = lines.where(F.col("sign").isin("+", "-") & ~ignorable(F.col("body")))
    return real.select("diff_id", "hunk", "sign", F.when(F.col("sign") == "-", F.col("old_no")).otherwise(F.col("new_no")).alias("line_no"), F.trim("body").alias("code"))


def neighbourhood(changed: DataFrame, reach: int = 2) -> DataFrame:
    """The line numbers within reach of a changed line."""
    near = F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("line_no")
    return changed.select("diff_id", near).where("line_no > 0").distinct()


def primary_version(diffs: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """OLD for a diff that only deletes, else NEW."""
    lines = F.split(F.col(diff_col), "\n")
    added = F.size(F.filter(lines, lambda s: s.startswith("+") & ~s.startswith("+++")))
    removed = F.size(F.filter(lines, lambda s: s.startswith("-") & ~s.startswith("---")))
    return diffs.select(
        F.col(id_col).alias("diff_id"), added.alias("added"), removed.alias("removed"), F.when((removed > 0) & (added == 0), "OLD").otherwise("NEW").alias("version")
    )


def unified(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(pair_id, diff): the unified diff of pairs (pair_id, name, old, new, old_start, new_start), with hunk headers counted
    in lines of the files that the texts start at; null where nothing differs.

    Matching runs of lines has no Catalyst form, so pairs come in Arrow batches.
    """

    def one(name: str, old: str, new: str, old_start: int, new_start: int) -> str | None:
        out = []
        for line in difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{name}", f"b/{name}", n=context):
            if m := _RANGE.match(line):
                a, b = int(m["a"]) + old_start - 1, int(m["b"]) + new_start - 1
                line = f"@@ -{a},{m['n'] or 1} +{b},{m['m'] or 1} @@{line[m.end() :]}"
            out.append(line)
        return "".join(out).strip() and "".join(out) or None

    def run(batches):
        for batch in batches:
            rows = zip(batch["name"], batch["old"].fillna(""), batch["new"].fillna(""), batch["old_start"], batch["new_start"], strict=True)
            yield pd.DataFrame({"pair_id": batch["pair_id"], "diff": [one(*r) for r in rows]})

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", "name", "old", "new", "old_start", "new_start").mapInPandas(run, f"pair_id {kind}, diff string")
