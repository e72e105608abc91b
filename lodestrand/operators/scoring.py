"""Scores and verdicts from alignment traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STRONG, WEAK, SLICE_WEIGHT, ANCHOR_WEIGHT = 0.9, 0.4, 0.5, 0.5


def trace_scores(trace: DataFrame, similarity: Column | str = "similarity") -> DataFrame:
    """(pair_id, side, score, score_feat, score_ctx): the token-weighted mean similarity of a side's lines, over all of
    them, over those that are no COMMON ones and over the COMMON ones. Header lines do not count; a mean over nothing
    is 0."""
    value = F.greatest(F.col(similarity) if isinstance(similarity, str) else similarity, F.lit(0.0))

    def mean(keep: Column) -> Column:
        tokens = F.sum(F.when(keep, F.col("tokens")).otherwise(0))
        return F.when(tokens > 0, F.sum(F.when(keep, F.col("tokens") * value).otherwise(0.0)) / tokens).otherwise(0.0)

    body, common = ~F.col("is_header"), F.col("tag") == "COMMON"
    return trace.groupBy("pair_id", "side").agg(mean(body).alias("score"), mean(body & ~common).alias("score_feat"), mean(body & common).alias("score_ctx"))


def anchor_scores(trace: DataFrame, anchors: DataFrame) -> DataFrame:
    """(pair_id, side, anchor_score): the mean over anchors of the best similarity on their line; a line that the trace
    lacks counts 0. Where no anchor has a line, or there is none, it is 1. A trace's lines are orig_line, a number, or
    orig_lines, an array of those that a statement was joined from. A pair with anchors and no trace has no row; it
    counts as 0."""
    usable = anchors.where("line_no > 0")
    own = F.explode("orig_lines") if "orig_lines" in trace.columns else F.col("orig_line")
    best = usable.join(trace.select("pair_id", "side", own.alias("line_no"), "similarity"), ["pair_id", "side", "line_no"], "left")
    each = best.groupBy("pair_id", "side", "anchor").agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("s"))
    found = each.groupBy("pair_id", "side").agg(F.avg("s").alias("anchor_score"))
    return trace.select("pair_id", "side").distinct().join(found, ["pair_id", "side"], "left").withColumn("anchor_score", F.coalesce("anchor_score", F.lit(1.0)))


def total(score: Column, anchor: Column) -> Column:
    return SLICE_WEIGHT * score + ANCHOR_WEIGHT * anchor


def verdict(rows: DataFrame) -> DataFrame:
    """rows with verdict and confidence from total_vuln, total_fix, feat_vuln, feat_fix (null where a side has no such
    lines) and score_ctx."""
    vuln, fix = F.col("total_vuln"), F.col("total_fix")
    has_vuln, has_fix = F.col("feat_vuln").isNotNull(), F.col("feat_fix").isNotNull()
    patched = (
        F.when(has_fix & ~has_vuln, F.col("feat_fix") >= STRONG)
        .when(has_vuln & ~has_fix, F.col("feat_vuln") < WEAK)
        .when(has_vuln & has_fix, fix > vuln)
    )
    name = F.when(vuln < WEAK, "MISMATCH").when(patched.isNull(), "UNKNOWN").when(patched, "PATCHED").otherwise("VULNERABLE")
    rows = rows.withColumn("verdict", name)
    sure = F.when(F.col("verdict") == "MISMATCH", 1 - vuln).when(F.col("verdict") == "UNKNOWN", F.col("score_ctx")).when(F.col("verdict") == "PATCHED", fix).otherwise(vuln)
    return rows.withColumn("confidence", sure)


def final_verdict(rows: DataFrame) -> DataFrame:
    """The last judgement from what was found: consistent, reachable, in_scope, blocked, vulnerable; if the table has them
    also type_matches, whether the path is of the kind the type asks for, and contested, which goes to another round."""
    has = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("boolean")
    name = (
        F.when(~F.col("consistent"), "SAFE-Mismatch")
        .when(~F.col("reachable"), "SAFE-Unreachable")
        .when(~has("type_matches"), "SAFE-TypeMismatch")
        .when(~F.col("in_scope"), "SAFE-OutOfScope")
        .when(F.col("blocked"), "SAFE-Blocked")
        .when(has("contested"), "PROCEED")
        .when(F.col("vulnerable"), "VULNERABLE")
        .otherwise("SAFE-Unknown")
    )
    return rows.withColumn("verdict", name)


def competitive(trace: DataFrame, modified: DataFrame) -> DataFrame:
    """(pair_id, side, loss): what a side loses where both lines of a changed pair claim one target line: of the less
    similar one, the new line if both are alike, tokens times similarity, as a share of the side's tokens. Header lines
    do not count among those.

    trace: pair_id, side (pre or post), pos, target_no, tokens, similarity, is_header. modified: pair_id, pre, post.
    """
    a, b = (
        trace.where(F.col("side") == side).select("pair_id", F.col("pos").alias(side), F.col("target_no").alias(f"t{k}"), F.col("tokens").alias(f"n{k}"), F.col("similarity").alias(f"s{k}"))
        for side, k in (("pre", "a"), ("post", "b"))
    )
    both = modified.select("pair_id", "pre", "post").join(a, ["pair_id", "pre"]).join(b, ["pair_id", "post"]).where("ta = tb")
    new_loses = F.col("sa") >= F.col("sb")
    lost = both.select(
        "pair_id", F.when(new_loses, "post").otherwise("pre").alias("side"), F.when(new_loses, F.col("nb") * F.col("sb")).otherwise(F.col("na") * F.col("sa")).alias("_lost")
    )
    sizes = trace.groupBy("pair_id", "side").agg(F.sum(F.when(F.col("is_header"), 0).otherwise(F.col("tokens"))).alias("_tokens"))
    summed = lost.groupBy("pair_id", "side").agg(F.sum("_lost").alias("_lost")).join(sizes, ["pair_id", "side"])
    return summed.select("pair_id", "side", F.when(F.col("_tokens") > 0, F.col("_lost") / F.col("_tokens")).otherwise(0.0).alias("loss"))
