"""From a patch to its likely unpatched siblings: search, align both sides, score, judge and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.headers import headers
from lodestrand.functions.text import line_tokens, strip_comments
from lodestrand.operators import align, rank, scoring, search
from lodestrand.operators.statements import statements
from lodestrand.plans.storage import materialize


SIDES = ("pre", "post")


def token_lines(texts: DataFrame, id_col: str, text_col: str, markers: bool = False) -> DataFrame:
    """(unit_id, tokens, line_nos, lines, all_nos): the statements of each text as tokens, with their first lines, their
    texts and all their lines."""
    rows = statements(texts, id_col, text_col, markers).withColumn("t", line_tokens(F.col("text")))
    packed = F.array_sort(F.collect_list(F.struct("statement", "t", "first_line", "text", "line_nos")))
    fields = {"tokens": "t", "line_nos": "first_line", "lines": "text", "all_nos": "line_nos"}
    return rows.groupBy("unit_id").agg(packed.alias("_p")).select("unit_id", *(F.col(f"_p.{f}").alias(n) for n, f in fields.items()))


def candidates(patches: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """(group_id, unit_id, hit_count): units that share most tokens with a patch's old side, comments aside."""
    asked = patches.select("group_id", strip_comments(F.col("pre")).alias("code"))
    found = search.hits(search.postings(units, "unit_id", "code"), search.query_tokens(asked, "group_id", "code"))
    return search.top_hits(found, most).select(F.col("query_id").alias("group_id"), "unit_id", "hit_count")


def benchmark_candidates(patches: DataFrame, corpus: DataFrame, most: int = 2000) -> DataFrame:
    """(group_id, unit_id, hit_count): for patches (group_id, vul_id, func, pre) the units of a benchmark corpus (unit_id,
    vul_id, func_name, code) that are versions of the same function.

    All patches of a vulnerability ask together, with all their tokens and of its own units only; of the `most` units
    with most hits those named like a patch's function are its candidates.
    """
    code = strip_comments(F.col("pre"))
    asked = patches.groupBy("vul_id").agg(F.array_join(F.sort_array(F.collect_list(code)), "\n").alias("code"))
    tokens = search.query_tokens(asked, "vul_id", "code", cap=1 << 30).withColumnRenamed("query_id", "vul_id")
    index = search.postings(corpus, "unit_id", "code").join(corpus.select("unit_id", "vul_id"), "unit_id")
    found = index.join(tokens, ["vul_id", "token"]).groupBy(F.col("vul_id").alias("query_id"), "unit_id").agg(F.count(F.lit(1)).alias("hit_count"))
    top = search.top_hits(found, most).join(corpus.select("unit_id", "func_name"), "unit_id")
    named = patches.select("group_id", F.col("vul_id").alias("query_id"), F.col("func").alias("func_name"))
    return top.join(named, ["query_id", "func_name"]).select("group_id", "unit_id", "hit_count")


def sides(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slices, modified): (group_id, side, slice, line_nos, all_nos, headers, tags) of both sides of every patch that has
    tokens on its old side, and (group_id, pre, post), the places of lines changed into each other."""
    made = {side: token_lines(patches, "group_id", side, True) for side in SIDES}
    none = {"tokens": "array<array<string>>", "line_nos": "array<int>", "lines": "array<string>", "all_nos": "array<array<int>>"}
    wide = patches.select("group_id")
    for side, rows in made.items():
        wide = wide.join(rows.select(F.col("unit_id").alias("group_id"), F.struct(*none).alias(side)), "group_id", "left")
    empty = F.struct(*(F.array().cast(kind).alias(n) for n, kind in none.items()))
    wide = wide.select("group_id", *(F.coalesce(side, empty).alias(side) for side in SIDES)).where(F.exists("pre.tokens", lambda t: F.size(t) > 0))
    wide = wide.withColumn("pair_id", F.xxhash64("group_id"))
    told = materialize(align.tag_pairs(wide.select("pair_id", *(F.col(f"{side}.tokens").alias(side) for side in SIDES))).join(wide.select("pair_id", "group_id"), "pair_id"))
    tags = told.groupBy("group_id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_t")).select("group_id", "side", F.transform("_t", lambda s: s["tag"]).alias("tags"))
    each = wide.select("group_id", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("_s")) for side in SIDES))).alias("_x"))
    slices = each.select("group_id", "_x.side", F.col("_x._s.tokens").alias("slice"), "_x._s.line_nos", "_x._s.all_nos", headers(F.col("_x._s.lines")).alias("headers"))
    changed = told.where("side = 'pre' and partner is not null").select("group_id", F.col("pos").alias("pre"), F.col("partner").alias("post"))
    return slices.join(tags, ["group_id", "side"]), changed


def traces(chosen: DataFrame, slices: DataFrame, units: DataFrame) -> DataFrame:
    """(pair_id, group_id, unit_id, side, pos, target_no, file_line, similarity, decay, tokens, tag, is_header, orig_lines)
    of the candidates (group_id, unit_id) aligned with both sides of their patch. pair_id stands for patch and unit. Units
    may have a start_line, the line of their file that they begin on."""
    start = F.col("start_line") if "start_line" in units.columns else F.lit(1).alias("start_line")
    wanted = units.select("unit_id", "code", start).join(chosen.select("unit_id").distinct(), "unit_id", "left_semi")
    targets = token_lines(wanted, "unit_id", "code").select("unit_id", F.col("tokens").alias("target"), F.col("line_nos").alias("target_nos"))
    both = chosen.select("group_id", "unit_id").join(slices, "group_id").join(targets, "unit_id").join(wanted.select("unit_id", "start_line"), "unit_id")
    both = both.withColumn("pair_id", F.xxhash64("group_id", "unit_id", "side"))
    keys = both.select("pair_id", "group_id", "unit_id", "side", "all_nos", "target_nos", "start_line")
    found = align.rebased(align.align_pairs(both), keys).join(keys.drop("target_nos", "start_line"), "pair_id")
    return found.withColumns({"pair_id": F.xxhash64("group_id", "unit_id"), "orig_lines": F.get("all_nos", F.col("pos"))}).drop("all_nos")


def match(patches: DataFrame, units: DataFrame, anchors: DataFrame | None = None, most: int = 2000, chosen: DataFrame | None = None) -> DataFrame:
    """(group_id, unit_id, verdict, confidence, score_vuln, score_fix, feat_vuln, feat_fix, rank) of each patch's
    candidates: patches have group_id, pre and post, units unit_id and code, anchors group_id, side, anchor, line_no and
    snippet.

    1. The units that share most tokens with the old side are candidates, unless they are chosen (group_id, unit_id); a
       patch without tokens there has none.
    2. Both sides of a patch are tagged against each other once, and a candidate is aligned with both. Headers count in
       no score.
    3. A side's score is its mean similarity after the decay for gaps. Where both sides have lines of their own and some
       were changed into each other, it is the mean before decay, less what the worse of two changed lines took from the
       better one.
    4. The total is half that score and half the anchors' (1 without anchors; those whose snippet has no tokens do not
       count). Totals give verdict and confidence; among a patch's VULNERABLE candidates rank counts from 0.
    """
    slices, changed = sides(patches)
    slices, chosen = materialize(slices), materialize(candidates(patches, units, most) if chosen is None else chosen.select("group_id", "unit_id").distinct())
    trace = materialize(traces(chosen, slices, units))
    own = slices.select("group_id", "side", F.exists("tags", lambda t: t != "COMMON").alias("has"))
    mixed = own.where("has").groupBy("group_id").count().where("count = 2").join(changed.select("group_id").distinct(), "group_id", "left_semi").select("group_id", F.lit(True).alias("_mixed"))
    pairs = trace.select("pair_id", "group_id", "unit_id").distinct()
    losses = scoring.competitive(trace, pairs.join(changed, "group_id"))
    decayed, raw = scoring.trace_scores(trace, F.col("similarity") * F.col("decay")), scoring.trace_scores(trace)
    marks = trace.select("group_id", "unit_id").distinct().join(_usable(anchors), "group_id").withColumn("pair_id", F.xxhash64("group_id", "unit_id")) if anchors is not None else None
    held = scoring.anchor_scores(trace, marks.select("pair_id", "side", "anchor", "line_no")) if marks is not None else trace.select("pair_id", "side").distinct().withColumn("anchor_score", F.lit(1.0))
    each = (
        decayed.join(raw.select("pair_id", "side", F.col("score").alias("_raw"), F.col("score_feat").alias("_raw_feat")), ["pair_id", "side"])
        .join(losses, ["pair_id", "side"], "left").join(held, ["pair_id", "side"], "left").join(pairs, "pair_id").join(own, ["group_id", "side"]).join(mixed, "group_id", "left")
    )
    score = F.when(F.col("_mixed"), F.greatest(F.lit(0.0), F.col("_raw") - F.coalesce("loss", F.lit(0.0)))).otherwise(F.col("score"))
    feat = F.when(F.col("has"), F.when(F.col("_mixed"), F.col("_raw_feat")).otherwise(F.col("score_feat")))
    sided = each.select("group_id", "unit_id", "side", "score_ctx", feat.alias("feat"), scoring.total(score, F.coalesce("anchor_score", F.lit(0.0))).alias("total"))
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    zero = F.lit(0.0)
    wide = sided.groupBy("group_id", "unit_id").agg(
        F.coalesce(of("pre", "total"), zero).alias("total_vuln"), F.coalesce(of("post", "total"), zero).alias("total_fix"),
        of("pre", "feat").alias("feat_vuln"), of("post", "feat").alias("feat_fix"), F.max("score_ctx").alias("score_ctx"),
    )
    judged = rank.ranked(scoring.verdict(wide), "group_id", ["unit_id"])
    sentinel = F.lit(-1.0)
    return judged.select(
        "group_id", "unit_id", "verdict", "confidence", F.col("total_vuln").alias("score_vuln"), F.col("total_fix").alias("score_fix"),
        F.coalesce("feat_vuln", sentinel).alias("feat_vuln"), F.coalesce("feat_fix", sentinel).alias("feat_fix"), "rank",
    )


def _usable(anchors: DataFrame) -> DataFrame:
    return anchors.where(F.size(line_tokens(F.col("snippet"))) > 0).select("group_id", "side", "anchor", "line_no")


def summary(matches: DataFrame) -> DataFrame:
    """Candidates of each patch by verdict, with the best confidence."""
    return matches.groupBy("group_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))
