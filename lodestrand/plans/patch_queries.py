"""Queries over diffs, the knowledge tables, statements, alignments, rankings, graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import ASCII_WORD, line_tokens
from lodestrand.operators import align, diffs, graphs, knowledge, rank, scoring, search, statements
from lodestrand.plans import storage
from lodestrand.plans.index_queries import document_postings
from lodestrand.plans.literals import frame, turn_pairs, values_sql
from lodestrand.sources.tables import table

#: Every turn with the one before it as a diff of two hunks: all its lines, some made into comments, and a note.
_MADE = "CASE length(x) % 7 WHEN 0 THEN '// ' || x WHEN 1 THEN '/* ' || x || ' */' WHEN 2 THEN '* ' || x WHEN 3 THEN '' ELSE x END"
_DIFFS = f"""(
SELECT a.conv_id * 100000 + a.turn AS diff_id, '@@ -' || (10 * a.turn + 1) || ',9 +' || (10 * a.turn + 1) || ',9 @@' || chr(10) || ' ' || a.role || chr(10)
  || array_to_string(list_transform(string_split(a.text, chr(10)), lambda x: '-' || {_MADE}), chr(10)) || chr(10) || array_to_string(list_transform(string_split(b.text, chr(10)), lambda x: '+' || {_MADE}), chr(10))
  || chr(10) || '@@ -900,2 +900,2 @@' || chr(10) || '-// ' || a.role || chr(10) || '+// ' || b.role AS diff
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
_LINES = rf"""
cut AS (SELECT diff_id, unnest(string_split(diff, chr(10))) AS line, generate_subscripts(string_split(diff, chr(10)), 1) AS i FROM {_DIFFS}),
num AS (SELECT *, regexp_matches(line, '^@@ -') AS head, sum(CASE WHEN regexp_matches(line, '^@@ -') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS hunk FROM cut),
st AS (SELECT *, max(CASE WHEN head THEN CAST(regexp_extract(line, '^@@ -(\d+)', 1) AS INTEGER) END) OVER (PARTITION BY diff_id, hunk) AS s1,
              max(CASE WHEN head THEN CAST(regexp_extract(line, '\+(\d+)', 1) AS INTEGER) END) OVER (PARTITION BY diff_id, hunk) AS s2 FROM num WHERE hunk > 0),
body AS (SELECT diff_id, hunk, i, head, line[1] AS sign, line[2:] AS body,
     s1 + coalesce(sum(CASE WHEN NOT head AND line[1] <> '+' THEN 1 ELSE 0 END) OVER w, 0) AS old_no, s2 + coalesce(sum(CASE WHEN NOT head AND line[1] <> '-' THEN 1 ELSE 0 END) OVER w, 0) AS new_no
     FROM st WINDOW w AS (PARTITION BY diff_id, hunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, trim(body) AS s, CASE WHEN trim(body) = '' OR starts_with(trim(body), '//') THEN true
     WHEN starts_with(trim(body), '/*') THEN strpos(trim(body), '*/') = 0 OR trim(substr(trim(body), strpos(trim(body), '*/') + 2)) = ''
     WHEN starts_with(trim(body), '*') THEN starts_with(trim(body), '*/') OR trim(body) = '*' OR starts_with(trim(body), '* ') OR regexp_full_match(trim(body), '[*/]+') ELSE false END AS noise
     FROM body WHERE NOT head)
"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """The same as _DIFFS: a turn and the one behind it, brought together by one window."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    both = turn_pairs(rows)
    made = lambda x: F.when(F.length(x) % 7 == 0, F.concat(F.lit("// "), x)).when(F.length(x) % 7 == 1, F.concat(F.lit("/* "), x, F.lit(" */"))).when(F.length(x) % 7 == 2, F.concat(F.lit("* "), x)).when(F.length(x) % 7 == 3, "").otherwise(x)
    signed = lambda c, sign: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(sign), made(x))), "\n")
    at = (10 * F.col("turn") + 1).cast("string")
    head = F.concat(F.lit("@@ -"), at, F.lit(",9 +"), at, F.lit(",9 @@\n "), "role")
    tail = F.concat(F.lit("@@ -900,2 +900,2 @@\n-// "), "role", F.lit("\n+// "), "next_role")
    return both.select((F.col("conv_id") * 100000 + F.col("turn")).alias("diff_id"), F.concat_ws("\n", head, signed("text", "-"), signed("next_text", "+"), tail).alias("diff"))


def noise_hunks(spark: SparkSession, d: str) -> DataFrame:
    return diffs.noise_hunks(diffs.hunk_lines(_diffs(spark, d), "diff_id", "diff"))


NOISE_HUNKS = f"WITH {_LINES} SELECT diff_id, CAST(hunk AS BIGINT) AS hunk, bool_and(noise OR sign NOT IN ('+', '-')) AS noise FROM judged GROUP BY 1, 2"


def diff_line_walk(spark: SparkSession, d: str) -> DataFrame:
    return diffs.changed_lines(diffs.hunk_lines(_diffs(spark, d), "diff_id", "diff"))


DIFF_LINE_WALK = f"""
WITH {_LINES} SELECT diff_id, CAST(hunk AS BIGINT) AS hunk, sign, CAST(CASE sign WHEN '-' THEN old_no ELSE new_no END AS INTEGER) AS line_no, s AS code
FROM judged WHERE sign IN ('+', '-') AND NOT noise
"""


def patch_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return diffs.neighbourhood(diffs.changed_lines(diffs.hunk_lines(_diffs(spark, d), "diff_id", "diff")))


PATCH_NEIGHBOURHOOD = f"""
WITH {_LINES}, c AS (SELECT diff_id, CASE sign WHEN '-' THEN old_no ELSE new_no END AS n FROM judged WHERE sign IN ('+', '-') AND NOT noise)
SELECT DISTINCT diff_id, CAST(n + k AS INTEGER) AS line_no FROM c, (VALUES (-2), (-1), (0), (1), (2)) AS o(k) WHERE n + k > 0
"""


def cleaned_diffs(spark: SparkSession, d: str) -> DataFrame:
    return diffs.cleaned(diffs.hunk_lines(_diffs(spark, d), "diff_id", "diff"))


CLEANED_DIFFS = f"""
WITH {_LINES}, keep AS (SELECT diff_id, hunk FROM judged GROUP BY 1, 2 HAVING NOT bool_and(noise OR sign NOT IN ('+', '-')))
SELECT diff_id, string_agg(sign || body, chr(10) ORDER BY i) AS text FROM judged JOIN keep USING (diff_id, hunk) GROUP BY 1
"""


def primary_version(spark: SparkSession, d: str) -> DataFrame:
    return diffs.primary_version(_diffs(spark, d), "diff_id", "diff")


PRIMARY_VERSION = f"""
WITH l AS (SELECT diff_id, unnest(string_split(diff, chr(10))) AS line FROM {_DIFFS}),
n AS (SELECT diff_id, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS a, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS r FROM l GROUP BY 1)
SELECT diff_id, CAST(a AS INTEGER) AS added, CAST(r AS INTEGER) AS removed, CASE WHEN r > 0 AND a = 0 THEN 'OLD' ELSE 'NEW' END AS version FROM n
"""

_IDS = "(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'CWE-' || p_partkey % 1000 WHEN 1 THEN 'CWE-' || p_partkey % 500 || ': ' || p_name WHEN 2 THEN CAST(p_partkey % 500 AS VARCHAR) WHEN 3 THEN ' ' || p_partkey % 500 || ' ' WHEN 4 THEN p_name END AS raw FROM part)"


def cwe_category(spark: SparkSession, d: str) -> DataFrame:
    """Every part with an identifier of a weakness, in one of the forms that they are written in."""
    key = F.col("p_partkey")
    small = (key % 500).cast("string")
    raw = F.when(key % 6 == 0, F.concat(F.lit("CWE-"), (key % 1000).cast("string"))).when(key % 6 == 1, F.concat(F.lit("CWE-"), small, F.lit(": "), "p_name")).when(key % 6 == 2, small)
    raw = raw.when(key % 6 == 3, F.concat(F.lit(" "), small, F.lit(" "))).when(key % 6 == 4, F.col("p_name"))
    found = knowledge.classify(table(spark, d, "part").select("p_partkey", raw.alias("raw")), spark, "raw")
    return found.select("p_partkey", "raw", F.coalesce("cwe", F.lit(-1)).alias("cwe"), "category", "major", "is_numeric")


CWE_CATEGORY = rf"""
WITH i AS (SELECT p_partkey, raw, coalesce(TRY_CAST(nullif(regexp_extract(raw, 'CWE-(\d+)', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(raw, '^\s*(\d+)\s*$', 1), '') AS INTEGER)) AS cwe FROM {_IDS}),
c AS (SELECT i.p_partkey, i.raw, i.cwe, coalesce(w.category, 'Unknown') AS category FROM i LEFT JOIN (SELECT * FROM {values_sql(list(knowledge.CWE), 'cwe, category')}) w USING (cwe))
SELECT p_partkey, raw, coalesce(cwe, -1) AS cwe, category, major, major = 'Numeric-Domain' AS is_numeric FROM c LEFT JOIN (SELECT * FROM {values_sql(list(knowledge.CATEGORIES), 'category, major')}) m USING (category)
"""

_POS = [(i, c) for i, (c, _) in enumerate(knowledge.CATEGORIES)]
_CATS = f"(SELECT * FROM {values_sql(_POS, 'pos, category')})"
_NAMES = f"""(SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN c.category WHEN 1 THEN lower(c.category) || ' ' WHEN 2 THEN c.category || ' in ' || p_name WHEN 3 THEN split_part(c.category, ' ', 1) ELSE p_name END AS name
  FROM part JOIN {_CATS} c ON c.pos = p_partkey % {len(_POS)})"""


def category_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names that parts give to categories: exact, in other case, as a part of more, and none."""
    key, of = F.col("p_partkey"), F.col("category")
    known = knowledge.categories(spark).select(F.col("pos").alias("_pos"), "category")
    both = table(spark, d, "part").withColumn("_pos", (key % len(_POS)).cast("int")).join(known, "_pos")
    name = F.when(key % 5 == 0, of).when(key % 5 == 1, F.concat(F.lower(of), F.lit(" "))).when(key % 5 == 2, F.concat(of, F.lit(" in "), "p_name")).when(key % 5 == 3, F.substring_index(of, " ", 1)).otherwise(F.col("p_name"))
    return knowledge.resolve(both.select(name.alias("name")).distinct(), spark, "name").select("name", "category", F.coalesce("rule", F.lit(0)).alias("rule"))


CATEGORY_RESOLUTION = f"""
WITH n AS (SELECT * FROM {_NAMES}), b AS (SELECT name, category, pos, CASE WHEN name = category THEN 1 WHEN lower(trim(name)) = lower(category) THEN 2
      WHEN contains(lower(trim(name)), lower(category)) OR contains(lower(category), lower(trim(name))) THEN 3 END AS rule FROM n, {_CATS} c)
SELECT name, coalesce(category, 'Unknown') AS category, coalesce(rule, 0) AS rule FROM (SELECT n.name, b.category, b.rule, b.pos FROM n LEFT JOIN b ON n.name = b.name AND b.rule IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY rule NULLS LAST, pos) = 1
"""


def statement_groups(spark: SparkSession, d: str) -> DataFrame:
    made = statements.statements(table(spark, d, "documents"), "doc_id", "text")
    return made.select("unit_id", "statement", "first_line", "n_lines", F.length("text").alias("n_chars"))


STATEMENT_GROUPS = r"""
WITH t AS (SELECT doc_id AS unit_id, string_split(regexp_replace(text, '//[^\n]*', '', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT * FROM (SELECT unit_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM t) WHERE trim(line) <> ''),
p AS (SELECT *, regexp_replace(line, '"[^"]*"|''[^'']*''', '', 'g') AS q FROM l),
dl AS (SELECT *, length(regexp_replace(q, '[^(]', '', 'g')) - length(regexp_replace(q, '[^)]', '', 'g')) AS delta FROM p),
s AS (SELECT *, sum(delta) OVER w AS s FROM dl WINDOW w AS (PARTITION BY unit_id ORDER BY n)),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY unit_id ORDER BY n)) AS depth FROM s),
g AS (SELECT *, coalesce(sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement FROM m)
SELECT unit_id, CAST(statement AS BIGINT) AS statement, CAST(min(n) AS INTEGER) AS first_line, count(*) AS n_lines, CAST(sum(length(trim(line))) + count(*) - 1 AS INTEGER) AS n_chars FROM g GROUP BY 1, 2
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark passage with the document that shares most of its tokens, cut into sentences of line tokens."""
    units, passages = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = search.top_hits(search.hits(document_postings(spark, d), search.query_tokens(passages, "item_id", "text", ASCII_WORD)), 1)
    both = found.join(passages.select(F.col("item_id").alias("query_id"), F.col("text").alias("a")), "query_id").join(units.select(F.col("doc_id").alias("unit_id"), F.col("text").alias("b")), "unit_id")
    cut = lambda c: F.transform(F.split(c, r"[.\n]\s*"), line_tokens)
    return both.select(F.col("query_id").alias("pair_id"), cut("a").alias("slice"), cut("b").alias("target"))


def line_tags(spark: SparkSession, d: str) -> DataFrame:
    return align.tag_pairs(_pairs(spark, d).select("pair_id", F.col("slice").alias("pre"), F.col("target").alias("post")))


def align_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).withColumns(
        {"line_nos": F.transform("slice", lambda x, i: i + 1), "tags": F.transform("slice", lambda x: F.lit("VULN"))}
    )
    trace = align.align_pairs(pairs).withColumn("side", F.lit("pre"))
    return scoring.trace_scores(trace, F.col("similarity") * F.col("decay")).select("pair_id", F.round("score", 6).alias("score"), F.round("score_feat", 6).alias("score_feat"))


_TRACE = """(SELECT l_orderkey AS pair_id, CASE l_linestatus WHEN 'O' THEN 'pre' ELSE 'post' END AS side, l_linenumber AS orig_line, CAST(l_quantity AS INTEGER) AS tokens, round(l_discount * 10, 2) AS similarity,
  CASE l_returnflag WHEN 'N' THEN 'COMMON' WHEN 'R' THEN 'VULN' ELSE 'FIX' END AS tag, l_linenumber = 7 AS is_header FROM lineitem) AS t"""
_ANCHORS = """(SELECT l_orderkey AS pair_id, CASE l_linestatus WHEN 'O' THEN 'pre' ELSE 'post' END AS side, 'a' || l_partkey % 3 AS anchor, CASE WHEN l_tax > 0.06 THEN -1 ELSE l_linenumber + l_suppkey % 2 END AS line_no FROM lineitem) AS a"""


def score_from_trace(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pairs: a line's status is its side, its discount a similarity and its quantity the tokens."""
    rows = table(spark, d, "lineitem").withColumns({"pair_id": F.col("l_orderkey"), "side": F.when(F.col("l_linestatus") == "O", "pre").otherwise("post")})
    flag = F.col("l_returnflag")
    trace = rows.select(
        "pair_id", "side", F.col("l_linenumber").alias("orig_line"), F.col("l_quantity").cast("int").alias("tokens"), F.round(F.col("l_discount") * 10, 2).alias("similarity"),
        F.when(flag == "N", "COMMON").when(flag == "R", "VULN").otherwise("FIX").alias("tag"), (F.col("l_linenumber") == 7).alias("is_header"),
    )
    line = F.when(F.col("l_tax") > 0.06, -1).otherwise(F.col("l_linenumber") + F.col("l_suppkey") % 2).cast("int")
    anchors = rows.select("pair_id", "side", F.concat(F.lit("a"), (F.col("l_partkey") % 3).cast("string")).alias("anchor"), line.alias("line_no"))
    both = scoring.trace_scores(trace).join(scoring.anchor_scores(trace, anchors), ["pair_id", "side"])
    six = lambda c: F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)
    return both.select("pair_id", "side", six("score").alias("score"), six("score_feat").alias("score_feat"), six("anchor_score").alias("anchor_score"), six(scoring.total(F.col("score"), F.col("anchor_score"))).alias("total"))


SCORE_FROM_TRACE = f"""
WITH t AS (SELECT * FROM {_TRACE}), a AS (SELECT * FROM {_ANCHORS} WHERE line_no > 0),
s AS (SELECT pair_id, side, coalesce(sum(tokens * similarity) FILTER (NOT is_header) / nullif(sum(tokens) FILTER (NOT is_header), 0), 0.0) AS score,
       coalesce(sum(tokens * similarity) FILTER (NOT is_header AND tag <> 'COMMON') / nullif(sum(tokens) FILTER (NOT is_header AND tag <> 'COMMON'), 0), 0.0) AS score_feat FROM t GROUP BY 1, 2),
b AS (SELECT a.pair_id, a.side, anchor, coalesce(max(similarity), 0.0) AS m FROM a LEFT JOIN t ON a.pair_id = t.pair_id AND a.side = t.side AND a.line_no = t.orig_line GROUP BY 1, 2, 3),
c AS (SELECT pair_id, side, avg(m) AS anchor_score FROM b GROUP BY 1, 2)
SELECT s.pair_id, s.side, round(score + 1e-9, 6) AS score, round(score_feat + 1e-9, 6) AS score_feat, round(coalesce(anchor_score, 1.0) + 1e-9, 6) AS anchor_score,
  round(0.5 * score + 0.5 * coalesce(anchor_score, 1.0) + 1e-9, 6) AS total
FROM s LEFT JOIN c ON s.pair_id = c.pair_id AND s.side = c.side
"""

_TOTALS = """(SELECT l_orderkey, l_linenumber, round(l_discount * 10, 2) AS total_vuln, round(l_tax * 10, 2) AS total_fix, CASE WHEN l_returnflag <> 'N' THEN round(l_quantity / 50, 2) END AS feat_vuln,
  CASE WHEN l_linestatus = 'O' THEN round(l_quantity / 50, 2) END AS feat_fix, 0.5 AS score_ctx FROM lineitem)"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as candidates: discount and tax as totals, quantities as what the changed lines score."""
    share = F.round(F.col("l_quantity") / 50, 2)
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 10, 2).alias("total_vuln"), F.round(F.col("l_tax") * 10, 2).alias("total_fix"),
        F.when(F.col("l_returnflag") != "N", share).alias("feat_vuln"), F.when(F.col("l_linestatus") == "O", share).alias("feat_fix"), F.lit(0.5).alias("score_ctx"),
    )
    return scoring.verdict(rows).select("l_orderkey", "l_linenumber", "verdict", F.round("confidence", 6).alias("confidence"))


VERDICTS = f"""
WITH r AS (SELECT *, CASE WHEN total_vuln < 0.4 THEN 'MISMATCH' WHEN feat_fix IS NOT NULL AND feat_vuln IS NULL THEN CASE WHEN feat_fix >= 0.9 THEN 'PATCHED' ELSE 'VULNERABLE' END
  WHEN feat_vuln IS NOT NULL AND feat_fix IS NULL THEN CASE WHEN feat_vuln < 0.4 THEN 'PATCHED' ELSE 'VULNERABLE' END
  WHEN feat_vuln IS NOT NULL THEN CASE WHEN total_fix > total_vuln THEN 'PATCHED' ELSE 'VULNERABLE' END ELSE 'UNKNOWN' END AS verdict
  FROM {_TOTALS})
SELECT l_orderkey, l_linenumber, verdict, CAST(round(CASE verdict WHEN 'MISMATCH' THEN 1 - total_vuln WHEN 'PATCHED' THEN total_fix WHEN 'UNKNOWN' THEN score_ctx ELSE total_vuln END, 6) AS DOUBLE) AS confidence FROM r
"""

_FACTS = {"consistent": "l_quantity > 5", "reachable": "l_discount > 0.01", "in_scope": "l_tax < 0.07", "blocked": "l_linenumber = 3", "vulnerable": "l_returnflag <> 'N'"}


def final_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(rule).alias(name) for name, rule in _FACTS.items()))
    return scoring.final_verdict(rows).select("l_orderkey", "l_linenumber", "verdict")


FINAL_VERDICTS = f"""
SELECT l_orderkey, l_linenumber, CASE WHEN NOT consistent THEN 'SAFE-Mismatch' WHEN NOT reachable THEN 'SAFE-Unreachable' WHEN NOT in_scope THEN 'SAFE-OutOfScope' WHEN blocked THEN 'SAFE-Blocked'
  WHEN vulnerable THEN 'VULNERABLE' ELSE 'SAFE-Unknown' END AS verdict FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'{rule} AS {name}' for name, rule in _FACTS.items())} FROM lineitem)
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as candidates: a part is the target, a supplier the patch, a return flag the verdict."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("patch_func"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"),
        F.when(flag == "R", "VULNERABLE").when(flag == "A", "PATCHED").otherwise("UNKNOWN").alias("verdict"), F.round(F.col("l_discount") * 10, 2).alias("confidence"),
    )


_CANDIDATES = """
SELECT l_suppkey AS patch_func, l_partkey AS target, l_orderkey AS seq, l_linenumber AS line,
  CASE l_returnflag WHEN 'R' THEN 'VULNERABLE' WHEN 'A' THEN 'PATCHED' ELSE 'UNKNOWN' END AS verdict, round(l_discount * 10, 2) AS confidence FROM lineitem
"""
_BEST = f"""
best AS (SELECT * FROM ({_CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY CASE verdict WHEN 'VULNERABLE' THEN 3 WHEN 'UNKNOWN' THEN 2 WHEN 'PATCHED' THEN 1 ELSE 0 END DESC, confidence DESC, seq * 10 + line) = 1),
ranked AS (SELECT *, CASE WHEN verdict = 'VULNERABLE' THEN row_number() OVER (PARTITION BY patch_func, verdict = 'VULNERABLE' ORDER BY confidence DESC, target) - 1 ELSE -1 END AS rank FROM best)
"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    return rank.best_per_target(_candidates(spark, d).withColumn("at", F.col("seq") * 10 + F.col("line")), ["target"], "at").drop("at")


def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("target", "patch_func", "verdict", "confidence", "seq")


DEDUP_CANDIDATES = f"WITH {_BEST} SELECT target, patch_func, verdict, confidence, seq FROM best"


def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(_best(spark, d), "patch_func", ["target"]).where("confidence >= 0.4 or rank < 0").select("patch_func", "target", F.col("rank").cast("int").alias("rank"))


RANK_CANDIDATES = f"WITH {_BEST} SELECT patch_func, target, CAST(rank AS INTEGER) AS rank FROM ranked WHERE confidence >= 0.4 OR rank < 0"


def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A walk down each supplier's shortlist of ten."""
    short = rank.shortlist(rank.ranked(_best(spark, d), "patch_func", ["target"]), "patch_func", ["target"])
    return rank.adaptive_threshold(short, "patch_func", ["place"], F.col("line") == 1, "confidence")


ADAPTIVE_THRESHOLD = f"""
WITH RECURSIVE {_BEST},
short AS (SELECT *, row_number() OVER (PARTITION BY patch_func ORDER BY CASE WHEN rank < 0 THEN 999 ELSE rank END, target) AS place FROM ranked QUALIFY place <= 10),
walk AS (
  SELECT patch_func, CAST(0 AS BIGINT) AS place, CAST(0.4 AS DOUBLE) AS t, 0 AS taken, 0 AS skipped FROM short GROUP BY 1
  UNION ALL
  SELECT w.patch_func, s.place, CASE WHEN s.confidence >= w.t AND s.line = 1 THEN round(w.t + 0.1, 6) ELSE w.t END, w.taken + CASE WHEN s.confidence < w.t THEN 0 ELSE 1 END, w.skipped + CASE WHEN s.confidence < w.t THEN 1 ELSE 0 END
  FROM walk w JOIN short s ON s.patch_func = w.patch_func AND s.place = w.place + 1
)
SELECT patch_func, t AS threshold, taken, skipped FROM walk QUALIFY row_number() OVER (PARTITION BY patch_func ORDER BY place DESC) = 1
"""


def peer_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one order as peers."""
    return rank.peers(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


PEER_JOIN = """
SELECT l_orderkey, l_partkey, peer FROM (SELECT DISTINCT a.l_orderkey, a.l_partkey, b.l_partkey AS peer FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY peer) <= 200
"""

#: Parts as patches: brand and size are a file, a name and a price class a function.
_PATCHES = "(SELECT p_partkey AS id, p_brand || '/' || p_size AS file, p_name || ' ' || p_partkey // 40 AS func FROM part)"
_CALLS = "(SELECT l_partkey AS a, p_name || ' ' || p_partkey // 40 AS callee FROM lineitem JOIN part ON p_partkey = l_suppkey * 7 WHERE l_quantity >= 49)"
_MEMBERS = "(SELECT p_partkey AS id, p_type AS member FROM part)"


def _patches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patches, their calls and the members they use, as in _PATCHES, _CALLS and _MEMBERS."""
    parts, func = table(spark, d, "part"), F.concat_ws(" ", "p_name", F.floor(F.col("p_partkey") / 40).cast("string"))
    patches = parts.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("file"), func.alias("func"))
    some = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 7).alias("p_partkey"))
    return patches, some.join(parts.select("p_partkey", func.alias("callee")), "p_partkey").select("a", "callee"), parts.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("member"))


def patch_components(spark: SparkSession, d: str) -> DataFrame:
    patches, made, members = _patches(spark, d)
    calls = graphs.call_edges(patches, made)
    return graphs.components(patches.select("id"), calls.unionAll(graphs.shared_member_edges(patches, members, calls)))


PATCH_COMPONENTS = f"""
WITH RECURSIVE p AS (SELECT * FROM {_PATCHES}), c AS (SELECT DISTINCT * FROM {_CALLS}), mb AS (SELECT * FROM {_MEMBERS}),
m AS (SELECT c.a, q.id AS b, q.file = o.file AS same, max(q.file = o.file) OVER (PARTITION BY c.a, c.callee) AS near, count(DISTINCT q.file) OVER (PARTITION BY c.a, c.callee) AS files
      FROM c JOIN p o ON o.id = c.a JOIN p q ON q.func = c.callee),
e AS (SELECT a, b FROM m WHERE (near AND same) OR (NOT near AND files = 1)
      UNION SELECT x.id, y.id FROM mb x JOIN mb y ON x.member = y.member AND x.id <> y.id JOIN p px ON px.id = x.id JOIN p py ON py.id = y.id AND px.file = py.file),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id AS other FROM p UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.other)
SELECT id, min(other) AS component FROM r GROUP BY 1
"""


def patch_groups(spark: SparkSession, d: str) -> DataFrame:
    """Components cut so that no two patches of one function are together."""
    patches = _patches(spark, d)[0]
    same = patches.alias("x").join(patches.alias("y"), F.expr("x.func = y.func and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return graphs.patch_groups(patch_components(spark, d), patches, same)


#: Every user as a function: kinds of events are nodes, and an event leads to the user's next one.
_FLOW = """(SELECT DISTINCT func_id, src, dst FROM (
  SELECT CAST(user_id AS VARCHAR) AS func_id, coalesce(lag(event_type) OVER w, 'ENTRY') AS src, event_type AS dst FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  UNION ALL SELECT CAST(user_id AS VARCHAR), event_type, 'EXIT' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1))"""
#: What kinds of events define and use.
ACCESSES = [("signup", "session", "def"), ("click", "session", "use"), ("click", "cart", "def"), ("view", "item", "def"), ("purchase", "cart", "use"), ("purchase", "item", "use"), ("error", "session", "def"), ("error", "item", "use")]
_ACCESSES = f"(SELECT DISTINCT CAST(user_id AS VARCHAR) AS func_id, node, var, access FROM events JOIN (SELECT * FROM {values_sql(ACCESSES, 'node, var, access')}) ON node = event_type)"


def _flow(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("func_id"), "event_type", "ts", "event_id")
    order = Window.partitionBy("func_id").orderBy("ts", "event_id")
    steps = events.select("func_id", F.lag("event_type").over(order).alias("src"), F.col("event_type").alias("dst"), F.lead("event_type").over(order).alias("_next"))
    inner = steps.select("func_id", F.coalesce("src", F.lit("ENTRY")).alias("src"), "dst")
    return inner.unionAll(steps.where("_next is null").select("func_id", "dst", F.lit("EXIT"))).distinct()


def _accesses(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "events").select(F.col("user_id").cast("string").alias("func_id"), F.col("event_type").alias("node")).distinct()
    return kinds.join(frame(spark, ACCESSES, "node string, var string, access string"), "node").select("func_id", "node", "var", "access")


def reaching_definitions(spark: SparkSession, d: str) -> DataFrame:
    return graphs.reaching_definitions(_flow(spark, d), _accesses(spark, d))


REACHING_DEFINITIONS = f"""
WITH RECURSIVE fl AS (SELECT * FROM {_FLOW}), ac AS (SELECT * FROM {_ACCESSES}),
r AS (SELECT d.func_id, d.var, d.node AS def_node, fl.dst AS node FROM ac d JOIN fl ON fl.func_id = d.func_id AND fl.src = d.node WHERE d.access = 'def'
  UNION SELECT r.func_id, r.var, r.def_node, fl.dst FROM r JOIN fl ON fl.func_id = r.func_id AND fl.src = r.node
  WHERE NOT EXISTS (SELECT 1 FROM ac k WHERE k.func_id = r.func_id AND k.node = r.node AND k.var = r.var AND k.access = 'def'))
SELECT r.func_id, r.var, r.def_node, r.node AS use_node FROM r JOIN ac u ON u.func_id = r.func_id AND u.node = r.node AND u.var = r.var AND u.access = 'use'
"""


def control_dependence(spark: SparkSession, d: str) -> DataFrame:
    return graphs.control_dependence(_flow(spark, d))


CONTROL_DEPENDENCE = f"""
WITH RECURSIVE fl AS (SELECT * FROM {_FLOW}), nd AS (SELECT func_id, src AS node FROM fl UNION SELECT func_id, dst FROM fl),
around AS (SELECT func_id, node AS d, 'EXIT' AS node FROM nd WHERE node <> 'EXIT'
  UNION SELECT r.func_id, r.d, fl.src FROM around r JOIN fl ON fl.func_id = r.func_id AND fl.dst = r.node WHERE fl.src <> r.d),
post AS (SELECT a.func_id, a.node AS node, b.node AS d FROM nd a JOIN nd b ON a.func_id = b.func_id
  WHERE a.node = b.node OR (a.node <> 'EXIT' AND NOT EXISTS (SELECT 1 FROM around r WHERE r.func_id = a.func_id AND r.d = b.node AND r.node = a.node)))
SELECT DISTINCT fl.func_id, fl.src, p.d AS dst FROM fl JOIN post p ON p.func_id = fl.func_id AND p.node = fl.dst
WHERE p.d = fl.src OR NOT EXISTS (SELECT 1 FROM post q WHERE q.func_id = fl.func_id AND q.node = fl.src AND q.d = p.d)
"""

_PAIRS = "(SELECT func_id, a.node AS source, b.node AS target FROM (SELECT func_id, src AS node FROM fl UNION SELECT func_id, dst FROM fl) a JOIN (SELECT func_id, src AS node FROM fl UNION SELECT func_id, dst FROM fl) b USING (func_id))"


def pair_reachability(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a user's nodes."""
    flow = _flow(spark, d)
    nodes = flow.select("func_id", F.col("src").alias("source")).unionAll(flow.select("func_id", "dst")).distinct()
    found = graphs.pair_reachability(flow, nodes.join(nodes.toDF("func_id", "target"), "func_id"))
    return found.withColumn("hops", F.coalesce("hops", F.lit(-1)))


PAIR_REACHABILITY = f"""
WITH RECURSIVE fl AS (SELECT * FROM {_FLOW}), pr AS (SELECT * FROM {_PAIRS}),
r AS (SELECT pr.func_id, pr.source, fl.dst AS node, 1 AS hops FROM (SELECT DISTINCT func_id, source FROM pr) pr JOIN fl ON fl.func_id = pr.func_id AND fl.src = pr.source
  UNION SELECT r.func_id, r.source, fl.dst, r.hops + 1 FROM r JOIN fl ON fl.func_id = r.func_id AND fl.src = r.node WHERE r.hops < 20)
SELECT pr.func_id, pr.source, pr.target, coalesce(min(r.hops), -1) AS hops FROM pr LEFT JOIN r ON r.func_id = pr.func_id AND r.source = pr.source AND r.node = pr.target GROUP BY 1, 2, 3
"""

_CHECKS = """(SELECT l_orderkey AS candidate, l_quantity > 5 AS reachable, CASE l_returnflag WHEN 'N' THEN 'data' WHEN 'R' THEN 'control' ELSE 'temporal' END AS path_type, l_linestatus = 'F' AS is_optional,
  l_linenumber > 4 AS skipped FROM lineitem)"""


def chain_verification(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates whose lines are the pairs that were checked."""
    kind = F.when(F.col("l_returnflag") == "N", "data").when(F.col("l_returnflag") == "R", "control").otherwise("temporal")
    return graphs.chain_verdict(table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("candidate"), (F.col("l_quantity") > 5).alias("reachable"), kind.alias("path_type"), (F.col("l_linestatus") == "F").alias("is_optional"), (F.col("l_linenumber") > 4).alias("skipped")
    ))


CHAIN_VERIFICATION = f"""
SELECT candidate, count(*) FILTER (NOT is_optional AND NOT skipped AND NOT reachable) = 0 AS reachable,
  CASE count(DISTINCT path_type) FILTER (reachable AND NOT skipped) WHEN 0 THEN 'none' WHEN 1 THEN min(path_type) FILTER (reachable AND NOT skipped) ELSE 'mixed' END AS path_type
FROM {_CHECKS} GROUP BY 1
"""

def program_slice(spark: SparkSession, d: str) -> DataFrame:
    """What of a user's events bears on the cart of a purchase: data edges from reaching definitions, control edges."""
    data = reaching_definitions(spark, d).select("func_id", F.col("def_node").alias("src"), F.col("use_node").alias("dst"), F.lit("data").alias("kind"), "var")
    control = control_dependence(spark, d).select("func_id", "src", "dst", F.lit("control").alias("kind"), F.lit(None).cast("string").alias("var"))
    asked = _accesses(spark, d).where("node = 'purchase'").select("func_id", "node").distinct().withColumn("vars", F.array(F.lit("cart")))
    return graphs.slice_nodes(data.unionAll(control), asked)


_FINDINGS = [f"SELECT CAST(l_suppkey AS VARCHAR) AS vul_id, l_returnflag AS file, l_linestatus AS func FROM lineitem WHERE l_linenumber {which}" for which in ("<= 2", ">= 2")]


def findings_append(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    old, new = (rows.where(f"l_linenumber {which}").select(F.col("l_suppkey").cast("string").alias("vul_id"), F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("func")) for which in ("<= 2", ">= 2"))
    return storage.append_findings(old, new)


FINDINGS_APPEND = " UNION ".join(_FINDINGS)


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return storage.batch_summary(table(spark, d, "events").select("event_type", (F.col("value") >= 10).alias("ok")), "event_type", "ok")


BATCH_SUMMARY = """
SELECT event_type, count(*) AS total, count(*) FILTER (value >= 10) AS succeeded, count(*) FILTER (NOT value >= 10) AS failed FROM events GROUP BY ROLLUP (event_type)
"""

QUERIES = {
    f.__name__: f
    for f in (
        noise_hunks, diff_line_walk, patch_neighbourhood, cleaned_diffs, primary_version, cwe_category, category_resolution, statement_groups, line_tags, align_scores,
        score_from_trace, verdicts, final_verdicts, dedup_candidates, rank_candidates, adaptive_threshold, peer_join, patch_components, patch_groups,
        reaching_definitions, control_dependence, pair_reachability, chain_verification, program_slice, findings_append, batch_summary,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
