"""Queries over versions of files, diffs as sets and hunks, evidence and the results of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import diff_side
from lodestrand.operators import diffs, grouping, lookup, slices, versions
from lodestrand.plans import storage
from lodestrand.plans.evidence_queries import _FUNCTIONS, _functions
from lodestrand.plans.literals import turn_pairs
from lodestrand.plans.patch_queries import _DIFFS, _diffs
from lodestrand.sources.tables import table


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a commit on the turn before, with one file, named by its role."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    blobs = turns.select(name(F.col("turn")).alias("version"), F.concat("role", F.lit(".c")).alias("path"), "text")
    commits = turn_pairs(turns).select(name(F.col("turn") + 1).alias("version"), name(F.col("turn")).alias("parent"))
    found = versions.changed_files(blobs, commits)
    size = lambda c: F.coalesce(F.length(c), F.lit(-1))
    return found.select("version", "path", size("old_text").alias("n_old"), size("new_text").alias("n_new"))


CHANGED_FILES = """
WITH p AS (SELECT b.conv_id || ':' || b.turn AS version, a.role || '.c' AS p1, a.text AS t1, b.role || '.c' AS p2, b.text AS t2 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT version, p1 AS path, CAST(length(t1) AS INTEGER) AS n_old, CAST(CASE WHEN p1 = p2 THEN length(t2) ELSE -1 END AS INTEGER) AS n_new FROM p WHERE p1 <> p2 OR t1 <> t2
UNION ALL SELECT version, p2, CAST(-1 AS INTEGER), CAST(length(t2) AS INTEGER) FROM p WHERE p1 <> p2
"""


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    """The C functions of users as files of three versions."""
    made = _functions(spark, d)
    return made.select(F.concat(F.lit("v"), (F.col("func_id").cast("long") % 3).cast("string")).alias("version"), F.concat("func_id", F.lit(".c")).alias("path"), F.col("code").alias("text"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _blobs(spark, d).select("version", F.concat(F.lit("f_"), F.regexp_replace("path", r"\.c$", "")).alias("name"))


def definitions_at_version(spark: SparkSession, d: str) -> DataFrame:
    return versions.definitions_at(_blobs(spark, d), _names(spark, d)).select("version", "name", "path", "line_no", "kind", "line")


DEFINITIONS_AT_VERSION = """
SELECT DISTINCT 'v' || user_id % 3 AS version, 'f_' || user_id AS name, user_id || '.c' AS path, CAST(1 AS INTEGER) AS line_no, 'function' AS kind, 'int f_' || user_id || '(int x)' AS line FROM events
"""


def symbol_code_at_version(spark: SparkSession, d: str) -> DataFrame:
    found = versions.symbol_code(versions.symbols_at(_blobs(spark, d)), _names(spark, d))
    return found.select("version", "name", "path", "kind", "start_line", "end_line", F.length("code").alias("n_chars"), F.md5("code").alias("code_md5"))


SYMBOL_CODE_AT_VERSION = f"""
SELECT 'v' || CAST(func_id AS BIGINT) % 3 AS version, 'f_' || func_id AS name, func_id || '.c' AS path, 'function' AS kind, CAST(1 AS INTEGER) AS start_line, CAST(len(string_split(code, chr(10))) - 1 AS INTEGER) AS end_line,
  CAST(length(code) - 1 AS INTEGER) AS n_chars, md5(code[1:length(code) - 1]) AS code_md5 FROM {_FUNCTIONS}
"""


def callers_at_version(spark: SparkSession, d: str) -> DataFrame:
    """Who calls a name at every version, the first ten calls."""
    blobs = _blobs(spark, d)
    names = blobs.select("version", F.explode(F.array(F.lit("read_v"), F.lit("use"), F.lit("if"))).alias("name")).distinct()
    return versions.callers_at(blobs, versions.symbols_at(blobs), names)


CALLERS_AT_VERSION = f"""
WITH l AS (SELECT 'v' || CAST(func_id AS BIGINT) % 3 AS version, func_id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS n FROM {_FUNCTIONS})
SELECT version, 'read_v' AS name, func_id || '.c' AS path, 'f_' || func_id AS caller, CAST(n AS INTEGER) AS line_no, trim(line) AS line FROM l WHERE contains(line, 'read_v(')
QUALIFY row_number() OVER (PARTITION BY version ORDER BY func_id || '.c', n) <= 10
"""


def diff_sides(spark: SparkSession, d: str) -> DataFrame:
    """How many different lines each diff deletes and adds, and how many are in both."""
    rows = _diffs(spark, d).select("diff_id", diff_side(F.col("diff"), "-").alias("m"), diff_side(F.col("diff"), "+").alias("p"))
    return rows.select("diff_id", F.size("m").alias("n_deleted"), F.size("p").alias("n_added"), F.size(F.array_intersect("m", "p")).alias("n_both"))


DIFF_SIDES = f"""
WITH l AS (SELECT DISTINCT diff_id, x[1] AS sign, trim(x[2:]) AS x FROM (SELECT diff_id, unnest(string_split(diff, chr(10))) AS x FROM {_DIFFS}) WHERE x[1] IN ('-', '+') AND NOT starts_with(x, '---') AND NOT starts_with(x, '+++') AND trim(x[2:]) <> '')
SELECT d.diff_id, CAST(count(x) FILTER (sign = '-') AS INTEGER) AS n_deleted, CAST(count(x) FILTER (sign = '+') AS INTEGER) AS n_added, CAST(count(x) - count(DISTINCT x) AS INTEGER) AS n_both
FROM {_DIFFS} d LEFT JOIN l ON l.diff_id = d.diff_id GROUP BY 1
"""


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """The diffs of a dialogue as patches of one commit: a turn's role is its file."""
    rows = _diffs(spark, d)
    conv, turn = (F.col("diff_id") / 100000).cast("long"), F.col("diff_id") % 100000
    return rows.select(conv.cast("string").alias("commit"), turn.cast("string").alias("id"), F.concat(F.lit("file"), (turn % 2).cast("string")).alias("file"), F.concat(F.lit("f"), (turn % 3).cast("string")).alias("func"), "diff")


def commit_hunks(spark: SparkSession, d: str) -> DataFrame:
    return grouping.hunks(_patches(spark, d)).select("commit", "id", "at", F.length("diff").alias("n_chars"))


COMMIT_HUNKS = f"""
WITH l AS (SELECT diff_id, unnest(string_split(diff, chr(10))) AS x, generate_subscripts(string_split(diff, chr(10)), 1) AS i FROM {_DIFFS}),
h AS (SELECT *, sum(CASE WHEN starts_with(x, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS h FROM l),
m AS (SELECT diff_id // 100000 AS c, diff_id % 100000 AS p, min(i) - 1 AS k, sum(length(x)) + count(*) - 1 AS n FROM h GROUP BY diff_id, h)
SELECT CAST(c AS VARCHAR) AS "commit", p || '#' || k AS id, CAST(k AS INTEGER) AS "at", CAST(n AS INTEGER) AS n_chars FROM m
"""


def commit_groups(spark: SparkSession, d: str) -> DataFrame:
    """The patches of every dialogue in groups, and those cut by their hunks."""
    patches = _patches(spark, d)
    groups = storage.materialize(grouping.function_groups(patches))
    return grouping.hunk_groups(patches, groups).select("commit", "part", "group_no", "hunk_group", "id", F.length("diff").alias("n_chars"))


def unified_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a new version of the turn before, as a unified diff, walked line by line again."""
    both = turn_pairs(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))
    start = (100 * F.col("turn") + 1).cast("int")
    pairs = both.select((F.col("conv_id") * 100000 + F.col("turn")).alias("pair_id"), F.col("role").alias("name"), F.col("text").alias("old"), F.col("next_text").alias("new"), start.alias("old_start"), start.alias("new_start"))
    made = diffs.unified(pairs).where("diff is not null")
    return diffs.hunk_lines(made, "pair_id", "diff").groupBy("diff_id", "sign").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("sign") == "-", F.col("old_no")).otherwise(F.col("new_no"))).alias("first"))


def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, numbered as in a slice, as a piece of evidence."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.concat(F.format_string("[%4d] ", s["line_no"]), s["line"])), "\n")
    made = rows.groupBy("unit_id").agg(text.alias("text")).select(F.col("unit_id").cast("string").alias("func"), F.lit("pre").alias("version"), "text")
    return slices.evidence(made).select("evidence_id", "line_no", F.length("code").alias("n_chars"))


EVIDENCE_IDS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id || ':pre:' || n AS evidence_id, CAST(n AS INTEGER) AS line_no, CAST(length(regexp_replace(rtrim(line), '^\\s+', '')) AS INTEGER) AS n_chars FROM l
"""


def consistency(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates whose lines are anchors."""
    return slices.consistency(table(spark, d, "lineitem").selectExpr("l_orderkey AS candidate", "l_linestatus = 'F' AS is_optional", "l_quantity > 10 AS is_mapped", "l_discount < 0.09 AS causality"))


CONSISTENCY = """
SELECT l_orderkey AS candidate, CASE WHEN bool_and(l_linestatus = 'F' OR l_quantity > 10) AND bool_and(l_discount < 0.09) THEN 'PROCEED' ELSE 'SAFE' END AS decision FROM lineitem GROUP BY 1
"""


def findings_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of returned lines as findings, with the nation and balance of those in debt, UNKNOWN for the others."""
    findings = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    runs = table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey", "s_name", "s_nationkey")
    return storage.with_metadata(findings, runs, "s_suppkey", "s_name", "s_nationkey")


FINDINGS_METADATA = """
SELECT f.s_suppkey, coalesce(s_name, 'UNKNOWN') AS s_name, coalesce(CAST(s_nationkey AS VARCHAR), 'UNKNOWN') AS s_nationkey
FROM (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_returnflag = 'R') f LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal < 0) USING (s_suppkey)
"""

QUERIES = {
    f.__name__: f
    for f in (
        changed_files, definitions_at_version, symbol_code_at_version, callers_at_version, diff_sides, commit_hunks, commit_groups, unified_diffs, evidence_ids, consistency, findings_metadata,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
