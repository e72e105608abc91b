"""Queries over anchors, evidence and C functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import cfg, graphs, lookup, mapping, validate
from lodestrand.plans import matching
from lodestrand.plans.literals import frame, values_sql
from lodestrand.sources import csource
from lodestrand.sources.tables import table

#: What every kind of event is as a statement of C.
STATEMENTS = (("signup", "  x = read_v();"), ("click", "  y = x + 1;"), ("purchase", "  if (y > 2)\n    z = y;"), ("error", "  if (!x)\n    return -1;"), ("view", "  use(z);"))
_STATEMENTS = values_sql(list(STATEMENTS), "event_type, code")
_FUNCTIONS = f"""(SELECT CAST(user_id AS VARCHAR) AS func_id, 'int f_' || user_id || '(int x)' || chr(10) || '{{' || chr(10) || '  int y = 0, z = 0;' || chr(10) || string_agg(code, chr(10) ORDER BY ts, event_id) || chr(10) || '  return z;' || chr(10) || '}}' || chr(10) AS code
  FROM events JOIN (SELECT * FROM {_STATEMENTS}) USING (event_type) GROUP BY user_id)"""


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, code): every user as a C function with a statement for each of the user's events, in order."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type").join(frame(spark, list(STATEMENTS), "event_type string, code string"), "event_type")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "code"))), lambda s: s["code"]), "\n")
    made = events.groupBy("user_id").agg(body.alias("_b")).withColumn("func_id", F.col("user_id").cast("string"))
    return made.select("func_id", F.concat(F.lit("int f_"), "func_id", F.lit("(int x)\n{\n  int y = 0, z = 0;\n"), "_b", F.lit("\n  return z;\n}\n")).alias("code"))


def c_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of one file for each user, with the lines they span."""
    files = _functions(spark, d).select(F.concat("func_id", F.lit(".c")).alias("path"), F.col("code").alias("text"))
    return csource.functions(files).select("path", "kind", "name", "start_line", "end_line")


C_SYMBOLS = f"SELECT func_id || '.c' AS path, 'function' AS kind, 'f_' || func_id AS name, CAST(1 AS INTEGER) AS start_line, CAST(len(string_split(code, chr(10))) - 1 AS INTEGER) AS end_line FROM {_FUNCTIONS}"


def c_flow(spark: SparkSession, d: str) -> DataFrame:
    return cfg.program_graphs(_functions(spark, d))[1]


#: Statements lead to the next one, a condition also past what it guards, a return to the end.
C_FLOW = f"""
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS func_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
part AS (SELECT func_id, 0 AS i, 0 AS k, 'plain' AS kind FROM ev GROUP BY 1
  UNION ALL SELECT func_id, i, 0, CASE WHEN event_type IN ('purchase', 'error') THEN 'test' ELSE 'plain' END FROM ev
  UNION ALL SELECT func_id, i, 1, CASE event_type WHEN 'error' THEN 'leave' ELSE 'plain' END FROM ev WHERE event_type IN ('purchase', 'error')
  UNION ALL SELECT func_id, max(i) + 1, 0, 'leave' FROM ev GROUP BY 1),
num AS (SELECT *, row_number() OVER (PARTITION BY func_id ORDER BY i, k) AS n FROM part),
nx AS (SELECT *, min(n) FILTER (k = 0) OVER (PARTITION BY func_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM num)
SELECT func_id, 'ENTRY' AS src, 'n1' AS dst FROM nx WHERE n = 1
UNION SELECT func_id, 'n' || n, 'n' || (n + 1) FROM nx WHERE kind = 'test'
UNION SELECT func_id, 'n' || n, 'n' || after FROM nx WHERE kind <> 'leave'
UNION SELECT func_id, 'n' || n, 'EXIT' FROM nx WHERE kind = 'leave'
"""


def c_dependence(spark: SparkSession, d: str) -> DataFrame:
    return cfg.dependence(_functions(spark, d))


def c_slices(spark: SparkSession, d: str) -> DataFrame:
    """What decides the last statement of each function: its backward slice."""
    nodes, _, _ = cfg.program_graphs(_functions(spark, d))
    last = nodes.where("node like 'n%'").groupBy("func_id").agg(F.max_by("node", F.struct("line", F.length("node"), "node")).alias("node"))
    return graphs.slice_nodes(cfg.dependence(_functions(spark, d)), last.withColumn("vars", F.array().cast("array<string>")))


def located_anchors(spark: SparkSession, d: str) -> DataFrame:
    """First words of every document's second line as anchors, tried on lines 1 and 2."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text")
    second = rows.where("line_no = 2").select("unit_id", F.substring("line", 1, 12).alias("snippet"))
    tried = second.withColumn("line_no", F.explode(F.array(F.lit(1), F.lit(2))))
    return validate.located_anchors(tried, rows).select("unit_id", "line_no", "snippet")


LOCATED_ANCHORS = r"""
WITH l AS (SELECT * FROM (SELECT doc_id AS unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
t AS (SELECT unit_id, substr(line, 1, 12) AS snippet, k FROM l, (VALUES (1), (2)) AS v(k) WHERE n = 2),
b AS (SELECT t.unit_id, t.k, t.snippet, regexp_replace(t.snippet, '\s+', '', 'g') AS x, regexp_replace(l.line, '\s+', '', 'g') AS y FROM t JOIN l ON l.unit_id = t.unit_id AND l.n = t.k)
SELECT unit_id, k AS line_no, snippet FROM b WHERE x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x))
"""


def duplicate_types(spark: SparkSession, d: str) -> DataFrame:
    """Event types that a user has more often than the ten expected of clicks and the one of all others."""
    events = table(spark, d, "events").select(F.col("user_id").alias("unit_id"), F.col("event_type").alias("type"))
    return validate.duplicate_types(events, frame(spark, [("click", 10)], "type string, wanted int"))


DUPLICATE_TYPES = """
SELECT user_id AS unit_id, event_type AS type, count(*) AS n, CAST(CASE event_type WHEN 'click' THEN 10 ELSE 1 END AS INTEGER) AS wanted FROM events GROUP BY 1, 2
HAVING count(*) > CASE event_type WHEN 'click' THEN 10 ELSE 1 END
"""


def hunk_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a dialogue as hunks, batched by a budget of characters."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("diff_id"), F.col("turn").cast("int").alias("hunk"), F.length("text").alias("n_chars"))
    return validate.batches(turns, budget=1200)


HUNK_BATCHES = """
WITH RECURSIVE h AS (SELECT conv_id AS diff_id, CAST(turn AS INTEGER) AS hunk, length(text) + 50 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT diff_id, hunk, i, n AS used, 0 AS batch FROM h WHERE i = 1
  UNION ALL SELECT h.diff_id, h.hunk, h.i, CASE WHEN w.used + h.n > 1200 THEN h.n ELSE w.used + h.n END, w.batch + CASE WHEN w.used + h.n > 1200 THEN 1 ELSE 0 END
  FROM w JOIN h ON h.diff_id = w.diff_id AND h.i = w.i + 1)
SELECT diff_id, hunk, CAST(batch AS INTEGER) AS batch FROM w
"""


def path_affinity(spark: SparkSession, d: str) -> DataFrame:
    """How much of the address of every fiftieth page each page shares."""
    pages = table(spark, d, "pages").select("page_id", "url")
    asked = pages.where("page_id % 50 = 0").select(F.col("page_id").alias("context_id"), F.col("url").alias("context"))
    return pages.join(asked, F.lit(True)).select("context_id", "page_id", F.round(validate.path_affinity(F.col("url"), F.col("context")), 6).alias("affinity"))


PATH_AFFINITY = """
WITH c AS (SELECT page_id AS context_id, url AS context FROM pages WHERE page_id % 50 = 0),
p AS (SELECT context_id, page_id, string_split(url, '/') AS x, string_split(context, '/') AS y FROM pages, c)
SELECT context_id, page_id, round(len(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i] AND i <= least(len(x), len(y)))) / greatest(len(x), len(y)), 6) AS affinity FROM p
"""

def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a search prints it; a fifth of them without a number."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text").join(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "source"), "unit_id")
    number = F.when(F.col("line_no") % 5 == 0, "none").otherwise(F.col("line_no").cast("string"))
    return validate.grep_lines(rows.select(F.concat_ws(":", F.lit("HEAD"), "source", number, "line").alias("raw"))).groupBy("tree", "path", "line_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars")
    )


GREP_LINES = r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
p AS (SELECT regexp_extract('HEAD:' || source || ':' || CASE WHEN n % 5 = 0 THEN 'none' ELSE CAST(n AS VARCHAR) END || ':' || line, '^([^:]*):([^:]*):([^:]*):(.*)$', ['tree', 'path', 'n', 'content']) AS r FROM l)
SELECT r.tree AS tree, r.path AS path, TRY_CAST(r.n AS INTEGER) AS line_no, count(*) AS n, CAST(sum(length(r.content)) AS BIGINT) AS n_chars FROM p WHERE TRY_CAST(r.n AS INTEGER) IS NOT NULL GROUP BY ALL
"""


def first_values(spark: SparkSession, d: str) -> DataFrame:
    """The first turn text and role that each dialogue has set."""
    turns = table(spark, d, "conversations")
    return turns.groupBy("conv_id").agg(validate.first_set("role", "turn").alias("role"), validate.first_set("text", "turn").alias("text"))


FIRST_VALUES = "SELECT conv_id, arg_min(role, turn) FILTER (role <> '') AS role, arg_min(text, turn) FILTER (text NOT IN ('', '0', '0.0')) AS text FROM conversations GROUP BY 1"

def _sentences(column: str):
    """A text with a line for each sentence."""
    return F.regexp_replace(column, r"\.[ \n]", ".\n")


def match_patches(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage as a patch, which takes its second sentence out and changes the end of the last one, looked
    for in all documents, with the first words of the passage as an anchor. The 20 nearest documents are judged."""
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("group_id"), _sentences("text").alias("pre"))
    cut = F.split("pre", "\n")
    post = F.concat_ws("\n", F.filter(cut, lambda x, i: i != 1), F.lit("and no more of it."))
    patches = passages.withColumn("post", post)
    anchors = passages.select("group_id", F.lit("pre").alias("side"), F.lit("opening").alias("anchor"), F.lit(1).alias("line_no"), F.substring(cut[0], 1, 40).alias("snippet"))
    units = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), _sentences("text").alias("code"))
    found = matching.match(patches, units, anchors, 20)
    return found.select("group_id", "unit_id", "verdict", F.round("confidence", 6).alias("confidence"), "rank")


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.summary(match_patches(spark, d))


def line_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's lines in the turn after it."""
    turns = table(spark, d, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("post"))
    return mapping.line_mapping(turns.join(later, ["conv_id", "turn"]).select(F.xxhash64("conv_id", "turn").alias("pair_id"), F.col("text").alias("pre"), "post"))


def typed_paths(spark: SparkSession, d: str) -> DataFrame:
    """From the first to the last node of each C function, along data and along control."""
    nodes, _, _ = cfg.program_graphs(_functions(spark, d))
    inner = nodes.where("node like 'n%'").groupBy("func_id")
    ends = inner.agg(F.min_by("node", F.struct("line", F.length("node"), "node")).alias("node")).withColumn("type", F.lit("source")).unionByName(inner.agg(F.max_by("node", F.struct("line", F.length("node"), "node")).alias("node")).withColumn("type", F.lit("sink")))
    links = frame(spark, [(0, "source", "sink", "data"), (1, "source", "sink", "control")], "pos int, source string, target string, dependency string")
    return mapping.typed_paths(cfg.dependence(_functions(spark, d)), ends, links)


QUERIES = {
    f.__name__: f
    for f in (
        c_symbols, c_flow, c_dependence, c_slices, located_anchors, duplicate_types, hunk_batches, path_affinity, grep_lines, first_values,
        match_patches, match_summary, line_mapping, typed_paths,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
