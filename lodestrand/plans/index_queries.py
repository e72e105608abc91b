"""Queries over the token index, symbol lookups, line searches and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import ASCII_WORD, DROPPED_MARKS, SPACE_CHARS, STOPWORDS, WORD_CHARS, line_tokens, squeezed
from lodestrand.operators import lookup, ranges, search
from lodestrand.plans import storage
from lodestrand.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = rf"""
raw AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM src),
whole AS (SELECT id, t FROM raw WHERE length(t) >= 3 AND regexp_matches(t, '[a-zA-Z]') AND lower(t) NOT IN ({_STOP})),
camel AS (SELECT id, regexp_extract_all(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+') AS p FROM whole),
part AS (SELECT id, unnest(string_split(t, '_')) AS t FROM whole UNION SELECT id, unnest(p) FROM camel WHERE len(p) > 1),
tok AS (SELECT id, t FROM whole UNION SELECT id, t FROM part WHERE length(t) >= 3 AND regexp_matches(t, '[a-zA-Z]') AND lower(t) NOT IN ({_STOP}))
"""


def _tokens(source: str, name: str) -> str:
    """The token rows of a table, as common table expressions with a suffix."""
    text = _TOKENS
    for n in ("raw", "whole", "camel", "part", "tok", "src"):
        text = text.replace(f" {n} ", f" {n}_{name} ").replace(f"\n{n} AS", f"\n{n}_{name} AS").replace(f"FROM {n})", f"FROM {n}_{name})").replace(f"FROM {n},", f"FROM {n}_{name},")
    return f"src_{name} AS ({source}),{text}"


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all documents, from the session's index."""

    def make() -> tuple[DataFrame, DataFrame]:
        units = table(spark, d, "documents")
        return units.select(F.col("doc_id").alias("unit_id"), F.col("source").alias("path")), search.postings(units, "doc_id", "text", ASCII_WORD)

    return storage.session_index(spark, f"{d}/documents", make)[1]


def token_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 documents that share most tokens with the first benchmark passage."""
    passages = table(spark, d, "benchmark")
    first = passages.join(passages.agg(F.min("item_id").alias("item_id")), "item_id")
    found = search.hits(document_postings(spark, d), search.query_tokens(first, "item_id", "text", ASCII_WORD, cap=10_000))
    return found.orderBy(F.col("hit_count").desc(), "unit_id").limit(20).select("unit_id", "hit_count")


TOKEN_TOPK = f"""
WITH {_tokens('SELECT doc_id AS id, text FROM documents', 'd')}, {_tokens('SELECT item_id AS id, text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)', 'q')}
SELECT d.id AS unit_id, count(*) AS hit_count FROM tok_d d JOIN tok_q q USING (t) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
"""


def token_search_batch(spark: SparkSession, d: str) -> DataFrame:
    """For every benchmark passage the 10 documents that share most of its 30 longest tokens."""
    found = search.hits(document_postings(spark, d), search.query_tokens(table(spark, d, "benchmark"), "item_id", "text", ASCII_WORD))
    return search.top_hits(found, 10).select("query_id", "unit_id", "hit_count", "place")


TOKEN_SEARCH_BATCH = f"""
WITH {_tokens('SELECT doc_id AS id, text FROM documents', 'd')}, {_tokens('SELECT item_id AS id, text FROM benchmark', 'q')},
capped AS (SELECT id, t FROM tok_q QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(t) DESC, t) <= 30),
hit AS (SELECT q.id AS query_id, d.id AS unit_id, count(*) AS hit_count FROM tok_d d JOIN capped q USING (t) GROUP BY 1, 2)
SELECT query_id, unit_id, hit_count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, unit_id) AS INTEGER) AS place
FROM hit QUALIFY place <= 10
"""


def token_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have each token."""
    return search.document_frequency(document_postings(spark, d))


TOKEN_DF = f"WITH {_tokens('SELECT doc_id AS id, text FROM documents', 'd')} SELECT t AS token, count(*) AS df FROM tok_d GROUP BY 1"


def symbol_lookup_limited(spark: SparkSession, d: str) -> DataFrame:
    """At most five parts for each brand, as symbols of one name."""
    parts = table(spark, d, "part").select("p_brand", "p_name", "p_partkey")
    names = parts.select(F.concat(F.lit("struct "), "p_brand").alias("name")).distinct()
    return lookup.definitions(parts, names, "p_brand", ["p_name", "p_partkey"]).select("p_brand", "p_name", "p_partkey", "place")


SYMBOL_LOOKUP = """
SELECT p_brand, p_name, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 5
"""


def list_in_path(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each wanted address; addresses without a page fall back to pages they end with."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    short = pages.select("page_id", F.regexp_extract("path", r"^https?://(.*)$", 1).alias("path"))
    wanted = pages.select(F.col("path").alias("wanted")).union(short.select("path")).distinct()
    return lookup.in_path(short, wanted, "path").select("wanted", "page_id", "path", "how")


LIST_IN_PATH = r"""
WITH pg AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
short AS (SELECT page_id, regexp_extract(path, '^https?://(.*)$', 1) AS path FROM pg),
wanted AS (SELECT path AS wanted FROM pg UNION SELECT path FROM short),
exact AS (SELECT wanted, page_id, path FROM short JOIN wanted ON path = wanted)
SELECT wanted, page_id, path, 'exact' AS how FROM exact
UNION ALL
SELECT w.wanted, s.page_id, s.path, 'suffix' FROM wanted w JOIN short s ON ends_with(w.wanted, s.path) WHERE w.wanted NOT IN (SELECT path FROM short) AND s.path <> ''
"""


def caller_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that mention a symbol."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text")
    return lookup.caller_lines(rows, "heron")


CALLER_LINES = """
WITH l AS (SELECT doc_id AS unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT unit_id, CAST(n AS INTEGER) AS line_no, line FROM l WHERE contains(line, 'heron') AND NOT regexp_matches(trim(line), '^(//|/[*]|[*]|#)')
"""


def grep_word_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty lines that hold a word."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text")
    return lookup.grep_page(rows, "that", 20, 20).select("unit_id", "line_no", "place", "total", "has_more")


GREP_WORD_PAGE = r"""
WITH l AS (SELECT doc_id AS unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
hit AS (SELECT unit_id, CAST(n AS INTEGER) AS line_no, row_number() OVER (ORDER BY unit_id, n) AS place, count(*) OVER () AS total FROM l WHERE regexp_matches(line, '\bthat\b'))
SELECT unit_id, line_no, CAST(place AS INTEGER) AS place, total, total > 40 AS has_more FROM hit WHERE place > 20 AND place <= 40
"""


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Two lines before and after every line that mentions a symbol, numbered, the line itself marked."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text")
    at = lookup.caller_lines(rows, "heron").select("unit_id", F.col("line_no").alias("at"))
    return lookup.context_windows(rows, at, 2, 2)


CONTEXT_WINDOWS = """
WITH l AS (SELECT doc_id AS unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
hit AS (SELECT unit_id, n AS at_ FROM l WHERE contains(line, 'heron') AND NOT regexp_matches(trim(line), '^(//|/[*]|[*]|#)'))
SELECT l.unit_id, CAST(at_ AS INTEGER) AS at, CAST(n AS INTEGER) AS line_no, CASE WHEN n = at_ THEN '>> ' ELSE '   ' END || '[' || lpad(CAST(n AS VARCHAR), 4, ' ') || '] ' || line AS text
FROM l JOIN hit ON l.unit_id = hit.unit_id AND n BETWEEN at_ - 2 AND at_ + 2
"""


def definition_ranking(spark: SparkSession, d: str) -> DataFrame:
    """For every fiftieth page the ten pages whose addresses are closest."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    context = pages.where("page_id % 50 = 0").select(F.col("page_id").alias("context_id"), F.col("path").alias("context_path"))
    return lookup.closest_paths(pages, context, "context_id", "page_id", 10)


DEFINITION_RANKING = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
c AS (SELECT page_id AS context_id, path AS context FROM p WHERE page_id % 50 = 0),
b AS (SELECT context_id, page_id, path, context, regexp_replace(path, '/[^/]*$', '') AS d1, regexp_replace(context, '/[^/]*$', '') AS d2,
             regexp_extract(path, '([^/.]*)[^/]*$', 1) AS s1, regexp_extract(context, '([^/.]*)[^/]*$', 1) AS s2 FROM p, c WHERE page_id <> context_id)
SELECT context_id, page_id, CASE WHEN path = context THEN 100 WHEN d1 = d2 THEN 50 WHEN s1 = s2 THEN 40 ELSE 0 END AS score,
       CASE WHEN path = context THEN 0 WHEN d1 = d2 THEN 1 ELSE 2 END AS distance, CAST(row_number() OVER (PARTITION BY context_id ORDER BY score DESC, distance, page_id) AS INTEGER) AS place FROM b
QUALIFY place <= 10
"""


def enclosing_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Clicks inside the span that a user's signup opens and the next error of that user closes."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    starts = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("s"))
    ends = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("e"))
    spans = starts.join(ends, "user_id", "left").groupBy("user_id", "span_id", "s").agg(F.min(F.when(F.col("e") > F.col("s"), F.col("e"))).alias("e"))
    spans = spans.select("user_id", "s", "e", F.col("span_id").cast("string").alias("name"))
    return ranges.enclosing(events.where("event_type = 'click'"), spans, "user_id", "ts", "s", "e", "name").select("event_id", "enclosing")


ENCLOSING = """
WITH st AS (SELECT user_id, event_id AS span_id, ts AS s FROM events WHERE event_type = 'signup'),
sp AS (SELECT st.*, (SELECT min(ts) FROM events x WHERE x.user_id = st.user_id AND x.event_type = 'error' AND x.ts > st.s) AS e FROM st),
m AS (SELECT c.event_id, arg_max(span_id, s) AS n, max(s) AS s, any_value(c.ts) AS ts FROM events c
      LEFT JOIN sp ON sp.user_id = c.user_id AND sp.s <= c.ts AND (sp.e IS NULL OR c.ts <= sp.e) WHERE c.event_type = 'click' GROUP BY 1)
SELECT event_id, coalesce(CAST(n AS VARCHAR), 'unknown') AS enclosing FROM m WHERE s IS NULL OR s < ts
"""


def latest_start(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with the user's last signup before it: the as-of join."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    found = ranges.latest(events.where("event_type = 'purchase'"), events.where("event_type = 'signup'"), "user_id", "ts", "event_id")
    return found.select("event_id", "enclosing")


LATEST_START = """
SELECT p.event_id, coalesce(CAST(s.event_id AS VARCHAR), 'unknown') AS enclosing
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts > s.ts
"""


def benchmark_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Turns by dialogue and role under a composite name, at most twenty for each."""
    turns = table(spark, d, "conversations").select("conv_id", "role", "turn", F.concat_ws(":", "role", "turn", "conv_id").alias("name"), F.length("text").alias("size"))
    names = turns.select(F.concat_ws(":", "conv_id", "role").alias("name")).distinct()
    keyed = turns.withColumn("key", F.concat_ws(":", "conv_id", "role"))
    return lookup.definitions(keyed, names, "key", ["turn"], 20).select("conv_id", "role", "name", "size")


BENCHMARK_LOOKUP = """
SELECT conv_id, role, role || ':' || turn || ':' || conv_id AS name, CAST(length(text) AS INTEGER) AS size FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= 20
"""


def changed_units(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as the new version of the turn before it: added, or changed once white space is gone."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    old = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    both = turns.join(old, ["conv_id", "turn"], "left")
    kind = F.when(F.col("old").isNull(), "ADDED").otherwise("MODIFIED")
    return both.where(F.col("old").isNull() | (squeezed(F.col("text")) != squeezed(F.col("old")))).select("conv_id", "turn", kind.alias("change_type"))


CHANGED_UNITS = r"""
SELECT n.conv_id, n.turn, CASE WHEN o.text IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS change_type
FROM conversations n LEFT JOIN conversations o ON o.conv_id = n.conv_id AND o.turn + 1 = n.turn
WHERE o.text IS NULL OR regexp_replace(n.text, '\s+', '', 'g') <> regexp_replace(o.text, '\s+', '', 'g')
"""


def line_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many line tokens every turn has, and the first and last of them."""
    made = table(spark, d, "conversations").select("conv_id", "turn", line_tokens(F.col("text")).alias("_t"))
    return made.select("conv_id", "turn", F.size("_t").alias("n_tokens"), F.get("_t", F.lit(0)).alias("first"), F.get("_t", F.size("_t") - 1).alias("last"))


_DROPPED = ", ".join(f"'{m}'" for m in DROPPED_MARKS)
LINE_TOKEN_COUNTS = rf"""
WITH bare AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '^\[\s*\d+\]', ''), '//[^\n]*', '', 'g'), '/\*[^\n]*?\*/', '', 'g') AS t FROM conversations),
raw AS (SELECT conv_id, turn, unnest(r) AS t, generate_subscripts(r, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(t, '->|[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CHARS}]') AS r FROM bare)),
part AS (SELECT conv_id, turn, i, unnest(p) AS p, generate_subscripts(p, 1) AS j FROM (SELECT conv_id, turn, i, CASE WHEN regexp_matches(t, '^[{WORD_CHARS}]') THEN list_filter(string_split(t, '_'), lambda x: x <> '') ELSE [t] END AS p FROM raw)),
piece AS (SELECT conv_id, turn, i, j, CASE WHEN regexp_matches(p, '[A-Za-z]|\p{{Nd}}') THEN regexp_extract_all(regexp_replace(p, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\p{{Nd}}+') ELSE [p] END AS q FROM part),
tok AS (SELECT * FROM (SELECT conv_id, turn, i, j, lower(unnest(q)) AS t, generate_subscripts(q, 1) AS k FROM piece) WHERE t NOT IN ({_DROPPED}))
SELECT conv_id, turn, CAST(count(t) AS INTEGER) AS n_tokens, arg_min(t, (i, j, k)) AS first, arg_max(t, (i, j, k)) AS last FROM conversations LEFT JOIN tok USING (conv_id, turn) GROUP BY 1, 2
"""


def grep_regex_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of thirty lines that a regular expression matches."""
    rows = lookup.lines(table(spark, d, "documents"), "doc_id", "text")
    return lookup.grep_page(rows, r"[a-z]+tion[,.]", 0, 30, "regex").select("unit_id", "line_no", "method", "place", "total", F.coalesce("next_cursor", F.lit(-1)).alias("next_cursor"))


GREP_REGEX_PAGE = r"""
WITH l AS (SELECT doc_id AS unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
hit AS (SELECT unit_id, CAST(n AS INTEGER) AS line_no, row_number() OVER (ORDER BY unit_id, n) AS place, count(*) OVER () AS total FROM l WHERE regexp_matches(line, '[a-z]+tion[,.]'))
SELECT unit_id, line_no, 'regex_match' AS method, CAST(place AS INTEGER) AS place, total, CASE WHEN total > 30 THEN 30 ELSE -1 END AS next_cursor FROM hit WHERE place <= 30
"""


QUERIES = {
    "token_topk": token_topk,
    "token_search_batch": token_search_batch,
    "token_document_frequency": token_document_frequency,
    "symbol_lookup_limited": symbol_lookup_limited,
    "list_in_path": list_in_path,
    "caller_lines": caller_lines,
    "grep_word_page": grep_word_page,
    "context_windows": context_windows,
    "definition_ranking": definition_ranking,
    "enclosing_range_join": enclosing_range_join,
    "latest_start_asof": latest_start,
    "benchmark_lookup": benchmark_lookup,
    "changed_units": changed_units,
    "line_token_counts": line_token_counts,
    "grep_regex_page": grep_regex_page,
}
SQL = {
    "token_topk": TOKEN_TOPK,
    "token_search_batch": TOKEN_SEARCH_BATCH,
    "token_document_frequency": TOKEN_DF,
    "symbol_lookup_limited": SYMBOL_LOOKUP,
    "list_in_path": LIST_IN_PATH,
    "caller_lines": CALLER_LINES,
    "grep_word_page": GREP_WORD_PAGE,
    "context_windows": CONTEXT_WINDOWS,
    "definition_ranking": DEFINITION_RANKING,
    "enclosing_range_join": ENCLOSING,
    "latest_start_asof": LATEST_START,
    "benchmark_lookup": BENCHMARK_LOOKUP,
    "changed_units": CHANGED_UNITS,
    "line_token_counts": LINE_TOKEN_COUNTS,
    "grep_regex_page": GREP_REGEX_PAGE,
}
