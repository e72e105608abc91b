"""Point lookups, greps and rankings over symbol and line tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import quoted


def definitions(symbols: DataFrame, names: DataFrame, name_col: str, order: list[str], most: int = 5) -> DataFrame:
    """At most `most` symbols of each wanted name; of a name with spaces only the last word counts."""
    wanted = names.select(F.element_at(F.split(F.col("name"), " "), -1).alias(name_col)).distinct()
    found = symbols.join(wanted, name_col, "left_semi")
    place = F.row_number().over(Window.partitionBy(name_col).orderBy(*order))
    return found.withColumn("place", place).where(F.col("place") <= most)


def body(symbols: DataFrame, names: DataFrame, name_col: str, order: list[str], path_col: str | None = None) -> DataFrame:
    """The first definition of each wanted name, of its path if names have one under path_col."""
    keys = [name_col, *([path_col] if path_col else [])]
    found = symbols.join(names.select(*keys).distinct(), keys, "left_semi")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def in_path(symbols: DataFrame, paths: DataFrame, path_col: str, kind: str | None = None) -> DataFrame:
    """Symbols of each wanted path, of one kind if it is given; where no path is equal, those whose path the wanted one
    ends with."""
    symbols = symbols.where(F.col("kind") == kind) if kind else symbols
    exact = symbols.join(paths, symbols[path_col] == paths["wanted"])
    missing = paths.join(symbols.select(F.col(path_col).alias("_p")), F.col("wanted") == F.col("_p"), "left_anti")
    tails = missing.select("wanted", F.explode(F.transform(F.sequence(F.lit(1), F.length("wanted")), lambda i: F.substr(F.col("wanted"), i))).alias("_tail"))
    loose = symbols.join(tails, symbols[path_col] == tails["_tail"]).drop("_tail")
    return exact.withColumn("how", F.lit("exact")).unionByName(loose.withColumn("how", F.lit("suffix")))


def lines(units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(unit_id, line_no, line), lines from 1."""
    cut = units.select(F.col(id_col).alias("unit_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("_i", "line"))
    return cut.select("unit_id", (F.col("_i") + 1).alias("line_no"), "line")


def looks_like_comment(line: Column) -> Column:
    return F.trim(line).rlike(r"^(//|/\*|\*|#)")


def caller_lines(rows: DataFrame, symbol: str) -> DataFrame:
    """Lines that hold the symbol as it is written and do not look like comments; shorter symbols than three find none."""
    return rows.where(F.lit(len(symbol) >= 3) & F.col("line").contains(symbol) & ~looks_like_comment(F.col("line")))


def grep(rows: DataFrame, pattern: str, mode: str = "word", scope: tuple[int, int] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(unit_id, line_no, line, type, method) of the lines that a pattern matches.

    word: the pattern as it is written, between word boundaries of any script. regex: a regular expression; one that is
    none gives a single row of method "error" that says so. def_use: nodes (unit_id, line_no, code, defs, uses) of the
    scope that define or use the variable, where that finds none the whole word. scope: first and last line.
    """
    inside = F.col("line_no").between(*scope) if scope else F.lit(True)
    if mode == "regex":
        try:
            re.compile(pattern)
        except re.error as error:
            kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
            return rows.sparkSession.createDataFrame([(None, None, f"Invalid regex: {error}", "error", "error")], f"unit_id {kinds['unit_id']}, line_no {kinds['line_no']}, line string, type string, method string")
        hit, method = F.col("line").rlike(pattern), "regex_match"
    else:
        hit, method = F.col("line").rlike(rf"(?U)\b{quoted(pattern)}\b"), "word_match"
    text = rows.where(inside & hit).select("unit_id", "line_no", F.trim("line").alias("line"), F.lit("match").alias("type"), F.lit(method).alias("method"))
    if mode != "def_use" or nodes is None or not scope:
        return text
    defines = F.array_contains("defs", pattern)
    exact = nodes.where(inside & (defines | F.array_contains("uses", pattern))).select(
        "unit_id", "line_no", F.trim("code").alias("line"), F.when(defines, "def").otherwise("use").alias("type"), F.lit("precise_pdg").alias("method")
    )
    return exact.unionByName(text.join(exact.select("unit_id").distinct(), "unit_id", "left_anti"))


def page(hits: DataFrame, cursor: int, limit: int) -> DataFrame:
    """One page of hits in order, with the total, whether more follow and where they start.

    The total comes from an aggregate, and the page from a top-k, so no task sorts all hits.
    """
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    first = hits.orderBy("unit_id", "line_no").limit(cursor + limit)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy("unit_id", "line_no")))
    more = F.col("total") > cursor + limit
    return numbered.where(F.col("place") > cursor).join(total, F.lit(True)).withColumns({"has_more": more, "next_cursor": F.when(more, F.lit(cursor + limit))})


def grep_page(rows: DataFrame, word: str, cursor: int, limit: int, mode: str = "word") -> DataFrame:
    """One page of what grep() finds."""
    return page(grep(rows, word, mode), cursor, limit)


def enclosing_callers(callers: DataFrame, functions: DataFrame, most: int = 20) -> DataFrame:
    """Caller lines (unit_id, line_no, line) with the function around each, at most `most` functions for each unit, the
    first by line; a line outside all functions has the name "unknown", the line a function starts on goes.

    functions: unit_id, name, start_line, end_line, which do not overlap: the last start decides, in one sorted pass.
    """
    marks = functions.select("unit_id", F.col("start_line").alias("line_no"), F.struct("name", "start_line", "end_line").alias("_f"), F.lit(None).cast("string").alias("line"))
    both = callers.select("unit_id", "line_no", F.lit(None).cast(marks.schema["_f"].dataType).alias("_f"), "line").unionByName(marks)
    before = Window.partitionBy("unit_id").orderBy("line_no", F.col("_f").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_f", F.last("_f", True).over(before)).where("line is not null").where("_f is null or _f.start_line <> line_no")
    named = near.select("unit_id", "line_no", "line", F.when(F.col("_f.end_line") >= F.col("line_no"), F.col("_f.name")).otherwise("unknown").alias("caller"))
    first = F.min("line_no").over(Window.partitionBy("unit_id", "caller"))
    return named.withColumn("_first", first).withColumn("place", F.dense_rank().over(Window.partitionBy("unit_id").orderBy("_first"))).where(F.col("place") <= most).drop("_first")


def context_windows(rows: DataFrame, at: DataFrame, before: int, after: int) -> DataFrame:
    """Numbered lines around each place (unit_id, at): the place's own line is marked."""
    wanted = at.select("unit_id", "at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - before), F.col("at") + after)).alias("line_no"))
    return _marked(rows, wanted)


def symbol_context(rows: DataFrame, at: DataFrame, symbols: DataFrame, reach: int = 10, most: int = 50) -> DataFrame:
    """Numbered lines around each place (unit_id, at): the whole symbol (unit_id, start_line, end_line) that starts on the
    line and ends within `most` lines, else `reach` lines on both sides."""
    own = symbols.select("unit_id", F.col("start_line").alias("at"), "end_line").where(F.col("end_line") - F.col("at") < most).groupBy("unit_id", "at").agg(F.max("end_line").alias("end_line"))
    near = at.select("unit_id", "at").join(own, ["unit_id", "at"], "left")
    first = F.when(F.col("end_line").isNull(), F.greatest(F.lit(1), F.col("at") - reach)).otherwise(F.col("at"))
    wanted = near.select("unit_id", "at", F.explode(F.sequence(first, F.coalesce("end_line", F.col("at") + reach))).alias("line_no"))
    return _marked(rows, wanted)


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    mark = F.when(F.col("line_no") == F.col("at"), ">> ").otherwise("   ")
    return rows.join(wanted, ["unit_id", "line_no"]).select("unit_id", "at", "line_no", F.concat(mark, F.format_string("[%4d] %s", "line_no", "line")).alias("text"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def closeness(path: Column, context: Column) -> Column:
    """100 for the same file, 50 for its directory, 40 for its basename's stem, else 0."""
    return F.when(path == context, 100).when(_directory(path) == _directory(context), 50).when(_stem(path) == _stem(context), 40).otherwise(0)


def caller_distance(path: Column, context: Column) -> Column:
    """0 for the same file, 1 for its directory, else 2."""
    return F.when(path == context, 0).when(_directory(path) == _directory(context), 1).otherwise(2)


def closest(scored: DataFrame, context: str, item: str, most: int = 10) -> DataFrame:
    """The first `most` items of every context by score, then by distance, with their place."""
    order = Window.partitionBy(context).orderBy(F.col("score").desc(), "distance", item)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _keys(path: Column, other: Column) -> Column:
    """What a path can share with another, each under the score that it gives; `other` stands for nothing shared."""
    shared = {100: path, 50: _directory(path), 40: _stem(path), 0: other}
    return F.inline(F.array(*(F.struct(F.lit(score).alias("_score"), key.alias("_key")) for score, key in shared.items())))


def closest_paths(items: DataFrame, contexts: DataFrame, context: str, item: str, most: int = 10, salts: int = 64) -> DataFrame:
    """closest() of the items (item, path) to each of the contexts (context, context_path), without the pairs of all with
    all: context, item, score, distance, place. Items with the context's own id do not count.

    Among the items that share a path, a directory or a stem, and among all items, only the first `most` can be placed
    once the context's own id is left out: whatever scores higher comes before the others in any case. So each key keeps
    the rows of its `most` + 1 smallest ids, `most` rows of an id that repeats. Contexts meet those by key, and a pair
    counts under the key that gives its score. Lists are cut before they are shuffled; contexts meet that of all items
    by salt.
    """
    rows = items.where(F.col(item).isNotNull()).select(item, "path")
    within = Window.partitionBy("_score", "_key", item).orderBy("path")
    across = Window.partitionBy("_score", "_key").orderBy(item)
    keyed = rows.select(item, "path", _keys(F.col("path"), F.lit(None).cast("string"))).where("_key is not null")
    keyed = keyed.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= most)
    keyed = keyed.withColumn("_n", F.dense_rank().over(across)).where(F.col("_n") <= most + 1)
    least = rows.select(item).distinct().orderBy(item).limit(most + 1)
    first = rows.join(least, item).withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy("path"))).where(F.col("_n") <= most)
    first = first.withColumn("_score", F.lit(0)).withColumn("_key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<string>")))
    salt = F.pmod(F.xxhash64(context), F.lit(salts)).cast("string")
    wanted = contexts.select(context, "context_path", _keys(F.col("context_path"), salt))
    columns = [item, "path", "_score", "_key"]
    met = wanted.join(keyed.select(columns).unionByName(first.select(columns)), ["_score", "_key"]).where(F.col(context) != F.col(item))
    path, other = F.col("path"), F.col("context_path")
    scored = met.where(closeness(path, other) == F.col("_score")).select(context, item, F.col("_score").alias("score"), caller_distance(path, other).alias("distance"))
    return closest(scored, context, item, most)
