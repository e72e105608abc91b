"""Files, definitions and callers at a version, over tables of file contents.

A repository's history is two tables: blobs(version, path, text), one row for each file of a version (a commit or a
tag), and commits(version, parent, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import normalised
from lodestrand.operators.lookup import lines
from lodestrand.operators.validate import latest_of
from lodestrand.sources.csource import functions

SOURCE = r"\.(c|h|cpp|hpp)$"
#: A name's callers and a symbol's definitions are listed up to these many.
MOST_CALLERS = 10


def changed_files(blobs: DataFrame, commits: DataFrame, suffix: str = r"\.(c|h|cpp|cc|cxx|hpp)$") -> DataFrame:
    """(version, path, old_text, new_text) of the source files that differ between a commit and its parent, added and
    deleted ones included. A text is null where the file is not there.

    Both versions of a path are brought together by one aggregation on (commit, path), not by a full outer join.
    """
    asked = commits.where("parent is not null").select(F.col("version").alias("commit"), "parent")
    files = blobs.where(F.col("path").rlike(suffix))
    new = files.join(asked, F.col("version") == F.col("commit")).select("commit", "path", F.lit(1).alias("side"), "text")
    old = files.join(asked, F.col("version") == F.col("parent")).select("commit", "path", F.lit(0).alias("side"), "text")
    both = old.unionByName(new).groupBy("commit", "path").agg(*(F.max(F.when(F.col("side") == i, F.col("text"))).alias(n) for i, n in enumerate(("old_text", "new_text"))))
    return both.where(~F.col("old_text").eqNullSafe(F.col("new_text"))).withColumnRenamed("commit", "version")


def content_at(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (version, path) with the file's text, empty where there is none."""
    return wanted.join(blobs.select("version", "path", "text"), ["version", "path"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def messages(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (version) with the commit's message, trimmed, empty where there is none."""
    return wanted.join(commits.select("version", "message"), "version", "left").withColumn("message", F.regexp_replace(F.coalesce("message", F.lit("")), r"^\s+|\s+$", ""))


def symbols_at(blobs: DataFrame) -> DataFrame:
    """(version, path, kind, name, start_line, end_line, code) of every file at every version.

    Equal contents, most files of most versions, are scanned once.
    """
    keyed = blobs.where(F.col("path").rlike(SOURCE)).select("version", "path", F.sha2("text", 256).alias("blob"), "text")
    once = keyed.groupBy("blob").agg(F.first("text").alias("text"))
    return keyed.select("version", "path", "blob").join(functions(once, "blob", "text").withColumnRenamed("path", "blob"), "blob").drop("blob")


def functions_in(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Functions of the wanted (version, path), with their place in the file."""
    place = F.row_number().over(Window.partitionBy("version", "path").orderBy("start_line", "name"))
    return symbols.where("kind = 'function'").join(wanted, ["version", "path"], "left_semi").withColumn("place", place)


def symbol_code(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """The definition of each wanted (version, name): the first by path and line; functions before other kinds."""
    order = Window.partitionBy("version", "name").orderBy(F.col("kind") != "function", "path", "start_line")
    return symbols.join(wanted, ["version", "name"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def is_definition(kind: Column, line: Column, name: Column) -> Column:
    """Whether a line that was found for a name defines it.

    A macro's line is its #define. A structure's has its keyword right before the name. A function's has something in
    front of the name that assigns nothing and calls nothing, is no #define, and a name in capitals of four letters or
    more is not what the line starts with.
    """
    code, esc = F.trim(line), F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    macro = code.startswith("#define") & F.trim(F.substr(code, F.lit(8))).startswith(name)
    struct = F.rlike(code, F.concat(F.lit(r"\b(?:struct|union|enum)\s+"), esc, F.lit(r"\b")))
    before = F.call_function("substring_index", code, name, F.lit(1))
    called = F.rlike(code, F.concat(F.lit(r"\w+\s*\([^)]*"), esc))
    function = (
        F.rlike(code, F.concat(esc, F.lit(r" ?\("))) & ~code.startswith("#define") & ~code.startswith(name) & ~(before.contains("=") & ~F.ltrim(before).startswith("=")) & ~called
    )
    return F.when(kind == "macro", macro).when(kind == "struct", struct).when(kind == "function", function).otherwise(False)


def definitions_at(blobs: DataFrame, names: DataFrame) -> DataFrame:
    """(version, name, path, line_no, kind, line) of the lines that define one of names (version, name).

    Every line is looked at once: the names that it could define are cut out of it and joined with those wanted, so cost
    does not grow with names times lines.
    """
    numbered = _numbered(blobs.where(F.col("path").rlike(SOURCE)))
    head = F.regexp_extract("line", r"^(?:struct|union|enum)\s+(\w+)", 1)
    macro = F.regexp_extract("line", r"^#define\s+(\w+)\b", 1)
    code = F.trim("line")
    passed = ~code.endswith(";") & ~code.contains("if (") & ~code.contains("while (")
    calls = F.when(passed, F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b(\w+)\s*\(")))).otherwise(F.array().cast("array<string>"))
    named = F.concat(
        F.when(head != "", F.array(F.struct(F.lit("struct").alias("kind"), head.alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.when(macro != "", F.array(F.struct(F.lit("macro").alias("kind"), macro.alias("name")))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.transform(calls, lambda n: F.struct(F.lit("function").alias("kind"), n.alias("name"))),
    )
    found = numbered.select("version", "path", "line_no", "line", F.explode(named).alias("_d")).select("version", "path", "line_no", "line", "_d.*")
    return found.join(names.select("version", "name").distinct(), ["version", "name"]).where(is_definition(F.col("kind"), F.col("line"), F.col("name")))


def callers_at(blobs: DataFrame, symbols: DataFrame, names: DataFrame, most: int = MOST_CALLERS) -> DataFrame:
    """(version, name, path, caller, line_no, line): calls of names (version, name), at most `most` for each, by path and
    line.

    Names of less than three characters have no callers. Comment lines, signatures and lone declarations are no calls,
    nor is the line a function starts on. The caller is the last function that starts before the line and has not
    ended, else "global/unknown". Calls are cut out of lines once and joined with the names wanted.
    """
    wanted = names.where(F.length("name") >= 3).select("version", "name").distinct()
    code = F.trim("line")
    calls = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b(\w+)\s*\(")))).alias("name")
    rows = _numbered(blobs).where(~code.rlike(r"^(//|/\*|\*)")).select("version", "path", "line_no", code.alias("line"), calls).join(wanted, ["version", "name"])
    esc = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    signature = F.rlike("line", F.concat(F.lit(r"^static\s+\w+\s+"), esc, F.lit(r"\s*\("))) | F.rlike("line", F.concat(F.lit(r"^(?:\w+\s+)*\w+\s+"), esc, F.lit(r"\s*\([^)]*\)\s*$")))
    declared = F.col("line").endswith(";") & F.col("line").startswith(F.col("name"))
    real = rows.where(~signature & ~declared)
    own = symbols.where("kind = 'function'").select("version", "path", F.col("name").alias("caller"), "start_line", "end_line")
    both = real.join(own, ["version", "path"], "left").groupBy("version", "path", "line_no", "name", "line")
    inside = (F.col("start_line") < F.col("line_no")) & (F.col("line_no") <= F.col("end_line"))
    found = both.agg(
        F.max_by(F.when(inside, F.col("caller")), F.when(inside, F.col("start_line"))).alias("caller"), F.coalesce(F.bool_or(F.col("start_line") == F.col("line_no")), F.lit(False)).alias("_starts")
    )
    order = Window.partitionBy("version", "name").orderBy("path", "line_no")
    kept = found.where("not _starts").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return kept.select("version", "name", "path", F.coalesce("caller", F.lit("global/unknown")).alias("caller"), "line_no", "line")


def changed_functions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(version, path, name, change_type, old_code, new_code, start_line_old, start_line_new) of functions that were added
    or modified between two symbol tables (version, path, name, code, start_line); of a name that a file defines twice
    the last counts. Comments and white space do not."""
    keys = ["version", "path", "name"]
    old, new = (latest_of(rows, keys, "start_line") for rows in (old, new))
    a = old.select(*keys, F.col("code").alias("old_code"), F.col("start_line").alias("start_line_old"))
    b = new.select(*keys, F.col("code").alias("new_code"), F.col("start_line").alias("start_line_new"))
    both = b.join(a, keys, "left").where(F.col("old_code").isNull() | (normalised(F.col("old_code")) != normalised(F.col("new_code"))))
    kind = F.when(F.col("old_code").isNull(), "ADDED").otherwise("MODIFIED")
    return both.select(*keys, kind.alias("change_type"), F.coalesce("old_code", F.lit("")).alias("old_code"), "new_code", F.coalesce("start_line_old", F.lit(1)).alias("start_line_old"), "start_line_new")


def _numbered(blobs: DataFrame) -> DataFrame:
    """(version, path, line_no, line) of all files."""
    rows = lines(blobs.select(F.struct("version", "path").alias("_f"), "text"), "_f", "text")
    return rows.select("unit_id.version", "unit_id.path", "line_no", "line")

