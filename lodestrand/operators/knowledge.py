"""Weakness classes and their categories as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Categories in registry order with their major class.
CATEGORIES = (
    ("Integer Overflow", "Numeric-Domain"), ("Integer Underflow", "Numeric-Domain"), ("Divide By Zero", "Numeric-Domain"), ("Type Confusion", "Numeric-Domain"),
    ("Out-of-bounds Write", "Access-Validity"), ("Out-of-bounds Read", "Access-Validity"), ("Buffer Overflow", "Access-Validity"),
    ("Null Pointer Dereference", "Access-Validity"), ("Uninitialized Use", "Access-Validity"),
    ("Use After Free", "Resource-Lifecycle"), ("Double Free", "Resource-Lifecycle"), ("Memory Leak", "Resource-Lifecycle"),
    ("Race Condition", "Control-Logic"), ("Missing Authorization", "Control-Logic"), ("Authentication Bypass", "Control-Logic"), ("Logic Error", "Control-Logic"),
    ("Unknown", "Unknown"),
)
# Weakness number to category.
CWE = (
    (190, "Integer Overflow"), (191, "Integer Underflow"), (369, "Divide By Zero"), (787, "Out-of-bounds Write"), (125, "Out-of-bounds Read"),
    (120, "Buffer Overflow"), (121, "Buffer Overflow"), (122, "Buffer Overflow"), (476, "Null Pointer Dereference"), (457, "Uninitialized Use"),
    (416, "Use After Free"), (415, "Double Free"), (401, "Memory Leak"), (362, "Race Condition"), (862, "Missing Authorization"), (287, "Authentication Bypass"),
)
# Dependency chains, source, target, kind, optional.
CHAINS = {
    **{c: (("source", "computation", "data", False), ("computation", "sink", "data", False)) for c in ("Integer Overflow", "Integer Underflow", "Divide By Zero", "Type Confusion")},
    **{c: (("object", "access", "data", False), ("index", "access", "data", True)) for c in ("Out-of-bounds Write", "Out-of-bounds Read")},
    "Buffer Overflow": (("object", "access", "data", False), ("source", "access", "data", True)),
    **{c: (("object", "access", "data", False),) for c in ("Null Pointer Dereference", "Uninitialized Use")},
    "Use After Free": (("alloc", "dealloc", "data", False), ("dealloc", "use", "temporal", False)),
    "Double Free": (("alloc", "dealloc", "data", False), ("dealloc", "dealloc", "temporal", False)),
    "Memory Leak": (("alloc", "exit", "temporal", False),),
}
# Vulnerability types of an older naming; those that are no category stand for themselves.
LEGACY_TYPES = (
    "Use After Free", "Double Free", "Out-of-bounds Write", "Out-of-bounds Read", "Buffer Overflow", "Memory Leak", "Null Pointer Dereference", "Uninitialized Use",
    "Race Condition", "Deadlock", "Integer Overflow", "Integer Underflow", "Divide By Zero", "Type Confusion",
    "Authentication Bypass", "Privilege Escalation", "Authorization Bypass", "Logic Error",
    "Injection", "Path Traversal", "Improper Validation", "Information Exposure", "Cryptographic Issue",
    "Infinite Loop", "Recursion Error", "Resource Exhaustion", "Resource Leak", "Unknown", "Other",
)
# The one category whose older name differs.
LEGACY_NAMES = {"Missing Authorization": "Authorization Bypass"}


def categories(spark: SparkSession) -> DataFrame:
    rows = [(i, c, m, m == "Numeric-Domain") for i, (c, m) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "pos int, category string, major string, is_numeric boolean")


def weaknesses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CWE, "cwe int, category string")


def chain_links(spark: SparkSession) -> DataFrame:
    rows = [(c, i, *link) for c, links in CHAINS.items() for i, link in enumerate(links)]
    return spark.createDataFrame(rows, "category string, pos int, source string, target string, dependency string, is_optional boolean")


def parse_cwe(text: Column) -> Column:
    """The number after CWE-, else a bare whole number, else null."""
    named, bare = F.regexp_extract(text, r"CWE-(\d+)", 1), F.regexp_extract(text, r"^\s*(\d+)\s*$", 1)
    return F.coalesce(named.try_cast("int"), bare.try_cast("int"))


def classify(rows: DataFrame, spark: SparkSession, cwe_col: str) -> DataFrame:
    """rows with the weakness number, category (Unknown without one), major class and whether it is numeric."""
    found = rows.withColumn("cwe", parse_cwe(F.col(cwe_col))).join(weaknesses(spark), "cwe", "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))
    return found.join(categories(spark).drop("pos"), "category", "left")


def resolve(names: DataFrame, spark: SparkSession, name_col: str) -> DataFrame:
    """names with the category meant: written exactly, in other case, contained either way, or by its older name; else
    Unknown.

    The dimension has seventeen rows; each name meets all of them and the best match by rule, then by registry order, stays.
    """
    low, known = F.lower(F.trim(F.col(name_col))), F.lower("category")
    older = F.lower(legacy_type(F.col("category")))
    rule = F.when(F.col(name_col) == F.col("category"), 1).when(low == known, 2).when(low.contains(known) | known.contains(low), 3).when((low == older) & (older != "unknown"), 4)
    both = names.join(categories(spark), rule.isNotNull(), "left").withColumn("rule", rule)
    best = F.row_number().over(Window.partitionBy(name_col).orderBy(F.col("rule").asc_nulls_last(), "pos"))
    return both.withColumn("_n", best).where("_n = 1").select(name_col, F.coalesce("category", F.lit("Unknown")).alias("category"), "rule")


def legacy_type(category: Column) -> Column:
    """A category's name in the older list of types, Unknown if it has none."""
    renamed = F.lit(None).cast("string")
    for new, old in LEGACY_NAMES.items():
        renamed = F.when(category == new, old).otherwise(renamed)
    return F.coalesce(F.when(category.isin(*LEGACY_TYPES), category), renamed, F.lit("Unknown"))


def chain_text(links: DataFrame) -> DataFrame:
    """(category, chain): each category's links (category, pos, source, target, dependency, is_optional) on one line. A
    link goes on from the one before; one with the same target as what stands last is written backwards, and a source
    that was shown with a link before is not shown again."""
    mark = F.concat(F.substring("dependency", 1, 1), F.when(F.col("is_optional"), "?").otherwise(""))
    item = F.struct("pos", "source", "target", mark.alias("mark"))
    packed = links.groupBy("category").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        arrow, back = F.concat(F.lit("\u2192"), x["mark"]), F.concat(F.lit("\u2190"), x["mark"])
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        more = F.when(last.isNull(), F.array(x["source"], arrow, x["target"])).when(last == x["target"], F.array(back, x["source"])).otherwise(F.array(arrow, x["target"]))
        return F.when(F.array_contains(acc["seen"], x["source"]), acc).otherwise(F.struct(F.concat(acc["out"], more).alias("out"), F.array_append(acc["seen"], x["source"]).alias("seen")))

    return packed.select("category", F.array_join(F.aggregate("_l", empty, step)["out"], " ").alias("chain"))


def taxonomy(rows: DataFrame, spark: SparkSession, category_col: str = "category") -> DataFrame:
    """rows with the record of their category: major class, whether it is numeric, the older type, the anchor types in the
    order of the chain, and the chain as text; empty for a category without links."""
    links = chain_links(spark)
    ends = links.select("category", F.posexplode(F.array("source", "target")).alias("_e", "type"), "pos").groupBy("category", "type").agg(F.min(F.struct("pos", "_e")).alias("_at"))
    types = ends.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "type"))), lambda s: s["type"]).alias("anchor_types"))
    known = categories(spark).drop("pos").join(types, "category", "left").join(chain_text(links), "category", "left")
    record = known.select(
        F.col("category").alias(category_col), "major", "is_numeric", legacy_type(F.col("category")).alias("legacy_type"),
        F.coalesce("anchor_types", F.array().cast("array<string>")).alias("anchor_types"), F.coalesce("chain", F.lit("")).alias("chain"),
    )
    return rows.join(record, category_col, "left")
