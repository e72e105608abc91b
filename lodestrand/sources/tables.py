"""Tables, source trees, repository and vulnerability lists, and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of source files and folders that are passed over.
SUFFIXES = ("c", "h", "cpp", "hpp", "cc", "cxx")
SKIPPED = (".git", "Documentation", "scripts", "tools")
MOST_BYTES = 30 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, text) of the source files below root. Size, suffix and folder are tested on the listing, before
    any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.col("path").rlike(rf"\.({'|'.join(SUFFIXES)})$") & (F.col("length") <= most_bytes)
    for folder in SKIPPED:
        wanted &= ~F.col("path").contains(f"/{folder}/")
    return files.where(wanted).select("path", "length", F.col("content").cast("string").alias("text"))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """(repository, version); an older header, `repo`, is accepted too."""
    rows = spark.read.option("header", True).csv(path)
    name = F.coalesce(*(F.col(c) for c in ("repository", "repo") if c in rows.columns))
    version = F.col("version") if "version" in rows.columns else F.lit(None)
    return rows.select(name.alias("repository"), version.cast("string").alias("version"))


def vulnerabilities(spark: SparkSession, path: str, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The first row of each (repo, vul_id) by fixed commit, of the wanted ids, at most `most` of them."""
    rows = spark.read.schema("repo string, vul_id string, fixed_commit_sha string").option("header", True).csv(path)
    first = F.row_number().over(Window.partitionBy("repo", "vul_id").orderBy("fixed_commit_sha"))
    rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    rows = rows.where(F.col("vul_id").isin(ids)) if ids else rows
    return rows.orderBy("repo", "vul_id").limit(most) if most else rows


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(cve, cwe_ids, cwe_names, description) from a JSON object keyed by CVE."""
    kind = "map<string, struct<cwe_ids: array<string>, cwe_names: array<string>, description: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("cve", "_m"))
    return rows.select("cve", "_m.*")


def versioned_functions(spark: SparkSession, path: str) -> DataFrame:
    """(vul_id, tag, version, file_path, func_name, code_content) from nested JSON."""
    kind = "map<string, struct<versions: map<string, map<string, map<string, map<string, string>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("vul_id", "_a"))
    for column, inner in (("tag", "_a.versions"), ("version", "_b"), ("file_path", "_c")):
        below = {"tag": "_b", "version": "_c", "file_path": "_d"}[column]
        rows = rows.select(*[c for c in rows.columns if not c.startswith("_")], F.explode(inner).alias(column, below))
    return rows.select("vul_id", "tag", "version", "file_path", F.explode("_d").alias("func_name", "code_content"))


def by_basename(files: DataFrame, name: str) -> DataFrame:
    return files.where((F.col("path") == name) | F.col("path").endswith(f"/{name}"))


def benchmark_corpus(functions: DataFrame, listed: DataFrame) -> DataFrame:
    """versioned_functions() of the vulnerabilities that are listed, tags pre, vul and fix, each with its compound name."""
    known = functions.where(F.col("tag").isin("pre", "vul", "fix")).join(listed.select("vul_id").distinct(), "vul_id", "left_semi")
    return known.withColumn("name", F.concat_ws(":", "tag", "version", "func_name"))
