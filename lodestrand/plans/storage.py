"""Tables that phases leave behind: in a named folder, or in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import search

_temporary: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; where it is unset, a temporary folder in local mode and an error on a
    cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="lodestrand-"))
        atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
    return f"file://{_temporary[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """df written once and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/phase-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class MissingIndex(RuntimeError):
    """An index that a query needs is not there."""


def write_index(symbols: DataFrame, postings: DataFrame, folder: str) -> None:
    """Symbols, and distinct postings dealt by token and sorted, so that a token's rows lie in one file and few of its row
    groups, and an aggregate by token reads sorted rows. One shuffle drops duplicates and deals."""
    symbols.write.mode("overwrite").parquet(f"{folder}/symbols")
    dealt = postings.repartition("token").dropDuplicates(["token", "unit_id"])
    dealt.sortWithinPartitions("token", "unit_id").write.mode("overwrite").parquet(f"{folder}/postings")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    for part in ("symbols", "postings"):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            raise MissingIndex(f"no index in {folder}: build it first")
    return spark.read.parquet(f"{folder}/symbols"), spark.read.parquet(f"{folder}/postings")


def write_benchmark(corpus: DataFrame, folder: str) -> None:
    """The index of a benchmark corpus (vul_id, name, file_path, func_name, code_content): units numbered by a hash of
    vulnerability, path and compound name, with distinct postings."""
    units = corpus.withColumn("unit_id", F.xxhash64("vul_id", "file_path", "name")).dropDuplicates(["unit_id"])
    write_index(units, search.postings(units, "unit_id", "code_content"), folder)


def session_index(spark: SparkSession, source: str, make) -> tuple[DataFrame, DataFrame]:
    """The index of a source: make() gives its symbols and postings, which are written the first time that this
    application asks and read from then on."""
    name = hashlib.sha256(f"{spark.sparkContext.applicationId}\x00{source}".encode()).hexdigest()[:24]
    folder = f"{shared_folder(spark)}/index-{name}"
    try:
        return read_index(spark, folder)
    except MissingIndex:
        write_index(*make(), folder)
        return read_index(spark, folder)


def append_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both batches without exact duplicates."""
    return old.unionByName(new).dropDuplicates()


def batch_summary(results: DataFrame, variant: str, success: str) -> DataFrame:
    """Runs, successes and failures of each variant, and of all of them under a null variant."""
    return results.rollup(variant).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(success)).alias("succeeded"), F.count_if(~F.col(success)).alias("failed")
    )


def phase(spark: SparkSession, folder: str, name: str, make, force: bool = False) -> DataFrame:
    """The output of a phase: read if it is there, made and written if not or if forced."""
    path = f"{folder}/{name}"
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_metadata(findings: DataFrame, runs: DataFrame, key: str, *columns: str) -> DataFrame:
    """findings with columns of runs, UNKNOWN where a run says nothing."""
    both = findings.join(runs.select(key, *columns).dropDuplicates([key]), key, "left")
    return both.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in columns})


def failed_tasks(results: DataFrame, tasks: DataFrame, key: str, success: str) -> tuple[DataFrame, DataFrame]:
    """(tasks whose run failed, keys of failed runs that no task has)."""
    failed = results.where(~F.col(success)).select(key).distinct()
    return tasks.join(failed, key, "left_semi"), failed.join(tasks.select(key), key, "left_anti")


def pending_phases(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """The phases, in order, from the first that has not been stored on."""
    for i, name in enumerate(names):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return names[i:]
    return []


def completion(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, expected, done, complete): how many of the tasks that each key expects have been done."""
    asked = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    made = done.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    both = asked.join(made, key, "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
    return both.withColumn("complete", F.col("done") >= F.col("expected"))


def output_folders(base: str, repository: str, vulnerability: str, variant: str = "") -> dict[str, str]:
    """Where phases and results of a run go; a variant has folders of its own."""
    suffix = f"-{variant}" if variant else ""
    return {"phases": f"{base}/checkpoints{suffix}/{repository}/{vulnerability}", "results": f"{base}/results{suffix}/{repository}"}
