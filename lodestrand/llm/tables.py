"""Intermediate tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key are spread over this many pieces before any two of them meet.
SALTS = 64

#: Rows of an Arrow batch at most: texts are long, and an executor holds several batches for each of its tasks.
BATCH_ROWS = 2000

_own_dir: str | None = None
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; where it is unset, a temporary one in local mode and
    an error on a cluster."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lodestrand-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS. It is read when a plan runs, so it stays lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def materialize(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrand-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what materialize() wrote in this session, once the results have been stored."""
    for path in _written.pop(spark, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores in front as no column of that name needs."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salt(col: Column | str, n: int = SALTS) -> Column:
    """A number in [0, n) that a row keeps when its task runs again."""
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


class Groups:
    """The groups of rows with equal keys, kept in two levels.

    A key's rows first meet by salt, so a key that holds a third of all rows is spread over SALTS tasks, both on the
    way up (rows -> parts -> whole) and when an answer for each group goes down again.
    """

    def __init__(self, df: DataFrame, keys: list[str], id_col: str):
        self.keys = keys
        self.rows = df.withColumn("_salt", salt(id_col))
        self.parts = self.rows.groupBy(*keys, "_salt").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_size"))
        self.whole = self.parts.groupBy(*keys).agg(F.min("_least").alias("least"), F.sum("_size").alias("size"))

    def hand_down(self, answers: DataFrame) -> DataFrame:
        """rows with the columns of answers, which has one row per group."""
        spread = self.parts.select(*self.keys, "_salt").join(answers, self.keys)
        return self.rows.join(spread, [*self.keys, "_salt"]).drop("_salt")
