"""Interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _number(kind: str):
    """A function from a column of this type to a number that never falls as the column rises."""
    if kind == "timestamp_ntz":
        return lambda c: F.unix_date(F.to_date(c)) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return lambda c: F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, buckets: int = 256) -> DataFrame:
    """points with the span that encloses each: of the spans with the same key, the one with the latest start before
    the point, if it has no end or ends at the point or later. Points that are a span's start are dropped; without a
    span the name is "unknown".

    Spans may nest, so a point can lie behind the end of the latest span and inside an earlier one. The range of all
    points is cut into buckets of one length: a point is in one, a span in as many as it touches. They meet on key and
    bucket, each pair once, so that a key with a third of all points is many tasks and a short span meets its own time
    only; max_by with partial sums keeps the best. `latest` is the linear form for spans that do not nest.
    """
    number = _number(points.schema[at].dataType.simpleString())
    low, high = points.agg(F.min(number(F.col(at))), F.max(number(F.col(at)))).first()
    low, width = low or 0.0, max((high or 0.0) - (low or 0.0), 1e-9) / buckets
    bucket = lambda c: F.least(F.greatest(F.floor((number(c) - low) / width), F.lit(0)), F.lit(buckets - 1)).cast("int")
    p = points.withColumns({"_p": F.monotonically_increasing_id(), "_b": bucket(F.col(at))})
    s = spans.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_n")).where(F.col("_e").isNull() | (F.col("_e") >= F.col("_s")))
    s = s.withColumn("_c", F.explode(F.sequence(bucket(F.col("_s")), F.when(F.col("_e").isNull(), buckets - 1).otherwise(bucket(F.col("_e"))))))
    on = (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.col("_s") <= F.col(at)) & (F.col("_e").isNull() | (F.col(at) <= F.col("_e")))
    best = p.join(s, on).groupBy("_p").agg(F.max_by("_n", "_s").alias("enclosing"), F.max("_s").alias("_s"))
    found = p.join(best, "_p", "left").where(F.col("_s").isNull() | (F.col("_s") < F.col(at)))
    return found.withColumn("enclosing", F.coalesce("enclosing", F.lit("unknown"))).drop("_p", "_b", "_s")


def latest(points: DataFrame, starts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points with the value of the last start of the same key before each, "unknown" without one: one shuffle and one
    sorted pass over both, never a product. Starts at the same time count from the next time on."""
    both = points.select(F.struct("*").alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).cast("string").alias("_v")).unionByName(
        starts.select(F.lit(None).cast(points.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(value).cast("string").alias("_v"))
    )
    before = Window.partitionBy("_k").orderBy("_t", F.col("_row").isNull(), "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", True).over(before)).where("_row is not null").select("_row.*", F.coalesce("_last", F.lit("unknown")).alias("enclosing"))
