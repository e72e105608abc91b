"""Small literal tables that Spark and DuckDB read alike, and inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def values_sql(rows: list[tuple], columns: str) -> str:
    """(VALUES ...) AS t(columns), as both dialects read it."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Every turn (conv_id, turn, role, text) that is followed by the next number, with next_role and next_text."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumns({"_t": F.lead("turn").over(order), "next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)}).where("_t = turn + 1").drop("_t")
