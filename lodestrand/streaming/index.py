"""A token index kept up to date over a folder that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestrand.functions.text import UNICODE_WORD
from lodestrand.operators.search import postings


def follow(spark: SparkSession, folder: str, schema: str, id_col: str, code_col: str, index: str, checkpoint: str, word: str = UNICODE_WORD, **trigger) -> StreamingQuery:
    """Append the postings of every new Parquet file in folder to index, once each.

    A batch writes its own partition and replaces it if it is run again, so a restart after a failure neither loses
    nor repeats postings. trigger: as for writeStream.trigger, all files there now and then stop by default.
    """

    def write(rows: DataFrame, batch: int) -> None:
        made = postings(rows, id_col, code_col, word)
        made.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{index}/batch={batch}")

    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
