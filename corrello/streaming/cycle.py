"""The incremental cycle: new raw items are taken in by a file stream.

Each micro-batch inserts the items whose id is new (an anti join against the
table, so no unbounded streaming state) and appends them; derived tables are
then recomputed from the table.  Appends are idempotent: a batch that is run
again finds its ids present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corrello.operators.state import insert_if_absent
from corrello.sources.readers import RAW_ITEM


def take_in(spark: SparkSession, items: DataFrame, folder: str) -> int:
    """Append the new ones of ``items`` to the raw table below ``folder``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.schema(RAW_ITEM).parquet(folder) if there else spark.createDataFrame([], RAW_ITEM)
    new = insert_if_absent(items, old, ["id"], ["fetched_at", "source_ref"]).persist()
    try:
        count = new.count()
        if count:
            new.write.mode("append").parquet(folder)
        return count
    finally:
        new.unpersist()


def stream_items(spark: SparkSession, landing: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in all JSON files of ``landing`` that no earlier run has read."""
    stream = spark.readStream.schema(RAW_ITEM).json(landing)
    write = stream.writeStream.foreachBatch(lambda df, _: take_in(spark, df, folder) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
