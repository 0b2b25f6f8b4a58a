"""Incremental index: new passages enter once, whatever their order of arrival or repetition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id


def passages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """hash_id, text of a stream of Parquet files; each text once over the life of the stream."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return rows.select(content_id("passage", F.col("text")).alias("hash_id"), "text").dropDuplicates(["hash_id"])


def run_available(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Processes what is there, appends it to the Parquet folder `table` and returns that."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(table).awaitTermination()
    return stream.sparkSession.read.parquet(table)


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one on a single machine where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="evigraph-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"
