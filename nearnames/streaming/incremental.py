"""Incremental featurisation: pairs that arrive as files or any stream are scored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nearnames.operators import scoring

PAIRS = "x_1 string, x_2 string, label int"


def read_pairs(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of pairs as a stream."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def featurize_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each micro-batch's features under ``out``, in a folder of its own.

    A batch that is run again after a failure overwrites its own folder, so every pair
    is in the output exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        scoring.featurize(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
