"""Landed JSON files to the store as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.normalize import normalize
from ..schema import RAW_PR
from ..sources.store import upsert_prs

LANDED = StructType([StructField("repo", StringType()), *RAW_PR.fields])


def read_landed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw pull requests with ``repo``, one JSON object a line, as files arrive."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(raw: DataFrame, org: str, store: str, progress: str, available_now: bool = True) -> StreamingQuery:
    """Normalize and upsert each batch; a batch that is run again gives the same store."""

    def put(batch: DataFrame, _: int) -> None:
        upsert_prs(normalize(batch, org), store)

    writer = raw.writeStream.foreachBatch(put).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
