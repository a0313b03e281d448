"""Predictions as they arrive: the batch operators' stateless parts on streams, and counts in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium.functions.variants import with_readable
from scenarium.operators.payload import schema_kind

ARRIVALS = "nested_id bigint, image_id string, body string, written_at timestamp, ingested_at timestamp"


def arrivals(spark: SparkSession, folder: str, schema: str = ARRIVALS, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def delivered_once(rows: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Each key's first delivery; keys are remembered for ``late``, so state stays bounded."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def kinds(rows: DataFrame, body: str = "body") -> DataFrame:
    """Readable rows with the kind of their schema."""
    keep = [F.col(c) for c in rows.columns]
    return with_readable(rows, body, "__v").select(*keep, schema_kind(F.try_variant_get("__v", "$.core", "variant")).alias("kind"))


def windowed_counts(rows: DataFrame, at: str, window: str = "1 day", late: str | None = "7 days", by: str = "kind") -> DataFrame:
    """(start, by, n): rows per window of event time; what is later than ``late`` is dropped. None: the stream has its watermark already."""
    counted = (rows.withWatermark(at, late) if late else rows).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")
