"""The stateless cleaning operators over a stream of new files, one pass over what is there (AvailableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import curate


def clean_stream(stream: DataFrame, text_col: str, attribute_col: str) -> DataFrame:
    """Adds norm, drop_reason and dedup_key; no state, so late rows need no watermark."""
    out = curate.prepared(stream, text_col)
    return out.withColumn("dedup_key", text.dedup_key(F.col("norm"), F.col(attribute_col)))


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, text_col: str = "text", attribute_col: str = "lang") -> None:
    """Clean the files below source that the checkpoint has not seen and append them to sink."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    query = clean_stream(stream, text_col, attribute_col).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
