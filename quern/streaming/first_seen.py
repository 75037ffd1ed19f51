"""First representative and frequency by dedup key, kept up to date over a stream, and sinks that a rerun does not repeat.

The state store holds one row for each key and period: the least row of the key by event time, and the number of rows.
The watermark closes a period `late` after its end: its state leaves the store, and rows that come later still are
dropped (Spark counts them in the query's progress, dropped_late()). So the store holds the open periods only, whatever
the stream's age, and what is known of closed ones is in the sink.

Each micro-batch writes the keys that it changed to a folder of its own below the sink, named by the batch's number. A
batch that runs again after a failure overwrites its own folder and appends nothing twice; a reader takes each key's
last word. After a restart the checkpoint says which batch comes next and what the state was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE, PERIOD = "1 hour", "1 day"


def by_batch(sink: str, form: str = "parquet", **options: object) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows in sink/batch=<number>. With form='csv' and header=True each file begins with
    the header, and none holds it twice, however often a run is broken off and taken up again."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.format(form).options(**options).mode("overwrite").save(f"{sink.rstrip('/')}/batch={batch}")

    return write


def first_seen(stream: DataFrame, key: str, time: str, keep: list[str], late: str = LATE, period: str = PERIOD) -> DataFrame:
    """(period, key, frequency, first): first is a struct of time and keep, the least one. Rows without a key are one
    key; rows without a time belong to no period and are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    first = F.min(F.struct(F.col(time).alias("time"), *(F.col(c) for c in keep))).alias("first")
    return timed.groupBy(F.window(time, period).alias("period"), F.col(key).alias("dedup_key")).agg(F.count(F.lit(1)).alias("frequency"), first)


def start(stream: DataFrame, sink: str, checkpoint: str, key: str, time: str, keep: list[str], late: str = LATE, period: str = PERIOD) -> StreamingQuery:
    """Bring the sink up to date with what the stream has now; changed keys only are written."""
    rows = first_seen(stream, key, time, keep, late, period)
    return rows.writeStream.outputMode("update").foreachBatch(by_batch(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """(dedup_key, frequency, first) of all that the sink was told: each period's last word for a key, then all periods
    together."""
    told = spark.read.parquet(sink)
    last = told.groupBy("dedup_key", "period").agg(F.max_by(F.struct("frequency", "first"), "batch").alias("l"))
    return last.groupBy("dedup_key").agg(F.sum("l.frequency").alias("frequency"), F.min("l.first").alias("first"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query dropped since it started, as they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def pending(rows: DataFrame, results: DataFrame, key: str, error: str) -> DataFrame:
    """Rows whose key has no result yet, or only ones with an error: what a run that was broken off still has to do."""
    done = results.filter(F.coalesce(F.col(error), F.lit("")) == "").select(key).distinct()
    return rows.join(done, key, "left_anti")
