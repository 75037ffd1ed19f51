"""What feeds and watches a training run: padded batches, and where a run stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import curate


def padded_batches(rows: DataFrame, id_col: str, tokens: str, size: int, pad: int, views: dict[str, int], by_length: bool = True) -> DataFrame:
    """(batch, width, ids, tokens, and each view): `size` rows a batch, in the order of their lengths, so that a batch's
    lists have nearly one length; with by_length=False in the order of ids. Every list is padded to its batch's longest;
    a view that is missing is zeros of the length that `views` names. Null tokens are no tokens.

    Rows are numbered over ranges of lengths, so no task holds more than a range, and a batch is bounded by `size`.
    """
    held = rows.select(F.col(id_col).alias("_id"), F.coalesce(tokens, F.array().cast(rows.schema[tokens].dataType)).alias("_t"), *(F.coalesce(v, F.array_repeat(F.lit(0.0), n)).alias(v) for v, n in views.items()))
    sized = held.withColumn("_n", F.size("_t"))
    # numbers go to ids only; the wide rows meet them afterwards
    placed = curate.numbered(sized.select("_id", "_n"), ["_n", "_id"] if by_length else ["_id"]).select("_id", "row_id")
    batched = sized.join(placed, "_id").withColumn("batch", F.expr(f"row_id div {size}"))
    member = F.struct("row_id", F.col("_id").alias("id"), F.col("_t").alias("t"), *views)
    whole = batched.groupBy("batch").agg(F.max("_n").alias("width"), F.array_sort(F.collect_list(member)).alias("m"))
    filled = F.transform("m", lambda x: F.concat(x["t"], F.array_repeat(F.lit(pad).cast(rows.schema[tokens].dataType.elementType), F.col("width") - F.size(x["t"]))))
    return whole.select("batch", "width", F.transform("m", lambda x: x["id"]).alias("ids"), filled.alias("tokens"), *(F.col("m")[v].alias(v) for v in views))


def stops(log: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch, n_epochs): the log of each run is read in the order of its epochs, best
    value and waiting time in hand. An epoch is best if its loss is less than all before; after `patience` epochs
    without a best one the run stops, and what is logged later does not count. stop_epoch is null for a run that goes on
    to its log's end; n_epochs are those that count. A null or NaN loss is never best. A run's log is one row's list."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("epoch"), F.nanvl(F.col(loss).cast("double"), F.lit(None)).alias("loss"))))
    kind = log.schema[epoch].dataType
    none = F.lit(None)
    start = F.struct(none.cast("double").alias("best"), none.cast(kind).alias("at"), F.lit(0).alias("waited"), none.cast(kind).alias("stop"), F.lit(0).cast("long").alias("n"))

    def step(a, x):
        better = x["loss"].isNotNull() & (a["best"].isNull() | (x["loss"] < a["best"]))
        waited = F.when(better, 0).otherwise(a["waited"] + 1)
        after = F.struct(
            F.when(better, x["loss"]).otherwise(a["best"]).alias("best"),
            F.when(better, x["epoch"]).otherwise(a["at"]).alias("at"),
            waited.alias("waited"),
            F.when(waited >= patience, x["epoch"]).alias("stop"),
            (a["n"] + 1).alias("n"),
        )
        return F.when(a["stop"].isNotNull(), a).otherwise(after)

    folded = log.groupBy(run).agg(F.aggregate(rows, start, step).alias("f"))
    return folded.select(run, F.col("f.at").alias("best_epoch"), F.col("f.best").alias("best_loss"), F.col("f.stop").alias("stop_epoch"), F.col("f.n").alias("n_epochs"))
