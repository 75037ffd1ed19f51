"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Each source has a weight and a weight schedule over training time t in [0, 1]: a straight line from begin to end with
mean 1 (sources are ordered in one task: a row for each, so some millions of them at most). Sizes are word counts. A source's target is its weight's share of all words; a target stops at max_epochs
times the source's size and the excess goes to the others by weight until none is above (solved in closed form: in
the order of max_epochs * size / weight the capped sources come first).

The integral of a source's schedule is its cumulative demand D(t) = target * (b*t + (e-b)*t^2/2). Its documents stand
in a fixed pseudo-random order (md5 of the id), and are taken whole, in as many full rounds as fit the target and
then once more up to the document in which the target falls; the k-th word of a source is due when D(t) = k, which is
inverted for each document to give its training positions. The documents are then range-sorted by position.

Running sums never order a whole source in one task: rows are dealt into BUCKETS slices of the md5 order per source,
the slices are summed, and only sums over the slices and within a slice are windowed.

Null text has size 0, a null source is a source of its own and comes last; a source of size 0 gets target 0.
Repeated rows count as documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, read_table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BUCKETS = 1024
#: (begin, end) of each weight's schedule; the mean of the two is 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, rank, weight, target. One row per source, few by nature."""
    everyone = Window.partitionBy(F.lit(0))
    rank = (F.row_number().over(everyone.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1).cast("int")
    weighed = sizes.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    by_cap = everyone.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone)
    left = total - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    # once a source is below its cap in this order, so are all after it, at the same rate per weight
    rated = weighed.withColumn("_rate", left / F.sum("weight").over(after)).withColumn(
        "_free", F.col("_rate") * F.col("weight") <= max_epochs * F.col("source_size")
    )
    rate = F.first(F.when(F.col("_free"), F.col("_rate")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    cap = (max_epochs * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(rate * F.col("weight"), cap))
    return rated.withColumn("target", target).drop("_rate", "_free")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, positions (array of t, one per copy taken), range-sorted."""
    size = F.coalesce(F.size(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(size).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_key"),
    ).withColumn("_bucket", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    sized = checkpointed(sized)
    cells = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_cell"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, max_epochs)
    slices = cells.withColumn(
        "_base", F.sum("_cell").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_cell")
    )
    per_slice = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("_source"), F.col("s._bucket").alias("_b"), "_base", "source_size", "rank", "weight", "target"
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    placed = (
        sized.withColumn("_run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(per_slice, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_start", F.col("_base") + F.col("_run"))
    )
    rounds = F.floor(F.col("target") / F.col("source_size")).cast("int")
    part = F.col("target") - rounds * F.col("source_size")
    copies = F.when(F.col("source_size") > 0, rounds + (F.col("_start") + F.col("size") / 2 < part).cast("int")).otherwise(0)
    n = len(weights)
    begin = F.element_at(F.array(*(F.lit(float(schedules[i % len(schedules)][0])) for i in range(n))), (F.col("rank") % n + 1).cast("int"))
    end = F.element_at(F.array(*(F.lit(float(schedules[i % len(schedules)][1])) for i in range(n))), (F.col("rank") % n + 1).cast("int"))

    def when_due(k):
        """t with begin*t + (end-begin)*t*t/2 = share of the demand met before copy k; the form without cancellation."""
        share = F.least((k * F.col("source_size") + F.col("_start")) / F.col("target"), F.lit(1.0))
        return 2 * share / (F.col("_begin") + F.sqrt(F.greatest(F.col("_begin") ** 2 + 2 * (F.col("_end") - F.col("_begin")) * share, F.lit(0.0))))

    taken = (
        placed.withColumn("_copies", F.least(copies, F.lit(max_epochs)))
        .withColumn("_begin", begin)
        .withColumn("_end", end)
        .withColumn(
            "positions",
            F.when(
                (F.col("_copies") > 0) & (F.col("target") > 0),
                F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), when_due),
            ).otherwise(F.array().cast("array<double>")),
        )
    )
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).cast("long").alias("taken"), "positions"
    ).orderBy(F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0)), "doc_id")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_mix_sources": op9_mix_sources}
ORACLE_SQL = {
    "op9_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                   CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
            FROM documents
        ),
        b AS (SELECT *, CAST('0x' || left(k, 8) AS BIGINT) % 1024 AS slice FROM d),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight
            FROM d GROUP BY source
        ),
        r AS (
            SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM s
        ),
        f AS (SELECT arg_min(rate, source_size / weight) AS rate FROM r WHERE rate * weight <= 3 * source_size),
        t AS (
            SELECT s.*, least(3.0::DOUBLE * source_size, coalesce(f.rate * weight, 3.0::DOUBLE * source_size))::DOUBLE AS target
            FROM s LEFT JOIN f ON true
        ),
        c AS (
            SELECT b.*, source_size, target,
                   sum(size) OVER (PARTITION BY b.source ORDER BY slice, k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
            FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size > 0 THEN CAST(size * (CAST(floor(target / source_size) AS BIGINT)
                    + CASE WHEN start + size / 2.0::DOUBLE < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS taken
        FROM c""",
}
