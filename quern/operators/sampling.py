"""Splits, samples and baseline draws. Random order is md5(seed|id), the same wherever it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import curate
from quern.session import checkpointed
from quern.operators.joins import small


def seeded(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def uniform(seed: int, key: Column, n: Column) -> Column:
    """A number 0 .. n - 1."""
    return F.pmod(F.conv(F.substring(seeded(seed, key), 1, 15), 16, 10).cast("long"), n)


def stratified_split(df: DataFrame, id_col: str, stratum: str, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split per id: max(1, floor(n * train)) train, floor(n * val) val, the rest test, per stratum of any size."""
    rows = df.select(id_col, stratum, seeded(seed, F.col(id_col)).alias("_draw"))
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    at = curate.numbered(rows, [stratum, "_draw", id_col], by=stratum).join(small(sizes), F.col(stratum).eqNullSafe(F.col("_s")))
    n_train = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(train)))
    n_val = F.floor(F.col("_n") * F.lit(val))
    return at.select(id_col, stratum, F.when(F.col("row_id") < n_train, "train").when(F.col("row_id") < n_train + n_val, "val").otherwise("test").alias("split"))


def stratified_sample(df: DataFrame, id_col: str, stratum: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """Per stratum the max(1, n // 3) heaviest, then seeded draws from the rest, n in all. Ranks are limited within each
    task before a stratum's rows meet."""
    head = max(1, n // 3)
    first = lambda rows, order, most: curate.rank_within(rows, [stratum], order, "_r").filter(F.col("_r") <= most)
    heavy = first(df, [F.desc(weight), F.col(id_col)], head).select(id_col, stratum)
    rest = df.join(small(heavy.select(F.col(id_col).alias("_id"))), F.col(id_col) == F.col("_id"), "left_anti")
    drawn = first(rest.withColumn("_draw", seeded(seed, F.col(id_col))), [F.col("_draw"), F.col(id_col)], n - head).select(id_col, stratum)
    return heavy.withColumn("is_head", F.lit(True)).unionByName(drawn.withColumn("is_head", F.lit(False)))


def nucleus(df: DataFrame, by: list[str], p: str, order: list[Column], mass: float) -> DataFrame:
    """Rows by falling probability whose predecessors sum to no more than mass; the first always stays."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(p).over(w), F.lit(0.0))).filter(F.round("_before", 9) <= mass).drop("_before")


def weighted_draw(test: DataFrame, id_col: str, values: DataFrame, value: str, count: str, seed: int = 42, blocks: int = 1024) -> DataFrame:
    """For each test row a value with probability count / total: a range join on the running sum, by `blocks` equal parts
    of the range, so a value is copied at most `blocks` times, however large its count."""
    spans = curate.running_total(values, [F.desc(count), value], F.col(count), name="hi").withColumn("lo", F.col("hi") - F.col(count))
    total = values.agg(F.sum(count).alias("t")).first()["t"] or 0
    width = max(1, -(-int(total) // blocks))
    placed = spans.filter(F.col(count) > 0).withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    drawn = test.select(id_col, uniform(seed, F.col(id_col), F.lit(max(1, int(total)))).alias("u")).withColumn("_b", F.floor(F.col("u") / width))
    return drawn.join(placed, "_b").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(id_col, value)


def run_named(baselines: dict[str, Callable[[], DataFrame]], id_col: str, value: str) -> tuple[DataFrame | None, dict[str, str]]:
    """Predictions (baseline, id, value) of all baselines that succeed; the others with their errors. Each is run and
    written to the checkpoint folder by itself, so that one that fails while it runs takes no other with it."""
    made, failed = None, {}
    for name, predict in baselines.items():
        try:
            rows = checkpointed(predict().select(F.lit(name).alias("baseline"), id_col, value))
        except Exception as error:
            failed[name] = str(error)
            continue
        made = rows if made is None else made.unionByName(rows)
    return made, failed


def top_beams(df: DataFrame, by: list[str], score: Column, order: list[Column], most: int) -> DataFrame:
    """The `most` best-scored continuations of each group, with beam_score and rank."""
    return curate.rank_within(df.withColumn("beam_score", score), by, [F.desc("beam_score"), *order]).filter(F.col("rank") <= most)
