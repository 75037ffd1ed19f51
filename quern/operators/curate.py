"""Curation: drop with a reason, dedup before expensive steps, bring results back, update by a map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.operators.joins import joined_back, small
from quern.session import checkpointed


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """withColumn for a costly expression that several others use: a generator of one row, through which the optimizer
    neither repeats the expression for each use nor moves filters that would."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def prepared(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds norm and drop_reason (empty, meta, short or null)."""
    return once(once(df, "norm", text.normalize(F.col(text_col))), "drop_reason", text.drop_reason(F.col("norm")))


def numbered(df: DataFrame, order: list[str | Column], by: str | None = None) -> DataFrame:
    """row_id: 0-based dense position in `order` (which begins with `by`), over all rows or over those of one `by`."""
    return running_total(df, order, F.lit(1), by, "row_id").withColumn("row_id", F.col("row_id") - 1)


def running_total(df: DataFrame, order: list[str | Column], amount: Column, by: str | None = None, name: str = "total") -> DataFrame:
    """Sum of amount over a row and all rows before it in `order` (which begins with `by`), of all rows or of one `by`.

    The rows are put in ranges and written to the checkpoint folder once; what is added up is what is numbered, however
    the plan would divide it again. A range, never a group or the whole, is sorted in one task.
    """
    place = {"_amount": amount, "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(place))
    keys = [by] if by else []
    sizes = parts.groupBy("_part", *keys).agg(F.sum("_amount").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, and one more for each group that begins in it
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_part").alias("_p"), "_before", *(F.col(k).alias("_by") for k in keys))
    met = F.col("_part") == F.col("_p")
    if by:
        met = met & F.col(by).eqNullSafe(F.col("_by"))
    within = Window.partitionBy("_part", *keys).orderBy("_at")
    own = parts.withColumn("_own", F.sum("_amount").over(within))
    return own.join(small(starts), met).withColumn(name, F.col("_before") + F.col("_own")).drop("_amount", "_part", "_at", "_own", "_before", "_p", "_by")


def first_by_key(df: DataFrame, key: Column, order: str, keep: list[str]) -> DataFrame:
    """One row per key: frequency and the columns of the member that comes first."""
    return df.groupBy(key.alias("dedup_key")).agg(F.count(F.lit(1)).alias("frequency"), F.min_by(F.struct(*keep), order).alias("_f")).select("dedup_key", *(F.col(f"_f.{c}").alias(c) for c in keep), "frequency")


def apply_on_distinct(df: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run fn once per distinct key (DataFrame of key -> DataFrame with key and results) and join the results back."""
    return df.join(fn(df.select(key).distinct()), key, "left")


def brought_back(df: DataFrame, results: DataFrame, key: str, value: str, order: str, spread: str) -> DataFrame:
    """Outcome per row: missing (no result), sentinel, or kept. Of several results for a key the last by `order` counts.
    Rows of a key that a large share holds are dealt by `spread`."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    one = checkpointed(results.groupBy(key).agg(F.max_by(value, order).alias(value)).join(counts, key))
    outcome = F.when(F.col(value).isNull(), "missing").when(F.col(value) == fixed.SENTINEL, "sentinel").otherwise("kept")
    return joined_back(df, one, [key], "_rows", spread).drop("_rows").withColumn("outcome", outcome)


def updated_where_sentinel(df: DataFrame, mapping: DataFrame, key: str, value: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the sentinel take the mapped value; also the map entries that no row used."""
    hit = df.join(mapping, key, "left").withColumn(value, F.when((F.col(value) == fixed.SENTINEL) & F.col(new).isNotNull(), F.col(new)).otherwise(F.col(value)))
    unused = mapping.join(df.filter(F.col(value) == fixed.SENTINEL), key, "left_anti")
    return hit.drop(new), unused


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_with_remainder(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group with their rank, and n_more: how many further rows the group has."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    more = F.greatest(F.col("_n") - most, F.lit(0)).alias("n_more")
    return rank_within(df, by, order).filter(F.col("rank") <= most).join(small(sizes), by).select(*df.columns, F.col("rank").cast("long").alias("rank"), more)


def distinct_examples(df: DataFrame, value: str, order: list[str], most: int) -> DataFrame:
    """One row for each value, the first in order; of these the first `most`."""
    rest = [c for c in df.columns if c not in (value, *order)]
    first = df.groupBy(value).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(value, *(F.col(f"_f.{c}").alias(c) for c in [*order, *rest])).orderBy(*order).limit(most).select(*df.columns)


def of_attribute(df: DataFrame, column: str, slug: str) -> DataFrame:
    """Rows of one attribute, named by its slug."""
    return df.filter(F.col(column) == text.unslug(F.lit(slug)))


def having_any(df: DataFrame, *flags: str) -> DataFrame:
    """Rows for which one of the boolean columns is true."""
    return df.filter(F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in flags)) if len(flags) > 1 else F.col(flags[0]))


def known_only(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """The same rows; a value that is not known fails the job and is named."""
    wrong = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return df.withColumn(column, F.when(F.col(column).isin(known), F.col(column)).otherwise(wrong))


def switched(df: DataFrame, target: str, source: str) -> DataFrame:
    """target takes the values of source, and source goes."""
    return df.drop(target).withColumnRenamed(source, target)


def resolved(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each name from the first of its alternatives that df has; a name without any is an error."""
    missing = [name for name, given in aliases.items() if not set(given) & set(df.columns)]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*(F.col(next(c for c in given if c in df.columns)).alias(name) for name, given in aliases.items()))


def existing(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of `order` that df has, in that order."""
    return df.select(*(c for c in order if c in df.columns))


def positional(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], compare: tuple[str, str], checked: int = 50, width: int = 25) -> tuple[DataFrame, DataFrame]:
    """Rows paired by position, none if the sides differ in number; and one row (n_left, n_right, n_checked, agreement):
    the share of the first pairs whose compared texts begin alike."""
    a, b = numbered(left, left_order), numbered(right, right_order).withColumnRenamed("row_id", "_id")
    counts = [df.count() for df in (left, right)]
    pairs = a.join(b, F.col("row_id") == F.col("_id")).drop("_id").filter(F.lit(counts[0] == counts[1]))
    begins = lambda c: F.left(F.lower(F.btrim(F.coalesce(c, F.lit("")))), F.lit(width))
    alike = F.avg((begins(F.col(compare[0])) == begins(F.col(compare[1]))).cast("double"))
    told = pairs.filter(F.col("row_id") < checked).agg(F.count(F.lit(1)).alias("n_checked"), F.round(alike, 6).alias("agreement"))
    return pairs, told.select(F.lit(counts[0]).cast("long").alias("n_left"), F.lit(counts[1]).cast("long").alias("n_right"), "n_checked", "agreement")
