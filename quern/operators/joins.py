"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry that more than one in HOT_SHARE rows has is hot; there are fewer than HOT_SHARE such entries, whatever the data.
HOT_SHARE = 1000
SPREAD = 1 << 16
SMALL_ROWS = 100_000


def joined_back(rows: DataFrame, entries: DataFrame, keys: list[str], n: str, spread: str) -> DataFrame:
    """Left join of rows with entries, one for each key, which have the number n of their rows.

    Hot entries, under HOT_SHARE of them, are broadcast; the rest is joined by shuffle, in which rows of hot entries
    are dealt by `spread` instead of meeting in one task. Nulls in keys meet each other. entries should be checkpointed.
    """
    total = entries.agg(F.sum(n).alias("t")).first()["t"] or 0
    values = [c for c in entries.columns if c not in keys]
    no_key = lambda cs: functools.reduce(lambda a, b: a | b, (F.col(c).isNull() for c in cs))
    meet = [f"_k{i}" for i in range(len(keys))]
    named = entries.select(*(F.col(k).alias(m) for k, m in zip(keys, meet, strict=True)), F.struct(*values).alias("_entry"), ((F.col(n) * HOT_SHARE > total) | no_key(keys)).alias("_hot"))
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, meet, strict=True)))
    dealt = F.when(F.col("_hot").isNotNull() | no_key(keys), 1 + F.pmod(F.xxhash64(spread), F.lit(SPREAD))).otherwise(0)
    out = rows.join(F.broadcast(named.filter("_hot")), same, "left").withColumns({"_found": F.col("_entry"), "_to": dealt}).drop(*meet, "_hot", "_entry")
    rest = named.filter("NOT _hot").withColumn("_at", F.lit(0).cast("long"))
    out = out.join(rest, same & (F.col("_to") == F.col("_at")), "left")
    entry = F.coalesce("_found", "_entry")
    return out.select(*rows.columns, *(entry[v].alias(v) for v in values))


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A broadcast, if counting finds at most `most` rows; else the plain table, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
