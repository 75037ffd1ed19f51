"""Split, sample and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import curate, sampling
from quern.sources.io import table

from .registry import query


@query("""
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, source, CASE WHEN rn <= greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
           WHEN rn <= greatest(1, floor(n * 0.7::DOUBLE)) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def win_strat_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source")


@query("""
    WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r > 5, CASE WHEN r <= 5 THEN lpad(CAST(r AS VARCHAR), 10, '0') ELSE md5('42|' || doc_id) END, doc_id) AS o FROM a)
    SELECT doc_id, lang, r <= 5 AS is_head FROM b WHERE o <= 15""")
def win_strat_sample(spark, sf_dir):
    return sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", "lang", "n_chars", 15)


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 8")
def win_first_k(spark, sf_dir):
    top = curate.rank_within(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")]).filter("rank <= 8")
    return top.withColumn("rank", F.col("rank").cast("long"))


@query("""
    WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p FROM t),
    c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT user_id, event_type, round(p, 6) AS p FROM c WHERE round(before, 9) <= 0.5""")
def win_nucleus(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = t.withColumn("p", F.col("n") / F.sum("n").over(curate.Window.partitionBy("user_id")).cast("double"))
    return sampling.nucleus(p, ["user_id"], "p", [F.desc("p"), F.col("event_type")], 0.5).select("user_id", "event_type", F.round("p", 6).alias("p"))


@query("""
    WITH n AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, item_id, count(*) OVER () AS n FROM benchmark),
    d AS (SELECT doc_id, CAST('0x' || left(md5('7|' || doc_id), 15) AS BIGINT) AS u FROM documents)
    SELECT doc_id, item_id FROM d JOIN n ON d.u % n.n = n.i""")
def smp_uniform(spark, sf_dir):
    """A training row per test row, with replacement: a dense index and an equi join."""
    train = curate.numbered(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"])
    total = train.agg(F.count(F.lit(1)).alias("n"))
    drawn = table(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(total)).withColumn("row_id", sampling.uniform(7, F.col("doc_id"), F.col("n")))
    return drawn.join(train, "row_id").select("doc_id", "item_id")


@query("""
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, source) AS hi FROM c),
    d AS (SELECT doc_id, CAST('0x' || left(md5('42|' || doc_id), 15) AS BIGINT) % (SELECT sum(n) FROM c)::BIGINT AS u FROM documents)
    SELECT doc_id, source FROM d JOIN s ON d.u >= s.hi - s.n AND d.u < s.hi""")
def smp_weighted_range_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.weighted_draw(docs.select("doc_id"), "doc_id", docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n")


@query("SELECT lang, arg_max(source, (n, -rank)) AS source FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY lang, source) GROUP BY lang")
def agg_mode(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return curate.rank_within(n, ["lang"], [F.desc("n"), F.col("source")]).filter("rank = 1").select("lang", "source")
