"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import curate, nearest
from quern.sources.io import table

from .registry import query


@query("""
    SELECT d.doc_id, l.quality, l.toxic FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS k FROM documents) d
    LEFT JOIN (SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id END AS k, quality, toxic FROM labels) l ON d.k IS NOT DISTINCT FROM l.k""")
def jn_left_nullsafe(spark, sf_dir):
    """Left outer, many to many; null keys meet null keys. The few distinct build rows of the null key are joined apart
    from the rest, so that all null keys need not meet in one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("k"))
    lab = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("lk"), "quality", "toxic")
    salt = 8
    left = d.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(salt)))
    nulls = lab.filter("lk IS NULL").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    right = lab.filter("lk IS NOT NULL").withColumn("_s", F.lit(None).cast("int")).unionByName(nulls.withColumn("_s", F.col("_s").cast("int")))
    meets = F.col("k").eqNullSafe(F.col("lk")) & F.when(F.col("k").isNull(), F.col("_s")).cast("int").eqNullSafe(F.col("_r"))
    return left.join(right.withColumnRenamed("_s", "_r"), meets, "left").select("doc_id", "quality", "toxic")


@query("""
    SELECT c_custkey, c_name, n_name, r_name, coalesce(nullif(c_nationkey, 0), n_regionkey) AS key_or_region
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def jn_dim_lookup(spark, sf_dir):
    """nation and region have fixed sizes (25 and 5 rows); zero counts as missing in the coalesced key."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce(F.nullif("c_nationkey", F.lit(0)), "n_regionkey").alias("key_or_region"))


@query("""
    WITH p AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, coalesce(text, '') AS pred FROM conversations WHERE role = 'assistant'),
    r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, coalesce(text, '') AS ref FROM documents),
    g AS (SELECT least((SELECT count(*) FROM p), (SELECT count(*) FROM r)) AS n)
    SELECT r.doc_id, CAST(p.i AS BIGINT) AS position, left(lower(trim(pred, ' ')), 25) = left(lower(trim(ref, ' ')), 25) AS agrees FROM p JOIN r USING (i), g WHERE i < n""")
def jn_positional(spark, sf_dir):
    """Rows paired by position; the agreement of their beginnings tells whether the order can be trusted."""
    # only what is compared goes through the range sort
    begins = lambda c: F.left(F.lower(F.btrim(F.coalesce(c, F.lit("")))), F.lit(25))
    p = curate.numbered(table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", begins(F.col("text")).alias("pred")), ["conv_id", "turn"])
    r = curate.numbered(table(spark, sf_dir, "documents").select("doc_id", begins(F.col("text")).alias("ref")), ["doc_id"])
    return p.join(r, "row_id").select("doc_id", F.col("row_id").alias("position"), (F.col("pred") == F.col("ref")).alias("agrees"))


@query("""
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id, e.vec_id AS nn, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 9) AS sim
          FROM q JOIN e ON q.label <> e.label)
    SELECT vec_id, arg_max(nn, (sim, -nn)) AS nearest, round(max(sim), 6) AS similarity FROM s GROUP BY vec_id""")
def jn_knn_cosine(spark, sf_dir):
    """Nearest vector of another label for a stated query set, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return nearest.nearest(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "label", "embedding").select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@query("""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    q AS (SELECT * FROM e WHERE vec_id % 50 = 0), r AS (SELECT * FROM e WHERE label = 0),
    s AS (SELECT q.vec_id, q.label AS own, r.vec_id AS nn, round(list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))), 9) AS sim FROM q JOIN r ON r.vec_id <> q.vec_id)
    SELECT vec_id, arg_max(nn, (sim, -nn)) AS nearest, round(max(sim), 6) AS similarity, own = 0 AS masked FROM s GROUP BY vec_id, own""")
def jn_knn_fallback(spark, sf_dir):
    """Queries whose label all rows share find their nearest among these all the same, and are marked."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("label"), "embedding")
    found = nearest.nearest(rows.filter("vec_id % 50 = 0"), rows.filter("label = 0"), "vec_id", "label", "embedding", fallback=True)
    return found.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"), "masked")


@query("""
    SELECT printf('row%05d', o_orderkey) AS custom_id, count(l_orderkey) AS n_results, count(*) FILTER (l_orderkey IS NULL) AS n_missing
    FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def jn_correlate(spark, sf_dir):
    """Results brought to their requests by id; requests without a result are counted."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    n = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    out = o.join(n, o.o_orderkey == n.l_orderkey, "left")
    return out.select(text.custom_id(F.col("o_orderkey")).alias("custom_id"), F.coalesce("n", F.lit(0)).alias("n_results"), F.when(F.col("n").isNull(), 1).otherwise(0).cast("long").alias("n_missing"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conv FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY role")
def jn_membership(spark, sf_dir):
    c, lab = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return c.join(lab, "conv_id", "left_semi").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_conv"))


@query("""
    SELECT n_nationkey AS key, n_name AS name, 'nation' AS origin, CAST(NULL AS VARCHAR) AS segment FROM nation
    UNION ALL SELECT r_regionkey, r_name, 'region', NULL FROM region
    UNION ALL SELECT c_nationkey, c_name, 'customer', c_mktsegment FROM customer""")
def set_union_all(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("origin"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("origin"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("segment"))
    return n.unionByName(r).unionByName(c, allowMissingColumns=True)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT DISTINCT lang, source FROM documents")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("""
    WITH m AS (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25)
    SELECT l_partkey FROM m ORDER BY l_partkey LIMIT 20""")
def agg_unmapped(spark, sf_dir):
    """Distinct keys without a mapping, sorted, the first 20."""
    m = table(spark, sf_dir, "lineitem").select("l_partkey").subtract(table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey"))
    return m.orderBy("l_partkey").limit(20)
