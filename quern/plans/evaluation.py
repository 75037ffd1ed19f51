"""Metric queries over assistant turns as predictions and the user turns before them as references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import alignment, metrics
from quern.sources.io import table

from .registry import query
from .sql import METRIC_TOKENS, PAIRS


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("pred"))
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.coalesce("text", F.lit("")).alias("ref"))
    return a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("id"), "conv_id", "pred", "ref")


_GRAMS = f"""
    tk AS (SELECT id, conv_id, {METRIC_TOKENS.format('pred')} AS p, {METRIC_TOKENS.format('ref')} AS r FROM pairs),
    pg AS (SELECT id, n, array_to_string(p[i:i + n - 1], ' ') AS g, count(*) AS tf FROM (SELECT id, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM tk, (VALUES (1), (2), (3), (4)) t(n)) GROUP BY ALL),
    rg AS (SELECT id, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS tf FROM (SELECT id, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM tk, (VALUES (1), (2), (3), (4)) t(n)) GROUP BY ALL)"""


@query(f"""
    WITH {PAIRS}, {_GRAMS}, df AS (SELECT n, g, count(*) AS df FROM rg GROUP BY n, g), tot AS (SELECT count(*) AS t FROM pairs),
    w AS (SELECT id, n, coalesce(pg.tf, 0) * ln((t + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS a, coalesce(rg.tf, 0) * ln((t + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS b
          FROM pg FULL JOIN rg USING (id, n, g) LEFT JOIN df USING (n, g), tot),
    s AS (SELECT id, n, sum(a * b) / ((sqrt(sum(a * a)) + 1e-10) * (sqrt(sum(b * b)) + 1e-10)) AS c FROM w GROUP BY id, n),
    i AS (SELECT id, sum(c) / 4 * 10 AS cider FROM s GROUP BY id)
    SELECT round(avg(coalesce(cider, 0)), 6) AS cider, count(*) AS n_samples FROM pairs LEFT JOIN i USING (id)""")
def met_cider(spark, sf_dir):
    return metrics.cider(pairs(spark, sf_dir)).agg(F.round(F.avg("cider"), 6).alias("cider"), F.count(F.lit(1)).alias("n_samples"))


_BLEU = """
    h AS (SELECT pg.id, pg.n, pg.tf, least(pg.tf, coalesce(rg.tf, 0)) AS hit FROM pg LEFT JOIN rg USING (id, n, g)),
    pn AS (SELECT {k}, n, sum(hit) / sum(tf)::DOUBLE AS p FROM h JOIN grp USING (id) GROUP BY {k}, n),
    l AS (SELECT {k}, sum(len(p)) AS lp, sum(len(r)) AS lr, count(*) AS n_samples FROM tk JOIN grp USING (id) GROUP BY {k}),
    wd AS (SELECT {k}, coalesce(max(p) FILTER (n = 1), 0) AS p1, coalesce(max(p) FILTER (n = 2), 0) AS p2, coalesce(max(p) FILTER (n = 3), 0) AS p3, coalesce(max(p) FILTER (n = 4), 0) AS p4 FROM pn GROUP BY {k})
    SELECT {k}, n_samples, round(p1, 6) AS bleu1, round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN
        CASE WHEN lp > lr THEN 1 ELSE exp(1 - lr / lp::DOUBLE) END * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 6) AS bleu4
    FROM l JOIN wd USING ({k})"""


@query(f"WITH {PAIRS}, {_GRAMS}, grp AS (SELECT id, 'all' AS file FROM pairs), {_BLEU.format(k='file')}")
def met_bleu(spark, sf_dir):
    return metrics.bleu(pairs(spark, sf_dir).withColumn("file", F.lit("all")), "file")


@query(f"WITH {PAIRS}, {_GRAMS}, grp AS (SELECT id, 'model' || conv_id % 7 AS file FROM pairs), {_BLEU.format(k='file')}")
def met_per_file(spark, sf_dir):
    return metrics.bleu(_by_file(pairs(spark, sf_dir)), "file")


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.concat(F.lit("model"), (F.col("conv_id") % 7).cast("string")))


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(text.metric_tokens(F.col("text"))).alias("surface"))


@query(f"""
    WITH {PAIRS}, {_GRAMS}, f AS (SELECT id, 'model' || conv_id % 7 AS file FROM pairs), tot AS (SELECT file, count(*) AS t FROM f GROUP BY file),
    df AS (SELECT file, n, g, count(*) AS df FROM rg JOIN f USING (id) GROUP BY ALL),
    b AS (SELECT id, n, g, coalesce(pg.tf, 0) AS p, coalesce(rg.tf, 0) AS r FROM pg FULL JOIN rg USING (id, n, g)),
    w AS (SELECT id, n, p * ln((t + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS a, r * ln((t + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS b
          FROM b JOIN f USING (id) JOIN tot USING (file) LEFT JOIN df USING (file, n, g)),
    s AS (SELECT id, n, sum(a * b) / ((sqrt(sum(a * a)) + 1e-10) * (sqrt(sum(b * b)) + 1e-10)) AS c FROM w GROUP BY id, n),
    i AS (SELECT id, sum(c) / 4 * 10 AS cider FROM s GROUP BY id),
    known AS (SELECT DISTINCT unnest({METRIC_TOKENS.format("text")}) AS surface FROM benchmark),
    sh AS (SELECT id, count(known.surface) / count(*)::DOUBLE AS share FROM (SELECT id, unnest(p) AS surface FROM tk) LEFT JOIN known USING (surface) GROUP BY id)
    SELECT file, count(*) AS n_samples, round(avg(coalesce(cider, 0)), 4) AS cider, round(avg(share), 4) AS vocab_conf FROM f LEFT JOIN i USING (id) LEFT JOIN sh USING (id) GROUP BY file""")
def met_files_cider_conformity(spark, sf_dir):
    """CIDEr with a group's own document frequencies, and conformity, as the file report has them."""
    return metrics.evaluated(_by_file(pairs(spark, sf_dir)), "file", _surfaces(spark, sf_dir), aligned=False).select("file", "n_samples", "cider", "vocab_conf")


@query()
def met_file_report(spark, sf_dir):
    """All metrics of each file; ROUGE-L has no SQL and is held to the plain recurrence by tests."""
    return metrics.evaluated(_by_file(pairs(spark, sf_dir)), "file", _surfaces(spark, sf_dir))


@query(f"WITH {PAIRS.replace('pairs AS', 'every AS')}, pairs AS (SELECT * FROM every ORDER BY id LIMIT 100), {_GRAMS}, grp AS (SELECT id, 'quick' AS file FROM pairs), {_BLEU.format(k='file')}")
def met_quick_bleu(spark, sf_dir):
    """BLEU of the first 100 rows."""
    return metrics.bleu(pairs(spark, sf_dir).orderBy("id").limit(100).withColumn("file", F.lit("quick")), "file")


@query(f"""
    WITH {PAIRS}, s AS (SELECT DISTINCT unnest({METRIC_TOKENS.format("text")}) AS surface FROM benchmark),
    t AS (SELECT id, unnest({METRIC_TOKENS.format('pred')}) AS surface FROM pairs),
    r AS (SELECT id, count(s.surface) / count(*)::DOUBLE AS share FROM t LEFT JOIN s USING (surface) GROUP BY id)
    SELECT round(avg(share), 6) AS vocab_conf, count(*) AS n_scored FROM r""")
def met_vocab_conf(spark, sf_dir):
    return metrics.vocabulary_conformance(pairs(spark, sf_dir), _surfaces(spark, sf_dir))


@query()
def met_rouge_l(spark, sf_dir):
    """LCS is a dynamic program; tests hold it against the plain recurrence."""
    return metrics.rouge_l(pairs(spark, sf_dir)).select("id", F.round("rouge_l", 6).alias("rouge_l"))


@query(f"""
    WITH {PAIRS}, o AS (SELECT id, list_distinct({METRIC_TOKENS.format('pred')}) AS p, list_distinct({METRIC_TOKENS.format('ref')}) AS r, row_number() OVER (ORDER BY id) AS rn FROM pairs),
    sh AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY md5('42|' || k || '|' || id), id) AS rn FROM o, (SELECT unnest(range(1, 101)) AS k)),
    obs AS (SELECT avg(CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(p, r)) / len(p)::DOUBLE END) AS m FROM o),
    sim AS (SELECT k, avg(CASE WHEN len(sh.p) = 0 THEN 0 ELSE len(list_intersect(sh.p, o.r)) / len(sh.p)::DOUBLE END) AS m FROM o JOIN sh USING (rn) GROUP BY k)
    SELECT round((SELECT m FROM obs), 6) AS observed, round(avg(m), 6) AS shuffled, round(((SELECT m FROM obs) - avg(m)) / stddev_samp(m), 3) AS z FROM sim""")
def met_shuffle_test(spark, sf_dir):
    """Observed token overlap against 100 seeded shuffles of the predictions, as a z score."""
    return metrics.shuffle_test(pairs(spark, sf_dir))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
    p AS (SELECT a.vec_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1)
    SELECT round(avg(c), 6) AS clip_score, count(c) AS n_scored, count(*) - count(c) AS n_missing FROM p""")
def met_embedding_score(spark, sf_dir):
    """Mean cosine of paired vectors; pairs without a partner are counted, not scored."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = e.alias("a").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id", "left")
    c = both.select(text.cosine(F.col("embedding"), F.col("other")).alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("clip_score"), F.count("c").alias("n_scored"), (F.count(F.lit(1)) - F.count("c")).alias("n_missing"))


@query()
def met_meteor(spark, sf_dir):
    """Matches, chunks and score of each pair. The alignment with the fewest chunks is a search that SQL has no form for;
    tests hold it to all alignments of short rows."""
    return alignment.meteor(pairs(spark, sf_dir)).select("id", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


@query("""
    WITH t AS (SELECT vec_id // 10 AS id, vec_id % 10 >= 5 AS is_pred, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    g AS (SELECT DISTINCT id FROM t), df AS (SELECT label, count(DISTINCT id) AS df FROM t WHERE NOT is_pred GROUP BY label),
    w AS (SELECT t.*, ln(((SELECT count(*) FROM g) + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS w FROM t LEFT JOIN df USING (label)),
    s AS (SELECT a.id, a.vec_id AS p, b.vec_id AS r, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM t a JOIN t b ON a.id = b.id AND a.is_pred AND NOT b.is_pred),
    x AS (SELECT id, sum(w * c) / sum(w) AS x FROM (SELECT p AS vec_id, max(c) AS c FROM s GROUP BY p) JOIN w USING (vec_id) GROUP BY id),
    y AS (SELECT id, sum(w * c) / sum(w) AS y FROM (SELECT r AS vec_id, max(c) AS c FROM s GROUP BY r) JOIN w USING (vec_id) GROUP BY id)
    SELECT id, round(coalesce(x, 0), 6) AS precision, round(coalesce(y, 0), 6) AS recall, round(coalesce(2 * x * y / (x + y), 0), 6) AS f1 FROM g LEFT JOIN x USING (id) LEFT JOIN y USING (id)""")
def met_token_match(spark, sf_dir):
    """Vectors of ten ids are the tokens of a prediction and its reference; a token's name is its label."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("id"), (F.col("vec_id") % 10 >= 5).alias("is_pred"), F.struct("vec_id", F.col("label").cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector")).alias("t"))
    side = lambda mine: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("is_pred", "t")), lambda x: x["is_pred"] == mine)), lambda x: F.struct(x["t"]["token"].alias("token"), x["t"]["vector"].alias("vector")))
    made = rows.groupBy("id").agg(side(True).alias("pred"), side(False).alias("ref"))
    return alignment.greedy_match(made).select("id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))
