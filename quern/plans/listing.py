"""Queries for columns, guards, flags, calendars and named baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.operators import curate, sampling, vocab
from quern.sources.io import table

from .notes import NOTES_SQL, alternation, notes
from .registry import query
from .vocabulary import _VOCAB, words


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = replace('4-NOT_SPECIFIED', '_', ' ')")
def flt_attribute(spark, sf_dir):
    return curate.of_attribute(table(spark, sf_dir, "orders"), "o_orderpriority", "4-NOT_SPECIFIED").select("o_orderkey", "o_custkey")


_VIEWS = "v AS (SELECT conv_id, bool_or(role = 'user') AS has_user, bool_or(role = 'system') AS has_system, bool_or(role = 'assistant') AS has_assistant, count(*) AS n FROM conversations GROUP BY conv_id)"


def _views(spark, sf_dir):
    held = (F.bool_or(F.col("role") == r).alias(f"has_{r}") for r in ("user", "system", "assistant"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*held, F.count(F.lit(1)).alias("n"))


@query(f"WITH {_VIEWS} SELECT conv_id, n FROM v WHERE has_system OR has_assistant")
def flt_flags(spark, sf_dir):
    return curate.having_any(_views(spark, sf_dir), "has_system", "has_assistant").select("conv_id", "n")


@query(f"""
    WITH {_VIEWS}, r AS (SELECT conv_id, n, row_number() OVER (PARTITION BY n ORDER BY md5('42|' || conv_id), conv_id) AS rn, count(*) OVER (PARTITION BY n) AS c FROM v WHERE has_user AND has_assistant)
    SELECT conv_id, n, CASE WHEN rn <= greatest(1, floor(c * 0.7::DOUBLE)) THEN 'train' WHEN rn <= greatest(1, floor(c * 0.7::DOUBLE)) + floor(c * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def win_split_both_views(spark, sf_dir):
    """Only entities with both views are split."""
    both = curate.having_any(curate.having_any(_views(spark, sf_dir), "has_user"), "has_assistant")
    return sampling.stratified_split(both.select("conv_id", "n"), "conv_id", "n")


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def flt_known_values(spark, sf_dir):
    """A role that is not known would fail the job."""
    return curate.known_only(table(spark, sf_dir, "conversations"), "role", ["system", "user", "assistant"]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, n_chars AS size, md5(source) AS caption FROM documents")
def prj_switch_and_alias(spark, sf_dir):
    """A column takes another's values, names come from the first alternative at hand, absent columns are left out."""
    docs = table(spark, sf_dir, "documents").withColumn("caption", F.lit("old")).withColumn("caption_sentence", F.md5("source"))
    named = curate.resolved(curate.switched(docs, "caption", "caption_sentence"), {"doc_id": ["id", "doc_id"], "lang": ["lang"], "size": ["n_chars", "size"], "caption": ["caption", "text"]})
    return curate.existing(named, ["doc_id", "bertscore", "lang", "size", "caption"])


_FLAGS = {
    "n_digit": [r"\d"],
    "n_unit": [r"\b\d+\s*(?:mm|cm|%|m)\b"],
    "n_subjective": fixed.SUBJECTIVE,
    "n_colloquial": fixed.COLLOQUIAL,
    "n_dialect": fixed.DIALECT,
    "n_artifact": [r"\.{2,}|!+|\?+|\s{2,}|^\s|\s$"],
}
_ODD = r"[^\p{L}\p{N}_\s,.;:'\-()" + '"]'


@query(f"""
    WITH {NOTES_SQL} SELECT lang, {", ".join(f"count(*) FILTER (regexp_matches(line, '{alternation(p)}')) AS {name}" for name, p in _FLAGS.items())},
        count(*) FILTER (regexp_matches(line, '{_ODD.replace("'", "''")}')) AS n_odd, count(*) FILTER (length(line) BETWEEN 1 AND 7) AS n_short, count(*) FILTER (trim(line, ' ') = lang || ' ' OR trim(line, ' ') = lower(trim(line, ' '))) AS n_unchanged
    FROM notes GROUP BY lang""")
def agg_profile_flags(spark, sf_dir):
    """Nine flags in one pass over the notes."""
    line = F.col("line")
    hits = (F.count_if(text.any_match(line, p)).alias(name) for name, p in _FLAGS.items())
    same = F.btrim(line) == F.lower(F.btrim(line))
    return notes(spark, sf_dir).groupBy("lang").agg(*hits, F.count_if(line.rlike(_ODD)).alias("n_odd"), F.count_if(F.length(line).between(1, 7)).alias("n_short"), F.count_if(same).alias("n_unchanged"))


@query("""
    WITH j AS (SELECT o.o_orderkey, nullif(o.o_custkey % 11, 0) AS dairy, CASE WHEN o.o_orderkey % 13 <> 0 THEN o.o_orderdate END AS day, c.c_custkey FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0)
    SELECT count(*) AS n, count(*) FILTER (dairy IS NULL) AS n_no_dairy, count(*) FILTER (day IS NULL) AS n_no_date, count(*) FILTER (c_custkey IS NULL) AS n_orphan, count(c_custkey) AS n_paired FROM j""")
def agg_missing_keys(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").select(F.nullif(F.col("o_custkey") % 11, F.lit(0)).alias("dairy"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("day"), "c_custkey")
    absent = lambda x, name: F.count_if(F.col(x).isNull()).alias(name)
    return j.agg(F.count(F.lit(1)).alias("n"), absent("dairy", "n_no_dairy"), absent("day", "n_no_date"), absent("c_custkey", "n_orphan"), F.count("c_custkey").alias("n_paired"))


@query("SELECT doc_id, CASE WHEN doc_id % 30 BETWEEN 1 AND 28 THEN strftime(DATE '2018-01-10' + CAST(7 * (doc_id % 30) AS INTEGER), '%Y-%m-%d') END AS session_date FROM documents")
def jn_calendar(spark, sf_dir):
    """Session number to date by a calendar of 28 rows written dd-MM-yyyy; 0 and unknown numbers have no date."""
    calendar = spark.range(1, 29).select(F.col("id").alias("n"), F.date_format(F.date_add(F.lit("2018-01-10").cast("date"), (F.col("id") * 7).cast("int")), "dd-MM-yyyy").alias("written"))
    known = calendar.select("n", F.date_format(F.to_date("written", "dd-MM-yyyy"), "yyyy-MM-dd").alias("session_date"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("doc_id") % 30, F.lit(0)).alias("number"))
    return docs.join(F.broadcast(known), F.col("number") == F.col("n"), "left").select("doc_id", "session_date")


_SIDE = "(SELECT row_number() OVER (ORDER BY {}) - 1 AS i, left(lower(trim(coalesce(text, ''), ' ')), 25) AS t FROM documents)"


@query(f"""
    WITH a AS {_SIDE.format('doc_id')}, b AS {_SIDE.format('n_chars % 2, doc_id')}, p AS (SELECT a.i, a.t = b.t AS same FROM a JOIN b USING (i))
    SELECT 'equal' AS sides, (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM documents) AS n_right, count(*) AS n_checked, round(avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM p WHERE i < 50
    UNION ALL SELECT 'unequal', (SELECT count(*) FROM documents), (SELECT count(*) FROM benchmark), 0, NULL""")
def jn_positional_gate(spark, sf_dir):
    """Agreement over the first 50 pairs; sides that differ in number are not joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("text").alias("a"))
    other = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2).alias("odd"), F.col("text").alias("b"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    equal = curate.positional(docs, ["doc_id"], other, ["odd", "id"], ("a", "b"))[1]
    unequal = curate.positional(docs, ["doc_id"], items, ["item_id"], ("a", "b"))[1]
    return equal.select(F.lit("equal").alias("sides"), "*").unionByName(unequal.select(F.lit("unequal").alias("sides"), "*"))


@query("""
    WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p FROM t)
    SELECT user_id, event_type, round(ln(p), 6) AS beam_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM p) WHERE rank <= 3""")
def win_beams(spark, sf_dir):
    """The three best continuations of each group by log probability."""
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = t.join(t.groupBy("user_id").agg(F.sum("n").alias("all")), "user_id")
    top = sampling.top_beams(p, ["user_id"], F.round(F.log(F.col("n") / F.col("all").cast("double")), 12), [F.col("event_type")], 3)
    return top.select("user_id", "event_type", F.round("beam_score", 6).alias("beam_score"), F.col("rank").cast("long").alias("rank"))


@query("""
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, source) AS hi FROM c),
    d AS (SELECT doc_id, CAST('0x' || left(md5('42|' || doc_id), 15) AS BIGINT) % (SELECT sum(n) FROM c)::BIGINT AS u FROM documents)
    SELECT 'most_frequent' AS baseline, doc_id, (SELECT source FROM c ORDER BY n DESC, source LIMIT 1) AS prediction FROM documents
    UNION ALL SELECT 'weighted', doc_id, source FROM d JOIN s ON d.u >= s.hi - s.n AND d.u < s.hi""")
def smp_named_baselines(spark, sf_dir):
    """Named baselines side by side; one that fails (here: a column that does not exist) leaves the others alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    ways = {
        "most_frequent": lambda: docs.select("doc_id").join(F.broadcast(counts.orderBy(F.desc("n"), "source").limit(1)), F.lit(True)).withColumnRenamed("source", "prediction"),
        "weighted": lambda: sampling.weighted_draw(docs, "doc_id", counts, "source", "n").withColumnRenamed("source", "prediction"),
        "broken": lambda: docs.select("doc_id", F.col("absent").alias("prediction")),
    }
    return sampling.run_named(ways, "doc_id", "prediction")[0]


_STEMS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in fixed.STEMS.items()) + "}"


@query(f"""
    WITH {_VOCAB}, s AS (SELECT lang, coalesce({_STEMS}[token], token) AS stem, token, n FROM counts WHERE n >= 3)
    SELECT lang, stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_surfaces, string_agg(token, ', ' ORDER BY n DESC, token) AS surfaces FROM s GROUP BY lang, stem""")
def agg_surfaces_by_stem(spark, sf_dir):
    rows = words(spark, sf_dir).filter("n >= 3").withColumn("stem", vocab.stem(F.col("token")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "token")))
    return rows.groupBy("lang", "stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_surfaces"), F.array_join(F.transform(ordered, lambda x: x["token"]), ", ").alias("surfaces"))
