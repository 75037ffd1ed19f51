"""Batches and epochs, rules that come as a table, a stream kept up to date, and reading back what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators import training
from quern.session import shared_folder
from quern.sources import io
from quern.sources.io import table
from quern.streaming import first_seen

from .registry import query
from .sql import WORDS

#: Batch size, what fills short rows, and the length of a view.
_SIZE, _PAD, _VIEW = 64, -1, 64


@query(f"""
    WITH t AS (
        SELECT d.doc_id, list_transform(coalesce({WORDS.replace('text', 'd.text')}, []), lambda w: length(w)) AS t, coalesce(e.embedding::DOUBLE[], list_transform(range({_VIEW}), lambda x: 0.0)) AS v
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    ), b AS (SELECT *, (row_number() OVER (ORDER BY len(t), doc_id) - 1) // {_SIZE} AS batch, len(t) AS n FROM t),
    w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM b)
    SELECT batch, width, count(*) AS n_rows, CAST(sum(width - n) AS BIGINT) AS n_pad,
           md5(string_agg(array_to_string(list_concat([doc_id], t, list_transform(range(width - n), lambda x: {_PAD})), ','), ';' ORDER BY n, doc_id)) AS tokens_md5,
           md5(string_agg(array_to_string(list_transform(v, lambda x: floor(256 * x)::BIGINT), ','), ';' ORDER BY n, doc_id)) AS views_md5
    FROM w GROUP BY batch, width""")
def trn_padded_batches(spark, sf_dir):
    """Documents in batches of nearly one length; a row's second view is the vector of its id, zeros where there is none."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.transform(text.word_tokens(F.col("text")), F.length).alias("t"))
    rows = words.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")), "doc_id", "left")
    made = training.padded_batches(rows, "doc_id", "t", _SIZE, _PAD, {"v": _VIEW})
    joined = lambda lists: F.md5(F.array_join(F.transform(lists, lambda x: F.array_join(x, ",")), ";"))
    named = F.zip_with("ids", "tokens", lambda i, t: F.concat(F.array(i), t.cast("array<long>")))
    whole = F.transform("v", lambda x: F.transform(x, lambda y: F.floor(y * 256)))
    n_pad = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.size(F.filter(t, lambda x: x == _PAD)))
    return made.select("batch", F.col("width").cast("long").alias("width"), F.size("ids").cast("long").alias("n_rows"), n_pad.alias("n_pad"), joined(named).alias("tokens_md5"), joined(whole).alias("views_md5"))


_PATIENCE = 7


@query(f"""
    WITH o AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    b AS (SELECT *, max(CASE WHEN before IS NULL OR value < before THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM o),
    s AS (SELECT *, min(CASE WHEN n - last >= {_PATIENCE} THEN n END) OVER (PARTITION BY user_id) AS stop FROM b),
    k AS (SELECT * FROM s WHERE stop IS NULL OR n <= stop)
    SELECT user_id, max(CASE WHEN n = last THEN event_id END) AS best_epoch, min(value) AS best_loss, max(CASE WHEN n = stop THEN event_id END) AS stop_epoch, max(n) AS n_epochs FROM k GROUP BY user_id""")
def trn_stops(spark, sf_dir):
    """Each user's values as a run's losses."""
    return training.stops(table(spark, sf_dir, "events"), "user_id", "event_id", "value", _PATIENCE)


def _nation_rules(spark: SparkSession, sf_dir: str):
    """A rule for each nation's name in its region, and one for any: rules as another table has them."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    own = n.select(F.col("r_name").alias("attribute"), F.col("n_nationkey").alias("order"), F.concat(F.lit(r"\S+#0*(\d+) of ("), "n_name", F.lit(")")).alias("pattern"), F.lit("{2} has {1}").alias("frame"))
    general = spark.range(1).select(F.lit(None).cast("string").alias("attribute"), F.lit(1000).alias("order"), F.lit(r"(\S+) .*").alias("pattern"), F.lit("someone: {x}").alias("frame"))
    return rules.from_table(own.unionByName(general))


_NOTED = """
    p AS (
        SELECT key, name || ' of ' || n_name || CASE WHEN key % 2 = 0 THEN '.' ELSE '' END AS text, r.r_name AS attribute, n_name, x.r_name = r.r_name AS fits
        FROM who JOIN nation ON nationkey = n_nationkey JOIN region x ON x.r_regionkey = n_regionkey JOIN region r ON r.r_regionkey = CASE WHEN key % 5 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END
    )"""


def _noted(spark: SparkSession, sf_dir: str, name: str, prefix: str):
    """Names with their nation as texts; the attribute is the nation's region, for every fifth row the next one."""
    who = table(spark, sf_dir, name).select(F.col(f"{prefix}_{'custkey' if prefix == 'c' else 'suppkey'}").alias("key"), F.col(f"{prefix}_name").alias("name"), F.col(f"{prefix}_nationkey").alias("n_nationkey"))
    at = F.when(F.col("key") % 5 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    rows = who.join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey").withColumn("r_regionkey", at).join(F.broadcast(table(spark, sf_dir, "region")), "r_regionkey")
    return rows.select("key", F.concat("name", F.lit(" of "), "n_name", F.when(F.col("key") % 2 == 0, ".").otherwise("")).alias("text"), F.col("r_name").alias("attribute"))


@query(f"""
    WITH who AS (SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey FROM customer), {_NOTED}
    SELECT key, CASE WHEN fits THEN n_name || ' has ' || key ELSE 'someone: ' || string_split(text, ' ')[1] END AS sentence FROM p""")
def fn_rules_table(spark, sf_dir):
    """A table's rules, compiled to one Column."""
    return _noted(spark, sf_dir, "customer", "c").select("key", rules.compiled(_nation_rules(spark, sf_dir), F.col("text"), F.col("attribute")).alias("sentence"))


@query(f"""
    WITH who AS (SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationkey FROM supplier), {_NOTED}
    SELECT key, 0 AS place, n_name || ' has ' || key AS sentence FROM p WHERE fits
    UNION ALL SELECT key, CASE WHEN fits THEN 1 ELSE 0 END, 'someone: ' || string_split(text, ' ')[1] FROM p""")
def fn_rules_sql(spark, sf_dir):
    """The same rules called from SQL, where every rule that matches gives a row."""
    rules.register(spark, "rule_sentences", _nation_rules(spark, sf_dir))
    return spark.sql("SELECT key, place, sentence FROM {noted}, LATERAL rule_sentences(text, attribute)", noted=_noted(spark, sf_dir, "supplier", "s"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
    SELECT event_type || ':' || user_id AS dedup_key, count(*) AS frequency, arg_min(event_id, {'t': ts, 'e': event_id}) AS first_id, min(ts) AS first_ts FROM events GROUP BY 1""")
def str_first_seen(spark, sf_dir):
    """The events as a stream: frequency and first event of each key, brought up to date and read back."""
    kinds = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    keyed = stream.withColumn("key", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    sink, state = _folder(spark, "stream"), _folder(spark, "state")
    first_seen.start(keyed, sink, state, "key", "ts", ["event_id"]).awaitTermination()
    return first_seen.current(spark, sink).select("dedup_key", "frequency", F.col("first.event_id").alias("first_id"), F.col("first.time").cast("timestamp_ntz").alias("first_ts"))


@query("SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, n_chars FROM documents")
def src_csv(spark, sf_dir):
    """Whole texts, with their quotes and line ends, written as CSV and read back."""
    path = _folder(spark, "csv")
    columns = ["doc_id", "text", "lang", "n_chars"]
    io.write_csv(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars"), path, columns)
    back = io.read_csv(spark, path, "doc_id long, text string, lang string, n_chars long")
    return back.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")


@query("""
    WITH l AS (SELECT doc_id, max(quality) AS quality, 0 AS place FROM labels GROUP BY doc_id UNION ALL SELECT doc_id, 10 + min(toxic), 1 FROM labels WHERE doc_id % 3 = 0 GROUP BY doc_id)
    SELECT doc_id, arg_max(quality, place) AS value FROM l GROUP BY doc_id""")
def src_lookup(spark, sf_dir):
    """Two files of results as one lookup: the later file has the last word."""
    labels, paths = table(spark, sf_dir, "labels"), [_folder(spark, "lookup"), _folder(spark, "lookup")]
    io.write_csv(labels.groupBy("doc_id").agg(F.max("quality").alias("value")), paths[0], ["doc_id", "value"])
    io.write_csv(labels.filter("doc_id % 3 = 0").groupBy("doc_id").agg((F.min("toxic") + 10).alias("value")), paths[1], ["doc_id", "value"])
    return io.read_lookup(spark, paths, "doc_id long, value int", "doc_id")


@query("SELECT 'lang/' || coalesce(lang, 'none') || '/x' AS file, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1")
def src_labelled(spark, sf_dir):
    """Files labelled by the folder that holds them."""
    root = _folder(spark, "labelled")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("lang/"), F.coalesce("lang", F.lit("none")), F.lit("/x")).alias("at"))
    for (at,) in rows.select("at").distinct().collect():  # a folder for each language
        io.write_csv(rows.filter(F.col("at") == at), f"{root}/{at}", ["doc_id"])
    return io.read_labelled(spark, root, "doc_id long", root.removeprefix("file:")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, CAST(doc_id AS VARCHAR) AS sample_id FROM documents")
def src_splits(spark, sf_dir):
    """Splits written as JSON documents of ids and read back."""
    path, m = _folder(spark, "splits"), F.col("doc_id") % 10
    splits = table(spark, sf_dir, "documents").select(F.when(m < 7, "train").when(m < 9, "val").otherwise("test").alias("split"), F.col("doc_id").cast("string").alias("sample_id"))
    io.write_split_document(splits, path)
    return io.read_splits(spark, path)
