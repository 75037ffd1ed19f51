"""Profile, measure and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import curate
from quern.sources.io import table

from .registry import query


@query(r"""
    SELECT lang, count(*) AS n, count(DISTINCT nullif(text, '')) AS n_unique, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, round(avg(length(coalesce(text, ''))), 1) AS avg_len, max(length(coalesce(text, ''))) AS max_len,
           count(*) FILTER (regexp_matches(text, '[0-9]')) AS n_digit, count(*) FILTER (regexp_matches(text, '(?i)[0-9]+\s*(mm|cm|%|m)([^a-zA-Z0-9]|$)')) AS n_unit,
           count(*) FILTER (regexp_matches(text, '\.{2,}|!+|\?+|\s{2,}|^\s|\s$')) AS n_artifact
    FROM documents GROUP BY lang""")
def agg_profile(spark, sf_dir):
    hit = lambda p, name: F.count_if(F.col("text").rlike(p)).alias(name)
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("text") != "", F.md5("text"))).alias("n_unique"), F.count_if(F.btrim(t) == "").alias("n_empty"),
        F.round(F.avg(F.length(t)), 1).alias("avg_len"), F.max(F.length(t)).cast("long").alias("max_len"), hit("[0-9]", "n_digit"),
        hit(r"(?i)[0-9]+\s*(mm|cm|%|m)([^a-zA-Z0-9]|$)", "n_unit"), hit(r"\.{2,}|!+|\?+|\s{2,}|^\s|\s$", "n_artifact"),
    )


@query("""
    WITH m AS (SELECT lang, source, avg(n_chars) AS x FROM documents GROUP BY ALL)
    SELECT lang, source, round((x - min(x) OVER (PARTITION BY lang)) / (max(x) OVER (PARTITION BY lang) - min(x) OVER (PARTITION BY lang) + 1e-9), 6) AS scaled FROM m""")
def agg_minmax(spark, sf_dir):
    m = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("x"))
    w = curate.Window.partitionBy("lang")
    return m.select("lang", "source", F.round((F.col("x") - F.min("x").over(w)) / (F.max("x").over(w) - F.min("x").over(w) + 1e-9), 6).alias("scaled"))


@query("""
    WITH f AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'baselines/' || source ELSE source END || '/' || lang AS file, n_chars FROM documents)
    SELECT CASE WHEN split_part(file, '/', 1) = 'baselines' THEN split_part(file, '/', 2) ELSE split_part(file, '/', 1) END AS model, lang AS attribute, round(avg(n_chars), 4) AS mean_value FROM f GROUP BY ALL""")
def agg_macro_mean(spark, sf_dir):
    """Means by the labels parsed from a path."""
    docs = table(spark, sf_dir, "documents")
    file = F.concat_ws("/", F.when(F.col("doc_id") % 3 == 0, "baselines"), "source", "lang")
    p = docs.select(F.split(file, "/").alias("p"), "n_chars")
    model = F.when(F.col("p")[0] == "baselines", F.col("p")[1]).otherwise(F.col("p")[0])
    return p.groupBy(model.alias("model"), F.element_at("p", -1).alias("attribute")).agg(F.round(F.avg("n_chars"), 4).alias("mean_value"))


@query("SELECT d.lang, count(*) AS n_total, count(l.doc_id) AS n_paired, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS rate, count(*) - count(l.doc_id) AS n_orphan FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def agg_pairing_rate(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n_total"), F.count("hit").alias("n_paired"), F.round(F.count("hit") / F.count(F.lit(1)).cast("double"), 6).alias("rate"), (F.count(F.lit(1)) - F.count("hit")).alias("n_orphan"))


@query("""
    SELECT conv_id, arg_min(md5(text), turn) FILTER (role = 'user' AND text <> '') AS first_user, arg_min(md5(text), turn) FILTER (role = 'assistant' AND text <> '') AS first_assistant FROM conversations GROUP BY conv_id""")
def agg_view_first(spark, sf_dir):
    """Per entity the first non-empty value of each view."""
    c = table(spark, sf_dir, "conversations").filter("text <> ''").groupBy("conv_id").agg(*(F.min(F.when(F.col("role") == r, F.struct("turn", F.md5("text").alias("h")))).alias(f"_{r}") for r in ("user", "assistant")))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return every.join(c, "conv_id", "left").select("conv_id", F.col("_user.h").alias("first_user"), F.col("_assistant.h").alias("first_assistant"))


@query("""
    WITH v AS (SELECT conv_id, bool_or(role = 'user') AS u, bool_or(role = 'system') AS s FROM conversations GROUP BY conv_id)
    SELECT count(*) FILTER (u AND s) AS both_views, count(*) FILTER (u AND NOT s) AS user_only, count(*) FILTER (s AND NOT u) AS system_only, count(*) FILTER (NOT u AND NOT s) AS neither FROM v""")
def agg_view_coverage(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "user").alias("u"), F.bool_or(F.col("role") == "system").alias("s"))
    return v.agg(F.count_if(F.col("u") & F.col("s")).alias("both_views"), F.count_if(F.col("u") & ~F.col("s")).alias("user_only"), F.count_if(F.col("s") & ~F.col("u")).alias("system_only"), F.count_if(~F.col("u") & ~F.col("s")).alias("neither"))


@query("SELECT l_orderkey, l_returnflag, min(l_linenumber) AS l_linenumber, arg_min(l_quantity, (l_linenumber, l_quantity)) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_returnflag")
def agg_keep_first(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min(F.struct("l_linenumber", "l_quantity")).alias("f"))
    return g.select("l_orderkey", "l_returnflag", "f.l_linenumber", "f.l_quantity")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1), 4) AS weighted_price FROM lineitem GROUP BY l_returnflag")
def agg_weighted_mean(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * q) / F.greatest(F.sum(q), F.lit(1.0)), 4).alias("weighted_price"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_totalprice IS NULL) AS n_null, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS match_rate FROM orders GROUP BY o_orderpriority")
def agg_tally(spark, sf_dir):
    done = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_totalprice").isNull()).alias("n_null"), F.round(F.avg(done), 6).alias("match_rate"))


@query("SELECT lang, count(DISTINCT source) AS n_sources, count(*) AS frequency FROM documents GROUP BY lang ORDER BY lang, frequency DESC")
def srt_composite(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("frequency")).orderBy("lang", F.desc("frequency"))


@query(r"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang,
           CASE WHEN regexp_extract(url, '/([0-9]+)', 1) = '' THEN NULL ELSE CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) END AS number, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def fn_url_parse(spark, sf_dir):
    get = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", get("^([a-z]+)://").alias("scheme"), get("^[a-z]+://([^/?#]+)").alias("host"), get("^[a-z]+://[^/]+/([a-z]{2})/").alias("lang"), F.nullif(get("/([0-9]+)"), F.lit("")).cast("int").alias("number"), get(r"\?([^#]*)").alias("query"))


@query("""
    SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 8 THEN 'Molto sottile' WHEN l_quantity < 10 THEN 'Sottile' WHEN l_quantity < 14 THEN 'Media' WHEN l_quantity < 18 THEN 'Spessa' ELSE 'Molto spessa' END AS bucket FROM lineitem) GROUP BY bucket""")
def fn_bin(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(text.capitalize(text.thickness(F.col("l_quantity"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE ELSE p_size END AS v, p_partkey % 3 AS u FROM part),
    x AS (SELECT p_partkey, CASE WHEN u = 0 THEN v * 10 WHEN u = 1 THEN v WHEN v < 5 THEN v * 10 ELSE v END AS mm FROM m)
    SELECT p_partkey, CASE WHEN mm < 8 THEN 'Molto sottile' WHEN mm < 10 THEN 'Sottile' WHEN mm < 14 THEN 'Media' WHEN mm < 18 THEN 'Spessa' ELSE 'Molto spessa' END AS thickness FROM x""")
def fn_measure(spark, sf_dir):
    """Measurements written as text (cm with a decimal comma, mm, or bare) and parsed back to a thickness word."""
    size = F.col("p_size")
    written = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace((size / 10.0).cast("string"), F.lit("."), F.lit(",")), F.lit(" cm"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Circa "), size.cast("string"), F.lit(" mm"))).otherwise(size.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.measured_thickness(written).alias("thickness"))


@query("""
    SELECT o_orderkey, CASE WHEN n = '' THEN 'unknown' ELSE n END AS sample_id FROM (
        SELECT o_orderkey, trim(coalesce(o_orderstatus, '') || '__' || coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') || '__P' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END, '_') AS n FROM orders)""")
def fn_sample_id(spark, sf_dir):
    slot = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.sample_id(F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), slot, F.lit(None)).alias("sample_id"))


@query("SELECT p_partkey, replace(p_type, ' ', '_') AS slug, replace(p_name || '/' || p_brand, '/', '__') AS flat_name, printf('row%05d', p_partkey) AS custom_id, CAST(replace(replace(CAST(p_retailprice AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) AS price FROM part")
def fn_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    written = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    return p.select("p_partkey", text.slug(F.col("p_type")).alias("slug"), text.flat_name(F.concat_ws("/", "p_name", "p_brand")).alias("flat_name"), text.custom_id(F.col("p_partkey")).alias("custom_id"), text.decimal_comma(written).alias("price"))


@query("""
    SELECT doc_id, 'images/2020-2021/' || (doc_id % 28 + 1) || '°Seduta_' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '-03-2021/P' || (doc_id % 9) || 'a_TN_' || (300 + doc_id % 50) || '_FETTA.bmp' AS image_path,
           '2021-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS session_date, CAST(doc_id % 28 + 1 AS INTEGER) AS session_num_img, CAST(doc_id % 9 AS INTEGER) AS panel_slot, 'a' AS panel_replicate, 'TN_' || (300 + doc_id % 50) AS dairy_id, 'Fetta' AS view FROM documents""")
def fn_path_parse(spark, sf_dir):
    d = F.col("doc_id")
    path = F.concat(F.lit("images/2020-2021/"), (d % 28 + 1).cast("string"), F.lit("°Seduta_"), F.lpad((d % 28 + 1).cast("string"), 2, "0"), F.lit("-03-2021/P"), (d % 9).cast("string"), F.lit("a_TN_"), (d % 50 + 300).cast("string"), F.lit("_FETTA.bmp"))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("image_path"))
    got = text.parse_image_path(F.col("image_path"))
    return rows.select("doc_id", "image_path", *(got[c].alias(c) for c in ("session_date", "session_num_img", "panel_slot", "panel_replicate", "dairy_id", "view")))


_ROMAN = "I II III IV V VI".split()


@query(f"""
    WITH d AS (SELECT doc_id, doc_id % 4 AS kind, lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day, lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS month, {_ROMAN}[doc_id % 6 + 1] AS bimester, 300 + doc_id % 50 AS dairy FROM documents)
    SELECT doc_id, CASE kind WHEN 3 THEN NULL ELSE '2021-' || month || '-' || day END AS session_date, CASE WHEN kind = 2 THEN CAST(doc_id % 28 + 1 AS INTEGER) END AS session_num_img,
           CASE WHEN kind IN (0, 2) THEN bimester END AS bimester_img, CASE WHEN kind = 1 THEN 7 END AS panel_slot, CASE WHEN kind = 1 THEN 'b' END AS panel_replicate,
           CASE WHEN kind < 3 THEN 'TN_' || dairy END AS dairy_id, CASE kind WHEN 0 THEN 'Grana' WHEN 1 THEN 'Fetta' WHEN 2 THEN 'Grana' END AS view FROM d""")
def fn_path_layouts(spark, sf_dir):
    """Paths of several layouts: dates year or day first, by dashes or underscores, bimesters, grana views, and none of it."""
    d = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day, month, dairy = two(d % 28 + 1), two(d % 12 + 1), (d % 50 + 300).cast("string")
    bimester = F.element_at(F.array(*map(F.lit, _ROMAN)), (d % 6 + 1).cast("int"))
    kinds = [
        F.concat(F.lit("2021/"), bimester, F.lit(" Bimestre/2021_"), month, F.lit("_"), day, F.lit("/"), dairy, F.lit(" grana.bmp")),
        F.concat(F.lit("2021/prove/2021-"), month, F.lit("-"), day, F.lit("/P7B_TN"), dairy, F.lit("_fetta.BMP")),
        F.concat(F.lit("2021/"), (d % 28 + 1).cast("string"), F.lit(" seduta "), F.lower(bimester), F.lit(" bimestre/"), day, F.lit("_"), month, F.lit("_2021/x_TN_"), dairy, F.lit("_GRANA.bmp")),
        F.concat(F.lit("varie/foto"), d.cast("string"), F.lit("x.bmp")),
    ]
    path = F.element_at(F.array(*kinds), (d % 4 + 1).cast("int"))
    got = text.parse_image_path(F.col("image_path"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("image_path")).select("doc_id", *(got[c].alias(c) for c in ("session_date", "session_num_img", "bimester_img", "panel_slot", "panel_replicate", "dairy_id", "view")))


@query("""
    SELECT lang, n, round(100.0::DOUBLE * n_bad / n, 4) AS bad_pct, CASE WHEN 100.0::DOUBLE * n_bad / n <= 20 THEN 'ok' ELSE 'warn' END AS status
    FROM (SELECT lang, count(*) AS n, count(*) FILTER (quality = 0) AS n_bad FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def met_gate(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    g = j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("bad"))
    share = text.percent(F.col("bad"), F.col("n"))
    return g.select("lang", "n", F.round(share, 4).alias("bad_pct"), F.when(share <= 20, "ok").otherwise("warn").alias("status"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE role IN ('user', 'system') AND coalesce(trim(text), '') <> 'N/A' AND coalesce(CAST(turn AS VARCHAR), role, text) IS NOT NULL")
def flt_placeholder(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    some = F.coalesce(F.col("turn").cast("string"), "role", "text").isNotNull()
    return c.filter(F.col("role").isin("user", "system") & (F.coalesce(F.btrim("text"), F.lit("")) != "N/A") & some).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, list(md5(coalesce(text, '')) ORDER BY turn)[1:5] AS turns FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) GROUP BY conv_id")
def srt_truncate(spark, sf_dir):
    """Lists cut to their first five entries; the cut is made before the lists are built."""
    c = curate.rank_within(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], "r").filter("r <= 5")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5(F.coalesce("text", F.lit(""))).alias("h")))).alias("t")).select("conv_id", F.transform("t", lambda x: x["h"]).alias("turns"))
