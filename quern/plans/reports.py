"""The assembled reports, as ordered lines: (section, at, line). Numbers are counted in Spark; a report's lines are
aggregates, some for each language, and io.write_lines() puts them in one file."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.operators import curate, lexicon, vocab
from quern.sources.io import table

from .registry import query
from .sql import PREPARED, WORDS
from .vocabulary import _FORMS, _STOP, _first, entries

#: Rows of the token lists, and how many of the most frequent are looked at for them.
_TOKENS, _LOOKED_AT = 25, 60


def _lines(section: str, df: DataFrame, order: list[Column | str], line: Column) -> DataFrame:
    """A section's rows as lines, numbered from 0 in their order; sections are aggregates of few rows."""
    at = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order)) - 1
    return df.select(F.lit(section).alias("section"), at.cast("long").alias("at"), line.alias("line"))


def tenths(n: Column, d: Column) -> Column:
    """n / d with one decimal, rounded half up in whole numbers."""
    t = F.floor((20 * n + d) / (2 * d))
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def length_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, min, p25, med, p75, max, total): of n sorted values those at n/4, n/2 and 3n/4, from the counts of the
    distinct values, so that no group's values are ever one list."""
    sizes = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(by).orderBy(value)
    run = sizes.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda rank: F.min(F.when(F.col("upto") > F.expr(rank), F.col(value)))
    return run.groupBy(by, "n").agg(F.min(value).alias("min"), at("n div 4").alias("p25"), at("n div 2").alias("med"), at("3 * n div 4").alias("p75"), F.max(value).alias("max"), F.sum(F.col(value) * F.col("c")).alias("total"))


_STATS_SQL = "printf('%-30s n=%d min=%d p25=%d med=%d p75=%d max=%d mean=%s', coalesce(lang, ''), n, s[1], s[n // 4 + 1], s[n // 2 + 1], s[3 * n // 4 + 1], s[n], ((20 * total + n) // (2 * n) // 10) || '.' || ((20 * total + n) // (2 * n) % 10))"


def _stats_line() -> Column:
    return F.format_string("%-30s n=%d min=%d p25=%d med=%d p75=%d max=%d mean=%s", F.coalesce("lang", F.lit("")), "n", "min", "p25", "med", "p75", "max", tenths(F.col("total"), F.col("n")))


@query(f"""
    WITH {PREPARED}, kept AS (SELECT lang, length(norm) AS chars, len(regexp_extract_all(lower(norm), '[\\p{{L}}\\p{{N}}_'']+')) AS words FROM prepared WHERE drop_reason IS NULL),
    c AS (SELECT count(*) AS n, count(*) FILTER (drop_reason IS NULL) AS k, count(*) FILTER (drop_reason = 'empty') AS e, count(*) FILTER (drop_reason = 'meta') AS m, count(*) FILTER (drop_reason = 'short') AS s FROM prepared),
    f AS (SELECT unnest([{{'at': 0, 'line': 'input rows  : ' || n}}, {{'at': 1, 'line': 'output rows : ' || k || '  (' || CASE WHEN n = 0 THEN '0.0' ELSE ((2000 * k + n) // (2 * n) // 10) || '.' || ((2000 * k + n) // (2 * n) % 10) END || '%)'}},
        {{'at': 2, 'line': 'dropped empty/null  : ' || e}}, {{'at': 3, 'line': 'dropped meta-notes  : ' || m}}, {{'at': 4, 'line': 'dropped too-short   : ' || s}}]) AS x FROM c),
    l AS (SELECT lang, count(*) AS n, list(chars ORDER BY chars) AS s, sum(chars)::BIGINT AS total FROM kept GROUP BY lang),
    t AS (SELECT lang, count(*) AS n, list(words ORDER BY words) AS s, sum(words)::BIGINT AS total FROM kept GROUP BY lang),
    w AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS.replace('text', 'norm')}) AS token FROM prepared WHERE drop_reason IS NULL) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM w QUALIFY r <= {_LOOKED_AT}),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r) AS k FROM r WHERE token NOT IN ({_STOP}) QUALIFY k <= {_TOKENS})
    SELECT '1 rows' AS section, x['at']::BIGINT AS at, x['line'] AS line FROM f
    UNION ALL SELECT '2 kept rows by language', row_number() OVER (ORDER BY n DESC, lang) - 1, printf('%-30s %6d', coalesce(lang, ''), n) FROM l
    UNION ALL SELECT '3 length in characters', row_number() OVER (ORDER BY lang) - 1, {_STATS_SQL} FROM l
    UNION ALL SELECT '4 length in tokens', row_number() OVER (ORDER BY lang) - 1, {_STATS_SQL} FROM t
    UNION ALL SELECT '5 most frequent tokens', row_number() OVER (ORDER BY lang, k) - 1, printf('%-10s %5d  %s', coalesce(lang, ''), n, token) FROM q""")
def rpt_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleaning kept and dropped, lengths, and the tokens of what was kept."""
    rows = curate.prepared(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    reasons = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("drop_reason").isNull()).alias("k"), *(F.count_if(F.col("drop_reason") == r).alias(r) for r in ("empty", "meta", "short")))
    share = F.when(F.col("n") == 0, "0.0").otherwise(tenths(100 * F.col("k"), F.col("n")))
    told = F.array(
        F.format_string("input rows  : %d", "n"),
        F.format_string("output rows : %d  (%s%%)", "k", share),
        F.format_string("dropped empty/null  : %d", "empty"),
        F.format_string("dropped meta-notes  : %d", "meta"),
        F.format_string("dropped too-short   : %d", "short"),
    )
    head = reasons.select(F.lit("1 rows").alias("section"), F.posexplode(told).alias("at", "line")).withColumn("at", F.col("at").cast("long"))
    kept = curate.once(rows.filter("drop_reason IS NULL").select("lang", "norm"), "w", text.word_tokens(F.col("norm"))).select("lang", F.length("norm").alias("chars"), F.size("w").alias("words"), "w")
    by_lang, lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), F.coalesce("lang", F.lit(""))
    counts = vocab.token_counts(kept, F.col("w"), ["lang"])
    top = curate.rank_within(counts, ["lang"], [F.desc("n"), F.col("token")], "r").filter(F.col("r") <= _LOOKED_AT)
    listed = curate.rank_within(top.filter(~F.col("token").isin(fixed.STOP)), ["lang"], [F.col("r")], "k").filter(F.col("k") <= _TOKENS)
    by = F.asc_nulls_last("lang")
    parts = [
        head,
        _lines("2 kept rows by language", by_lang, [F.desc("n"), by], F.format_string("%-30s %6d", lang, "n")),
        _lines("3 length in characters", length_stats(kept, "lang", "chars"), [by], _stats_line()),
        _lines("4 length in tokens", length_stats(kept, "lang", "words"), [by], _stats_line()),
        _lines("5 most frequent tokens", listed, [by, "k"], F.format_string("%-10s %5d  %s", lang, "n", "token")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


# DuckDB's levenshtein counts bytes, so that each accented letter is given one of its own
@query(f"""
    WITH {_FORMS}, k AS (SELECT * FROM st WHERE form NOT IN ({_STOP}) AND stem NOT IN ({_STOP})), g AS (SELECT lang, stem, form, sum(n) AS n, min(first_at) AS first_at FROM k GROUP BY ALL),
    s AS (SELECT lang, stem, sum(n)::BIGINT AS n, string_agg(form, ', ' ORDER BY n DESC, first_at) AS surfaces, min(first_at) AS first_at FROM g GROUP BY lang, stem HAVING sum(n) >= 3),
    top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_at) AS rank FROM s QUALIFY rank <= 200),
    short AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank) AS k FROM top WHERE length(stem) <= 3 QUALIFY k <= 25),
    near AS (
        SELECT a.lang, a.n + b.n AS n, a.stem AS a, b.stem AS b FROM top a JOIN top b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rank < b.rank
        WHERE abs(length(a.stem) - length(b.stem)) <= 1 AND levenshtein(translate(a.stem, 'àèéìòù', 'AEFIOU'), translate(b.stem, 'àèéìòù', 'AEFIOU')) = 1
        QUALIFY row_number() OVER (PARTITION BY a.lang ORDER BY a.n + b.n DESC, a.stem, b.stem) <= 20
    )
    SELECT '1 very short' AS section, row_number() OVER (ORDER BY lang, k) - 1 AS at, printf('%-10s %6d  %-20s  surfaces: %s', coalesce(lang, ''), n, stem, surfaces) AS line FROM short
    UNION ALL SELECT '2 one letter apart', row_number() OVER (ORDER BY lang, n DESC, a, b) - 1, printf('%-10s %6d  %s = %s', coalesce(lang, ''), n, a, b) FROM near
    UNION ALL SELECT '3 first of each language', row_number() OVER (ORDER BY rank, lang) - 1, printf('%3d %-10s %s(%d)', rank, coalesce(lang, ''), stem, n) FROM top WHERE rank <= 30""")
def rpt_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a vocabulary's first 200 stems: short ones, pairs a letter apart, the first of each language."""
    top = _first(lexicon.surfaces(entries(spark, sf_dir), "lang", "stem"), 200)
    short = curate.rank_within(top.filter(F.length("stem") <= 3), ["lang"], [F.col("rank")], "k").filter("k <= 25")
    ranked = top.select("lang", F.col("stem").alias("token"), "rank")
    pairs = vocab.edit_pairs(ranked, "lang")
    n = lambda side: top.select(F.col("lang").alias(f"_l{side}"), F.col("stem").alias(f"token_{side}"), F.col("n").alias(f"n_{side}"))
    for side in "ab":  # at most 200 stems a language
        pairs = pairs.join(F.broadcast(n(side)), f"token_{side}").filter(F.col("lang").eqNullSafe(F.col(f"_l{side}"))).drop(f"_l{side}")
    near = curate.rank_within(pairs.withColumn("n", F.col("n_a") + F.col("n_b")), ["lang"], [F.desc("n"), F.col("token_a"), F.col("token_b")], "k").filter("k <= 20")
    lang, by = F.coalesce("lang", F.lit("")), F.asc_nulls_last("lang")
    parts = [
        _lines("1 very short", short, [by, "k"], F.format_string("%-10s %6d  %-20s  surfaces: %s", lang, "n", "stem", F.array_join("surfaces", ", "))),
        _lines("2 one letter apart", near, [by, F.desc("n"), "token_a", "token_b"], F.format_string("%-10s %6d  %s = %s", lang, "n", "token_a", "token_b")),
        _lines("3 first of each language", top.filter("rank <= 30"), ["rank", by], F.format_string("%3d %-10s %s(%d)", "rank", lang, "stem", "n")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)
