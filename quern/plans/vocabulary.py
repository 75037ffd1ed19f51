"""Vocabulary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.operators import curate, lexicon, vocab
from quern.sources.io import table

from .registry import query
from .sql import WORDS

_STOP = ", ".join(f"'{w}'" for w in fixed.STOP)
_UNITS = ", ".join(f"'{w}'" for w in fixed.UNITS)
_FIX = text.EXPANSIONS
_MAP = "MAP {" + ", ".join("'{}': '{}'".format(a.replace("'", "''"), b) for a, b in _FIX.items()) + "}"
_VOCAB = rf"""
    v AS (
        SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[a-zàèéìòù'']+'),
            lambda t: coalesce({_MAP}[trim(t, '''')], trim(t, ''''))), lambda t: length(t) > 2 AND NOT regexp_matches(t, '[0-9]') AND t NOT IN ({_UNITS})) AS w
        FROM documents
    ), tok AS (SELECT lang, unnest(w) AS token FROM v), counts AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY lang, token)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.token_counts(table(spark, sf_dir, "documents"), text.word_tokens(F.col("text")), ["lang"])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.token_counts(table(spark, sf_dir, "documents"), text.vocabulary_tokens(F.col("text")), ["lang"])


@query(f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS}) AS token FROM documents) GROUP BY lang, token")
def agg_token_freq(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(r"""
    SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '""" + fixed.SPACE + r"""+'), lambda t: regexp_replace(t, '[^\p{L}\p{N}_]', '', 'g')), lambda t: t <> '')) AS token FROM documents)
    GROUP BY lang, token""")
def agg_split_token_freq(spark, sf_dir):
    """Tokens as parts between white space, with what is no word character taken out of them."""
    return vocab.token_counts(table(spark, sf_dir, "documents"), text.split_tokens(F.coalesce("text", F.lit(""))), ["lang"])


@query(f"WITH {_VOCAB} SELECT lang, token, n FROM counts WHERE n >= 3")
def agg_vocabulary_floor(spark, sf_dir):
    return words(spark, sf_dir).filter("n >= 3")


@query(f"WITH {_VOCAB} SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM counts WHERE n >= 3) WHERE rank <= 200")
def win_topn_tokens(spark, sf_dir):
    return curate.rank_within(words(spark, sf_dir).filter("n >= 3"), ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 200").withColumn("rank", F.col("rank").cast("long"))


@query(f"""
    WITH {_VOCAB}, p AS (SELECT lang, w[i] AS a, w[i + 1] AS b FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM v)),
    g AS (SELECT lang, a || ' ' || b AS bigram, count(*) AS n FROM p WHERE a NOT IN ({_STOP}) AND b NOT IN ({_STOP}) GROUP BY ALL)
    SELECT lang, bigram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, bigram) AS rank FROM g WHERE n >= 3) WHERE rank <= 80""")
def win_topn_bigrams(spark, sf_dir):
    g = vocab.bigram_counts(table(spark, sf_dir, "documents"), text.vocabulary_tokens(F.col("text")), ["lang"], fixed.STOP)
    return curate.rank_within(g.filter("n >= 3"), ["lang"], [F.desc("n"), F.col("bigram")]).filter("rank <= 80").withColumn("rank", F.col("rank").cast("long"))


@query(f"""
    WITH t AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS}) AS token FROM documents) GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM t),
    rest AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r) AS rank FROM top WHERE r <= 60 AND token NOT IN ({_STOP}))
    SELECT lang, token, n, rank FROM rest WHERE rank <= 25""")
def win_stop_after_topn(spark, sf_dir):
    """Stop words leave after the top 60 is taken, so fewer than 25 may remain."""
    top = curate.rank_within(tokens(spark, sf_dir), ["lang"], [F.desc("n"), F.col("token")], "r").filter("r <= 60")
    rest = curate.rank_within(top.filter(~F.col("token").isin(fixed.STOP)), ["lang"], [F.col("r")]).filter("rank <= 25")
    return rest.select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@query(rf"""
    WITH {_VOCAB}, s AS (SELECT lang, left(token, 4) AS stem, token, n FROM counts WHERE n >= 3)
    SELECT lang, stem, CAST(sum(n) AS BIGINT) AS n, string_agg(token, ', ' ORDER BY n DESC, token) AS surfaces FROM s GROUP BY lang, stem""")
def agg_ordered_surfaces(spark, sf_dir):
    rows = words(spark, sf_dir).filter("n >= 3").withColumn("stem", F.left("token", F.lit(4)))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "token")))
    return rows.groupBy("lang", "stem").agg(F.sum("n").alias("n"), F.array_join(F.transform(ordered, lambda x: x["token"]), ", ").alias("surfaces"))


@query(f"""
    WITH {_VOCAB}, lem AS (SELECT * FROM counts WHERE n >= 3)
    SELECT token, count(DISTINCT lang) AS n_langs, string_agg(lang, ',' ORDER BY lang) AS langs, CAST(sum(n) AS BIGINT) AS n
    FROM lem GROUP BY token HAVING count(DISTINCT lang) >= 2""")
def jn_inverse_lookup(spark, sf_dir):
    lem = words(spark, sf_dir).filter("n >= 3").groupBy("token").agg(F.count_distinct("lang").alias("n_langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.sum("n").alias("n"))
    return lem.filter("n_langs >= 2")


@query(f"""
    WITH {_VOCAB}, s AS (SELECT token, count(*) AS n_langs, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY token HAVING count(*) >= 3)
    SELECT token, n_langs, n FROM s ORDER BY n_langs DESC, n DESC, token LIMIT 40""")
def win_shared_lemmas(spark, sf_dir):
    s = words(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n_langs"), F.sum("n").alias("n")).filter("n_langs >= 3")
    return s.orderBy(F.desc("n_langs"), F.desc("n"), "token").limit(40)


@query(f"""
    WITH {_VOCAB}, r AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM counts)
    SELECT rank, max(token) FILTER (lang = 'de') AS de, max(token) FILTER (lang = 'en') AS en, max(token) FILTER (lang = 'es') AS es, max(token) FILTER (lang = 'fr') AS fr
    FROM r WHERE rank <= 30 GROUP BY rank""")
def win_pivot_top(spark, sf_dir):
    r = curate.rank_within(words(spark, sf_dir), ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 30")
    return r.withColumn("rank", F.col("rank").cast("long")).groupBy("rank").pivot("lang", ["de", "en", "es", "fr"]).agg(F.first("token"))


@query("""
    WITH t AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM t WHERE length(token) >= 3)
    SELECT a.lang, a.token AS token_a, b.token AS token_b FROM r a JOIN r b ON a.lang = b.lang AND a.rank < b.rank
    WHERE a.rank <= 120 AND b.rank <= 120 AND abs(length(a.token) - length(b.token)) <= 1 AND levenshtein(a.token, b.token) = 1""")
def jn_edit_distance(spark, sf_dir):
    t = vocab.token_counts(table(spark, sf_dir, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), ["lang"]).filter(F.length("token") >= 3)
    return vocab.edit_pairs(curate.rank_within(t, ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 120"), "lang")


@query(f"""
    WITH {_VOCAB}, c AS (SELECT lang, token, n FROM counts WHERE n >= 3), vowel AS (SELECT unnest(['a', 'e', 'i', 'o']) AS v),
    x AS (SELECT lang, token, n, token || v AS other FROM c, vowel UNION ALL SELECT lang, token, n, left(token, length(token) - 1) || v FROM c, vowel WHERE regexp_matches(token, '[aeio]$'))
    SELECT DISTINCT x.lang, least(x.token, other) AS token_a, greatest(x.token, other) AS token_b, x.n + c.n AS n FROM x JOIN c ON c.lang = x.lang AND c.token = other WHERE x.token <> other""")
def jn_variant_pairs(spark, sf_dir):
    return vocab.variant_pairs(words(spark, sf_dir).filter("n >= 3"), "lang")


@query(f"""
    WITH t AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS}) AS token FROM documents) GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM t WHERE token IN ({_UNITS}) OR regexp_matches(token, '[0-9]'))
    SELECT lang, token, n, rank FROM f WHERE rank <= 30""")
def flt_audit_units(spark, sf_dir):
    f = tokens(spark, sf_dir).filter(F.col("token").isin(fixed.UNITS) | F.col("token").rlike("[0-9]"))
    return curate.rank_within(f, ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 30").withColumn("rank", F.col("rank").cast("long"))


@query(f"""
    WITH t AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS}) AS token FROM documents) GROUP BY ALL),
    f AS (SELECT *, {_MAP}[token] AS expansion, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM t WHERE length(token) <= 3 AND token NOT IN ({_UNITS}) AND NOT regexp_matches(token, '[0-9]'))
    SELECT lang, token, n, expansion, rank FROM f WHERE rank <= 25""")
def flt_audit_short(spark, sf_dir):
    f = tokens(spark, sf_dir).filter((F.length("token") <= 3) & ~F.col("token").isin(fixed.UNITS) & ~F.col("token").rlike("[0-9]"))
    top = curate.rank_within(f, ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 25")
    return top.select("lang", "token", "n", text.lookup(_FIX, F.col("token")).alias("expansion"), F.col("rank").cast("long").alias("rank"))


_STEMS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in fixed.STEMS.items()) + "}"
#: Words with the place where each first appears, as forms and stems.
_FORMS = f"""{_VOCAB}, ps AS (SELECT lang, doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM v),
    wd AS (SELECT lang, token, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first_at FROM ps GROUP BY ALL),
    fm AS (
        SELECT x.lang, x.token, x.n, x.first_at, coalesce(y.token, x.token) AS form FROM wd x LEFT JOIN wd y ON x.lang IS NOT DISTINCT FROM y.lang
        AND y.token = CASE WHEN suffix(x.token, 'ita') THEN left(x.token, length(x.token) - 3) || 'ità' WHEN suffix(x.token, 'it') THEN x.token || 'à' END
    ), st AS (SELECT *, coalesce({_STEMS}[form], form) AS stem FROM fm)"""


def entries(spark: SparkSession, sf_dir: str, by: str = "lang") -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return lexicon.dictionary(lexicon.word_table(rows, text.vocabulary_tokens(F.col("text")), by, "doc_id"), by)


def _first(df: DataFrame, most: int, by: str = "lang") -> DataFrame:
    """The most frequent of each group with 3 occurrences or more, then the first seen."""
    ranked = curate.rank_within(df.filter("n >= 3"), [by], [F.desc("n"), F.col("first_at")]).filter(F.col("rank") <= most)
    return ranked.withColumn("rank", F.col("rank").cast("long")).drop("first_at")


@query(f"""
    WITH {_FORMS}, g AS (SELECT lang, stem, form, sum(n) AS n, min(first_at) AS first_at FROM st WHERE form NOT IN ({_STOP}) AND stem NOT IN ({_STOP}) GROUP BY ALL)
    SELECT lang, stem, CAST(sum(n) AS BIGINT) AS n, string_agg(form, ', ' ORDER BY n DESC, first_at) AS surfaces FROM g GROUP BY lang, stem""")
def agg_stem_surfaces(spark, sf_dir):
    """Accents restored, stop words out: each stem's count and forms."""
    return lexicon.surfaces(entries(spark, sf_dir), "lang", "stem").select("lang", "stem", "n", F.array_join("surfaces", ", ").alias("surfaces"))


@query(f"""
    WITH {_FORMS}, p AS (SELECT lang, doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT lang, doc_id, w, unnest(range(len(w) - 1)) AS i FROM v)),
    g AS (
        SELECT p.lang, x.stem || ' ' || y.stem AS bigram, count(*) AS n, min({{'d': doc_id, 'i': i}}) AS first_at
        FROM p JOIN st x ON p.lang IS NOT DISTINCT FROM x.lang AND a = x.token JOIN st y ON p.lang IS NOT DISTINCT FROM y.lang AND b = y.token
        WHERE x.stem NOT IN ({_STOP}) AND y.stem NOT IN ({_STOP}) GROUP BY ALL
    )
    SELECT lang, bigram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_at) AS rank FROM g WHERE n >= 3) WHERE rank <= 80""")
def win_topn_stem_bigrams(spark, sf_dir):
    pairs = lexicon.stem_bigrams(table(spark, sf_dir, "documents"), text.vocabulary_tokens(F.col("text")), "lang", "doc_id", entries(spark, sf_dir))
    return _first(pairs, 80)


@query()
def win_topn_lemmas(spark, sf_dir):
    """The 200 first lemmas of each lang with their forms. Merging depends on the order of first appearance; a plain
    restatement in the tests holds it."""
    return _first(lexicon.surfaces(entries(spark, sf_dir), "lang", "lemma").withColumn("surfaces", F.array_join("surfaces", ", ")), 200)


@query()
def win_lemmas_in_four(spark, sf_dir):
    """Lemmas that four sources or more have among their first 200; no SQL, as win_topn_lemmas has none."""
    listed = _first(lexicon.surfaces(entries(spark, sf_dir, "source"), "source", "lemma"), 200, "source")
    held = listed.groupBy("lemma").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_list(F.coalesce("source", F.lit("")))), ",").alias("sources"))
    return held.filter("n_sources >= 4").orderBy(F.desc("n_sources"), F.desc("lemma")).limit(40)


@query()
def vocab_merge_inflections(spark, sf_dir):
    """Greedy merging depends on first-seen order and is held by a plain restatement in the tests."""
    seen = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(text.vocabulary_tokens(F.col("text"))).alias("pos", "token"))
    counts = seen.groupBy("lang", vocab.stem(F.col("token")).alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first_at"))
    return vocab.inflections(counts, "lang", ["first_at"])


@query(f"""
    WITH {_VOCAB}, t AS (SELECT lang, token, n, CASE WHEN regexp_matches(token, 'ita$') THEN left(token, length(token) - 3) || 'ità' WHEN regexp_matches(token, 'it$') THEN token || 'à' END AS want FROM counts)
    SELECT t.lang, coalesce(a.token, t.token) AS token, CAST(sum(t.n) AS BIGINT) AS n FROM t LEFT JOIN counts a ON a.lang = t.lang AND a.token = t.want GROUP BY 1, 2""")
def fn_restore_accent(spark, sf_dir):
    return vocab.restored_accents(words(spark, sf_dir), "lang")


@query(f"""
    WITH {_VOCAB}, top AS (SELECT lang, token FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM counts) WHERE r <= 60)
    SELECT lang, doc_id, n_matches, n_lemmas, row_number() OVER (PARTITION BY lang ORDER BY n_matches DESC, doc_id) AS rank FROM (
        SELECT v.lang, v.doc_id, count(top.token) AS n_matches, count(DISTINCT top.token) AS n_lemmas
        FROM v LEFT JOIN (SELECT doc_id, lang, unnest(w) AS token FROM v) u USING (doc_id) LEFT JOIN top ON top.lang = u.lang AND top.token = u.token GROUP BY v.lang, v.doc_id)""")
def jn_vocab_matches(spark, sf_dir):
    """Rows ranked by their matches with the group's vocabulary; those without any come last and are the residual list."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(text.vocabulary_tokens(F.col("text"))).alias("token"))
    top = curate.rank_within(words(spark, sf_dir), ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 60").select("lang", "token")
    found = rows.join(F.broadcast(top), ["lang", "token"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("token").alias("n_lemmas"))
    every = table(spark, sf_dir, "documents").select("lang", "doc_id").join(found, "doc_id", "left").na.fill(0, ["n_matches", "n_lemmas"])
    at = curate.numbered(every, ["lang", F.desc("n_matches"), "doc_id"], by="lang")
    return at.select("lang", "doc_id", "n_matches", "n_lemmas", (F.col("row_id") + 1).alias("rank"))


@query(f"""
    WITH {_VOCAB}, top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM counts), listed AS (SELECT lang, string_agg(token, ', ' ORDER BY r) AS v FROM top WHERE r <= 60 GROUP BY lang)
    SELECT lang, 'Attribute: ' || lang || '. Notes in ' || lang || chr(10) || 'Style: short' || chr(10) || chr(10) || '1. Keep all.' || chr(10) || '2. Invent nothing.' || chr(10) || chr(10) || 'Vocabulary: ' || v || chr(10) || chr(10)
        || 'Phrases: panna cotta, burro fuso' || chr(10) || chr(10) || 'Examples (1):' || chr(10) || '  Given: "legg ' || lang || '"' || chr(10) || '  Wanted: "leggermente ' || lang || '."' AS prompt FROM listed""")
def fn_prompt(spark, sf_dir):
    top = curate.rank_within(words(spark, sf_dir), ["lang"], [F.desc("n"), F.col("token")]).filter("rank <= 60")
    example = F.array(F.struct(F.concat(F.lit("legg "), "lang").alias("given"), F.concat(F.lit("leggermente "), "lang", F.lit(".")).alias("wanted")))
    config = table(spark, sf_dir, "documents").select("lang").distinct().select("lang", F.concat(F.lit("Notes in "), "lang").alias("intro"), F.lit("short").alias("style"), F.array(F.lit("1. Keep all."), F.lit("2. Invent nothing.")).alias("rules"), F.array(F.lit("panna cotta"), F.lit("burro fuso")).alias("phrases"), example.alias("examples"))
    return vocab.system_prompts(top, "lang", config)


@query("""SELECT doc_id, 'Rewrite this note for "' || lang || '" by the rules.' || chr(10) || 'Note: "' || source || '"' || chr(10) || 'Caption:' AS prompt FROM documents""")
def fn_user_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", vocab.user_prompt(F.col("lang"), F.col("source")).alias("prompt"))
