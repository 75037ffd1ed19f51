"""Personal data, and the terms that give it away; DataFrame functions only.

Protected entities are found by fixed patterns (email, ip, card, phone). How strongly a term t reveals an entity c is
estimated from the corpus: pointwise mutual information of c and t as a share of the information content of c,

    disclosure(c; t) = log(p(c, t) / (p(c) * p(t))) / -log(p(c)),    1 where t never occurs without c.

p counts documents: those that hold c (n_c), t (n_t), or t within REACH characters of c (n_ct), of all N. A term of
a document that reveals one of its entities by REMOVE or more is removed, by GENERALISE or more generalised to the class
of its characters. disclosure >= 1 - 1/k is tested as n_t^k * n_c <= N * n_ct^k, in which no logarithm is rounded. All
occurrences in the documents that hold the entity are treated; a document without entities stays as it is.

Terms are words of letters and digits, TERM characters long at least, with a letter among them, A-Z lower-cased. Words
that touch an entity or lie in one are part of it.

Matches are counted and placed by split() and regexp_extract_all(), which see the same leftmost matches. The patterns
say the same as the plain ones in KINDS, in forms that take time in proportion to the text: a word is entered at its
beginning or where the last match ended, and nothing is tried again. Offsets are running sums over the matches of a text.

What depends on a text alone is worked out once for equal texts, under the text's sha256, and joined back; hot texts,
entities and terms are joined by broadcasts of the hot entries. Only texts with a digit or an @ are searched, only those
with a match are shuffled, and of the others only counts of terms.

Null text is empty. Rows with a null id are answered like others, repeated rows repeatedly, and empty tables give no
rows. Very long texts are searched whole; their matches, not their characters, become rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, joined_back, read_table, stored

#: Kinds in their order, with the plain pattern.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time; of cards and phones at once those with a possible number of digits.
SEARCHED = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": KINDS["phone"],
}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
REACH, TERM = 100, 3
WORD = r"[\p{L}\p{N}]"
#: disclosure of 1 - 1/k: k = 8 is 0.875; removed where nothing is left of the entity's information.
GENERALISE_K = 8
FINDING = "array<struct<kind:string,start:long,end:long>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test: from the right, every second digit counts double, less 9 over 9."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == "ip", match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & luhn(digits))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _texts(docs: DataFrame, id_col: str, text_col: str, hint: str) -> DataFrame:
    """doc_id, _text and _hash, which is null for texts that can hold no entity."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    return slim.withColumn("_hash", F.when(F.col("_text").rlike(hint), F.unhex(F.sha2(F.col("_text").cast("binary"), 256))))


def _matches(texts: DataFrame, searched: list[tuple[Column, Column, Column]], reach: int = 0) -> DataFrame:
    """(_hash, kind, i, last, n, start, match, before, after) of the matches in each text: searched lists (kind, text,
    pattern); n is the number of rows that have the text; before and after are what lies within reach of a match and no
    further than the next match of the kind, and one character more where it goes on; last: none of the kind follows."""
    split = F.array(*(F.struct(k.alias("kind"), F.split(t, p, -1).alias("gaps"), F.regexp_extract_all(t, p, F.lit(0)).alias("found")) for k, t, p in searched))
    # each inner column is worked out once, behind its generator; what follows only reads it
    cut = texts.select("_hash", F.explode(split).alias("s")).filter(F.size("s.found") > 0)
    one = lambda m, i: F.struct(i.alias("i"), (i == F.size("s.found") - 1).alias("last"), F.length(F.get("s.gaps", i)).alias("gap"), F.right(F.get("s.gaps", i), F.lit(reach + 1)).alias("before"), m.alias("match"), F.left(F.get("s.gaps", i + 1), F.lit(reach + 1)).alias("after"))
    rows = cut.select("_hash", "s.kind", F.explode(F.transform("s.found", one)).alias("m")).select("_hash", "kind", "m.*")
    once = rows.groupBy("_hash", "kind", "i").agg(F.count(F.lit(1)).alias("n"), *(F.any_value(c).alias(c) for c in ("last", "gap", "before", "match", "after")))
    so_far = Window.partitionBy("_hash", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return once.select("_hash", "kind", "i", "last", "n", (end - F.length("match")).alias("start"), "match", "before", "after")


def entities(texts: DataFrame, reach: int = REACH) -> DataFrame:
    """Valid base spans of each text: (_hash, kind, start, end, n, value, near), near being the words within reach."""
    searched = [(F.lit(k), F.col("_text"), F.lit(p)) for k, p in SEARCHED.items()]
    found = _matches(texts.filter("_hash IS NOT NULL"), searched, reach).filter(valid(F.col("kind"), F.col("match")))
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(ascii_lower(F.col("match")))
    # words that go on beyond reach, or touch this match or the next one, do not count
    cut = lambda c, beyond, touching, alone: F.when(F.length(c) > reach, F.regexp_replace(c, beyond, "")).when(alone, F.col(c)).otherwise(F.regexp_replace(c, touching, ""))
    first, last = rf"^{WORD}++", rf"(?<!{WORD}){WORD}++\z"
    before = F.regexp_replace(cut("before", f"^(?:{WORD}++|(?s:.))", first, F.col("i") == 0), last, "")
    after = F.regexp_replace(cut("after", rf"(?:(?<!{WORD}){WORD}++|(?s:.))\z", last, F.col("last")), first, "")
    return stored(found.select("_hash", "kind", "start", (F.col("start") + F.length("match")).alias("end"), "n", value.alias("value"), F.array_union(terms(before), terms(after)).alias("near")))


def terms(text: Column) -> Column:
    """Distinct terms: words with TERM characters or more, one of them a letter."""
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(f"{WORD}{{{TERM},}}+"), F.lit(0)))
    return F.filter(words, lambda w: w.rlike(r"\p{L}"))


def raised(x: Column, k: int) -> Column:
    """x to the power k by multiplication alone, so that every engine comes to the same double."""
    half = raised(x, k // 2) if k > 1 else x
    return half if k == 1 else half * half * x if k % 2 else half * half


def disclosing(texts: DataFrame, found: DataFrame, k: int = GENERALISE_K) -> DataFrame:
    """(_hash, term, removed, n): the terms of each text that reveal one of its entities too strongly."""
    n_all = texts.count()
    near = found.groupBy("kind", "value", "_hash").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    near = stored(near)
    pairs = near.select("kind", "value", "_hash", "n", F.explode("near").alias("term"))
    both = pairs.groupBy("kind", "value", "term").agg(F.sum("n").alias("n_ct"))
    of_entity = stored(near.groupBy("kind", "value").agg(F.sum("n").alias("n_c"), F.sum(F.size("near")).alias("n_rows")))
    both = stored(joined_back(both, of_entity, ["kind", "value"], "n_rows", "term"))
    wanted = both.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    often = texts.select(F.explode(terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    known = stored(wanted.join(often, "term").select("term", "n_t", "n_rows"))
    power = lambda c: raised(F.col(c).cast("double"), k)
    told = joined_back(both, known, ["term"], "n_rows", "value")
    told = told.filter((F.col("n_t") <= F.col("n_ct")) | (power("n_t") * F.col("n_c") <= power("n_ct") * n_all))
    told = stored(told.select("kind", "value", "term", (F.col("n_t") <= F.col("n_ct")).alias("removed"), F.col("n_ct").alias("n_rows")))
    met = joined_back(pairs, told, ["kind", "value", "term"], "n_rows", "_hash").filter("removed IS NOT NULL")
    return met.groupBy("_hash", "term").agg(F.max("removed").alias("removed"), F.max("n").alias("n"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, k: int = GENERALISE_K, carry_text: bool = False) -> DataFrame:
    """Per row: doc_id, findings (array of kind, start, end, by kind as listed, generalised and removed terms last, then
    by start), and with carry_text the text as _text."""
    texts = _texts(docs, id_col, text_col, "[0-9@]")
    base = entities(texts, reach)
    hits = stored(disclosing(texts, base, k))
    words = stored(hits.groupBy("_hash").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"), F.max("n").alias("n")))
    held = joined_back(texts.filter("_hash IS NOT NULL"), words, ["_hash"], "n", "doc_id").filter("terms IS NOT NULL")
    pattern = F.concat(F.lit(f"(?<!{WORD})(?:"), F.col("terms"), F.lit(f")(?!{WORD})"))
    low = held.select("_hash", F.explode(F.array(F.struct(ascii_lower(F.col("_text")).alias("t"), pattern.alias("p")))).alias("x"))
    at = _matches(low, [(F.lit("term"), F.col("x.t"), F.col("x.p"))]).withColumnRenamed("match", "term")
    action = F.when(F.col("removed"), "removed").otherwise("generalised")
    added = at.join(hits.select("_hash", "term", "removed"), ["_hash", "term"]).select("_hash", action.alias("kind"), "start", (F.col("start") + F.length("term")).alias("end"), F.col("n"), F.lit(False).alias("base"))
    every = base.select("_hash", "kind", "start", "end", "n", F.lit(True).alias("base")).unionByName(added)
    # a term that shares a character with a base span is part of it
    onward = Window.partitionBy("_hash").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("_hash").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(onward)
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(backward)
    free = F.col("base") | ((F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end")))
    clear = every.withColumn("free", free).filter("free")
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, "generalised", "removed"])), F.col("kind"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    told = stored(clear.groupBy("_hash").agg(spans.alias("findings"), F.max("n").alias("n")))
    rows = texts if carry_text else texts.select("doc_id", "_hash")
    out = joined_back(rows, told, ["_hash"], "n", "doc_id")
    return out.select("doc_id", *(["_text"] if carry_text else []), F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, k: int = GENERALISE_K) -> DataFrame:
    """Per row: doc_id, text with the base spans replaced by their kind in brackets, generalised terms by the class of
    their characters ([word] or [code]) and removed terms by nothing, and findings. Of overlapping spans the one that
    begins first is replaced, and the rest of the others with it."""
    rows = findings(docs, id_col, text_col, reach, k, carry_text=True)
    by_start = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), x["kind"].alias("kind"))))
    ordered = rows.select("*", F.explode(F.array(by_start)).alias("_s"))
    part = lambda a, b: F.substring(F.col("_text"), (a + 1).cast("int"), (b - a).cast("int"))

    def stand_in(x: Column) -> Column:
        term = part(x["start"], -x["last"])
        return F.when(x["kind"] == "removed", "").when(x["kind"] == "generalised", F.when(term.rlike("[0-9]"), "[code]").otherwise("[word]")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))

    def put(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.array_append(acc["out"], F.concat(part(acc["at"], x["start"]), stand_in(x))))
        return F.struct(F.greatest(acc["at"], -x["last"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("_s", start, put, lambda acc: F.concat(F.array_join(acc["out"], ""), part(acc["at"], F.length("_text").cast("long"))))
    return ordered.select("doc_id", done.alias("text"), "findings")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *map(count, [*KINDS, "generalised", "removed"]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_pii": op11_pii}

_RAW = " UNION ALL ".join(f"SELECT row, {i} AS rank, '{kind}' AS kind, text, '{pattern}' AS pattern FROM t" for i, (kind, pattern) in enumerate(KINDS.items()))
_POWER = "(({0}::DOUBLE * {0}) * ({0}::DOUBLE * {0})) * (({0}::DOUBLE * {0}) * ({0}::DOUBLE * {0}))"

#: Tokens with their places stand for the texts between the matches; otherwise the same steps by the plain patterns.
ORACLE_SQL = {
    "op11_pii": rf"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        k AS ({_RAW} UNION ALL SELECT row, 9, 'word', text, '{WORD}+' FROM t),
        c AS (SELECT row, rank, kind, unnest(regexp_extract_all(text, pattern)) AS m, unnest(regexp_split_to_array(text, pattern)) AS gap, unnest(range(len(regexp_extract_all(text, pattern)) + 1)) AS i FROM k),
        p AS MATERIALIZED (
            SELECT row, rank, kind, m, e - length(m) AS s, e FROM (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY row, rank ORDER BY i) AS e FROM c) WHERE m IS NOT NULL
        ), d AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM p WHERE rank < 9),
        r AS (
            SELECT *, lag(e) OVER w AS last_e, lead(s) OVER w AS next_s FROM d WHERE kind <> 'card' OR length(digits) BETWEEN 13 AND 19
            WINDOW w AS (PARTITION BY row, rank ORDER BY s)
        ), base AS MATERIALIZED (
            SELECT row, rank, kind, s, e, last_e, next_s, CASE WHEN kind IN ('card', 'phone') THEN digits ELSE translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS value
            FROM r WHERE CASE kind
                WHEN 'ip' THEN regexp_full_match(m, '{PART}(\.{PART}){{3}}') WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
                WHEN 'card' THEN list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0
                ELSE true END
        ), w AS MATERIALIZED (
            SELECT row, s, e, translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM p WHERE kind = 'word' AND length(m) >= {TERM} AND regexp_matches(m, '\p{{L}}')
        ), near AS MATERIALIZED (
            SELECT DISTINCT b.kind, b.value, b.row, w.term FROM base b JOIN w ON b.row = w.row
            AND ((w.e < b.s AND w.s >= b.s - {REACH} AND (b.last_e IS NULL OR w.s > b.last_e)) OR (w.s > b.e AND w.e <= b.e + {REACH} AND (b.next_s IS NULL OR w.e < b.next_s)))
        ), x AS (
            SELECT kind, value, term, n_ct, n_c, n_t, (SELECT count(*) FROM t) AS n
            FROM (SELECT kind, value, term, count(*) AS n_ct FROM near GROUP BY ALL) JOIN (SELECT kind, value, count(DISTINCT row) AS n_c FROM base GROUP BY ALL) USING (kind, value)
            JOIN (SELECT term, count(DISTINCT row) AS n_t FROM w GROUP BY term) USING (term)
        ), told AS (SELECT kind, value, term, n_t <= n_ct AS removed FROM x WHERE n_t <= n_ct OR {_POWER.format('n_t')} * n_c <= {_POWER.format('n_ct')} * n),
        hits AS (SELECT row, term, max(removed) AS removed FROM near JOIN told USING (kind, value, term) GROUP BY ALL),
        added AS (
            SELECT row, CASE WHEN removed THEN 11 ELSE 10 END AS rank, CASE WHEN removed THEN 'removed' ELSE 'generalised' END AS kind, s, e
            FROM w JOIN hits USING (row, term) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.s < w.e AND b.e > w.s)
        ), every AS (SELECT row, rank, kind, s, e FROM base UNION ALL SELECT * FROM added),
        f AS (
            SELECT row, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in [*KINDS, "generalised", "removed"])},
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 9) AS based, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans
            FROM every GROUP BY row
        )
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in [*KINDS, "generalised", "removed"])}, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN f USING (row)"""
}
