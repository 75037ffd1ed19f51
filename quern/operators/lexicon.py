"""A vocabulary of lemmas: a rewrite dictionary made on distinct words, and applied to counts of words and word pairs.

A group's words are rewritten in steps: a missing accent is restored where the accented form is attested, the form
becomes its given stem, stop words leave, and inflections of one stem follow their leading form. Each step depends on
the word and its group's vocabulary alone, never on the word's neighbours. So a dictionary with one row for each
(group, word) says everything; a text's words, or their adjacent pairs, are counted first and rewritten afterwards,
which moves distinct words and pairs instead of the text, and keeps adjacency: pairs are made of the text's own words,
stop words included, and those whose stem is a stop word leave then.

Words that a large share of the pairs has are joined by broadcast. The order in which words first appear, which decides
ties and merging, is that of the rows' `order` and the place in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import vocab
from quern.operators.joins import joined_back
from quern.session import checkpointed


def word_table(rows: DataFrame, tokens: Column, by: str, order: str) -> DataFrame:
    """(by, token, n, first_at): how often, and where first, each group has a word."""
    placed = rows.select(F.col(by), F.col(order).alias("_row"), F.posexplode(tokens).alias("_pos", "token"))
    return placed.groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "_pos")).alias("first_at"))


def dictionary(words: DataFrame, by: str) -> DataFrame:
    """(by, token, n, first_at) -> the same with form, stem, and lemma, which is null for stop words."""
    wanted = F.when(F.col("token").endswith("ita"), F.concat(F.expr("left(token, length(token) - 3)"), F.lit("ità"))).when(F.col("token").endswith("it"), F.concat("token", F.lit("à")))
    attested = words.filter(F.col("token").endswith("ità")).select(F.col(by).alias("_by"), F.col("token").alias("_form"))
    met = F.col(by).eqNullSafe(F.col("_by")) & (wanted == F.col("_form"))
    stemmed = words.join(attested, met, "left").withColumn("form", F.coalesce("_form", "token")).drop("_by", "_form")
    stemmed = stemmed.withColumn("stem", vocab.stem(F.col("form")))
    kept = stemmed.filter(~F.col("form").isin(fixed.STOP) & ~F.col("stem").isin(fixed.STOP))
    stems = kept.groupBy(by, F.col("stem").alias("token")).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))
    led = vocab.led_forms(stems, by, ["first_at"]).select(F.col(by).alias("_by"), F.col("token").alias("_stem"), "lemma")
    with_lemma = kept.join(led, F.col(by).eqNullSafe(F.col("_by")) & (F.col("stem") == F.col("_stem"))).drop("_by", "_stem")
    stops = stemmed.filter(F.col("form").isin(fixed.STOP) | F.col("stem").isin(fixed.STOP)).withColumn("lemma", F.lit(None).cast("string"))
    return checkpointed(with_lemma.unionByName(stops))


def surfaces(entries: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, n, first_at, surfaces): the forms of each lemma or stem, the most frequent first, then the first seen."""
    forms = entries.filter("lemma IS NOT NULL").groupBy(by, key, "form").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_at", "form")))
    return forms.groupBy(by, key).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.transform(ordered, lambda x: x["form"]).alias("surfaces"))


def stem_bigrams(rows: DataFrame, tokens: Column, by: str, order: str, entries: DataFrame) -> DataFrame:
    """(by, bigram, n, first_at): adjacent words as stems, without the pairs that have a stop word."""
    many = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_t", F.lit(1), many), F.slice("_t", F.lit(2), many), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    placed = rows.select(F.col(by), F.col(order).alias("_row"), tokens.alias("_t")).select(by, "_row", F.posexplode(pairs).alias("_pos", "p"))
    counted = placed.groupBy(by, "p.a", "p.b").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_row", "_pos")).alias("first_at"))
    for side, other in (("a", "b"), ("b", "a")):
        changed = entries.filter("stem <> token").select(by, F.col("token").alias(side), "stem", "n")
        counted = joined_back(counted, checkpointed(changed), [by, side], "n", other).withColumn(side, F.coalesce("stem", side)).drop("stem", "n")
    named = counted.filter(~F.col("a").isin(fixed.STOP) & ~F.col("b").isin(fixed.STOP))
    return named.groupBy(by, F.concat("a", F.lit(" "), "b").alias("bigram")).agg(F.sum("_n").alias("n"), F.min("first_at").alias("first_at"))
