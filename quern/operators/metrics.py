"""Corpus metrics over (id, pred, ref) rows, in relational form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text
from quern.operators import alignment, curate, grams
from quern.operators import shuffles as shuffles_of
from quern.operators.joins import small
from quern.session import checkpointed


def _grams(pairs: DataFrame, column: str, most: int, keys: list[str]) -> DataFrame:
    """(keys, id, n, gram, tf) of a column's metric tokens."""
    tokens = pairs.select(*keys, "id", text.metric_tokens(F.col(column)).alias("_t"))
    lists = F.array(*(F.struct(F.lit(n).alias("n"), text.ngrams(F.col("_t"), n).alias("g")) for n in range(1, most + 1)))
    exploded = tokens.select(*keys, "id", F.explode(lists).alias("x")).select(*keys, "id", "x.n", F.explode("x.g").alias("gram"))
    return exploded.groupBy(*keys, "id", "n", "gram").agg(F.count(F.lit(1)).alias("tf"))


def cider(pairs: DataFrame, by: str | None = None, most: int = 4) -> DataFrame:
    """Per id: mean over 1..most of the tf-idf cosine, times 10; idf = ln((N + 1) / (df + 1)), df over the references of
    the group."""
    return grams.scored(pairs, by, most).select("id", *([by] if by else []), "cider")


def bleu(pairs: DataFrame, by: str | None = None, most: int = 4, digits: int = 6) -> DataFrame:
    """Corpus BLEU by group: bleu1 is the clipped unigram precision without brevity penalty, bleu4 the usual score."""
    keys = [by] if by else []
    pred, ref = _grams(pairs, "pred", most, keys), _grams(pairs, "ref", most, keys)
    hits = pred.withColumnRenamed("tf", "p").join(ref.withColumnRenamed("tf", "r"), [*keys, "id", "n", "gram"], "left")
    per_n = hits.groupBy(*keys, "n").agg(F.sum(F.least("p", F.coalesce("r", F.lit(0)))).alias("hit"), F.sum("p").alias("tf"))
    lens = pairs.select(*keys, F.size(text.metric_tokens(F.col("pred"))).alias("lp"), F.size(text.metric_tokens(F.col("ref"))).alias("lr")).groupBy(*keys).agg(F.sum("lp").alias("lp"), F.sum("lr").alias("lr"), F.count(F.lit(1)).alias("n_samples"))
    precision = lambda n: F.coalesce(F.max(F.when(F.col("n") == n, F.col("hit") / F.col("tf"))), F.lit(0.0)).alias(f"p{n}")
    wide = per_n.groupBy(*keys).agg(*(precision(n) for n in range(1, most + 1)))
    joined = lens.join(wide, by, "left") if by else lens.join(F.broadcast(wide))  # one row each
    return joined.select(*keys, "n_samples", *_bleu_scores(most, digits))


def _bleu_scores(most: int, digits: int) -> list[Column]:
    """bleu1 and bleu4 of the precisions p1 and so on and the lengths lp and lr."""
    ps = [F.coalesce(f"p{n}", F.lit(0.0)) for n in range(1, most + 1)]
    brevity = F.when(F.col("lp") == 0, 0.0).when(F.col("lp") > F.col("lr"), 1.0).otherwise(F.exp(1 - F.col("lr") / F.col("lp")))
    logs = sum((F.log(p) for p in ps[1:]), F.log(ps[0]))
    return [F.round(ps[0], digits).alias("bleu1"), F.round(F.when(F.least(*ps) > 0, brevity * F.exp(logs / most)).otherwise(0.0), digits).alias("bleu4")]


def evaluated(pairs: DataFrame, by: str, surfaces: DataFrame | None = None, digits: int = 4, aligned: bool = True) -> DataFrame:
    """One row per group (file) with rows: n_samples, bleu1, bleu4, meteor and rouge_l (if aligned), cider and, with
    surfaces, vocab_conf."""
    pairs = checkpointed(pairs)
    mean = lambda rows, name: rows.groupBy(by).agg(F.round(F.avg(name), digits).alias(name))
    at = range(4)
    sums = (F.sum(F.col(c)[n]).alias(f"_{c}{n}") for c in ("hit", "tf") for n in at)
    told = grams.scored(pairs, by, len(at)).groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"), F.sum("lp").alias("lp"), F.sum("lr").alias("lr"), *sums, F.round(F.avg("cider"), digits).alias("cider"))
    precisions = {f"p{n + 1}": F.when(F.col(f"_tf{n}") > 0, F.col(f"_hit{n}") / F.col(f"_tf{n}")) for n in at}
    told = told.withColumns(precisions).select(by, "n_samples", *_bleu_scores(len(at), digits), "cider")
    out = told.join(mean(alignment.meteor(pairs, by), "meteor"), by).join(mean(rouge_l(pairs, by), "rouge_l"), by).select(by, "n_samples", "bleu1", "bleu4", "meteor", "rouge_l", "cider") if aligned else told
    if surfaces is not None:
        share = conformity(pairs, surfaces, [by])
        out = out.join(mean(share, "share").withColumnRenamed("share", "vocab_conf"), by, "left")
    return out


def overlap(pred: Column, ref: Column) -> Column:
    """Share of the distinct tokens of pred that ref has; 0 without tokens. Both are sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(pred, ref)).cast("double"), F.size(pred)), F.lit(0.0))


def shuffle_test(pairs: DataFrame, shuffles: int = 100, seed: int = 42) -> DataFrame:
    """Overlap of paired rows against that of seeded shuffles of the predictions: observed, shuffled (mean) and z."""
    sets = pairs.select("id", F.array_distinct(text.metric_tokens(F.col("pred"))).alias("p"), F.array_distinct(text.metric_tokens(F.col("ref"))).alias("r"))
    slim = sets.select("id", overlap(F.col("p"), F.col("r")).alias("o"), *(F.array_join(c, " ").alias(c) for c in ("p", "r")))
    rows = checkpointed(curate.numbered(slim, ["id", "p", "r"]))
    observed = rows.agg(F.avg("o").alias("m")).first()["m"]
    sims = shuffles_of.mean_overlaps(rows, shuffles, seed)
    m = F.lit(observed).cast("double")
    return sims.agg(F.round(m, 6).alias("observed"), F.round(F.avg("s"), 6).alias("shuffled"), F.round((m - F.avg("s")) / F.stddev_samp("s"), 3).alias("z"))


def conformity(pairs: DataFrame, surfaces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, share) of rows with a token: the share of their tokens in the surface set (column surface)."""
    tokens = pairs.select(*keys, "id", F.explode(text.metric_tokens(F.col("pred"))).alias("surface"))
    known = small(checkpointed(surfaces.select("surface").distinct())).withColumn("hit", F.lit(1))
    return tokens.join(known, "surface", "left").groupBy(*keys, "id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))


def vocabulary_conformance(pairs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Mean share over the rows that have one."""
    return conformity(pairs, surfaces, []).agg(F.round(F.avg("share"), 6).alias("vocab_conf"), F.count(F.lit(1)).alias("n_scored"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence with bit sets: one big-integer step per token of b."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        both = row & where.get(t, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def _rouge(pred: pd.Series, ref: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(pred, ref, strict=True):
        n = lcs_length(list(p), list(r)) if len(p) and len(r) else 0
        out.append(2 * n / (len(p) + len(r)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def rouge_l(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Per id the LCS F-measure."""
    return pairs.select("id", *([by] if by else []), _rouge(text.metric_tokens(F.col("pred")), text.metric_tokens(F.col("ref"))).alias("rouge_l"))
