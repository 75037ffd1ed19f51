"""Word alignment scores: METEOR by exact and stem matches, and greedy matching of token vectors."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text
from quern.operators.joins import joined_back
from quern.operators.vocab import family
from quern.session import checkpointed

#: Fixed values of the METEOR score: weight of precision and recall, and of the penalty.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
#: Sets of taken places that are followed at a time; of each set those alignments alone that may still be the best. Rows
#: in which no word repeats need one; more than these are only reached by rows with many repetitions, whose number of
#: chunks may then be more than the least.
STATES = 512


def align(pred: list[str], ref: list[str], pred_stems: list[str], ref_stems: list[str]) -> tuple[int, int]:
    """(matches, chunks): words are matched one to one, as many as possible by the word itself, then as many of the
    rest as possible by the stem; of all such alignments one with the fewest chunks (stretches that are adjacent and
    in order on both sides)."""
    in_pred, in_ref = Counter(pred), Counter(ref)
    exact = {w: min(n, in_ref[w]) for w, n in in_pred.items()}
    over_pred, over_ref = Counter(), Counter()
    stem_of = dict(zip(pred, pred_stems, strict=True)) | dict(zip(ref, ref_stems, strict=True))
    for w, n in in_pred.items():
        over_pred[stem_of[w]] += n - exact[w]
    for w, n in in_ref.items():
        over_ref[stem_of[w]] += n - min(n, in_pred[w])
    by_stem = {s: min(n, over_ref[s]) for s, n in over_pred.items()}
    at_word, at_stem = defaultdict(list), defaultdict(list)
    for j, w in enumerate(ref):
        at_word[w].append(j)
        if in_ref[w] > in_pred[w]:  # some of its places are over
            at_stem[stem_of[w]].append(j)
    mask_word = {w: sum(1 << j for j in js) for w, js in at_word.items()}
    mask_stem = {x: sum(1 << j for j in js) for x, js in at_stem.items()}
    spare = {w: in_ref[w] - min(in_ref[w], in_pred[w]) for w in in_ref}
    words_of = defaultdict(set)
    for w in in_pred:
        words_of[stem_of[w]].add(w)
    # which words decide on the same places: all of a stem where stems are matched, else the word alone
    group = {w: (True, stem_of[w]) if by_stem[stem_of[w]] else (False, w) for w in in_pred}
    ahead = Counter(group[w] for w in pred)
    places: dict[tuple[bool, str], int] = defaultdict(int)
    for w, mask in mask_word.items():
        places[True, stem_of[w]] |= mask
        places[False, w] |= mask
    # a place of ref that goes on with no neighbour is like all others of its word: the first free one is tried for them
    follows = {(group[a], group[b]) for a, b in itertools.pairwise(pred)}
    of_ref = [(True, stem_of[w]) if by_stem.get(stem_of[w]) else (False, w) for w in ref]
    linked = 0
    for j, pair in enumerate(itertools.pairwise(of_ref)):
        if pair in follows:
            linked |= 3 << j

    def tried(at: list[int], free: int) -> list[int]:
        found, plain = [], set()
        for j in at:
            if free >> j & 1 and (linked >> j & 1 or ref[j] not in plain):
                found.append(j)
                if not linked >> j & 1:
                    plain.add(ref[j])
        return found

    # (places of ref used for words, those used for stems) -> chunks, and the places that would go on with the last one.
    # More chunks for the same places are never better, as going on saves one at most; places whose words are all read
    # decide nothing more and are taken out.
    states: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    seen: Counter = Counter()
    for i, w in enumerate(pred):
        s, before = stem_of[w], seen[w]
        seen[w] += 1
        ahead[group[w]] -= 1
        if not exact[w] and not by_stem[s]:
            if any(on for _, on in states.values()):
                states = {key: (chunks, 0) for key, (chunks, _) in states.items()}
            continue
        left_w = in_pred[w] - before - 1
        follower = pred[i + 1] if i + 1 < len(pred) else None
        open_next = mask_word.get(follower, 0) | (mask_stem.get(stem_of[follower], 0) if by_stem[stem_of[follower]] else 0) if follower is not None else 0
        keep = -1 if ahead[group[w]] else ~places[group[w]]
        after: dict[tuple[int, int], tuple[int, int]] = {}

        def put(used: int, stems: int, chunks: int, j: int, keep: int = keep, after: dict = after, open_next: int = open_next) -> None:
            on = 2 << j & open_next & ~(used | stems) if j >= 0 else 0
            key = (used & keep, stems & keep)
            old = after.get(key)
            if old is None or old[0] > chunks:
                after[key] = (chunks, on)
            elif old[0] == chunks and on & ~old[1]:
                after[key] = (chunks, old[1] | on)

        for (used, stems), (chunks, on) in states.items():
            taken = (used & mask_word.get(w, 0)).bit_count()
            if taken < exact[w]:
                for j in tried(at_word[w], ~(used | stems)):
                    put(used | 1 << j, stems, chunks + (not on >> j & 1), j)
            if exact[w] - taken <= left_w:  # this occurrence may be one that is over
                if not by_stem[s]:
                    put(used, stems, chunks, -1)
                    continue
                rest = sum(seen[x] - (x == w) - (used & mask_word.get(x, 0)).bit_count() for x in words_of[s])  # over and seen
                matched = sum(1 for j in at_stem[s] if stems >> j & 1)
                if matched < by_stem[s]:
                    for j in tried(at_stem[s], ~(used | stems)):
                        other = ref[j]
                        if other != w and (stems & mask_word[other]).bit_count() < spare[other]:
                            put(used, stems | 1 << j, chunks + (not on >> j & 1), j)
                if over_pred[s] - rest - 1 >= by_stem[s] - matched:
                    put(used, stems, chunks, -1)
        states = dict(sorted(after.items(), key=lambda x: (x[1][0], x[0]))[:STATES]) if len(after) > STATES else after
    matches = sum(exact.values()) + sum(by_stem.values())
    return matches, min(chunks for chunks, _ in states.values()) if states and matches else 0


def meteor_score(matches: int, chunks: int, n_pred: int, n_ref: int) -> float:
    if not matches:
        return 0.0
    precision, recall = matches / n_pred, matches / n_ref
    mean = precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)
    return mean * (1 - GAMMA * (chunks / matches) ** BETA)


@F.pandas_udf(T.StructType([T.StructField("matches", T.LongType()), T.StructField("chunks", T.LongType()), T.StructField("meteor", T.DoubleType())]))
def _meteor(pred: pd.Series, ref: pd.Series, pred_stems: pd.Series, ref_stems: pd.Series) -> pd.DataFrame:
    out = []
    for p, r, ps, rs in zip(pred, ref, pred_stems, ref_stems, strict=True):
        m, c = align(list(p), list(r), list(ps), list(rs))
        out.append((m, c, meteor_score(m, c, len(p), len(r))))
    return pd.DataFrame(out, columns=["matches", "chunks", "meteor"])


def meteor(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Per id: matches, chunks, meteor. The stem of a word is what is left without its final vowels; synonyms, which
    need a word net, are not matched."""
    tokens = pairs.select("id", *([by] if by else []), text.metric_tokens(F.col("pred")).alias("_p"), text.metric_tokens(F.col("ref")).alias("_r"))
    stems = lambda c: F.transform(c, family)
    return tokens.select("id", *([by] if by else []), _meteor("_p", "_r", stems("_p"), stems("_r")).alias("m")).select("id", *([by] if by else []), "m.*")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """(id, pred, ref), lists of (token, vector) -> precision, recall and f1: every token counts the greatest cosine it
    has with a token of the other side, weighted by its idf, ln((N + 1) / (df + 1)) over the N references. Where all
    weights of a side are 0 its tokens count alike; an empty side scores 0. Vectors without length are similar to
    nothing."""
    n = pairs.count()
    sides = {c: pairs.select("id", F.posexplode(c).alias("pos", "t")).select("id", "pos", "t.token", "t.vector") for c in ("pred", "ref")}
    df = checkpointed(sides["ref"].select("id", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df")))

    def weighed(side: str) -> DataFrame:
        idf = F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1))
        rows = joined_back(sides[side], df, ["token"], "df", "id").withColumn("w", idf)
        return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "vector"))).alias(f"_{side}"))

    both = pairs.select("id").join(weighed("pred"), "id", "left").join(weighed("ref"), "id", "left")
    lists = [F.col(f"_{s}")[f].alias(f"{s}_{f}") for s in ("pred", "ref") for f in ("w", "vector")]
    kind = pairs.schema["id"].dataType.simpleString()

    def unit(vectors: list) -> np.ndarray:
        m = np.array(vectors, dtype=float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def share(near: np.ndarray, weights: list[float]) -> float:
        w = np.array(weights)
        w = w if w.sum() > 0 else np.ones(len(w))
        return float((near * w).sum() / w.sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["pred_w", "pred_vector", "ref_w", "ref_vector"]).to_pylist():
                p = q = f = 0.0
                if r["pred_vector"] and r["ref_vector"]:
                    near = unit(r["pred_vector"]) @ unit(r["ref_vector"]).T
                    p, q = share(near.max(axis=1), r["pred_w"]), share(near.max(axis=0), r["ref_w"])
                    f = 2 * p * q / (p + q) if p + q else 0.0
                out.append((p, q, f))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.float64()) for c in cols)], ["id", "precision", "recall", "f1"])

    return both.select("id", *lists).mapInArrow(score, f"id {kind}, precision double, recall double, f1 double")
