"""METEOR and greedy vector matching against every alignment of short rows and hand cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import alignment


def stem(w):
    return w.rstrip("oaie")


def every_alignment(pred, ref):
    """(exact, all matches, chunks) of the best of all one-to-one alignments."""
    best = None
    options = [[j for j, r in enumerate(ref) if r == w or stem(r) == stem(w)] + [None] for w in pred]
    for choice in itertools.product(*options):
        used = [j for j in choice if j is not None]
        if len(used) != len(set(used)):
            continue
        exact = sum(j is not None and ref[j] == w for w, j in zip(pred, choice))
        chunks = sum(j is not None and (i == 0 or choice[i - 1] is None or choice[i - 1] + 1 != j) for i, j in enumerate(choice))
        key = (-exact, -len(used), chunks)
        best = key if best is None or key < best else best
    return -best[0], -best[1], best[2]


def test_alignment_against_all(spark):
    rng = random.Random(9)
    for _ in range(200):
        words = ["a", "b", "casa", "case", "caso", "rosso", "rossa"][: rng.choice([2, 4, 7])]
        pred, ref = ([rng.choice(words) for _ in range(rng.randint(0, 5))] for _ in range(2))
        _, matches, chunks = every_alignment(pred, ref)
        assert alignment.align(pred, ref, [stem(w) for w in pred], [stem(w) for w in ref]) == (matches, chunks), (pred, ref)


def test_repeated_words_ask_for_few_alignments(monkeypatch):
    """Many words that occur several times on both sides, apart from each other: all their alignments are alike, and one
    set of places at a time is enough. Before, hundreds were followed, and 512 were not enough for the last case."""
    words = [f"w{chr(97 + k)}" for k in range(8)]
    pred = [x for n in range(6) for k, w in enumerate(words) for x in (w, f"p{n}k{k}q")]
    ref = [x for n in range(3) for k, w in enumerate(words) for x in (w, f"r{n}k{k}t")]
    monkeypatch.setattr(alignment, "STATES", 1)
    assert alignment.align(pred, ref, pred, ref) == (24, 24)
    # w0..w7 are adjacent once on either side, after repetitions that are not
    monkeypatch.setattr(alignment, "STATES", 512)
    assert alignment.align(pred + words, [*ref[:16], "t", *words, *ref[32:]], [*pred, *words], [*ref[:16], "t", *words, *ref[32:]]) == (24, 17)


def test_alignment_of_repetitions_against_all():
    rng = random.Random(31)
    for _ in range(60):
        words = ["a", "b", "casa", "case", "x", "y", "z"]
        pred, ref = ([rng.choice(words) for _ in range(rng.randint(4, 6))] for _ in range(2))
        _, matches, chunks = every_alignment(pred, ref)
        assert alignment.align(pred, ref, [stem(w) for w in pred], [stem(w) for w in ref]) == (matches, chunks), (pred, ref)


def test_meteor_by_hand(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "on the mat sat the cat", "the cat sat on the mat"), (3, "the cat was sat on the mat", "the cat sat on the mat"), (4, "x y", "z"), (5, "", "z"), (6, "case rosse", "casa rossa"), (7, "a " * 400, "a " * 300)]
    got = {r.id: r for r in alignment.meteor(spark.createDataFrame(rows, "id int, pred string, ref string")).collect()}
    assert got[1].meteor == pytest.approx(1 - 0.5 / 6**3) and (got[1].matches, got[1].chunks) == (6, 1)
    assert (got[2].matches, got[2].chunks) == (6, 3) and got[2].meteor == pytest.approx(1 - 0.5 * (3 / 6) ** 3)
    assert (got[3].matches, got[3].chunks) == (6, 2) and got[3].meteor == pytest.approx((6 / 7) / (0.9 * 6 / 7 + 0.1) * (1 - 0.5 * (2 / 6) ** 3))
    assert got[4].meteor == got[5].meteor == 0.0 and (got[6].matches, got[6].chunks) == (2, 1)
    assert (got[7].matches, got[7].chunks) == (300, 1)


def test_greedy_match(spark):
    v = {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [3.0, 3.0], "0": [0.0, 0.0]}
    rows = [(1, "ab", "ab"), (2, "a", "c"), (3, "", "a"), (4, "ac", "b"), (5, "0", "a")]
    df = spark.createDataFrame([(i, [(t, v[t]) for t in p], [(t, v[t]) for t in r]) for i, p, r in rows], "id int, pred array<struct<token:string,vector:array<double>>>, ref array<struct<token:string,vector:array<double>>>")
    got = {r.id: (r.precision, r.recall, r.f1) for r in alignment.greedy_match(df).collect()}
    idf = {t: math.log(6 / (n + 1)) for t, n in {"a": 3, "b": 2, "c": 1}.items()}
    half = math.sqrt(0.5)
    assert got[1] == pytest.approx((1, 1, 1)) and got[2] == pytest.approx((half,) * 3) and got[3] == got[5] == (0, 0, 0)
    p = idf["c"] * half / (idf["a"] + idf["c"])
    assert got[4] == pytest.approx((p, half, 2 * p * half / (p + half)))
    assert alignment.greedy_match(df.limit(0)).count() == 0
