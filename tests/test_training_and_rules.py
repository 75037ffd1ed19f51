"""Padded batches, early stopping and rules that a caller gives."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import rules
from quern.operators import training


def test_padded_batches(spark):
    rng = random.Random(11)
    rows = [(i, None if i == 5 else [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 40, 41]))], [1.0, 2.0] if i % 3 else None) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, t array<int>, view array<double>").repartition(5)
    share = {}
    for by_length in (True, False):
        got = training.padded_batches(df, "id", "t", 10, 0, {"view": 2}, by_length).orderBy("batch").collect()
        want = sorted(rows, key=lambda r: (len(r[1] or []), r[0]) if by_length else r[0])
        assert [len(b.ids) for b in got] == [10] * 10 + [3] and [i for b in got for i in b.ids] == [r[0] for r in want]
        for k, b in enumerate(got):
            part = want[10 * k : 10 * k + 10]
            width = max(len(r[1] or []) for r in part)
            assert b.width == width and [list(t) for t in b.tokens] == [(r[1] or []) + [0] * (width - len(r[1] or [])) for r in part]
            assert [list(v) for v in b.view] == [r[2] or [0.0, 0.0] for r in part]
        cells = sum(b.width * len(b.ids) for b in got)
        share[by_length] = 1 - sum(len(r[1] or []) for r in rows) / cells
    assert share[True] < 0.5 * share[False]


def plain_stops(losses, patience):
    best = at = stop = None
    waited = n = 0
    for e, x in losses:
        n += 1
        if x is not None and x == x and (best is None or x < best):
            best, at, waited = x, e, 0
        else:
            waited += 1
        if waited >= patience:
            stop = e
            break
    return at, best, stop, n


def test_stops(spark):
    rng = random.Random(12)
    logs = {r: [(e, rng.choice([None, float("nan"), 1.0, 2.0, rng.random()])) for e in range(1, rng.randint(2, 30))] for r in range(60)}
    df = spark.createDataFrame([(r, e, x) for r, log in logs.items() for e, x in log], "run int, epoch int, loss double").repartition(4)
    for patience in (1, 3, 7):
        got = {r.run: (r.best_epoch, r.best_loss, r.stop_epoch, r.n_epochs) for r in training.stops(df, "run", "epoch", "loss", patience).collect()}
        assert got == {r: plain_stops(log, patience) for r, log in logs.items()}


RULES = [
    rules.Rule("crust", 2, r"(.+)", "The crust is {x}."),
    rules.Rule("crust", 1, r"thin (\w+) (\w+)", "A {2} crust, thin as {1}."),
    rules.Rule("paste", 1, r"(?:very )?(soft|hard)", "{x} paste"),
    rules.Rule(None, 9, r"none", "Nothing."),
]


def test_rules_as_a_column_and_from_sql(spark):
    rows = [(1, "Thin paper white!", "crust"), (2, "  brown ", "crust"), (3, "very HARD.", "paste"), (4, "wet", "paste"), (5, "none", "other"), (6, "none", "crust"), (7, None, "crust"), (8, "none", None)]
    df = spark.createDataFrame(rows, "id int, text string, attribute string")
    want = {1: "A white crust, thin as paper.", 2: "The crust is brown.", 3: "HARD paste", 4: None, 5: "Nothing.", 6: "The crust is none.", 7: None, 8: "Nothing."}
    table = spark.createDataFrame([(r.attribute, r.order, r.pattern, r.frame) for r in RULES] + [(None, None, None, "x")], "attribute string, order int, pattern string, frame string")
    for given in (RULES, rules.from_table(table)):
        assert {r.id: r.s for r in df.select("id", rules.compiled(given, F.col("text"), F.col("attribute")).alias("s")).collect()} == want
    rules.register(spark, "sentences", RULES)
    df.createOrReplaceTempView("noted")
    got = spark.sql("SELECT id, place, sentence FROM noted, LATERAL sentences(text, attribute)").collect()
    assert {r.id: r.sentence for r in got if r.place == 0} == {k: v for k, v in want.items() if v}
    assert {(r.id, r.sentence) for r in got if r.place == 1} == {(1, "The crust is Thin paper white."), (6, "Nothing.")}
    assert df.select(rules.compiled([], F.col("text"), F.col("attribute")).alias("s")).filter("s IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="asks for a group"):
        rules.checked([rules.Rule(None, 1, "a(?:b)c", "{x}")])
    with pytest.raises(ValueError, match="more than"):
        rules.from_table(spark.range(rules.MOST + 1).selectExpr("'a' AS attribute", "int(id) AS `order`", "'x' AS pattern", "'y' AS frame"))
