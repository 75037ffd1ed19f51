"""Golden cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import metrics, vocab


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("  a b\tc  ", "a b c"), ("è", "è"), ("a b​", "a b"), ('"x"', "x"), (None, "")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("", "empty"), ("n/a", "meta"), ("---", "meta"), ("x", "short"), ("ok", None), ("NON PENALIZZO", "meta")])
def test_drop_reason(spark, given, want):
    assert one(spark, text.drop_reason(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("Bella", "PURE_EVAL"), ("bella grana", None), ("10", "NUMBER_ONLY"), ("0,8", "NUMBER_ONLY"), ("1 2 3 4", None), ("10 mm", None), ("ValutazIone alle 13:40", "SYSTEM_META")])
def test_useless_reason(spark, given, want):
    assert one(spark, text.useless_reason(F.col("t")), t=given) == want


def test_categories(spark):
    assert one(spark, text.categories(F.col("t")), t="Forse buono?") == ["UNCERTAINTY", "INTERROGATIVE"]
    assert one(spark, text.categories(F.col("t")), t="non so come") == []
    assert one(spark, text.categories(F.col("t")), t="non so dire") == ["META"]


def test_dedup_key(spark):
    assert one(spark, text.dedup_key(F.col("t"), F.col("a")), t="Macchie, fini!", a="A") == "A::macchie fini"


@pytest.mark.parametrize(
    ("given", "want"),
    [("10 mm", "Media"), ("1 cm", "Media"), ("0,8", "Sottile"), ("8-10 mm", "Sottile"), ("Più di 1 cm", "Media"), ("20", "Molto spessa"), ("Sottile", None), ("10 mm ma scura", None)],
)
def test_measured_thickness(spark, given, want):
    assert one(spark, text.measured_thickness(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("caption", "attribute", "want"),
    [
        ("Profumo di panna.", "Profumo", "Il formaggio ha un profumo di panna."),
        ("Crosta sottile.", "Spessore della Crosta", "La crosta del formaggio è sottile."),
        ("Pasta con alone centrale.", "Struttura della Pasta", "La pasta del formaggio presenta un alone centrale."),
        ("Pasta con macchie.", "Struttura della Pasta", "La pasta del formaggio presenta macchie."),
        ("Altro", "Profumo", None),
    ],
)
def test_sentence(spark, caption, attribute, want):
    assert one(spark, text.polish(text.sentence(F.col("t"), F.col("a"))), t=caption, a=attribute) == want


def test_canonical_opening(spark):
    assert one(spark, text.canonical_opening(F.col("t"), F.col("a")), t="Note olfattive di pane.", a="Profumo") == "Profumo di pane."


def test_small_functions(spark):
    assert one(spark, text.metric_tokens(F.col("t")), t="L'aroma è un'altra-cosa.") == ["laroma", "è", "unaltracosa"]
    assert one(spark, text.sample_id(F.lit("TN_307"), F.lit("2021-01-27"), F.lit(None), F.lit(None)), t="") == "TN_307__2021-01-27__P"
    assert one(spark, text.decimal_comma(F.col("t")), t=" 7,48 ") == 7.48
    assert one(spark, text.decimal_comma(F.col("t")), t="x") is None
    assert one(spark, text.preprocess(F.col("t"), F.lit("")), t="*legg granoloso* .") == "leggermente granuloso ."


def test_path(spark):
    path = "TG/2020/27°Seduta_24-03-2021/P2_TN_305_337_B_GRANA.bmp"
    row = spark.createDataFrame([(path,)], "p string").select(*(c.alias(k) for k, c in text.parse_image_path(F.col("p")).items())).first()
    assert (row.session_date, row.session_num_img, row.panel_slot, row.dairy_id, row.view) == ("2021-03-24", 27, None, "TN_305", "Grana")


def test_merged_inflections():
    counts = {"rotondo": 5, "rotonda": 3, "rotondi": 1, "spessa": 2, "spessi": 4, "occhi": 9}
    head = vocab.leaders(list(counts.items()))
    assert head == {"rotondo": "rotondo", "rotonda": "rotondo", "rotondi": "rotondo", "spessa": "spessi", "spessi": "spessi", "occhi": "occhi"}


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0 for _ in b] if not row else row
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in (("abcbdab", "bdcaba"), ("", "a"), ("aaaa", "aa"), ("xyz", "abc")):
        assert metrics.lcs_length(list(a), list(b)) == plain(a, b)


def test_cider_of_one_identical_pair_is_zero(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a b c d")], "id long, pred string, ref string")
    assert metrics.cider(pairs).first()["cider"] == 0.0
