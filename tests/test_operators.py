"""Operators whose plans have to hold on wide, skewed or broken input."""

import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.operators import curate, grams, joins, metrics, nearest, sampling, shuffles, vocab


def test_numbered_keeps_all_rows_of_wide_tables(spark):
    """Adaptive coalescing divides a narrow and a wide reading of one shuffle differently; no row may go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    try:
        for partitions in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = curate.numbered(docs, ["doc_id"]).select("doc_id", "row_id", F.length("text")).collect()
            assert sorted(r.row_id for r in got) == list(range(10_000))
            assert [r.row_id for r in sorted(got, key=lambda r: r.doc_id)] == list(range(10_000))
        per = curate.numbered(docs, ["source", F.desc("doc_id")], by="source").groupBy("source").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.count_distinct("row_id").alias("n"))
        assert all(r.a == 0 and r.b == r.n - 1 for r in per.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_running_total(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(200)], "id long, n long")
    got = curate.running_total(rows, ["id"], F.col("n")).orderBy("id").collect()
    total = 0
    for r in got:
        total += r.n
        assert r.total == total


def test_joined_back(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 2 else f"k{i}") for i in range(3000)], "id long, k string")
    entries = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = joins.joined_back(rows, entries.filter("k IS NULL OR k <> 'k2'"), ["k"], "n", "id").collect()
    want = {r.k: (r.n, r.top) for r in entries.collect()}
    assert len(got) == 3000 and all((r.n, r.top) == (want[r.k] if r.k != "k2" else (None, None)) for r in got)


def test_grams_of_chunks_and_segments(spark):
    """Many chunks and segments give what one gives, and no n-gram becomes a row of its own."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices(["uno", "due", "tre", "Quattro!", "", "\u00e8", "sei-sette"], k=n))
    rows = [(i, f"f{i % 3}", say(rng.randrange(0, 30)), say(rng.randrange(0, 12))) for i in range(200)] + [(200, "f0", "", ""), (201, "f3", "x", ""), (202, "f3", "", "x")]
    pairs = spark.createDataFrame(rows, "id long, file string, pred string, ref string")
    told = lambda df: sorted((r.id, r.file, round(r.cider, 9), r.lp, r.lr, tuple(r.hit), tuple(r.tf)) for r in df.collect())
    got = grams.scored(pairs, "file", 4, chunk_bytes=1000, segment_bytes=500)
    assert told(got) == told(grams.scored(pairs, "file", 4)) and len(told(got)) == 203
    assert "Generate" not in grams.scored(pairs, "file", 4)._jdf.queryExecution().optimizedPlan().toString()
    by_sums = {r.file: (r.bleu1, r.bleu4) for r in metrics.evaluated(pairs, "file", digits=6, aligned=False).collect()}
    assert by_sums == {r.file: (r.bleu1, r.bleu4) for r in metrics.bleu(pairs, "file").collect()}


def test_shuffles_in_small_chunks_against_a_plain_version(spark):
    rng = random.Random(8)
    data = [(rng.randrange(-(10**12), 10**12), *(" ".join(sorted(rng.sample("a b c d e f g h".split(), rng.randrange(0, 5)))) for _ in range(2))) for _ in range(90)]
    ordered = sorted(data)
    rows = spark.createDataFrame([(*x, i) for i, x in enumerate(ordered)], "id long, p string, r string, row_id long").repartition(3)
    want = {}
    for k in range(1, 8):
        drawn = sorted(ordered, key=lambda x: (hashlib.md5(f"42|{k}|{x[0]}".encode()).hexdigest(), x[0]))
        want[k] = sum(len(set(a[1].split()) & set(b[2].split())) / len(a[1].split()) for a, b in zip(drawn, ordered) if a[1]) / len(data)
    for sizes in ({}, {"chunk_bytes": 60, "block_bytes": 90, "bucket_rows": 40}):
        got = {r.k: r.s for r in shuffles.mean_overlaps(rows, 7, 42, **sizes).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    assert shuffles.mean_overlaps(rows.limit(0), 7, 42).count() == 0


def test_shuffle_test_moves_no_text_for_each_shuffle(spark):
    """Before, rows of each shuffle were joined with their texts, twice."""
    words = [f"w{i}" for i in range(40)]
    pairs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(words, 9)), " ".join(random.Random(-i).sample(words, 9))) for i in range(300)], "id long, pred string, ref string")
    r = metrics.shuffle_test(pairs)
    assert r.count() == 1 and r.first().observed is not None
    assert "Join" not in r._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_packed(spark):
    import numpy as np

    for keys in ([], [0], [2**64 - 1], [3, 7, 900, 2**63, 2**64 - 2]):
        assert grams.unpacked(grams.packed(np.array(keys, np.uint64))).tolist() == keys


def test_stratified(spark):
    rows = spark.createDataFrame([(i, "big" if i % 10 else "small", i) for i in range(500)], "id long, s string, w long")
    split = sampling.stratified_split(rows, "id", "s").groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in split} == {("big", "train"): 315, ("big", "val"): 67, ("big", "test"): 68, ("small", "train"): 35, ("small", "val"): 7, ("small", "test"): 8}
    got = sampling.stratified_sample(rows, "id", "s", "w", 9).collect()
    assert sum(r.is_head for r in got) == 6 and len(got) == 18 and len({r.id for r in got}) == 18


def test_weighted_draw_of_large_counts(spark):
    test, values = spark.range(400), spark.createDataFrame([("a", 3 * 10**12), ("b", 10**12), ("c", 0)], "v string, n long")
    got = [r.v for r in sampling.weighted_draw(test, "id", values, "v", "n").collect()]
    assert len(got) == 400 and set(got) == {"a", "b"} and 250 < got.count("a") < 350


def test_named_baselines(spark):
    made, failed = sampling.run_named({"one": lambda: spark.range(2).withColumn("p", F.lit("x")), "bad": lambda: spark.range(2).select("nothing")}, "id", "p")
    assert made.count() == 2 and list(failed) == ["bad"]


def test_nearest(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.1]), (3, "b", [1.0, 0.1]), (4, "a", [0.0, 1.0]), (5, "c", [0.0, 0.0])], "id long, label string, v array<double>")
    got = {r.id: (r.nearest, r.masked) for r in nearest.nearest(rows.filter("id IN (1, 4)"), rows, "id", "label", "v").collect()}
    assert got == {1: (2, False), 4: (2, False)}
    same = rows.filter("label = 'a'")
    assert nearest.nearest(same, same, "id", "label", "v").count() == 0
    assert {(r.id, r.nearest, r.masked) for r in nearest.nearest(same, same, "id", "label", "v", fallback=True).collect()} == {(1, 4, True), (4, 1, True)}


def test_guards_and_columns(spark):
    df = spark.createDataFrame([(1, "a", True, None)], "id int, role string, x boolean, y boolean")
    assert curate.known_only(df, "role", ["a"]).count() == 1
    with pytest.raises(Exception, match="unknown role: a"):
        curate.known_only(df, "role", ["b"]).collect()
    assert curate.having_any(df, "x", "y").count() == 1 and curate.having_any(df, "y").count() == 0
    with pytest.raises(ValueError, match="pred"):
        curate.resolved(df, {"pred": ["caption_pred", "pred"]})
    pairs, told = curate.positional(df, ["id"], df.union(df).withColumnRenamed("role", "other"), ["id"], ("role", "other"))
    assert pairs.count() == 0 and told.first()["n_checked"] == 0


def test_apply_on_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, i int")
    got = curate.apply_on_distinct(df, "k", lambda keys: keys.withColumn("up", F.upper("k")))
    assert {(r.i, r.up) for r in got.collect()} == {(1, "A"), (2, "A"), (3, "B")}


def test_nfc_is_sent_what_needs_it(spark):
    """Every code point and the pairs that compose: what NFC changes must match the pattern."""
    import regex

    java = text._NOT_YET_NFC.replace("\\x{", "\\N{").replace("\\N{", "\\x{")
    pattern = regex.compile(regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java))
    missed = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFC", c) != c and not pattern.search(c)]
    assert not missed, [hex(ord(c)) for c in missed[:20]]
    row = spark.createDataFrame([("cafe\u0301",), ("caffè",), (None,)], "t string").select(text.nfc(F.col("t")).alias("t")).collect()
    assert [r.t for r in row] == ["café", "caffè", None]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Il formaggio presenta macchia scura.", "Il formaggio presenta una macchia scura."),
        ("La crosta presenta area chiara.", "La crosta presenta un'area chiara."),
        ("La pasta presenta spacco e presenta macchia.", "La pasta presenta uno spacco e presenta macchia."),
        ("La pasta presenta lieve alone.", "La pasta presenta un lieve alone."),
        ("La pasta presenta evidente macchia.", "La pasta presenta un'evidente macchia."),
        ("La pasta presenta macchie e alone.", "La pasta presenta macchie e alone."),
        ("La pasta presenta qualche alone.", "La pasta presenta qualche alone."),
        ("La pasta presenta tre macchia.", "La pasta presenta una tre macchia."),
        ("La pasta è dal colore giallo.", "La pasta è di colore giallo."),
        ("La crosta è dalla buona umidità.", "La crosta presenta un'umidità."),
        ("La crosta è dalla granulosità fine.", "La crosta presenta una granulosità fine."),
        ("La crosta è dalla fascia chiara.", "La crosta presenta una fascia chiara."),
        ("La crosta è dalla bella forma.", "La crosta è dalla bella forma."),
        ("La crosta è unghia.", "La crosta presenta un'unghia."),
        ("Una  crosta con una  ombra.", "Una crosta con una ombra."),
        ("Con una ombra.", "Con un'ombra."),
        (None, None),
    ],
)
def test_polish(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.polish(F.col("t")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("legg salato", "leggermente salato"), ("Legg. salato", "Leggermente. salato"), ("un po' di umidita", "un poco' di umidità"), ("più Piu", "più Più"), ("'crosts'", "'crosta'"), ("GRANOLOSO x", "Granuloso x"), ("", ""), ("abb,abb", "abbastanza,abbastanza"), ("tabb", "tabb")],
)
def test_expand_words(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.expand_words(F.col("t")).alias("x")).first()["x"] == want


def test_participles_and_families(spark):
    assert vocab.inflection_candidates("mangiata")[0] == "mangiato" and vocab.inflection_candidates("tagli") == ["taglo", "taglio", "tagle"]
    assert vocab.inflection_candidates("buon") == ["buono", "buone", "buona"]
    words = [(r + e) for r in ("mangiat", "buon", "tagli", "tagl", "spess", "vin", "occhi", "are") for e in ("", "o", "a", "i", "e", "io")]
    rng = random.Random(5)
    counts = {w: rng.randint(1, 9) for w in rng.sample(words, len(words))}
    whole = vocab.leaders(list(counts.items()))
    # no rule leads out of a family: alone, each family gives the same
    families = {}
    for w, n in counts.items():
        families.setdefault(w.rstrip("oaie"), []).append((w, n))
    assert {w: h for f in families.values() for w, h in vocab.leaders(f).items()} == whole
    rows = spark.createDataFrame([("g", w, n, i) for i, (w, n) in enumerate(counts.items())], "g string, token string, n long, at long")
    got = {r.lemma: set(r.surfaces.split(", ")) for r in vocab.inflections(rows, "g", ["at"]).collect()}
    want = {}
    for w, h in whole.items():
        want.setdefault(h, set()).add(w)
    assert got == want
    assert vocab.leaders([("occhi", 1), ("occhio", 2), ("occhia", 3)])["occhi"] == "occhi"  # given stems never follow


def test_evaluated(spark):
    rows = [(1, "f1", "a b c d e", "a b c d e"), (2, "f1", "x", "a b"), (3, "f2", "", "a"), (4, "f2", "la pasta è dura", "la pasta dura")]
    pairs = spark.createDataFrame(rows, "id long, file string, pred string, ref string")
    got = {r.file: r for r in metrics.evaluated(pairs, "file", spark.createDataFrame([("a",), ("pasta",)], "surface string")).collect()}
    assert got["f1"].n_samples == 2 and got["f1"].bleu1 == round(5 / 6, 4) and got["f1"].rouge_l == 0.5
    assert got["f2"].vocab_conf == 0.25 and got["f2"].rouge_l == round((2 * 3 / 7) / 2, 4)
    assert got["f1"].vocab_conf == round((1 / 5 + 0) / 2, 4) and got["f1"].cider >= 0


def test_fixed_values():
    assert len(fixed.STEMS) == 141 and fixed.STEMS["cotte"] == "cotto" and all(v in fixed.STEMS for v in fixed.STEMS.values())


def brute_nearest(queries, rows, fallback):
    def unit(v):
        size = sum(x * x for x in v) ** 0.5
        return [x / size if size else 0.0 for x in v]

    rows = [(i, label, unit(v)) for i, label, v in rows if v is not None and i is not None]
    out = {}
    for q, label, v in queries:
        v, found = unit(v), {False: [], True: []}
        for i, other, w in rows:
            if i != q:
                found[label is not None and label == other].append((-round(sum(a * b for a, b in zip(v, w, strict=True)), 9), i))
        for masked in (False, True) if fallback else (False,):
            if found[masked]:
                out[q] = (min(found[masked])[1], masked)
                break
    return out


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_nearest_against_all_pairs(spark, spread, monkeypatch):
    rng = random.Random(int(spread * 100))
    monkeypatch.setattr(nearest, "PIVOTS", 24)
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 6 * 40)  # several blocks of queries
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(30)]
    rows = [(i, rng.choice(["a", "b", "b", None]), [x + rng.gauss(0, spread) for x in centres[i % 30]]) for i in range(900)]
    rows += [(900 + i, "a", rows[3][2]) for i in range(300)] + [(1200, "b", [0.0] * 6), (1201, "a", [0.0] * 6), (1202, "c", None)]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(6)
    asked = [r for r in rows if r[0] % 10 == 0 and r[2]]
    index = nearest.build(df, "id", "label", "v")
    got = {r.id: (r.nearest, r.masked) for r in nearest.nearest(df.filter("id % 10 = 0"), df, "id", "label", "v", index=index).collect()}
    assert got == brute_nearest(asked, rows, False)
    if spread < 0.1:  # rows have neighbourhoods: most rings are passed over
        assert 0 < index.compared.value < 0.35 * len(asked) * len(rows)
    only = df.filter("label = 'a'")
    got = {r.id: (r.nearest, r.masked) for r in nearest.nearest(df.filter("id % 10 = 0"), only, "id", "label", "v", fallback=True).collect()}
    want = brute_nearest(asked, [r for r in rows if r[1] == "a"], True)
    assert got == want and {m for _, m in want.values()} == {True, False}
    assert nearest.nearest(df.limit(0), df, "id", "label", "v").count() == nearest.nearest(df, df.limit(0), "id", "label", "v", fallback=True).count() == 0


def test_baselines_that_fail_while_they_run(spark):
    from pyspark.sql import functions as F

    breaks = lambda: spark.range(3).withColumn("p", F.raise_error(F.lit("too late")).cast("string"))
    made, failed = sampling.run_named({"late": breaks, "one": lambda: spark.range(2).withColumn("p", F.lit("x")), "early": lambda: 1 / 0}, "id", "p")
    assert made.count() == 2 and set(failed) == {"late", "early"} and "too late" in failed["late"]


def test_unicode_white_space_parts_words(spark):
    df = spark.createDataFrame([("A\u00a0b\u2003c\u0085d-e f\x1cg\u3000h",)], "t string")
    assert df.select(text.metric_tokens(F.col("t"))).first()[0] == ["a", "b", "c", "de", "f", "g", "h"]
