"""Every query that has SQL against that SQL, on the small tables."""

import os
from pathlib import Path

import pytest

from quern.plans import registry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE_SQL:
        result = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall())
    else:
        assert got


def test_funnel_conserves_rows(spark):
    for r in registry.QUERIES["curate_funnel"](spark, str(SF)).collect():
        assert r.n_rows == r.dropped_empty + r.dropped_meta + r.dropped_short + r.n_kept


def test_multilabel_is_its_sql_at_the_edges_of_words(spark, duck, tmp_path):
    texts = ["Pareà bene", "sembraé", "forse", "credo\u00a0che", "\u00a0direi", "buono?\r", "dove?\u2028", "ma\u00a0si", "non soò", "non so come", "non\u00a0valuto", "valutazione\u00a0x", "il votoè", "peccato\x0b", "PARE", "ſembra ora", "nonſ non ſo", "non non so come so", "non so seso, non so cosà", "pareſ", "Kforse il votoſ"]
    spark.createDataFrame([(i, t, "it", "blog") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    own = duck.cursor()
    own.execute("CREATE SCHEMA edges; SET schema = 'edges'")
    own.execute(f"CREATE VIEW edges.documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = own.execute(registry.ORACLE_SQL["flt_multilabel"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["flt_multilabel"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["agg_unmatched_captions", "fn_sentence", "agg_match_rate", "fn_sentence_frames"])
def test_plans_of_frames_stay_small(spark, name):
    """The driver holds the plan: it had near a million characters, put together from columns within columns."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000_000)
    try:
        plan = registry.QUERIES[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(plan) < 120_000


def test_custom_ids_of_large_keys(spark, tmp_path):
    keys = [7, 99999, 100000, 1234567]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(100000, "R"), (100000, "R"), (7, "N")], "l_orderkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "a b", "n", "b", 1.5) for k in keys], "p_partkey long, p_type string, p_name string, p_brand string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    want = {k: f"row{k:05d}" for k in keys}
    got = {r.custom_id: (r.n_results, r.n_missing) for r in registry.QUERIES["jn_correlate"](spark, str(tmp_path)).collect()}
    assert got == {want[k]: (2, 0) if k == 100000 else (0, 1) for k in keys}
    assert {r.p_partkey: r.custom_id for r in registry.QUERIES["fn_names"](spark, str(tmp_path)).collect()} == want


def test_sentence_frames_take_whole_texts(spark, tmp_path):
    spark.createDataFrame([(0, "latte cotto e burro fuso"), (7, "latte cotto e burro fresco")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = registry.QUERIES["fn_sentence_frames"](spark, str(tmp_path)).collect()
    assert (r.n, r.n_matched, r.n_sentences) == (2, 2, 2)


def test_stream(spark, tmp_path):
    from quern.streaming.clean import run_available

    rows = spark.read.parquet(str(SF / "documents.parquet"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_sources_round_trip(spark, tmp_path):
    from quern.sources import io

    df = spark.createDataFrame([("a b", 1), ("c", 2)], "attribute string, n int")
    io.write_by_attribute(df, str(tmp_path / "p"))
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["attribute_slug=a_b", "attribute_slug=c"]
    (tmp_path / "v.txt").write_text("# head\n\n7\tpanna\tpanna, panne\n3\tmm\tmm\n9\tburro\tburro\n")
    assert [r.lemma for r in io.read_vocabulary(spark, str(tmp_path / "v.txt"), ["mm"]).orderBy("at").collect()] == ["panna", "burro"]  # the file's order
    (tmp_path / "s.json").write_text('{"train": ["a"], "val": [], "test": ["b", "c"]}')
    assert io.read_splits(spark, str(tmp_path / "s.json")).count() == 3
    assert io.codebook_keys(spark.createDataFrame([("TN_302", "C0A")], "dairy string, code string")).count() == 3
