"""Sources and sinks, written and read back."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.sources import io


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", cell', "two\nlines"), (2, "", None), (3, "è", "x")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    io.write_csv(df, str(tmp_path / "t"), ["b", "id", "a"])
    assert next(Path(tmp_path / "t").glob("*.csv")).read_text().splitlines()[0] == "b,id,a"
    back = io.read_csv(spark, str(tmp_path / "t"), "b string, id int, a string").orderBy("id").collect()
    assert [(r.id, r.a or "", r.b or "") for r in back] == [(i, a or "", b or "") for i, a, b in rows]


def test_splits_and_json(spark, tmp_path):
    (tmp_path / "splits.json").write_text(json.dumps({"train": ["b", "a"], "val": [], "test": ["c"]}, indent=1))
    got = io.read_splits(spark, str(tmp_path / "splits.json"))
    assert {(r.split, r.sample_id) for r in got.collect()} == {("train", "a"), ("train", "b"), ("test", "c")}
    io.write_splits(got, str(tmp_path / "out"))
    assert {r.split: list(r.ids) for r in spark.read.json(str(tmp_path / "out")).collect()} == {"train": ["a", "b"], "test": ["c"]}
    io.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "one"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "one").glob("*.json"))) == {"a": 1, "b": None}


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("# head\n\n9\tpanna\tpanna, Panne\n12\tall'apertura\tx\n7\tburro\tburro\n3\tlatte\n")
    got = io.read_vocabulary(spark, str(path), ["all'apertura"], 2)
    assert [(r["count"], r.lemma) for r in got.orderBy("at").collect()] == [(9, "panna"), (7, "burro")]  # the file's order
    assert {r.surface for r in io.surface_set(got).collect()} == {"panna", "panne", "burro"}


def test_calendar_and_lookup(spark, tmp_path):
    (tmp_path / "c.csv").write_text("n,date\n1,17-01-2018\n x,18-01-2018\n2,\n3,31-02-2018\n4, 07-02-2018 \n")
    assert [(r.n, str(r.session_date)) for r in io.read_calendar(spark, str(tmp_path / "c.csv")).orderBy("n").collect()] == [(1, "2018-01-17"), (4, "2018-02-07")]
    for name, body in (("a", "k,v\nx,1\ny,2\n"), ("b", "k,v\ny,3\ny,4\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    got = io.read_lookup(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "k string, v string", "k")
    assert {r.k: r.v for r in got.collect()} == {"x": "1", "y": "4"}  # the last wins


def test_listing_and_labels(spark, tmp_path):
    for p in ("2020/a.bmp", "2020/deep/b.bmp", "2020/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    got = io.list_images(spark, str(tmp_path)).collect()
    assert sorted(Path(r.path).name for r in got) == ["a.bmp", "b.bmp"] and {r.length for r in got} == {5}
    for model in ("m1/Aroma", "baselines/freq/Aroma"):
        (tmp_path / "runs" / model).mkdir(parents=True)
        (tmp_path / "runs" / model / "predictions.csv").write_text("pred,ref\na,b\n")
    labelled = io.read_labelled(spark, str(tmp_path / "runs"), "pred string, ref string", str(tmp_path / "runs"))
    assert {r.file for r in labelled.collect()} == {"m1/Aroma", "baselines/freq/Aroma"}


def test_workbook(spark):
    sheets = {" Aroma ": [("a", 1), ("b",), ("c", None, "extra")], "Notes": [("x", "y")]}
    got = io.workbook_rows(spark, sheets, ["text", "score"], {"aroma": "Aroma"}).collect()
    assert [(r.text, r.score, r.attribute) for r in got] == [("a", "1", "Aroma"), ("b", None, "Aroma"), ("c", None, "Aroma")]


def test_outcomes_and_attributes(spark, tmp_path):
    df = spark.createDataFrame([("Colore della Pasta", None), ("Aroma", "short")], "attribute string, drop_reason string")
    io.write_kept_and_dropped(df, str(tmp_path / "o"))
    assert {(r.attribute, r.outcome) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {("Colore della Pasta", "kept"), ("Aroma", "short")}
    io.write_by_attribute(df, str(tmp_path / "a"))
    assert {p.name for p in (tmp_path / "a").iterdir() if p.is_dir()} == {"attribute_slug=Colore_della_Pasta", "attribute_slug=Aroma"}
    assert io.deliverable(df, {"attribute": "tag"}).columns == ["tag"]


def test_rewrite_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    io.rewrite_in_place(spark, path, lambda df: df.withColumn("twice", F.col("id") * 2))
    assert sorted(r.twice for r in spark.read.parquet(path).collect()) == [0, 2, 4]
    Path(path).rename(path + ".old")  # a swap that broke off between its two renames
    io.rewrite_in_place(spark, path, lambda df: df.filter("id > 0"))
    assert spark.read.parquet(path).count() == 2 and not Path(path + ".old").exists()


def test_unique_names(spark):
    good = spark.createDataFrame([("a/b.bmp",), ("a/c.bmp",)], "p string")
    io.assert_unique_names(good, "p")
    with pytest.raises(ValueError, match="a__b.bmp"):
        io.assert_unique_names(good.union(spark.createDataFrame([("a__b.bmp",)], "p string")), "p")


def test_report_and_prompts(spark, tmp_path):
    text = io.report("Run", {"counts": spark.range(4).orderBy("id")}, most=2)
    assert text.splitlines()[0] == "Run" and "... and 2 more" in text
    io.write_texts(spark, spark.createDataFrame([("Aroma", "# Aroma\ntext")], "n string, t string"), str(tmp_path / "p"), "n", "t")
    assert next((tmp_path / "p" / "name=Aroma").glob("*.txt")).read_text() == "# Aroma\ntext\n"


def test_missing_uploads(spark):
    from quern.sources import io

    local = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, size long")
    there = spark.createDataFrame([("a", 1), ("b", 9), ("b", 8), ("d", 4), ("a", 7)], "name string, size long")
    assert sorted((r.name, r.why) for r in io.missing_uploads(local, there, "name", "size").collect()) == [("b", "size"), ("c", "absent")]
    assert io.missing_uploads(local, there.limit(0), "name", "size").count() == 3


def test_report_in_one_file(spark, tmp_path):
    from quern.plans import registry
    from quern.sources import io

    lines = registry.QUERIES["rpt_preparation"](spark, "/root/testdata/sf0.001")
    io.write_lines(lines, str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*")
    text = part.read_text().split("\n")
    assert text[1] == "## 1 rows" and text[2] == "input rows  : 200" and [x for x in text if x.startswith("## ")] == sorted(x for x in text if x.startswith("## "))
    assert len(text) == lines.count() + 5 * 2 + 1  # a blank and a name for each section, and the end
