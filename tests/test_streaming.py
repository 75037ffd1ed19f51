"""The stateful stream against the batch query, over restarts, late rows and a batch that runs twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators import curate
from quern.streaming import first_seen

SCHEMA = "id long, k string, at timestamp"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def run(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = first_seen.start(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "k", "at", ["id"])
    query.awaitTermination()
    return query


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def known(spark, tmp_path):
    return {r.dedup_key: (r.frequency, r.first.id, r.first.time) for r in first_seen.current(spark, str(tmp_path / "out")).collect()}


def test_first_seen_over_restarts(spark, tmp_path):
    first = [(i, f"k{i % 7}", at(i / 10)) for i in range(200)] + [(1000, None, at(1)), (1001, None, at(0.5)), (1002, "x", None)]
    add(spark, tmp_path, first)
    assert first_seen.dropped_late(run(spark, tmp_path)) == 0
    batch = curate.first_by_key(spark.createDataFrame([r for r in first if r[2]], SCHEMA), F.col("k"), "at", ["id"]).collect()
    assert {k: v[:2] for k, v in known(spark, tmp_path).items()} == {r.dedup_key: (r.frequency, r.id) for r in batch}
    # a later run, after a restart: an earlier row in time that is not too late takes the first place
    second = [(2000, "k0", at(19.8)), (2001, "k1", at(0.05)), (2002, "new", at(60))]
    add(spark, tmp_path, second)
    query = run(spark, tmp_path)
    got = known(spark, tmp_path)
    assert got["k0"][0] == 30 and got["new"] == (1, 2002, at(60)) and got["k1"] == (30, 2001, at(0.05))
    # the watermark stands at 59 h now: what is older than its period is dropped and counted
    add(spark, tmp_path, [(3000, "k0", at(1)), (3001, "new", at(59.5))])
    query = run(spark, tmp_path)
    assert first_seen.dropped_late(query) >= 1
    after = known(spark, tmp_path)
    assert after["k0"] == got["k0"] and after["new"] == (2, 3001, at(59.5))
    # nothing new: nothing changes
    run(spark, tmp_path)
    assert known(spark, tmp_path) == after


def test_a_batch_that_runs_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    write = first_seen.by_batch(str(tmp_path / "log"), "csv", header=True)
    for batch in (0, 1, 1, 1):
        write(rows.withColumn("n", F.col("n") + batch), batch)
    back = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert back.count() == 4 and {r.k for r in back.collect()} == {"a", "b"}
    done = spark.createDataFrame([("a", ""), ("b", "timeout"), ("c", None)], "k string, error string")
    every = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert sorted(r.k for r in first_seen.pending(every, done, "k", "error").collect()) == ["b", "d"]
