"""Streams over files in two steps against the same fold over everything."""

import datetime as dt

from pyspark.sql import functions as F

from doctide.operators.sequences import Breaker
from doctide.streaming.follow import breaker_stream, bursts, follow_latest, upsert_sink


def run(spark, tmp_path, name, schema, parts, build, mode):
    """Feeds the parts one batch each and returns all rows put out."""
    folder = str(tmp_path / name)
    spark.createDataFrame([], schema).write.parquet(folder)
    query = build(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_follow_latest(spark, tmp_path):
    parts = [[(1, 0, 1, 1), (1, 0, 3, 2), (1, 0, 2, 3), (2, 5, 9, 4)], [(1, 0, 2, 5), (2, 6, 1, 6)], [(1, 1, 1, 7)]]
    rows = run(spark, tmp_path, "follow", "key long, epoch long, rev long, arrival long", parts, follow_latest, "update")
    assert [tuple(r) for r in sorted(rows, key=lambda r: r["arrival"])] == [(1, 0, 3, 2), (2, 5, 9, 4), (2, 6, 1, 6), (1, 1, 1, 7)]


def test_breaker_stream_keeps_state_between_batches(spark, tmp_path):
    outcomes = [(1, t, t % 3 != 0) for t in range(60)]
    rows = run(spark, tmp_path, "breaker", "service long, t long, failed boolean", [outcomes[:25], outcomes[25:]], breaker_stream, "append")
    breaker = Breaker()
    assert [r["state"] for r in sorted(rows, key=lambda r: r["t"])] == [breaker.step(t, f) for _, t, f in outcomes]


def test_bursts(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    parts = [[(1, at(0), "a"), (1, at(20), "b"), (1, at(90), "c")], [(1, at(900), "z")], [(1, at(1800), "z")]]
    rows = run(spark, tmp_path, "bursts", "key long, ts timestamp, item string", parts, lambda s: bursts(s, "ts", "key"), "append")
    assert {(r["n"], tuple(r["items"])) for r in rows} >= {(2, ("a", "b")), (1, ("c",))}


def test_upsert_sink_replaces_its_own_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "key long, arrival long, v string")
    for _ in range(2):
        upsert_sink(str(tmp_path / "sink"))(df, 0)
    assert sorted((r["key"], r["v"]) for r in spark.read.parquet(str(tmp_path / "sink")).select("key", F.col("v")).collect()) == [(1, "new"), (2, "x")]
