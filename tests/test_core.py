import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import header_key, page_list
from paperloom.plans import registry
from paperloom.sources import readers, sinks
from paperloom.streaming import events


def test_every_twin_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_page_list(spark):
    df = spark.createDataFrame([("1-3,7", 9), ("all", 3), ("first", 5), ("2,2,1", 4), ("8-12", 9), ("x", 3)], "s string, n int")
    assert [r[0] for r in df.select(page_list(F.col("s"), F.col("n"))).collect()] == [[1, 2, 3, 7], [1, 2, 3], [1], [1, 2], [8, 9], []]
    assert spark.range(1).select(header_key(F.lit("  Unit \n Price "))).first()[0] == "unit price"


def test_json_lines_quarantine(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n{"a": \n{"b": "y"}\n\n')
    ok, bad = readers.read_json_lines(spark, str(p), "a int, b string", ("a",))
    assert [tuple(r) for r in ok.collect()] == [(1, "x")] and bad.count() == 2


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"sets": [{"name": "s", "document_type": "invoice", "options": {"kie": "on"}, "files": ["a", "b"]}]}')
    rows = readers.read_manifest(spark, str(p)).collect()
    assert {r.file for r in rows} == {"a", "b"} and rows[0].options == {"kie": "on", "document_type": "invoice"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (3, "n")], "k int, v string")
    once = sinks.upserted(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "z"), (2, "c"), (3, "n")]
    assert sorted(map(tuple, sinks.upserted(once, new, "k").collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(ValueError):
        sinks.upserted(old, new.withColumnRenamed("v", "w"), "k")


def test_event_stream_drops_repeats(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [("a", 1, "start", 0.0, t, t), ("a", 1, "start", 0.0, t, t), ("a", 2, "done", 1.0, t, t)]
    schema = "task_id string, id long, type string, progress double, ts timestamp, received_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = events.event_log(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    events.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2
    assert events.task_states(out).first().state == "done"
