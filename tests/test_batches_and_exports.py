"""Fields over pages and windows, accuracy, batches, exports, engines and streams on literal cases."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import accuracy, batches, fields
from paperloom.sources import engines, exports, sinks
from paperloom.streaming import events

T = dt.datetime(2025, 1, 1)


def test_pages_are_merged(spark):
    rows = [("t", "2", "total", "9"), ("t", "1", "total", "5"), ("t", "3", "total", " "), ("t", "1", "items", '[{"a":1}]'), ("t", "2", "items", '[{"a":2},{"a":3}]'), ("t", "1", "raw_output", "x"), ("t", "0", "line_items", "one"), ("t", "1", "line_items", "[]")]
    df = spark.createDataFrame(rows, "task string, page string, field string, value string")
    got = {r.field: r.value for r in fields.merged_pages(df).collect()}
    assert got["total"] == "9" and json.loads(got["items"]) == [{"a": 1}, {"a": 2}, {"a": 3}] and json.loads(got["line_items"]) == ["one"] and "raw_output" not in got


def test_windows_overlap_by_one_block(spark):
    df = spark.createDataFrame([("d", 1, i, "x" * 20) for i in range(6)] + [("e", 1, 0, "y" * 500), ("e", 1, 1, "z")], "doc string, page int, idx int, text string")
    got = [(r.doc, r.window, r.first, r.last) for r in fields.text_windows(df, 90).orderBy("doc", "window").collect()]
    assert got == [("d", 0, 0, 2), ("d", 1, 2, 4), ("d", 2, 4, 5), ("e", 0, 0, 0), ("e", 1, 1, 1)]
    f = spark.createDataFrame([("t", 1, 0, "q", "s"), ("t", 0, 0, "q", "s "), ("t", 1, 1, "r", "s")], "task string, window int, ordinal int, quote string, statement string")
    assert [(r.window, r.quote, r.position) for r in fields.merged_windows(f).orderBy("position").collect()] == [(0, "q", 1), (1, "r", 2)]


def test_maps_of_fields(spark):
    one = spark.range(1).select(F.create_map(*[F.lit(x) for x in ("total", "5", "name", " ", "items", "[]", "raw_output", "x")]).alias("f")).select(
        fields.meaningful(F.col("f")).alias("n"), fields.backfilled(F.col("f"), ["total", "date", "items"]).alias("b"), fields.pruned(F.col("f")).alias("p"),
        fields.filled_queries(F.col("f"), F.array(F.lit("name"), F.lit("total"))).alias("q"), fields.production_hit(F.col("f"), F.lit("receipt")).alias("h"), fields.contract(F.lit("failed"), F.lit(0)).alias("c"),
    ).first()
    assert one.n == 1 and one.b["date"] == "" and one.b["total"] == "5" and "items" not in one.p and one.q == ["total"] and one.h.reason == "production_hit" and one.c.reason == "stage_not_completed:failed"
    assert fields.dotted('{"a": {"b": 1, "c": [1, 2]}, "d": null}') == {"a.b": "1", "a.c": "[1, 2]"}
    with pytest.raises(Exception, match="already in the schema"):
        m = F.create_map(F.lit("a"), F.lit("x"))
        spark.range(1).select(fields.extended_schema(m, m)).collect()


def test_ground_truth(spark):
    c = "doc int, tbl int, row int, col int, text string"
    t = spark.createDataFrame([(1, 1, 0, 0, "$1,0"), (1, 1, 0, 1, ""), (1, 1, 1, 0, "B"), (1, 1, 2, 0, "x"), (1, 1, 3, 0, "")], c)
    a = spark.createDataFrame([(1, 1, 0, 0, "1,0"), (1, 1, 0, 1, "y"), (1, 1, 1, 0, "c"), (1, 1, 9, 0, "more")], c)
    items = accuracy.cell_items(t, a)
    assert {(r.row, r.col): r.status for r in items.collect()} == {(0, 0): "match", (0, 1): "gt_empty", (1, 0): "wrong", (2, 0): "missing"}
    r = accuracy.accuracy(items, []).first()
    assert (r.total, r.evaluable, r.matched, r.missing, r.wrong, r.accuracy) == (4, 3, 1, 1, 1, 0.3333)
    assert accuracy.same_shape(t, a).first().same is False and accuracy.bad_cells(items).count() == 2


def test_fuzzy_matches_are_used_once(spark):
    c = "doc int, n int, page int, text string"
    t = spark.createDataFrame([(1, 0, 1, "Table 1 sums"), (1, 1, 1, "Table 1 sums"), (1, 2, 1, "unlike")], c)
    a = spark.createDataFrame([(1, 7, 1, "table 1 sums")], c)
    got = {r.n: r.status for r in accuracy.matched_captions(t, a).collect()}
    assert got[0] == "match" and got[1] == "missing" and got[2] in ("missing", "near")
    h = accuracy.found_headings(t.select("doc", "n", "text"), spark.createDataFrame([(1, "see: Table 1 sums")], "doc int, text string"))
    assert {r.n: r.present for r in h.collect()} == {0: True, 1: True, 2: False}
    o = accuracy.order_score(spark.createDataFrame([(1, 1, i, x) for i, x in enumerate("abcd")], "doc int, page int, place int, id string"), spark.createDataFrame([(1, 1, i, x) for i, x in enumerate("acbd")], "doc int, page int, place int, id string"))
    assert o.first().score == 0.75


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", i == 3) for i in range(40)], "id int, s string, risk boolean")
    got = accuracy.stratified(df, "s", "id", 9, F.col("risk")).collect()
    assert len(got) == 9 and 3 in {r.id for r in got} and sum(r.s == "b" for r in got) == 2
    assert {r.id for r in got} == {r.id for r in accuracy.stratified(df.orderBy(F.desc("id")), "s", "id", 9, F.col("risk")).collect()}


def test_names_and_columns(spark):
    t = spark.createDataFrame([("b", "1", "x/a b.pdf", "completed", None, '{"kie_fields": {"total": "5", "deep": {"k": [1]}}}'), ("b", "2", "a b.pdf", "completed", None, None), ("b", "3", "a_b_2.pdf", "completed", None, None), ("b", "4", "z.pdf", "failed", "boom", None)], "batch_id string, task_id string, file_name string, status string, error string, result string")
    names = {r.task_id: r.file for r in batches.split_names(t).collect()}
    assert names["1"] == "a_b.csv" and names["3"] == "a_b_2.csv" and len(set(names.values())) == 3
    table = batches.kie_table(t)
    assert [r.column for r in table.select("column", "place").distinct().orderBy("place").collect()] == [*batches.CORE_COLUMNS, "deep.k", "total"]
    assert {r.task_id for r in batches.kie_table(t, passed_only=True).collect()} == {"1", "2", "3"}
    assert '"error"' not in batches.json_bundle(t).filter("task_id = '1'").first().line
    assert {r.task_id: r.status for r in batches.retry(t.withColumns({"started_at": F.current_timestamp(), "completed_at": F.current_timestamp()})).collect()}["4"] == "pending"


def test_state_of_batches(spark):
    e = spark.createDataFrame([("b", 1, "start", T), ("b", 2, "pause", T), ("c", 1, "start", T), ("c", 2, "cancel", T), ("c", 3, "resume", T)], "batch_id string, id int, action string, ts timestamp")
    assert {r.batch_id: r.state for r in batches.control_state(e).collect()} == {"b": "paused", "c": "cancelled"}
    t = spark.createDataFrame([("d", str(i), "processing" if i == 0 else "pending") for i in range(5)], "batch_id string, task_id string, status string")
    assert {r.task_id for r in batches.runnable(t, batches.control_state(e), 3).collect()} == {"1", "2"}
    log = spark.createDataFrame([("k", 1, "a", False), ("k", 2, "b", False), ("m", 1, "c", True)], "k string, n int, v string, gone boolean")
    assert [r.v for r in batches.compacted(log, "k", "n", "gone").collect()] == ["b"]
    d = batches.decoded(spark.createDataFrame([("", None), ('{"a":1}', '["x"]'), ("{", "[")], "o string, l string"), ["o"], ["l"]).collect()
    assert [(r.o, r.l) for r in d] == [({}, []), ({"a": "1"}, ["x"]), ({}, [])]
    with pytest.raises(ValueError):
        batches.upserted_rows(t, log)


def test_files(spark):
    cells = spark.createDataFrame([(1, 1, r, c, v) for r, row in enumerate([["a", "=b"], ["1", "2"]]) for c, v in enumerate(row)], "doc int, tbl int, row int, col int, text string")
    t = spark.createDataFrame([(1, 1, 2, 0.9, "Cap")], "doc int, tbl int, page int, confidence double, caption string")
    assert [r.line for r in exports.csv_lines(t, cells).orderBy("place").collect()] == ["'=== Table 1 (Page 2) confidence=90% ===", "Cap", "a,'=b", "1,2", ""]
    assert exports.csv_files(t, cells).first().file == "table_01_p2.csv"
    s = json.loads(exports.structured_tables(t, cells).first().json)
    assert (s["rowCount"], s["columnCount"], s["cells"][0]["kind"], s["cells"][2]["kind"]) == (2, 2, "columnHeader", "content")
    book = exports.table_workbook(t, cells)
    assert b"inlineStr" in zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet2.xml")
    blocks = spark.createDataFrame([(1, 1, 0, "title", "T", 0.99), (1, 1, 1, "text", "low", 0.5)], "doc int, page int, ord int, type string, text string, confidence double")
    md = exports.markdown(blocks, t, cells).first().text
    assert md.startswith("# Page 1\n\n## T\n\nlow _(confidence 50%)_") and "| a | =b |\n| --- | --- |\n| 1 | 2 |" in md
    pack = exports.zip_pack({"a/x.txt": b"1", "b.txt": b"22"}, ["f"])
    assert exports.copied_entries(pack, "a/") == {"a/x.txt": b"1"}
    with pytest.raises(ValueError):
        exports.zip_pack({"x": b"123"}, limit=2)
    with pytest.raises(ValueError):
        exports.zip_pack({"../x": b"1"})
    assert zipfile.ZipFile(io.BytesIO(exports.document([("Heading1", "A & B")]))).read("word/document.xml").count(b"A &amp; B") == 1
    m = exports.pack_manifest(spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "doc int, name string, bytes long"), 10).orderBy("name").collect()
    assert [(r.running, r.fits, r.too_large) for r in m] == [(5, True, True), (11, False, True)]
    i = spark.createDataFrame([("json, CSV,odd",), (None,)], "s string").select(exports.include_set(F.col("s")).alias("x")).collect()
    assert i[0].x.parts == ["json", "csv"] and i[0].x.unknown == ["odd"] and len(i[1].x.parts) == 5
    assert "<td>&lt;a&gt;</td>" in exports.report_html(spark.createDataFrame([(1, "<a>")], "k int, v string"), "k", ["v"]).first().html


def test_engines_and_pdf_pages(spark, tmp_path):
    pdf = b"%PDF-1.4\n1 0 obj<</Type /Pages/Count 2>>endobj 2 0 obj<</Type /Page>>endobj 3 0 obj<</Type/Page/Parent 1 0 R>>endobj /Title (A \\(b\\))"
    df = spark.createDataFrame([("x.pdf", bytearray(pdf)), ("y.png", bytearray(b"1")), ("z.pdf", bytearray(b"no"))], "path string, content binary")
    assert sorted((r.path, r.page) for r in engines.page_numbers(df).collect()) == [("x.pdf", 1), ("x.pdf", 2), ("y.png", 1)]
    assert engines.pdf_metadata(pdf)["Title"] == "A (b)" and engines.pdf_metadata(None)["page_count"] == "0"
    engines.register("recognition", "stub", lambda: lambda row: [(row["path"], 1)] if row["path"] != "z.pdf" else 1 / 0, "name string, n int")
    engines.register("recognition", "spare", lambda: lambda row: [("spare", 0)], "name string, n int")
    got = {r.path: (r.name, r.error) for r in engines.extracted(df, "recognition", "stub", ["path"]).collect()}
    assert got["x.pdf"] == ("x.pdf", None) and got["z.pdf"][0] is None and got["z.pdf"][1].startswith("ZeroDivisionError")
    assert {r.path: r.name for r in engines.retried(df, "recognition", "stub", "spare", ["path"]).collect()}["z.pdf"] == "spare"
    with pytest.raises(KeyError):
        engines.extracted(df, "layout", "none", ["path"])
    (tmp_path / "a b.json").write_text('{"k": {"x": 1}}')
    assert [tuple(r) for r in engines.configuration(spark, str(tmp_path)).collect()] == [("a_b", "k", '{"x": 1}')]
    assert engines.save_template(str(tmp_path / "t"), "../x y", {"a": 1}) == "x_y"
    r = spark.createDataFrame([(1, "{"), (2, '{"tables": []}'), (3, '{"tables": [], "quality": {"table_backfill": {}}}')], "doc int, result string")
    assert {x.doc: x.error for x in engines.contract_errors(r).collect()} == {1: "not_json", 2: "no_table_backfill"}


def test_guarded_csv_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([("+5", 1), ("\tx", 2), ("-3", 3), (None, 4)], "a string, n int")
    sinks.write_csv_guarded(df, str(tmp_path / "c"))
    back = {r.n: r.a for r in spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "c")).withColumn("n", F.col("n").cast("int")).collect()}
    assert back[1] == "'+5" and back[2].startswith("'") and back[3] == "-3" and back[4] is None
    seen = []
    write = sinks.fan_out([("bad", lambda d, b: 1 / 0), ("good", lambda d, b: seen.append(d.count()))])
    write(df, 0)
    assert seen == [4] and [f[1] for f in write.failures] == ["bad"]
    for k in range(4):
        (tmp_path / "k" / str(k)).mkdir(parents=True)
    assert len(sinks.keep_newest(str(tmp_path / "k"), 3)) == 1


def test_numbered_log_as_a_stream(spark, tmp_path):
    rows = [("a", f"e{i}", None) for i in range(5)] + [("b", "x", "m")]
    schema = "task_id string, type string, message string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.numbered_log(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep=3)
    events.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("task_id", "id", "first_kept").collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("b", 1, 1)]
