import json

import pytest

from paperloom.operators.inlining import flat_tables, schema_graph, shred, singular


def rows_of(spark, records, root="pages", **kw):
    df = spark.createDataFrame(list(enumerate(records)), "record_id long, j string")
    out = shred(df, "record_id", "j", root, **kw)
    return {(r.record_id, r.entity, r.node, r.parent) for r in out.collect() if r.entity != "record"}


def test_shapes_give_the_same_nodes(spark):
    block = {"type": "text", "payload": {"text": "a", "cells": [{"row": 0}, {"row": 1}]}, "provenance": {"s": 1}}
    twice = {"pages": [{"blocks": [block | {"provenance": [{"s": 1}, {"s": 2}]}]}]}
    listed = {"fused": {"pages": [{"blocks": [block]}]}}
    variants = [listed, {"fused": json.dumps(listed["fused"])}, {"pages": [{"blocks": block}]}, {"fused": {"pages": {"1": {"blocks": [block]}}}}]
    found = rows_of(spark, [json.dumps(v) for v in [*variants, twice]])
    for i in range(4):
        assert {x[1:] for x in found if x[0] == i} == {("page", "0", ""), ("block", "0.0", "0"), ("cell", "0.0.0", "0.0"), ("cell", "0.0.1", "0.0"), ("provenance", "0.0.0", "0.0")}


def test_unreadable_null_and_empty(spark):
    ok = json.dumps([{"task_id": "a", "items": [{"x": 1}, None, {"x": 2}]}])
    found = rows_of(spark, [None, "", "{", "[]", "null", "{}", ok, json.dumps(ok), json.dumps({"tasks": json.loads(ok)}), json.dumps({"task_id": "b"})], "tasks", listed=True)
    assert {x[0] for x in found} == {6, 7, 8, 9}
    assert {x[1:] for x in found if x[0] == 6} == {("task", "0", ""), ("item", "0.0", "0"), ("item", "0.2", "0")}


def test_graph_and_inlined_columns(spark):
    df = spark.createDataFrame([(1, json.dumps({"pages": [{"n": 1, "size": {"w": 2}}, {"n": 2}]}), "x")], "record_id long, j string, node string")
    graph = schema_graph(df, "j", "pages")
    assert graph.tables == {"pages"} and "size" in graph.compound
    assert graph.columns("pages") == {"n": "bigint", "size.w": "bigint"}
    got = flat_tables(df, "record_id", "j", "pages")["page"].orderBy("node").collect()
    assert [(r.n, r.size_w) for r in got] == [(1, 2), (2, None)]
    assert shred(df.limit(0), "record_id", "j", "pages").count() == 0


def test_recursive_label_gets_a_table(spark):
    found = rows_of(spark, [json.dumps({"pages": [{"child": {"k": 1, "child": {"k": 2}}}]})])
    assert (0, "child", "0.0.0", "0.0") in found


@pytest.mark.parametrize("label,name", [("pages", "page"), ("provenance", "provenance"), ("cells", "cell"), ("address", "address")])
def test_singular(label, name):
    assert singular(label) == name


def test_columns_are_typed_and_never_clash(spark):
    records = [{"pages": [{"node": "x", "a_b": 1, "a": {"b": 2.5}, "ok": True, "mixed": 1}, {"mixed": "t", "a": {"b": 3}, "tags": ["p", "q"], "none": None}]}, {"pages": "[{\"a_b\": 7}]"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "record_id long, j string")
    page = flat_tables(df, "record_id", "j", "pages")["page"]
    assert dict(page.dtypes) == {"record_id": "bigint", "node": "string", "parent_entity": "string", "parent": "string", "a_b": "double", "a_b_2": "bigint", "mixed": "string", "node_2": "string", "ok": "boolean", "tags": "string"}
    rows = {(r.record_id, r.node): r for r in page.collect()}
    assert (rows[0, "0"].a_b, rows[0, "0"].a_b_2, rows[0, "0"].node_2, rows[0, "0"].ok) == (2.5, 1, "x", True)
    assert rows[0, "1"].tags == '["p", "q"]' and rows[0, "1"].a_b == 3.0 and rows[1, "0"].a_b_2 == 7
