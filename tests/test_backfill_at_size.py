"""Cell backfill: what moves between machines, and the rules that were joins before."""

import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.functions import strings
from paperloom.operators import backfill, trust
from paperloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["q_backfill_funnel", "q_backfill_summary", "q_proof_report"])
def test_lines_move_once(spark, name):
    """Only the line items are moved, by one exchange that all steps read, and at the end groups."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len([x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]) <= 1
    assert len(set(re.findall(r"ReadSchema: (\S+)", plan))) == 1 and "Python" not in plan


def test_folding_in_place_is_the_normal_form(spark):
    texts = ["plain 12", "ﬁx ①", "Ａ１，％", "é", "½", "株式会社㈱", "가", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strings.nfkc_in_place(F.col("t"))).collect()] == [unicodedata.normalize("NFKC", t) for t in texts]
    assert [r[0] for r in df.select(backfill.comparable(F.col("t"))).collect()] == [r[0] for r in df.select(strings.comparable(F.col("t"))).collect()]


def test_maximal_runs_equal_the_rule(spark):
    rows = [(k, a, b) for k in (1, 2) for a in range(5) for b in range(a, min(5, a + 3)) if (k * 7 + a * 3 + b) % 4]
    rows += [(1, 0, 1), (1, None, 2), (2, 3, None)]
    df = spark.createDataFrame([(k, 0, 0, a, b) for k, a, b in rows], "k int, block int, line int, first int, last int")
    known = [r for r in rows if None not in r]
    within = lambda k, a, b: any(x == k and y <= a and b <= z and (y < a or b < z) for x, y, z in known)
    want = [r for r in rows if None in r or not within(*r)]
    assert sorted(((r.k, r.first, r.last) for r in backfill.maximal_runs(df, ["k"]).select("k", F.col("first").alias("first"), "last").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["q_backfill_funnel", "q_backfill_summary", "q_proof_report"])
def test_words_are_not_paired_with_all_cells(spark, name):
    """Only tables are joined, to words and to cells; both meet in a union by cell that moves none of them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    assert len([x for x in lines if "SortMergeJoin" in x or "NestedLoop" in x]) == 0 and len([x for x in lines if "ShuffledHashJoin" in x]) == 2
    union = next(i for i, x in enumerate(lines) if re.search(r"\bUnion\b", x))
    assert not any("Exchange" in x and "REPARTITION_BY_NUM" not in x for x in lines[union - 3 :])


def test_rows_and_columns_of_few_candidates_are_those_of_all(spark):
    stretches = [(y, y + h) for y in (-30.0, 0.0, 3.3, 9.9, 10.0, 14.9, 15.0, 19.99, 25.0, 29.7, 31.0, 80.0) for h in (-1.0, 0.0, 4.0, 9.9, 10.0, 10.1, 33.0)]
    df = spark.createDataFrame([(a, b, n) for a, b in stretches for n in (0, 1, 3)], "a double, b double, n int")
    got = df.select("a", "b", "n", backfill.band_row(F.col("a"), F.col("b"), F.lit(0.1), F.lit(0.1) + 10.0 * F.col("n"), F.col("n")).alias("row"), backfill.nearest_column(F.col("a"), F.lit(0.1), F.lit(0.1) + 10.0 * F.col("n"), F.col("n")).alias("col")).collect()
    for r in got:
        top, low = 0.1, 0.1 + 10.0 * r.n
        h = (low - top) / r.n if r.n else 0
        overlap = [min(r.b, top + (i + 1) * h) - max(r.a, top + i * h) for i in range(r.n)]
        assert r.row == (overlap.index(max(overlap)) if r.n else None)
        away = [(abs(top + (j + 0.5) * h - r.a), j) for j in range(r.n)]
        away = [x for x in away if x[0] <= h / 2 + max(0.05 * (low - top), 0.6 * h)]
        assert r.col == (min(away)[1] if away else None)


def test_first_runs_are_the_longest_runs(spark):
    rows = [(k, 0, 0, i, float(i), t) for k, ts in enumerate([["1", "2"], ["1", " ", "2"], ["", "1"], ["1", ""], ["", "", "", "1", ""], ["", ""], ["5", "5", None, "5", "5", "5"]]) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k int, block int, line int, word_no int, x0 double, text string")
    runs = backfill.word_runs(df, ["k"]).filter("norm <> ''").select("*", F.col("norm").alias("of"))
    want = sorted((r.k, r["first"], r.norm) for r in backfill.maximal_runs(runs, ["k", "of"]).collect())
    got = backfill.first_runs(df, ["k"]).select("k", "word_no", F.explode("runs").alias("norm")).collect()
    assert sorted((r.k, r.word_no, r.norm) for r in got) == want


def test_word_on_an_edge_and_a_table_without_rows(spark):
    """A word on the edge of two rows is across for both, the visual row it stands for decides; a table without a grid fails no other."""
    words = spark.createDataFrame([("d", 1, 0, 0, 0, 10.0, 45.0, 40.0, 55.0, "1250"), ("e", 1, 0, 0, 0, 1.0, 1.0, 2.0, 2.0, "1250")], "doc string, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    tables = spark.createDataFrame([("d", 1, "t", 0.0, 0.0, 200.0, 200.0, 2, 2), ("e", 1, "t", 0.0, 0.0, 200.0, 200.0, 0, 0)], "doc string, page int, tbl string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int")
    cells = spark.createDataFrame([("d", 1, "t", 0, 0, "125O"), ("d", 1, "t", 1, 0, "125O"), ("e", 1, "t", 0, 0, "1250"), ("e", 1, None, 0, 0, "1250")], "doc string, page int, tbl string, row int, col int, text string")
    got = {(r.doc, r.tbl, r.row): (r.provenance, r.reason) for r in backfill.solved(tables, words, cells).collect()}
    assert got["d", "t", 0] == ("text_backfilled", "cluster") and got["d", "t", 1] == ("text_mismatch", "crossing")
    assert got["e", "t", 0] == got["e", None, 0] == ("text_mismatch", "shape_mismatch")


def test_proof_over_all_is_the_total_of_the_levels(spark):
    rows = [("a", "t", "text_confirmed", 0.95), ("a", "t", "text_mismatch", None), ("a", "u", "vision", 0.5), ("b", "t", "text_backfilled", None)]
    cells = spark.createDataFrame(rows, "doc string, tbl string, provenance string, confidence double")
    levels, whole = trust.proof_report(cells), trust.proof_report(cells, whole=True)
    assert levels.count() == 6 and levels.columns == whole.columns
    total = whole.first()
    assert levels.filter("doc is null and tbl is null").collect() == [total] and (total.cells, total.low, total.unmeasured, total.coverage) == (4, 1, 2, 0.6667)
    assert trust.proof_report(cells.limit(0), whole=True).count() == trust.proof_report(cells.limit(0)).count() == 0
    assert "Expand" not in registry.QUERIES["q_proof_report"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
