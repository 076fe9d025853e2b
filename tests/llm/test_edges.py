"""Nulls, empty tables, very long texts, repeats and clashing columns for every operator; mixing under skew and caps."""

import pytest

from paperloom.llm import addresses, leakage, lookalikes, mixing, pii, scans, subjects

CLASH = "doc_id long, text string, k string, t string, word string, n long, pos int, item_id long, kind string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", None, "w", 1, 2, 3, "x") for i, t in enumerate(texts)], CLASH)


LONG = "the court order and the arbitration clause were filed by the plaintiff again " * 3000
TEXTS = [None, "", " ", "\n\n", LONG, "short", "short"]


def test_subjects(spark):
    got = {tuple(r) for r in subjects.document_subjects(frame(spark, TEXTS)).collect()}
    assert got == {(4, "law")}
    assert subjects.document_subjects(frame(spark, []).limit(0)).count() == 0


def test_personal_spans_and_masks(spark):
    long = LONG + " Contact person: Helen Aldringsby. " + LONG
    df = frame(spark, [*TEXTS, long])
    assert {(r.doc_id, r.pii_value) for r in pii.personal_spans(df, ["doc_id"], "text").collect()} == {("7", "Helen Aldringsby")}
    out = pii.masked(df, "text")
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[7] == long.replace("Helen Aldringsby", "[NAME]")
    assert pii.masked(df.limit(0), "text").count() == 0 and pii.masked_json(df.limit(0), "text").count() == 0


def test_lookalikes(spark):
    df = frame(spark, [*TEXTS, LONG + "сору"])
    out = {r.doc_id: r for r in lookalikes.normalized(df, "doc_id", "text").collect()}
    assert len(out) == 8 and out[0].text is None and out[1].text == "" and out[7].text == LONG + "copy" and out[7].word == "w"
    assert lookalikes.normalized(df.limit(0), "doc_id", "text").count() == 0


def test_leakage(spark):
    item = " ".join(f"w{i}x{i * 7 % 13}y" for i in range(40))
    items = spark.createDataFrame([(1, item, "z"), (2, item, "z"), (3, None, "z")], "item_id long, text string, doc_id string")
    got = {tuple(r) for r in leakage.leaked_items(frame(spark, [*TEXTS, LONG + item + LONG]), items).collect()}
    assert got == {(7, 1), (7, 2)}
    assert leakage.leaked_items(frame(spark, TEXTS), items.limit(0)).count() == 0


def test_scans(spark):
    parts = "tbl string, rec_id string, parts array<struct<node:string,page:int,text:string>>"
    rows = [("documents", str(i), None if t is None else [("", None, t)]) for i, t in enumerate(TEXTS)] + [("documents", "9", []), ("documents", "8", [("", None, None)])]
    df = spark.createDataFrame(rows, parts)
    assert scans.defects(df).count() == 0
    out = {r.rec_id: r.text for r in scans.repaired(df).collect()}
    assert len(out) == 9 and out["5"] == "short" and out["4"].startswith("the court order") and out["9"] == ""
    assert scans.repaired(df.limit(0)).count() == 0


def test_addresses(spark):
    schema = "address_id long, content string, street_address string, city string, state string, postal_code string, k string, form string, location string"
    rows = [(1, None, None, None, None, None, "a", "b", "c"), (2, "12 Oak Street, Springfield 62704", None, None, None, None, "a", None, "c"), (3, "Oak St. 12, 62704 Springfield", None, None, None, None, None, "b", "c"), (4, "x" * 5000, None, None, None, None, None, None, None), (5, "12", "", " ", None, "", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in addresses.same_location_pairs(df).collect()} == {(2, 3)}
    assert {r.address_id for r in addresses.address_classes(df).collect()} == {2, 3, 4, 5}
    assert addresses.same_location_pairs(df.limit(0)).count() == 0


def mix(spark, rows, targets):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rate double, copies int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = mixing.mixed(df, t)
    return out, {r.source: r for r in mixing.mix_report(out, t).collect()}


def test_mixing_with_a_cap_that_binds(spark):
    rows = [(i, "big", "word " * 10, 1.0, 1) for i in range(400)] + [(1000 + i, "small", "word " * 10, 1.0, 1) for i in range(20)]
    out, report = mix(spark, rows, [("big", 0.5, 1), ("small", 0.5, 3)])
    assert report["small"].most_copies == 3 and report["small"].mixed_tokens <= 3 * report["small"].tokens
    assert report["small"].actual_share == pytest.approx(0.5, abs=0.02)
    assert {r.copies for r in out.filter("source = 'small'").collect()} == {3}


def test_mixing_at_a_hundredfold_skew(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 500)
    rows = [(i, "hot", "word " * (1 + i % 40), 1.0, 1) for i in range(10_000)] + [(20_000 + i, "cold", "word " * (1 + i % 40), 1.0, 1) for i in range(100)] + [(30_000, None, "word", 1.0, 1), (30_001, "hot", None, 1.0, 1), (30_002, "hot", "", 1.0, 1)]
    out, report = mix(spark, rows, [("hot", 0.9, 1), ("cold", 0.1, 2)])
    assert report["hot"].actual_share == pytest.approx(0.9, abs=0.01) and report["cold"].actual_share == pytest.approx(0.1, abs=0.01)
    assert out.count() == 10_102 and out.filter("copies > 2").count() == 0
