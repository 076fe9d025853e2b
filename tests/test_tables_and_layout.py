"""Tables, backfill, evidence, layout on literal cases."""

from pyspark.sql import functions as F

from paperloom.operators import backfill, evidence, layout, tables, trust

WORD = "doc string, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
TABLE = "doc string, page int, tbl string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int"
CELL = "doc string, page int, tbl string, row int, col int, text string"
ELEMENT = "doc string, page int, ord int, id string, type string, x0 double, y0 double, x1 double, y1 double, confidence double, reading_order int, text string, html string"


def el(n, kind, box, text="", page=1, order=None, conf=None):
    return ("d", page, n, f"e{n}", kind, *map(float, box), conf, order, text, None)


def solve(spark, words, cells, n_rows=1, n_cols=2, box=(0, 0, 200, 100)):
    w = spark.createDataFrame([("d", 1, 0, 0, i, *map(float, b), t) for i, (b, t) in enumerate(words)], WORD)
    t = spark.createDataFrame([("d", 1, "t", *map(float, box), n_rows, n_cols)], TABLE)
    c = spark.createDataFrame([("d", 1, "t", r, k, v) for r, k, v in cells], CELL)
    return {(r.row, r.col): r for r in backfill.solved(t, w, c).collect()}


def test_value_in_its_row_and_column(spark):
    got = solve(spark, [((10, 10, 40, 20), "1234")], [(0, 0, "1234"), (0, 1, "9999")])
    assert (got[0, 0].provenance, got[0, 0].reason) == ("text_confirmed", "value_match")
    assert got[0, 1].provenance == "text_mismatch"


def test_value_of_another_column_is_no_match(spark):
    w = [((90, 10, 100, 20), "1234")]
    assert solve(spark, w, [(0, 0, "1234")])[0, 0].reason != "value_match"
    assert solve(spark, w, [(0, 1, "1234")])[0, 1].reason == "value_match"


def test_nearest_of_equal_values(spark):
    w = [((10, 10, 25, 20), "777"), ((60, 10, 75, 20), "777")]
    got = solve(spark, w, [(0, 0, "777"), (0, 1, "777")])
    assert got[0, 0].word_bbox.x0 == 10 and got[0, 1].word_bbox.x0 == 60
    tie = solve(spark, [((10, 10, 20, 20), "777"), ((30, 10, 40, 20), "777")], [(0, 0, "777")])
    assert tie[0, 0].reason != "value_match"


def test_bank_statement_is_confirmed(spark):
    rows = [["Date", "Description", "Amount (USD)"], ["2024-01-05", "Opening balance", "1,250.00"], ["2024-01-12", "Invoice payment", "3,480.25"], ["2024-01-20", "Wire transfer", "12,900.00"], ["2024-02-01", "Service fee", "45.50"], ["2024-02-10", "Refund", "-250.00"], ["2024-02-18", "Closing balance", "17,425.75"]]
    words, xs = [], (44, 164, 374)
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            x = xs[c]
            for t in text.split():
                words.append((("d", 1, r * 3 + c, 0, len(words), float(x), 80.0 + 24 * r + 6, x + 5.0 * len(t), 80.0 + 24 * r + 16), t))
                x += 5 * len(t) + 3
    w = spark.createDataFrame([(*k, t) for k, t in words], WORD)
    t = spark.createDataFrame([("d", 1, "t", 80.0, 160.0, 1080.0, 160.0 + 7 * 48, 7, 3)], TABLE)
    c = spark.createDataFrame([("d", 1, "t", r, k, v) for r, row in enumerate(rows) for k, v in enumerate(row)], CELL)
    cells = backfill.solved(t, w, c)
    s = backfill.backfill_summary(cells).first()
    assert (s.candidates, s.confirmed, s.backfilled, s.mismatch) == (12, 12, 0, 0)
    assert s.reason_value_match == 12 and s.confirmed_rate == 1.0 and s.mismatches_cut == 0
    assert backfill.first_mismatches(cells).count() == 0


def test_misread_cell_is_filled_from_the_layer(spark):
    got = solve(spark, [((10, 30, 40, 40), "1250")], [(0, 0, "125O"), (0, 1, "40.7-4098MHz")])
    assert (got[0, 0].provenance, got[0, 0].reason, got[0, 0].text, got[0, 0].ocr_text) == ("text_backfilled", "geometric", "1250", "125O")
    assert got[0, 1].reason == "band_range_incomplete"


def test_word_across_the_border_and_plain_cells(spark):
    got = solve(spark, [((40, 30, 65, 40), "55")], [(0, 0, "77"), (0, 1, "some words")])
    assert got[0, 1].provenance == "vision" and got[0, 1].reason is None
    assert got[0, 0].provenance == "text_mismatch"


HTML = "<p>x</p><table><thead><tr><th colspan=2>Head</th><th>C</th></tr></thead><tr><td rowspan=2>a</td><td>b</td><td>c<table><tr><td>in</td></tr></table></td></tr><tr><td>d</td><td>e</td></tr><tr><td></td><td> </td><td></td></tr><tr><td>f</td><td>g</td><td>h</td></tr></table><table><tr><td>2</td><td>3</td></tr></table>"


def test_html_cells(spark):
    df = spark.createDataFrame([(1, HTML), (2, "<table><tr><td>one</td></tr></table>"), (3, None), (4, "no table")], "id int, html string")
    cells = tables.html_cells(df, ["id"])
    got = sorted((r.row, r.col, r.rowspan, r.colspan, r.text, r.is_header) for r in cells.collect())
    assert got == [(0, 0, 1, 2, "Head", True), (0, 2, 1, 1, "C", True), (1, 0, 2, 1, "a", False), (1, 1, 1, 1, "b", False), (1, 2, 1, 1, "c", False), (2, 1, 1, 1, "d", False), (2, 2, 1, 1, "e", False), (3, 0, 1, 1, "f", False), (3, 1, 1, 1, "g", False), (3, 2, 1, 1, "h", False)]
    p = tables.table_profile(cells, ["id"]).first()
    assert (p.n_rows, p.n_cols, p.header_rows, p.has_merged_cells) == (4, 3, 1, True)
    assert {(r.row, r.col): r.text for r in tables.grid(cells, ["id"]).collect()}[2, 0] == ""
    assert tables.header_spans(cells, ["id"]).count() == 1 and tables.real_tables(cells, ["id"]).count() == 1


def grid(spark, rows, id=1):
    return spark.createDataFrame([(id, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "id int, row int, col int, text string")


def test_mapping_by_header_position_and_second_row(spark):
    bank = [["Date", "Memo", "Debit", "Credit", "Balance"], ["d1", "m1", "5", "", "9"], ["", "", "", "", ""], ["d2", "m2", "", "7", "8"]]
    got = tables.mapped_rows(grid(spark, bank), ["id"], "bank_statement").orderBy("row_index").collect()
    assert [(r.row_index, r.transaction_date, r.description, r.amount, r.balance) for r in got] == [(0, "d1", "m1", "5", "9"), (2, "d2", "m2", "7", "8")]
    plain = tables.mapped_rows(grid(spark, [["x", "y", "z", "w"], ["d", "t", "1", "2"]]), ["id"], "bank_statement").collect()
    assert [(r.transaction_date, r.balance) for r in plain] == [("d", "2")]
    second = tables.mapped_rows(grid(spark, [["Invoice 1", "", ""], ["Item", "Qty", "Amount"], ["pen", "2", "3.00"]]), ["id"], "invoice_line_items").collect()
    assert [(r.line_description, r.quantity, r.line_total, r.unit_price) for r in second] == [("pen", "2", "3.00", "")]
    assert tables.mapped_rows(grid(spark, [["x", "y"], ["1", "2"]]), ["id"], "invoice_line_items").count() == 0
    own = tables.mapped_rows(grid(spark, [["SKU", "Menge"], ["a", "1"]]), ["id"], {"sku": [], "qty": ["Menge", "Quantity"]}).first()
    assert (own.sku, own.qty) == ("a", "1")
    assert tables.missing_fields(grid(spark, [["SKU"], ["a"]]), ["id"], {"sku": [], "qty": ["Menge"]}).first().missing == ["qty"]


def test_captions_and_spans(spark):
    cells = grid(spark, [["Table 1: sums", "", ""], ["a", "b", "c"], ["1", "2", "3"]])
    assert tables.caption_rows(cells, ["id"]).first().caption == "Table 1: sums"
    assert tables.without_captions(cells, ["id"]).agg(F.max("row")).first()[0] == 1
    spans = spark.createDataFrame([(1, 0, 0, 0, 1, 2), (1, 1, 1, 0, 1, 1), (1, 2, 1, 1, 1, 1)], "id int, ordinal int, row int, col int, rowspan int, colspan int")
    body = grid(spark, [["h", ""], ["a", "b"]])
    scores = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7)], "id int, ordinal int, confidence double")
    assert {(r.row, r.col): r.confidence for r in tables.spans_fit(spans, body, scores, ["id"]).collect()} == {(0, 0): 0.9, (1, 0): 0.8, (1, 1): 0.7}
    for bad in (scores.filter("ordinal < 2"), scores.limit(0)):
        assert tables.spans_fit(spans, body, bad, ["id"]).count() == 0
    assert tables.spans_fit(spans, grid(spark, [["h", "x"], ["a", "b"]]), scores, ["id"]).count() == 0


def test_quotes_by_ladder_and_prefix(spark):
    cases = [
        ("café trial", "café trial done", "verbatim_exact", "V1"), ("ﬁx the kit", "fix the kit now", "verbatim_exact", "V2"), ("outcomes   improved.", "outcomes improved.", "verbatim_exact", "V3"),
        ("IQR 6,838–19,034", "IQR 6,838-19,034 was stable", "verbatim_exact", "V4"), ("car- dioprotective", "the cardioprotective effect", "verbatim_exact", "V5"), ("meta-analysis", "a metaanalysis of trials", "verbatim_exact", "V6"),
        ("word " * 27 + "tail", "word " * 27 + "different ending words here", "near_match", None), ("word " * 10 + "tail", "word " * 7 + "other", "unsupported", None), ("", "text", "unsupported", None), (None, "text", "unsupported", None),
    ]
    df = spark.createDataFrame([(i, q, t) for i, (q, t, *_) in enumerate(cases)], "i int, q string, t string")
    got = [(r.m.verdict, r.m.variant) for r in df.select("i", evidence.quote_match(F.col("q"), F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == [(v, n) for *_, v, n in cases]


def test_fidelity(spark):
    df = spark.createDataFrame([("reduces risk clearly", "may reduce risk"), ("may reduce risk", "reduces risk clearly"), ("may x", "may y")], "c string, q string")
    assert [r[0] for r in df.select(evidence.fidelity(F.col("c"), F.col("q"))).collect()] == ["overclaim", "add_hedge", "faithful"]


FIND = "doc string, ordinal int, statement string, statement_type string, quote string, quote_block string, page int, population string, intervention string, comparator string, outcome string, followup string"
PAGE = "doc string, page int, text string, trusted boolean"


def test_gate(spark):
    slots = ("p", "i", "c", "o", "none")
    near = "word " * 27
    pages = spark.createDataFrame([("d", 1, "it may reduce risk in adults " + near + "x y z", True), ("d", 2, "hidden text", False)], PAGE)
    f = spark.createDataFrame([
        ("d", 1, "reduces risk", "result", "it may reduce risk", None, 1, *slots), ("d", 2, "it may reduce risk", "limitation", "it may reduce risk", None, 1, *slots),
        ("d", 3, "words", "result", near + "a b c", None, 1, *slots), ("d", 4, "s", "result", "hidden text", None, 2, *slots), ("d", 5, "s", "result", "reduce risk", None, 1, "p", "", None, "o", "x"),
    ], FIND)
    g = {r.ordinal: r for r in evidence.gated(f, pages).collect()}
    assert [g[i].route for i in range(1, 6)] == ["ledger", "export", "review+export", "ledger", "review(evidence_slot_incomplete)"]
    assert (g[1].axis, g[4].axis, g[4].detail, g[2].claim_type, g[1].id) == ("B", "A", "grounding unavailable", "limitations", "F-001")
    assert g[5].slots == ["intervention", "comparator"]
    r = evidence.gate_report(evidence.gated(f, pages)).first()
    assert (r.candidates, r.rejected, r.near_match, r.slot_incomplete, r.export_allowed) == (5, 2, 1, 1, False)
    assert evidence.ledger(evidence.gated(f, pages)).count() == 2


def test_attribution(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta gamma", True), ("d", 2, "alpha beta gamma and more", True), ("d", 3, "delta epsilon zeta eta", True)], PAGE)
    blank = (None,) * 5
    f = spark.createDataFrame([("d", 1, "s", "t", "beta gamma", "[p2_b0]", None, *blank), ("d", 2, "s", "t", "beta gamma", None, None, *blank), ("d", 3, "s", "t", "delta epsilon other", None, None, *blank), ("d", 4, "s", "t", "", None, None, *blank)], FIND)
    got = {r.ordinal: (r.page_found, r.how) for r in evidence.attributed(f, pages).collect()}
    assert got == {1: (2, "marker"), 2: (1, "scan"), 3: (3, "prefix"), 4: (None, "unresolved")}
    assert evidence.containing_page(f.select("doc", "ordinal", "quote"), pages).filter("ordinal = 2").first().found_page == 1


def test_statuses_and_kinds(spark):
    df = spark.createDataFrame([("table", ""), ("formula", ""), ("seal", ""), ("chart", ""), ("text", "x"), ("text", " "), ("odd", "x"), (None, None)], "t string, x string")
    rows = df.select(layout.processing_status(F.col("t"), F.col("x")).alias("s"), layout.view_kind(F.col("t")).alias("k")).collect()
    assert [r.s for r in rows] == ["skip_table", "skip_formula", "skip_seal", "extracted", "no_ocr", "no_ocr_empty", "passthrough_unknown_type", "passthrough_unknown_type"]
    assert [r.k for r in rows] == ["table", "formula", "seal", "figure", "paragraph", "paragraph", "odd", "paragraph"]


def test_orders_and_quality(spark):
    e = spark.createDataFrame([el(0, "text", (0, 50, 9, 60), "a", order=None, conf=0.0), el(1, "text", (0, 0, 9, 9), "b", order=2, conf=0.8), el(2, "table", (0, 20, 9, 30)), el(3, "figure", (0, 90, 9, 99), order=1)], ELEMENT)
    assert [r.id for r in layout.reading_order(e).orderBy("place").collect()] == ["e3", "e1", "e2", "e0"]
    assert [r.view_order for r in layout.view_order(e).orderBy("ord").collect()] == [0, 2, 3, 1]
    fused = layout.fused_blocks(e)
    q = layout.quality_layer(fused.select("doc", "type", "status", "confidence")).first()
    assert (q.text_blocks_total, q.text_blocks_no_ocr, q.table_blocks_total, q.figure_blocks_total, q.avg_layout_confidence) == (2, 2, 1, 1, 0.8)
    assert fused.filter("type = 'table'").first().provenance.merge_strategy == "table_structure_only"
    v = layout.page_view(e).first()
    assert v.content == "a\nb" and v.n_table == 1
    assert layout.content_flags(e).first().has_tables


def test_captions_go_one_to_one(spark):
    e = spark.createDataFrame([el(0, "figure", (0, 0, 100, 100)), el(1, "figure", (0, 120, 100, 220))], ELEMENT)
    c = spark.createDataFrame([el(5, "figure_caption", (0, 104, 100, 114), "one"), el(6, "figure_caption", (0, 224, 100, 234), "two"), el(7, "figure_caption", (300, 0, 400, 10), "far")], ELEMENT)
    assert {(r.ord, r.caption) for r in layout.bound_captions(e, c).collect()} == {(0, "one"), (1, "two")}
    assert {(r.ord, r.caption) for r in layout.bound_captions(e, c.orderBy(F.desc("ord"))).collect()} == {(0, "one"), (1, "two")}


def figures(spark, boxes, height=1000.0, captions=None):
    rows = [(*el(i, "figure", b), height, None, (captions or {}).get(i)) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, ELEMENT + ", page_height double, caption_id string, caption string")


def test_split_figures(spark):
    kinds = lambda *a, **k: [r.kind for r in layout.split_figures(figures(spark, *a, **k)).collect()]
    assert kinds([(0, 0, 100, 100), (0, 110, 100, 180)]) == ["possible_vertical_split"]
    assert kinds([(0, 0, 100, 100), (110, 0, 200, 100)]) == ["possible_horizontal_split"]
    assert kinds([(0, 0, 100, 100), (10, 10, 50, 50)]) == ["nested_regions"]
    assert kinds([(0, 0, 100, 100), (0, 110, 100, 180)], captions={0: "a", 1: "b"}) == []
    assert kinds([(0, 0, 100, 250), (0, 260, 100, 500)]) == []
    assert kinds([(0, 110, 100, 180), (0, 0, 100, 100)]) == []
    assert kinds([(0, 0, 100, 100), (0, 900, 100, 990)] + [(400 + i, 400, 401 + i, 401) for i in (0, 300)]) == []


def test_near_components(spark):
    chain = [(1, i, float(i * 10), 0.0, i * 10 + 5.0, 5.0) for i in range(30)] + [(1, 99, 5000.0, 0.0, 5010.0, 10.0)]
    df = spark.createDataFrame(chain, "doc int, n int, x0 double, y0 double, x1 double, y1 double")
    got = layout.near_components(df, ["doc"], members=20, least_area=100.0).collect()
    assert [(r.component, r.members, r.x1) for r in got] == [(0, 30, 295.0)]


def test_scores_and_dedupe(spark):
    e = spark.createDataFrame([el(0, "text", (0, 0, 100, 100), "whole"), el(1, "text", (0, 0, 100, 40), "This child is complete, it is long enough."), el(2, "text", (0, 50, 100, 100), "This other child is complete, it is long too."), el(3, "text", (200, 0, 300, 40), "alone")], ELEMENT)
    assert {r.id for r in layout.deduplicated(e).collect()} == {"e1", "e2", "e3"}
    d = spark.createDataFrame([("d", 1, 0, 2.0, 1.0, 98.0, 41.0, 0.7), ("d", 1, 1, 0.0, 0.0, 100.0, 40.0, 0.9)], "doc string, page int, n int, x0 double, y0 double, x1 double, y1 double, score double")
    assert {r.id: r.score for r in layout.near_scores(e, d).collect()} == {"e0": None, "e1": 0.7, "e2": None, "e3": None}
    assert {(r.outer, r.inner) for r in layout.containment_pairs(e, 0.7).collect()} >= {(0, 1), (0, 2)}


def test_folds(spark):
    one = spark.range(1).select(layout.column_groups(F.array(*map(F.lit, [30.0, 1.0, 9.0, 11.5, 22.0]))).alias("c"), layout.row_keys(F.array(*map(F.lit, [10.0, 14.0, 19.0, 15.0]))).alias("r")).first()
    assert one.c == [1.0, 11.5, 22.0] and one.r == [10.0, 19.0]


def test_page_verdicts_and_cell_confidence(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (100, 0, 0.0), (100, 90, 0.9), (100, 30, 0.6)], "t int, i int, c double")
    assert [r.v.verdict for r in df.select(trust.page_verdict(F.col("t"), F.col("i"), F.col("c")).alias("v")).collect()] == ["no_text", "text_layer", "overlay", "mixed"]
    cells = spark.createDataFrame([("t", 0, 0.0, 0.0, 10.0, 10.0), ("t", 1, 0.0, 10.0, 10.0, 20.0), ("u", 0, 0.0, 0.0, 1.0, 1.0)], "tbl string, cell int, x0 double, y0 double, x1 double, y1 double")
    entries = spark.createDataFrame([("t", 0, 1.0, 91.0, 3.0, 93.0, 0.9), ("t", 1, 1.0, 95.0, 3.0, 97.0, 0.5), ("t", 2, 1.0, 84.0, 3.0, 86.0, 0.8)], "tbl string, ordinal int, x0 double, y0 double, x1 double, y1 double, score double")
    heights = spark.createDataFrame([("t", 100.0)], "tbl string, height double")
    got = {(r.tbl, r.cell): (r.confidence, r.status) for r in trust.cell_confidence(entries, cells, heights).collect()}
    assert got == {("t", 0): (0.5, "flip"), ("t", 1): (0.8, "flip"), ("u", 0): (None, "no_entries")}
