"""Queries of the smaller operators. Twins state what has to come out: literal rows, or the rule written anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import accuracy, backfill, batches, evidence, fields, geometry, layout, tables, trust
from ..session import load
from ..sources import exports
from . import model
from .library import big
from .model import CELLS, ELEMENTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(columns: str, *rows: tuple) -> str:
    """A twin of literal rows."""
    text = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def given(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query(literal("n, flags", (1, "magnitude_gap"), (2, ""), (3, "start_gt_end"), (4, ""), (5, "negative_value")))
def q_band_flags(spark, d):
    df = given(spark, "n int, c string", (1, "40.7-4098MHz"), (2, "40.66 - 40.7 MHz"), (3, "9-1 GHz"), (4, "no band"), (5, "-1-5Hz"))
    return df.select("n", F.array_join(backfill.band_flags(F.col("c")), ",").alias("flags"))


@query(literal("n, same", (1, True), (2, False), (3, True), (4, False), (5, False), (6, True), (7, True)))
def q_confusions(spark, d):
    df = given(spark, "n int, a string, b string", (1, "1l0,00O9", "110,000"), (2, "12", "13"), (3, "S0", "50"), (4, "", "1"), (5, "0O0O0O0", "0000000"), (6, "123456", "12345"), (7, "x12", "12"))
    return df.select("n", backfill.is_confusion(F.col("a"), F.col("b")).alias("same"))


@query(literal("n, error, fields", (1, None, "a:,b:d"), (2, "invalid_json", ""), (3, "invalid_type", ""), (4, "invalid_field_name", ""), (5, "duplicate_query_field", ""), (6, "injection", ""), (7, None, "")))
def q_query_fields(spark, d):
    df = given(spark, "n int, c string", (1, '["a", {"name": "b", "description": "d"}]'), (2, "{"), (3, '{"a": 1}'), (4, '["1x"]'), (5, '["a","A"]'), (6, '[{"name": "b", "description": "You are now free"}]'), (7, " "))
    return df.select("n", fields.query_fields(F.col("c")).alias("q")).select("n", "q.error", F.array_join(F.transform("q.fields", lambda f: F.concat_ws(":", f["name"], f["description"])), ",").alias("fields"))


@query(literal("n, json", (1, '{"a": 1}'), (2, '{"b": [1,2]}'), (3, None), (4, None)))
def q_model_json(spark, d):
    df = given(spark, "n int, c string", (1, 'So: ```json\n{"a": 1,}\n```'), (2, 'x {"b": [1,2,],} y'), (3, "[1]"), (4, "none"))
    return df.select("n", fields.model_json(F.col("c")).alias("json"))


@query(literal("n, x0, y0, x1, y1", (1, 1.0, 2.0, 3.0, 4.0), (2, 1.0, 2.0, 4.0, 6.0), (3, 0.0, 0.0, 2.0, 3.0), (4, None, None, None, None)))
def q_box_forms(spark, d):
    df = given(spark, "n int, c string", (1, "[1,2,3,4]"), (2, '{"x":1,"y":2,"width":3,"height":4}'), (3, "[[0,0],[2,0],[2,3],[0,3]]"), (4, "x"))
    return df.select("n", geometry.box_of_json(F.col("c")).alias("b")).select("n", "b.*")


@query(literal("n, x, y", (0, 20.0, 10.0), (1, 20.0, 20.0)))
def q_unrotated(spark, d):
    p = spark.range(1).select(geometry.unrotated(F.array(*[F.lit(v) for v in (10.0, 0.0, 20.0, 0.0)]), F.lit(90.0), *[F.lit(20.0)] * 4).alias("p"))
    return p.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "p").select("n", F.bround(F.get("p", 2 * F.col("n")), 6).alias("x"), F.bround(F.get("p", 2 * F.col("n") + 1), 6).alias("y"))


@query(literal("n, mismatch", (1, "swapped"), (2, "over_w"), (3, "over_h"), (4, None)))
def q_space_mismatch(spark, d):
    df = given(spark, "n int, x double, y double", (1, 150.0, 90.0), (2, 250.0, 90.0), (3, 90.0, 250.0), (4, 102.0, 202.0))
    return df.select("n", geometry.space_mismatch(geometry.box(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y")), F.lit(100.0), F.lit(200.0)).alias("mismatch"))


@query(f"WITH {ELEMENTS} SELECT doc, ord, CASE type WHEN 'table' THEN 'table' WHEN 'figure_caption' THEN 'figure' WHEN 'figure' THEN 'figure' WHEN 'formula' THEN 'formula' ELSE 'text' END AS element_type, floor(1000 * y0 / 1400)::BIGINT AS z_index, row_number() OVER (PARTITION BY doc ORDER BY floor(1000 * y0 / 1400), y0, x0, ord) AS position FROM el")
def q_unified(spark, d):
    u = layout.unified(model.elements(spark, d).withColumn("page_height", F.lit(1400.0)))
    return big(u.select("doc", "ord", "element_type", "z_index", "position")).select("doc", F.col("ord").cast("int").alias("ord"), "element_type", "z_index", "position")


@query(f"WITH {ELEMENTS} SELECT doc, ord, CASE WHEN ord % 4 <> 3 THEN ((ord * 31) % 100)::DOUBLE / 100 END AS score FROM el")
def q_near_scores(spark, d):
    e = model.elements(spark, d)
    det = e.filter("ord % 4 <> 3").select("doc", "page", F.col("ord").alias("n"), (F.col("x0") + 2).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.col("x1") + 1).alias("x1"), (F.col("y1") - 1).alias("y1"), (((F.col("ord") * 31) % 100) / 100.0).alias("score"))
    return layout.near_scores(e, det).select("doc", "ord", "score")


@query(f"WITH {ELEMENTS} SELECT doc, ord, left(text, 40) AS content, length(text) > 40 AS truncated FROM el WHERE regexp_matches(text, '[^ ]')")
def q_text_blocks(spark, d):
    t = layout.text_blocks(model.elements(spark, d), 40)
    return t.select("doc", F.expr("cast(substr(id, 2) as int)").alias("ord"), "content", "truncated")


@query(f"WITH {ELEMENTS} SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY coalesce(confidence, 1.0), ord) AS place FROM el QUALIFY place <= 5")
def q_review_queue(spark, d):
    return accuracy.review_queue(model.elements(spark, d), 5).select("doc", "ord", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {ELEMENTS} SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY ord) AS box_order FROM el WHERE type = 'formula' AND x1 > x0 AND y1 > y0")
def q_accepted_boxes(spark, d):
    b = layout.accepted_boxes(model.elements(spark, d), ["formula"])
    return b.select("doc", F.expr("cast(substr(source_id, 2) as int)").alias("ord"), F.col("box_order").cast("bigint").alias("box_order"))


@query(f"WITH {ELEMENTS} SELECT doc, count(*) AS total, count(*) FILTER (ord % 2 = 0) AS recognised, count(*) FILTER (ord % 2 = 1) AS failed FROM el WHERE type = 'formula' GROUP BY doc")
def q_formulas_in_place(spark, d):
    f = layout.fused_blocks(model.elements(spark, d))
    latex = f.filter("type = 'formula'").select("doc", F.col("block_id").alias("source_id"), F.lit(0).alias("ordinal"), F.when(F.expr("cast(substr(block_id, 2) as int) % 2 = 0"), F.lit("x^2")).otherwise("").alias("latex"))
    out = layout.with_formulas(f, latex.unionByName(latex.withColumns({"ordinal": F.lit(1), "latex": F.lit("later")})))
    return out.filter("type = 'formula'").groupBy("doc").agg(F.count("*").alias("total"), F.count_if((F.col("status") == "recognized") & (F.col("payload.text") == "x^2")).alias("recognised"), F.count_if(F.col("status") == "formula_unrecognized").alias("failed"))


@query(f"WITH {ELEMENTS} SELECT doc, count(*) FILTER (type <> 'seal') + 1 AS n, 'seal_0001' AS last FROM el GROUP BY doc")
def q_seals_added(spark, d):
    e = model.elements(spark, d)
    seals = e.select("doc").distinct().select("doc", F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("stamp").alias("text")), F.struct(F.lit(2).alias("ordinal"), F.lit(" ").alias("text")))).alias("s")).select("doc", "s.*")
    return layout.with_seals(layout.fused_blocks(e), seals).groupBy("doc").agg(F.count("*").alias("n"), F.max_by("block_id", "position").alias("last"))


@query("SELECT doc_id AS doc, 3::BIGINT AS total_pages, (3 - (doc_id % 3))::BIGINT AS pages_done, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '3:missing' ELSE '2:boom,3:missing' END AS failed FROM documents")
def q_assembled_documents(spark, d):
    t = load(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    k = F.col("doc") % 3
    pages = t.select("doc", F.explode(F.sequence(F.lit(1), F.when(k == 0, 3).otherwise(2))).alias("page")).withColumn("error", F.when((k == 2) & (F.col("page") == 2), "boom"))
    a = layout.assembled_documents(pages, t.withColumn("n_pages", F.lit(3)))
    both = F.zip_with("failed_pages", "errors", lambda p, e: F.concat_ws(":", p.cast("string"), e))
    return big(a.select("doc", "total_pages", "pages_done", F.array_join(both, ",").alias("failed")))


# words and runs
WORDS = f"""{CELLS}, wo AS (SELECT tbl, row, col, layer AS text, 20 + 100.0::DOUBLE * col + 20 AS x0, 40 + 20.0::DOUBLE * (row - 1) + 5 AS y0, 20 + 100.0::DOUBLE * col + 20 + 5 * length(layer) AS x1 FROM ce)"""


@query(f"WITH {WORDS} SELECT tbl, (row - 1)::BIGINT AS trow, col::BIGINT AS tcol, dense_rank() OVER (PARTITION BY tbl ORDER BY row) - 1 AS cluster, col::BIGINT AS grp FROM wo")
def q_layout_model(spark, d):
    t, w, _ = model.placed(spark, d)
    m = backfill.layout_model(t, w)
    return m.select("tbl", *[F.col(c).cast("bigint").alias(c) for c in ("trow", "tcol", "cluster", "grp")])


@query(f"WITH {WORDS} SELECT tbl, dense_rank() OVER (PARTITION BY tbl ORDER BY row) - 1 AS cluster, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM wo GROUP BY tbl, row")
def q_row_clusters(spark, d):
    _, w, _ = model.placed(spark, d)
    c = backfill.row_clusters(w, ["doc"], F.lit(5.0))
    return c.groupBy(F.col("doc").alias("tbl"), F.col("cluster").cast("bigint").alias("cluster")).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"WITH {WORDS} SELECT tbl, (row - 1)::BIGINT AS best FROM wo WHERE col = 0")
def q_band_overlap_rows(spark, d):
    t, w, _ = model.placed(spark, d)
    own = w.join(t.select("doc", F.col("y0").alias("ty0"), F.col("y1").alias("ty1"), "n_rows"), "doc").filter("word_no % 3 = 0")
    return own.select(F.col("doc").alias("tbl"), backfill.band_row(F.col("y0"), F.col("y1"), F.col("ty0") / 2, F.col("ty1") / 2, F.col("n_rows")).cast("bigint").alias("best"))


@query("""WITH w AS (SELECT item_id, unnest(range(len(ws)))::INT AS i, ws FROM (SELECT item_id, string_split(text, ' ')[1:12] AS ws FROM eval_items)) SELECT item_id, k::BIGINT AS k, count(*) AS n FROM (SELECT item_id, i, unnest(range(1, 5)) AS k, len(ws) AS m FROM w) WHERE i + k <= m GROUP BY 1, 2""")
def q_word_runs(spark, d):
    e = load(spark, d, "eval_items").select("item_id", F.posexplode(F.slice(F.split("text", " "), 1, 12)).alias("word_no", "text")).withColumns({"block": F.lit(0), "line": F.lit(0)})
    r = backfill.word_runs(e, ["item_id"])
    return r.groupBy("item_id", (F.col("last") - F.col("first") + 1).cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT item_id, CASE WHEN len(string_split(text, ' ')[1:12]) >= 4 THEN len(string_split(text, ' ')[1:12]) - 3 ELSE 1 END AS n FROM eval_items")
def q_maximal_runs(spark, d):
    e = load(spark, d, "eval_items").select("item_id", F.posexplode(F.slice(F.split("text", " "), 1, 12)).alias("word_no", "text")).withColumns({"block": F.lit(0), "line": F.lit(0)})
    return backfill.maximal_runs(backfill.word_runs(e, ["item_id"]), ["item_id"]).groupBy("item_id").agg(F.count("*").alias("n"))


# tables
@query(f"WITH {CELLS} SELECT tbl, (row - 1)::BIGINT AS row_index, max(text) FILTER (col = 0) AS transaction_date, max(text) FILTER (col = 1) AS description, max(text) FILTER (col = 2) AS amount, '' AS balance FROM ce GROUP BY tbl, row")
def q_map_bank_rows(spark, d):
    c = model.cells(spark, d).select("tbl", "row", "col", "text")
    head = c.select("tbl").distinct().select("tbl", F.lit(0).alias("row"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("text")) for i, h in enumerate(["q", "p", "c"])])).alias("x")).select("tbl", "row", "x.*")
    m = tables.mapped_rows(head.unionByName(c), ["tbl"], "bank_statement")
    return big(m.select("tbl", "row_index", "transaction_date", "description", "amount", "balance"))


@query(f"WITH {CELLS} SELECT tbl FROM ce GROUP BY tbl HAVING count(*) FILTER (trim(text) <> '') > 0")
def q_real_tables(spark, d):
    return tables.real_tables(model.cells(spark, d), ["tbl"])


@query(f"WITH {CELLS} SELECT tbl, count(*) AS measured, 0::BIGINT AS unmeasured, count(*) FILTER (c < 0.9) AS low FROM (SELECT tbl, row, min(((tbl * 3 + row * 5 + col * 7) % 100)::DOUBLE / 100) AS c FROM ce GROUP BY tbl, row) GROUP BY tbl")
def q_cell_conf_summary(spark, d):
    from .library import q_cell_min_confidence

    return trust.confidence_summary(q_cell_min_confidence(spark, d).withColumnRenamed("row", "cell"))


@query(f"WITH {CELLS} SELECT count(*) AS total, count(*) AS evaluable, count(*) FILTER (text = layer) AS matched, 0::BIGINT AS missing, count(*) FILTER (text <> layer) AS wrong, round_even(count(*) FILTER (text = layer) / count(*), 4) AS accuracy FROM ce")
def q_accuracy(spark, d):
    c = model.cells(spark, d).withColumn("doc", F.col("tbl"))
    return accuracy.accuracy(accuracy.cell_items(c.select("doc", "tbl", "row", "col", F.col("layer").alias("text")), c.select("doc", "tbl", "row", "col", "text")), [])


@query(f"""WITH {CELLS} SELECT symbol, sum(e)::BIGINT AS expected, sum(least(e, f))::BIGINT AS found, round_even(sum(least(e, f)) / sum(e), 4) AS rate FROM (SELECT coalesce(s, '*') AS symbol, e, f FROM (SELECT tbl, s, sum(len(layer) - len(replace(layer, s, ''))) AS e, sum(len(text) - len(replace(text, s, ''))) AS f FROM ce, (VALUES ('0'), ('7')) AS v(s) GROUP BY tbl, s)) GROUP BY symbol
  UNION ALL SELECT '*', sum(e)::BIGINT, sum(least(e, f))::BIGINT, round_even(sum(least(e, f)) / sum(e), 4) FROM (SELECT tbl, s, sum(len(layer) - len(replace(layer, s, ''))) AS e, sum(len(text) - len(replace(text, s, ''))) AS f FROM ce, (VALUES ('0'), ('7')) AS v(s) GROUP BY tbl, s)""")
def q_symbol_survival(spark, d):
    c = model.cells(spark, d).groupBy(F.col("tbl").alias("doc")).agg(F.concat_ws(" ", F.sort_array(F.collect_list("layer"))).alias("layer"), F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    return accuracy.symbol_survival(c.select("doc", F.col("layer").alias("text")), c.select("doc", "text"), ["0", "7"])


# evidence
@query("""SELECT doc_id AS doc, concat_ws(',', CASE WHEN doc_id % 6 = 5 AND doc_id % 4 <> 0 THEN 'statement' END, CASE WHEN doc_id % 6 = 5 THEN 'quote' END, CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 THEN 'slots' END) AS errors FROM documents WHERE length(trim(text)) > 0 AND (doc_id % 6 = 5 OR doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0)""")
def q_finding_schema_errors(spark, d):
    g = evidence.gated(model.findings(spark, d), model.grounding(spark, d))
    return g.select("doc", F.array_join("errors", ",").alias("errors")).filter("errors <> ''")


@query("SELECT CASE WHEN doc_id % 6 = 0 OR doc_id % 6 = 1 THEN 'scan' WHEN doc_id % 6 = 5 THEN 'unresolved' ELSE 'prefix' END AS how, count(*) AS n FROM documents WHERE length(trim(text)) > 0 AND NOT regexp_matches(text, '[^\\x00-\\x7F]') AND len(list_filter(string_split_regex(text, '[ \\n\\t\\r\\f]+'), lambda w: w <> '')) >= 30 AND NOT regexp_matches(text, '-\\n') GROUP BY 1".replace("\\\\", "\\"))
def q_attribution(spark, d):
    whole = F.size(F.filter(F.split("text", "[ \n\t\r\f]+"), lambda w: w != "")) >= 30
    p = model.grounding(spark, d).filter(~F.col("text").rlike(r"[^\x00-\x7F]") & whole & ~F.col("text").contains("-\n"))
    f = model.findings(spark, d).join(p.select("doc"), "doc", "left_semi")
    return evidence.attributed(f, p).groupBy("how").agg(F.count("*").alias("n"))


# fields and batches
@query("SELECT batch_id, CASE WHEN max(k) > 0 THEN 'processing' ELSE 'done' END AS s FROM (SELECT batch_id, (status IN ('pending', 'processing'))::INT AS k FROM batch_tasks) GROUP BY 1")
def q_batch_final_status(spark, d):
    t = load(spark, d, "batch_tasks").groupBy("batch_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "cancelled")], F.count_if(F.col("status").isin("pending", "processing")).alias("left"))
    s = batches.final_status(F.col("n"), F.col("completed"), F.col("failed"), F.col("cancelled"), F.col("left"))
    return t.select("batch_id", F.when(s == "processing", "processing").otherwise("done").alias("s"))


@query(literal("n, street, city, country", (1, "1 High St\nLeeds", "Leeds", "United Kingdom"), (2, "1 High St", None, None), (3, None, None, None)))
def q_addresses_typed(spark, d):
    df = given(spark, "n int, c string", (1, "1 High St\nLeeds, United Kingdom"), (2, "1 High St"), (3, " "))
    return df.select("n", fields.to_address(F.col("c")).alias("a")).select("n", "a.*")


@query("SELECT task_id, count(*) AS n, count(*) FILTER (keep) AS kept FROM (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY id DESC) <= 3 AS keep FROM (SELECT DISTINCT task_id, id FROM task_events)) GROUP BY task_id HAVING count(*) > 0")
def q_event_tail_counts(spark, d):
    e = load(spark, d, "task_events")
    t = batches.event_tail(e, 3).groupBy("task_id").agg(F.count("*").alias("kept"))
    return e.select("task_id", "id").distinct().groupBy("task_id").agg(F.count("*").alias("n")).join(t, "task_id").select("task_id", "n", "kept")


@query("SELECT record_id, CASE WHEN status IN ('completed', 'succeeded') THEN 100 ELSE 0 END AS progress FROM batch_jobs")
def q_reloaded(spark, d):
    return batches.reloaded(load(spark, d, "batch_jobs").withColumn("error", F.lit(None).cast("string")), F.lit(True)).select("record_id", "progress")


@query("SELECT review_id, CASE WHEN ascii(right(review_id, 1)) % 2 = 0 THEN 'resolved' ELSE status END AS status FROM (SELECT review_id, max(status) AS status FROM hitl_reviews GROUP BY 1)")
def q_review_state(spark, d):
    r = load(spark, d, "hitl_reviews").groupBy("review_id").agg(F.max("status").alias("status")).withColumn("k", F.ascii(F.right("review_id", F.lit(1))))
    edits = r.filter("k % 2 = 0").select("review_id", F.explode(F.array(F.struct(F.lit(1).alias("id"), F.lit("a").alias("field"), F.lit("x").alias("value")), F.struct(F.lit(2).alias("id"), F.lit("a").alias("field"), F.lit("y").alias("value")))).alias("e")).select("review_id", "e.*")
    return batches.review_state(r.drop("k"), edits).select("review_id", "status")


@query()
def q_stratified_sample(spark, d):
    """A fixed sample by source with every document of a batch at risk (picks by hash, so rows only)."""
    return accuracy.stratified(load(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100, F.col("doc_id") % 97 == 0)


@query()
def q_run_report(spark, d):
    """Stages, tokens and hedged findings per document."""
    t = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit("s").alias("stage"), F.col("n_chars").alias("tokens"), F.lit(1.0).alias("seconds"))
    return accuracy.run_report(t, model.findings(spark, d))


# texts
@query(literal("n, v", (1, "TotalAmount".replace("lA", "l A")), (2, "a 1 b"), (3, None)))
def q_respaced(spark, d):
    df = given(spark, "n int, c string", (1, "TotalAmount"), (2, "a1\nb"), (3, None))
    return df.select("n", strings.respaced(F.col("c")).alias("v"))


@query(literal("n, v", (1, "Hi you"), (2, "Ĭ"), (3, "plain")))
def q_cid_decoded(spark, d):
    df = given(spark, "n int, c string", (1, "(cid:72)(cid:105) you"), (2, "(cid:300)"), (3, "plain"))
    return df.select("n", strings.cid_decoded(F.col("c")).alias("v"))


@query(literal("n, v", (1, "12,000"), (2, "abc"), (3, "(x)%")))
def q_comparable(spark, d):
    df = given(spark, "n int, c string", (1, "１２，０００"), (2, " a b c "), (3, "（x）％"))
    return df.select("n", strings.comparable(F.col("c")).alias("v"))


@query(literal("n, sheet, stem, html", (1, "a_b_c", "a_b_c", "a/b:c"), (2, "Sheet", "file", ""), (3, "<x>", "x", "&lt;x&gt;")))
def q_names(spark, d):
    df = given(spark, "n int, c string", (1, "a/b:c"), (2, ""), (3, "<x>"))
    return df.select("n", strings.sheet_name(F.col("c")).alias("sheet"), strings.file_stem(F.col("c")).alias("stem"), strings.html_escaped(F.col("c")).alias("html"))


@query("SELECT item_id, CASE WHEN length(text) > 160 THEN 'Table 1 (Page 2) confidence=50% — ' || left(text, 157) || '...' ELSE 'Table 1 (Page 2) confidence=50% — ' || text END AS title FROM (SELECT item_id, trim(text) AS text FROM eval_items)")
def q_table_titles(spark, d):
    e = load(spark, d, "eval_items")
    return e.select("item_id", strings.table_title(F.lit(1), F.lit(2), F.lit(50), F.col("text")).alias("title"))


@query("SELECT item_id, '10.1234/' || item_id AS doi FROM eval_items")
def q_doi(spark, d):
    return load(spark, d, "eval_items").select("item_id", strings.doi(F.concat(F.lit("see https://doi.org/10.1234/"), F.col("item_id").cast("string"), F.lit("). "), "text")).alias("doi"))


@query("SELECT doc_id AS doc, sum(n_chars) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id)::BIGINT AS running, sum(n_chars) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) <= 20000 AS fits FROM documents")
def q_pack_manifest(spark, d):
    f = load(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("doc"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("name"), F.col("n_chars").alias("bytes"), "doc_id")
    return exports.pack_manifest(f, 20_000).select(F.col("doc_id").alias("doc"), "running", "fits")


@query("SELECT doc_id AS doc, greatest(coalesce(page_count, 0), 0) + CASE WHEN coalesce(page_count, 0) > 0 THEN 0 ELSE 1 END AS pages FROM documents")
def q_page_count(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("doc"), trust.page_count(F.col("page_count"), F.lit(None).cast("int")).alias("pages"))
