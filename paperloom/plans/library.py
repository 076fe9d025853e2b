"""Queries of the operator library. Twins are written from the meaning of the operator, over the same relations in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import accuracy, backfill, batches, evidence, fields, geometry, layout, tables, trust
from ..session import load
from ..sources import exports
from . import model
from .model import CELLS, ELEMENTS, KIE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the name of its function, with its twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the twins give them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def texts(n: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in n)


# evidence
SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORDS30 = r"list_filter(string_split_regex(text, '[ \n\t\r\f]+'), lambda w: w <> '')[1:30]"
FINDINGS = rf"""fi AS (SELECT doc, text, trusted, quote, CASE WHEN doc % 4 = 0 THEN 'may ' || quote ELSE quote END AS statement, p17, p19, p23 FROM (
  SELECT doc_id AS doc, text, doc_id % 10 <> 9 AS trusted, CASE doc_id % 6 WHEN 1 THEN array_to_string({WORDS30}, '  ') WHEN 2 THEN array_to_string({WORDS30}, ' ') || ' zzz' WHEN 3 THEN 'never written anywhere in it'
    WHEN 4 THEN array_to_string({WORDS30}, ' ') || ' zz1 zz2 zz3 zz4' WHEN 5 THEN '' ELSE array_to_string({WORDS30}, ' ') END AS quote, doc_id % 17 = 0 AS p17, doc_id % 19 = 0 AS p19, doc_id % 23 = 0 AS p23
  FROM documents WHERE length(trim(text)) > 0))"""


def _sql_ladder(x: str) -> str:
    lig = x
    for a, b in strings.LIGATURES.items():
        lig = f"replace({lig}, '{a}', '{b}')"
    return lig


def _v3(x: str) -> str:
    return f"trim(regexp_replace({_sql_ladder(f'nfc_normalize({x})')}, '{SPACE}', ' ', 'g'))"


def _v4(x: str) -> str:
    out = _v3(x)
    for a, b in strings.QUOTES_AND_DASHES.items():
        out = "replace({}, '{}', '{}')".format(out, a.replace("'", "''"), b.replace("'", "''"))
    return out


V4Q, V4T = _v4("quote"), _v4("text")
V5 = r"regexp_replace(regexp_replace({x}, '([a-z])- ([a-z])', '\1\2', 'g'), '([a-z])- ([a-z])', '\1\2', 'g')"
LADDER = f"""la AS (SELECT doc, statement, quote, text, trusted, p17, p19, p23, nfc_normalize(quote) AS q1, nfc_normalize(text) AS h1, {_sql_ladder("nfc_normalize(quote)")} AS q2, {_sql_ladder("nfc_normalize(text)")} AS h2,
  {_v3("quote")} AS q3, {_v3("text")} AS h3, {V4Q} AS q4, {V4T} AS h4 FROM fi),
lb AS (SELECT *, {V5.format(x="q4")} AS q5, {V5.format(x="h4")} AS h5 FROM la),
lc AS (SELECT *, replace(q5, '-', '') AS q6, replace(h5, '-', '') AS h6, CASE WHEN q4 = '' THEN 0 ELSE len(string_split(q4, ' ')) END AS total FROM lb),
ld AS (SELECT *, CASE WHEN quote <> '' AND contains(text, quote) THEN 'V0' WHEN q1 <> '' AND contains(h1, q1) THEN 'V1' WHEN q2 <> '' AND contains(h2, q2) THEN 'V2' WHEN q3 <> '' AND contains(h3, q3) THEN 'V3'
  WHEN q4 <> '' AND contains(h4, q4) THEN 'V4' WHEN q5 <> '' AND contains(h5, q5) THEN 'V5' WHEN q6 <> '' AND contains(h6, q6) THEN 'V6' END AS variant,
  coalesce(list_max(list_filter(range(1, total + 1), lambda k: contains(h6, array_to_string(string_split(q4, ' ')[1:k], ' ')))), 0) AS pref FROM lc),
le AS (SELECT *, CASE WHEN variant IS NOT NULL THEN 'verbatim_exact' WHEN total > 0 AND pref >= total - 3 AND pref / total >= 0.9 THEN 'near_match' ELSE 'unsupported' END AS v FROM ld),
lf AS (SELECT *, CASE WHEN trusted THEN v ELSE 'unsupported' END AS verdict, CASE WHEN doc % 4 = 0 AND NOT regexp_matches(quote, '(?i)\\bmay\\b') THEN 'add_hedge' ELSE 'faithful' END AS fidelity, trusted AND (p17 OR p19 OR p23) AS gap FROM le)"""
LADDER = LADDER.replace("\\\\b", "\\b")


@query(f"WITH {FINDINGS}, {LADDER} SELECT doc, verdict, CASE WHEN trusted THEN variant END AS variant, fidelity FROM lf")
def q_evidence_verdicts(spark, d):
    g = evidence.gated(model.findings(spark, d), model.grounding(spark, d))
    return g.select("doc", "verdict", "variant", "fidelity")


@query(f"""WITH {FINDINGS}, {LADDER} SELECT CASE WHEN gap THEN 'review(evidence_slot_incomplete)' WHEN quote = '' OR trim(statement) = '' OR p17 OR p19 OR p23 THEN 'review(evidence_schema_invalid)' WHEN verdict = 'unsupported' THEN 'ledger' WHEN verdict = 'near_match' THEN 'review+export' ELSE 'export' END AS route,
  count(*) AS n FROM lf GROUP BY 1""")
def q_export_gate(spark, d):
    g = evidence.gated(model.findings(spark, d), model.grounding(spark, d))
    return g.groupBy("route").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS}, {LADDER} SELECT doc, pref AS prefix, total FROM ld WHERE trusted AND variant IS NULL")
def q_quote_longest_prefix(spark, d):
    f = model.findings(spark, d).join(model.grounding(spark, d).filter("trusted"), ["doc", "page"])
    m = f.select("doc", evidence.quote_match(F.col("quote"), F.col("text")).alias("m")).filter("m.variant is null")
    return big(m.select("doc", "m.prefix", "m.total"))


@query("SELECT doc_id AS doc, concat_ws(',', CASE WHEN doc_id % 23 = 0 THEN 'comparator' END, CASE WHEN doc_id % 19 = 0 THEN 'intervention' END, CASE WHEN doc_id % 17 = 0 THEN 'population' END) AS missing FROM documents WHERE length(trim(text)) > 0 AND (doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0)")
def q_slot_completeness(spark, d):
    f = model.findings(spark, d)
    return f.select("doc", F.array_join(F.array_sort(evidence.missing_slots(f)), ",").alias("missing")).filter("missing <> ''")


HEDGED = "CASE item_id % 4 WHEN 0 THEN 'may ' || text WHEN 1 THEN 'it seems LIKELY that ' || text ELSE text END"
HEDGE_LIST = "[" + texts(sorted(strings.HEDGES)) + "]"


@query(f"""SELECT item_id, CASE WHEN len(list_filter(q, lambda h: NOT list_contains(c, h))) > 0 THEN 'overclaim' WHEN len(list_filter(c, lambda h: NOT list_contains(q, h))) > 0 THEN 'add_hedge' ELSE 'faithful' END AS fidelity, array_to_string(q, ',') AS hedges
  FROM (SELECT item_id, list_filter({HEDGE_LIST}, lambda h: regexp_matches({HEDGED}, '(?i)\\b' || h || '\\b')) AS q, list_filter({HEDGE_LIST}, lambda h: regexp_matches(CASE WHEN item_id % 3 = 0 THEN 'may ' || text ELSE text END, '(?i)\\b' || h || '\\b')) AS c FROM eval_items)""".replace("\\\\b", "\\b"))
def q_hedge_fidelity(spark, d):
    e = load(spark, d, "eval_items")
    k = F.col("item_id") % 4
    quote = F.when(k == 0, F.concat(F.lit("may "), "text")).when(k == 1, F.concat(F.lit("it seems LIKELY that "), "text")).otherwise(F.col("text"))
    claim = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("may "), "text")).otherwise(F.col("text"))
    return e.select("item_id", evidence.fidelity(claim, quote).alias("fidelity"), F.array_join(strings.hedges(quote), ",").alias("hedges"))


# trust
@query("""SELECT doc_id AS doc, verdict, round_even(CASE verdict WHEN 'no_text' THEN 1 WHEN 'overlay' THEN 1 WHEN 'text_layer' THEN greatest(0.6, least(1, 1 - 0.5 * (s / 0.2 + c / 0.5))) ELSE greatest(0, least(0.5, 0.5 * (s / 0.5 + c / 0.8))) END, 4)::DOUBLE AS confidence FROM (
  SELECT *, CASE WHEN n = 0 THEN 'no_text' WHEN s < 0.2 AND c < 0.5 THEN 'text_layer' WHEN s >= 0.5 AND c >= 0.8 THEN 'overlay' ELSE 'mixed' END AS verdict FROM (
  SELECT doc_id, n_chars AS n, CASE WHEN n_chars > 0 THEN ((n_chars * (doc_id % 8)) // 8)::DOUBLE / n_chars END AS s, (doc_id % 10)::DOUBLE / 10 AS c FROM documents))""")
def q_page_trust(spark, d):
    t = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("n"), F.expr("(n_chars * (doc_id % 8)) div 8").alias("i"), ((F.col("doc_id") % 10) / 10.0).alias("c"))
    return t.select("doc", trust.page_verdict(F.col("n"), F.col("i"), F.col("c")).alias("v")).select("doc", "v.verdict", "v.confidence")


@query("""SELECT file_type, count(*) AS n FROM (SELECT batch_id, CASE WHEN ext = 'pdf' THEN CASE WHEN ok THEN 'pdf_digital' ELSE 'pdf_scan' END WHEN ext IN ('png', 'jpg', 'tif') THEN 'image' ELSE 'unsupported' END AS file_type FROM (
  SELECT batch_id, ['pdf', 'png', 'docx', 'pdf'][1 + min(doc_id) % 4] AS ext, bool_and(n_chars > 0 AND doc_id % 8 < 1) AS ok FROM documents WHERE batch_id IS NOT NULL GROUP BY batch_id)) GROUP BY 1""")
def q_file_type(spark, d):
    t = load(spark, d, "documents").filter("batch_id is not null").select(F.col("batch_id").alias("doc"), "doc_id", F.when((F.col("n_chars") > 0) & (F.col("doc_id") % 8 < 1), "text_layer").otherwise("mixed").alias("verdict"))
    files = t.groupBy("doc").agg(F.get(F.array(*map(F.lit, ["pdf", "png", "docx", "pdf"])), (F.min("doc_id") % 4).cast("int")).alias("extension"))
    return trust.file_type(t.select("doc", "verdict"), files).groupBy("file_type").agg(F.count("*").alias("n"))


# layout
STATUS = f"""CASE WHEN type = 'table' THEN 'skip_table' WHEN type = 'formula' THEN 'skip_formula' WHEN type = 'seal' THEN 'skip_seal' WHEN type = 'figure' THEN 'extracted' WHEN type IN ('doc_title', 'figure_caption', 'text') THEN CASE WHEN regexp_matches(text, '[^ ]') THEN 'no_ocr' ELSE 'no_ocr_empty' END ELSE 'passthrough_unknown_type' END"""


@query(f"""WITH {ELEMENTS} SELECT status, CASE status WHEN 'skip_table' THEN 'table_structure_only' WHEN 'skip_formula' THEN 'formula_placeholder' WHEN 'skip_seal' THEN 'seal_placeholder' WHEN 'extracted' THEN 'region_only' ELSE status END AS strategy, count(*) AS n, count(confidence) AS measured FROM (SELECT *, {STATUS} AS status FROM el) GROUP BY 1, 2""")
def q_fused_status(spark, d):
    f = layout.fused_blocks(model.elements(spark, d))
    return f.groupBy("status", F.col("provenance.merge_strategy").alias("strategy")).agg(F.count("*").alias("n"), F.count("confidence").alias("measured"))


@query(f"""WITH {ELEMENTS} SELECT doc, count(*) FILTER (type IN ('doc_title', 'figure_caption', 'text')) AS text_blocks_total, count(*) FILTER (type IN ('doc_title', 'figure_caption', 'text')) AS text_blocks_no_ocr, count(*) FILTER (type = 'table') AS table_blocks_total, count(*) FILTER (type = 'figure') AS figure_blocks_total,
  count(*) FILTER (type = 'formula') AS formula_count, count(*) FILTER (type = 'seal') AS seal_count, round(avg(confidence) FILTER (type IN ('doc_title', 'figure_caption', 'text') AND confidence > 0), 4) AS avg_layout_confidence FROM el GROUP BY doc""")
def q_quality_layer(spark, d):
    q = layout.quality_layer(layout.fused_blocks(model.elements(spark, d)))
    return q.withColumn("avg_layout_confidence", F.round("avg_layout_confidence", 4))


@query(f"""WITH {ELEMENTS} SELECT CASE type WHEN 'doc_title' THEN 'title' WHEN 'figure_caption' THEN 'figure_title' WHEN 'text' THEN 'paragraph' ELSE type END AS kind, count(*) AS n FROM el GROUP BY 1""")
def q_view_kinds(spark, d):
    return model.elements(spark, d).groupBy(layout.view_kind(F.col("type")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {ELEMENTS} SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN reading_order IS NULL THEN 1 ELSE 0 END, reading_order, y0, x0, ord) AS place FROM el""")
def q_reading_order(spark, d):
    return big(layout.reading_order(model.elements(spark, d)).select("doc", "ord", "place")).select("doc", F.col("ord").cast("int").alias("ord"), "place")


@query(f"""WITH {ELEMENTS} SELECT doc, ord, coalesce(reading_order::BIGINT, ord + (SELECT count(*) FROM el f WHERE f.doc = e.doc AND f.ord < e.ord AND f.reading_order IS NULL)) AS view_order FROM el e""")
def q_view_counter(spark, d):
    v = layout.view_order(model.elements(spark, d))
    return v.select("doc", "ord", F.col("view_order").cast("bigint").alias("view_order"))


@query(f"""WITH {ELEMENTS}, v AS (SELECT *, coalesce(reading_order::BIGINT, ord + (SELECT count(*) FROM el f WHERE f.doc = e.doc AND f.ord < e.ord AND f.reading_order IS NULL)) AS vo FROM el e)
  SELECT doc, md5(coalesce(string_agg(text, chr(10) ORDER BY vo, ord) FILTER (type IN ('doc_title', 'text') AND regexp_matches(text, '[^ ]')), '')) AS content, count(*) FILTER (type = 'text') AS n_paragraph, count(*) FILTER (type = 'table') AS n_table FROM v GROUP BY doc""")
def q_page_content(spark, d):
    return layout.page_view(model.elements(spark, d)).select("doc", F.md5("content").alias("content"), "n_paragraph", "n_table")


@query(f"WITH {ELEMENTS} SELECT doc, type, page, count(*) AS n FROM el GROUP BY ROLLUP (doc, type, page) HAVING doc IS NOT NULL")
def q_type_counts_rollup(spark, d):
    return layout.type_counts(model.elements(spark, d)).select("doc", "type", "page", "n")


@query(f"WITH {ELEMENTS} SELECT doc, count(*) AS n, sum(length(text))::BIGINT AS chars FROM el WHERE type IN ('text', 'table') GROUP BY doc HAVING count(*) >= 8 AND sum(length(text)) >= 500")
def q_body_pages(spark, d):
    e = model.elements(spark, d)
    return layout.body_pages(e.filter(F.col("type") != "figure_caption")).select("doc", "n", "chars")


@query(f"""WITH {ELEMENTS} SELECT a.doc, a.ord AS outer_ord, b.ord AS inner_ord, round_even(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)), 4) AS ratio FROM el a JOIN el b ON a.doc = b.doc AND a.ord <> b.ord
  WHERE b.x0 >= a.x0 - greatest(10, 0.05 * (a.x1 - a.x0)) AND b.x1 <= a.x1 + greatest(10, 0.05 * (a.x1 - a.x0)) AND b.y0 >= a.y0 - greatest(10, 0.05 * (a.y1 - a.y0)) AND b.y1 <= a.y1 + greatest(10, 0.05 * (a.y1 - a.y0))""")
def q_containment_pairs(spark, d):
    p = layout.containment_pairs(model.elements(spark, d))
    return p.select("doc", F.col("outer").alias("outer_ord"), F.col("inner").alias("inner_ord"), "ratio")


@query(f"""WITH {ELEMENTS}, fg AS (SELECT * FROM el WHERE type = 'figure'), p AS (SELECT a.doc, a.ord AS i, b.ord AS j, b.y0 - a.y1 AS v, b.x0 - a.x1 AS h, least(a.y1 - a.y0, b.y1 - b.y0) AS low, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS ox, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS oy,
    least(a.x1 - a.x0, b.x1 - b.x0) AS wide, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, least(a.x0, b.x0) AS x0, greatest(a.x1, b.x1) AS x1 FROM fg a JOIN fg b ON a.doc = b.doc AND a.ord < b.ord)
  SELECT * FROM (SELECT doc, i, j, CASE WHEN ox * oy >= 0.9 * least(aa, ab) THEN 'nested_regions' WHEN ox >= 0.6 * wide AND ((v >= 0 AND v <= 56) OR (v < 0 AND v >= -0.5 * low)) THEN CASE WHEN NOT (v >= 0 AND low >= 280) THEN 'possible_vertical_split' END WHEN oy >= 0.6 * low AND h >= 0 AND h <= 56 THEN 'possible_horizontal_split' END AS kind, round_even(x0, 1) AS x0, round_even(x1, 1) AS x1 FROM p) WHERE kind IS NOT NULL""")
def q_split_figures(spark, d):
    f = layout.figure_elements(model.elements(spark, d)).withColumn("page_height", F.lit(1400.0))
    return layout.split_figures(f).select("doc", "i", "j", "kind", "x0", "x1")


@query()
def q_bind_captions(spark, d):
    """Captions bound to figures, page by page (order matters, so rows only)."""
    e = model.elements(spark, d)
    return layout.bound_captions(layout.figure_elements(e), e.filter(F.col("type").isin(layout.FIGURE_CAPTIONS)))


@query()
def q_deduplicated_elements(spark, d):
    """Elements without those their children repeat (order matters, so rows only)."""
    return layout.deduplicated(model.elements(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query()
def q_windows_budget(spark, d):
    """Windows of text blocks within a budget of characters."""
    e = model.elements(spark, d).filter("type = 'text'").select("doc", "page", F.col("ord").alias("idx"), "text")
    return fields.text_windows(e, 2000).select("doc", "page", "window", "first", "last", F.length("payload").alias("size"))


BOXES = [(i, 10.0 * i + 200.0 * (i // 7), 5.0 * (i % 3), 10.0 * i + 200.0 * (i // 7) + 4, 5.0 * (i % 3) + 60) for i in range(40)]
BOX_VALUES = ", ".join(f"({n}, {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)" for n, x0, y0, x1, y1 in BOXES)


@query(f"""WITH RECURSIVE b AS (SELECT * FROM (VALUES {BOX_VALUES}) AS t(n, x0, y0, x1, y1)), e AS (SELECT a.n AS u, c.n AS v FROM b a JOIN b c ON greatest(a.x0, c.x0) - least(a.x1, c.x1) < 12 AND greatest(a.y0, c.y0) - least(a.y1, c.y1) < 12),
  r AS (SELECT n AS s, n AS t FROM b UNION SELECT r.s, e.v FROM r JOIN e ON r.t = e.u), c AS (SELECT s AS n, min(t) AS component FROM r GROUP BY s)
  SELECT component::BIGINT AS component, count(*) AS members, min(x0) AS x0, max(x1) AS x1 FROM c JOIN b USING (n) GROUP BY component HAVING count(*) >= 5""")
def q_components(spark, d):
    b = spark.createDataFrame([(1, *x) for x in BOXES], "doc int, n bigint, x0 double, y0 double, x1 double, y1 double")
    return layout.near_components(b, ["doc"], members=5, least_area=0.0).select("component", "members", "x0", "x1")


# tables
@query(f"WITH {CELLS} SELECT col, count(*) AS n, count(*) FILTER (length(text) <= 40 AND (regexp_matches(text, '^[+\\-]?[¥$€£]?\\s?[0-9][0-9,.\\s]*%?$') OR (regexp_matches(text, '^[A-Za-z0-9\\s._/-]+$') AND regexp_matches(text, '[0-9]')))) AS n_candidates FROM ce GROUP BY col".replace("\\\\", "\\"))
def q_cell_candidates(spark, d):
    return model.cells(spark, d).groupBy("col").agg(F.count("*").alias("n"), F.count_if(backfill.is_candidate(F.col("text"))).alias("n_candidates"))


VERDICT = """CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'vision' WHEN text = layer THEN 'text_confirmed' WHEN length(text) = length(layer) AND length(text) - length(replace(text, 'O', '')) <= CASE WHEN length(text) <= 6 THEN 1 ELSE 2 END THEN 'text_backfilled' WHEN text = layer || '7' THEN 'text_backfilled' ELSE 'text_mismatch' END"""


@query(f"""WITH {CELLS} SELECT provenance, reason, count(*) AS n FROM (SELECT {VERDICT} AS provenance, CASE {VERDICT} WHEN 'text_confirmed' THEN 'value_match' WHEN 'text_backfilled' THEN 'geometric' WHEN 'text_mismatch' THEN 'sanity_reject' END AS reason FROM ce) GROUP BY 1, 2""")
def q_backfill_funnel(spark, d):
    s = backfill.solved(*model.placed(spark, d))
    return s.groupBy("provenance", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {CELLS} SELECT tbl AS doc, count(*) FILTER ({VERDICT} <> 'vision') AS candidates, count(*) FILTER ({VERDICT} = 'text_confirmed') AS confirmed, count(*) FILTER ({VERDICT} = 'text_backfilled') AS backfilled, count(*) FILTER ({VERDICT} = 'text_mismatch') AS mismatch, round_even(count(*) FILTER ({VERDICT} = 'text_confirmed') / nullif(count(*) FILTER ({VERDICT} <> 'vision'), 0), 3) AS confirmed_rate FROM ce GROUP BY tbl""")
def q_backfill_summary(spark, d):
    s = backfill.backfill_summary(backfill.solved(*model.placed(spark, d)))
    return s.select("doc", "candidates", "confirmed", "backfilled", "mismatch", "confirmed_rate")


@query(f"""WITH {CELLS} SELECT provenance, count(*) AS n FROM (SELECT {VERDICT} AS provenance FROM ce) GROUP BY ROLLUP (provenance)""")
def q_proof_report(spark, d):
    total = trust.proof_report(backfill.solved(*model.placed(spark, d)).withColumn("confidence", F.lit(None).cast("double")), whole=True)
    each = F.array(*[F.struct(F.lit(c).alias("provenance"), F.col(c).alias("n")) for c in ("text_confirmed", "text_backfilled", "text_mismatch", "vision")], F.struct(F.lit(None).cast("string").alias("provenance"), F.col("cells").alias("n")))
    return total.select(F.explode(each).alias("x")).select("x.*").filter("n > 0")


@query(f"""WITH {CELLS} SELECT tbl, dense_rank() OVER (PARTITION BY tbl ORDER BY row) AS row, col::BIGINT AS col, text FROM ce UNION ALL SELECT DISTINCT tbl, 0, 0, 'Order' FROM ce""")
def q_html_tables(spark, d):
    c = tables.html_cells(model.html(spark, d), ["tbl"])
    return big(c.select("tbl", "row", "col", "text"))


@query(f"""WITH {CELLS} SELECT tbl, count(DISTINCT row) + 1 AS n_rows, 3::BIGINT AS n_cols, count(*) + 1 AS n_cells, 1::BIGINT AS header_rows, true AS has_merged_cells FROM ce GROUP BY tbl""")
def q_html_profile(spark, d):
    p = tables.table_profile(tables.html_cells(model.html(spark, d), ["tbl"]), ["tbl"])
    return big(p.select("tbl", "n_rows", "n_cols", "n_cells", "header_rows", "has_merged_cells"))


@query(f"""WITH {CELLS} SELECT tbl, (row - 1)::BIGINT AS row_index, max(text) FILTER (col = 0) AS quantity, max(text) FILTER (col = 1) AS unit_price, max(text) FILTER (col = 2) AS line_total, '' AS line_description FROM ce GROUP BY tbl, row""")
def q_map_rows(spark, d):
    m = tables.mapped_rows(model.header_grid(spark, d), ["tbl"], "invoice_line_items")
    return big(m.select("tbl", "row_index", "quantity", "unit_price", "line_total", "line_description"))


@query(f"""WITH {CELLS} SELECT tbl, (row - 1)::BIGINT AS row_index, max(text) FILTER (col = 0) AS menge, max(text) FILTER (col = 1) AS preis FROM ce GROUP BY tbl, row""")
def q_map_custom_schema(spark, d):
    m = tables.mapped_rows(model.header_grid(spark, d), ["tbl"], {"menge": ["qty"], "preis": ["UNIT PRICE"]})
    return big(m.select("tbl", "row_index", "menge", "preis"))


@query(f"""WITH {CELLS} SELECT tbl, count(*) AS total, count(*) FILTER (text = layer) AS matched, count(*) FILTER (text <> layer) AS wrong, round_even(count(*) FILTER (text = layer) / count(*), 4) AS accuracy FROM ce GROUP BY tbl""")
def q_gt_cells(spark, d):
    c = model.cells(spark, d).withColumn("doc", F.col("tbl"))
    items = accuracy.cell_items(c.select("doc", "tbl", "row", "col", F.col("layer").alias("text")), c.select("doc", "tbl", "row", "col", "text"))
    return accuracy.accuracy(items, ["tbl"]).select("tbl", "total", "matched", "wrong", "accuracy")


@query(f"""WITH {CELLS} SELECT tbl, row, min(((tbl * 3 + row * 5 + col * 7) % 100)::DOUBLE / 100) AS confidence FROM ce GROUP BY tbl, row""")
def q_cell_min_confidence(spark, d):
    c = model.cells(spark, d)
    e = c.select("tbl", (F.col("row") * 3 + F.col("col")).alias("ordinal"), F.lit(1.0).alias("x0"), (10.0 * F.col("row") + 1).alias("y0"), F.lit(3.0).alias("x1"), (10.0 * F.col("row") + 3).alias("y1"), (((F.col("tbl") * 3 + F.col("row") * 5 + F.col("col") * 7) % 100) / 100.0).alias("score"))
    boxes = c.select("tbl", F.col("row").alias("cell"), F.lit(0.0).alias("x0"), (10.0 * F.col("row")).alias("y0"), F.lit(9.0).alias("x1"), (10.0 * F.col("row") + 9).alias("y1")).distinct()
    m = trust.cell_confidence(e, boxes, c.select("tbl", F.lit(1000.0).alias("height")).distinct())
    return m.select("tbl", F.col("cell").alias("row"), "confidence")


# fields
HINT = {t: h for t, h in fields.HINTS.items()}
FILLED = "(coalesce(trim({c}), '') <> '')::INT"


@query(f"""WITH {KIE} SELECT task, CASE document_type WHEN 'invoice' THEN round_even(({FILLED.format(c="invoice_number")} + {FILLED.format(c="total")} + {FILLED.format(c="seller_name")} + {FILLED.format(c="invoice_date")}) / 4.0::DOUBLE, 4) WHEN 'receipt' THEN round_even({FILLED.format(c="total")} / 4.0::DOUBLE, 4) ELSE 0 END AS fill
  FROM ki WHERE fields IS NOT NULL AND document_type IN ('invoice', 'receipt', '', 'id_card')""")
def q_fill_confidence(spark, d):
    k = model.kie(spark, d).filter("fields is not null").filter(F.col("document_type").isin("invoice", "receipt", "", "id_card"))
    return k.select("task", fields.fill_confidence(F.col("fields"), F.col("document_type")).cast("double").alias("fill"))


@query(f"""WITH {KIE} SELECT document_type, reason, count(*) AS n FROM (SELECT document_type, CASE WHEN fields IN ('{{}}') THEN 'empty_fields' WHEN document_type = 'invoice' THEN CASE WHEN {FILLED.format(c="invoice_number")} + {FILLED.format(c="total")} + {FILLED.format(c="seller_name")} + {FILLED.format(c="invoice_date")} > 0 THEN 'production_hit' ELSE 'no_required_keys_filled' END
  WHEN document_type = 'receipt' THEN CASE WHEN {FILLED.format(c="total")} > 0 THEN 'production_hit' ELSE 'no_required_keys_filled' END WHEN document_type IN ('id_card', 'passport', 'bank_card', 'coi', 'pico') THEN 'no_required_keys_filled' ELSE 'unsupported_doc_type:' || document_type END AS reason FROM ki WHERE fields IS NOT NULL) GROUP BY 1, 2""")
def q_production_hit(spark, d):
    k = model.kie(spark, d).filter("fields is not null")
    return k.select("document_type", fields.production_hit(F.col("fields"), F.col("document_type"))["reason"].alias("reason")).groupBy("document_type", "reason").agg(F.count("*").alias("n"))


DATE_OK = r"regexp_matches(trim(invoice_date), '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})$')"
MONEY_OK = r"(trim(total) <> '' AND regexp_matches(trim(total), '^[$€£]?\s*-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{2})?$'))"


@query(f"""WITH {KIE} SELECT task, (coalesce({DATE_OK}, false))::INT::BIGINT + (coalesce({MONEY_OK}, false))::INT::BIGINT AS passed, 2 - (coalesce({DATE_OK}, false))::INT::BIGINT - (coalesce({MONEY_OK}, false))::INT::BIGINT AS failed,
  concat_ws(',', CASE WHEN NOT coalesce({DATE_OK}, false) THEN 'invoice_date' END, CASE WHEN NOT coalesce({MONEY_OK}, false) THEN 'total' END) AS failed_fields FROM ki WHERE document_type = 'invoice' AND fields IS NOT NULL""")
def q_validate_fields(spark, d):
    rows = model.kie_rows(spark, d).filter("document_type = 'invoice'")
    return fields.validation_summary(fields.validated(rows)).select("task", "passed", "failed", "failed_fields")


@query(f"""WITH {KIE} SELECT document_type, count(*) AS n, count(*) FILTER (document_type IN ('invoice', 'receipt', 'id_card', 'passport', 'bank_card') AND (NOT coalesce({MONEY_OK}, false) OR (document_type = 'invoice' AND NOT coalesce({DATE_OK}, false))) AND document_type NOT IN ('id_card', 'passport', 'bank_card')) AS n_review FROM ki WHERE fields IS NOT NULL GROUP BY 1""")
def q_hitl_route(spark, d):
    rows = model.kie_rows(spark, d)
    s = fields.validation_summary(fields.validated(rows)).join(rows.select("task", "document_type").distinct(), "task")
    send = fields.to_review(F.col("document_type"), F.lit(""), F.col("validation_passed"), F.lit(True))
    return s.groupBy("document_type").agg(F.count("*").alias("n"), F.count_if(send).alias("n_review"))


@query(f"""WITH {KIE}, n AS (SELECT task, regexp_extract(total, '-?[0-9]{{1,3}}([,，][0-9]{{3}})+(\\.[0-9]+)?|-?[0-9]+(\\.[0-9]+)?', 0) AS s, total FROM ki WHERE total IS NOT NULL)
  SELECT task, CASE WHEN s <> '' THEN replace(replace(s, ',', ''), '，', '')::DOUBLE END AS amount, CASE WHEN s = '' THEN NULL WHEN contains(total, '£') THEN 'GBP' WHEN contains(total, '$') THEN 'USD' WHEN contains(total, '¥') THEN 'CNY' WHEN contains(total, '€') THEN 'EUR' WHEN contains(total, '￥') THEN 'CNY'
    ELSE nullif(upper(regexp_extract(total, '(?i)\\b(GBP|USD|EUR|CNY|JPY|HKD|AUD|CAD)\\b', 1)), '') END AS currency FROM n""".replace("\\\\", "\\"))
def q_currency(spark, d):
    k = model.kie_rows(spark, d).filter("field = 'total' and value is not null")
    return k.select("task", fields.to_currency(F.col("value")).alias("c")).select("task", "c.amount", "c.currency")


@query(f"""WITH {KIE} SELECT task, strftime(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d-%m-%Y'), try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d %b %Y'), try_strptime(v, '%d %B %Y'), try_strptime(v, '%d-%b-%Y'), try_strptime(v, '%Y.%m.%d'), try_strptime(v, '%d.%m.%Y'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%Y%m%d')), '%Y-%m-%d') AS iso
  FROM (SELECT task, trim(invoice_date) AS v FROM ki WHERE invoice_date IS NOT NULL)""")
def q_typed_dates(spark, d):
    k = model.kie_rows(spark, d).filter("field = 'invoice_date' and value is not null")
    return k.select("task", fields.to_date(F.col("value")).alias("iso"))


PAGE_SPECS = [("1-3,7", 9), ("all", 3), ("first", 5), ("2,2,1", 4), ("8-12", 9), ("x", 3), ("", 2), ("3", 2), ("all", 0)]


@query("SELECT * FROM (VALUES ('1-3,7', 9, '1,2,3'), ('all', 3, '1,2,3'), ('first', 5, '1'), ('2,2,1', 4, '1,2'), ('8-12', 9, '8,9'), ('x', 3, ''), ('', 2, '1'), ('3', 2, ''), ('all', 0, '')) AS t(spec, pages, listed)")
def q_page_spec(spark, d):
    df = spark.createDataFrame(PAGE_SPECS, "spec string, pages int")
    return df.select("spec", "pages", F.array_join(fields.page_list(F.col("spec"), F.col("pages"), 3), ",").alias("listed"))


@query("""SELECT task, field, arg_max(value, page) AS value FROM (SELECT batch_id AS task, task_id AS page, unnest(['invoice_number', 'seller_name', 'total']) AS field, unnest([json_extract_string(result, '$.kie_fields.invoice_number'), json_extract_string(result, '$.kie_fields.seller_name'), json_extract_string(result, '$.kie_fields.total')]) AS value
  FROM (SELECT batch_id, dense_rank() OVER (PARTITION BY batch_id ORDER BY task_id) AS task_id, result FROM (SELECT batch_id, task_id, max(result) AS result FROM batch_tasks WHERE result IS NOT NULL GROUP BY 1, 2))) WHERE regexp_replace(coalesce(value, ''), '\\s', '', 'g') NOT IN ('', '[]', '{}', 'null') GROUP BY 1, 2""".replace("\\\\", "\\"))
def q_merge_pages(spark, d):
    from pyspark.sql import Window

    t = load(spark, d, "batch_tasks").filter("result is not null").groupBy("batch_id", "task_id").agg(F.max("result").alias("result"))
    t = t.withColumn("page", F.dense_rank().over(Window.partitionBy("batch_id").orderBy("task_id")))
    names = ["invoice_number", "seller_name", "total"]
    rows = t.select(F.col("batch_id").alias("task"), "page", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.get_json_object("result", f"$.kie_fields.{n}").alias("value")) for n in names])).alias("x")).select("task", "page", "x.*")
    return fields.merged_pages(rows)


@query()
def q_merge_items(spark, d):
    """Line items of all tasks of a batch as one list (nested JSON, so rows only)."""
    t = load(spark, d, "batch_tasks").filter("result is not null").select(F.col("batch_id").alias("task"), F.col("task_id").alias("page"), F.lit("items").alias("field"), F.get_json_object("result", "$.kie_fields.items").alias("value"))
    return fields.merged_pages(t.distinct())


@query()
def q_flattened_results(spark, d):
    """Every extracted field under its dotted path, counted (recursive JSON, so rows only)."""
    return batches.result_fields(load(spark, d, "batch_tasks")).groupBy("path").agg(F.count("*").alias("n"))


# batches
@query("""WITH t AS (SELECT batch_id, task_id, coalesce(arg_max(status, coalesce(completed_at, started_at)), max(status)) AS status, min(started_at) AS s, max(completed_at) AS e FROM batch_tasks GROUP BY 1, 2)
  SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round_even(100.0::DOUBLE * count(*) FILTER (status IN ('completed', 'failed', 'skipped', 'cancelled')) / count(*), 2) AS progress,
    CASE WHEN count(*) FILTER (status IN ('completed', 'failed')) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')), 2) END AS success_rate,
    CASE WHEN count(*) FILTER (status IN ('pending', 'processing')) > 0 THEN 'processing' WHEN count(*) = count(*) FILTER (status = 'failed') THEN 'failed' WHEN count(*) FILTER (status = 'cancelled') > 0 THEN 'cancelled' ELSE 'completed' END AS final_status FROM t GROUP BY batch_id""")
def q_batch_summary(spark, d):
    return batches.batch_summary(load(spark, d, "batch_tasks")).select("batch_id", "total", "completed", "failed", "progress", "success_rate", "final_status")


@query("""WITH k AS (SELECT DISTINCT batch_id, unnest(json_keys(result, '$.kie_fields')) AS path FROM batch_tasks WHERE result IS NOT NULL), f AS (SELECT DISTINCT batch_id, path FROM k) SELECT batch_id, path, row_number() OVER (PARTITION BY batch_id ORDER BY path) AS place FROM f
  WHERE EXISTS (SELECT 1 FROM batch_tasks b WHERE b.batch_id IS NOT DISTINCT FROM f.batch_id AND json_type(b.result, '$.kie_fields.' || path) NOT IN ('NULL', 'OBJECT'))""")
def q_dynamic_columns(spark, d):
    c = batches.dynamic_columns(batches.result_fields(load(spark, d, "batch_tasks")))
    return c.select("batch_id", "path", F.col("place").cast("bigint").alias("place"))


@query()
def q_kie_table(spark, d):
    """The table of results in long form."""
    return batches.kie_table(load(spark, d, "batch_tasks")).groupBy("column", "place").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT *, row_number() OVER (PARTITION BY status IN ('completed', 'succeeded', 'failed', 'cancelled', 'interrupted', 'missing_artifacts') ORDER BY coalesce(completed_at, created_at) DESC NULLS LAST, record_id DESC) AS n FROM batch_jobs)
  SELECT record_id, status FROM j WHERE coalesce(status NOT IN ('completed', 'succeeded', 'failed', 'cancelled', 'interrupted', 'missing_artifacts'), false) OR n <= 5""")
def q_retention(spark, d):
    return batches.retained(load(spark, d, "batch_jobs").filter("status is not null"), 5).select("record_id", "status")


@query("""SELECT record_id, CASE WHEN status = 'processing' THEN 'paused' ELSE status END AS status FROM batch_jobs""")
def q_recovered(spark, d):
    return batches.recovered(load(spark, d, "batch_jobs").select("record_id", "status"), "batch")


@query("""SELECT DISTINCT batch_id, task_id, file_name, status, left(coalesce(error, ''), 400) AS error FROM batch_tasks WHERE status IN ('failed', 'skipped')""")
def q_failures(spark, d):
    return batches.failures(load(spark, d, "batch_tasks"))


@query("""SELECT event_type, s.id AS subscription_id, count(*) AS n FROM events e JOIN (VALUES ('a', ['view', 'click']), ('b', ['purchase', 'view'])) AS s(id, ev) ON list_contains(s.ev, e.event_type) GROUP BY 1, 2""")
def q_subscribers(spark, d):
    subs = spark.createDataFrame([("a", "u", ["view", "click", "view"], True), ("b", "v", ["purchase", "view"], True), ("c", "w", ["view"], False)], "id string, url string, events array<string>, active boolean")
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("event"))
    kinds = e.select("event_id", F.col("event").alias("event_type"))
    return batches.subscribers(e, subs).join(kinds, "event_id").groupBy("event_type", "subscription_id").agg(F.count("*").alias("n"))


RULES = [("prefix", "standard", "S"), ("contains", "brass", "B"), ("contains", "steel", "T"), ("prefix", "promo", "P"), ("exact", "economy anodized steel", "X")]


@query("""SELECT p_partkey, CASE WHEN t = 'economy anodized steel' THEN 'X' WHEN t LIKE 'promo%' THEN 'P' WHEN t LIKE '%steel%' THEN 'T' WHEN t LIKE '%brass%' THEN 'B' WHEN t LIKE 'standard%' THEN 'S' ELSE 'UNMAPPED' END AS mapped FROM (SELECT p_partkey, lower(trim(p_type)) AS t FROM part)""")
def q_rules_last_match(spark, d):
    return batches.ruled(load(spark, d, "part"), RULES, "p_type").select("p_partkey", "mapped")


CLASS_SQL = ", ".join(f"{{'n': {' + '.join('contains(t, ' + chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) + ')::INT' for w in words)}, 'o': {-i}, 't': '{t}'}}" for i, (t, words) in enumerate(accuracy.KEYWORDS.items()))


@query(f"""SELECT doc_id, CASE WHEN total > 1 THEN best.t ELSE 'auto' END AS document_type, CASE WHEN total > 1 THEN round_even(best.n / total, 3) ELSE 0 END AS confidence FROM (SELECT doc_id, list_max(s) AS best, list_sum(list_transform(s, lambda x: x.n)) AS total FROM (SELECT doc_id, [{CLASS_SQL}] AS s FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)))""")
def q_classify_documents(spark, d):
    return accuracy.classified(load(spark, d, "documents"), accuracy.KEYWORDS, "doc_id").select("doc_id", "document_type", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT min(doc_id) AS doc_id, n_chars, lang FROM (SELECT doc_id, n_chars, lang, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS f FROM documents) WHERE f = doc_id GROUP BY f, n_chars, lang")
def q_dedupe_first_wins(spark, d):
    t = load(spark, d, "documents").select("doc_id", "n_chars", "lang", F.sha2("text", 256).alias("h"))
    return batches.first_wins(t, ["h", "n_chars"], ["doc_id"]).select("doc_id", "n_chars", "lang")


# accuracy
@query("""SELECT item_id, count(*) AS printed, count(*) FILTER (NOT seen) AS missing, round_even(1 - count(*) FILTER (NOT seen) / count(*), 4) AS recall FROM (SELECT DISTINCT item_id, w, w IN (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+')) FROM eval_items WHERE item_id % 2 = 0) AS seen
  FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+')) AS w FROM eval_items) WHERE w <> '') GROUP BY item_id""".replace("\\\\", "\\"))
def q_text_recall(spark, d):
    e = load(spark, d, "eval_items").select(F.col("item_id").alias("doc"), "text")
    half = load(spark, d, "eval_items").filter("item_id % 2 = 0").select("text")
    seen = half.select(F.explode(strings.harness_tokens(F.col("text"))).alias("w")).distinct().agg(F.concat_ws(" ", F.array_sort(F.collect_set("w"))).alias("text"))
    actual = e.select("doc").join(F.broadcast(seen), F.lit(True)).select("doc", "text")
    return accuracy.text_recall(e, actual).select(F.col("doc").alias("item_id"), "printed", "missing", "recall")


@query("""SELECT doc_id, status FROM (SELECT doc_id, CASE WHEN e = '' THEN 'gt_empty' WHEN a = '' THEN 'missing' WHEN e = a THEN 'match' ELSE 'wrong' END AS status FROM (SELECT doc_id, lower(coalesce(doc_type, '')) AS e, CASE doc_id % 3 WHEN 0 THEN lower(coalesce(doc_type, '')) WHEN 1 THEN '' ELSE 'other' END AS a FROM documents))""")
def q_gt_fields(spark, d):
    t = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit("doc_type").alias("field"), F.col("doc_type").alias("value"))
    a = t.select("doc", "field", F.when(F.col("doc") % 3 == 0, F.concat(F.lit(" $"), F.upper("value"))).when(F.col("doc") % 3 == 1, "").otherwise("other").alias("value"))
    return accuracy.field_items(t, a).select(F.col("doc").alias("doc_id"), "status")


@query()
def q_fuzzy_captions(spark, d):
    """Captions against found ones by similarity, one to one (order matters, so rows only)."""
    e = model.elements(spark, d).filter("type = 'figure_caption'").select("doc", F.col("ord").alias("n"), "page", "text")
    return accuracy.matched_captions(e, e.withColumn("text", F.concat("text", F.lit(" x")))).groupBy("status").agg(F.count("*").alias("n"))


# texts
@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b', '[TAX-ID-MASKED]', 'g'), '\\b[0-9]{2}-[0-9]{7}\\b', '[TAX-ID-MASKED]', 'g'), '\\b[0-9]{9}\\b', '[TAX-ID-MASKED]', 'g')) AS masked FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')""".replace("\\\\", "\\"))
def q_pii_mask(spark, d):
    t = load(spark, d, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return t.select("doc_id", F.md5(strings.pii_masked(F.col("text"))).alias("masked"))


CELL_TEXTS = ["+5", "=SUM(A1)", "-0.5", "-abc", "@x", "\tx", "-1,000", "plain", 'a "b"', "c,d"]
CELL_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(CELL_TEXTS)).replace("'\t", "chr(9) || '")


@query(f"""SELECT n, CASE WHEN left(t, 1) IN ('=', '+', '@', chr(9), chr(13)) OR (left(t, 1) = '-' AND try_cast(replace(t, ',', '') AS DOUBLE) IS NULL) THEN chr(39) || t ELSE t END AS safe, CASE WHEN contains(t, ',') OR contains(t, chr(34)) THEN chr(34) || replace(t, chr(34), chr(34) || chr(34)) || chr(34) ELSE t END AS quoted FROM (VALUES {CELL_VALUES}) AS v(n, t)""")
def q_excel_safe(spark, d):
    df = spark.createDataFrame(list(enumerate(CELL_TEXTS)), "n int, t string")
    return df.select("n", strings.spreadsheet_safe(F.col("t")).alias("safe"), strings.csv_quoted(F.col("t")).alias("quoted"))


@query(f"WITH {ELEMENTS} SELECT doc, ord, CASE WHEN confidence IS NULL THEN 0 ELSE round_even(confidence * 100, 0)::INT END AS pct FROM el")
def q_confidence_pct(spark, d):
    return model.elements(spark, d).select("doc", "ord", strings.percent(F.col("confidence")).alias("pct"))


@query(f"""WITH {CELLS} SELECT tbl AS doc, count(DISTINCT row) + 2 AS lines, '=== Table 1 (Page 1) confidence=87% ===' AS banner FROM ce GROUP BY tbl""")
def q_csv_lines(spark, d):
    c = model.cells(spark, d).withColumn("doc", F.col("tbl"))
    t = c.select("doc", "tbl", F.lit(1).alias("page"), F.lit(0.87).alias("confidence"), F.lit(None).cast("string").alias("caption")).distinct()
    lines = exports.csv_lines(t, c.select("doc", "tbl", "row", "col", "text"))
    return lines.groupBy("doc").agg(F.count("*").alias("lines"), F.regexp_replace(F.min_by("line", "place"), "^'", "").alias("banner"))


@query()
def q_markdown(spark, d):
    """Documents as Markdown (sizes; the text is long)."""
    return exports.markdown(model.elements(spark, d).select("doc", "page", "ord", "type", "text", "confidence")).select("doc", F.length("text").alias("size"))


@query()
def q_structured_tables(spark, d):
    """Tables as structured JSON (sizes)."""
    c = model.cells(spark, d).withColumn("doc", F.col("tbl"))
    t = c.select("doc", "tbl", F.lit(1).alias("page"), F.lit(None).cast("string").alias("caption")).distinct()
    return exports.structured_tables(t, c.select("doc", "tbl", "row", "col", "text")).select("doc", F.length("json").alias("size"))


@query("""SELECT date_trunc('hour', ts) + to_minutes(30 * k) AS start, event_type, count(*) AS n FROM (SELECT *, unnest([-1, 0, 1]) AS k FROM events) WHERE ts >= date_trunc('hour', ts) + to_minutes(30 * k) AND ts < date_trunc('hour', ts) + to_minutes(30 * k + 60) GROUP BY 1, 2""")
def q_sliding(spark, d):
    e = load(spark, d, "events")
    w = e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


@query(f"""WITH {ELEMENTS} SELECT doc, ord, round_even(greatest(0, x1 - x0) * (y1 - y0), 2) AS area, round_even((x0 + x1) / 2, 2) AS cx FROM el""")
def q_described(spark, d):
    return layout.described(model.elements(spark, d)).select("doc", "ord", "area", "cx")


@query(f"""WITH {CELLS} SELECT tbl, row, col, round_even(20 + 100.0::DOUBLE * col, 2) AS x0, round_even(40 + 20.0::DOUBLE * (row - 1), 2) AS y0 FROM ce""")
def q_cell_rects(spark, d):
    t, _, c = model.placed(spark, d)
    g = c.join(t, ["doc", "page", "tbl"]).withColumn("r", geometry.cell_rect(F.struct("x0", "y0", "x1", "y1"), F.col("row"), F.col("col"), F.col("n_rows"), F.col("n_cols")))
    return g.select("tbl", (F.col("row") + 1).alias("row"), "col", F.bround("r.x0", 2).alias("x0"), F.bround("r.y0", 2).alias("y0"))
