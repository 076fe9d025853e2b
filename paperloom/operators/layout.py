"""Layout elements: adapters of engine output, fused and view layers, quality, containment, captions and split figures.

``elements`` (doc, page, ord, id, type, x0, y0, x1, y1, confidence, reading_order, text, html). Pairwise steps join on
(doc, page) with the boxes as residual; order-dependent assignments run once per page in Arrow batches.

Defined results: unknown labels pass through; a missing confidence stays null (not measured is not 0); boxes without extent
contain and overlap nothing; pages without elements do not appear; other columns are kept where the docstring says so.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import BOX, area, box_of_json, containment, derived, intersection, merged, overlap_ratio, vertical_gap

# Labels of the layout model.
TEXT_LABELS = ["doc_title", "paragraph_title", "abstract_title", "reference_title", "content_title", "text", "abstract", "content", "reference", "reference_content", "algorithm", "header", "header_image", "footer", "footer_image", "footnote", "figure_title", "aside_text", "number", "title", "subtitle", "figure_caption", "table_caption", "list", "list_item"]
VISION_LABELS = ["figure", "image", "chart", "figure_table_chart", "picture"]
FORMULA_LABELS = ["formula", "inline_formula", "equation", "formula_number"]
SEAL_LABELS = ["seal", "stamp"]
STRATEGIES = {"no_ocr": "no_ocr", "no_ocr_empty": "no_ocr_empty", "skip_table": "table_structure_only", "skip_formula": "formula_placeholder", "skip_seal": "seal_placeholder", "extracted": "region_only", "passthrough_unknown_type": "passthrough_unknown_type", "recognized": "recognized_by_optional_engine"}
KINDS = {
    "title": ["doc_title", "title", "subtitle"],
    "paragraph_title": ["paragraph_title", "abstract_title", "reference_title", "content_title", "section_header"],
    "figure_title": ["figure_table_chart_title", "caption", "figure_caption", "table_caption"],
    "paragraph": ["text", "abstract", "content", "reference", "reference_content", "algorithm", "aside_text", "author", "date", "references", "list", "list_item"],
    "header": ["header", "header_image", "page_header"],
    "footer": ["footer", "footer_image", "footnote", "page_footer"],
    "number": ["number"],
    "table": ["table"],
    "figure": ["figure", "image", "chart", "picture", "figure_table_chart", "flowchart"],
    "formula": ["formula", "inline_formula", "equation", "formula_body", "display_formula", "formula_number"],
    "seal": ["seal", "stamp"],
}
UNIFIED = {
    "title": "title", "subtitle": "subtitle", "section_header": "section_header", "table": "table", "table_header": "table_header", "table_caption": "table", "figure": "figure", "figure_caption": "figure", "image": "image",
    "page_header": "page_header", "page_footer": "page_footer", "footnote": "footnote", "formula": "formula", "list_item": "list_item", "header": "page_header", "header_image": "page_header", "footer": "page_footer", "footer_image": "page_footer",
    "equation": "formula", "list": "list_item", "paragraph": "text", "number": "text", "aside_text": "text", "reference": "text", "doc_index": "text",
}
BODY_LABELS = ["text", "paragraph", "title", "table", "figure_caption"]
FIGURE_LABELS = ["figure", "image", "chart", "picture", "figure_table_chart", "flowchart"]
FIGURE_CAPTIONS = ["figure_caption", "figure_title", "figure_table_chart_title", "caption"]
TABLE_CAPTIONS = ["table_caption", "figure_table_chart_title"]
SCORE_TOLERANCE, FALLBACK_BOX, FALLBACK_CONFIDENCE = 3.0, (0.0, 0.0, 1000.0, 1400.0), 0.01


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in BOX])


def recognised_entries(df: DataFrame, key: list[str], texts: str = "rec_texts", scores: str = "rec_scores", polys: str = "rec_polys") -> DataFrame:
    """Parallel arrays of recognised texts, scores and polygons (flat numbers) as rows: key, ordinal, text, score, x0..y1. Blank texts are dropped."""
    z = F.arrays_zip(F.col(texts).alias("text"), F.col(scores).alias("score"), F.col(polys).alias("poly"))
    rows = df.select(*key, F.posexplode(z).alias("ordinal", "e")).filter(F.trim(F.coalesce("e.text", F.lit(""))) != "")
    even, odd = F.filter("e.poly", lambda x, i: i % 2 == 0), F.filter("e.poly", lambda x, i: i % 2 == 1)
    return rows.select(*key, "ordinal", "e.text", "e.score", F.array_min(even).alias("x0"), F.array_min(odd).alias("y0"), F.array_max(even).alias("x1"), F.array_max(odd).alias("y1"))


def recognised_pairs(df: DataFrame, key: list[str], entries: str = "entries") -> DataFrame:
    """Entries [box, (text, confidence)] as the same rows; ``entries`` is an array of structs (box array<double>, text, confidence)."""
    rows = df.select(*key, F.posexplode(entries).alias("ordinal", "e")).filter(F.trim(F.coalesce("e.text", F.lit(""))) != "")
    even, odd = F.filter("e.box", lambda x, i: i % 2 == 0), F.filter("e.box", lambda x, i: i % 2 == 1)
    return rows.select(*key, "ordinal", "e.text", F.col("e.confidence").alias("score"), F.array_min(even).alias("x0"), F.array_min(odd).alias("y0"), F.array_max(even).alias("x1"), F.array_max(odd).alias("y1"))


def near_scores(elements: DataFrame, detections: DataFrame) -> DataFrame:
    """Elements with the score of the first detection (doc, page, n, x0..y1, score) all of whose edges lie within 3 pixels of theirs; null without one.

    A grid of 3 pixels on the upper left corner is the equi-key, looked up in the neighbouring cells.
    """
    d = detections.select("doc", "page", "n", "score", *[F.col(c).alias(f"d{c}") for c in BOX], F.floor(F.col("x0") / SCORE_TOLERANCE).alias("gx"), F.floor(F.col("y0") / SCORE_TOLERANCE).alias("gy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    e = elements.select("doc", "page", "ord", *BOX, F.explode(steps).alias("s")).select("*", (F.floor(F.col("x0") / SCORE_TOLERANCE) + F.col("s.i")).alias("gx"), (F.floor(F.col("y0") / SCORE_TOLERANCE) + F.col("s.j")).alias("gy"))
    close = F.lit(True)
    for c in BOX:
        close = close & (F.abs(F.col(c) - F.col(f"d{c}")) < SCORE_TOLERANCE)
    best = e.join(d, ["doc", "page", "gx", "gy"]).filter(close).groupBy("doc", "page", "ord").agg(F.min_by("score", "n").alias("score"))
    return elements.join(best, ["doc", "page", "ord"], "left")


def adapted_blocks(blocks: DataFrame) -> DataFrame:
    """Engine blocks (doc, page, idx, label, bbox JSON, content, block_order, index) as elements; blocks without a readable box are dropped.

    Pages whose blocks are tables in HTML alone get the page's default box and a confidence of 0.01.
    """
    b = box_of_json(F.col("bbox"))
    whole = F.lower(F.coalesce("content", F.lit(""))).contains("<table") & F.col("bbox").isNull()
    real = blocks.withColumn("b", F.when(whole, F.struct(*[F.lit(v).alias(c) for c, v in zip(BOX, FALLBACK_BOX)])).otherwise(b)).filter("b is not null")
    return real.select(
        "doc", "page", F.col("idx").alias("ord"), F.format_string("p%d_e%d", "page", F.coalesce("index", "idx")).alias("id"), F.lower(F.coalesce("label", F.lit("unknown"))).alias("type"), "b.*",
        F.when(whole, F.lit(FALLBACK_CONFIDENCE)).alias("confidence"), F.col("block_order").alias("reading_order"),
        F.when(~F.lower(F.coalesce("content", F.lit(""))).contains("<table"), F.trim("content")).alias("text"), F.when(F.lower("content").contains("<table"), F.col("content")).alias("html"),
    )


def unified(elements: DataFrame, page_height: str = "page_height") -> DataFrame:
    """Elements with the label of the unified model (unknown ones are text) and their depth, in order of page, depth, y, x."""
    label = F.coalesce(F.try_element_at(_table(UNIFIED), F.lower("type")), F.lit("text"))
    depth = F.floor(F.try_divide(1000 * F.col("y0"), F.col(page_height))).cast("int")
    order = Window.partitionBy("doc").orderBy("page", "z_index", "y0", "x0", "ord")
    return elements.withColumns({"element_type": label, "z_index": F.coalesce(depth, F.lit(0))}).withColumn("position", F.row_number().over(order))


def processing_status(label: Column, text: Column) -> Column:
    """How a block of a type was handled."""
    t = F.trim(F.lower(F.coalesce(label, F.lit(""))))
    return (
        F.when(t == "table", "skip_table").when(t.isin(FORMULA_LABELS), "skip_formula").when(t.isin(SEAL_LABELS), "skip_seal").when(t.isin(VISION_LABELS), "extracted")
        .when(t.isin(TEXT_LABELS), F.when(F.trim(F.coalesce(text, F.lit(""))) != "", "no_ocr").otherwise("no_ocr_empty")).otherwise("passthrough_unknown_type")
    )


def merge_strategy(status: Column) -> Column:
    """Strategy a status stands for."""
    return F.coalesce(F.try_element_at(_table(STRATEGIES), status), F.lit("keep_structure"))


def view_kind(label: Column) -> Column:
    """The kind a label has in the view: one of eleven, unknown labels as they are, none as a paragraph."""
    t = F.lower(F.coalesce(label, F.lit("")))
    return F.coalesce(F.try_element_at(_table({t: k for k, ts in KINDS.items() for t in ts}), t), F.when(t != "", t), F.lit("paragraph"))


def fused_blocks(elements: DataFrame, source: str = "layout") -> DataFrame:
    """Elements as fused blocks: id (by place where missing), status, provenance, payload, in their order."""
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord")) - 1
    e = elements.withColumn("block_id", F.coalesce(F.when(F.col("id") != "", F.col("id")), F.format_string("p%d_b%d", "page", place))).withColumn("status", processing_status(F.col("type"), F.col("text")))
    text = F.coalesce("text", F.lit(""))
    return e.select(
        "doc", "page", "ord", "block_id", F.lower(F.coalesce("type", F.lit("unknown"))).alias("type"), *BOX, "status", F.lit(source).alias("source"), "confidence", "reading_order",
        F.struct(text.alias("text"), "confidence", F.when(F.lower("type") == "table", F.col("html")).alias("html")).alias("payload"),
        F.struct(F.lit(source).alias("primary_source"), text.alias("primary_text"), merge_strategy(F.col("status")).alias("merge_strategy"), F.col("status").alias("status"), F.lower("type").alias("block_type")).alias("provenance"),
    )


def with_formulas(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """Blocks with recognised formulas (doc, source_id, ordinal, latex) in place: the first of a block counts, an empty one marks it unrecognised."""
    first = formulas.groupBy("doc", F.col("source_id").alias("block_id")).agg(F.min_by("latex", "ordinal").alias("latex"))
    done = F.trim(F.coalesce("latex", F.lit("")))
    out = blocks.join(first, ["doc", "block_id"], "left").withColumn("_hit", F.col("latex").isNotNull())
    return out.withColumns({
        "status": F.when(F.col("_hit") & (done != ""), "recognized").when(F.col("_hit"), "formula_unrecognized").otherwise(F.col("status")),
        "payload": F.when(F.col("_hit") & (done != ""), F.col("payload").withField("text", done)).otherwise(F.col("payload")),
    }).drop("latex", "_hit")


def with_seals(blocks: DataFrame, seals: DataFrame) -> DataFrame:
    """(doc, page, position, block_id, text): placeholders of seals on page 1 taken out, recognised seals (doc, ordinal, text) added behind the others."""
    kept = blocks.filter(~((F.col("status") == "skip_seal") & (F.col("page") == 1))).select("doc", "page", F.lit(0).alias("late"), "ord", "block_id", F.col("payload.text").alias("text"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("ordinal"))
    new = seals.filter(F.trim("text") != "").select("doc", F.lit(1).alias("page"), F.lit(1).alias("late"), F.col("ordinal").alias("ord"), F.format_string("seal_%04d", number).alias("block_id"), "text")
    order = Window.partitionBy("doc", "page").orderBy("late", "ord")
    return kept.unionByName(new).withColumn("position", F.row_number().over(order)).drop("late", "ord")


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements with their place in reading order: those the engine ordered first, then the others from top left."""
    order = Window.partitionBy("doc", "page").orderBy(F.col("reading_order").isNull(), "reading_order", "y0", "x0", "ord")
    return elements.withColumn("place", F.row_number().over(order))


def view_order(elements: DataFrame) -> DataFrame:
    """Elements with the order of the view: the engine's, else a running count of the document, which an element without order moves on by two."""
    before = Window.partitionBy("doc").orderBy("page", "ord")
    fallbacks = F.coalesce(F.sum(F.col("reading_order").isNull().cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return elements.withColumn("view_order", F.coalesce("reading_order", F.row_number().over(before) - 1 + fallbacks))


def page_view(elements: DataFrame) -> DataFrame:
    """Per page: the content of its paragraphs in view order, and how many blocks of each kind it has."""
    v = view_order(elements).withColumn("kind", view_kind(F.col("type")))
    told = F.when(F.col("kind").isin("title", "paragraph_title", "paragraph") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.struct("view_order", "ord", "text"))
    return v.groupBy("doc", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text"]), "\n").alias("content"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("paragraph", "table", "figure", "formula", "seal")],
    )


def type_counts(elements: DataFrame) -> DataFrame:
    """Counts by (doc, page, type), (doc, type) and doc; the level tells which."""
    counted = elements.rollup("doc", "type", "page").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return counted.filter("doc is not null")


def content_flags(elements: DataFrame) -> DataFrame:
    """Per document: elements, pages, and whether it has tables, figures, formulas."""
    t = F.lower("type")
    return elements.groupBy("doc").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.bool_or(t == "table").alias("has_tables"), F.bool_or(t.isin(FIGURE_LABELS)).alias("has_figures"), F.bool_or(t.isin(FORMULA_LABELS)).alias("has_formulas"))


def quality_layer(blocks: DataFrame) -> DataFrame:
    """Per document: counts of blocks by what they are and how they were handled, and the mean of the confidences above 0 of text (null for none)."""
    t = F.lower("type")
    text = t.isin(TEXT_LABELS)
    return blocks.groupBy("doc").agg(
        F.count_if(text).alias("text_blocks_total"), F.count_if(text & F.col("status").isin("no_ocr", "no_ocr_empty")).alias("text_blocks_no_ocr"), F.count_if(t == "table").alias("table_blocks_total"),
        F.count_if(t.isin(VISION_LABELS)).alias("figure_blocks_total"), F.count_if(t.isin("formula", "inline_formula")).alias("formula_count"), F.count_if(t.isin(SEAL_LABELS)).alias("seal_count"),
        F.avg(F.when(text & (F.col("confidence") > 0), F.col("confidence"))).alias("avg_layout_confidence"),
    )


def formula_quality(total: Column, boxes: Column, recognised: Column) -> Column:
    """(total, failed, rate) of formulas (or seals): the largest of the counts, what is not recognised, and the share that is."""
    n = F.greatest(F.coalesce(total, F.lit(0)), F.coalesce(boxes, F.lit(0)), F.coalesce(recognised, F.lit(0)))
    done = F.coalesce(recognised, F.lit(0))
    return F.struct(n.alias("total"), F.greatest(n - done, F.lit(0)).alias("failed"), F.coalesce(F.try_divide(done, n), F.lit(0.0)).cast("double").alias("rate"))


def formula_stats(stats: DataFrame) -> DataFrame:
    """Per document: counters of pages added up, the histograms of reasons (map) added key by key, the first model name that is not empty."""
    plain = stats.groupBy("doc").agg(F.sum("boxes").alias("boxes"), F.sum("recognised").alias("recognised"), F.min_by(F.when(F.col("model") != "", F.col("model")), F.when(F.col("model") != "", F.col("page"))).alias("model"))
    keys = stats.select("doc", F.explode("reasons").alias("k", "v")).groupBy("doc", "k").agg(F.sum("v").alias("v")).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("reasons"))
    return plain.join(keys, "doc", "left")


def containment_pairs(elements: DataFrame, share: float = 0.0) -> DataFrame:
    """(doc, page, outer, inner, ratio): boxes that lie in another one but for 5 % of its extent or 10 pixels, with the share of the inner one they cover."""
    a, b = elements.alias("a"), elements.alias("b")
    tx, ty = (F.greatest(F.lit(10.0), 0.05 * (F.col(f"a.{c}1") - F.col(f"a.{c}0"))) for c in "xy")
    inside = (F.col("b.x0") >= F.col("a.x0") - tx) & (F.col("b.x1") <= F.col("a.x1") + tx) & (F.col("b.y0") >= F.col("a.y0") - ty) & (F.col("b.y1") <= F.col("a.y1") + ty)
    ratio = containment(_box("b."), _box("a."))
    return a.join(b, F.expr("a.doc = b.doc and a.page = b.page and a.ord <> b.ord") & inside).select("a.doc", "a.page", F.col("a.ord").alias("outer"), F.col("b.ord").alias("inner"), F.bround(ratio, 4).alias("ratio")).filter(F.col("ratio") >= share)


def deduplicated(elements: DataFrame, share: float = 0.70) -> DataFrame:
    """Elements without those that two or more complete elements inside them repeat; taken out one after another, largest first, a removed one counts no more.

    A child is complete if it has over 30 characters and ends a sentence or has over 8 words. The order matters, so each page runs as one.
    """
    fields = elements.schema

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["y0", "x0", "ord"]).to_dict("records")
        alive = set(range(len(rows)))

        def complete(r):
            t = (r["text"] or "").strip()
            return len(t) > 30 and (t[-1] in ".!?;" or len(t.split()) > 8)

        for i in sorted(alive, key=lambda i: -(rows[i]["x1"] - rows[i]["x0"]) * (rows[i]["y1"] - rows[i]["y0"])):
            p, n = rows[i], 0
            for j in alive - {i}:
                c = rows[j]
                size = (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
                w, h = min(p["x1"], c["x1"]) - max(p["x0"], c["x0"]), min(p["y1"], c["y1"]) - max(p["y0"], c["y0"])
                if size > 0 and w > 0 and h > 0 and w * h / size >= share and size < (p["x1"] - p["x0"]) * (p["y1"] - p["y0"]) and complete(c):
                    n += 1
            if n >= 2:
                alive.discard(i)
        return pd.DataFrame([rows[i] for i in sorted(alive)], columns=pdf.columns)

    return elements.groupBy("doc", "page").applyInPandas(page, fields)


def bound_captions(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, ord, caption_id, caption): captions bound one to one to the regions of their page, region by region in order, nearest first.

    A caption fits where the boxes overlap horizontally by half the narrower one and lie no further apart than half the higher one
    (50 where both are flat). The fitting pairs are one join; only they reach the order-dependent choice, page by page.
    """
    r, c = regions.alias("r"), captions.alias("c")
    a, b = _box("r."), _box("c.")
    high = F.greatest(F.col("r.y1") - F.col("r.y0"), F.col("c.y1") - F.col("c.y0"))
    gap = vertical_gap(a, b)
    pairs = r.join(c, F.expr("r.doc = c.doc and r.page = c.page")).filter((overlap_ratio(a, b, "x") >= 0.5) & (gap <= F.when(high > 0, 0.5 * high).otherwise(50.0)))
    pairs = pairs.select("r.doc", "r.page", F.col("r.ord").alias("ord"), F.col("c.ord").alias("c_ord"), gap.alias("gap"), F.col("c.id").alias("caption_id"), F.coalesce("c.text", F.lit("")).alias("caption"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for o, own in pdf.sort_values(["ord", "gap", "c_ord"]).groupby("ord", sort=True):
            for row in own.itertuples(index=False):
                if row.caption_id not in taken:
                    taken.add(row.caption_id)
                    out.append((row.doc, row.page, o, row.caption_id, row.caption))
                    break
        return pd.DataFrame(out, columns=["doc", "page", "ord", "caption_id", "caption"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("doc", "page").applyInPandas(choose, f"doc {kinds['doc']}, page {kinds['page']}, ord {kinds['ord']}, caption_id {kinds['caption_id']}, caption string")


def split_figures(figures: DataFrame, page_height: str = "page_height") -> DataFrame:
    """(doc, page, i, j, kind, x0..y1 of both): figures of a page that are likely one, or one inside the other.

    nested_regions: 90 % of one lies in the other. possible_vertical_split: the second below the first, 60 % horizontal overlap, a gap
    up to the limit (4 % of the page, 12 at least) or an overlap up to half the lower one. possible_horizontal_split: the second right of
    it, 60 % vertical overlap, gap up to the limit. Pairs with different captions are figures of their own, and so are two stacked ones
    that both take 20 % of the page's height. ``figures`` may have caption_id and caption.
    """
    f = figures
    for c in ("caption_id", "caption"):
        if c not in f.columns:
            f = f.withColumn(c, F.lit(None).cast("string"))
    a, b = f.alias("a"), f.alias("b")
    x, y = _box("a."), _box("b.")
    p = F.col(f"a.{page_height}")
    limit = F.when(p > 0, F.greatest(F.lit(12.0), 0.04 * p)).otherwise(12.0)
    v, h = F.col("b.y0") - F.col("a.y1"), F.col("b.x0") - F.col("a.x1")
    low = F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0"))
    nested = (containment(x, y) >= 0.9) | (containment(y, x) >= 0.9)
    vertical = (overlap_ratio(x, y, "x") >= 0.6) & (v.between(F.lit(0), limit) | ((v < 0) & (v >= -0.5 * low)))
    horizontal = (overlap_ratio(x, y, "y") >= 0.6) & h.between(F.lit(0), limit)
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    other = lambda c: (text(f"a.{c}") != "") & (text(f"b.{c}") != "") & (text(f"a.{c}") != text(f"b.{c}"))
    apart = other("caption_id") | other("caption")
    whole = (p > 0) & (low >= 0.2 * p)
    kind = F.when(nested, "nested_regions").when(vertical, F.when(~apart & ~((v >= 0) & whole), "possible_vertical_split")).when(horizontal & ~apart, "possible_horizontal_split")
    m = merged(x, y)
    pairs = a.join(b, F.expr("a.doc = b.doc and a.page = b.page and a.ord < b.ord")).withColumn("kind", kind).filter("kind is not null")
    return pairs.select("a.doc", "a.page", F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), "kind", *[F.bround(m[c], 1).alias(c) for c in BOX])


def figure_elements(elements: DataFrame) -> DataFrame:
    """Figures among the elements (seals are none)."""
    return elements.filter(F.trim(F.lower("type")).isin(FIGURE_LABELS))


def figure_index(figures: DataFrame) -> DataFrame:
    """(doc, id, page, type, caption, confidence, filename): figures with ids made unique (a repeated one gets its page) and file names."""
    again = F.row_number().over(Window.partitionBy("doc", "id").orderBy("page", "ord")) > 1
    name = F.when(again, F.concat("id", F.lit("_p"), F.col("page").cast("string"))).otherwise(F.col("id"))
    return figures.select("doc", name.alias("id"), "page", "type", F.coalesce("caption", F.lit("")).alias("caption"), "confidence", F.concat(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.lit(".png")).alias("filename"))


def crop_boxes(figures: DataFrame, margin: float = 0.0, least: float = 8.0) -> DataFrame:
    """Figures with the whole-pixel box to cut out on a page of (page_width, page_height); boxes under ``least`` pixels are left out."""
    lo = lambda c: F.greatest(F.floor(F.col(c) - margin), F.lit(0))
    hi = lambda c, m: F.least(F.ceil(F.col(c) + margin), F.col(m).cast("bigint"))
    cut = figures.withColumns({"cx0": lo("x0"), "cy0": lo("y0"), "cx1": hi("x1", "page_width"), "cy1": hi("y1", "page_height")})
    return cut.filter((F.col("cx1") - F.col("cx0") >= least) & (F.col("cy1") - F.col("cy0") >= least))


def accepted_boxes(elements: DataFrame, labels: list[str]) -> DataFrame:
    """Boxes of the given types with an extent, with the id of their element and their order on the page."""
    order = Window.partitionBy("doc", "page").orderBy("ord")
    e = elements.filter(F.lower("type").isin(labels) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return e.select("doc", "page", F.col("id").alias("source_id"), F.lower("type").alias("type"), *BOX, F.row_number().over(order).alias("box_order"))


def assembled_documents(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per document: pages it has (of the file, not of the results), pages that worked, the failed ones and their errors in order of pages.

    ``sizes`` (doc, n_pages); ``pages`` (doc, page, error). A page without a result has failed with "missing".
    """
    every = sizes.filter("n_pages > 0").select("doc", "n_pages", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))
    r = every.join(pages.select("doc", "page", "error", F.lit(True).alias("_there")), ["doc", "page"], "left").withColumn("error", F.when(F.col("_there").isNull(), "missing").otherwise(F.col("error")))
    bad = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page", "error"))))
    return r.groupBy("doc").agg(F.max("n_pages").alias("total_pages"), F.count_if(F.col("error").isNull()).alias("pages_done"), bad.alias("_b")).select("doc", "total_pages", "pages_done", F.transform("_b", lambda x: x["page"]).alias("failed_pages"), F.transform("_b", lambda x: x["error"]).alias("errors"))


def body_pages(elements: DataFrame, least: int = 8, chars: int = 500) -> DataFrame:
    """(doc, page, n, chars) of pages that hold running text: enough body elements with enough characters."""
    e = elements.filter(F.lower("type").isin(BODY_LABELS))
    n = e.groupBy("doc", "page").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return n.filter((F.col("n") >= least) & (F.col("chars") >= chars))


def text_blocks(elements: DataFrame, limit: int = 120) -> DataFrame:
    """(doc, page, id, role, content, truncated): texts cut to a limit for display."""
    e = elements.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return e.select("doc", "page", "id", view_kind(F.col("type")).alias("role"), F.left("text", F.lit(limit)).alias("content"), (F.length("text") > limit).alias("truncated"))


def described(elements: DataFrame) -> DataFrame:
    """Elements with rounded width, height, area and centre."""
    return elements.select("*", derived(_box()).alias("d")).select(*elements.columns, "d.*")


def preprocessing(meta: DataFrame) -> DataFrame:
    """(doc, width, height, angle, deskewed): what was done to a page before layout; unknown sizes are those of the input, unknown angles 0."""
    return meta.select(
        "doc", F.coalesce("output_width", "input_width", F.lit(0)).alias("width"), F.coalesce("output_height", "input_height", F.lit(0)).alias("height"), F.coalesce("angle", F.lit(0.0)).alias("angle"), (F.coalesce("angle", F.lit(0.0)) % 360 != 0).alias("turned")
    )


def column_groups(starts: Column, tolerance: float = 10.0) -> Column:
    """Sorted coordinates drawn to column starts: a new one where a value lies more than the tolerance right of the last start."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(starts), empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(F.when(F.size(acc) == 0, F.array(x)).otherwise(acc), -1) > tolerance), F.concat(acc, F.array(x))).otherwise(acc))


def row_keys(ys: Column, tolerance: float = 5.0) -> Column:
    """Array of row keys in order of arrival: each y takes the first key within the tolerance, else becomes one. The key stays where its first y was."""
    empty = F.array().cast("array<double>")
    return F.aggregate(ys, empty, lambda keys, y: F.when(F.exists(keys, lambda k: F.abs(k - y) <= tolerance), keys).otherwise(F.concat(keys, F.array(y))))


def cell_texts(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, page, tbl, row, col, text): recognised texts whose centre lies in a cell's box (bx0, by0, bx1, by1), joined from top left."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = words.join(cells, ["doc", "page"]).filter(cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1")))
    found = inside.groupBy("doc", "page", "tbl", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ").alias("text"))
    return cells.select("doc", "page", "tbl", "row", "col").join(found, ["doc", "page", "tbl", "row", "col"], "left").fillna("", ["text"])


def cells_from_boxes(boxes: DataFrame) -> DataFrame:
    """Cell boxes (doc, page, tbl, n, x0..y1) with row and column: rows by keys of their top within 5 pixels in order of arrival, then from top; columns from left."""
    keys = boxes.groupBy("doc", "page", "tbl").agg(F.array_sort(row_keys(F.transform(F.array_sort(F.collect_list(F.struct("n", "y0"))), lambda x: x["y0"].cast("double")))).alias("keys"), F.transform(F.array_sort(F.collect_list(F.struct("n", "y0"))), lambda x: x["y0"].cast("double")).alias("ys"))
    arrived = keys.withColumn("arrival", row_keys(F.col("ys")))
    b = boxes.join(arrived.select("doc", "page", "tbl", "keys", "arrival"), ["doc", "page", "tbl"])
    mine = F.get(F.filter("arrival", lambda k: F.abs(k - F.col("y0")) <= 5.0), F.lit(0))
    b = b.withColumn("row", (F.array_position("keys", mine) - 1).cast("int"))
    return b.withColumn("col", F.row_number().over(Window.partitionBy("doc", "page", "tbl", "row").orderBy("x0", "n")) - 1).drop("keys", "arrival")


def near_components(boxes: DataFrame, key: list[str], gap: float = 12.0, members: int = 20, least_area: float = 9000.0) -> DataFrame:
    """(key, component, members, x0..y1): boxes joined where they lie closer than the gap on both axes; small ones are left out.

    ``boxes`` has n as its number within the key. Labels are the least number reached; each round takes the least label among
    the neighbours and the label of that label, so the rounds grow with the logarithm of the component's length. Near pairs come
    from an equi-join on grid cells as wide as the largest box of the key allows.
    """
    from ..session import cut

    size = boxes.groupBy(*key).agg((F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) + gap + 1).alias("_s"))
    b = boxes.join(size, key).select(*key, "n", *BOX, F.floor(F.col("x0") / F.col("_s")).alias("gx"), F.floor(F.col("y0") / F.col("_s")).alias("gy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = b.withColumn("s", F.explode(steps)).withColumns({"gx": F.col("gx") + F.col("s.i"), "gy": F.col("gy") + F.col("s.j")}).drop("s")
    o = b.select(*key, "gx", "gy", F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in BOX])
    dx = F.greatest(F.col("x0"), F.col("ox0")) - F.least(F.col("x1"), F.col("ox1"))
    dy = F.greatest(F.col("y0"), F.col("oy0")) - F.least(F.col("y1"), F.col("oy1"))
    edges = cut(around.join(o, [*key, "gx", "gy"]).filter((F.col("n") != F.col("m")) & (dx < gap) & (dy < gap)).select(*key, "n", "m"))
    labels = cut(boxes.select(*key, "n", F.col("n").alias("label")))
    while True:
        near = edges.join(labels.select(*key, F.col("n").alias("m"), F.col("label").alias("other")), [*key, "m"]).groupBy(*key, "n").agg(F.min("other").alias("other"))
        step = labels.join(near, [*key, "n"], "left").select(*key, "n", "label", F.least("label", F.coalesce("other", "label")).alias("new"))
        jump = step.join(labels.select(*key, F.col("n").alias("new"), F.col("label").alias("root")), [*key, "new"], "left")
        step = cut(jump.select(*key, "n", F.least("new", F.coalesce("root", "new")).alias("label"), (F.least("new", F.coalesce("root", "new")) < F.col("label")).alias("moved")))
        labels = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    out = boxes.join(labels, [*key, "n"]).groupBy(*key, F.col("label").alias("component")).agg(F.count("*").alias("members"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    return out.filter((F.col("members") >= members) & (area(_box()) >= least_area))


def block_differences(old: DataFrame, new: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, page, place, same_type, within): blocks of two runs paired by their place, and whether they lie within the tolerances (1 % of the width, 2.5 % of the height, extents 5 %)."""
    k = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord"))
    a = old.withColumn("place", k).select("doc", "page", "place", F.col("type").alias("ta"), *[F.col(c).alias(f"a{c}") for c in BOX])
    b = new.withColumn("place", k).select("doc", "page", "place", F.col("type").alias("tb"), *[F.col(c).alias(f"b{c}") for c in BOX])
    d = lambda c: F.abs(F.col(f"a{c}") - F.col(f"b{c}"))
    ext = lambda s, c: F.col(f"{s}{c}1") - F.col(f"{s}{c}0")
    near = (d("x0") <= 0.01 * width) & (d("y0") <= 0.025 * height) & (F.abs(ext("a", "x") - ext("b", "x")) <= 0.05 * ext("a", "x")) & (F.abs(ext("a", "y") - ext("b", "y")) <= 0.05 * ext("a", "y"))
    return a.join(b, ["doc", "page", "place"], "full").select("doc", "page", "place", F.coalesce(F.col("ta") == F.col("tb"), F.lit(False)).alias("same_type"), F.coalesce(near, F.lit(False)).alias("within"))
