"""Trust in text layers and cells: page verdicts, file types, routing, confidence of cells from recognition scores.

Defined results: pages without text are ``no_text``; files without pages are unsupported; tables without cells or entries, or whose
entries fit no frame, are not measured (null, never 0); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
INVISIBLE, COVERAGE, OVERLAY_INVISIBLE, OVERLAY_COVERAGE = 0.2, 0.5, 0.5, 0.8
HIT_SHARE, LOW = 0.8, 0.90


def page_signals(runs: DataFrame) -> DataFrame:
    """(doc, page, total, invisible, fonts, glyphless, cid_rate) of text runs (doc, page, font, chars, render_mode, to_unicode boolean).

    Invisible is render mode 3; cid_rate is the share of characters in fonts without a Unicode table, fonts compared without subset prefix and case.
    """
    base = F.lower(F.regexp_replace("font", r"^[A-Z]{6}\+", ""))
    r = runs.withColumn("base", base)
    mapped = r.groupBy("doc", "page", "base").agg(F.bool_or(F.coalesce("to_unicode", F.lit(False))).alias("mapped"))
    r = r.join(mapped, ["doc", "page", "base"])
    return r.groupBy("doc", "page").agg(
        F.sum("chars").alias("total"), F.sum(F.when(F.col("render_mode") == 3, F.col("chars")).otherwise(0)).alias("invisible"), F.countDistinct("base").alias("fonts"),
        F.bool_or(F.contains("base", F.lit("glyphless"))).alias("glyphless"), F.bround(F.coalesce(F.try_divide(F.sum(F.when(~F.col("mapped"), F.col("chars")).otherwise(0)), F.sum("chars")), F.lit(0.0)), 4).alias("cid_rate"),
    )


def page_verdict(total: Column, invisible: Column, coverage: Column) -> Column:
    """(verdict, confidence): no_text, text_layer (little hidden, little image), overlay (a scan with hidden text), else mixed."""
    share = F.try_divide(invisible, total)
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    out = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.bround(c, 4).alias("confidence"))
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, out("no_text", F.lit(1.0)))
        .when((share < INVISIBLE) & (coverage < COVERAGE), out("text_layer", clamp(1 - 0.5 * (share / INVISIBLE + coverage / COVERAGE), 0.6, 1.0)))
        .when((share >= OVERLAY_INVISIBLE) & (coverage >= OVERLAY_COVERAGE), out("overlay", F.lit(1.0)))
        .otherwise(out("mixed", clamp(0.5 * (share / OVERLAY_INVISIBLE + coverage / OVERLAY_COVERAGE), 0.0, 0.5)))
    )


def verdict_histogram(pages: DataFrame) -> DataFrame:
    """(doc, no_text, text_layer, overlay, mixed): pages of each verdict."""
    return pages.groupBy("doc").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("no_text", "text_layer", "overlay", "mixed")])


def trusted_pages(pages: DataFrame) -> DataFrame:
    """(doc, page) of pages whose text layer can be relied on."""
    return pages.filter("verdict = 'text_layer'").select("doc", "page")


def file_type(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, file_type): pdf_digital where every page is a text layer, else pdf_scan; image; unsupported. ``files`` has doc and extension."""
    digital = pages.groupBy("doc").agg(F.bool_and(F.col("verdict") == "text_layer").alias("digital"))
    e = F.lower(F.regexp_replace("extension", "^[.]", ""))
    return files.join(digital, "doc", "left").select("doc", F.when(e == "pdf", F.when(F.col("digital"), "pdf_digital").otherwise("pdf_scan")).when(e.isin("png", "jpg", "jpeg", "tiff", "tif"), "image").otherwise("unsupported").alias("file_type"))


def routed(types: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, file_type, document_type, route): the way a file takes by what it is and what it is about."""
    r = F.when(F.col("file_type") == "unsupported", "reject").when((F.col("file_type") == "pdf_digital") & F.col("document_type").isin("pico", "coi"), "text_first").when(F.col("file_type") == "pdf_digital", "text_layer").otherwise("recognition")
    return types.join(classes.select("doc", "document_type"), "doc", "left").withColumn("document_type", F.coalesce("document_type", F.lit("auto"))).withColumn("route", r)


def first_cells(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Entries (tbl, ordinal, cx, cy, score) with the first cell (tbl, cell, x0..y1) whose box holds their centre; null for none."""
    hit = entries.join(cells, "tbl").filter(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))).groupBy("tbl", "ordinal").agg(F.min("cell").alias("cell"))
    return entries.join(hit, ["tbl", "ordinal"], "left")


def cell_confidence(entries: DataFrame, cells: DataFrame, heights: DataFrame) -> DataFrame:
    """(tbl, cell, confidence, status): the least score of the entries (tbl, ordinal, x0..y1, score) in each cell.

    Entries may stand in a frame turned upside down: it is taken only where it hits more cells; ``heights`` (tbl, height) tells where to
    turn. Tables without cells, entries or a frame that fits HIT_SHARE of the entries have no measured cell.
    """
    e = entries.select("tbl", "ordinal", "score", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")).join(heights, "tbl", "left")
    frames = F.array(F.struct(F.lit(1).alias("raw"), F.col("cy").alias("cy")), F.struct(F.lit(0).alias("raw"), (F.col("height") - F.col("cy")).alias("cy")))
    both = e.select("tbl", "ordinal", "score", "cx", F.explode(frames).alias("f")).select("tbl", F.concat_ws("|", "f.raw", "ordinal").alias("ordinal"), "score", "cx", F.col("f.cy").alias("cy"), F.col("f.raw").alias("raw")).filter("cy is not null")
    placed = first_cells(both, cells)
    hits = placed.groupBy("tbl", "raw").agg(F.count("cell").alias("hits"), F.count("*").alias("n"))
    frame = hits.groupBy("tbl").agg(F.max_by(F.struct("raw", "hits", "n"), F.struct("hits", "raw")).alias("b")).select("tbl", "b.*").withColumn("fits", F.col("hits") >= HIT_SHARE * F.col("n"))
    score = placed.join(frame.filter("fits").select("tbl", "raw"), ["tbl", "raw"]).filter("cell is not null").groupBy("tbl", "cell").agg(F.bround(F.min("score"), 6).alias("confidence"))
    state = cells.select("tbl").distinct().join(frame, "tbl", "left").select("tbl", F.when(F.col("fits").isNull(), "no_entries").when(~F.col("fits"), "frame_unresolved").when(F.col("raw") == 1, "raw").otherwise("flip").alias("status"))
    return cells.select("tbl", "cell").join(score, ["tbl", "cell"], "left").join(state, "tbl")


def confidence_summary(measured: DataFrame) -> DataFrame:
    """Per table: cells measured, not measured, and below the low mark."""
    return measured.groupBy("tbl").agg(F.count("confidence").alias("measured"), F.count_if(F.col("confidence").isNull()).alias("unmeasured"), F.count_if(F.col("confidence") < LOW).alias("low"))


def attached(tables: DataFrame, elements: DataFrame) -> DataFrame:
    """Tables with the confidence payload of the layout element of their id; null where it has none."""
    return tables.join(elements.select("doc", "id", "cell_confidence"), ["doc", "id"], "left")


def proof_report(cells: DataFrame, most: int = 20, whole: bool = False) -> DataFrame:
    """Counts by provenance and measure of (doc, tbl, provenance, confidence), per table, per document (tbl null) and over all (both null); ``whole``: only over all."""
    p = F.col("provenance")
    counts = {"cells": F.count("*"), **{v: F.count_if(p == v) for v in ("vision", "text_confirmed", "text_backfilled", "text_mismatch")}, "low": F.count_if(F.col("confidence") < LOW), "unmeasured": F.count_if(F.col("confidence").isNull())}
    own = [c.alias(n) for n, c in counts.items()]
    if whole:
        out = cells.agg(*own).filter("cells > 0").select(*[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in ("doc", "tbl")], *counts)
    else:  # counted by table first, so that only tables are repeated for each level
        out = cells.groupBy("doc", "tbl").agg(*own).rollup("doc", "tbl").agg(*[F.sum(n).alias(n) for n in counts])
    return out.withColumn("coverage", F.bround(F.try_divide(F.col("text_confirmed") + F.col("text_backfilled"), F.col("cells") - F.col("vision")), 4))


def annotation(cells: DataFrame) -> DataFrame:
    """Cells with the mark a reviewer sees: green and amber are drawn at the words' box, else the grid's; red is only counted."""
    mark = F.when(F.col("provenance") == "text_confirmed", "green").when(F.col("provenance") == "text_backfilled", "amber").when(F.col("provenance") == "text_mismatch", "red")
    out = cells.withColumn("mark", mark)
    at = F.coalesce("word_bbox", "grid_bbox")
    return out.withColumns({"at": F.when(F.col("mark").isin("green", "amber"), at), "drawn": F.col("mark").isin("green", "amber") & at.isNotNull()})


def annotation_summary(pages: DataFrame) -> DataFrame:
    """(doc, annotated, skipped, reason): pages drawn on, pages left out, and why the document has none where it has none."""
    first = F.min_by(F.col("skip_reason"), F.when(F.col("skip_reason").isNotNull(), F.col("page")))
    n = F.count_if(F.col("skip_reason").isNull())
    return pages.groupBy("doc").agg(n.alias("annotated"), F.count("skip_reason").alias("skipped"), F.when(n == 0, first).alias("reason"))


def page_count(found: Column, *others: Column) -> Column:
    """The number of pages of a document: the first of the sources that is above 0, else 1."""
    return F.coalesce(*[F.when(c > 0, c) for c in (found, *others)], F.lit(1))
