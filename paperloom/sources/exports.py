"""Exports: tables as CSV lines, structured JSON, Markdown, workbooks, zip packs, reports.

What goes into a file is a DataFrame of lines or parts with their order; writing is one step at the end, per document, on the
driver only for formats that have no distributed writer (xlsx, docx, zip). Those are bounded by ``MOST_ROWS`` and refuse more.

Defined results: null cells are empty; tables without rows give their title alone; names are safe as file and sheet names.
"""

from __future__ import annotations

import io
import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import cell_cut, csv_quoted, file_stem, html_escaped, percent, sheet_name, spreadsheet_safe, table_banner, table_title

PACK_BYTES, MOST_ROWS = 256 * 1024 * 1024, 1_000_000
PACK_PARTS = ["json", "csv", "xlsx", "markdown", "figures"]
LOW_MARK = 0.95


def _rows(cells: DataFrame, key: list[str], cell: Column, sep: str) -> DataFrame:
    one = cells.groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))).alias("c"))
    return one.select(*key, "row", F.array_join(F.transform("c", lambda x: x["t"]), sep).alias("line"))


def table_number(tables: DataFrame) -> DataFrame:
    """Tables (doc, tbl, page, confidence, score, caption) with their number in the document and their confidence in percent."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("page", "tbl"))
    score = F.col("score") if "score" in tables.columns else None
    return tables.withColumns({"number": n, "pct": percent(F.col("confidence"), score)})


def csv_lines(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, place, line): all tables of a document as one CSV: banner, caption where there is one, rows, an empty line between tables."""
    t = table_number(tables)
    head = t.select("doc", "number", F.lit(0).alias("part"), F.lit(0).alias("row"), csv_quoted(spreadsheet_safe(table_banner(F.col("number"), F.col("page"), F.col("pct")))).alias("line"))
    caption = t.filter(F.trim(F.coalesce("caption", F.lit(""))) != "").select("doc", "number", F.lit(1).alias("part"), F.lit(0).alias("row"), csv_quoted(spreadsheet_safe(F.trim("caption"))).alias("line"))
    body = _rows(cells.join(t.select("doc", "tbl", "number"), ["doc", "tbl"]), ["doc", "number"], csv_quoted(spreadsheet_safe(F.col("text"))), ",").select("doc", "number", F.lit(2).alias("part"), "row", "line")
    gap = t.select("doc", "number", F.lit(3).alias("part"), F.lit(0).alias("row"), F.lit("").alias("line"))
    every = head.unionByName(caption).unionByName(body).unionByName(gap)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("number", "part", "row"))).select("doc", "place", "line")


def csv_files(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, file, row, line): each table as a CSV of its own, named by number and page."""
    t = table_number(tables).withColumn("file", F.format_string("table_%02d_p%s.csv", "number", F.coalesce(F.col("page").cast("string"), F.lit("?"))))
    return _rows(cells.join(t.select("doc", "tbl", "file"), ["doc", "tbl"]), ["doc", "file"], csv_quoted(spreadsheet_safe(F.col("text"))), ",")


def structured_tables(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, tbl, json): tables as objects with rowCount, columnCount, cells of rowIndex, columnIndex, kind and content, caption and page."""
    c = cells.groupBy("doc", "tbl").agg(
        (F.max("row") + 1).alias("rowCount"), (F.max("col") + 1).alias("columnCount"),
        F.array_sort(F.collect_list(F.struct(F.col("row").alias("rowIndex"), F.col("col").alias("columnIndex"), F.when(F.col("row") == 0, "columnHeader").otherwise("content").alias("kind"), F.coalesce("text", F.lit("")).alias("content")))).alias("cells"),
    )
    return tables.join(c, ["doc", "tbl"]).select("doc", "tbl", F.to_json(F.struct("rowCount", "columnCount", "cells", "caption", F.col("page").alias("pageNumber"))).alias("json"))


def markdown(blocks: DataFrame, tables: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(doc, text): pages with their titles and paragraphs in order, texts below the mark flagged, then the tables as pipe tables filled to their width."""
    kind = F.lower(F.coalesce("type", F.lit("text")))
    flag = F.when(F.col("confidence") < LOW_MARK, F.format_string(" _(confidence %d%%)_", percent(F.col("confidence")))).otherwise("")
    body = F.when(kind.isin("doc_title", "title"), F.concat(F.lit("## "), "text")).when(kind.like("%title"), F.concat(F.lit("### "), "text")).otherwise(F.concat("text", flag))
    lines = blocks.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc", "page", F.lit(1).alias("part"), F.col("ord").cast("bigint").alias("n"), body.alias("line"))
    pages = blocks.select("doc", "page").distinct().select("doc", "page", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("n"), F.format_string("# Page %d", F.col("page")).alias("line"))
    every = pages.unionByName(lines)
    if tables is not None and cells is not None:
        t = table_number(tables)
        plain = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        rows = cells.groupBy("doc", "tbl", "row").agg(F.array_sort(F.collect_list(F.struct("col", plain.alias("t")))).alias("c"))
        wide = cells.groupBy("doc", "tbl").agg((F.max("col") + 1).alias("w"))
        full = rows.join(wide, ["doc", "tbl"]).withColumn("v", F.slice(F.concat(F.transform("c", lambda x: x["t"]), F.array_repeat(F.lit(""), F.col("w"))), F.lit(1), F.col("w")))
        text = F.concat(F.lit("| "), F.array_join("v", " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("w")))
        table = full.select("doc", "tbl", "row", F.when(F.col("row") == 0, F.concat(text, rule)).otherwise(text).alias("l")).groupBy("doc", "tbl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "l"))), lambda x: x["l"]), "\n").alias("l"))
        titled = t.join(table, ["doc", "tbl"], "left").select("doc", F.coalesce("page", F.lit(1)).alias("page"), F.lit(2).alias("part"), F.col("number").cast("bigint").alias("n"), F.concat_ws("\n\n", F.concat(F.lit("**"), table_title(F.col("number"), F.col("page"), F.col("pct"), F.col("caption")), F.lit("**")), "l").alias("line"))
        every = every.unionByName(titled)
    return every.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part", "n", "line"))), lambda x: x["line"]), "\n\n").alias("text"))


def include_set(spec: Column) -> Column:
    """(parts, unknown) of a list such as "json, csv": all parts for none."""
    asked = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(spec, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != ""))
    every = F.array(*map(F.lit, PACK_PARTS))
    return F.struct(F.when(F.size(asked) == 0, every).otherwise(F.array_intersect(every, asked)).alias("parts"), F.array_except(asked, every).alias("unknown"))


def pack_manifest(files: DataFrame, limit: int = PACK_BYTES) -> DataFrame:
    """Files (doc, name, bytes) with their running size in order of name, and whether the pack of their document is too large."""
    run = F.sum("bytes").over(Window.partitionBy("doc").orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("bytes").over(Window.partitionBy("doc"))
    return files.withColumns({"running": run, "fits": run <= limit, "too_large": all_ > limit})


def report_html(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, html): a table per key with one line per row, in order of the columns; texts escaped, long ones cut."""
    tr = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escaped(cell_cut(F.col(c).cast("string"))), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + "</tr>"
    return rows.select(key, tr.alias("_t"), F.struct(*columns).alias("_o")).groupBy(key).agg(F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), ""), F.lit("</table>")).alias("html"))


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for one file: write the lines with a distributed writer")
    return rows


def write_lines(lines: DataFrame, folder: str, key: str = "doc") -> None:
    """Lines (key, place, line) as one text file per key under ``folder``: a distributed write, each key in one task in order of place."""
    lines.repartition(key).sortWithinPartitions(key, "place").select(key, "line").write.mode("overwrite").partitionBy(key).text(folder)


def write_csv_with_mark(lines: list[str], path: str) -> None:
    """Lines as a CSV file that spreadsheets read as UTF-8."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook (xlsx) of sheets of rows. Sheet names are made safe and unlike each other; texts that read like formulas stay texts."""
    def column(n):
        out = ""
        while True:
            n, r = divmod(n, 26)
            out = chr(65 + r) + out
            if not n:
                return out
            n -= 1

    names: list[str] = []
    for raw in sheets:
        base = "".join("_" if c in "[]:*?/\\" else c for c in raw).strip()[:31] or "Sheet"
        name, k = base, 1
        while name.lower() in [x.lower() for x in names]:
            k += 1
            name = f"{base[: 31 - len(str(k)) - 1]}_{k}"
        names.append(name)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = range(1, len(names) + 1)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, x in zip(n, names)) + "</sheets></workbook>")
        for i, rows in zip(n, sheets.values()):
            body = []
            for r, row in enumerate(rows, 1):
                cells = "".join(f'<c r="{column(c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c r="{column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row) if v is not None)
                body.append(f'<row r="{r}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def table_workbook(tables: DataFrame, cells: DataFrame) -> bytes:
    """A workbook of one document: a summary and a sheet per table, title in the first row, rows filled or cut to the header's width."""
    listed = sorted(_bounded(table_number(tables).select("tbl", "number", "page", "pct", "caption", table_title(F.col("number"), F.col("page"), F.col("pct"), F.col("caption")).alias("title"))), key=lambda r: r["number"])
    rows: dict = {}
    for r in _bounded(cells.select("tbl", "row", "col", spreadsheet_safe(F.col("text")).alias("text"))):
        rows.setdefault(r["tbl"], {}).setdefault(r["row"], {})[r["col"]] = r["text"]
    sheets = {"Summary": [["Table", "Page", "Confidence", "Caption"], *[[r["number"], r["page"], r["pct"], r["caption"]] for r in listed]]}
    for r in listed:
        own = rows.get(r["tbl"], {})
        wide = max(own.get(min(own), {0: ""}), default=0) + 1 if own else 0
        sheets[f"Table_{r['number']}"] = [[r["title"]], *[[own[k].get(c, "") for c in range(wide)] for k in sorted(own)]]
    return workbook(sheets)


def document(paragraphs: list[tuple[str, str]]) -> bytes:
    """A word-processor document (docx) of (style, text) paragraphs; styles Heading1 to Heading3 and Normal."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    pack = "http://schemas.openxmlformats.org/package/2006"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(s)}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def zip_pack(files: dict[str, bytes], missing: list[str] | None = None, limit: int = PACK_BYTES) -> bytes:
    """A zip of files with a manifest; refused where their sizes pass the limit. Names are confined to the pack."""
    import json

    total = 0
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            total += len(files[name])
            if total > limit:
                raise ValueError(f"pack is larger than {limit} bytes")
            if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/"):
                raise ValueError(f"{name} leads out of the pack")
            z.writestr(name, files[name])
        z.writestr("manifest.json", json.dumps({"files": [{"name": n, "bytes": len(files[n])} for n in sorted(files)], "missing": missing or []}))
    return out.getvalue()


def copied_entries(pack: bytes, prefix: str) -> dict[str, bytes]:
    """Entries of a zip below a prefix."""
    with zipfile.ZipFile(io.BytesIO(pack)) as z:
        return {n: z.read(n) for n in z.namelist() if n.startswith(prefix) and not n.endswith("/")}


def confined(folder: str, name: str) -> str:
    """The path of a file inside a folder; a name that leads out of it is an error."""
    path = os.path.realpath(os.path.join(folder, name))
    if os.path.commonpath([os.path.realpath(folder), path]) != os.path.realpath(folder):
        raise ValueError(f"{name} leads out of {folder}")
    return path


__all__ = ["csv_files", "csv_lines", "file_stem", "markdown", "sheet_name", "structured_tables"]
