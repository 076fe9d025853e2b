"""Engines and files: pluggable extraction engines as batch sources, page enumeration, configuration.

An engine is a callable that turns one page or file into rows; it runs in Arrow batches, once built per worker, and never fails a
task: what it raises becomes the ``error`` of its row. Engines for layout, recognition, tables, fields, formulas and seals register
under a kind and a name.

Defined results: unreadable PDFs have 0 pages and images 1; null content gives no rows; an unknown engine is an error at planning.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("layout", "recognition", "table", "fields", "formula", "seal", "raster", "text_layer")
_ENGINES: dict[tuple[str, str], tuple[Callable[[], Callable], str]] = {}


def register(kind: str, name: str, factory: Callable[[], Callable], schema: str) -> None:
    """An engine: ``factory()`` gives a callable from a row (dict) to a list of tuples of ``schema``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of engine {kind}, one of {KINDS}")
    _ENGINES[kind, name] = (factory, schema)


def engines(kind: str | None = None) -> list[tuple[str, str]]:
    """Registered engines."""
    return sorted(k for k in _ENGINES if kind in (None, k[0]))


def extracted(df: DataFrame, kind: str, name: str, key: list[str]) -> DataFrame:
    """Rows of an engine over every row of ``df``: key, the engine's columns, error."""
    if (kind, name) not in _ENGINES:
        raise KeyError(f"no {kind} engine {name}; there are {engines(kind)}")
    factory, schema = _ENGINES[kind, name]
    kinds = dict(df.dtypes)
    wide = len(df.sparkSession.createDataFrame([], schema).columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = factory()
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k = tuple(row[c] for c in key)
                try:
                    out += [(*k, *r, None) for r in run(row)]
                except Exception as e:  # noqa: BLE001  the row carries its error, the task goes on
                    out.append((*k, *[None] * wide, f"{type(e).__name__}: {e}"[:400]))
            yield pd.DataFrame(out, columns=[*key, *[f"c{i}" for i in range(wide)], "error"])

    names = df.sparkSession.createDataFrame([], schema).dtypes
    out = df.mapInPandas(rows, ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(names)) + ", error string")
    return out.select(*key, *[F.col(f"c{i}").alias(n) for i, (n, _) in enumerate(names)], "error")


def retried(df: DataFrame, kind: str, first: str, second: str, key: list[str]) -> DataFrame:
    """Rows of one engine, and of a second one for the keys where the first failed or found nothing."""
    a = extracted(df, kind, first, key)
    good = a.filter("error is null")
    rest = df.join(good.select(*key).distinct(), key, "left_anti")
    return good.unionByName(extracted(rest, kind, second, key))


def pdf_pages(content: bytes | None) -> int:
    """Number of pages of a PDF by its page objects, also those in compressed object streams; 0 where it cannot be read."""
    if not content or b"%PDF" not in content[:1024]:
        return 0
    n = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", content))
    for m in re.finditer(rb"/Type\s*/ObjStm.*?stream\r?\n", content, re.S):
        try:
            n += len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", zlib.decompressobj().decompress(content[m.end() :])))
        except zlib.error:
            continue
    return n


def pdf_metadata(content: bytes | None) -> dict[str, str]:
    """The seven entries of a PDF's information as text ('' where missing) and its page count."""
    names = ["Title", "Author", "Subject", "Creator", "Producer", "CreationDate", "ModDate"]
    out = {}
    for n in names:
        m = re.search(rb"/" + n.encode() + rb"\s*\(((?:\\.|[^\\()])*)\)", content or b"", re.S)
        out[n] = re.sub(r"\\([()\\])", r"\1", m[1].decode("latin-1")) if m else ""
    return out | {"page_count": str(pdf_pages(content))}


def page_numbers(files: DataFrame) -> DataFrame:
    """(path, page) of files (path, content): every page of a PDF, one of an image."""
    count = F.pandas_udf(lambda s: s.map(pdf_pages), "int")
    pdf = F.lower("path").endswith(".pdf")
    n = F.when(pdf, count("content")).when(F.lower("path").rlike(r"\.(png|jpe?g|tiff?)$"), 1).otherwise(0)
    return files.select("path", n.alias("n")).filter("n > 0").select("path", F.explode(F.sequence(F.lit(1), "n")).alias("page"))


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, metadata) of PDF files (path, content)."""
    read = F.pandas_udf(lambda s: s.map(pdf_metadata), "map<string,string>")
    return files.select("path", read("content").alias("metadata"))


def page_selection(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, position, page): pages of a split or merged file in the order asked for (path, position, page); pages there are not are left out."""
    return wanted.join(pages, ["path", "page"], "left_semi").select("path", "position", "page")


def image_metadata(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256, matrix): size and hash of page images with the identity matrix they start from."""
    return files.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("matrix"))


def uploads_refused(files: DataFrame, extensions: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "tiff", "tif"), most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """(path, reason) of files a single upload is refused for: extension, too_large."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.select("path", F.when(~ext.isin(*extensions), "extension").when(F.col("length") > most_bytes, "too_large").alias("reason")).filter("reason is not null")


def contract_errors(results: DataFrame) -> DataFrame:
    """(doc, error) of results (doc, result JSON) that lack what reports need: not_json, no_tables, no_table_backfill."""
    has = lambda p: F.get_json_object("result", p).isNotNull()
    e = F.when(F.try_parse_json("result").isNull(), "not_json").when(~has("$.tables"), "no_tables").when(~has("$.quality.table_backfill"), "no_table_backfill")
    return results.select("doc", e.alias("error")).filter("error is not null")


def bound_findings(lines: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(findings, refused) of JSON lines (value): records of this schema version, and all others."""
    v = F.get_json_object("value", "$.schema_version")
    ok = F.coalesce((F.try_parse_json("value").isNotNull()) & (v == version), F.lit(False))
    return lines.filter(ok), lines.filter(~ok)


def configuration(spark: SparkSession, folder: str) -> DataFrame:
    """(id, key, value) of the configuration files (JSON, and YAML where its package is there) of a folder; ids are safe names, later files win."""
    out: dict[tuple[str, str], str] = {}
    for name in sorted(os.listdir(folder)):
        stem, ext = os.path.splitext(name)
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        if ext == ".json":
            value = json.loads(text)
        elif ext in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError:
                continue
            value = yaml.safe_load(text)
        else:
            continue
        id = re.sub(r"[^A-Za-z0-9_-]", "_", stem)
        out |= {(id, str(k)): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (value or {}).items()}
    return spark.createDataFrame([(i, k, v) for (i, k), v in sorted(out.items())], "id string, key string, value string")


def save_template(folder: str, name: str, template: dict) -> str:
    """A template as a JSON file under a safe name; the name it got."""
    safe = re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "template"
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{safe}.json"), "w", encoding="utf-8") as f:
        json.dump(template, f, ensure_ascii=False, indent=1, sort_keys=True)
    return safe
