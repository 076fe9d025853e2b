"""Relations of the document model derived from the stored tables, and the helper that runs SQL over them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ..session import load

TABLES = ("documents", "lineitem", "orders", "customer", "part", "nation", "region", "supplier", "events", "task_events", "batch_tasks", "batch_jobs", "hitl_reviews", "eval_items", "subject_labels", "address_values", "envelopes", "parties")

#: Blocks: one per line of a document, with type, box and confidence by rule.
BLOCKS_SPARK = r"""blocks AS (SELECT doc, idx, text, CASE WHEN idx = 0 THEN 'title' WHEN idx % 9 = 8 THEN 'figure_title' WHEN idx % 5 = 3 THEN 'table' ELSE 'text' END AS type,
  0.0D AS x0, 20.0D * idx AS y0, 6.0D * length(text) AS x1, 20.0D * idx + 18 AS y1, CASE WHEN (doc + idx) % 11 = 0 THEN NULL ELSE ((doc * 7 + idx * 13) % 100) / 100.0D END AS confidence
  FROM (SELECT doc_id AS doc, t.idx, t.text FROM documents LATERAL VIEW posexplode(split(documents.text, '\n')) t AS idx, text))"""
BLOCKS_DUCK = r"""blocks AS (SELECT doc, idx, text, CASE WHEN idx = 0 THEN 'title' WHEN idx % 9 = 8 THEN 'figure_title' WHEN idx % 5 = 3 THEN 'table' ELSE 'text' END AS type,
  0.0::DOUBLE AS x0, 20.0::DOUBLE * idx AS y0, 6.0::DOUBLE * length(text) AS x1, 20.0::DOUBLE * idx + 18 AS y1, CASE WHEN (doc + idx) % 11 = 0 THEN NULL ELSE ((doc * 7 + idx * 13) % 100)::DOUBLE / 100 END AS confidence
  FROM (SELECT doc_id AS doc, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS idx, unnest(string_split(text, chr(10))) AS text FROM documents))"""
#: Words of the blocks with boxes from their character offsets.
WORDS_SPARK = BLOCKS_SPARK + r""", words AS (SELECT doc, line, word_no, text, 6.0D * before AS x0, 6.0D * (before + length(text)) AS x1, y0, y0 + 10 AS y1
  FROM (SELECT doc, idx AS line, pos AS word_no, w AS text, y0, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc, idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT doc, idx, y0, split(text, ' ') AS ws FROM blocks WHERE text <> '') LATERAL VIEW posexplode(ws) t AS pos, w) WHERE text <> '')"""
WORDS_DUCK = BLOCKS_DUCK + r""", words AS (SELECT doc, idx AS line, pos AS word_no, w AS text, 6.0::DOUBLE * (length(array_to_string(ws[1:pos], ' ')) + CASE WHEN pos > 0 THEN 1 ELSE 0 END) AS x0,
  6.0::DOUBLE * (length(array_to_string(ws[1:pos], ' ')) + CASE WHEN pos > 0 THEN 1 ELSE 0 END + length(w)) AS x1, y0, y0 + 10 AS y1
  FROM (SELECT doc, idx, y0, string_split(text, ' ') AS ws, (unnest(range(len(string_split(text, ' ')))))::INTEGER AS pos, unnest(string_split(text, ' ')) AS w FROM blocks WHERE text <> '') WHERE w <> '')"""
#: Table cells: quantity, price and discount of a line item as text, with a misread twin by rule.
CELLS = r"""cells AS (SELECT tbl, row_no, col_no, layer, CASE WHEN (tbl + row_no) % 13 = 0 THEN concat(layer, '7') WHEN (tbl + row_no) % 7 = 0 THEN replace(layer, '0', 'O') ELSE layer END AS ocr FROM (
  SELECT l_orderkey AS tbl, l_linenumber AS row_no, 0 AS col_no, CAST(CAST(l_quantity AS INT) AS {S}) AS layer FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 1, CAST(CAST(round(l_extendedprice) AS BIGINT) AS {S}) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2, CAST(CAST(round(l_discount * 100) AS INT) AS {S}) FROM lineitem))"""
CELLS_SPARK, CELLS_DUCK = CELLS.replace("{S}", "STRING"), CELLS.replace("{S}", "VARCHAR")


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """SQL over the tables of a folder; only the tables it names behind FROM or JOIN are opened, under names no other query uses."""
    mark = hashlib.sha256(folder.encode()).hexdigest()[:12]
    for t in TABLES:
        named = re.compile(rf"(\bFROM\s+|\bJOIN\s+){t}\b")
        if named.search(sql):
            load(spark, folder, t).createOrReplaceTempView(f"paperloom_{mark}_{t}")
            sql = re.sub(rf"(?<![\w.]){t}\.", f"{t}_.", sql)
            sql = named.sub(rf"\1paperloom_{mark}_{t} {t}_ ", sql) if re.search(rf"(?<![\w]){t}_\.", sql) else named.sub(rf"\1paperloom_{mark}_{t}", sql)
    return spark.sql(sql)
