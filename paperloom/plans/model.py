"""Relations of the document model as DataFrames, derived by rule from the stored tables, for queries of the operator library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def elements(spark: SparkSession, d: str) -> DataFrame:
    """One layout element per line of a document; types, boxes and confidences by rule."""
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    i = F.col("ord")
    kind = (
        F.when(i == 0, "doc_title").when(i % 9 == 8, "figure_caption").when(i % 5 == 3, "table").when(i % 7 == 5, "figure").when(i % 13 == 11, "formula")
        .when(i % 17 == 16, "seal").when(i % 11 == 10, "odd_label").otherwise("text")
    )
    rows = rows.withColumn("type", kind)
    x0, y0 = ((i % 3) * 40).cast("double"), (i * 20).cast("double")
    return rows.select(
        "doc", F.lit(1).alias("page"), "ord", F.concat(F.lit("e"), i.cast("string")).alias("id"), "type", x0.alias("x0"), y0.alias("y0"), (x0 + 20 + (6 * F.length("text")) % 300).alias("x1"),
        (y0 + F.when(F.col("type") == "figure", 100.0).otherwise(18.0)).alias("y1"), F.when((F.col("doc") + i) % 11 != 0, ((F.col("doc") * 7 + i * 13) % 100) / 100.0).alias("confidence"),
        F.when(F.col("type").isin("doc_title", "text"), i).alias("reading_order"), "text", F.lit(None).cast("string").alias("html"),
    )


#: The same relation for the twins.
ELEMENTS = r"""el AS (SELECT doc, 1 AS page, ord, 'e' || ord AS id, type, ((ord % 3) * 40)::DOUBLE AS x0, (ord * 20)::DOUBLE AS y0, ((ord % 3) * 40)::DOUBLE + 20 + (6 * length(text)) % 300 AS x1,
  (ord * 20)::DOUBLE + CASE WHEN type = 'figure' THEN 100 ELSE 18 END AS y1, CASE WHEN (doc + ord) % 11 <> 0 THEN ((doc * 7 + ord * 13) % 100)::DOUBLE / 100 END AS confidence,
  CASE WHEN type IN ('doc_title', 'text') THEN ord END AS reading_order, text
  FROM (SELECT *, CASE WHEN ord = 0 THEN 'doc_title' WHEN ord % 9 = 8 THEN 'figure_caption' WHEN ord % 5 = 3 THEN 'table' WHEN ord % 7 = 5 THEN 'figure' WHEN ord % 13 = 11 THEN 'formula'
    WHEN ord % 17 = 16 THEN 'seal' WHEN ord % 11 = 10 THEN 'odd_label' ELSE 'text' END AS type
    FROM (SELECT doc_id AS doc, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS ord, unnest(string_split(text, chr(10))) AS text FROM documents)))"""


def cells(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """Cells of one table per order: a header and quantity, price and discount of its lines, as the text layer has them (``layer``) and as recognised (``text``).

    With ``parts``, each order's lines are brought together in one of so many partitions first, so that nothing derived by order moves again.
    """
    li = load(spark, d, "lineitem")
    if parts:
        li = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount").repartition(parts, "l_orderkey")
        # always true; as no filter and no choice of columns is pushed below it, all that is derived reads one and the same exchange
        li = li.filter((F.monotonically_increasing_id() >= 0) | F.isnan(F.col("l_linenumber") + F.col("l_quantity") + F.col("l_extendedprice") + F.col("l_discount")))
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.round(F.min("l_extendedprice")).cast("bigint").alias("p"), F.round(F.min("l_discount") * 100).cast("int").alias("c"))
    long = li.select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("row"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(n).cast("string").alias("layer")) for i, n in enumerate("qpc")])).alias("x")).select("tbl", "row", "x.*")
    k = F.col("tbl") + F.col("row")
    read = F.when(k % 13 == 0, F.concat("layer", F.lit("7"))).when(k % 7 == 0, F.replace("layer", F.lit("0"), F.lit("O"))).otherwise(F.col("layer"))
    return long.withColumn("text", read)


CELLS = """li AS (SELECT l_orderkey AS tbl, l_linenumber AS row, min(l_quantity) AS q, min(l_extendedprice) AS p, min(l_discount) AS c FROM lineitem GROUP BY 1, 2), ce AS (SELECT tbl, row, col, layer, CASE WHEN (tbl + row) % 13 = 0 THEN layer || '7' WHEN (tbl + row) % 7 = 0 THEN replace(layer, '0', 'O') ELSE layer END AS text FROM (
  SELECT tbl, row, 0 AS col, CAST(CAST(q AS INT) AS VARCHAR) AS layer FROM li UNION ALL SELECT tbl, row, 1, CAST(CAST(round(p) AS BIGINT) AS VARCHAR) FROM li UNION ALL SELECT tbl, row, 2, CAST(CAST(round(c * 100) AS INT) AS VARCHAR) FROM li))"""

HEADERS = ["Qty", "Unit  Price", "Amount"]


def header_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same tables as grids with a header row, rows numbered by line."""
    c = cells(spark, d)
    head = c.select("tbl").distinct().select("tbl", F.lit(0).alias("row"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("text")) for i, h in enumerate(HEADERS)])).alias("x")).select("tbl", "row", "x.*")
    return head.unionByName(c.select("tbl", "row", "col", "text"))


def html(spark: SparkSession, d: str) -> DataFrame:
    """One HTML table per order with a head, a spanning title and its lines."""
    c = cells(spark, d).groupBy("tbl", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    tr = F.concat(F.lit("<tr><td>"), F.array_join(F.transform("c", lambda x: x["text"]), "</td><td>"), F.lit("</td></tr>"))
    body = c.select("tbl", "row", tr.alias("tr")).groupBy("tbl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: x["tr"]), "").alias("b"))
    return body.select("tbl", F.concat(F.lit("<html><table><thead><tr><th colspan='3'>Order</th></tr></thead>"), "b", F.lit("</table></html>")).alias("html"))


def placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, words, cells) with places: each order's table a grid of 100 x 20 points a cell, its layer's word in the middle of each cell."""
    # a line becomes three cells and three words, hence more and smaller partitions
    c = cells(spark, d, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumns({"doc": F.col("tbl"), "page": F.lit(1), "row": F.col("row") - 1})
    size = c.groupBy("doc", "page", "tbl").agg((F.max("row") + 1).alias("n_rows"))
    tables = size.select("doc", "page", "tbl", F.lit(40.0).alias("x0"), F.lit(80.0).alias("y0"), F.lit(640.0).alias("x1"), (80.0 + 40.0 * F.col("n_rows")).alias("y1"), "n_rows", F.lit(3).alias("n_cols"))
    x, y = 20.0 + 100.0 * F.col("col") + 20, 40.0 + 20.0 * F.col("row") + 5
    words = c.select("doc", "page", (F.col("row") * 3 + F.col("col")).alias("block"), F.lit(0).alias("line"), (F.col("row") * 3 + F.col("col")).alias("word_no"), x.alias("x0"), y.alias("y0"), (x + 5.0 * F.length("layer")).alias("x1"), (y + 10).alias("y1"), F.col("layer").alias("text"))
    return tables, words, c.select("doc", "page", "tbl", "row", "col", "text")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding per non-empty document: a quote from its text, changed by rule, a statement with or without its hedge, slots by rule."""
    t = load(spark, d, "documents").filter(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("doc"), "text")
    k = F.col("doc") % 6
    words = F.slice(F.filter(F.split("text", "[ \n\t\r\f]+"), lambda w: w != ""), 1, 30)
    plain = F.array_join(words, " ")
    quote = F.when(k == 1, F.array_join(words, "  ")).when(k == 2, F.concat(plain, F.lit(" zzz"))).when(k == 3, F.lit("never written anywhere in it")).when(k == 4, F.concat(plain, F.lit(" zz1 zz2 zz3 zz4"))).when(k == 5, F.lit("")).otherwise(plain)
    said = F.when(F.col("doc") % 4 == 0, F.concat(F.lit("may "), quote)).otherwise(quote)
    slot = lambda n: F.when(F.col("doc") % n == 0, F.lit(" ")).when(F.col("doc") % n == 1, F.lit("Not specified")).otherwise(F.lit("given"))
    return t.select(
        "doc", F.lit(1).cast("bigint").alias("ordinal"), said.alias("statement"), F.lit("result").alias("statement_type"), quote.alias("quote"), F.lit(None).cast("string").alias("quote_block"), F.lit(1).alias("page"),
        slot(17).alias("population"), slot(19).alias("intervention"), slot(23).alias("comparator"), F.lit("o").alias("outcome"), F.lit("f").alias("followup"),
    )


def grounding(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, text, trusted): documents as pages, every tenth not trusted."""
    return load(spark, d, "documents").filter(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text", (F.col("doc_id") % 10 != 9).alias("trusted"))


def kie(spark: SparkSession, d: str) -> DataFrame:
    """(task, document_type, fields map) of the results of distinct tasks, the greater result where they differ."""
    t = load(spark, d, "batch_tasks").filter("result is not null").groupBy("task_id").agg(F.max("result").alias("result"))
    return t.select(F.col("task_id").alias("task"), F.coalesce(F.get_json_object("result", "$.document_type"), F.lit("")).alias("document_type"), F.from_json(F.get_json_object("result", "$.kie_fields"), "map<string,string>").alias("fields"))


#: The same relation for the twins: task, document_type, and one text per field.
KIE = """ki AS (SELECT task_id AS task, coalesce(json_extract_string(result, '$.document_type'), '') AS document_type, json_extract_string(result, '$.kie_fields.invoice_number') AS invoice_number, json_extract_string(result, '$.kie_fields.invoice_date') AS invoice_date,
  json_extract_string(result, '$.kie_fields.seller_name') AS seller_name, json_extract_string(result, '$.kie_fields.buyer_name') AS buyer_name, json_extract_string(result, '$.kie_fields.total') AS total, json_extract(result, '$.kie_fields.items')::VARCHAR AS items,
  json_extract(result, '$.kie_fields')::VARCHAR AS fields FROM (SELECT task_id, max(result) AS result FROM batch_tasks WHERE result IS NOT NULL GROUP BY task_id))"""


def kie_rows(spark: SparkSession, d: str) -> DataFrame:
    """(task, document_type, field, value) of the plain fields."""
    names = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total"]
    k = kie(spark, d).filter("fields is not null")
    return k.select("task", "document_type", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.try_element_at("fields", F.lit(n)).alias("value")) for n in names])).alias("x")).select("task", "document_type", "x.*")
