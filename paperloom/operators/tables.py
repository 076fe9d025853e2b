"""Tables: HTML into cells, headers, captions, column mapping, projection of scores onto spans.

Cells are long rows (table keys, row, col, text), so that everything but the reading of HTML is an ordinary join or aggregate.

Defined results: null or tag-free HTML gives no cells; malformed spans count as 1; a table of fewer than two columns gives no
cells; rows of blank cells are left out and the others move up; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_COLUMNS, LEAST_COLUMNS, CELL_LENGTH, CELL_LEAST, PROBED_ROWS, SHORT = 20, 2, 500, 400, 3, 20

# Aliases of table headers by template and field.
TEMPLATES = {
    "bank_statement": {
        "transaction_date": ["date", "transaction date", "posting date", "value date", "txn date"],
        "description": ["description", "memo", "narration", "details", "payee", "merchant"],
        "amount": ["amount", "debit", "credit", "withdrawal", "deposit"],
        "balance": ["balance", "running balance", "available balance"],
    },
    "invoice_line_items": {
        "line_description": ["description", "item", "product", "service", "line description", "name"],
        "quantity": ["qty", "quantity", "units", "count"],
        "unit_price": ["unit price", "price", "rate", "unit cost"],
        "line_total": ["amount", "line total", "total", "extended price", "subtotal"],
    },
}
POSITIONAL = {"bank_statement"}


class _Reader(HTMLParser):
    """Rows of the first table: (inside thead, [(text, rowspan, colspan, th)]). Tables inside cells are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[bool, list[list]]] = []
        self.depth, self.done, self.head, self.cell = 0, False, False, None

    def _span(self, attrs, name):
        value = dict(attrs).get(name) or "1"
        return max(1, int(value)) if value.strip().isdigit() else 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += not self.done
        elif self.depth == 1 and not self.done:
            if tag == "thead":
                self.head = True
            elif tag == "tr":
                self.cell = None
                self.rows.append((self.head, []))
            elif tag in ("td", "th"):
                if not self.rows:
                    self.rows.append((self.head, []))
                self.cell = ["", self._span(attrs, "rowspan"), self._span(attrs, "colspan"), tag == "th"]
                self.rows[-1][1].append(self.cell)
            elif self.cell is not None:
                self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or self.depth == 0
        elif self.depth == 1:
            if tag == "thead":
                self.head = False
            elif tag in ("td", "th", "tr"):
                self.cell = None

    def handle_data(self, data):
        if self.depth == 1 and self.cell is not None and not self.done:
            self.cell[0] += data


def _cut(text: str) -> str:
    if len(text) <= CELL_LENGTH:
        return text
    head = text[:CELL_LENGTH]
    for sign, more in ((".", 1), (" ", 0)):
        at = head.rfind(sign)
        if at >= CELL_LEAST:
            return head[: at + more]
    return head


def parsed_table(html: str | None) -> list[tuple]:
    """(ordinal, row, col, rowspan, colspan, text, is_header) of the cells of the first table, at their places in the grid."""
    if not html or "<" not in html:
        return []
    reader = _Reader()
    reader.feed(html)
    rows = [(head, cells) for head, cells in reader.rows]
    wide = max((sum(c[2] for c in cells) for _, cells in rows), default=0)
    if wide < LEAST_COLUMNS:
        return []
    texts = [[" ".join(c[0].split()) for c in cells] for _, cells in rows]
    heads = {i for i, (head, _) in enumerate(rows) if head}
    if not heads:
        for i, own in enumerate(texts[:PROBED_ROWS]):
            if own and any(len(t) > SHORT for t in own):
                break
            if own:
                heads.add(i)
    taken: set[tuple[int, int]] = set()
    out, line, ordinal = [], 0, 0
    for i, (_, cells) in enumerate(rows):
        if not cells:
            continue
        col, placed = 0, []
        for (_, down, across, th), text in zip(cells, texts[i]):
            while (i, col) in taken:
                col += 1
            if col >= wide:
                break
            taken.update((r, c) for r in range(i, i + down) for c in range(col, col + across))
            placed.append((col, down, across, _cut(text), th or i in heads))
            col += across
        if any(text for *_, text, _ in placed):
            for col, down, across, text, header in placed:
                if col < MOST_COLUMNS:
                    out.append((ordinal, line, col, down, across, text, header))
                ordinal += 1
            line += 1
        else:
            ordinal += len(placed)
    return out


CELLS = "ordinal int, row int, col int, rowspan int, colspan int, text string, is_header boolean"


def html_cells(df: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """The cells of the first table of each HTML text at their places in the grid: key, ordinal, row, col, rowspan, colspan, text, is_header."""
    kinds = dict(df.dtypes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*key, "ordinal", "row", "col", "rowspan", "colspan", "text", "is_header"]
        for pdf in batches:
            keys = pdf[key].itertuples(index=False, name=None)
            yield pd.DataFrame([(*k, *c) for k, h in zip(keys, pdf["_h"]) for c in parsed_table(h)], columns=names)

    own = df.filter(F.col(html).contains("<")).select(*key, F.col(html).alias("_h"))
    return own.mapInPandas(rows, ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + CELLS)


def table_profile(cells: DataFrame, key: list[str]) -> DataFrame:
    """Per table: rows, columns, cells, filled cells, header rows, whether cells are merged."""
    return cells.groupBy(*key).agg(
        (F.max("row") + 1).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols"), F.count("*").alias("n_cells"), F.count_if(F.col("text") != "").alias("n_filled"),
        F.countDistinct(F.when(F.col("is_header"), F.col("row"))).alias("header_rows"), F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("has_merged_cells"),
    )


def grid(cells: DataFrame, key: list[str]) -> DataFrame:
    """Every place of each table's grid: key, row, col, text. Places a span covers, and gaps, hold ''."""
    size = cells.groupBy(*key).agg(F.max("row").alias("_r"), F.least(F.max(F.col("col") + F.col("colspan")) - 1, F.lit(MOST_COLUMNS - 1)).alias("_c"))
    every = size.select(*key, F.explode(F.sequence(F.lit(0), "_r")).alias("row"), "_c").select(*key, "row", F.explode(F.sequence(F.lit(0), "_c")).alias("col"))
    return every.join(cells.select(*key, "row", "col", "text"), [*key, "row", "col"], "left").fillna("", ["text"])


def header_spans(cells: DataFrame, key: list[str]) -> DataFrame:
    """Header cells that span: key, row, col, rowspan, colspan, text."""
    return cells.filter(F.col("is_header") & ((F.col("rowspan") > 1) | (F.col("colspan") > 1))).select(*key, "row", "col", "rowspan", "colspan", "text")


def header_row_count(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, header_rows) by the rule for tables without a marked head: leading rows, at most three, with no cell over 20 characters."""
    short = cells.groupBy(*key, "row").agg(F.min((F.length("text") <= SHORT).cast("int")).alias("s"))
    lead = F.min("s").over(Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return short.withColumn("lead", lead).groupBy(*key).agg(F.count_if((F.col("lead") == 1) & (F.col("row") < PROBED_ROWS)).alias("header_rows"))


def real_tables(cells: DataFrame, key: list[str]) -> DataFrame:
    """Keys of tables that are more than a rule or an axis: not all blank, and three rows or three columns at least."""
    size = cells.groupBy(*key).agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.count_if(F.trim("text") != "").alias("n"))
    return size.filter((F.col("n") > 0) & ~((F.col("r") < 3) & (F.col("c") < 3))).select(*key)


def caption_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, caption): the caption in a table's first row, where it holds at most two filled cells that read "Table 1:" or "Figure 1."."""
    first = cells.filter((F.col("row") == 0) & (F.trim("text") != "")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("t")))).alias("c"))
    return first.select(*key, "c", F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("caption")).filter((F.size("c") <= 2) & F.col("caption").rlike(r"(?i)^(table|figure)\s+\d+[:.]")).select(*key, "caption")


def without_captions(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells with caption rows taken off and the rows below moved up."""
    out = cells.join(caption_rows(cells, key), key, "left")
    return out.filter(F.col("caption").isNull() | (F.col("row") > 0)).withColumn("row", F.when(F.col("caption").isNull(), F.col("row")).otherwise(F.col("row") - 1)).drop("caption")


def header_form(c: Column) -> Column:
    """A header as it is compared."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def alias_rows(fields: dict[str, list[str]], own_names: bool = False) -> list[tuple[str, str, int]]:
    """(alias, field, position) of a template; of an alias two fields claim, the later one holds it. ``own_names``: a field's name is an alias."""
    out: dict[str, tuple[str, int]] = {}
    for i, (name, aliases) in enumerate(fields.items()):
        for a in [*([name] if own_names else []), *aliases]:
            out[" ".join(a.lower().split())] = (name, i)
    return [(a, f, i) for a, (f, i) in out.items()]


def mapped_rows(cells: DataFrame, key: list[str], template: str | dict[str, list[str]]) -> DataFrame:
    """Rows of tables under the fields of a template: key, template, row_index and one column per field ('' where missing).

    Row 0 is the header; where none of its cells is an alias, row 1 is taken for it if two of its cells are, else, for templates
    with a fixed order of columns, the position decides. A later column of the same field wins; rows without a field are left out.
    """
    name, fields = (template, TEMPLATES[template]) if isinstance(template, str) else ("custom", template)
    spark = cells.sparkSession
    aliases = F.broadcast(spark.createDataFrame(alias_rows(fields, not isinstance(template, str)), "alias string, field string, position int"))
    known = cells.filter("row <= 1").withColumn("alias", header_form("text")).join(aliases, "alias").select(*key, "row", "col", "field")
    hits = known.groupBy(*key).agg(F.count_if(F.col("row") == 0).alias("first"), F.count_if(F.col("row") == 1).alias("second"))
    head = hits.select(*key, F.when(F.col("first") > 0, 0).when(F.col("second") >= 2, 1).alias("head")).filter("head is not null")
    where = known.join(head, key).filter("row = head").select(*key, "col", "field", "head")
    if name in POSITIONAL:
        rest = cells.select(*key).distinct().join(head, key, "left_anti").select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(f).alias("field")) for i, f in enumerate(fields)])).alias("x")).select(*key, "x.*")
        where = where.unionByName(rest.withColumn("head", F.lit(0)))
    values = cells.join(where, [*key, "col"]).filter((F.col("row") > F.col("head")) & (F.trim("text") != ""))
    one = values.groupBy(*key, "row", "head", "field").agg(F.max_by(F.trim("text"), "col").alias("v"))
    wide = one.groupBy(*key, "row", "head").pivot("field", list(fields)).agg(F.first("v"))
    return wide.select(*key, F.lit(name).alias("template"), (F.col("row") - F.col("head") - 1).alias("row_index"), *[F.coalesce(f, F.lit("")).alias(f) for f in fields])


def missing_fields(cells: DataFrame, key: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """(key, missing): fields of a customer's schema no header maps to. A table with any must be refused."""
    aliases = F.broadcast(cells.sparkSession.createDataFrame(alias_rows(fields, True), "alias string, field string, position int"))
    seen = cells.filter("row = 0").withColumn("alias", header_form("text")).join(aliases, "alias").groupBy(*key).agg(F.collect_set("field").alias("s"))
    return cells.select(*key).distinct().join(seen, key, "left").select(*key, F.array_sort(F.array_except(F.array(*map(F.lit, fields)), F.coalesce("s", F.array().cast("array<string>")))).alias("missing"))


def padded(row: Column, n: Column) -> Column:
    """A row (array of texts) cut or filled with '' to n columns."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def spans_fit(spans: DataFrame, cells: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """(key, ordinal, row, col, confidence): the score of each written cell at its anchor in the grid.

    ``spans`` has ordinal, row, col, rowspan, colspan; ``scores`` has ordinal, confidence; ``cells`` is the grid. Nothing is given for a table
    unless there is a score for every span and no other, spans are at least 1, lie in the grid, share no anchor, and cover blank cells only.
    """
    size = cells.groupBy(*key).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    placed = spans.join(size, key, "left")
    shape = placed.groupBy(*key).agg(
        F.count("*").alias("n"), F.countDistinct("row", "col").alias("places"),
        F.bool_and(F.coalesce((F.col("rowspan") >= 1) & (F.col("colspan") >= 1) & (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") + F.col("rowspan") <= F.col("h")) & (F.col("col") + F.col("colspan") <= F.col("w")), F.lit(False))).alias("inside"),
    )
    good = spans.filter("rowspan >= 1 and colspan >= 1")
    covered = good.select(*key, "row", "col", F.explode(F.sequence(F.lit(0), F.col("rowspan") - 1)).alias("i"), "colspan").select(*key, "row", "col", "i", F.explode(F.sequence(F.lit(0), F.col("colspan") - 1)).alias("j"))
    covered = covered.filter("i > 0 or j > 0").select(*key, (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"))
    hidden = covered.join(cells.filter("text <> ''"), [*key, "row", "col"], "left_semi").select(*key).distinct()
    counted = scores.groupBy(*key).agg(F.count("*").alias("m"))
    fit = shape.join(counted, key).filter("inside and n = places and n = m").join(hidden, key, "left_anti").select(*key)
    return spans.join(fit, key, "left_semi").join(scores, [*key, "ordinal"]).select(*key, "ordinal", "row", "col", "confidence")


def zipped_tables(blocks: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """Table blocks with the HTML of the table at the same place in its page's order: block ``ord`` against region ``region_id``."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    m = F.row_number().over(Window.partitionBy(*key).orderBy("region_id"))
    return blocks.filter("type = 'table'").withColumn("_k", k).join(tables.withColumn("_k", m).select(*key, "_k", "html"), [*key, "_k"], "left").drop("_k")


def engine_route(layout_tables: Column, page_tables: Column, policy: Column) -> Column:
    """(path, reason) of a table result: tables of the layout first, those of the whole page only where the policy allows it."""
    pick = lambda p, r: F.struct(F.lit(p).alias("path"), F.lit(r).alias("reason"))
    return F.when(layout_tables > 0, pick("layout", "layout_tables")).when(policy == "never", pick("none", "policy_off")).when(page_tables > 0, pick("page", "layout_empty")).otherwise(pick("none", "no_tables"))
