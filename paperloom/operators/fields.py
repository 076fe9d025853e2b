"""Extracted fields: parsing of model output, validation, typing, merging over pages and windows, measures.

Long form is (task, page, field, value) with list values in JSON; wide maps are map<string,string>.

Defined results: blank values count as missing; an unknown rule or document type makes a field valid and a document type
unsupported; pages that are no numbers sort as 0; equal pages keep the greater value; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LIST_FIELDS = ["items", "line_items", "findings"]
DATE_SHAPES = [r"\d{4}-\d{2}-\d{2}$", r"\d{2}/\d{2}/\d{4}$", r"\d{2}-\d{2}-\d{4}$"]
CURRENCY_SHAPE = r"[\$€£]?\s*-?\d{1,3}(?:,\d{3})*(?:\.\d{2})?$"
HINTS = {"invoice": ["invoice_number", "total", "seller_name", "invoice_date"], "receipt": ["total", "merchant_name", "receipt_date", "receipt_number"], "id_card": ["name", "id_number"], "passport": ["passport_number", "name"], "bank_card": ["bank_card_number", "bank_name"], "coi": ["carrier", "policy_type", "eff_date", "exp_date", "limits"], "pico": ["findings"]}
RULES = {
    "invoice": {"invoice_date": "date", "date": "date", "total": "currency", "total_amount": "currency", "subtotal": "currency", "tax": "currency"},
    "receipt": {"date": "date", "total": "currency", "subtotal": "currency", "tax": "currency"},
    "id_card": {"id_number": r"regex:^\d{18}$"},
    "passport": {"passport_number": r"regex:^[A-Za-z0-9]{6,12}$"},
    "bank_card": {"card_number": r"regex:^[\d\s-]{13,19}$", "expiry_date": "date"},
    "custom": {"transaction_date": "date", "amount": "currency", "unit_price": "currency", "line_total": "currency", "balance": "currency"},
}
FULL_REVIEW, LITE_TEMPLATES = ["invoice", "receipt", "id_card", "passport", "bank_card"], ["bank_statement", "invoice_line_items"]
CURRENCIES = {"£": "GBP", "$": "USD", "¥": "CNY", "€": "EUR", "￥": "CNY"}
CURRENCY_CODES = "GBP|USD|EUR|CNY|JPY|HKD|AUD|CAD"
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyy年M月d日", "yyyy.M.d", "d.M.yyyy", "M/d/yyyy"]
COUNTRY = r"(?i)(United Kingdom|United States|UK|USA|中国|China)"
INJECTIONS = [r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions", r"(?i)disregard\s+(the\s+)?(system|above)", r"(?i)you\s+are\s+now\s+", r"(?i)<\s*/?\s*system\s*>"]
QUERY_FIELDS, DESCRIPTION = 20, 200


def stripped(c: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_filled(c: Column) -> Column:
    """Whether a value counts: not null, not blank, no empty list or object."""
    t = stripped(c)
    return F.coalesce((t != "") & ~F.regexp_replace(t, r"\s", "").isin("[]", "{}", "null"), F.lit(False))


def model_json(c: Column) -> Column:
    """The JSON object in a model's answer: the whole text, the inside of a fence, or from the first to the last brace, without commas before
    closing brackets; null where none of them is an object."""
    def tidy(x):
        return F.regexp_replace(stripped(x), r",\s*([}\]])", "$1")

    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    is_object = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")
    return F.coalesce(*[F.when(is_object(tidy(x)), tidy(x)) for x in (c, fence, outer)])


def page_list(spec: Column, pages: Column, most: Column | int | None = None) -> Column:
    """Pages of a specification such as "1", "first", "all" or "1-3,7": sorted, distinct, within the document, cut to ``most``."""
    s = F.lower(F.regexp_replace(F.coalesce(spec, F.lit("1")), r"\s", ""))
    every = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    first = F.when(pages >= 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))

    def part(p):
        a, b = F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 1).try_cast("int"), F.regexp_extract(p, r"^(\d+)-(\d+)$", 2).try_cast("int")
        hi = F.least(F.coalesce(b, a), pages)
        return F.when(a.isNotNull() & (a <= hi), F.sequence(a, hi)).otherwise(F.array().cast("array<int>"))

    listed = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split(s, ","), part)), lambda x: (x >= 1) & (x <= pages))))
    out = F.when(s == "all", every).when(s.isin("first", ""), first).otherwise(listed)
    return out if most is None else F.slice(out, F.lit(1), F.lit(most) if isinstance(most, int) else most)


def pages_cut(spec: Column, pages: Column, most: int) -> Column:
    """Whether a page list had to be cut."""
    return F.size(page_list(spec, pages)) > most


def is_valid(value: Column, rule: Column) -> Column:
    """Whether a value keeps its rule: date, currency, ``regex:…`` (from the beginning), or none."""
    v = stripped(F.coalesce(value, F.lit("")))
    date = F.lit(False)
    for shape in DATE_SHAPES:
        date = date | v.rlike("^" + shape)
    pattern = F.regexp_replace(rule, "^regex:", "")
    own = F.regexp_instr(v, F.concat(F.lit("^(?:"), pattern, F.lit(")"))) == 1
    return F.when(rule.isNull(), F.lit(True)).when(rule == "date", date).when(rule == "currency", (v != "") & v.rlike("^" + CURRENCY_SHAPE)).when(rule.startswith("regex:"), own).otherwise(F.lit(True))


def rule_rows(df: DataFrame, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(document_type, field, rule) of all default rules; a small table to broadcast."""
    return df.sparkSession.createDataFrame([(t, f, r) for t, own in (rules or RULES).items() for f, r in own.items()], "document_type string, field string, rule string")


def validated(fields: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Fields (task, document_type, field, value) with their rule and whether they keep it. Blank values of fields with a rule do not."""
    r = F.broadcast(rules if rules is not None else rule_rows(fields))
    return fields.join(r, ["document_type", "field"], "left").withColumn("valid", is_valid(F.col("value"), F.col("rule")))


def validation_summary(checked: DataFrame) -> DataFrame:
    """Per task: fields with a rule that keep it, that do not, whether all do, and the failing fields in order."""
    own = F.col("rule").isNotNull()
    return checked.groupBy("task").agg(
        F.count_if(own & F.col("valid")).alias("passed"), F.count_if(own & ~F.col("valid")).alias("failed"), (F.count_if(own & ~F.col("valid")) == 0).alias("validation_passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(own & ~F.col("valid"), F.col("field")))), ",").alias("failed_fields"),
    )


def review_profile(document_type: Column, template: Column) -> Column:
    """How much of a document type a person reviews: full, lite or off."""
    d, t = F.lower(F.trim(F.coalesce(document_type, F.lit("auto")))), F.lower(F.trim(F.coalesce(template, F.lit(""))))
    return F.when(d.isin(FULL_REVIEW), "full").when((d == "custom") & t.isin(LITE_TEMPLATES), "lite").otherwise("off")


def to_review(document_type: Column, template: Column, passed: Column, enabled: Column) -> Column:
    """Whether a task goes to review: a profile that reviews, review switched on, and validation that failed."""
    return F.coalesce(enabled, F.lit(True)) & (review_profile(document_type, template) != "off") & ~F.coalesce(passed, F.lit(True))


def to_date(c: Column) -> Column:
    """An ISO date out of the written forms known, days before months where both fit; null for any other text."""
    s = F.trim(c)
    forms = [F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "dd/MM/yyyy"), F.try_to_date(s, "d/M/yyyy"), F.try_to_date(s, "d-M-yyyy"), *[F.try_to_date(s, f) for f in DATE_FORMATS], F.try_to_date(s, "yyyyMMdd")]
    return F.date_format(F.coalesce(*forms), "yyyy-MM-dd")


def to_number(c: Column) -> Column:
    """The first number of a text, thousands separated by plain or full-width commas."""
    n = F.regexp_extract(c, r"-?\d{1,3}(?:[,，]\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?", 0)
    return F.when(n != "", F.regexp_replace(n, "[,，]", "").try_cast("double"))


def to_currency(c: Column) -> Column:
    """(amount, currency): a number with the currency of the first known sign, else of the first known code; null without a number."""
    code = F.lit(None).cast("string")
    for sign, name in reversed(CURRENCIES.items()):
        code = F.when(F.contains(c, F.lit(sign)), name).otherwise(code)
    word = F.upper(F.regexp_extract(c, rf"(?i)\b({CURRENCY_CODES})\b", 1))
    return F.when(to_number(c).isNotNull(), F.struct(to_number(c).alias("amount"), F.coalesce(code, F.when(word != "", word)).alias("currency")))


def to_address(c: Column) -> Column:
    """(street, city, country): lines or comma parts but the last as the street; a country at the end, and then the part before it as the city."""
    parts = F.filter(F.transform(F.split(c, r"[\n,]+"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    last = F.try_element_at(parts, F.lit(-1))
    named = last.rlike(COUNTRY)
    return F.when(n > 0, F.struct(
        F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), n - 1), "\n")).otherwise(last).alias("street"),
        F.when(named & (n >= 2), F.try_element_at(parts, F.lit(-2))).alias("city"), F.when(named, last).alias("country"),
    ))


def merged_pages(fields: DataFrame) -> DataFrame:
    """(task, field, value): one value per field over all pages (task, page, field, value). Lists are joined in order of pages, a single value
    before a list becomes its first entry; of other fields the last value that is not blank counts. Raw model output is left out."""
    page = F.coalesce(F.when(F.col("page").cast("string").rlike(r"^\d+$"), F.col("page").cast("int")), F.lit(0)).alias("p")
    f = fields.filter(F.col("field") != "raw_output").select("task", page, "field", "value")
    plain = f.filter(~F.col("field").isin(LIST_FIELDS)).filter(is_filled(F.col("value"))).groupBy("task", "field").agg(F.max_by("value", F.struct("p", "value")).alias("value"))
    inner = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r"^\[\s*", ""), r"\s*\]$", "")
    text = lambda v: F.when(F.trim(v).startswith("["), inner(v)).when(F.trim(v).startswith("{"), F.trim(v)).otherwise(F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6))
    lists = f.filter(F.col("field").isin(LIST_FIELDS) & is_filled(F.col("value"))).groupBy("task", "field").agg(F.array_sort(F.collect_list(F.struct("p", text(F.col("value")).alias("t")))).alias("v"))
    lists = lists.select("task", "field", F.concat(F.lit("["), F.array_join(F.filter(F.transform("v", lambda x: x["t"]), lambda x: x != ""), ","), F.lit("]")).alias("value"))
    return plain.unionByName(lists)


def merged_windows(findings: DataFrame) -> DataFrame:
    """Findings of all windows (task, window, ordinal, quote, statement, ..): of equal ones the first window's, numbered through."""
    same = Window.partitionBy("task", F.trim(F.coalesce("quote", F.lit(""))), F.trim(F.coalesce("statement", F.lit("")))).orderBy("window", "ordinal")
    kept = findings.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("task").orderBy("window", "ordinal")))


def backfilled(fields: Column, names: list[str]) -> Column:
    """A map of fields with every named one in it, '' where it was missing; lists are never filled in."""
    blank = F.create_map(*[F.lit(x) for n in names if n not in LIST_FIELDS for x in (n, "")]) if [n for n in names if n not in LIST_FIELDS] else F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array_distinct(F.concat(F.map_entries(fields), F.filter(F.map_entries(blank), lambda e: ~F.map_contains_key(fields, e["key"])))))


def pruned(fields: Column) -> Column:
    """A map of JSON values without nulls, empty lists and empty objects; 0 and '' stay."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & ~F.regexp_replace(v, r"\s", "").isin("null", "[]", "{}"))


def dotted(value: str) -> dict[str, str]:
    """A nested object under dotted keys; a list is JSON text cut to 500 characters."""
    import json

    out: dict[str, str] = {}
    try:
        todo = [("", json.loads(value))] if value else []
    except ValueError:
        return out
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        elif path and v is not None:
            out[path] = json.dumps(v, ensure_ascii=False)[:500] if isinstance(v, list) else str(v)
    return out


def flattened(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, value): every value of a JSON column under its dotted path."""
    import pandas as pd

    kinds = dict(df.dtypes)

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame([(*k, p, v) for k, j in zip(pdf[key].itertuples(index=False, name=None), pdf["_j"]) for p, v in sorted(dotted(j).items())], columns=[*key, "path", "value"])

    return df.select(*key, F.col(column).alias("_j")).mapInPandas(rows, ", ".join(f"{k} {kinds[k]}" for k in key) + ", path string, value string")


def extended_schema(schema: Column, more: Column) -> Column:
    """A schema map with further names; a name that is there already is an error."""
    clash = F.size(F.array_intersect(F.map_keys(schema), F.map_keys(more))) > 0
    return F.when(clash, F.raise_error(F.lit("name already in the schema"))).otherwise(F.map_concat(schema, more))


def query_fields(spec: Column) -> Column:
    """(error, fields) of requested fields in JSON, each a name or {name, description}: invalid_json, invalid_type, invalid_field_name,
    duplicate_query_field (whatever the case), too_many_fields, injection; descriptions without control characters, cut to 200."""
    text = F.trim(F.coalesce(spec, F.lit("")))
    listed = F.from_json(text, "array<string>")
    clean = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1f\x7f]", "")
    name = lambda x: F.trim(clean(F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)))
    about = lambda x: F.left(F.trim(clean(F.when(x.startswith("{"), F.get_json_object(x, "$.description")))), F.lit(DESCRIPTION))
    fields = F.transform(listed, lambda x: F.struct(name(x).alias("name"), about(x).alias("description")))
    names = F.transform(fields, lambda f: F.lower(f["name"]))
    hostile = F.exists(fields, lambda f: F.coalesce(sum((F.concat_ws(" ", f["name"], f["description"]).rlike(p).cast("int") for p in INJECTIONS), F.lit(0)) > 0, F.lit(False)))
    error = (
        F.when(text == "", F.lit(None)).when(F.try_parse_json(text).isNull(), "invalid_json").when(~text.startswith("["), "invalid_type")
        .when(F.exists(fields, lambda f: ~f["name"].rlike("^[A-Za-z][A-Za-z0-9_]*$")), "invalid_field_name").when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_query_field")
        .when(F.size(fields) > QUERY_FIELDS, "too_many_fields").when(hostile, "injection")
    )
    return F.struct(error.alias("error"), F.when(error.isNull() & (text != ""), fields).otherwise(F.array().cast("array<struct<name:string,description:string>>")).alias("fields"))


def filled_queries(fields: Column, names: Column) -> Column:
    """Those of the requested names that have a value, in the order asked for."""
    return F.filter(names, lambda n: is_filled(F.try_element_at(fields, n)))


def raw_only(fields: Column) -> Column:
    """Whether a result is nothing but raw model output."""
    return (F.size(fields) == 1) & F.map_contains_key(fields, F.lit("raw_output"))


def meaningful(fields: Column) -> Column:
    """How many fields of a map have a value, raw output aside."""
    return F.when(fields.isNull() | raw_only(fields), 0).otherwise(F.size(F.map_filter(fields, lambda k, v: (k != "raw_output") & is_filled(v))))


def hints_of(document_type: Column) -> Column:
    """The fields a document type is judged by, in order; empty for an unknown type."""
    table = F.create_map(*[x for t, h in HINTS.items() for x in (F.lit(t), F.array(*map(F.lit, h)))])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(document_type))), F.array().cast("array<string>"))


def fill_confidence(fields: Column, document_type: Column) -> Column:
    """Share of the fields a document type is judged by that have a value."""
    h = hints_of(document_type)
    n = F.size(F.filter(h, lambda x: is_filled(F.try_element_at(fields, x))))
    return F.when((F.size(h) == 0) | fields.isNull() | raw_only(fields), 0.0).otherwise(F.bround(n / F.size(h), 4))


def production_hit(fields: Column, document_type: Column) -> Column:
    """(hit, reason, keys): whether a result has one of the fields its type is judged by."""
    h = hints_of(document_type)
    keys = F.filter(h, lambda x: is_filled(F.try_element_at(fields, x)))
    none = F.array().cast("array<string>")
    out = lambda hit, reason, k: F.struct(F.lit(hit).alias("hit"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), k.alias("keys"))
    return (
        F.when(fields.isNull() | (F.size(fields) == 0), out(False, "empty_fields", none)).when(raw_only(fields), out(False, "raw_output_only", none))
        .when(F.size(h) == 0, out(False, F.concat(F.lit("unsupported_doc_type:"), F.lower(F.trim(F.coalesce(document_type, F.lit(""))))), none))
        .when(F.size(keys) > 0, out(True, "production_hit", keys)).otherwise(out(False, "no_required_keys_filled", none))
    )


def contract(stage: Column, count: Column) -> Column:
    """(kept, reason): whether extraction kept its contract: completed, with no negative count."""
    out = lambda ok, r: F.struct(F.lit(ok).alias("kept"), r.alias("reason"))
    return F.when(~F.coalesce(stage == "completed", F.lit(False)), out(False, F.concat(F.lit("stage_not_completed:"), F.coalesce(stage, F.lit(""))))).when(count < 0, out(False, F.concat(F.lit("invalid_negative_count:"), count.cast("string")))).when(count == 0, out(True, F.lit("completed_with_zero_fields_allowed"))).otherwise(out(True, F.lit("completed_with_field_hits")))


def is_id_number(c: Column) -> Column:
    """Whether a text is an identity number of 18 places."""
    return F.coalesce(F.trim(c).rlike("^[0-9]{17}[0-9Xx]$"), F.lit(False))


def id_precision(fields: Column, document_type: Column) -> Column:
    """(hit, reason): whether an identity card has a name and a well-formed number."""
    name, number = is_filled(F.try_element_at(fields, F.lit("name"))), is_id_number(F.try_element_at(fields, F.lit("id_number")))
    out = lambda hit, r: F.struct(F.lit(hit).alias("hit"), F.lit(r).alias("reason"))
    return (
        F.when(~F.coalesce(F.lower(F.trim(document_type)) == "id_card", F.lit(False)), out(True, "not_id_card")).when(fields.isNull() | (F.size(fields) == 0) | raw_only(fields), out(False, "empty_or_raw_output_only"))
        .when(name & number, out(True, "id_card_precision_hit")).when(name, out(False, "id_number_missing_or_invalid")).when(number, out(False, "name_missing")).otherwise(out(False, "name_and_id_number_missing"))
    )


def text_windows(blocks: DataFrame, budget: int = 12_000) -> DataFrame:
    """(doc, page, window, first, last, payload): blocks (doc, page, idx, text) in windows of at most ``budget`` characters, each beginning with the
    last block of the one before; a block over the budget is a window of its own. Every block is written "[p1_b0] text" on a line."""
    import pandas as pd

    kinds = dict(blocks.dtypes)

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("idx")
        lines = [f"[p{p}_b{i}] {t or ''}" for p, i, t in zip(rows["page"], rows["idx"], rows["text"])]
        idx, out, at = rows["idx"].tolist(), [], 0
        while at < len(lines):
            end, size = at, 0
            while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= budget):
                size += len(lines[end]) + 1
                end += 1
            out.append((rows["doc"].iloc[0], rows["page"].iloc[0], len(out), idx[at], idx[end - 1], "\n".join(lines[at:end])))
            if end >= len(lines):
                break
            at = end - 1 if end - 1 > at else end
        return pd.DataFrame(out, columns=["doc", "page", "window", "first", "last", "payload"])

    return blocks.groupBy("doc", "page").applyInPandas(page, f"doc {kinds['doc']}, page {kinds['page']}, window int, first {kinds['idx']}, last {kinds['idx']}, payload string")


def text_first(document_type: Column, is_pdf: Column, enabled: Column) -> Column:
    """Whether a document is read from its text before its image."""
    return F.coalesce(is_pdf & enabled & F.lower(document_type).isin("pico", "coi"), F.lit(False))


def page_payloads(trusted: DataFrame, native: DataFrame, fused: DataFrame) -> DataFrame:
    """Blocks a model reads (doc, page, idx, text, origin): the native ones of trusted pages, else the recognised ones; pages with neither are left out."""
    t = trusted.filter("trusted").select("doc", "page")
    a = native.filter(F.trim("text") != "").join(t, ["doc", "page"], "left_semi").withColumn("origin", F.lit("native"))
    have = a.select("doc", "page").distinct()
    b = fused.filter(F.trim("text") != "").join(have, ["doc", "page"], "left_anti").withColumn("origin", F.lit("recognised"))
    return a.select("doc", "page", "idx", "text", "origin").unionByName(b.select("doc", "page", "idx", "text", "origin"))


def options_of(df: DataFrame, fallback: bool, backfill_allowed: bool = True) -> DataFrame:
    """Requested options (nullable columns table_fallback, kie_pages, table_template, table_text_backfill) as they take effect."""
    template = F.lower(F.trim("table_template"))
    return df.withColumns({
        "table_fallback": F.coalesce("table_fallback", F.lit(fallback)), "kie_pages": F.coalesce(F.when(F.trim("kie_pages") != "", F.trim("kie_pages")), F.lit("1")),
        "table_template": F.when(template != "", template), "table_text_backfill": F.coalesce("table_text_backfill", F.lit("auto")) if backfill_allowed else F.lit("off"),
    })


def prompt(template: str, schema: Column) -> Column:
    """A prompt with the schema in the place kept for it."""
    return F.replace(F.lit(template), F.lit("{{ schema_json }}"), schema)


def kie_switched_on(document_type: Column, asked: Column) -> Column:
    """Whether fields are extracted: as asked, by default for the types that need it."""
    return F.coalesce(asked, F.lower(document_type).isin("invoice", "receipt", "id_card"), F.lit(False))
