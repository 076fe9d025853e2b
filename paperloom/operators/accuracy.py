"""Measures against ground truth: fields and grids, captions, tables, headings, printed text, samples for people to check.

Defined results: truth that is blank after normalising is ``gt_empty`` and not counted; what is there beyond the truth is
ignored; rates over nothing are null; equal scores go to the earlier candidate; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import collapsed, ground_truth_form, harness_tokens, hedges, similarity

# Fixed values.
CAPTION_NEAR, CAPTION_MATCH, SAME_PAGE, OTHER_PAGE = 0.5, 0.85, 0.10, -0.05
TABLE_CAPTION, TABLE_GRID, CELL_MATCH = 0.8, 0.2, 0.9


def status(expected: Column, actual: Column) -> Column:
    """gt_empty, missing, match or wrong, both texts normalised."""
    e, a = ground_truth_form(expected), ground_truth_form(actual)
    return F.when(e == "", "gt_empty").when(a == "", "missing").when(e == a, "match").otherwise("wrong")


def field_items(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc, field, expected, actual, status): every field of the truth (doc, field, value) against the actual one."""
    a = actual.groupBy("doc", "field").agg(F.first("value", True).alias("actual"))
    return truth.select("doc", "field", F.col("value").alias("expected")).join(a, ["doc", "field"], "left").withColumn("status", status(F.col("expected"), F.col("actual")))


def cell_items(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc, tbl, row, col, expected, actual, status): every cell of the truth (doc, tbl, row, col, text). A blank cell of the truth gives an item only
    where the actual table has the place; actual cells beyond the truth are ignored."""
    t = truth.select("doc", "tbl", "row", "col", F.col("text").alias("expected"))
    a = actual.select("doc", "tbl", "row", "col", F.col("text").alias("actual"), F.lit(True).alias("_there"))
    out = t.join(a, ["doc", "tbl", "row", "col"], "left").withColumn("status", status(F.col("expected"), F.col("actual")))
    return out.filter(F.col("_there") | (F.col("status") != "gt_empty")).drop("_there")


def same_shape(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc, tbl, same): whether both tables have the same rows with the same number of cells."""
    n = lambda df, c: df.groupBy("doc", "tbl", "row").agg(F.count("*").alias(c))
    both = n(truth, "a").join(n(actual, "b"), ["doc", "tbl", "row"], "full")
    return both.groupBy("doc", "tbl").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"))


def accuracy(items: DataFrame, key: list[str]) -> DataFrame:
    """Per key: total, evaluable, matched, missing, wrong and the share matched of the evaluable."""
    s = F.col("status")
    out = items.groupBy(*key) if key else items.groupBy()
    out = out.agg(F.count("*").alias("total"), F.count_if(s != "gt_empty").alias("evaluable"), *[F.count_if(s == x).alias(n) for x, n in (("match", "matched"), ("missing", "missing"), ("wrong", "wrong"))])
    return out.withColumn("accuracy", F.bround(F.try_divide("matched", "evaluable"), 4))


def actual_fields(results: DataFrame) -> DataFrame:
    """(doc, field, value) of results (doc, result JSON): kie_fields, else view.fields; objects with a content give that."""
    fields = F.coalesce(*[F.from_json(F.get_json_object("result", p), "map<string,string>") for p in ("$.kie_fields", "$.view.fields", "$.result.kie_fields")])
    rows = results.select("doc", F.explode(fields).alias("field", "v"))
    return rows.select("doc", "field", F.coalesce(F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.content")), F.col("v")).alias("value"))


def _greedy(pairs: DataFrame, need: float) -> DataFrame:
    """Of scored pairs (doc, t, a, score): for each t in order the best a; it is used up only where the score reaches ``need``."""
    kinds = dict(pairs.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for t, own in pdf.sort_values(["t", "score", "a"], ascending=[True, False, True]).groupby("t", sort=True):
            best = next(((r.a, r.score) for r in own.itertuples(index=False) if r.a not in used), None)
            if best:
                out.append((pdf["doc"].iloc[0], t, best[0], best[1]))
                if best[1] >= need:
                    used.add(best[0])
        return pd.DataFrame(out, columns=["doc", "t", "a", "score"])

    return pairs.groupBy("doc").applyInPandas(choose, f"doc {kinds['doc']}, t {kinds['t']}, a {kinds['a']}, score double")


def matched_captions(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, n, status, score): captions of the truth (doc, n, page, text) against found ones, by similarity and a bonus for the same page."""
    t, a = truth.alias("t"), found.alias("a")
    bonus = F.when(F.col("t.page") == F.col("a.page"), SAME_PAGE).otherwise(OTHER_PAGE)
    score = similarity(F.lower(collapsed(F.col("t.text"))), F.lower(collapsed(F.col("a.text")))) + bonus
    pairs = t.join(a, F.expr("t.doc = a.doc")).select("t.doc", F.col("t.n").alias("t"), F.col("a.n").alias("a"), score.alias("score")).filter(F.col("score") >= CAPTION_NEAR)
    best = _greedy(pairs, CAPTION_MATCH)
    out = truth.select("doc", "n").join(best.select("doc", F.col("t").alias("n"), F.col("a").alias("found"), F.bround("score", 4).alias("score")), ["doc", "n"], "left")
    return out.withColumn("status", F.when(F.col("score") >= CAPTION_MATCH, "match").when(F.col("score").isNotNull(), "near").otherwise("missing"))


def matched_tables(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, n, found, score): tables of the truth (doc, n, page, caption, n_rows, n_cols) against those found on their page, by caption and shape."""
    t, a = truth.alias("t"), found.alias("a")
    ratio = lambda c: F.least(F.col(f"t.{c}"), F.col(f"a.{c}")) / F.greatest(F.col(f"t.{c}"), F.col(f"a.{c}"))
    shape = F.coalesce((ratio("n_rows") + ratio("n_cols")) / 2, F.lit(0.0))
    score = TABLE_CAPTION * similarity(F.lower("t.caption"), F.lower("a.caption")) + TABLE_GRID * shape
    pairs = t.join(a, F.expr("t.doc = a.doc and t.page = a.page")).select("t.doc", F.col("t.n").alias("t"), F.col("a.n").alias("a"), score.alias("score"))
    return _greedy(pairs, 0.0).select("doc", F.col("t").alias("n"), F.col("a").alias("found"), F.bround("score", 4).alias("score"))


def found_headings(truth: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, n, present): whether a heading stands in a line of its document or a line in it, neither three times as long as the other."""
    t = truth.select("doc", "n", F.lower(collapsed(F.col("text"))).alias("h")).filter("h <> ''")
    b = lines.select("doc", F.lower(collapsed(F.col("text"))).alias("b")).filter("b <> ''").distinct()
    hit = t.join(b, "doc").filter((F.contains("h", "b") | F.contains("b", "h")) & (F.length("h") < 3 * F.length("b")) & (F.length("b") < 3 * F.length("h"))).select("doc", "n").distinct()
    return t.select("doc", "n").join(hit.withColumn("present", F.lit(True)), ["doc", "n"], "left").fillna(False, ["present"])


def text_recall(printed: DataFrame, actual: DataFrame, most: int = 60) -> DataFrame:
    """Per document: distinct printed tokens, those missing from the actual text, the recall and the first of the missing in order."""
    p = printed.select("doc", F.explode(harness_tokens(F.col("text"))).alias("w")).distinct()
    a = actual.select("doc", F.explode(harness_tokens(F.col("text"))).alias("w")).distinct()
    miss = p.join(a, ["doc", "w"], "left_anti").withColumn("m", F.lit(1))
    both = p.join(miss, ["doc", "w"], "left")
    order = Window.partitionBy("doc").orderBy(F.col("m").isNull(), "w")
    both = both.withColumn("k", F.row_number().over(order))
    out = both.groupBy("doc").agg(F.count("*").alias("printed"), F.count("m").alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull() & (F.col("k") <= most), F.col("w")))), " ").alias("first_missing"))
    return out.withColumn("recall", F.bround(1 - F.try_divide("missing", "printed"), 4))


def harness_verdict(captions: DataFrame, tables: DataFrame, headings: DataFrame, cells: DataFrame) -> DataFrame:
    """Per document: counts by status of captions, tables, headings and cells, hard failures (missing tables or headings), and the verdict."""
    c = captions.groupBy("doc").agg(*[F.count_if(F.col("status") == s).alias(f"captions_{s}") for s in ("match", "near", "missing")])
    t = tables.groupBy("doc").agg(F.count("*").alias("tables_found"))
    h = headings.groupBy("doc").agg(F.count_if("present").alias("headings_found"), F.count_if(~F.col("present")).alias("headings_missing"))
    x = cells.groupBy("doc").agg(F.count_if(F.col("status") == "match").alias("cells_match"), F.count_if(F.col("status").isin("wrong", "missing")).alias("cells_bad"))
    out = c.join(t, "doc", "full").join(h, "doc", "full").join(x, "doc", "full").fillna(0)
    out = out.withColumn("hard_fail", F.col("headings_missing") + F.col("captions_missing"))
    return out.withColumn("verdict", F.when(F.col("hard_fail") > 0, "fail").when((F.col("cells_bad") > 0) | (F.col("captions_near") > 0), "review").otherwise("pass"))


def review_queue(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """Blocks by rising confidence, those not measured last, numbered per document."""
    order = Window.partitionBy("doc").orderBy(F.coalesce("confidence", F.lit(1.0)), "page", "ord")
    out = blocks.withColumn("place", F.row_number().over(order))
    return out if most is None else out.filter(F.col("place") <= most)


def bad_cells(items: DataFrame, most: int = 40) -> DataFrame:
    """The first cells of each document that do not match."""
    order = Window.partitionBy("doc").orderBy("tbl", "row", "col")
    return items.filter(F.col("status").isin("wrong", "missing")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def longest_candidate(blocks: DataFrame, lines: DataFrame, share: float = 0.65) -> DataFrame:
    """(doc, id, text): for each block the longest recognised line of its page that its text holds, at least ``share`` as long."""
    b, c = blocks.alias("b"), lines.alias("c")
    hit = b.join(c, F.expr("b.doc = c.doc and b.page = c.page")).filter(F.contains("b.text", "c.text") & (F.length("c.text") >= share * F.length("b.text")))
    return hit.groupBy("b.doc", "b.id").agg(F.max_by("c.text", F.struct(F.length("c.text"), "c.text")).alias("text"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, risk: Column | None = None, seed: int = 7) -> DataFrame:
    """A sample of n rows: every row at risk, the rest by strata in proportion (largest remainder), picked by the order of a hash of key and seed."""
    marked = df.withColumn("_risk", F.coalesce(risk, F.lit(False)) if risk is not None else F.lit(False))
    rest = marked.filter("not _risk")
    taken = marked.filter("_risk").agg(F.count("*").alias("r"))
    size = rest.groupBy(stratum).agg(F.count("*").alias("k"))
    left = F.greatest(F.lit(n) - F.col("r"), F.lit(0))
    size = size.join(F.broadcast(taken), F.lit(True)).join(F.broadcast(size.agg(F.sum("k").alias("all"))), F.lit(True)).withColumn("left", F.least(left, F.col("all")))
    share = size.withColumns({"base": F.floor(F.col("left") * F.col("k") / F.col("all")), "rem": (F.col("left") * F.col("k")) % F.col("all")})
    whole = Window.partitionBy()
    share = share.withColumn("extra", F.row_number().over(whole.orderBy(F.desc("rem"), stratum)) <= F.col("left") - F.sum("base").over(whole))
    share = share.select(F.col(stratum).alias("_s"), (F.col("base") + F.col("extra").cast("int")).alias("_take"))
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    picked = rest.withColumn("_n", F.row_number().over(order)).join(F.broadcast(share), F.col(stratum).eqNullSafe(F.col("_s"))).filter("_n <= _take").select(df.columns)
    return marked.filter("_risk").select(df.columns).unionByName(picked)


def symbol_survival(truth: DataFrame, actual: DataFrame, symbols: list[str]) -> DataFrame:
    """(symbol, expected, found, rate) of symbols counted in both texts of each document, and '*' for all."""
    n = lambda c: F.array(*[F.struct(F.lit(s).alias("symbol"), (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))).alias("n")) for s in symbols])
    t = truth.select("doc", F.explode(n(F.col("text"))).alias("x")).select("doc", "x.symbol", F.col("x.n").alias("expected"))
    a = actual.select("doc", F.explode(n(F.col("text"))).alias("x")).select("doc", "x.symbol", F.col("x.n").alias("found"))
    both = t.join(a, ["doc", "symbol"], "left").fillna(0, ["found"]).withColumn("found", F.least("found", "expected"))
    out = both.rollup("symbol").agg(F.sum("expected").alias("expected"), F.sum("found").alias("found"))
    return out.select(F.coalesce("symbol", F.lit("*")).alias("symbol"), "expected", "found", F.bround(F.try_divide("found", "expected"), 4).alias("rate"))


def run_report(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per paper: stages done, tokens, mean and longest wall time, findings and those with a hedge."""
    r = runs.groupBy("doc").agg(F.countDistinct("stage").alias("stages"), F.sum("tokens").alias("tokens"), F.bround(F.avg("seconds"), 3).alias("mean_s"), F.max("seconds").alias("longest_s"))
    f = findings.groupBy("doc").agg(F.count("*").alias("findings"), F.count_if(F.size(hedges(F.col("statement"))) > 0).alias("hedged"), F.countDistinct("statement_type").alias("types"))
    return r.join(f, "doc", "left").fillna(0, ["findings", "hedged", "types"])


def order_score(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc, page, score): longest common subsequence of two orders of block ids over the length of the expected one."""
    e = expected.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("e"))
    a = actual.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("a"))

    @F.pandas_udf("double")
    def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
        import bisect

        out = []
        for u, v in zip(x, y):
            at: dict = {}
            for i, k in enumerate(v if v is not None else []):
                at.setdefault(k, []).append(i)
            ends: list[int] = []
            for k in u:
                for i in reversed(at.get(k, [])):
                    p = bisect.bisect_left(ends, i)
                    ends[p : p + 1] = [i]
            out.append(len(ends) / len(u) if len(u) else 1.0)
        return pd.Series(out)

    return e.join(a, ["doc", "page"], "left").select("doc", "page", F.bround(lcs("e", "a"), 4).alias("score"))


def golden_verdicts(rows: DataFrame) -> DataFrame:
    """Golden records (id, stage, claim, quote) as verdicts: the stage's verdict, the hedges of claim and quote, whether it belongs in the ledger."""
    verdicts = {"verbatim": "verbatim_exact", "near": "near_match", "unsupported": "unsupported"}
    v = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv]), F.col("stage")), F.col("stage"))
    c, q = hedges(F.col("claim")), hedges(F.col("quote"))
    return rows.select("id", v.alias("verdict"), F.array_join(c, ",").alias("claim_hedges"), F.array_join(q, ",").alias("quote_hedges"), ((v == "unsupported") | (F.size(F.array_except(q, c)) > 0)).alias("in_ledger"))


def classified(texts: DataFrame, keywords: dict[str, list[str]], key: str = "doc", text: str = "text") -> DataFrame:
    """(key, document_type, confidence): the class with most of its keywords in the text, of equal ones the earlier; auto for none or a single hit."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = [sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in keywords.values()]
    scores = F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, h) in enumerate(zip(keywords, hits))])
    total = F.aggregate(scores, F.lit(0), lambda s, x: s + x["n"])
    best = F.array_max(scores)
    known = total > 1
    return texts.select(F.col(key), F.when(known, best["t"]).otherwise("auto").alias("document_type"), F.when(known, F.bround(best["n"] / total, 3)).otherwise(0.0).alias("confidence"), total.alias("hits"))


# Keywords of the document classes in order.
KEYWORDS = {
    "invoice": ["invoice", "bill to", "invoice number", "tax id"],
    "receipt": ["receipt", "thank you", "subtotal", "payment"],
    "id_card": ["identity", "date of birth", "driver license", "driver's license", "drivers license", "driver licence", "driver's licence", "driving licence", "driving license", "passport"],
    "bank_card": ["card number", "valid thru", "credit card", "debit"],
    "passport": ["passport", "nationality", "mrz"],
    "coi": ["certificate of liability insurance", "this certificate is issued as a matter of information only", "certificate holder", "affording coverage", "acord 25"],
    "pico": ["randomized", "controlled trial", "placebo", "double-blind", "primary outcome"],
}
