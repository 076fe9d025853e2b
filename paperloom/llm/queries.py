"""Queries of problems 1 to 3 and 5 to 8 with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inlining import shred
from ..session import cut, load
from . import addresses, leakage, lookalikes, mixing, pii, scans, subjects

SQL: dict[str, str] = {}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of address records of one location."""
    pairs = addresses.same_location_pairs(load(spark, d, "address_values"))
    return pairs.select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every address record with the class of its location and the number of its links: the other records of the class."""
    classes = cut(addresses.address_classes(load(spark, d, "address_values")))
    return classes.join(addresses.class_sizes(classes), "location").select("address_id", "location", (F.col("n_records") - 1).alias("n_links"))


def _review_strings(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, label, text): every string inside the review payloads with the name of its field."""
    rows = load(spark, d, "hitl_reviews").filter("length(payload) > 0").select(F.col("review_id").alias("rec_id"), "payload").distinct()

    def strings(batches):
        import pandas as pd

        from .pii_train import review_strings

        for pdf in batches:
            yield pd.DataFrame([(r, k, v) for r, p in zip(pdf["rec_id"], pdf["payload"]) for k, v in review_strings(p)], columns=["rec_id", "label", "text"])

    return rows.mapInPandas(strings, "rec_id string, label string, text string")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Names, mail addresses, telephone numbers, identity numbers and street addresses as written."""
    docs = pii.personal_spans(load(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")
    docs = docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "kind", "pii_value")
    reviews = pii.personal_spans(_review_strings(spark, d), ["rec_id"], "text", "label")
    return docs.unionByName(reviews.select(F.lit("hitl_reviews").alias("tbl"), "rec_id", "kind", "pii_value")).distinct()


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, text): documents and review payloads with typed placeholders for personal information."""
    docs = pii.masked(load(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), "text"), "text")
    reviews = load(spark, d, "hitl_reviews").select(F.lit("hitl_reviews").alias("tbl"), F.col("review_id").alias("rec_id"), F.col("payload").alias("text"))
    return docs.unionByName(pii.masked_json(reviews, "text"))


NAMES = ("seller_name", "buyer_name", "invoice_number")


def _kie_values(spark: SparkSession, d: str) -> DataFrame:
    """(task_id, field_name, value) of the compared fields of task results."""
    fields = F.from_json(F.get_json_object("result", "$.kie_fields"), "map<string,string>")
    tasks = load(spark, d, "batch_tasks").filter("result is not null").select("task_id", fields.alias("f"))
    return tasks.select("task_id", F.explode(F.map_filter("f", lambda k, v: k.isin(*NAMES) & v.isNotNull())).alias("field_name", "value"))


def scanned_records(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, parts): documents as one part, envelopes as one part per block in order of the record."""
    part = "array<struct<node:string,page:int,text:string>>"
    docs = load(spark, d, "documents").filter("length(text) > 0").select(
        F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"),
        F.array(F.struct(F.lit("").alias("node"), F.lit(None).cast("int").alias("page"), F.col("text"))).cast(part).alias("parts"),
    )
    rows = shred(load(spark, d, "envelopes").select("record_id", "envelope"), "record_id", "envelope", "pages", attributes=frozenset(["payload.text"]), entities=frozenset(["blocks"]))
    text = F.col("attrs").getItem("payload.text")
    at = F.split("node", "[.]")
    blocks = rows.filter((F.col("entity") == "block") & (F.length(text) > 0)).select(
        "record_id", F.struct(at[0].cast("int").alias("page"), at[1].cast("int").alias("no"), "node", text.alias("text")).alias("b")
    )
    # read three times over, so the small parsed side is kept in the shared folder
    parts = cut(blocks.groupBy("record_id").agg(F.array_sort(F.collect_list("b")).alias("b")))
    envelopes = parts.select(
        F.lit("envelopes").alias("tbl"), F.col("record_id").cast("string").alias("rec_id"), F.expr("transform(b, x -> struct(x.node as node, x.page as page, x.text as text))").cast(part).alias("parts")
    )
    return docs.unionByName(envelopes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines with broken words, misread characters, running headers and page numbers."""
    return scans.defects(scanned_records(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Documents and envelopes as continuous readable paragraphs."""
    return scans.repaired(scanned_records(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and task fields with a character that must change; names with the party they then equal."""
    docs = lookalikes.changed_rows(load(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")
    docs = docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), F.lit("text").alias("field_name"), F.lit("").alias("ref_id"))
    values = _kie_values(spark, d).distinct()
    script = F.when(F.col("field_name") == "invoice_number", "L").otherwise(lookalikes.text_script(F.col("_t")))
    values = values.withColumn("key", F.sha2(F.concat_ws("|", "task_id", "field_name", "value"), 256))
    suspects = values.filter(F.col("value").rlike(lookalikes.SUSPECT)).withColumn("canon", F.col("value"))
    words = lookalikes.exploded_words(suspects, ["key", "field_name"], "value", script)
    changed = lookalikes.rebuilt(suspects, ["key"], "canon", words, lookalikes.canonical_words(words)).filter("canon <> value")
    squeeze = lambda c: F.trim(F.regexp_replace(c, " +", " "))
    parties = load(spark, d, "parties").select(F.col("party_id").cast("string").alias("party"), squeeze(F.col("party_name")).alias("name"))
    named = changed.withColumn("name", F.when(F.col("field_name") != "invoice_number", squeeze(F.col("canon")))).join(parties, "name", "left")
    named = named.select(F.lit("batch_tasks").alias("tbl"), F.col("task_id").alias("rec_id"), "field_name", F.coalesce("party", F.lit("")).alias("ref_id")).distinct()
    return docs.unionByName(named)


def p3_normalized(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, field_name, text): documents and the compared fields of task results in the one form."""
    docs = lookalikes.normalized(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    docs = docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), F.lit("text").alias("field_name"), "text")
    values = _kie_values(spark, d).distinct().withColumn("key", F.sha2(F.concat_ws("|", "task_id", "field_name", "value"), 256)).withColumn("text", F.col("value"))
    script = F.when(F.col("field_name") == "invoice_number", "L").otherwise(lookalikes.text_script(F.col("_t")))
    words = cut(lookalikes.exploded_words(values, ["key", "field_name"], "value", script))
    fields = lookalikes.rebuilt(values, ["key"], "text", words, lookalikes.canonical_words(words))
    return docs.unionByName(fields.select(F.lit("batch_tasks").alias("tbl"), F.col("task_id").alias("rec_id"), "field_name", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry held-out passages, with the items."""
    return leakage.leaked_items(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "eval_items").select("item_id", "text"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of each suite with the number of documents that carry them."""
    items = load(spark, d, "eval_items").select("item_id", "suite")
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs")).join(items, "item_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a target source with its tokens, rate and copies in the mix."""
    return mixing.mixed(load(spark, d, "documents").select("doc_id", "source", "text"), load(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mix reaches."""
    return mixing.mix_report(p7_mix(spark, d), load(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty document with the subjects it deals with."""
    return subjects.document_subjects(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "subject_labels"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by subject."""
    docs = load(spark, d, "documents").select("doc_id", F.col("n_chars").alias("chars"))  # the stored length: texts are read once
    return p8_found(spark, d).join(docs, "doc_id").groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("chars").alias("n_chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p3_found": p3_found,
    "p3_normalized": p3_normalized,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}
