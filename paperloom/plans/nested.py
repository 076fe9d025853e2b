"""Queries over nested records (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inlining import flat_tables, schema_graph, shred
from ..session import load


def _both(spark: SparkSession, d: str, attributes: bool) -> list[tuple[str, DataFrame]]:
    envelopes = load(spark, d, "envelopes").select("record_id", "envelope")
    jobs = load(spark, d, "batch_jobs").select("record_id", "tasks")
    return [
        ("envelopes", shred(envelopes, "record_id", "envelope", "pages", attributes=attributes)),
        ("batch_jobs", shred(jobs, "record_id", "tasks", "tasks", attributes=attributes, listed=True)),
    ]


WANTED = {"envelopes": ["page", "block", "cell", "provenance"], "batch_jobs": ["task", "item"]}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per page, block, cell, provenance, task and item with the way to its parent."""
    parts = [
        rows.filter(F.col("entity").isin(WANTED[tbl])).select(F.lit(tbl).alias("tbl"), "record_id", "entity", "node", F.coalesce("parent", F.lit("")).alias("parent"))
        for tbl, rows in _both(spark, d, False)
    ]
    # records are unique, so are (record, entity, node): no distinct, no shuffle
    return parts[0].unionByName(parts[1])


def _table(spark: SparkSession, d: str, tbl: str, entity: str) -> DataFrame:
    """The flat table of one kind of object; with its keys alone where the records hold none."""
    column, root = ("envelope", "pages") if tbl == "envelopes" else ("tasks", "tasks")
    tables = flat_tables(load(spark, d, tbl).select("record_id", column), "record_id", column, root, listed=tbl == "batch_jobs")
    return tables[entity] if entity in tables else spark.createDataFrame([], "record_id long, node string, parent_entity string, parent string")


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of pages."""
    return _table(spark, d, "envelopes", "page")


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of blocks with their inlined payload and the key of their page."""
    return _table(spark, d, "envelopes", "block")


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of table cells with the key of their block."""
    return _table(spark, d, "envelopes", "cell")


def p4_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of provenance entries with the key of their block."""
    return _table(spark, d, "envelopes", "provenance")


def p4_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of tasks with their inlined results."""
    return _table(spark, d, "batch_jobs", "task")


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of line items with the key of their task."""
    return _table(spark, d, "batch_jobs", "item")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table and entity: the size of every relation the records turn into."""
    parts = [rows.groupBy(F.lit(tbl).alias("tbl"), "entity", "parent_entity").agg(F.count("*").alias("n_rows")) for tbl, rows in _both(spark, d, False)]
    return parts[0].unionByName(parts[1])


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, entity, path, type) of every column the schema graph gives the flat tables."""
    out = []
    for tbl, column, root in (("envelopes", "envelope", "pages"), ("batch_jobs", "tasks", "tasks")):
        graph = schema_graph(load(spark, d, tbl), column, root, tbl == "batch_jobs")
        out += [(tbl, label, path, kind) for label in sorted(graph.tables) for path, kind in graph.columns(label).items()]
    return spark.createDataFrame(out, "tbl string, entity string, path string, type string")


QUERIES = {"p4_found": p4_found, "p4_pages": p4_pages, "p4_blocks": p4_blocks, "p4_cells": p4_cells, "p4_provenance": p4_provenance, "p4_tasks": p4_tasks, "p4_items": p4_items, "p4_entities": p4_entities, "p4_columns": p4_columns}
