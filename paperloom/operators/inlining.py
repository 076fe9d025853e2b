"""Nested records to related flat tables by shared inlining.

The schema graph of all records is analysed first: its nodes are the labels of objects, its edges say which label
occurs inside which, how often, and whether repeated. A label gets a table of its own when it is repeated (an array
of objects or an object keyed by positions), shared (inside two different labels) or recursive; every other
descendant is a singleton and is inlined into the nearest table above it under a dotted column name. The graph also
notes which values stand under which label and of what kind they are, so it gives the typed columns of every table
(``flat_tables``); nothing is named by hand.

Defined results: null, empty and unreadable records give no rows. A lone object where others hold an array is an
array of one. A string that holds an encoded object or array counts as that object wherever the label is an object
in any record. Null elements of an array keep their position but give no row. Columns of the input other than the
key and the JSON column are ignored, whatever their names. Repeated record keys give repeated rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct (parent, child) label pairs and (label, value) pairs a schema may have; the graph is the only thing that reaches the
#: driver. Records with more have data in their keys; they are refused with an error that says so, never cut.
MAX_EDGES = 20_000
ROOT = ""


@dataclass
class SchemaGraph:
    """Labels that are objects, and those among them that need a table."""

    compound: set[str] = field(default_factory=set)
    tables: set[str] = field(default_factory=set)
    edges: dict[tuple[str, str], dict[str, int]] = field(default_factory=dict)
    values: dict[tuple[str, str], set[str]] = field(default_factory=dict)

    def columns(self, label: str) -> dict[str, str]:
        """Dotted path and SQL type of all values inlined into the table of a label, in order of their names."""
        out: dict[str, str] = {}
        todo = [(label, "", frozenset([label]))]
        while todo:
            at, path, above = todo.pop()
            for (owner, name), kinds in self.values.items():
                if owner == at and name not in self.tables and not (name in self.compound and kinds == {"text"}):
                    out[path + name] = _sql_type(kinds | ({"text"} if path + name in out else set()))
            todo += [(c, f"{path}{c}.", above | {c}) for p, c in self.edges if p == at and c not in self.tables and c not in above]
        return dict(sorted(out.items()))


def _sql_type(kinds: set[str]) -> str:
    return "bigint" if kinds == {"whole"} else "double" if kinds <= {"whole", "real"} else "boolean" if kinds == {"truth"} else "string"


def _decoded(value: str):
    s = value.strip()
    if s[:1] in ("{", "["):
        try:
            out = json.loads(s)
        except ValueError:
            return None
        if isinstance(out, (dict, list)):
            return out
    return None


def _record(text):
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return _decoded(value) if isinstance(value, str) else value


def _positional(value: dict) -> bool:
    return bool(value) and all(k.isdigit() for k in value) and any(isinstance(v, (dict, list)) for v in value.values())


def _elements(value) -> tuple[list, bool]:
    """The objects under a label in record order, and whether they were written as a repetition."""
    if isinstance(value, list):
        return value, any(isinstance(x, (dict, list)) for x in value)
    if isinstance(value, dict):
        return (list(value.values()), True) if _positional(value) else ([value], False)
    return [], False


def _rooted(record, root_label: str, listed: bool):
    """Where the column nominally holds an array (``listed``), a lone object or positional map is that array."""
    if listed and isinstance(record, dict) and record and root_label not in record:
        return _elements(record)[0]
    return record


_KINDS = {bool: "truth", int: "whole", float: "real", str: "text"}


def _walk_edges(record, root_label: str, out: dict, values: bool = True) -> None:
    def note(parent, child, kind):
        slot = out.setdefault((parent, child), [0, 0, 0])
        slot[kind] += 1

    stack = [(ROOT, root_label, record)] if isinstance(record, list) else [(None, ROOT, record)]
    while stack:
        parent, label, value = stack.pop()
        encoded = isinstance(value, str)
        if encoded:
            value = _decoded(value)
            if value is None:
                continue
        elements, repeated = _elements(value)
        objects = [x for x in elements if isinstance(x, dict)]
        if parent is not None and objects:
            note(parent, label, 2 if encoded else (1 if repeated else 0))
        for obj in objects:
            for k, v in obj.items():
                kind = _KINDS.get(type(v))
                if kind is None or kind == "text" and v[:1] in ("{", "["):
                    if v is not None:
                        stack.append((label, k, v))
                    if kind is None and not (type(v) is list and v and not any(isinstance(x, dict) for x in v)):
                        continue
                    kind = "text"
                if values and (label, k, kind) not in out:
                    out[label, k, kind] = [1]


def schema_graph(df: DataFrame, json_col: str, root_label: str, listed: bool = False, values: bool = True) -> SchemaGraph:
    """The label graph of all records. One distributed pass; edges are counted in the tasks before the shuffle.

    Without ``values`` it holds the labels alone, as far as tables and links need.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            for text in pdf["j"]:
                record = _rooted(_record(text), root_label, listed)
                if isinstance(record, (dict, list)):
                    _walk_edges(record, root_label, seen, values)
        edges_ = [(*x, None, *n) for x, n in seen.items() if len(x) == 2]
        yield pd.DataFrame(edges_ + [(*x, 0, 0, 0) for x in seen if len(x) == 3], columns=["parent", "child", "kind", "lone", "repeated", "encoded"])

    counted = (
        df.select(F.col(json_col).cast("string").alias("j"))
        .mapInPandas(edges, "parent string, child string, kind string, lone long, repeated long, encoded long")
        .groupBy("parent", "child", "kind")
        .agg(F.sum("lone").alias("lone"), F.sum("repeated").alias("repeated"), F.sum("encoded").alias("encoded"))
    )
    rows = counted.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} different label pairs: keys look like data, not like a schema")
    graph = SchemaGraph()
    parents: dict[str, set[str]] = {}
    for r in rows:
        if r.kind is not None:
            graph.values.setdefault((r.parent, r.child), set()).add(r.kind)
    rows = [r for r in rows if r.kind is None]
    for r in rows:
        if r.lone or r.repeated:
            graph.compound.add(r.child)
    for r in rows:
        if r.child in graph.compound:
            graph.edges[(r.parent, r.child)] = {"lone": r.lone, "repeated": r.repeated, "encoded": r.encoded}
            parents.setdefault(r.child, set()).add(r.parent)
            if r.repeated:
                graph.tables.add(r.child)
    graph.tables |= {c for c, ps in parents.items() if len(ps) > 1}
    graph.tables |= {c for c in graph.compound if _recursive(c, graph.edges)}
    return graph


def _recursive(label: str, edges) -> bool:
    seen, todo = set(), [c for p, c in edges if p == label]
    while todo:
        x = todo.pop()
        if x == label:
            return True
        if x not in seen:
            seen.add(x)
            todo += [c for p, c in edges if p == x]
    return False


def singular(label: str) -> str:
    return label[:-1] if len(label) > 3 and label.endswith("s") and not label.endswith("ss") else label


def _shred(record, root_label: str, graph: SchemaGraph, attributes: bool | frozenset[str], out: list, entities: frozenset[str] | None = None) -> None:
    """Rows (label, node, parent label, parent node, attributes) of one record, without recursion on the stack."""
    stack: list = []

    def enter(label, value, parent_label, parent_node, counters):
        elements, _ = _elements(value)
        for x in elements:
            at = counters.get(label, 0)
            counters[label] = at + 1
            if isinstance(x, dict):
                node = f"{parent_node}.{at}" if parent_node else str(at)
                stack.append((label, x, parent_label, parent_node, node))

    def inline(obj, prefix, attrs, label, node, counters):
        todo = [(obj, prefix)]
        while todo:
            value, path = todo.pop()
            for k, v in value.items():
                if isinstance(v, str) and k in graph.compound and (d := _decoded(v)) is not None:
                    v = d
                if k in graph.tables and isinstance(v, (dict, list)):
                    enter(k, v, label, node, counters)
                elif isinstance(v, dict):
                    todo.append((v, f"{path}{k}."))
                elif attributes and v is not None and (attributes is True or path + k in attributes):
                    attrs[path + k] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    if isinstance(record, dict):
        attrs: dict = {}
        inline(record, "", attrs, ROOT, "", {})
        if attributes:
            out.append((ROOT, "", None, None, attrs))
    else:
        enter(root_label, record, ROOT, "", {})
    while stack:
        label, obj, parent_label, parent_node, node = stack.pop()
        attrs = {}
        inline(obj, "", attrs, label, node, {})
        if entities is None or label in entities:
            out.append((label, node, parent_label, parent_node, attrs if attributes else None))


def shred(df: DataFrame, key: str, json_col: str, root_label: str, graph: SchemaGraph | None = None, attributes: bool | frozenset[str] = True, listed: bool = False, entities: frozenset[str] | None = None) -> DataFrame:
    """All objects of all tables in long form: key, entity, node, parent_entity, parent, attrs.

    (key, node) of entity is its primary key and (key, parent) of parent_entity the foreign key. Narrow: one pass over
    the records, no shuffle. ``attributes=False`` leaves the inlined values out where only the links are wanted, a set of paths all but
    those; ``entities`` names the labels whose rows are wanted.
    """
    graph = graph or schema_graph(df, json_col, root_label, listed, values=False)
    kind = df.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["k", "entity", "node", "parent_entity", "parent", "attrs"]
        for pdf in batches:
            buffer: list = []
            for k, text in zip(pdf["k"], pdf["j"]):
                record = _rooted(_record(text), root_label, listed)
                if not isinstance(record, (dict, list)):
                    continue
                found: list = []
                _shred(record, root_label, graph, attributes, found, entities)
                buffer += [(k, singular(e) if e else "record", n, p and singular(p), q, a) for e, n, p, q, a in found]
                if len(buffer) > 20_000:
                    yield pd.DataFrame(buffer, columns=columns)
                    buffer = []
            yield pd.DataFrame(buffer, columns=columns)

    out = df.select(F.col(key).alias("k"), F.col(json_col).cast("string").alias("j")).mapInPandas(
        rows, f"k {kind}, entity string, node string, parent_entity string, parent string, attrs map<string,string>"
    )
    return out.withColumnRenamed("k", key)


def column_names(paths: list[str], taken: tuple[str, ...]) -> dict[str, str]:
    """A column name for every dotted path: dots become underscores, names that clash get a number."""
    used, out = {x.lower() for x in taken}, {}
    for path in paths:
        name = base = path.replace(".", "_") or "value"
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out[path] = name
    return out


def entity_table(rows: DataFrame, entity: str, columns: dict[str, str], key: str = "record_id") -> DataFrame:
    """One flat table out of the long form: the keys, and the inlined values by path and type. A value its type cannot hold is null."""
    names = column_names(list(columns), (key, "node", "parent_entity", "parent"))
    return rows.filter(F.col("entity") == entity).select(
        key, "node", "parent_entity", "parent", *[F.col("attrs").getItem(c).try_cast(t).alias(names[c]) for c, t in columns.items()]
    )


def flat_tables(df: DataFrame, key: str, json_col: str, root_label: str, listed: bool = False) -> dict[str, DataFrame]:
    """Every kind of object that has a table of its own → its flat table with typed columns, all out of the schema graph."""
    graph = schema_graph(df, json_col, root_label, listed)
    rows = shred(df, key, json_col, root_label, graph, listed=listed)
    return {singular(label): entity_table(rows, singular(label), graph.columns(label), key) for label in sorted(graph.tables)}
