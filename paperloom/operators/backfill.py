"""Cell backfill: the text layer of a page confirms, corrects or contradicts what recognition read in the cells of a table.

``tables`` (doc, page, tbl, x0, y0, x1, y1 in pixels at twice the page size, n_rows, n_cols), ``words`` (doc, page, block,
line, word_no, x0, y0, x1, y1 in points, text) and ``cells`` (doc, page, tbl, row, col, text). No step compares all words of a page with
all its cells: a word finds its cells by arithmetic on the grid and brings them all that is read there, one row per word and cell, and
cells and words meet in one sort by cell. Relations that come in by page stay where they are: tables are joined on the page, windows
name its keys, and the union of words and cells keeps one column by page (table, row and column in a struct), as Spark does not see
that two sides of a union are parted alike where a second column repeats the key.

Defined results: cells that are no candidates keep their text with provenance ``vision`` and no reason; tables without words
turn every candidate into a mismatch; null texts are no candidates; equal words at one place are separate words; equal places of cells
are judged each by itself; words with one number in a line follow each other from left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from .geometry import cell_rect

# Fixed values.
PAD, RUN, COLUMN_GAP = 8.0, 4, 6.0
SYMBOLS = ["✓", "⊗", "●", "○"]
NUMBER, DATE, CODE = r"^[+\-]?[¥$€£]?\s?\d[\d,.\s]*%?$", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", r"^[A-Za-z0-9\s\-/._]+$"
CONFUSION_PAIRS = [("0", "O"), ("0", "o"), ("1", "l"), ("1", "I"), ("1", "i"), ("5", "S"), ("5", "s"), ("8", "B"), ("6", "b"), ("6", "G"), ("9", "g"), ("9", "q"), ("2", "Z"), ("2", "z"), ("✓", "√"), ("●", "•"), ("×", "x")]
REASONS = ["value_match", "geometric", "cluster", "sanity_reject", "no_aligned_line", "crossing", "multi_line", "shape_mismatch", "band_range_incomplete"]
KEY = ["doc", "page", "tbl"]


def comparable(c: Column) -> Column:
    """The form for comparison, without Python."""
    return strings.comparable(c, strings.nfkc_in_place)


def is_candidate(c: Column) -> Column:
    """Whether a cell can be checked: at most 40 characters that are a symbol, a number, a date or a code with a digit."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & (F.length(t) <= 40) & (t.isin(SYMBOLS) | t.rlike(NUMBER) | t.rlike(DATE) | (t.rlike(CODE) & t.rlike(r"\d")))


def _near(a: Column, b: Column, cap: Column) -> Column:
    """Whether two texts of one length differ in at most ``cap`` places, all of them confusion pairs."""
    pairs = sorted({x + y for p in CONFUSION_PAIRS for x, y in (p, p[::-1])})
    bad = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).when(F.concat(x, y).isin(pairs), 1).otherwise(99))
    return F.aggregate(bad, F.lit(0), lambda s, x: s + x) <= cap


def is_confusion(a: Column, b: Column) -> Column:
    """Whether two comparable texts read the same but for recognition: one replaced character up to length 6, two beyond, and one more or fewer
    character at the end or else the beginning."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    cap = F.when(F.length(longer) <= 6, 1).otherwise(2)
    n = F.length(longer)
    return F.when((a == "") | (b == "") | (F.abs(F.length(a) - F.length(b)) > 1), F.lit(False)).when(F.length(a) == F.length(b), _near(a, b, cap)).otherwise(
        _near(F.substring(longer, F.lit(1), n - 1), shorter, cap) | _near(F.substring(longer, F.lit(2), n - 1), shorter, cap)
    )


def band_range(c: Column) -> Column:
    """(start, end, unit) of a frequency range such as "40.66 - 40.7 MHz"; null where the text is none."""
    t = F.regexp_replace(F.trim(c), r"(?<=\d)[ \t]+(?=\d)", "")
    pattern = r"(?i)^([+-]?\d+(?:\.\d+)?)\s*-\s*([+-]?\d+(?:\.\d+)?)\s*(mhz|ghz|khz|hz)$"
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in {"mhz": "MHz", "ghz": "GHz", "khz": "kHz", "hz": "Hz"}.items() for x in kv]), F.lower(F.regexp_extract(t, pattern, 3)))
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).cast("double").alias("start"), F.regexp_extract(t, pattern, 2).cast("double").alias("end"), unit.alias("unit")))


def band_flags(c: Column) -> Column:
    """What is wrong with a frequency range: negative_value, non_finite, start_gt_end, magnitude_gap (over two decades); empty otherwise."""
    b = band_range(c)
    infinite = F.lit(float("inf"))
    finite = (F.abs(b["start"]) < infinite) & (F.abs(b["end"]) < infinite)
    gap = finite & (b["start"] > 0) & (b["end"] > 0) & (F.abs(F.log10(b["start"]) - F.log10(b["end"])) > 2)
    rules = {"negative_value": (b["start"] < 0) | (b["end"] < 0), "non_finite": ~finite, "start_gt_end": b["start"] > b["end"], "magnitude_gap": gap}
    return F.array_compact(F.array(*[F.when(b.isNotNull() & wrong, F.lit(n)) for n, wrong in rules.items()]))


def words_in_boxes(words: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """Words whose centre lies in a box (bx0, by0, bx1, by1), edges included: an equi-join on the page with the box as residual."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.join(boxes, on).filter(cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1")))


def words_outside(words: DataFrame, boxes: DataFrame, on: list[str]) -> DataFrame:
    """Words whose centre lies in none of the boxes (bx0, by0, bx1, by1)."""
    w, b = words.alias("w"), boxes.alias("b")
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    inside = cx.between(F.col("b.bx0"), F.col("b.bx1")) & cy.between(F.col("b.by0"), F.col("b.by1"))
    return w.join(b, (F.expr(" and ".join(f"w.{k} = b.{k}" for k in on))) & inside, "left_anti")


def _points(tables: DataFrame) -> DataFrame:
    return tables.select(*KEY, *[(F.col(c) / 2).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")], "n_rows", "n_cols")


def neighbourhood(tables: DataFrame, words: DataFrame) -> DataFrame:
    """Words around each table: centre in its padded box and in no sibling table; ``inside`` tells those in the box itself."""
    t = _points(tables)
    near = words_in_boxes(words, t.select("*", (F.col("tx0") - PAD).alias("bx0"), (F.col("ty0") - PAD).alias("by0"), (F.col("tx1") + PAD).alias("bx1"), (F.col("ty1") + PAD).alias("by1")), ["doc", "page"])
    near = near.drop("bx0", "by0", "bx1", "by1")
    s = t.select("doc", "page", F.col("tbl").alias("other"), *[F.col(f"t{c}").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    w, b = near.alias("w"), s.alias("b")
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    out = w.join(b, F.expr("w.doc = b.doc and w.page = b.page and w.tbl <> b.other") & cx.between(F.col("b.bx0"), F.col("b.bx1")) & cy.between(F.col("b.by0"), F.col("b.by1")), "left_anti")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return out.withColumn("inside", cx.between(F.col("tx0"), F.col("tx1")) & cy.between(F.col("ty0"), F.col("ty1")))


def row_clusters(words: DataFrame, key: list[str], tolerance: Column) -> DataFrame:
    """Words with the number of their visual row: sorted by lower edge, a new row where it lies more than the tolerance below the last."""
    order = Window.partitionBy(*key).orderBy("y1", "x0", "word_no")
    before = words.withColumn("_b", F.lag("y1").over(order))  # first, so that a window in the tolerance finds the rows sorted
    jump = F.when(F.col("y1") - F.col("_b") > tolerance, 1).otherwise(0)
    return before.withColumn("_j", jump).withColumn("cluster", F.sum("_j").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_j")


def row_groups(words: DataFrame, key: list[str], gap: float = COLUMN_GAP) -> DataFrame:
    """Words with the number of their group in the row: a new one where a word begins ``gap`` or more right of all before it."""
    order = Window.partitionBy(*key, "cluster").orderBy("x0", "x1", "word_no")
    edge = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("_j", F.when(F.col("x0") - edge >= gap, 1).otherwise(0)).withColumn("grp", F.sum("_j").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def _steps(x: Column, low: Column, size: Column, n: Column) -> Column:
    """The whole number of steps from ``low`` to ``x``, kept within two beyond a grid of ``n``."""
    return F.greatest(F.lit(-2), F.least(n + 1, F.floor(F.try_divide(x - low, size)))).cast("int")


def _within(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, i))


def band_row(y0: Column, y1: Column, top: Column, bottom: Column, n: Column) -> Column:
    """The row of a uniform grid whose band overlaps a stretch most, of equal ones the first; the overlap may be negative."""
    h = F.try_divide(bottom - top, n)
    overlap = lambda i: F.struct((F.least(y1, top + (i + 1) * h) - F.greatest(y0, top + i * h)).alias("ov"), (-i).alias("neg"))
    each = F.transform(F.sequence(F.lit(0), n - 1), overlap)
    # a stretch no longer than a row overlaps at most two bands
    at = _steps(y0, top, h, n)
    few = F.greatest(*[overlap(_within(at + k, n)) for k in (-1, 0, 1, 2)])
    return F.when(n > 0, F.when((h > 0) & (y0 <= y1) & (y1 - y0 <= h), -few["neg"]).otherwise(-F.array_max(each)["neg"]))


def nearest_column(centre: Column, left: Column, right: Column, n: Column) -> Column:
    """The column of a uniform grid whose widened band holds a centre, the nearest of them, of equal ones the first; null for none."""
    w = F.try_divide(right - left, n)
    more = F.greatest(0.05 * (right - left), 0.6 * w)
    distance = lambda j: F.struct(F.abs(left + (j + 0.5) * w - centre).alias("d"), j.alias("j"))
    each = F.transform(F.sequence(F.lit(0), n - 1), distance)
    near = F.filter(each, lambda x: x["d"] <= w / 2 + more)
    at = _steps(centre, left, w, n)
    few = F.least(*[distance(_within(at + k, n)) for k in (-1, 0, 1)])
    return F.when((n > 0) & (w > 0), F.when(few["d"] <= w / 2 + more, few["j"])).when((n > 0) & (F.size(near) > 0), F.array_min(near)["j"])


def grid_places(words: DataFrame, name: str, x: Column, low: Column, high: Column, n: Column) -> DataFrame:
    """``words`` with the first and, on an edge, the second row or column (``name``0, ``name``1) of a uniform grid that holds ``x``, edges included."""
    size = F.try_divide(high - low, n)
    holds = lambda i: i.between(0, n - 1) & x.between(low + i * size, low + (i + 1) * size)
    at, first = F.col(f"_{name}"), F.col(f"{name}0")
    out = words.withColumn(f"_{name}", F.when((n > 0) & (high > low), _steps(x, low, size, n)))
    out = out.withColumn(f"{name}0", F.when(holds(at - 1), at - 1).when(holds(at), at).when(holds(at + 1), at + 1))
    return out.withColumn(f"{name}1", F.when(holds(first + 1), first + 1)).drop(f"_{name}")


def layout_model(tables: DataFrame, words: DataFrame) -> DataFrame:
    """Words around each table with their row cluster, its table row, their group, its centre and table column."""
    return _arranged(neighbourhood(tables, words), KEY)


def _arranged(near: DataFrame, key: list[str]) -> DataFrame:
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY y1 - y0) OVER (PARTITION BY {', '.join(key)})")
    near = row_groups(row_clusters(near, key, F.greatest(F.lit(2.0), 0.5 * median)), key)
    c, g = Window.partitionBy(*key, "cluster"), Window.partitionBy(*key, "cluster", "grp")
    near = near.withColumns({"cy0": F.min("y0").over(c), "cy1": F.max("y1").over(c), "centre": (F.min("x0").over(g) + F.max("x1").over(g)) / 2})
    return near.withColumns({"trow": band_row(F.col("cy0"), F.col("cy1"), F.col("ty0"), F.col("ty1"), F.col("n_rows")), "tcol": nearest_column(F.col("centre"), F.col("tx0"), F.col("tx1"), F.col("n_cols"))})


def word_runs(words: DataFrame, key: list[str], most: int = RUN) -> DataFrame:
    """Runs of one to ``most`` words of a line: key, block, line, first, last (word numbers in the line), norm (comparable text) and the first word's columns."""
    order = Window.partitionBy(*key, "block", "line").orderBy("word_no")
    own = F.struct("word_no", "norm")
    ahead = F.array_compact(F.array(own, *[F.lead(own, i).over(order) for i in range(1, most)]))
    w = words.withColumn("norm", comparable(F.col("text"))).withColumn("_a", ahead)
    w = w.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_a"))))
    return w.withColumns({"first": F.col("word_no"), "last": F.element_at("_a", F.col("_n"))["word_no"], "norm": F.array_join(F.transform(F.slice("_a", F.lit(1), F.col("_n")), lambda x: x["norm"]), "")}).drop("_a", "_n")


def maximal_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """Runs that lie in no longer one of the same line and key."""
    line = Window.partitionBy(*key, "block", "line")
    begun = F.max(F.when(F.col("first").isNotNull(), F.col("last"))).over(line.orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    longest = F.max("last").over(Window.partitionBy(*key, "block", "line", "first"))
    return runs.withColumns({"_b": begun, "_l": longest}).filter(F.col("first").isNull() | F.col("last").isNull() | ~(F.coalesce(F.col("_b") >= F.col("last"), F.lit(False)) | (F.col("_l") > F.col("last")))).drop("_b", "_l")


def first_runs(words: DataFrame, key: list[str], most: int = RUN) -> DataFrame:
    """``words`` with ``runs``: the comparable texts of the runs of one to ``most`` words that begin with them and lie in no longer run of the same text.

    A longer run has the same text only by words without any, so it is enough to look at the words next to a run.
    """
    order = Window.partitionBy(*key, "block", "line").orderBy("word_no", "x0")
    out = words.withColumn("_n0", comparable(F.col("text")))
    out = out.withColumns({"_b": F.lag("_n0").over(order), **{f"_n{i}": F.lead("_n0", i).over(order) for i in range(1, most)}})
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(False))
    text, runs = F.col("_n0"), []
    for i in range(1, most + 1):
        longest = ~(empty("_b") | empty(f"_n{i}")) if i < most else F.lit(True)
        runs.append(F.when((text != "") & longest, text))
        text = F.concat(text, F.col(f"_n{i}")) if i < most else text
    return out.withColumn("runs", F.array_compact(F.array(*runs))).drop("_b", *[f"_n{i}" for i in range(most)])


def words_by_cell(tables: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, tbl, row, col, w): what each word says about each cell of the tables of its page.

    ``w.held``: its centre lies in the cell's rectangle; ``w.modelled``: it is near the table and its visual row and group stand for the cell,
    ``w.d`` being the distance of the group from the middle of the column and ``w.runs`` the texts that begin with the word.
    """
    points = _points(tables).filter("tbl is not null")
    t = points.groupBy("doc", "page").agg(F.collect_list(F.struct(*[c for c in points.columns if c not in ("doc", "page")])).alias("ts"))
    pairs = words.join(t.hint("shuffle_hash"), ["doc", "page"]).select(words["*"], "ts", F.explode("ts").alias("t"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    within = lambda b, pad: cx.between(b["tx0"] - pad, b["tx1"] + pad) & cy.between(b["ty0"] - pad, b["ty1"] + pad)
    other = F.coalesce(F.exists("ts", lambda s: (s["tbl"] != F.col("t.tbl")) & within(s, 0.0)), F.lit(False))
    pairs = pairs.withColumn("near", F.coalesce(within(F.col("t"), PAD) & ((F.size("ts") == 1) | ~other), F.lit(False)))
    # no cell reaches beyond the padded box, so what is neither near nor in it is in none
    pairs = pairs.filter(F.col("near") | within(F.col("t"), PAD)).select(*words.columns, "t.*", "near", within(F.col("t"), 0.0).alias("inside"))
    key = [*KEY, "near"]
    m = first_runs(_arranged(pairs, key), key)  # last, so that the windows of the layout stay together and share their sorts
    for name, x, low, high, n in (("r", cy, "ty0", "ty1", "n_rows"), ("c", cx, "tx0", "tx1", "n_cols")):
        m = grid_places(m, name, x, F.col(low), F.col(high), F.col(n))
    held = lambda r, c: F.when(F.col(r).isNotNull() & F.col(c).isNotNull(), F.struct(F.col(r).alias("row"), F.col(c).alias("col"), F.lit(True).alias("held"), F.lit(False).alias("modelled")))
    stands = F.when(F.col("near") & F.col("trow").isNotNull() & F.col("tcol").isNotNull(), F.struct(F.col("trow").alias("row"), F.col("tcol").alias("col"), F.lit(False).alias("held"), F.lit(True).alias("modelled")))
    one = F.col("near") & (F.col("trow") == F.col("r0")) & (F.col("tcol") == F.col("c0")) & F.col("r1").isNull() & F.col("c1").isNull()
    both = F.array(F.struct(F.col("trow").alias("row"), F.col("tcol").alias("col"), F.lit(True).alias("held"), F.lit(True).alias("modelled")))
    m = m.withColumn("at", F.explode(F.when(one, both).otherwise(F.array_compact(F.array(stands, *[held(r, c) for r in ("r0", "r1") for c in ("c0", "c1")])))))
    w, h, row, col = F.try_divide(F.col("tx1") - F.col("tx0"), F.col("n_cols")), F.try_divide(F.col("ty1") - F.col("ty0"), F.col("n_rows")), F.col("at.row"), F.col("at.col")
    whole = (F.col("x0") >= F.col("tx0") + col * w) & (F.col("y0") >= F.col("ty0") + row * h) & (F.col("x1") <= F.col("tx0") + (col + 1) * w) & (F.col("y1") <= F.col("ty0") + (row + 1) * h)
    middle = F.col("tx0") + F.try_divide((col + 0.5) * (F.col("tx1") - F.col("tx0")), F.col("n_cols"))
    line = F.when(F.col("block").isNotNull() & F.col("line").isNotNull(), F.struct("block", "line"))
    own = [F.when(F.col("at.held"), whole).alias("whole"), F.when(F.col("at.modelled"), F.abs(F.col("centre") - middle)).alias("d"), line.alias("line")]
    return m.select(*KEY, row.alias("row"), col.alias("col"), F.struct("at.held", "at.modelled", "inside", *own, "x0", "y0", "x1", "y1", "cy1", "word_no", "text", "runs").alias("w"))


def solved(tables: DataFrame, words: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with provenance, reason, the text they get, what recognition read (where it was replaced) and the box of their words.

    A cell is confirmed by value where one run in its row and column has its text, by the strictly nearest one where there are several;
    else by the words in its rectangle, else by the words that its row and column are made of.
    """
    rect = cell_rect(F.struct(*[(F.col(f"t{c}") * 2).alias(c) for c in ("x0", "y0", "x1", "y1")]), F.col("row"), F.col("col"), F.col("n_rows"), F.col("n_cols"))
    at, place = [*KEY, "row", "col"], ["tbl", "row", "col"]
    # no aliases, whose names would make the sides of the union differ
    own = _points(tables).withColumnsRenamed({"doc": "_doc", "page": "_page", "tbl": "_tbl"}).hint("shuffle_hash")
    every = cells.join(own, F.expr("doc = _doc and page = _page and tbl <= _tbl and tbl >= _tbl"), "left")
    every = every.select("doc", "page", F.struct(*place).alias("place"), F.struct(*[c for c in cells.columns if c not in at], comparable(F.col("text")).alias("norm"), is_candidate(F.col("text")).alias("asked"), rect.isNotNull().alias("shaped")).alias("c"))
    said = words_by_cell(tables, words).select("doc", "page", F.struct(*[F.col(c).cast(cells.schema[c].dataType).alias(c) for c in place]).alias("place"), "w")
    every, said = every.withColumn("w", F.lit(None).cast(said.schema["w"].dataType)), said.withColumn("c", F.lit(None).cast(every.schema["c"].dataType))
    s = every.unionByName(said).withColumn("ws", F.collect_list("w").over(Window.partitionBy("doc", "page", "place"))).filter("c is not null").select("doc", "page", "place.*", "c.*", "ws")

    cut = F.when(F.col("asked"), F.col("text").rlike("(?i)hz") & (F.size(band_flags(F.col("text"))) > 0))
    s = s.withColumn("cut", F.coalesce(cut, F.lit(False)))
    corners = ("x0", "y0", "x1", "y1")
    hits = F.filter("ws", lambda w: w["modelled"] & F.array_contains(w["runs"], F.col("norm")))
    s = s.withColumn("hits", F.when(F.col("asked") & ~F.col("cut"), F.transform(hits, lambda w: F.struct(w["d"].alias("d"), *[w[c].alias(c) for c in corners]))))
    n, least = F.size("hits"), F.array_min("hits")
    best = F.when(n == 1, F.col("hits")[0]).when((n > 1) & (F.size(F.filter("hits", lambda x: x["d"] <= least["d"])) == 1), least)
    s = s.withColumn("best", best).withColumn("open", F.col("asked") & ~F.col("cut") & F.col("best").isNull() & F.col("shaped"))
    # the words in the cell's rectangle, only where the value decides nothing
    box = lambda a: F.struct(*[F.bround(f(F.transform(a, lambda w: w[c])), 2).alias(c) for c, f in zip(corners, (F.array_min, F.array_min, F.array_max, F.array_max))])
    read = lambda a, order: F.array_join(F.transform(F.sort_array(F.transform(a, lambda w: F.struct(*[w[o].alias(o) for o in order], w["text"].alias("text")))), lambda w: w["text"]), " ")
    s = s.withColumn("g", F.when(F.col("open"), F.filter("ws", lambda w: w["held"])))
    lines = F.array_compact(F.transform("g", lambda w: w["line"]))
    one_line = F.coalesce(F.array_min(lines) == F.array_max(lines), F.lit(False))
    fails = F.when(F.size("g") == 0, "no_aligned_line").when(~F.forall("g", lambda w: w["whole"]), "crossing").when(~one_line, "multi_line")
    s = s.withColumn("fails", F.when(F.col("open"), fails))
    # the words of its row and column, only where those fail
    s = s.withColumn("k", F.when(F.col("fails").isNotNull(), F.filter("ws", lambda w: w["modelled"] & w["inside"])))
    s = s.withColumn("layer", F.when(F.col("fails").isNotNull(), read(F.col("k"), ["cy1", "x0", "word_no"])).when(F.col("open"), read(F.col("g"), ["x0", "word_no"])))
    s = s.withColumn("_t", F.when(F.col("open"), comparable(F.col("layer"))))
    say = lambda p, r: F.struct(F.lit(p).alias("provenance"), (r if isinstance(r, Column) else F.lit(r).cast("string")).alias("reason"))
    how = F.when(F.col("fails").isNull(), "geometric").otherwise("cluster")
    verdict = (
        F.when(~F.col("asked"), say("vision", None))
        .when(F.col("cut"), say("text_mismatch", "band_range_incomplete"))
        .when(F.col("best").isNotNull(), say("text_confirmed", "value_match"))
        .when(~F.col("shaped"), say("text_mismatch", "shape_mismatch"))
        .when(F.col("layer") == "", say("text_mismatch", F.coalesce(F.col("fails"), F.lit("no_aligned_line"))))
        .when(F.col("_t") == "", say("text_mismatch", "no_aligned_line"))
        .when(F.col("_t") == F.col("norm"), say("text_confirmed", how))
        .when(is_confusion(F.col("norm"), F.col("_t")), say("text_backfilled", how))
        .otherwise(say("text_mismatch", "sanity_reject"))
    )
    s = s.withColumn("v", verdict)
    s = s.withColumns({"provenance": F.col("v.provenance"), "reason": F.col("v.reason")})
    found = F.when(F.col("reason") == "value_match", F.struct(*[F.col(f"best.{c}").alias(c) for c in corners])).when(F.col("reason") == "geometric", box(F.col("g"))).when(F.col("reason") == "cluster", box(F.col("k")))
    filled = F.col("provenance") == "text_backfilled"
    return s.select(
        *at, *[F.when(filled, F.col("layer")).otherwise(F.col("text")).alias(c) if c == "text" else c for c in cells.columns if c not in at], "provenance", "reason",
        F.when(F.col("provenance").isin("text_confirmed", "text_backfilled"), found).alias("word_bbox"), F.when(filled, F.col("text")).alias("ocr_text"),
    )


def backfill_summary(cells: DataFrame, pages: DataFrame | None = None, most: int = 50) -> DataFrame:
    """Per document: candidates, confirmed, backfilled, mismatches, one count per reason (zeros kept), rates and the mismatches beyond the list."""
    c = cells.groupBy("doc").agg(
        F.count("*").alias("cells"), F.count_if(F.col("provenance") != "vision").alias("candidates"),
        *[F.count_if(F.col("provenance") == f"text_{p}").alias(p) for p in ("confirmed", "backfilled", "mismatch")],
        *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"reason_{r}") for r in REASONS],
    )
    rate = lambda n: F.bround(F.try_divide(n, F.col("candidates")), 3)
    out = c.withColumns({"confirmed_rate": rate(F.col("confirmed")), "backfilled_rate": rate(F.col("backfilled")), "mismatch_rate": rate(F.col("mismatch")), "mismatches_cut": F.greatest(F.col("mismatch") - most, F.lit(0))})
    return out if pages is None else out.join(pages.groupBy("doc").agg(F.count_if("trusted").alias("pages_used"), F.count_if(~F.col("trusted")).alias("pages_left")), "doc", "left")


def first_mismatches(cells: DataFrame, most: int = 50) -> DataFrame:
    """The first mismatches of each document in reading order of its tables."""
    order = Window.partitionBy("doc").orderBy("page", "tbl", "row", "col")
    return cells.filter("provenance = 'text_mismatch'").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
