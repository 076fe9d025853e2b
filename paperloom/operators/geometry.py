"""Boxes and coordinate frames as column expressions. A box is four columns x0, y0, x1, y1 (or a struct of that shape).

Defined results: null coordinates give null; boxes without extent have ratio 0; half-even rounding throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    """A box struct."""
    return F.struct(*[F.lit(c).cast("double").alias(n) if not isinstance(c, Column) else c.cast("double").alias(n) for n, c in zip(BOX, (x0, y0, x1, y1))])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def overlap(a: Column, b: Column, axis: str) -> Column:
    """Length two boxes share on an axis, 0 for none."""
    return F.greatest(F.lit(0.0), F.least(a[f"{axis}1"], b[f"{axis}1"]) - F.greatest(a[f"{axis}0"], b[f"{axis}0"]))


def overlap_ratio(a: Column, b: Column, axis: str) -> Column:
    """Shared length over the smaller extent on an axis."""
    least = F.least(a[f"{axis}1"] - a[f"{axis}0"], b[f"{axis}1"] - b[f"{axis}0"])
    return F.when(least > 0, overlap(a, b, axis) / least).otherwise(0.0)


def intersection(a: Column, b: Column) -> Column:
    return overlap(a, b, "x") * overlap(a, b, "y")


def containment(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def vertical_gap(a: Column, b: Column) -> Column:
    """Distance between two boxes one above the other; 0 where they overlap vertically."""
    return F.greatest(F.lit(0.0), F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"]))


def clamped(b: Column, w: Column, h: Column) -> Column:
    """A box cut to a page of the given size."""
    return box(F.least(F.greatest(b["x0"], F.lit(0.0)), w), F.least(F.greatest(b["y0"], F.lit(0.0)), h), F.least(F.greatest(b["x1"], F.lit(0.0)), w), F.least(F.greatest(b["y1"], F.lit(0.0)), h))


def merged(a: Column, b: Column) -> Column:
    """The smallest box around two."""
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_box(x0: Column, y0: Column, x1: Column, y1: Column, digits: int = 2) -> Column:
    """Aggregate: the box around all boxes of a group, rounded."""
    return F.struct(*[F.bround(f(c), digits).alias(n) for n, f, c in (("x0", F.min, x0), ("y0", F.min, y0), ("x1", F.max, x1), ("y1", F.max, y1))])


def box_of_json(value: Column) -> Column:
    """A box out of any of its written forms: {x0,y0,x1,y1}, {x,y,width,height}, [x0,y0,x1,y1], a flat polygon or a list of points.

    Null where the text is none of them.
    """
    flat = F.transform(F.filter(F.split(F.regexp_replace(value, r"[\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.try_cast("double"))
    listed = F.trim(value).startswith("[") & F.forall(flat, lambda x: x.isNotNull())
    xs, ys = F.filter(flat, lambda x, i: i % 2 == 0), F.filter(flat, lambda x, i: i % 2 == 1)
    d = lambda k: F.get_json_object(value, f"$.{k}").try_cast("double")
    return (
        F.when(listed & (F.size(flat) == 4), box(flat[0], flat[1], flat[2], flat[3]))
        .when(listed & (F.size(flat) > 4) & (F.size(flat) % 2 == 0), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        .when(d("x0").isNotNull() & d("y0").isNotNull() & d("x1").isNotNull() & d("y1").isNotNull(), box(d("x0"), d("y0"), d("x1"), d("y1")))
        .when(d("x").isNotNull() & d("y").isNotNull(), box(d("x"), d("y"), d("x") + F.coalesce(d("width"), d("w"), F.lit(0.0)), d("y") + F.coalesce(d("height"), d("h"), F.lit(0.0))))
    )


def polygon_box(points: Column) -> Column:
    """Box and centre of a polygon of eight numbers; null for any other number of them."""
    xs, ys = F.filter(points, lambda x, i: i % 2 == 0), F.filter(points, lambda x, i: i % 2 == 1)
    b = box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    centre = F.struct(*[b[n].alias(n) for n in BOX], ((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"))
    return F.when((F.size(points) == 8) & F.forall(points, lambda x: x.isNotNull()), centre)


def flat_polygon(points: Column) -> Column:
    """Four (x, y) points as eight numbers; null for any other number of them."""
    return F.when((F.size(points) == 4) & F.forall(points, lambda p: F.size(p) == 2), F.flatten(points))


def corners(b: Column) -> Column:
    """The polygon of a box as eight numbers."""
    return F.array(b["x0"], b["y0"], b["x1"], b["y0"], b["x1"], b["y1"], b["x0"], b["y1"])


def derived(b: Column, digits: int = 2) -> Column:
    """Width, height, area and centre of a box, rounded."""
    r = lambda c: F.bround(c, digits)
    return F.struct(r(width(b)).alias("width"), r(height(b)).alias("height"), r(area(b)).alias("area"), r((b["x0"] + b["x1"]) / 2).alias("cx"), r((b["y0"] + b["y1"]) / 2).alias("cy"))


def unrotated(polygon: Column, angle: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """A flat polygon on a page that was turned by ``angle`` degrees about its middle and set on a page of the new size, back on the old page."""
    t = F.radians(angle)
    cos, sin = F.cos(t), F.sin(t)
    n = F.floor(F.size(polygon) / 2).cast("int")

    def point(i):
        x, y = F.get(polygon, 2 * i) - new_w / 2, F.get(polygon, 2 * i + 1) - new_h / 2
        return F.array(cos * x - sin * y + w / 2, sin * x + cos * y + h / 2)

    return F.when(n >= 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), point))).otherwise(F.array().cast("array<double>"))


def flipped(b: Column, page_height: Column) -> Column:
    """A box with the vertical axis turned over."""
    return box(b["x0"], page_height - b["y1"], b["x1"], page_height - b["y0"])


def cell_rect(table: Column, row: Column, col: Column, n_rows: Column, n_cols: Column, scale: float = 2.0) -> Column:
    """The rectangle of a cell in a uniform grid over a table's box, in page points; null where there is no grid."""
    x0, y0 = table["x0"] / scale, table["y0"] / scale
    w, h = width(table) / scale / n_cols, height(table) / scale / n_rows
    inside = (n_rows > 0) & (n_cols > 0) & (width(table) > 0) & (height(table) > 0) & row.between(0, n_rows - 1) & col.between(0, n_cols - 1)
    return F.when(inside, box(x0 + col * w, y0 + row * h, x0 + (col + 1) * w, y0 + (row + 1) * h))


def space_mismatch(b: Column, w: Column, h: Column, tolerance: float = 3.0) -> Column:
    """How a box fails to lie on a raster of the given size: swapped, over_w, over_h; null where it lies on it."""
    over_w, over_h = b["x1"] > w + tolerance, b["y1"] > h + tolerance
    turned = (b["x1"] <= h + tolerance) & (b["y1"] <= w + tolerance)
    return F.when((over_w | over_h) & turned, "swapped").when(over_w, "over_w").when(over_h, "over_h")


def same_page_size(view_w: Column, view_h: Column, page_w: Column, page_h: Column, scale: float = 2.0, tolerance: float = 0.02) -> Column:
    """Whether a view's page is the page at its scale within a tolerance; unknown sizes pass."""
    near = lambda v, p: F.abs(v - scale * p) <= tolerance * scale * p
    known = view_w.isNotNull() & view_h.isNotNull() & page_w.isNotNull() & page_h.isNotNull()
    return ~known | (near(view_w, page_w) & near(view_h, page_h))


def lower_median(expression: str) -> Column:
    """Aggregate: the middle value of a SQL expression, of two the lower one."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {expression})")


def image_coverage(images: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, coverage): the box around all images of a page, cut to the page, over its area. ``images`` has x0..y1, ``pages`` width and height."""
    cut = images.join(pages, key).select(*key, "width", "height", clamped(F.struct(*BOX), F.col("width"), F.col("height")).alias("b")).filter("b.x1 > b.x0 and b.y1 > b.y0")
    around = cut.groupBy(*key, "width", "height").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    found = around.select(*key, ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))).alias("coverage"))
    return pages.select(*key).join(found, key, "left").select(*key, F.bround(F.coalesce("coverage", F.lit(0.0)), 4).alias("coverage"))
