"""Box expressions. A box is STRUCT<x0, y0, x1, y1> in fractions of the card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckloom import constants as C

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def parse(raw: Column) -> Column:
    """[ymin, xmin, ymax, xmax] in 0-1000 to a box; null when short, thin, flat or inverted."""
    ymin, xmin, ymax, xmax = (F.get(raw, F.lit(i)) / 1000 for i in range(4))
    usable = (
        (F.size(raw) == 4) & (xmax - xmin >= C.BOX_MIN_WIDTH) & (ymax - ymin >= C.BOX_MIN_HEIGHT)
    )
    return F.when(usable, box(xmin, ymin, xmax, ymax))


def parse_all(raws: Column) -> Column:
    """Every usable box of a list, top to bottom (then left to right, to have one order)."""
    return by_top(F.filter(F.transform(raws, parse), lambda b: b.isNotNull()))


def by_top(boxes: Column) -> Column:
    keyed = F.transform(
        boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["y1"].alias("y1"), b["x1"].alias("x1"))
    )
    return F.transform(F.sort_array(keyed), lambda b: box(b["x0"], b["y0"], b["x1"], b["y1"]))


def one_or_many(variant: Column) -> Column:
    """A stored `rules` value: one bare box of four numbers, a list of boxes, or nothing."""
    many = F.try_variant_get(variant, "$", "array<array<double>>")
    one = F.try_variant_get(variant, "$", "array<double>")
    bare = (F.size(one) == 4) & F.get(one, F.lit(0)).isNotNull()
    listed = F.when(bare, F.array(one)).otherwise(many)
    rows = F.coalesce(listed, F.array().cast("array<array<double>>"))
    whole = F.filter(rows, lambda r: F.size(r) == 4)
    return F.transform(whole, lambda r: box(*(F.get(r, F.lit(i)) for i in range(4))))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def grown(b: Column, by: float = C.NEAR) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def common(a: Column, b: Column) -> Column:
    return box(
        F.greatest(a["x0"], b["x0"]),
        F.greatest(a["y0"], b["y0"]),
        F.least(a["x1"], b["x1"]),
        F.least(a["y1"], b["y1"]),
    )


def share_inside(inner: Column, outer: Column) -> Column:
    """Share of `inner` that lies in `outer`."""
    own = area(inner)
    return F.when(own > 0, area(common(inner, outer)) / own).otherwise(F.lit(0.0))


def from_crop(b: Column, region=C.TAB_CROP) -> Column:
    """A box in the fractions of a crop, in the fractions of the card."""
    left, top, right, bottom = region
    return box(
        left + b["x0"] * (right - left),
        top + b["y0"] * (bottom - top),
        left + b["x1"] * (right - left),
        top + b["y1"] * (bottom - top),
    )


def in_tab_corner(b: Column) -> Column:
    return ((b["x0"] + b["x1"]) / 2 > C.TAB_CORNER[0]) & ((b["y0"] + b["y1"]) / 2 > C.TAB_CORNER[1])


def is_the_tab(mark: Column, tab: Column) -> Column:
    """A mark in the tab's corner that is the blank tab itself, not ink painted on it."""
    same = (area(tab) > 0) & (area(mark) >= area(tab) * C.TAB_MARK_SHARE)
    return in_tab_corner(mark) & (tab.isNull() | F.coalesce(same, F.lit(False)))


def is_line_shaped(b: Column) -> Column:
    return (width(b) >= C.BANNER_WIDTH) & (height(b) > 0) & (width(b) / height(b) >= C.BANNER_ASPECT)


def total_height(boxes: Column) -> Column:
    return F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + height(b))
