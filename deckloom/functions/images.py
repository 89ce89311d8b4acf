"""Expressions over an image held in one row: width, height and value arrays in reading order.

An image is bounded by its canvas, so work inside its row needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckloom.functions import arrays as A


def grey(r: Column, g: Column, b: Column) -> Column:
    """Whole-number luma as image libraries round it (16-bit weights)."""

    def one(rg: Column, blue: Column) -> Column:
        weighted = rg["a"] * 19595 + rg["b"] * 38470 + blue * 7471 + 32768
        return F.floor(weighted / 65536).cast("int")

    pairs = F.zip_with(r, g, lambda a, c: F.struct(a.alias("a"), c.alias("b")))
    return F.zip_with(pairs, b, one)


def crop(values: Column, width: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Values of a rectangle, row by row; empty when the rectangle is."""
    across = F.greatest(F.lit(0), x1 - x0).cast("int")
    return F.flatten(
        F.transform(A.index_range(y0, y1), lambda y: F.slice(values, (y * width + x0 + 1).cast("int"), across))
    )


def gradient(values: Column, width: Column) -> Column:
    """|difference to the next row|, one row shorter than the image."""
    below = F.size(values) - width
    return F.zip_with(
        F.slice(values, F.lit(1), below), F.slice(values, width + 1, below), lambda upper, lower: F.abs(upper - lower)
    )


def gradient_mean(values: Column, width: Column, height: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Mean gradient inside a crop, from the gradient of the whole; 0 when it has fewer than two rows."""
    inside = crop(values, width, x0, y0, x1, F.least(y1, height) - 1)
    return F.coalesce(A.mean(inside), F.lit(0.0))


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box in fractions as whole pixels, cut down to whole numbers."""
    return F.struct(
        F.floor(box["x0"] * width).cast("int").alias("x0"),
        F.floor(box["y0"] * height).cast("int").alias("y0"),
        F.least(F.floor(box["x1"] * width).cast("int"), width).alias("x1"),
        F.least(F.floor(box["y1"] * height).cast("int"), height).alias("y1"),
    )
