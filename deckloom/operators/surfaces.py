"""Light and ink on printed surfaces, and where the light and the detail of an image lie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from deckloom import constants as C
from deckloom.functions import arrays as A
from deckloom.functions import boxes as B
from deckloom.functions import colour as K
from deckloom.functions import images as I
from deckloom.operators import scale
from deckloom.operators.proof import present, problem

W, H = "width", "height"


def _inner(values: Column, box: Column, share: float) -> Column:
    """The middle of a pixel box, in by a share of its size on each side, never less than one pixel."""
    ix = F.bround((box["x1"] - box["x0"]) * share).cast("int")
    iy = F.bround((box["y1"] - box["y0"]) * share).cast("int")
    x0, y0 = box["x0"] + ix, box["y0"] + iy
    return I.crop(
        values, F.col(W), x0, y0, F.greatest(x0 + 1, box["x1"] - ix), F.greatest(y0 + 1, box["y1"] - iy)
    )


def is_dark(box: Column) -> Column:
    """Whether text on this surface would have to be light, from its middle."""
    means = [A.mean(_inner(F.col(c), box, 0.2)) for c in "rgb"]
    return K.luma(*means) < C.DARK_SURFACE


def paper_level(values: Column) -> Column:
    """Smallest value at or below which nine in ten pixels lie."""
    return F.get(F.sort_array(values), F.ceil(F.size(values) * C.PAPER_PERCENTILE).cast("int") - 1)


def cover(values: Column) -> Column:
    """Share of a light surface that something darker covers, soft at the edge."""


    def over(limits: Column) -> Column:
        low, span = limits["low"], limits["span"]
        return F.transform(
            values,
            lambda v: F.when(v >= low, F.lit(0)).otherwise(F.least(F.lit(255.0), F.bround(255 * (low - v) / span))).cast("int"),
        )

    def limits(paper: Column) -> Column:
        low = F.bround(paper * (1 - C.OCCLUDE_DEPTH))
        span = F.greatest(F.lit(1.0), F.bround(paper * C.OCCLUDE_RAMP))
        return F.struct(low.alias("low"), span.alias("span"))

    return A.mean(A.let(A.let(paper_level(values), limits), over)) / 255


def strips(images: DataFrame, keep: list[str], min_side: int = 8) -> DataFrame:
    """Per strip of `rules` (boxes in fractions): its mean grey, and its cover where it is light and large enough.

    Adds `strips` ARRAY<STRUCT<mean, cover>> to the row.
    """
    pixels = F.transform("rules", lambda s: I.box_pixels(s, F.col(W), F.col(H)))
    ready = scale.once(images, _grey=I.grey(F.col("r"), F.col("g"), F.col("b")), _boxes=pixels)

    def one(box: Column) -> Column:
        wide, tall = box["x1"] - box["x0"], box["y1"] - box["y0"]
        px, py = F.bround(wide * C.RULES_PAD).cast("int"), F.bround(tall * C.RULES_PAD).cast("int")
        fits = (F.least(wide, tall) >= min_side) & (F.least(wide - 2 * px, tall - 2 * py) >= min_side)
        region = I.crop(F.col("_grey"), F.col(W), box["x0"] + px, box["y0"] + py, box["x1"] - px, box["y1"] - py)
        whole = I.crop(F.col("_grey"), F.col(W), box["x0"], box["y0"], box["x1"], box["y1"])
        covered = F.when(fits & ~is_dark(box), A.let(region, cover))
        return F.struct(A.let(whole, A.mean).alias("mean"), covered.alias("cover"))

    return scale.once(ready, strips=F.transform("_boxes", one)).select(*keep, "strips")


def worst_mean() -> Column:
    """The darkest strip decides: contrast falls with the mean."""
    return F.array_min(F.transform("strips", lambda s: s["mean"]))


def worst_cover() -> Column:
    return F.array_max(F.transform("strips", lambda s: s["cover"]))


def contrast_problem(ink: int = C.PRINT_INK) -> Column:
    ratio = K.contrast(worst_mean(), F.lit(ink))
    return present(
        [F.when(ratio < C.CONTRAST_MIN, problem("panel_too_dark", F.concat(F.lit("contrast "), F.format_number(ratio, 2))))]
    )


def obstruction_problem() -> Column:
    covered = worst_cover()
    return present(
        [F.when(covered > C.OBSTRUCTION_MAX, problem("panel_obstructed", F.concat(F.lit("covered "), F.format_number(covered, 3))))]
    )


ISLANDS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("mass", "x0", "y0", "x1", "y1")]))
ENERGY = StructType([StructField(c, DoubleType()) for c in ("substance", "liveliness")])


def ink_mask(values: Column) -> Column:
    """1 where a pixel is off the surface's own value by more than its spread explains."""


    def mask(distance: Column) -> Column:
        limit = F.greatest(F.lit(C.INK_MIN_DEVIATION), A.upper_median(distance) * C.INK_SPREADS)
        return A.let(limit, lambda least: F.transform(distance, lambda d: (d >= least).cast("int")))

    return A.let(A.let(A.upper_median(values), lambda m: F.transform(values, lambda v: F.abs(v - m))), mask)


def parts_of(grid: np.ndarray) -> list[dict]:
    """4-connected parts of a mask with mass and bounds, by their first pixel in reading order.

    The unit is the run of a row. Runs of neighbouring rows that overlap are found by search in their sorted
    bounds and tied to the smallest run of their part, all runs at once.
    """
    height, wide = grid.shape
    padded = np.zeros((height, wide + 2), np.int8)
    padded[:, 1:-1] = grid
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    if not len(row):
        return []
    below = (row + 1) * (wide + 1)
    first = np.searchsorted(row * (wide + 1) + stop, below + start, side="right")
    last = np.searchsorted(row * (wide + 1) + start, below + stop, side="left")
    met = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(row)), met)
    lower = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(first, met)
    root = np.arange(len(row))
    while (apart := root[upper] != root[lower]).any():
        a, b = root[upper[apart]], root[lower[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root]).tolist() != root.tolist():
            root = further
    heads, part = np.unique(root, return_inverse=True)
    found = {"mass": np.zeros(len(heads), np.int64), "x0": np.full(len(heads), wide), "y0": np.full(len(heads), height),
             "x1": np.zeros(len(heads), np.int64), "y1": np.zeros(len(heads), np.int64)}
    np.add.at(found["mass"], part, stop - start)
    for low, values in (("x0", start), ("y0", row)):
        np.minimum.at(found[low], part, values)
    for high, values in (("x1", stop), ("y1", row + 1)):
        np.maximum.at(found[high], part, values)
    return [dict(zip(found, map(int, values))) for values in zip(*found.values())]


@F.pandas_udf(ISLANDS)
def islands(mask: pd.Series, width: pd.Series) -> pd.Series:
    """The parts of each mask. One Arrow batch of whole images at a time; null where there is no image."""
    return pd.Series([
        None if flat is None or not wide > 0 else parts_of(np.asarray(flat, dtype=bool).reshape(-1, int(wide)))
        for flat, wide in zip(mask, width)
    ], dtype=object)


def components(images: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the ink components of each grey image."""
    masked = scale.once(images.select(*keep, W, H, "px"), _mask=ink_mask(F.col("px")))
    return masked.select(*keep, W, H, islands("_mask", W).alias("islands"))


def badge_problem(min_width: int = 24, min_height: int = 12) -> Column:
    """A compact mark at the right end of a strip. Needs `components` of the strip."""
    w, h = F.col(W), F.col(H)

    def is_badge(c: Column) -> Column:
        wide, tall = c["x1"] - c["x0"], c["y1"] - c["y0"]
        return (
            ((c["x0"] + c["x1"]) / 2 / w >= C.BADGE_MIN_CX)
            & (tall / h >= C.BADGE_MIN_HEIGHT)
            & (wide / tall).between(C.BADGE_MIN_ASPECT, C.BADGE_MAX_ASPECT)
            & (c["mass"] / (wide * tall) >= C.BADGE_MIN_FILL)
            & (c["mass"] / (w * h) >= C.BADGE_MIN_SHARE)
        )

    big = (w >= min_width) & (h >= min_height)
    return present([F.when(big & F.exists("islands", is_badge), problem("painted_marks", F.lit("badge at the end of the type line")))])


def edge_strength(grid: np.ndarray, top: float, bottom: float) -> tuple[float | None, float]:
    """Mean edge of a band of rows, and its ratio to the whole. An image without an inside has no edges: null and 0."""
    if min(grid.shape) < 3:
        return None, 0.0
    v = grid.astype(np.int32)
    rows = v[:-2] + v[1:-1] + v[2:]
    edges = np.clip(9 * v[1:-1, 1:-1] - (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]), 0, 255)
    band = edges[round(len(edges) * top) : round(len(edges) * bottom)]
    whole = int(edges.sum(dtype=np.int64)) / edges.size
    mean = int(band.sum(dtype=np.int64)) / band.size if band.size else None
    return mean, 0.0 if whole == 0 else None if mean is None else mean / whole


def band_energy(images: DataFrame, keep: list[str], top: float = 2 / 3, bottom: float = 1.0) -> DataFrame:
    """Edge strength of a band (the lower third) and its ratio to the whole; 0 where all is flat.

    Edges are eight times the pixel less its neighbours, clipped to 0-255, without the outer rim.
    """

    @F.pandas_udf(ENERGY)
    def energy(px: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = [
            (None, 0.0) if flat is None or not wide > 0 else edge_strength(np.asarray(flat).reshape(-1, int(wide)), top, bottom)
            for flat, wide in zip(px, width)
        ]
        return pd.DataFrame(rows, columns=ENERGY.names).astype("Float64")

    return images.select(*keep, energy("px", W).alias("_e")).select(*keep, *[f"_e.{c}" for c in ENERGY.names])


def light_direction(images: DataFrame, keep: list[str]) -> DataFrame:
    """1 where the left (the top) half is at least as bright as the other, else -1."""
    w, h = F.col(W), F.col(H)
    mid_x, mid_y = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    left = A.total(I.crop(F.col("px"), w, F.lit(0), F.lit(0), mid_x, h))
    right = A.total(I.crop(F.col("px"), w, mid_x, F.lit(0), w, h))
    upper = A.total(F.slice("px", F.lit(1), mid_y * w))
    lower = A.total(F.slice("px", mid_y * w + 1, (h - mid_y) * w))
    return images.select(
        *keep, F.when(left >= right, 1).otherwise(-1).alias("light_x"), F.when(upper >= lower, 1).otherwise(-1).alias("light_y")
    )


def strip_boxes(raw: Column) -> Column:
    """Raw stored strips as usable boxes."""
    return F.coalesce(B.parse_all(raw), F.array().cast(f"array<{B.BOX}>"))
