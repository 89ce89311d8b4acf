"""Margins around an image: mats, black voids, rounded corners, and the rectangle to keep.

Images come as the image source stores them: width, height, number of channels and bytes. A kernel measures a whole
image at a time on views of its bytes and touches only the sampled lines near the sides, so no pixel becomes
a row or an array element, and an image of any size costs its bytes and little more.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from deckloom import constants as C
from deckloom.operators.proof import present, problem

SIDES = ["top", "bottom", "left", "right"]
BLACKS, MATS = ([f"{kind}_{side}" for side in SIDES] for kind in ("black", "mat"))
#: What can be measured: the columns of each part.
PARTS = {"black": BLACKS, "matted": ["matted"], "mat": MATS, "corner": ["corner"]}


def _cut(height: int, width: int, share: float) -> int:
    """A share of the shorter side in whole pixels, cut down."""
    return math.floor(min(height, width) * share)


def from_side(pixels: np.ndarray, side: str) -> np.ndarray:
    """A view whose first index counts lines in from a side, and whose second runs along it."""
    upright = pixels if side in ("top", "bottom") else pixels.swapaxes(0, 1)
    return upright if side in ("top", "left") else upright[::-1]


def run_depth(lines: np.ndarray, limit: int, step: int, matches) -> int:
    """Lines in, up to `limit`, of which at least nine in ten sampled pixels match."""
    sampled = lines[:limit, ::step]
    broken = matches(sampled).sum(axis=1) / sampled.shape[1] < C.LINE_SHARE
    return int(broken.argmax()) if broken.any() else limit


def _near(pixels: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (np.abs(pixels.astype(np.int16) - colour) <= C.MAT_TOLERANCE).all(axis=-1)


def black_depths(pixels: np.ndarray) -> list[int]:
    """Depth of the black margin on every side, in pixels."""
    height, width = pixels.shape[:2]
    limit, step = _cut(height, width, C.BLACK_WALK), max(1, width // 40)
    return [run_depth(from_side(pixels, s), limit, step, lambda lines: lines.max(axis=-1) <= C.BLACK) for s in SIDES]


def edge_ring(pixels: np.ndarray) -> np.ndarray:
    """The sampled pixels one inset in from all four sides."""
    height, width = pixels.shape[:2]
    depth, step = _cut(height, width, C.RING_INSET), max(1, width // 60)
    return np.concatenate([from_side(pixels, s)[depth, ::step] for s in SIDES])


def _spread(pixels: np.ndarray) -> float:
    """The widest channel's median absolute deviation."""
    values = pixels.astype(np.float64)
    return float(np.median(np.abs(values - np.median(values, axis=0)), axis=0).max())


def mat_of(pixels: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of the ring that is one flat colour, and that colour.

    Light rings count when they are flat; a ring of any one flat colour counts when it is very flat
    and not black; otherwise the light share stands.
    """
    ring = edge_ring(pixels)
    light = ring[ring.min(axis=1) > C.LIGHT_MAT]
    is_light = len(light) >= len(ring) * C.MATTED
    basis = light if is_light else ring
    colour = np.sort(basis, axis=0)[len(basis) // 2].astype(np.int16)
    same = ring[_near(ring, colour)]
    share = len(same) / len(ring)
    if is_light:
        return (0.0 if _spread(light) > C.MAT_FLAT_MAX else share), colour
    if colour.max() > C.BLACK and share >= C.DARK_MAT_SHARE and _spread(same) <= C.DARK_MAT_FLAT:
        return share, colour
    return len(light) / len(ring), colour


def mat_depths(pixels: np.ndarray, colour: np.ndarray) -> list[int]:
    """Lines of the mat's colour in from every side."""
    limit = _cut(*pixels.shape[:2], C.MARGIN_MAX_DEPTH)

    def depth(lines: np.ndarray) -> int:
        return run_depth(lines, limit, max(1, lines.shape[1] // 40), lambda some: _near(some, colour))

    return [depth(from_side(pixels, s)) for s in SIDES]


def corner_depth(pixels: np.ndarray) -> int:
    """Pixels to cut off every side so that a rounded card on white clears its arcs.

    0 unless all four corners are paper, or when the arc is too deep to be one.
    """
    height, width = pixels.shape[:2]
    box = C.CORNER_BOX
    corners = [pixels[y : y + box, x : x + box] for y in (0, max(height - box, 0)) for x in (0, max(width - box, 0))]
    if any(np.count_nonzero(c.min(axis=-1) > C.PAPER) <= box * box * 0.5 for c in corners):
        return 0
    limit, reach = _cut(height, width, C.CORNER_MAX_DEPTH), _cut(height, width, C.CORNER_REACH)
    depths = []
    for side in SIDES:
        lines = from_side(pixels, side)
        across = lines.shape[1]
        along = [*range(0, reach, C.CORNER_STEP), *range(across - reach, across, C.CORNER_STEP)]
        scene = lines[:limit, along].min(axis=-1) <= C.PAPER
        depths += np.where(scene.any(axis=0), scene.argmax(axis=0), limit).tolist() if limit else [0] * len(along)
    deepest = sorted(depths)[math.floor(len(depths) * C.CORNER_PERCENTILE)] if depths else limit
    return deepest if deepest < limit else 0


def image_margins(pixels: np.ndarray, parts: tuple[str, ...]) -> list:
    """The asked parts of one image (height × width × three channels, in any order of channels)."""
    matted, colour = mat_of(pixels) if "matted" in parts or "mat" in parts else (None, None)
    found = {
        "black": lambda: black_depths(pixels), "matted": lambda: [matted],
        "mat": lambda: mat_depths(pixels, colour), "corner": lambda: [corner_depth(pixels)],
    }
    return [v for part in parts for v in found[part]()]


def _pixels(raw: bytes, depth: int, width: int) -> np.ndarray:
    """A view of stored bytes with three channels; a grey image has the same one three times."""
    image = np.frombuffer(raw, np.uint8).reshape(-1, width, depth)
    return image[:, :, :3] if depth >= 3 else np.broadcast_to(image[:, :, :1], (*image.shape[:2], 3))


def measure_margins(images: DataFrame, image: str, keep: list[str], parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """`keep`, width, height and the columns of `parts`, from an image-source struct; one row in and one row out.

    black_* and mat_*: depths per side in pixels; matted: share of the edge that is one flat colour;
    corner: what clears a rounded card's arcs. Null for an image that is missing, cannot be decoded or has no pixels.
    """
    names = [c for part in parts for c in PARTS[part]]
    shape = StructType([StructField(c, DoubleType() if c == "matted" else IntegerType()) for c in names])

    @F.pandas_udf(shape)
    def margins(data: pd.Series, channels: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = [
            [None] * len(names) if raw is None or not len(raw) or not depth > 0 or not wide > 0 else image_margins(_pixels(raw, int(depth), int(wide)), parts)
            for raw, depth, wide in zip(data, channels, width)
        ]
        table = pd.DataFrame(rows, columns=names)
        return table.astype({c: "Float64" if c == "matted" else "Int32" for c in names})

    part = F.col(image)
    measured = images.select(*keep, part["width"].alias("width"), part["height"].alias("height"), margins(part["data"], part["nChannels"], part["width"]).alias("_m"))
    return measured.select(*keep, "width", "height", *[f"_m.{c}" for c in names])


def _short() -> Column:
    return F.least("width", "height")


def _share(share: float) -> Column:
    return F.floor(_short() * share).cast("int")


def black_inset() -> Column:
    """The shallowest black margin as a share of the shorter side."""
    return F.least(*BLACKS) / _short()


def trim_rectangle(images: DataFrame, image: str, keep: list[str]) -> DataFrame:
    """What to cut from each side, and the cut as a share of the shorter side. All 0 when nothing is.

    A mat goes when all four sides have one that ends before the ceiling. Without a mat a black void
    goes on the same terms, and failing that the arcs of a rounded card. Null for an image that cannot be decoded.
    """
    ceiling = _share(C.MARGIN_MAX_DEPTH)
    ready = measure_margins(images, image, keep)
    floor = F.greatest(F.lit(2), _share(C.BLACK_FLOOR))
    is_mat = F.col("matted") >= C.MATTED
    cut_mat = (F.least(*MATS) > 0) & (F.greatest(*MATS) < ceiling)
    cut_black = (F.least(*BLACKS) >= floor) & (F.greatest(*BLACKS) < ceiling)
    cuts = [
        F.when(F.col("matted").isNull(), F.lit(None).cast("int"))
        .when(is_mat, F.when(cut_mat, F.col(m)).otherwise(F.lit(0)))
        .when(cut_black, F.col(b)).otherwise(F.col("corner")).alias(s)
        for s, m, b in zip(SIDES, MATS, BLACKS)
    ]
    cut = ready.select(*keep, "width", "height", *cuts)
    depth = F.when(F.col("top").isNotNull(), F.greatest(*SIDES) / _short())
    return cut.select(*keep, *SIDES, depth.alias("depth"))


def matte_problem() -> Column:
    """A black page on all four sides, else a flat edge. Needs the parts black and matted."""
    return present(
        [
            F.when(
                black_inset() >= C.BLACK_INSET,
                problem("matted", F.concat(F.lit("black on every side: "), F.format_number(black_inset(), 3))),
            ).when(
                F.col("matted") >= C.MATTED,
                problem("matted", F.concat(F.lit("edge of one flat colour: "), F.format_number("matted", 3))),
            )
        ]
    )
