"""Structure of an image corpus: straight edges, flat bands, batch against baseline."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from deckloom import constants as C
from deckloom.functions import arrays as A
from deckloom.functions import images as I
from deckloom.operators import scale
from deckloom.operators.proof import present, problem
from deckloom.sources.images import grey_bytes

METRICS = ["ruled_rows", "widest_edge", "band_structure", "interior_energy"]
MEASURED = StructType([StructField(m, LongType() if m == "ruled_rows" else DoubleType()) for m in METRICS])
NOTHING = (None, None, None, None)


def vertical_gradient(images: DataFrame) -> DataFrame:
    """image_id, y, x, g: difference to the pixel below, from slices of the image's own row."""
    tall = images.select("image_id", "width", F.posexplode(I.gradient(F.col("px"), F.col("width"))).alias("at", "g"))
    return tall.select(
        "image_id", F.floor(F.col("at") / F.col("width")).alias("y"),
        (F.col("at") % F.col("width")).cast("bigint").alias("x"), "g",
    )


def spread(images: DataFrame) -> DataFrame:
    """Mean and population deviation of every image's values."""
    return images.select("image_id", A.mean(F.col("px")).alias("mean"), A.deviation(F.col("px")).alias("deviation"))


def image_metrics(grid: np.ndarray, sigma: float, share: float, band: float, inset: float) -> tuple:
    """The four metrics of one grey image. Sums are whole numbers, so each figure rounds once.

    An image without pixels has no rim to measure: 0 ruled rows, no widest edge, 0 elsewhere.
    """
    height, width = grid.shape
    g = np.abs(np.diff(grid.astype(np.int32), axis=0))
    shares = np.zeros(0)
    if g.size:
        total, wide = int(g.sum(dtype=np.int64)), g.ravel().astype(np.int64)
        deviation = math.sqrt(float(g.size * int(wide @ wide) - total * total)) / g.size
        shares = np.count_nonzero(g > total / g.size + sigma * deviation, axis=1) / width

    def side(x0: int, y0: int, x1: int, y1: int) -> float:
        part = g[max(y0, 0) : max(min(y1, height) - 1, 0), max(x0, 0) : max(x1, 0)]
        return int(part.sum(dtype=np.int64)) / part.size if part.size else 0.0

    bw, bh = math.floor(width * band), math.floor(height * band)
    ix, iy = math.floor(width * inset), math.floor(height * inset)
    bands = (side(0, 0, width, bh), side(0, height - bh, width, height), side(0, 0, bw, height), side(width - bw, 0, width, height))
    widest = float(shares.max()) if shares.size else None
    return int(np.count_nonzero(shares > share)), widest, min(bands), side(ix, iy, width - ix, height - iy)


def _metrics_table(rows: list[tuple]) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=METRICS)
    return table.astype({"ruled_rows": "Int64", **dict.fromkeys(METRICS[1:], "Float64")})


def measure(
    images: DataFrame,
    keep: list[str],
    sigma: float = C.EDGE_SIGMA,
    share: float = C.RULED_SHARE,
    band: float = C.BAND_SHARE,
    inset: float | None = None,
) -> DataFrame:
    """The four structure metrics, one row in and one row out; null for an image that has no channels.

    An edge is hard where the gradient passes its own image's mean by `sigma` deviations. Whole images are
    measured as arrays, one Arrow batch at a time.
    """
    inset = 3 * band if inset is None else inset

    @F.pandas_udf(MEASURED)
    def metrics(px: pd.Series, width: pd.Series) -> pd.DataFrame:
        return _metrics_table([
            NOTHING if flat is None or not wide > 0 else image_metrics(np.asarray(flat).reshape(-1, int(wide)), sigma, share, band, inset)
            for flat, wide in zip(px, width)
        ])

    measured = images.select(*keep, metrics("px", "width").alias("_m"))
    return measured.select(*keep, *[f"_m.{m}" for m in METRICS])


def measure_stored(
    images: DataFrame,
    image: str,
    keep: list[str],
    sigma: float = C.EDGE_SIGMA,
    share: float = C.RULED_SHARE,
    band: float = C.BAND_SHARE,
    inset: float | None = None,
) -> DataFrame:
    """`measure` straight from an image-source struct: bytes to grey to metrics in one step, no pixel arrays between.

    An image that cannot be decoded keeps its row, with null metrics.
    """
    inset = 3 * band if inset is None else inset

    @F.pandas_udf(MEASURED)
    def metrics(data: pd.Series, channels: pd.Series, width: pd.Series) -> pd.DataFrame:
        return _metrics_table([
            NOTHING if raw is None or not depth > 0 or not wide > 0 else image_metrics(grey_bytes(raw, int(depth)).reshape(-1, int(wide)), sigma, share, band, inset)
            for raw, depth, wide in zip(data, channels, width)
        ])

    part = F.col(image)
    measured = images.select(*keep, metrics(part["data"], part["nChannels"], part["width"]).alias("_m"))
    return measured.select(*keep, *[f"_m.{m}" for m in METRICS])


def score_corpus(files: DataFrame, image: str, keep: list[str], archetype: Column, **limits) -> DataFrame:
    """Stored images to metrics and problems, one row each: the whole scoring flow before any summary."""
    measured = measure_stored(files.withColumn("_archetype", archetype), image, [*keep, "_archetype"], **limits)
    return measured.withColumn("problems", grade(F.col("_archetype"))).drop("_archetype")


def gate(metric: str, archetype: Column) -> Column:
    out = F.lit(float(C.STRUCTURE_GATES["default"][metric]))
    for name, limits in C.STRUCTURE_GATES.items():
        if name != "default":
            out = F.when(archetype == name, F.lit(float(limits[metric]))).otherwise(out)
    return out


def grade(archetype: Column) -> Column:
    """Problems of measured images against their archetype's range."""

    def over(metric: str, code: str) -> Column:
        limit = gate(metric, archetype)
        told = F.concat(F.lit(f"{metric} "), F.format_number(metric, 3), F.lit(", at most "), limit.cast("string"))
        return F.when(F.col(metric) > limit, problem(code, told))

    return present([over("ruled_rows", "ruled"), over("widest_edge", "wide_rim"), over("interior_energy", "busy")])


def tall_metrics(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One row per metric; a metric that was not taken is skipped."""
    wide = measured.select(*keys, *[F.col(m).cast("double").alias(m) for m in METRICS])
    return wide.unpivot(keys, METRICS, "metric", "value").where(F.col("value").isNotNull())


def summarise(tall: DataFrame, keys: list[str]) -> DataFrame:
    """mean, min, max and the upper median per group. Sums are decimal, so their order cannot matter."""
    total = F.sum(F.col("value").cast("decimal(28,12)")).cast("double")
    basic = tall.groupBy(*keys).agg(
        (total / F.count(F.lit(1))).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    middle = scale.value_at_rank(tall, keys, "value", F.floor(F.col("_total") / 2) + 1, "median")
    return basic.join(middle, keys)


def compare(summary: DataFrame, batch: str = "batch", baseline: str = "baseline") -> DataFrame:
    """Metric by metric, how far a batch's mean is from the baseline's; flagged beyond the baseline's own mean."""
    ours = summary.where(F.col("batch") == batch).select("metric", F.col("mean").alias("ours"))
    theirs = summary.where(F.col("batch") == baseline).select("metric", F.col("mean").alias("theirs"))
    delta = F.col("ours") - F.col("theirs")
    return theirs.join(ours, "metric").select(
        "metric", "theirs", "ours", delta.alias("delta"), (F.abs(delta) > F.col("theirs")).alias("flagged")
    )


def scoreboard(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Failures and how many are inside the gates."""
    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("problems") > 0).alias("failures"),
        F.count_if(F.size("problems") == 0).alias("inside"),
    )


def listing(measured: DataFrame) -> DataFrame:
    """Worst first, then by name."""
    return measured.orderBy(F.col("ruled_rows").desc(), F.col("image_id"))
