"""Image corpora: files to rows that hold one image each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

CHANNELS = StructType([StructField(c, ArrayType(IntegerType())) for c in "rgb"])


@F.pandas_udf(CHANNELS)
def _channels(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Blue-green-red bytes (or grey, or with alpha) to three arrays, a whole image at a time."""
    rows = []
    for raw, depth in zip(data, channels):
        if depth < 1:
            rows.append((None, None, None))
            continue
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(-1, depth).astype(np.int32)
        rows.append((pixels[:, min(2, depth - 1)], pixels[:, min(1, depth - 1)], pixels[:, 0]))
    return pd.DataFrame(rows, columns=list("rgb"))


def grey_bytes(raw: bytes, depth: int) -> np.ndarray:
    """Whole-number luma of blue-green-red bytes (or grey, or with alpha), as image libraries round it."""
    pixels = np.frombuffer(raw, dtype=np.uint8).reshape(-1, depth)
    if depth == 1:
        return pixels[:, 0]
    blue, green, red = (pixels[:, min(i, depth - 1)].astype(np.int32) for i in range(3))
    return (red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16


def is_card_image(path: Column) -> Column:
    """Card pictures only: no stored blanks beside them, no contact sheets."""
    return path.rlike(r"(?i)\.png$") & ~path.rlike(r"(?i)-blank\.png$") & ~path.rlike(r"(?i)(^|/)sheet\.png$")


def decode(images: DataFrame, image: str, keep: list[str]) -> DataFrame:
    """An image-source struct to width, height and channel arrays r, g, b."""
    read = images.select(*keep, F.col(f"{image}.width").alias("width"), F.col(f"{image}.height").alias("height"),
                         _channels(F.col(f"{image}.data"), F.col(f"{image}.nChannels")).alias("_px"))
    return read.select(*keep, "width", "height", "_px.r", "_px.g", "_px.b")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Every card image under a folder, at any depth. One that cannot be decoded has an `error` and no channels."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][nN][gG]").load(path)
    kept = files.where(is_card_image(F.col("image.origin"))).withColumn("path", F.col("image.origin"))
    return decode(kept, "image", ["path"]).withColumn("error", F.when(F.col("width") < 0, "cannot be decoded"))
