"""Colour of an image against the colour identity of its card."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from deckloom import constants as C
from deckloom.functions import arrays as A
from deckloom.functions import colour as K
from deckloom.operators.proof import present, problem

BUCKETS = [name for name, *_ in C.HUE_BUCKETS]
COUNTS = ["pixels", "saturated", *BUCKETS]
PROFILE = StructType([StructField(c, LongType()) for c in COUNTS])
#: Images from this size on look their colours up in a table of all colours (16 MB a worker).
LOOKED_UP = 1 << 17


def bucket_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each pixel's hue among BUCKETS, or their number where it is not saturated.

    The same steps in the same order as `functions.colour`, so both give the same bucket to the last bit.
    """
    most, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    top, low = most / 255, least / 255
    span = top - low
    grey = span <= 0
    whole = np.where(grey, 1.0, span)
    rc, gc, bc = ((top - c / 255) / whole for c in (r, g, b))
    sixth = np.where(r == most, bc - gc, np.where(g == most, 2.0 + rc - bc, 4.0 + gc - rc)) / 6
    degrees = np.floor(np.where(grey, 0.0, np.mod(sixth, 1.0) * 360)).astype(np.int64)
    by_degree = np.array([BUCKETS.index(K.bucket_of_degree(d)) for d in range(360)] + [BUCKETS.index("red")], np.uint8)
    saturated = ~grey & (span / np.where(top > 0, top, 1.0) > C.SATURATION_MIN) & (top > C.VALUE_MIN)
    return np.where(saturated, by_degree[np.minimum(degrees, 360)], len(BUCKETS)).astype(np.uint8)


@functools.cache
def _all_colours() -> np.ndarray:
    """`bucket_of` for every colour, by red, green, blue; worked out once in a worker."""
    level = np.arange(256)
    out = np.empty((256, 256, 256), np.uint8)
    for red in range(256):
        out[red] = bucket_of(np.full((256, 256), red), level[:, None].repeat(256, 1), level[None, :].repeat(256, 0))
    return out.ravel()


def counts_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[int]:
    """Pixels, saturated pixels, and saturated pixels by bucket."""
    if r.size < LOOKED_UP:
        found = bucket_of(*(c.astype(np.int64) for c in (r, g, b)))
    else:
        found = _all_colours()[r.astype(np.uint32) << 16 | g.astype(np.uint32) << 8 | b.astype(np.uint32)]
    by_bucket = np.bincount(found.ravel(), minlength=len(BUCKETS) + 1)[: len(BUCKETS)]
    return [r.size, int(by_bucket.sum()), *by_bucket.tolist()]


def _table(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COUNTS).astype("Int64")


def profile(images: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Per image: pixels, saturated pixels and saturated pixels by hue bucket, from channel arrays.

    One row in and one row out, counted in the image's own row: null without channels, 0 without pixels.
    """

    @F.pandas_udf(PROFILE)
    def counted(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _table([[None] * len(COUNTS) if x is None else counts_of(*map(np.asarray, (x, y, z))) for x, y, z in zip(r, g, b)])

    return images.select("image_id", *keep, counted("r", "g", "b").alias("_c")).select("image_id", *keep, "_c.*")


def profile_stored(images: DataFrame, image: str, keep: list[str]) -> DataFrame:
    """`profile` straight from an image-source struct: views of the bytes, no arrays between."""

    @F.pandas_udf(PROFILE)
    def counted(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, depth in zip(data, channels):
            if raw is None or not depth > 0:
                rows.append([None] * len(COUNTS))
                continue
            pixels = np.frombuffer(raw, np.uint8).reshape(-1, int(depth))
            rows.append(counts_of(*(pixels[:, min(c, int(depth) - 1)] for c in ((2, 1, 0) if depth > 2 else (0, 0, 0)))))
        return _table(rows)

    part = F.col(image)
    return images.select(*keep, counted(part["data"], part["nChannels"]).alias("_c")).select(*keep, "_c.*")


def share(count: Column) -> Column:
    """Share of the saturated pixels; 0 when there are none."""
    return F.when(F.col("saturated") > 0, count / F.col("saturated")).otherwise(F.lit(0.0))


def saturated_share() -> Column:
    return F.col("saturated") / F.nullif("pixels", F.lit(0))


def mana_shares() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, _low, _high, mana in C.HUE_BUCKETS:
        if mana:
            out[mana] = out[mana] + share(F.col(name)) if mana in out else share(F.col(name))
    return out


def leader() -> tuple[Column, Column]:
    """The mana colour with the largest share, the earlier one on a tie, and that share."""
    shares = mana_shares()
    top = F.greatest(*shares.values())
    who = None
    for mana, part in shares.items():
        who = F.when(part == top, mana) if who is None else who.when(part == top, mana)
    return who, top


def tall_mana(profiled: DataFrame) -> DataFrame:
    """image_id, mana, share, place: one row per mana colour that a hue can show."""
    rows = [
        F.struct(F.lit(m).alias("mana"), s.alias("share"), F.lit(i).alias("place"))
        for i, (m, s) in enumerate(mana_shares().items())
    ]
    return profiled.select("image_id", F.inline(F.array(*rows)))


def leading_mana(tall: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("mana", "share"), F.struct("share", -F.col("place"))).alias("_best")
    return tall.groupBy("image_id").agg(best).select("image_id", "_best.*")


def identity_problem(identity: Column) -> Column:
    """An image that reads as a colour its card does not have. Needs the profile columns."""
    colour, top = leader()
    hued = F.array_intersect(identity, F.array(*[F.lit(m) for m in C.HUED_MANA]))
    own = F.lit(0.0)
    for mana, part in mana_shares().items():
        own = own + F.when(F.array_contains(identity, mana), part).otherwise(F.lit(0.0))
    purple = share(F.col("purple")) + share(F.col("magenta"))
    claims = saturated_share() >= C.NEUTRAL_SHARE
    black = F.array_contains(identity, "B")
    return present(
        [
            F.when(
                ~black & claims & (purple >= C.PURPLE_SHARE),
                problem("colour_identity", F.concat(F.lit("purple on a card that is not black: "), F.format_number(purple, 2))),
            )
            .when(~claims | F.array_contains(identity, colour), None)
            .when(top >= C.DOMINANT_SHARE, problem("colour_identity", F.concat(F.lit("reads as "), colour)))
            .when(
                (F.size(hued) > 0) & (own < C.OWN_SHARE_MIN),
                problem("colour_identity", F.concat(F.lit("own colour only "), F.format_number(own, 2))),
            )
        ]
    )


def robust_spread(images: DataFrame) -> DataFrame:
    """Worst channel's median absolute deviation."""
    return images.select("image_id", F.greatest(*[A.median_deviation(F.col(c)) for c in "rgb"]).alias("deviation"))
