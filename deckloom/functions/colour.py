"""Colour expressions: contrast, hue, mana colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deckloom import constants as C


def luminance(value: Column) -> Column:
    """Linear light of an sRGB channel value 0-255."""
    channel = value / 255
    return F.when(channel <= 0.03928, channel / 12.92).otherwise(F.pow((channel + 0.055) / 1.055, F.lit(2.4)))


def contrast(value: Column, ink: Column) -> Column:
    return (luminance(value) + 0.05) / (luminance(ink) + 0.05)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b) / 255, F.least(r, g, b) / 255
    return F.when(top > low, (top - low) / top).otherwise(F.lit(0.0))


def hue_degrees(r: Column, g: Column, b: Column) -> Column:
    most = F.greatest(r, g, b)
    top = most / 255
    span = top - F.least(r, g, b) / 255
    rc, gc, bc = (top - r / 255) / span, (top - g / 255) / span, (top - b / 255) / span
    sixth = F.when(r == most, bc - gc).when(g == most, 2.0 + rc - bc).otherwise(4.0 + gc - rc) / 6
    return F.when(span > 0, F.pmod(sixth, F.lit(1.0)) * 360).otherwise(F.lit(0.0))


def is_saturated(r: Column, g: Column, b: Column) -> Column:
    return (saturation(r, g, b) > C.SATURATION_MIN) & (F.greatest(r, g, b) / 255 > C.VALUE_MIN)


def bucket_of_degree(degree: int) -> str:
    for name, low, high, _mana in C.HUE_BUCKETS:
        if low <= degree < high or (low > high and (degree >= low or degree < high)):
            return name
    return "red"


def hue_bucket(degrees: Column) -> Column:
    """Bucket of a hue. The limits are whole degrees, so one look-up by the whole degree is enough."""
    by_degree = F.array(*[F.lit(bucket_of_degree(d)) for d in range(360)])
    return F.coalesce(F.get(by_degree, F.floor(degrees).cast("int")), F.lit("red"))


def bucket_mana(bucket: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _low, _high, mana in C.HUE_BUCKETS:
        if mana:
            out = F.when(bucket == name, mana).otherwise(out)
    return out


def colour_names(identity: Column, joiner: str = " and ") -> Column:
    """Names of the mana colours in the order of the identity; letters with no name are left out."""
    names = F.create_map(*[F.lit(x) for pair in C.COLOUR_NAMES.items() for x in pair])
    return F.array_join(F.filter(F.transform(identity, lambda c: names[c]), lambda n: n.isNotNull()), joiner)
