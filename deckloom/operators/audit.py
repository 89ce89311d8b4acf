"""Which rule sets grade a face, and in what order, by how it was made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ART_ONLY, COMPOSITED, LETTERED, NAME_ONLY = "art_only", "composited", "lettered", "name_only"
# mode → rule sets in report order; `matte` counts only for a borderless face, `collision` of a
# lettered face only where the cost is stamped
ORDER = {
    ART_ONLY: ["colour", "matte"],
    COMPOSITED: ["layout", "cover", "contrast", "colour", "matte"],
    LETTERED: ["text", "collision", "badge", "contrast", "colour", "matte"],
    NAME_ONLY: ["title_text", "collision", "layout", "cover", "contrast", "colour", "matte"],
}


PROBLEMS = "array<struct<code:string,detail:string>>"


def needed(name: str, mode: Column, borderless: Column, cost_stamped: Column) -> Column:
    """Whether a face's mode asks for a rule set at all: filter a set's input by this before working it out."""
    asked = [which for which, names in ORDER.items() if name in names]
    if name == "matte":
        return mode.isin(*asked) & borderless
    if name == "collision":
        return mode.isin(*[m for m in asked if m != LETTERED]) | ((mode == LETTERED) & cost_stamped)
    return mode.isin(*asked)


def gather(faces: DataFrame, key: str, found: list[DataFrame]) -> DataFrame:
    """`faces` (its key column) with the problems of every rule set; null where a set has none for a face.

    Each of `found` holds the key and a column of problems per rule set that shares its input. They meet in one grouped
    step, so there is one shuffle however many there are; of repeated rows of a face and set the greatest counts.
    """
    names = [c for df in found for c in df.columns if c != key]
    rows = [df.select(key, *[F.col(c).cast(PROBLEMS).alias(c) for c in df.columns if c != key]) for df in found]
    tall = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows, faces.select(key, F.lit(True).alias("_asked")))
    grouped = tall.groupBy(key).agg(F.max("_asked").alias("_asked"), *[F.max(n).alias(n) for n in names])
    return grouped.where("_asked").drop("_asked")


def by_mode(mode: Column, borderless: Column, cost_stamped: Column, sets: dict[str, Column]) -> Column:
    """All problems of a face. `sets` gives each rule set's problem array, null where it has no input."""
    none = F.array().cast(PROBLEMS)

    def part(name: str, which: str) -> Column:
        found = F.coalesce(sets[name], none)
        if name == "matte":
            return F.when(borderless, found).otherwise(none)
        if name == "collision" and which == LETTERED:
            return F.when(cost_stamped, found).otherwise(none)
        return found

    out = None
    for which, names in ORDER.items():
        joined = F.concat(*[part(n, which) for n in names])
        out = F.when(mode == which, joined) if out is None else out.when(mode == which, joined)
    return out.otherwise(none)
