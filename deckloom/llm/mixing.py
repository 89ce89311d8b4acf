"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Shares of tokens are raised to a power between 1 (as they are) and 0 (all equal). The power is bisected until the
weights have the target entropy, and back towards 1 where a source would be repeated more often than allowed.
Each source's documents form blocks; a keyed permutation of the blocks is walked until the source's
budget is met, once per pass over the source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deckloom.llm.common import private, settled

#: Consecutive document ids in a block; hash ranges in which blocks of a source are ordered.
BLOCK_IDS, RANGE_DIGITS = 64, 3
#: Powers tried in each pass over the sources: four halvings at a time.
POINTS, PASSES = 15, 12
#: A quota this near to whole passes, relative to itself, is meant as whole passes; doubles miss them by rounding.
NEAR = 1e-11


def tokens(text: Column | str) -> Column:
    """Words of the text between blanks. Null and blank texts have none."""
    text = F.trim(F.regexp_replace(text, r"\s+", " ")) if isinstance(text, Column) else F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


@dataclass(frozen=True)
class Mix:
    """The power, and what one token of weight costs: weight = (tokens / total) ** power / norm."""

    power: float
    norm: float
    total: int
    sources: int
    budget: float


def _sums(sizes: DataFrame, total: int, powers: list[float]) -> list[tuple[float, float, float]]:
    """For each power: sum of p^a, sum of p^a ln p, and the largest p^(a-1); one pass, merged before the shuffle."""
    p = F.col("n_tokens") / F.lit(float(total))
    row = sizes.agg(*[x for i, a in enumerate(powers) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"r{i}"))]).head()
    return [(row[f"z{i}"], row[f"l{i}"], row[f"r{i}"]) for i in range(len(powers))]


def solve(sizes: DataFrame, entropy: float, repeats: float, budget_tokens: int | None = None) -> Mix | None:
    """The power for ``sizes`` (source, n_tokens). None if no source has a token.

    ``entropy`` is the target as a share of the most that so many sources can have; the largest power in [0, 1] that
    reaches it is taken, 1 if the shares reach it as they are. ``repeats`` limits how often a token of any source is used;
    it comes first, and raises the power if need be. ``budget_tokens`` None: the least budget that uses every
    source at least once. The sources are never gathered: each pass sends back a few numbers per power.
    """
    sizes = sizes.where("n_tokens > 0")
    head = sizes.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most")).head()
    if not head["t"]:
        return None
    total, count = int(head["t"]), int(head["s"])
    p_most = head["most"] / total

    def budget(z: float, a: float) -> float:
        # a source's repeats are budget * weight / tokens; the largest source has the fewest
        return float(budget_tokens) if budget_tokens is not None else total * z * p_most ** (1 - a)

    goal = entropy * math.log(count)

    def found(ok) -> float:
        """The end of [0, 1] up to which ``ok`` changes, to 2^-48. ok holds from the returned side on."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            at = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            good = [ok(a, *s) for a, s in zip(at, _sums(sizes, total, at))]
            ends = [low, *at, high]
            k = next((i for i, g in enumerate(good) if g), POINTS)
            low, high = ends[k], ends[k + 1]
            if high - low < 1e-15:
                break
        return high

    h = lambda a, z, lp: math.log(z) - a * lp / z
    (z0, l0, r0), (z1, l1, r1) = _sums(sizes, total, [0.0, 1.0])
    low_enough = lambda a, z, lp, r: h(a, z, lp) < goal
    a = 1.0 if h(1.0, z1, l1) >= goal else 0.0 if h(0.0, z0, l0) <= goal else found(low_enough)
    z, lp, r = _sums(sizes, total, [a])[0]
    over = lambda a, z, r: budget(z, a) / total * r / z > repeats * (1 + 1e-12)
    if over(a, z, r) and not over(1.0, z1, r1):
        a = max(a, found(lambda a, z, lp, r: not over(a, z, r)))
        z = _sums(sizes, total, [a])[0][0]
    elif over(a, z, r):
        a, z = 1.0, z1
    return Mix(a, z, total, count, budget(z, a))


def mix(docs: DataFrame, entropy: float, repeats: float, budget_tokens: int | None = None, seed: str = "mix",
        id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document row: id, source, n_tokens, block, weight, quota (tokens for its source), copies.

    ``copies`` is how often the mixture uses the row: whole passes over its source, and one more if its block is among those
    that fit in what is left of the quota (a block that would pass the quota is left out, later smaller ones are not tried).
    A null source is a source of its own. Rows without tokens cost nothing and are used once per whole pass.
    Null ids share a block. With no token in the table every row is used once. Copies over a
    source exceed ``repeats`` only where the limit itself is below one pass.

    Documents are read once for their token counts; afterwards only narrow rows are shuffled. A source with a third of
    the rows is ordered in hash ranges of its blocks, so no task orders a source.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), tokens(text).alias("n_tokens"))
    plain = settled(plain.withColumn("block", F.floor(F.col("doc_id") / BLOCK_IDS)), "mix-rows")
    sizes = settled(plain.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(8), "mix-sizes")
    got = solve(sizes, entropy, repeats, budget_tokens)
    if got is None:
        return plain.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).alias("copies"))
    share = F.col("source_tokens") / F.lit(float(got.total))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("\u0000")), F.coalesce(F.col("block").cast("string"), F.lit("-"))))
    blocks = plain.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = settled(blocks.withColumn("place", order).withColumn("range", F.substring("place", 1, RANGE_DIGITS)), "mix-blocks")
    # start of each block in its source's permutation: sums of the ranges before, then within the range
    ranges = blocks.groupBy("source", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("before"), F.sum("range_tokens").over(W.partitionBy("source")).alias("source_tokens"))
    within = W.partitionBy("source", "range").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.withColumn("within", F.coalesce(F.sum("block_tokens").over(within), F.lit(0)))
    placed = placed.join(ranges.withColumnRenamed("source", "s").withColumnRenamed("range", "r"), F.expr("source <=> s and range = r"))
    weight = F.when(F.col("source_tokens") > 0, F.pow(share, F.lit(got.power)) / F.lit(got.norm)).otherwise(0.0)
    wanted = F.col("weight") * F.lit(got.budget)
    quota = F.floor(wanted + 1e-6)
    if budget_tokens is None:  # every source at least once
        whole = F.round(wanted / F.expr("nullif(source_tokens, 0)")).cast("long") * F.col("source_tokens")
        quota = F.greatest(F.when(F.abs(wanted - whole) <= NEAR * wanted, whole).otherwise(quota), F.col("source_tokens"))
    placed = placed.withColumn("weight", weight).withColumn("quota", quota)
    passes = F.when(F.col("source_tokens") > 0, F.expr("quota div source_tokens")).otherwise(1)
    rest = F.col("quota") - F.col("passes") * F.col("source_tokens")
    fits = (F.col("block_tokens") > 0) & (F.col("before") + F.col("within") + F.col("block_tokens") <= rest)
    placed = placed.withColumn("passes", passes).withColumn("copies", (F.col("passes") + fits.cast("int")).cast("int"))
    placed = placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "quota", "copies")
    return plain.join(placed, F.expr("source <=> s and block <=> b")).select("doc_id", "source", "n_tokens", "block", "weight", "quota", "copies")


def apply(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """``docs`` with every row as often as ``mixture`` (of the same ids and sources) says. Rows of one id and source share a block, so their copies are equal."""
    ident, origin, copies, copy = (private(f"__{n}", docs.columns) for n in ("id", "source", "copies", "copy"))
    used = mixture.where("copies > 0").select(F.col("doc_id").alias(ident), F.col("source").alias(origin), F.col("copies").alias(copies)).distinct()
    out = docs.join(used, F.col("doc_id").eqNullSafe(F.col(ident)) & docs["source"].cast("string").eqNullSafe(F.col(origin)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
