"""Shapes that keep one hot key from landing in one task.

A plain groupBy with mergeable aggregates needs none of this: Spark combines before it shuffles.
These are for what does not merge: dense numbers in a group, an exact rank in a group, and a lookup
whose fact side is mostly one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_PARTS = 1000
SALTS = 64
#: Parts that a cell is cut into, and how often, on the way to a rank.
CELLS, RECUTS = 8192, 3


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, however often later expressions use them.

    The optimizer merges projections and would repeat an array expression at every use, inside other
    lambdas even per element. A one-element generator is a step it does not merge.
    """
    packed = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline(packed))


def number_in_group(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "ordinal"
) -> DataFrame:
    """One-based dense number of each row within its keys, in two levels.

    `bucket` is any expression that does not fall as `order` rises and holds a bounded number of
    rows per key. Rows are ranked inside (keys, bucket); only the bucket counts, not the rows, are
    summed along the whole key.
    """
    parts = [*keys, "_bucket"]
    here = Window.partitionBy(*parts)
    local = (
        df.withColumn("_bucket", bucket)
        .withColumn("_local", F.row_number().over(here.orderBy(*order)))
        .withColumn("_n", F.count(F.lit(1)).over(here))
    )
    # one row per bucket, from the rows that are already together
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = local.where(F.col("_local") == 1).select(*parts, F.sum("_n").over(along).alias("_before"))
    return (
        local.join(before, parts)
        .withColumn(out, F.coalesce("_before", F.lit(0)).cast("bigint") + F.col("_local"))
        .drop("_bucket", "_local", "_n", "_before")
    )


def _magnitude(value: Column) -> Column:
    """A whole number that never falls as the value rises: which power of two it has, with its sign. NaN is last."""
    number = value.cast("double")
    size = F.least(F.floor(F.log2(F.abs(number))), F.lit(1100)) + 1200
    return (
        F.when(F.isnan(number), F.lit(9999)).when(number > 0, size).when(number < 0, -size).otherwise(F.lit(0)).cast("int")
    )


def _between(value: Column, low: Column, high: Column) -> Column:
    """Which of CELLS equal parts of low..high holds the value. Halves keep the widest range finite."""
    part, whole = (end.cast("double") / 2 - low.cast("double") / 2 for end in (value, high))
    return F.when(whole > 0, F.least(F.lit(CELLS - 1), F.floor(part / whole * CELLS)).cast("int")).otherwise(F.lit(0))


def _narrowed(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The few values among which each rank lies: keys, _which, value, its count _n, and the _rank among them.

    Repeats collapse to (value, count) first. A group is then cut by powers of two, and the cell that
    holds a rank is cut RECUTS times into CELLS parts of what it really spans; all of that is counting, so no
    task holds a group. Between two neighbouring powers of two lie 2^52 doubles, so what is left to order at the end
    are a few thousand values at most, wherever outliers lie and however uneven the spread is.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    asked = F.array(*[F.struct(F.lit(name).alias("_which"), rank.cast("bigint").alias("_rank")) for name, rank in ranks.items()])
    wanted = counted.groupBy(*keys).agg(F.sum("_n").alias("_total")).select(*keys, F.inline(asked))
    left = (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank")
    span = [F.sum("_n").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")]

    pool = counted.withColumn("_cell", _magnitude(F.col(value)))
    cells = pool.groupBy(*keys, "_cell").agg(*span).withColumn("_upto", F.sum("_n").over(_along(keys, "_cell")))
    hits = (cells.join(wanted, keys) if keys else cells.join(F.broadcast(wanted), F.lit(True))).where(_found())
    group = [*keys, "_which"]
    for _ in range(RECUTS):
        hits = hits.select(*group, "_cell", left, "_low", "_high")
        inside = pool.join(hits, [c for c in pool.columns if c not in (value, "_n")])
        pool = inside.select(*group, value, "_n", "_rank", _between(F.col(value), F.col("_low"), F.col("_high")).alias("_cell"))
        cells = pool.groupBy(*group, "_rank", "_cell").agg(*span)
        hits = cells.withColumn("_upto", F.sum("_n").over(_along(group, "_cell"))).where(_found())
        pool = pool.drop("_rank")
    return pool.join(hits.select(*group, "_cell", left), [*group, "_cell"])


def values_at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact values at one-based ranks per key, one column per name in `ranks`; null where a group ends before.

    A rank may use the group's row count, column `_total`; null values do not count, and a group without
    values has no row. See `_narrowed` for how no task comes to hold a group.
    """
    group = [*keys, "_which"]
    upto = F.sum("_n").over(_along(group, value))
    values = _narrowed(df, keys, value, ranks).withColumn("_upto", upto).where(_found())
    picked = [F.max(F.when(F.col("_which") == name, F.col(value))).alias(name) for name in ranks]
    return values.groupBy(*keys).agg(*picked)


def _found() -> Column:
    """The row in whose stretch of a running count the rank lies."""
    return (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))


def _along(keys: list[str], order: str):
    return Window.partitionBy(*keys or [F.lit(0)]).orderBy(order)


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, out: str) -> DataFrame:
    """`values_at_ranks` for one rank."""
    return values_at_ranks(df, keys, value, {out: rank})


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one part in HOT_PARTS of the rows: fewer than HOT_PARTS by arithmetic.

    Pass the narrowest frame that has the keys, since it is read once more for this.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    everything = counts.agg(F.sum("_n").alias("_all"))
    floor = F.greatest(F.col("_all"), F.lit(HOT_PARTS * HOT_PARTS))
    return (
        counts.join(F.broadcast(everything), F.col("_n") * HOT_PARTS > floor)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def lookup(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join facts to a side with few rows per key.

    Without `hot` it is an ordinary unhinted join: Spark broadcasts a side that measures small and
    splits skewed partitions at run time. With `hot` (see `hot_keys`, bounded, so broadcast) the hot
    and the null keys are spread over SALTS copies by hand; every other key joins once.
    """
    if hot is None:
        return facts.join(dim, keys, how)
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    loose = is_hot
    for key in keys:
        loose = loose | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int")
    left = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(loose, spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
