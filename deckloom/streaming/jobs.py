"""Live progress, catalogue upserts and the first-seen memo as Structured Streaming jobs.

Every sink is a folder of Parquet that a batch job can read while the stream runs (see `generations`). A micro-batch
writes its own delta and overwrites it when retried, so a lost executor or a restarted query never doubles a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deckloom.operators import catalogue, runs
from deckloom.streaming.generations import Generations


ONCE = {"availableNow": True}


# --- live progress ---------------------------------------------------------------------------
COUNTS = ["finished", "ok", "unsound", "failed", "timed", "seconds"]
TALLY = "job_id bigint, finished bigint, ok bigint, unsound bigint, failed bigint, timed bigint, seconds decimal(38,3)"


def _tallied(path: str, **sizes: int) -> Generations:
    def added(rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).cast("decimal(38,3)" if c == "seconds" else "bigint").alias(c) for c in COUNTS]
        return rows.groupBy("job_id").agg(*sums)

    return Generations(path, ["job_id"], added, **sizes)


def start_progress(results: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **sizes: int) -> StreamingQuery:
    """Sums per job, one row for each job that moved in a micro-batch. Seconds are kept to three decimals.

    Sums add up over deltas and runs, so the stream keeps no state, however many jobs there are, and needs no watermark:
    a row that comes late, even to a job long finished, counts like any other and none is dropped.

    `trigger` holds the arguments of Spark's trigger, for example {"processingTime": "5 seconds"}; by default
    what is there is worked off and the query ends. `sizes` are the `fan` and `buckets` of `generations`.
    """
    kept = _tallied(path, **sizes)
    results = results.withColumn("seconds", F.col("seconds").cast("decimal(28,3)"))

    def add(rows: DataFrame, batch: int) -> None:
        kept.put(runs.tallies(rows).select("job_id", *COUNTS), batch)

    return results.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).foreachBatch(add).start()


def read_progress(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """The sums so far per job, as the batch report shows them."""
    kept = _tallied(path)
    rows = kept.read(spark)
    sums = kept.merge(rows if rows is not None else spark.createDataFrame([], TALLY))
    joined = jobs.join(sums, "job_id", "left").fillna(0, COUNTS)
    remaining = F.greatest(F.lit(0), F.col("faces") - F.col("finished"))
    return joined.select(
        "job_id", "status", "faces", "finished", "ok", "unsound", "failed", remaining.alias("remaining"),
        runs.eta_seconds(F.col("status"), remaining, F.col("timed"), F.col("seconds").cast("double")).alias("eta_seconds"),
    )


# --- catalogue upserts -----------------------------------------------------------------------
def _newest(path: str, keys: list[str], order: list[str], **sizes: int) -> Generations:
    return Generations(path, keys, lambda rows: catalogue.latest(rows, keys, order), **sizes)


def start_upserts(
    rows: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, trigger: dict | None = None, **sizes: int
) -> StreamingQuery:
    """Each micro-batch adds its own newest version per key; versions are merged as `generations` says.

    `sizes` are its `fan` and `buckets`, which stay the same for the life of a folder.
    """
    kept = _newest(path, keys, order, **sizes)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).foreachBatch(kept.put).start()


def read_current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The current row per key over all versions that are left."""
    kept = _newest(path, keys, order)
    return kept.merge(kept.read(spark))


# --- first-seen memo -------------------------------------------------------------------------
def start_memo(rows: DataFrame, keys: list[str], path: str, checkpoint: str, trigger: dict | None = None, **sizes: int) -> StreamingQuery:
    """Insert-if-absent, with the memo itself as the only memory: the stream keeps no state, however many keys there are.

    A micro-batch looks its keys up in the buckets they fall in, by an anti-join that takes null for a key like any other.
    """
    memo = _memo(path, keys, **sizes)

    def absent(batch_rows: DataFrame, batch: int) -> None:
        new = batch_rows.select(*keys).dropDuplicates(keys)
        touched = [r[0] for r in new.select(memo.bucket()).distinct().collect()]  # one per bucket at most
        known = memo.read(batch_rows.sparkSession, before=batch, only=touched)
        if known is not None:
            known = known.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
            new = new.join(known, same, "left_anti")
        memo.put(new, batch)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).foreachBatch(absent).start()


def _memo(path: str, keys: list[str], **sizes: int) -> Generations:
    return Generations(path, keys, lambda rows: rows, **sizes)


def read_memo(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The keys seen so far, once each."""
    return _memo(path, keys).read(spark).select(*keys)
