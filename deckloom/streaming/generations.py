"""A folder of Parquet that micro-batches add to and that stays quick to read.

Each micro-batch writes one delta. When `fan` deltas have come, they are merged into a run; when `fan` runs of a
level have come, they are merged into one of the next level. So every row is rewritten once per level, levels grow with the
logarithm of the batches, and a reader opens fewer than `fan` deltas and, per level, fewer than `fan` files a bucket.

    delta/_batch=17/           rows of micro-batch 17
    runs/_run=15-1/_bucket=3/  what batch 15 merged into level 1, by hash of the keys
    manifest/version=15/       which runs there are, and up to which batch they hold everything

A merge becomes visible with its manifest, one file that is renamed into place; until then readers see the runs and
deltas before it. A retried batch overwrites its own delta, runs and manifest and nothing else. What the last two
manifests do not name is removed, so a reader has until the merge after next to finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, BUCKETS = 8, 16
Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    #: everything up to this batch is in the runs
    upto: int = -1
    #: (id, level)
    runs: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Generations:
    """`keys` deal runs into `buckets`. `merge` makes one row per key of several, and may be applied to parts first and to what came of them then."""

    path: str
    keys: list[str]
    merge: Merge
    fan: int = FAN
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # --- what is there ---
    def manifests(self, spark: SparkSession) -> list[Manifest]:
        """The newest two, newest first."""
        versions = _children(spark, f"{self.path}/manifest", "version=")
        out = []
        for version in sorted(versions, key=int, reverse=True):
            rows = spark.read.text(f"{self.path}/manifest/version={version}").collect()  # one line
            if rows:  # none while a retried batch rewrites it
                told = json.loads(rows[0][0])
                out.append(Manifest(int(version), told["upto"], tuple((i, level) for i, level in told["runs"])))
            if len(out) == 2:
                break
        return out

    def deltas(self, spark: SparkSession, after: int) -> list[int]:
        return sorted(b for b in map(int, _children(spark, f"{self.path}/delta", "_batch=", done=True)) if b > after)

    def read(self, spark: SparkSession, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """All rows of the runs and of the deltas behind them; None when there is nothing yet.

        `before` leaves out the deltas of that batch and later ones; `only` reads these buckets alone.
        """
        now = (self.manifests(spark) or [Manifest()])[0]
        deltas = [b for b in self.deltas(spark, now.upto) if before is None or b < before]
        parts = [self._runs(spark, now.runs, only), self._deltas(spark, deltas, only)]
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    def _runs(self, spark: SparkSession, runs: tuple[tuple[str, int], ...], only: list[int] | None = None) -> DataFrame | None:
        if not runs:
            return None
        base = f"{self.path}/runs"
        rows = spark.read.option("basePath", base).parquet(*[f"{base}/_run={i}" for i, _ in runs])
        return (rows if only is None else rows.where(F.col("_bucket").isin(only))).drop("_run", "_bucket")

    def _deltas(self, spark: SparkSession, deltas: list[int], only: list[int] | None = None) -> DataFrame | None:
        if not deltas:
            return None
        base = f"{self.path}/delta"
        rows = spark.read.option("basePath", base).parquet(*[f"{base}/_batch={b}" for b in deltas]).drop("_batch")
        return rows if only is None else rows.where(self.bucket().isin(only))

    # --- what a micro-batch does ---
    def put(self, rows: DataFrame, batch: int) -> None:
        """The batch's rows, one per key, instead of what an earlier try of it has written; then merges that are due."""
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/delta/_batch={batch}")
        self.compact(rows.sparkSession, batch)

    def compact(self, spark: SparkSession, batch: int) -> None:
        known = self.manifests(spark)
        now = known[0] if known else Manifest()
        if now.version >= batch:  # a retry of a batch whose merge is in place
            return
        deltas = self.deltas(spark, now.upto)
        if len(deltas) < self.fan:
            return
        runs, level, rows = list(now.runs), 1, self._deltas(spark, deltas)
        while len(same := [r for r in runs if r[1] == level]) >= self.fan - 1:
            rows = rows.unionByName(self._runs(spark, tuple(same)))
            runs = [r for r in runs if r[1] != level]
            level += 1
        name = f"{batch}-{level}"
        merged = self.merge(rows).withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket")
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/runs/_run={name}")
        told = json.dumps({"upto": deltas[-1], "runs": [*runs, (name, level)]})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={batch}")
        self._retire(spark, {name, *(i for i, _ in runs), *(i for i, _ in now.runs)}, now)

    def _retire(self, spark: SparkSession, named: set[str], before: Manifest) -> None:
        for version in map(int, _children(spark, f"{self.path}/manifest", "version=")):
            if version < before.version:
                _remove(spark, f"{self.path}/manifest/version={version}")
        for run in _children(spark, f"{self.path}/runs", "_run="):
            if run not in named:
                _remove(spark, f"{self.path}/runs/_run={run}")
        for delta in map(int, _children(spark, f"{self.path}/delta", "_batch=")):
            if delta <= before.upto:
                _remove(spark, f"{self.path}/delta/_batch={delta}")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _children(spark: SparkSession, path: str, prefix: str, done: bool = False) -> list[str]:
    """What stands behind the prefix in the names of folders; with `done` only of those whose write has ended."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return []
    names = [x.getPath().getName() for x in files.listStatus(at) if x.isDirectory()]
    mine = [n for n in names if n.startswith(prefix)]
    if done:
        success = spark._jvm.org.apache.hadoop.fs.Path
        mine = [n for n in mine if files.exists(success(f"{path}/{n}/_SUCCESS"))]
    return [n[len(prefix) :] for n in mine]


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)
