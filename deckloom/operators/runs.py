"""Jobs and results: status, retries, progress, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import boxes as B
from deckloom.operators import scale

ABANDONED = "its worker is gone: run the job again"


def next_action(attempt: Column, attempts: Column, codes: Column, cost_lettered: Column) -> Column:
    """ship, repaint, escalate (cost wrong to the end: repaint without it) or store (unsound, no tries left)."""
    clean = F.size(codes) == 0
    spent = attempt >= F.greatest(F.lit(1), attempts)
    return (
        F.when(clean, "ship")
        .when(spent & cost_lettered & F.array_contains(codes, "cost_wrong"), "escalate")
        .when(spent, "store")
        .otherwise("repaint")
    )


def corrections(action: Column, codes: Column) -> Column:
    """What the next attempt is told; an escalation no longer mentions the cost."""
    none = F.array().cast("array<string>")
    return (
        F.when(action == "repaint", codes)
        .when(action == "escalate", F.filter(codes, lambda c: c != "cost_wrong"))
        .otherwise(none)
    )


def face_status(error: Column, codes: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(F.size(codes) > 0, "unsound").otherwise("ok")


def keeps_evidence(error: Column, codes: Column, mode: Column, always: Column) -> Column:
    return error.isNull() & (mode != "ART_ONLY") & ((F.size(codes) > 0) | always)


def reap(jobs: DataFrame, owner: int) -> DataFrame:
    """Fail jobs whose process is gone. A job that was never claimed (null) is left alone."""
    orphan = (
        F.col("status").isin("queued", "running") & F.col("worker_pid").isNotNull() & (F.col("worker_pid") != owner)
    )
    return jobs.withColumn("error", F.when(orphan, F.lit(ABANDONED))).withColumn(
        "status", F.when(orphan, F.lit("failed")).otherwise(F.col("status"))
    )


def is_permanent_refusal(reason: Column) -> Column:
    said = F.upper(F.coalesce(reason, F.lit("")))
    hit = F.lit(False)
    for word in C.REFUSAL_REASONS:
        hit = hit | F.endswith(said, F.lit(word))
    return hit


def with_boxes_named(results: DataFrame, part: str, boxes: str) -> DataFrame:
    """Results whose name contains the text, whatever its case, and whose boxes were stored."""
    return results.where(F.contains(F.lower("name"), F.lit(part.lower())) & F.col(boxes).isNotNull())


def status_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """ok, unsound, and everything else as failed (rejected names land there too)."""
    counted = results.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "unsound").alias("unsound"),
        F.count(F.lit(1)).alias("_all"),
    )
    return counted.withColumn("failed", F.col("_all") - F.col("ok") - F.col("unsound")).drop("_all")


def last_planned(planned: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One planned face per job and name: the last of its duplicates."""
    rest = [c for c in planned.columns if c not in [*keys, *order]]
    return planned.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def attach_plan(results: DataFrame, planned: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return scale.lookup(results, last_planned(planned, keys, order), keys)


def measured_faces(
    jobs: DataFrame, results: DataFrame, planned: DataFrame, order: list[str], part: str = "", since: int | None = None
) -> DataFrame:
    """One row per face with stored boxes: what was painted beside what its plan asked for.

    Of the newest `since` jobs (all when not given) the faces whose name contains `part`. `panels` holds the
    title box and the rules boxes as stored; strips that were painted apart owe their height together. The plan is
    the last of the job and name by `order`; `met` is null where it asks for nothing.
    """
    faces = with_boxes_named(results, part, "panels")
    if since is not None:  # at most `since` rows
        faces = faces.join(F.broadcast(last_jobs(jobs, since).select("job_id")), "job_id", "left_semi")
    placed = attach_plan(faces, planned, ["job_id", "name"], order)
    title_y, height = F.col("panels.title.y0"), B.total_height(F.coalesce(F.col("panels.rules"), F.array().cast(f"array<{B.BOX}>")))
    return placed.select(
        "job_id", *[c for c in order if c in faces.columns], "name", "status", title_y.alias("title_y"),
        F.coalesce(title_y <= C.BRIEF_TITLE_MAX_Y, F.lit(False)).alias("at_top"),
        height.alias("strip_height"), F.col("planned_asked").alias("asked"), (height >= F.col("planned_asked")).alias("met"),
    )


def compliance(results: DataFrame) -> DataFrame:
    """How often the asked-for surfaces were painted. Needs title_y, strip_height, asked.

    One row: faces, titles in the top tenth, strips asked and met, the interpolated median and the
    worst title height. The median is found by rank, not by gathering the values.
    """
    rates = results.agg(
        F.count(F.lit(1)).alias("faces"),
        F.count_if(F.col("title_y") <= C.BRIEF_TITLE_MAX_Y).alias("title_at_top"),
        F.count("asked").alias("asked"),
        F.count_if(F.col("strip_height") >= F.col("asked")).alias("met"),
        F.max("title_y").alias("worst_title_y"),
    )
    total = F.col("_total")
    ends = scale.values_at_ranks(
        results.select("title_y"), [], "title_y", {"low": F.floor((total + 1) / 2), "high": F.floor(total / 2) + 1}
    )
    middle = ends.select(((F.col("low") + F.col("high")) / 2).alias("median_title_y"))
    return rates.join(middle, F.lit(True), "left")


def eta_seconds(status: Column, remaining: Column, timed: Column, seconds: Column, workers: int = C.WORKERS) -> Column:
    """Mean of the timed faces times the batches left; a first guess while nothing is timed; null when over."""
    each = F.coalesce(seconds / F.nullif(timed, F.lit(0)), F.lit(float(C.FIRST_GUESS_SECONDS)))
    batches = F.ceil(remaining / max(1, workers))
    return (
        F.when(status.isin("done", "failed"), F.lit(None).cast("bigint"))
        .when(remaining == 0, F.lit(0).cast("bigint"))
        .otherwise(F.floor(each * batches).cast("bigint"))
    )


def tallies(results: DataFrame) -> DataFrame:
    """Mergeable per-job sums that progress is made of."""
    timed = F.coalesce(F.col("seconds"), F.lit(0)) != 0
    return results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("finished"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "unsound").alias("unsound"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(timed).alias("timed"),
        F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"),
    )


def progress(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Per job: faces, finished by status, remaining, ETA."""
    counts = ["finished", "ok", "unsound", "failed", "timed", "seconds"]
    joined = jobs.join(tallies(results), "job_id", "left").fillna(0, counts)
    remaining = F.greatest(F.lit(0), F.col("faces") - F.col("finished"))
    return joined.select(
        "job_id", "status", "faces", "finished", "ok", "unsound", "failed", remaining.alias("remaining"),
        eta_seconds(F.col("status"), remaining, F.col("timed"), F.col("seconds")).alias("eta_seconds"),
    )


def longest_run(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Longest run of consecutive index values per key, the earliest on ties.

    The window spans the distinct index values of a key (days, scanlines), never its rows.
    """
    distinct = rows.select(key, index).distinct()
    island = F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index))
    runs = distinct.withColumn("_island", island).groupBy(key, "_island").agg(
        F.min(index).alias("start"), F.max(index).alias("end")
    )
    length = F.col("end") - F.col("start")
    best = F.max_by(F.struct("start", "end"), F.struct(length, -F.col("start"))).alias("_best")
    return runs.groupBy(key).agg(best).select(key, "_best.*")


def first_exemplars(archetypes: DataFrame, files: DataFrame, count: int) -> DataFrame:
    """The first `count` files by path per archetype; an archetype with none is an error row.

    The rank filter is cut to `count` rows per task before the shuffle by Spark's group limit.
    """
    place = F.row_number().over(Window.partitionBy("archetype").orderBy("path"))
    chosen = files.select("archetype", "path").withColumn("place", place).where(F.col("place") <= count)
    return archetypes.join(chosen, "archetype", "left").withColumn(
        "error", F.when(F.col("path").isNull(), F.lit("no exemplars"))
    )


def last_jobs(jobs: DataFrame, count: int) -> DataFrame:
    return jobs.orderBy(F.col("created").desc(), F.col("job_id").desc()).limit(count)
