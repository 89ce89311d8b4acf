"""The compliance report on a small hand-made history."""

import datetime

import duckdb
from oracle import compare

from deckloom.operators import runs
from deckloom.plans import ORACLES, QUERIES

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
RESULT = f"job_id int, line int, name string, status string, panels struct<title:{BOX},rules:array<{BOX}>>"


def strip(top, bottom):
    return (0.1, top, 0.9, bottom)


def test_strips_owe_their_height_together(spark):
    jobs = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02"), (3, "2026-01-02")], "job_id int, created string")
    results = spark.createDataFrame(
        [
            (1, 1, "Bolt", "ok", (strip(0.05, 0.1), [strip(0.6, 0.9)])),  # of an older job
            (2, 1, "Bolt", "ok", (strip(0.05, 0.1), [strip(0.5, 0.625), strip(0.75, 0.875)])),  # 0.25 in two strips
            (2, 2, "bolt bend", "unsound", (strip(0.25, 0.3), [strip(0.5, 0.625)])),
            (2, 3, "Bear", "ok", (strip(0.05, 0.1), [])),  # another card
            (3, 1, "Firebolt", "ok", (None, None)),  # nothing was painted
            (3, 2, "Bolt", "failed", None),  # no boxes were stored
        ],
        RESULT,
    )
    planned = spark.createDataFrame(
        [(2, "Bolt", 1, 0.9), (2, "Bolt", 2, 0.25), (2, "bolt bend", 1, 0.2), (1, "Bolt", 1, 0.1)], "job_id int, name string, line int, planned_asked double"
    )
    rows = runs.measured_faces(jobs, results, planned, ["line"], part="bolt", since=2)
    got = {(r.job_id, r.line): (r.title_y, r.at_top, r.strip_height, r.asked, r.met) for r in rows.collect()}
    assert got == {
        (2, 1): (0.05, True, 0.25, 0.25, True), (2, 2): (0.25, False, 0.125, 0.2, False), (3, 1): (None, False, 0.0, None, None),
    }
    report = runs.compliance(rows).first()
    assert (report.faces, report.title_at_top, report.asked, report.met) == (3, 1, 2, 1)
    assert (report.median_title_y, report.worst_title_y) == (0.15, 0.25)
    assert runs.measured_faces(jobs, results, planned, ["line"]).count() == 5
    nothing = runs.compliance(runs.measured_faces(jobs, results.limit(0), planned, ["line"], since=1)).collect()
    assert [(r.faces, r.median_title_y) for r in nothing] == [(0, None)]


def test_staging_takes_the_callers_phrases(spark):
    from pyspark.sql import functions as F

    from deckloom.operators import briefs

    table = spark.createDataFrame([(9 - i, f"c{9 - i}") for i in range(9)], "place int, phrase string")
    cameras = briefs.phrase_list(table, "place", "phrase", 8)
    moments = F.array(*[F.lit(f"m{i}") for i in range(7)])
    names = spark.createDataFrame([("Bear",), ("Élan",), ("",)], "name string")
    camera, moment = briefs.staging(F.col("name"), cameras, moments)
    for r in names.select("name", camera.alias("c"), moment.alias("m")).collect():
        seed = sum(r.name.encode())
        assert (r.c, r.m) == (f"c{seed % 8 + 1}", f"m{seed // 8 % 7}")


def test_half_days_begin_at_the_rounded_second(spark, tmp_path):
    times = {
        1: ["2024-01-01 11:59:59.499999", "2024-01-01 23:59:59.500000", "2024-01-03 00:00:00"],
        2: ["2024-01-01 11:59:59.500000", "2024-01-01 23:59:59.700000", None],
        3: ["1969-12-31 12:00:00.4", "1969-12-31 11:59:59.6", "1969-12-31 23:59:59.6", "1970-01-01 11:59:59.2"],
        4: [None],
        None: ["2024-01-01 11:59:59.9", "2024-01-01 12:00:00"],
    }
    rows = [(user, t and datetime.datetime.fromisoformat(t).replace(tzinfo=datetime.timezone.utc)) for user, ts in times.items() for t in ts]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT user_id, ts::TIMESTAMP AS ts FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    db.execute("SET TimeZone='UTC'")
    assert compare(spark, db, QUERIES["w4_longest_run"], ORACLES["w4_longest_run"], str(tmp_path)) == ""
