"""Streams over several micro-batches end where a batch job over all rows ends."""

import datetime
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from deckloom.operators import catalogue, runs
from deckloom.sources import records
from deckloom.streaming import jobs as streams
from deckloom.streaming.generations import Generations

RESULT = "job_id long, status string, seconds long, created timestamp"
DAY = datetime.datetime(2026, 1, 1)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def in_batches(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_progress(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[(1, "ok", 10, DAY), (2, "failed", 0, DAY)], [(1, "unsound", 30, DAY)], [(1, "ok", 20, DAY), (3, "ok", 5, DAY)]]
    for rows in batches:
        write(spark, source, rows, RESULT)
    jobs = spark.createDataFrame([(1, "running", 9), (2, "done", 1), (3, "running", 1), (4, "queued", 5)], "job_id long, status string, faces long")
    streams.start_progress(in_batches(spark, source, RESULT), out, state).awaitTermination()
    batch = runs.progress(jobs, spark.read.parquet(source))
    assert sorted(map(tuple, streams.read_progress(spark, out, jobs).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    eta = {r.job_id: r.eta_seconds for r in batch.collect()}
    assert eta == {1: 40, 2: None, 3: 0, 4: 120}
    # a rerun over the same checkpoint adds nothing; a new file moves only its own job
    write(spark, source, [(4, "ok", 7, DAY)], RESULT)
    streams.start_progress(in_batches(spark, source, RESULT), out, state).awaitTermination()
    batch = runs.progress(jobs, spark.read.parquet(source))
    assert sorted(map(tuple, streams.read_progress(spark, out, jobs).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_late_rows_count_and_no_state_is_kept(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    jobs = spark.createDataFrame([(i, "running", 40) for i in range(4)], "job_id long, status string, faces long")
    assert [r.finished for r in streams.read_progress(spark, out, jobs).collect()] == [0] * 4
    rng = random.Random(5)
    for k in range(11):  # the last files hold the oldest rows
        rows = [(rng.randrange(4), rng.choice(["ok", "failed", "unsound"]), rng.randrange(9), DAY - datetime.timedelta(days=40 * k)) for _ in range(6)]
        write(spark, source, rows, RESULT)
    query = streams.start_progress(in_batches(spark, source, RESULT), out, state, fan=3, buckets=2)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    batch = runs.progress(jobs, spark.read.parquet(source))
    assert sorted(map(tuple, streams.read_progress(spark, out, jobs).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_upserts_and_memo(spark, tmp_path):
    source, out, state, memo, memo_state = (str(tmp_path / n) for n in ("in", "out", "state", "memo", "memo_state"))
    schema = "id string, ts long, v string"
    for rows in ([("a", 1, "x"), ("b", 5, "y"), ("a", 3, "z")], [("a", 2, "late"), ("b", 6, "new")], [("c", 1, "only")]):
        write(spark, source, rows, schema)
    streams.start_upserts(in_batches(spark, source, schema), ["id"], ["ts"], out, state).awaitTermination()
    current = {r.id: r.v for r in streams.read_current(spark, out, ["id"], ["ts"]).collect()}
    assert current == {"a": "z", "b": "new", "c": "only"}
    assert {r.id: r.v for r in catalogue.latest(spark.read.parquet(source), ["id"], ["ts"]).collect()} == current
    streams.start_memo(in_batches(spark, source, schema), ["id"], memo, memo_state).awaitTermination()
    assert sorted(r.id for r in streams.read_memo(spark, memo, ["id"]).collect()) == ["a", "b", "c"]


def test_actions_and_records(spark, tmp_path):
    rows = [(1, []), (1, ["busy"]), (2, ["busy"]), (2, ["cost_wrong", "busy"])]
    df = spark.createDataFrame(rows, "attempt int, codes array<string>")
    action = runs.next_action(F.col("attempt"), F.lit(2), F.col("codes"), F.lit(True))
    got = [(r.a, r.c) for r in df.withColumn("a", action).withColumn("c", runs.corrections(F.col("a"), F.col("codes"))).collect()]
    assert got == [("ship", []), ("repaint", ["busy"]), ("store", []), ("escalate", ["busy"])]
    path = str(tmp_path / "record")
    for batch, size in (("p", 2), ("q", 3), ("p", 1)):
        records.write_records(spark.range(size).withColumn("pack", F.lit(batch)), path, "pack")
    assert {r.pack: r.n for r in spark.read.parquet(path).groupBy("pack").agg(F.count("*").alias("n")).collect()} == {"p": 1, "q": 3}
    summary = spark.createDataFrame([("ruled_rows", 1.0)], "metric string, mean double")
    cards = spark.createDataFrame([("Bear", '{"ruled_rows": 1, "q": "\\"x\\""}'), ("Bolt", None)], "name string, metrics string")
    for _ in range(2):  # a repeated report replaces itself
        records.write_report(summary, cards, str(tmp_path / "report"))
        got, told = records.read_report(spark, str(tmp_path / "report"))
        assert got.count() == 1 and sorted(map(tuple, told.collect())) == sorted(map(tuple, cards.collect()))


def test_records_after_a_failed_try(spark, tmp_path):
    path = str(tmp_path / "record")
    rows = spark.range(6).selectExpr("cast(id % 2 as string) AS pack", "id")
    records.write_records(rows, path, "pack")

    @F.pandas_udf("long")
    def torn(n):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        records.write_records(rows.where("pack = '1'").withColumn("id", torn("id")), path, "pack")
    records.write_records(rows.where("pack = '1' and id > 1"), path, "pack")
    assert sorted((r.pack, r.id) for r in records.read_records(spark, path).selectExpr("cast(pack as string) pack", "id").collect()) == [("0", 0), ("0", 2), ("0", 4), ("1", 3), ("1", 5)]


def test_orphans(spark):
    rows = [(1, "running", 7), (2, "running", 1), (3, "queued", None), (4, "done", 7)]
    jobs = spark.createDataFrame(rows, "job_id int, status string, worker_pid int")
    assert {r.job_id: r.status for r in runs.reap(jobs, owner=1).collect()} == {1: "failed", 2: "running", 3: "queued", 4: "done"}


def test_fractional_seconds(spark, tmp_path):
    from deckloom.streaming import jobs as J

    (tmp_path / "in").mkdir()
    schema = "job_id bigint, status string, seconds double"
    spark.createDataFrame([(1, "ok", 10.5), (1, "ok", 9.5), (1, "failed", 0.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    J.start_progress(stream, str(tmp_path / "out"), str(tmp_path / "check"), trigger={"availableNow": True}).awaitTermination()
    jobs = spark.createDataFrame([(1, "running", 5)], "job_id bigint, status string, faces int")
    row = J.read_progress(spark, str(tmp_path / "out"), jobs).head()
    assert (row["finished"], row["remaining"], row["ok"]) == (3, 2, 2)
    assert row["eta_seconds"] is not None


VERSIONS = "id string, ts long, v string"


def versions(tmp_path, fan=3, buckets=4):
    return Generations(str(tmp_path / "kept"), ["id"], lambda rows: catalogue.latest(rows, ["id"], ["ts"]), fan, buckets)


def folders(tmp_path, name):
    at = tmp_path / "kept" / name
    return sorted(p.name for p in at.iterdir() if p.is_dir()) if at.exists() else []


def test_merges_keep_files_few_and_answers_right(spark, tmp_path):
    kept, rng, newest = versions(tmp_path), random.Random(1), {}
    for batch in range(40):
        rows = [(f"k{rng.randrange(30)}", rng.randrange(10**6), f"{batch}-{i}") for i in range(8)]
        for row in rows:
            newest[row[0]] = max(newest.get(row[0], row), row, key=lambda r: (r[1], r))
        kept.put(spark.createDataFrame(rows, VERSIONS), batch)
        now = (kept.manifests(spark) or [None])[0]
        levels = [level for _, level in now.runs] if now else []
        assert len(kept.deltas(spark, now.upto if now else -1)) < 3 and all(levels.count(x) < 3 for x in levels)
    got = {r.id: (r.id, r.ts) for r in kept.merge(kept.read(spark)).collect()}
    assert got == {k: (k, r[1]) for k, r in newest.items()}
    # 40 batches: 13 merges of three; what two manifests do not name is gone
    assert len(folders(tmp_path, "manifest")) == 2
    assert len(folders(tmp_path, "runs")) <= 2 * 3 * 3 and len(folders(tmp_path, "delta")) <= 2 * 3
    for run in (tmp_path / "kept" / "runs").iterdir():
        assert all(len(list(b.glob("part-*"))) == 1 for b in run.glob("_bucket=*"))
    some = kept.read(spark, only=[0]).select("id").distinct().count()
    assert 0 < some < 30


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    kept = versions(tmp_path)
    rows = [spark.createDataFrame([("a", b, f"v{b}"), (f"own{b}", 1, "x")], VERSIONS) for b in range(6)]
    for batch in range(6):
        kept.put(rows[batch], batch)
        kept.put(rows[batch], batch)  # the query was stopped before it noted the batch
        assert kept.merge(kept.read(spark)).count() == batch + 2
    assert kept.merge(kept.read(spark)).where("id = 'a'").first().v == "v5"


@pytest.mark.parametrize("stop", ["delta", "run", "manifest"])
def test_a_merge_that_is_cut_off_is_made_again(spark, tmp_path, monkeypatch, stop):
    kept = versions(tmp_path)
    rows = [spark.createDataFrame([("a", b, f"v{b}"), (f"own{b}", 1, "x")], VERSIONS) for b in range(3)]
    kept.put(rows[0], 0)
    kept.put(rows[1], 1)
    write = DataFrameWriter.parquet if stop != "manifest" else DataFrameWriter.text

    def lost(self, path, *args, **kwargs):
        if {"delta": "delta/_batch=2", "run": "runs/", "manifest": "manifest/"}[stop] in path:
            raise RuntimeError("lost")
        return write(self, path, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "text" if stop == "manifest" else "parquet", lost)
        with pytest.raises(RuntimeError):
            kept.put(rows[2], 2)
    before = {r.id for r in kept.merge(kept.read(spark)).collect()}  # a reader between the tries
    assert before == {"a", "own0", "own1"} | ({"own2"} if stop != "delta" else set())
    kept.put(rows[2], 2)
    assert {r.id for r in kept.merge(kept.read(spark)).collect()} == {"a", "own0", "own1", "own2"}
    assert [level for _, level in kept.manifests(spark)[0].runs] == [1]


def test_a_reader_may_finish_after_the_next_merge(spark, tmp_path):
    kept = versions(tmp_path)
    for batch in range(3):
        kept.put(spark.createDataFrame([(f"k{batch}", 1, "x")], VERSIONS), batch)
    opened = kept.read(spark)
    for batch in range(3, 6):
        kept.put(spark.createDataFrame([(f"k{batch}", 1, "x")], VERSIONS), batch)
    assert opened.count() == 3


def test_memo_without_state(spark, tmp_path):
    source, memo, state = (str(tmp_path / n) for n in ("in", "memo", "state"))
    rng, seen = random.Random(2), set()
    for _ in range(9):
        rows = [(rng.choice(["a", "b", None, "c", "d"]), rng.randrange(6)) for _ in range(6)]
        seen |= set(rows)
        write(spark, source, rows, "id string, n long")
    rows = in_batches(spark, source, "id string, n long")
    query = streams.start_memo(rows, ["id", "n"], memo, state, fan=2, buckets=3)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    found = [tuple(r) for r in streams.read_memo(spark, memo, ["id", "n"]).collect()]
    assert len(found) == len(seen) and set(found) == seen
