"""Run records and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.sources import catalogue


def run_record(specs: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """The spec as it was run: its own text and every option resolved over the defaults."""
    return specs.select(*keep, spec, catalogue.resolved_options(F.col(spec)).alias("options"))


def face_record(results: DataFrame, keep: list[str]) -> DataFrame:
    """One JSON text per finished face; a failed face is a row like any other."""
    record = F.to_json(F.struct("name", "status", "seconds", "problems"), {"ignoreNullFields": "false"})
    return results.select(*keep, record.alias("record"))


def write_records(records: DataFrame, path: str, partition: str | None = None) -> None:
    """Append-free and repeatable: a rerun of a batch replaces that batch and nothing else."""
    writer = records.write.mode("overwrite")
    if partition is not None:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report_rows(cards: DataFrame, name: Column, metrics: list[str]) -> DataFrame:
    """One JSON text per card of a corpus report."""
    return cards.select(name.alias("name"), F.to_json(F.struct(*metrics)).alias("metrics"))


def write_report(summary: DataFrame, cards: DataFrame, path: str) -> None:
    """`summary` and `cards` side by side, as JSON lines."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    cards.write.mode("overwrite").json(f"{path}/cards")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`summary` and `cards` of a written report; a card's metrics are the text that was written."""
    return spark.read.json(f"{path}/summary"), spark.read.schema("name string, metrics string").json(f"{path}/cards")
