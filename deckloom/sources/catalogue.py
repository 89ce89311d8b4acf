"""Catalogue documents, symbol metadata, batch specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import text as T


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """One list per file, whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("list_id"), F.col("value").alias("text")
    )


def typed_cards(documents: DataFrame, document: str, keep: list[str] = ()) -> DataFrame:
    """Card documents (JSON text) kept whole as VARIANT beside id, name and layout."""
    parsed = documents.select(*keep, F.parse_json(document).alias("data"))
    return parsed.select(
        *keep,
        F.variant_get("data", "$.id", "string").alias("card_id"),
        F.variant_get("data", "$.name", "string").alias("name"),
        F.variant_get("data", "$.layout", "string").alias("layout"),
        "data",
    )


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """One card document per line."""
    return typed_cards(spark.read.text(path), "value")


SYMBOL = "map<string,struct<file:string,english:string,represents_mana:boolean,appears_in_mana_costs:boolean>>"


def symbol_rows(documents: DataFrame, document: str) -> DataFrame:
    """Symbol metadata documents (a JSON map each) to one row per token."""
    listed = documents.select(F.explode(F.from_json(document, SYMBOL)).alias("token", "about"))
    return listed.select("token", "about.*")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return symbol_rows(spark.read.text(path, wholetext=True), "value")


def symbol_dimension(spark: SparkSession) -> DataFrame:
    """The fixed symbols: token, file stem, two flags."""
    made = spark.createDataFrame(C.SYMBOLS, "token string, represents_mana boolean, appears_in_mana_costs boolean")
    return made.withColumn("file", T.symbol_file(F.expr("substring(token, 2, length(token) - 2)")))


def spec_problems(spec: Column, known: list[str] | Column | None = None) -> Column:
    """Why a batch spec (JSON text) cannot run, in the order checked; empty when it can."""
    keys = F.json_object_keys(spec)
    allowed = F.array(*[F.lit(k) for k in C.SPEC_OPTION_KEYS + C.SPEC_OTHER_KEYS]) if known is None else known
    if isinstance(allowed, list):
        allowed = F.array(*[F.lit(k) for k in allowed])
    unknown = F.sort_array(F.array_except(keys, allowed))
    cards = F.from_json(F.get_json_object(spec, "$.cards"), "array<string>")
    why = F.coalesce(F.get_json_object(spec, "$.why"), F.lit(""))
    return F.filter(
        F.array(
            F.when(keys.isNull(), F.lit("not_an_object")),
            F.when(F.coalesce(F.size(cards), F.lit(0)) < 1, F.lit("no_cards")),
            F.when(why == "", F.lit("no_why")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ","))),
        ),
        lambda p: p.isNotNull(),
    )


def read_specs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Batch specs with their problems; in strict mode a bad one stops the job."""
    specs = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("spec"), spec_problems(F.col("value")).alias("problems")
    )
    if strict:
        bad = F.concat_ws(": ", "path", F.array_join("problems", "; "))
        specs = specs.withColumn(
            "spec", F.when(F.size("problems") > 0, F.raise_error(bad).cast("string")).otherwise(F.col("spec"))
        )
    return specs


def resolved_options(spec: Column) -> Column:
    """The spec's options over the defaults, as one struct of texts."""

    def option(key: str) -> Column:
        default = C.OPTION_DEFAULTS.get(key)
        shown = None if default is None else str(default).lower() if isinstance(default, bool) else str(default)
        return F.coalesce(F.get_json_object(spec, f"$.{key}"), F.lit(shown)).alias(key)

    return F.struct(*[option(key) for key in C.SPEC_OPTION_KEYS])
