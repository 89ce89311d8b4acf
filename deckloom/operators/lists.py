"""Free-text lists: lines, entries, request checks, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import text as T
from deckloom.operators import scale

#: A count before a name: digits, perhaps an x, white space, and something after it.
COUNT = r"^([0-9]+)\s*(?:[xX]\s+|\s)(?=.)"
#: From white space before the first filled pair of round brackets to the end: set, number, finish.
PRINTING = r"\s+\([^)]+\).*$"


def is_entry(line: Column) -> Column:
    """A trimmed line that is neither blank, a comment, nor a section header."""
    comment = F.startswith(line, F.lit("#")) | F.startswith(line, F.lit("//"))
    header = F.lower(F.rtrim(line, F.lit(":"))).isin(*C.SECTION_HEADERS)
    return (line != "") & ~comment & ~header


def explode_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per entry line of a whole text. `line_no` counts every line, kept or not."""
    tall = df.select(*keep, F.posexplode(T.lines(F.col(text))).alias("line_no", "raw"))
    return tall.select(*keep, F.col("line_no").cast("bigint"), T.strip(F.col("raw")).alias("line")).where(
        is_entry(F.col("line"))
    )


def parse_entries(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds `quantity` (1 when not given) and `name`; drops the line."""
    text = F.col(line)
    counted = F.substring(text, 1, 1).between("0", "9")
    head = F.when(counted, F.regexp_extract(text, COUNT, 0)).otherwise(F.lit(""))
    kept = [c for c in df.columns if c != line]
    cut = scale.once(df, _head=head).select(*kept, "_head", F.ltrim(F.substr(text, F.length("_head") + 1)).alias("_rest"))
    quantity = F.when(F.col("_head") == "", F.lit(1).cast("bigint")).otherwise(F.regexp_extract("_head", "[0-9]+", 0).try_cast("bigint"))
    name = F.when(F.col("_rest").contains("("), F.regexp_replace("_rest", PRINTING, "")).otherwise(F.col("_rest"))
    return cut.select(*kept, quantity.alias("quantity"), T.strip(name).alias("name"))


def entries(df: DataFrame, line: str) -> DataFrame:
    """Parse rows that already hold one raw line each."""
    trimmed = df.withColumn(line, T.strip(F.col(line))).where(is_entry(F.col(line)))
    return parse_entries(trimmed, line)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct keys with the place of their first line. Case matters. Merges before the shuffle."""
    place = F.min(F.struct(*order)).alias("_place")
    return df.groupBy(*keys).agg(place).select(*keys, *[F.col(f"_place.{c}").alias(c) for c in order])


def request_batches(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, size: int = C.LOOKUP_BATCH
) -> DataFrame:
    """Number distinct names of a list in order and cut them into lookup batches."""
    numbered = scale.number_in_group(df, keys, [F.col(c) for c in order], bucket)
    return numbered.withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("bigint"))


def fold_custom_style(style: Column, custom: Column) -> Column:
    """A custom style replaces the chosen one, cut to the free-text limit."""
    given = F.coalesce(custom, F.lit("")) != ""
    return F.when(given, T.strip(F.left(custom, F.lit(C.MAX_FREE_TEXT)))).otherwise(T.strip(F.nullif(style, F.lit(""))))


def request_violations(mode: Column, text: Column, free_text: dict[str, Column]) -> Column:
    """Reason codes of one request, in the order they are checked."""
    blank = T.strip(F.coalesce(text, F.lit(""))) == ""
    checks = [
        (~F.coalesce(F.nullif(mode, F.lit("")), F.lit("CREATIVE_FULL")).isin(*C.MODES), "mode"),
        (blank, "list_required"),
        (~blank & (F.length(text) > C.MAX_LIST_CHARS), "list_too_long"),
    ]
    checks += [(F.length(col) > C.MAX_FREE_TEXT, f"{name}_too_long") for name, col in free_text.items()]
    return F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks]),
        lambda code: code.isNotNull(),
    )


def over_cap(lines: DataFrame, list_id: str, cap: int = C.MAX_ENTRIES) -> DataFrame:
    """Lists with more entry lines than one job may take. Repeats count, as each line is an entry."""
    return lines.groupBy(list_id).agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > cap)
