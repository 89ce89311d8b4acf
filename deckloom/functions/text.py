"""Text expressions: lines, tokens, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from deckloom import constants as C

# Every character at which a text is cut into lines; \r\n counts once.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ODD_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ODD_WHITE = WHITE.replace(r"\s", r"\t\n\f\r")  # all but the blank


def lines(text: Column) -> Column:
    """Most texts break at plain line feeds only, which need no pattern."""
    return F.when(text.rlike(ODD_BREAK), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))


SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def normalise(text: Column) -> Column:
    """Fold look-alike punctuation, drop braces, collapse white space, lower case."""
    given = F.coalesce(text, F.lit(""))
    folded = F.translate(given, C.FOLD_FROM + "{}", C.FOLD_TO)  # what has no counterpart goes
    # braces and folded blanks can bring two blanks together, so it is the folded text that is looked at
    wide = folded.contains("  ") | folded.rlike(ODD_WHITE)
    return F.lower(F.trim(F.when(wide, F.regexp_replace(folded, f"{WHITE}+", " ")).otherwise(folded)))


@F.pandas_udf(StringType())
def unicode_fold(text: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding, which Spark has no built-in for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalise_unicode(text: Column) -> Column:
    """`normalise` with full Unicode folding. One Arrow batch pass; opt in where it matters."""
    return normalise(unicode_fold(F.translate(text, C.FOLD_FROM, C.FOLD_TO)))


def shorten(text: Column, limit: int = 90) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def symbol_tokens(text: Column) -> Column:
    """Ordered canonical symbols. Halves of a split symbol are a sorted set; a split stays split."""

    def canonical(token: Column) -> Column:
        halves = F.sort_array(F.array_distinct(F.transform(F.split(token, "/"), lambda h: F.upper(F.trim(h)))))
        split = F.concat(F.array_join(halves, "/"), F.when(F.size(halves) == 1, F.lit("/")).otherwise(F.lit("")))
        return F.when(F.contains(token, F.lit("/")), split).otherwise(F.upper(F.trim(token)))

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.SYMBOL_PATTERN), F.lit(1))
    return F.transform(found, canonical)


def symbol_file(token: Column) -> Column:
    """File stem of a bare token: aliases first, else the token without slashes in upper case."""
    stem = F.upper(F.replace(token, F.lit("/"), F.lit("")))
    out = stem
    for name, alias in C.SYMBOL_FILE_ALIASES.items():
        out = F.when(token == name, F.lit(alias)).otherwise(out)
    return out


def known_symbol_pattern() -> str:
    """One pattern for every spelling that names a symbol file (slashes are free, case is not kept)."""
    tokens = [token for token, _, _ in C.SYMBOLS]
    bodies = {t.strip("{}").replace("/", "") for t in tokens} | set(C.SYMBOL_FILE_ALIASES.values())
    spelled = sorted((b for b in bodies if len(b) <= 6), key=lambda b: (-len(b), b))
    return "(?i)\\{/*(?:" + "|".join("/*".join(b) for b in spelled) + ")/*\\}"


def runs(text: Column, pattern: str) -> Column:
    """Cut a text at a pattern, keeping both: ARRAY<STRUCT<text, symbol>> in order, no empty runs."""
    between = F.split(text, pattern)
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        between,
        marks,
        lambda t, m: F.array(
            F.struct(t.alias("text"), F.lit(False).alias("symbol")),
            F.struct(m.alias("text"), F.lit(True).alias("symbol")),
        ),
    )
    return F.filter(F.flatten(pairs), lambda r: F.coalesce(r["text"], F.lit("")) != "")


def symbol_runs(text: Column) -> Column:
    """Text and symbol runs; a token with no symbol file stays text and joins its neighbours."""
    return runs(text, known_symbol_pattern())


def words(text: Column) -> Column:
    """What stands between white space. Most texts have plain spaces only, which need no pattern."""
    cut = F.when(text.rlike(ODD_WHITE), F.split(text, f"{WHITE}+")).otherwise(F.split(text, " "))
    return F.filter(cut, lambda w: w != "")


def is_keyword_line(paragraph: Column) -> Column:
    return (F.length(paragraph) < C.KEYWORD_LINE_BELOW) & strip(paragraph).rlike(C.KEYWORD_LINE)


def ability_word(paragraph: Column) -> Column:
    """The opening ability word, or the empty string."""
    return F.regexp_extract(paragraph, C.ABILITY_WORD, 1)


def smart_quotes(text: Column) -> Column:
    """Straight quotes to typographic ones, closing after a letter, digit or (double) stop."""
    closing = F.regexp_replace(text, r"([\p{L}\p{N}])'", "$1’")
    single = F.when(text.contains("'"), F.replace(closing, F.lit("'"), F.lit("‘"))).otherwise(text)
    double = F.regexp_replace(single, r'([\p{L}\p{N}.,!?])"', "$1”")
    return F.when(text.contains('"'), F.replace(double, F.lit('"'), F.lit("“"))).otherwise(single)


def key_letters(text: Column) -> Column:
    """Lower-case letters and digits only; the whole of it is compared, never a part."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def job_slug(name: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def pack_slug(name: Column) -> Column:
    """Each sign becomes a dash, ends are trimmed, then pairs of dashes are halved once."""
    dashed = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "-")
    return F.replace(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("--"), F.lit("-"))


def file_stem(name: Column, position: Column, slug=job_slug) -> Column:
    suffix = F.when(position == "SINGLE", F.lit("")).otherwise(F.concat(F.lit("-"), F.lower(position)))
    return F.concat(slug(name), suffix)


def byte_sum(text: Column) -> Column:
    """Sum of the UTF-8 bytes of a short text, such as a name."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, b: acc + F.conv(b, 16, 10).cast("bigint"))
    return total
