"""Printed text against catalogue text, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import arrays as A
from deckloom.functions import text as T
from deckloom.operators import scale

PATCHES = "array<struct<where:string,text:string>>"


def problem(code: str, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), detail.alias("detail"))


def present(problems: list[Column]) -> Column:
    """The problems that hold, in rule order."""
    return F.filter(F.array(*problems), lambda p: p.isNotNull())


def is_blank(text: Column) -> Column:
    return T.strip(F.coalesce(text, F.lit(""))) == ""


def tab_text(power: Column, toughness: Column, loyalty: Column) -> Column:
    return (
        F.when(power.isNotNull(), F.concat(power, F.lit("/"), F.coalesce(toughness, F.lit("None"))))
        .when(loyalty.isNotNull(), loyalty)
        .otherwise(F.lit(""))
    )


def expected_fields(cost_lettered: bool = False) -> list[tuple[str, Column]]:
    """(surface, what it must say) in the order reported. Needs the face columns."""
    fields = [
        ("title_plate", F.coalesce("name", F.lit(""))),
        ("type_strip", F.coalesce("type_line", F.lit(""))),
        ("rules_panel", F.coalesce("oracle_text", F.lit(""))),
        ("tab", tab_text(F.col("power"), F.col("toughness"), F.col("loyalty"))),
    ]
    if cost_lettered:
        fields.insert(1, ("cost", F.coalesce("mana_cost", F.lit(""))))
    return fields


def expected_tall(faces: DataFrame, face_id: str, cost_lettered: bool = False) -> DataFrame:
    fields = expected_fields(cost_lettered)
    rows = F.array(*[F.struct(F.lit(s).alias("surface"), t.alias("expected")) for s, t in fields])
    return faces.select(face_id, F.inline(rows))


def clean_patches(patches: Column) -> Column:
    """Blank patches dropped; a patch with no surface counts as `other`."""
    kept = F.filter(F.coalesce(patches, F.array().cast(PATCHES)), lambda p: ~is_blank(p["text"]))
    return F.transform(
        kept, lambda p: F.struct(F.coalesce(p["where"], F.lit("other")).alias("where"), p["text"].alias("text"))
    )


def patch_rows(read: DataFrame, face_id: str) -> DataFrame:
    """face, ord, surface, text: one row per cleaned patch."""
    tall = read.select(face_id, F.posexplode(clean_patches(F.col("patches"))).alias("ord", "patch"))
    return tall.select(face_id, F.col("ord").cast("bigint"), F.col("patch.where").alias("surface"), "patch.text")


def printed_surfaces(patches: DataFrame, face_id: str) -> DataFrame:
    """Per face and surface: its patches in order, joined by blanks, and how many there are."""
    return patches.groupBy(face_id, "surface").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY ord)").alias("printed"),
        F.count(F.lit(1)).alias("patches"),
    )


def expected_and_read(expected: DataFrame, printed: DataFrame, face_id: str) -> DataFrame:
    """One row per face and surface that either side has."""
    return expected.join(printed, [face_id, "surface"], "full_outer")


def texts_on(patches: Column, surface: str) -> Column:
    return F.transform(F.filter(patches, lambda p: p["where"] == surface), lambda p: p["text"])


def cost_disagreement(blind: Column, sighted: Column) -> Column:
    """Two readings of the cost, both there and readable, that name different symbols."""
    readable = ~F.contains(blind, F.lit(C.UNREADABLE)) & ~F.contains(sighted, F.lit(C.UNREADABLE))
    differ = ~T.symbol_tokens(blind).eqNullSafe(T.symbol_tokens(sighted))
    return readable & ~is_blank(blind) & ~is_blank(sighted) & differ


def proofread(
    patches: Column,
    has_title: Column,
    only: list[str] | None = None,
    cost_lettered: bool = False,
    cost_printed: Column | None = None,
) -> Column:
    """Problems of a lettered face, worst first. Needs the face columns in the same row.

    The cost is graded from its own reading, never from the whole-card transcription; leaving that
    reading out is an error, in the call and in a row.
    """
    if cost_lettered and cost_printed is None:
        raise ValueError("grading the cost needs its own reading: pass cost_printed")
    return A.let(
        clean_patches(patches), lambda cleaned: _graded(cleaned, has_title, only, cost_lettered, cost_printed)
    )


def _graded(cleaned: Column, has_title: Column, only, cost_lettered: bool, cost_printed: Column | None) -> Column:
    checks = [F.when(~has_title, problem("missing_title", F.lit("no plate across the top of the card")))]
    graded = []
    for surface, wanted in expected_fields(cost_lettered):
        if only is not None and surface not in only:
            continue
        graded.append(surface)
        on_card = F.array_join(texts_on(cleaned, surface), " ")
        if surface == "cost":
            reading = F.coalesce(
                cost_printed, F.raise_error(F.lit("a face has no reading of its cost")).cast("string")
            )
            checks.append(_cost_check(wanted, reading, on_card, F.size(texts_on(cleaned, "cost"))))
        else:
            checks.append(_text_check(surface, wanted, on_card))
    checks.append(_loose_check(cleaned, graded))
    return present(checks)


def _told(surface: str, printed: Column, wanted: Column) -> Column:
    return F.concat(F.lit(f"{surface} reads "), T.shorten(printed), F.lit(", must read "), T.shorten(wanted))


def _text_check(surface: str, wanted: Column, printed: Column) -> Column:
    return (
        F.when((wanted == "") & ~is_blank(printed), problem("text_extra", F.concat(F.lit(f"{surface} should be bare: "), T.shorten(printed))))
        .when(wanted == "", None)
        .when(is_blank(printed), problem("text_missing", F.concat(F.lit(f"{surface} must read "), T.shorten(wanted))))
        .when(T.normalise(printed) != T.normalise(wanted), problem("text_wrong", _told(surface, printed, wanted)))
    )


def _cost_check(wanted: Column, printed: Column, sighted: Column, times: Column) -> Column:
    has = wanted != ""
    return (
        F.when(has & (times > 1), problem("cost_wrong", F.concat(F.lit("painted in places: "), times.cast("string"))))
        .when(
            has & cost_disagreement(printed, sighted),
            problem("cost_wrong", F.concat(F.lit("reads two ways: "), T.shorten(printed), F.lit(" and "), T.shorten(sighted))),
        )
        .when(~has & ~is_blank(printed), problem("text_extra", F.concat(F.lit("cost should be bare: "), T.shorten(printed))))
        .when(~has, None)
        .when(is_blank(printed), problem("text_missing", F.concat(F.lit("cost must read "), T.shorten(wanted))))
        .when(
            F.contains(printed, F.lit(C.UNREADABLE))
            | ~T.symbol_tokens(printed).eqNullSafe(T.symbol_tokens(wanted)),
            problem("cost_wrong", _told("cost", printed, wanted)),
        )
    )


def _loose_check(cleaned: Column, graded: list[str]) -> Column:
    """Writing on any other surface but the artwork, by surface as first met; four are shown, all are counted."""


    def by_surface(loose: Column) -> Column:
        """Loose patches sorted by the first place of their surface among them, then by their own."""
        surfaces = F.array_distinct(F.transform(loose, lambda p: p["where"]))
        placed = A.let(
            surfaces,
            lambda names: F.transform(
                loose,
                lambda p, i: F.struct(
                    F.array_position(names, p["where"]).alias("surface_no"), i.alias("ord"), p["text"].alias("text")
                ),
            ),
        )
        return F.sort_array(placed)

    def told(loose: Column) -> Column:
        shown = F.transform(F.slice(by_surface(loose), 1, C.LOOSE_SHOWN), lambda p: T.shorten(p["text"], 40))
        detail = F.concat(F.size(loose).cast("string"), F.lit(" loose: "), F.array_join(shown, "; "))
        return F.when(F.size(loose) > 0, problem("text_extra", detail))

    return A.let(F.filter(cleaned, lambda p: ~p["where"].isin(*graded, "artwork")), told)


def _turn(word: Column) -> Column:
    """Round brackets a word opens less those it closes."""
    return F.length(F.replace(word, F.lit(")"), F.lit(""))) - F.length(F.replace(word, F.lit("("), F.lit("")))


def bracket_signs(words: Column) -> Column:
    """A string with one sign per word: 1 inside round brackets or where more open than close, else 0.

    The depth never falls below none. Only words with a bracket can change it, so only these are walked, and the
    sign of the words between two of them is repeated.
    """
    marks = F.filter(
        F.transform(words, lambda w, i: F.when(w.contains("(") | w.contains(")"), F.struct(i.alias("at"), _turn(w).alias("turn")))),
        lambda m: m.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("next"), F.lit("").alias("signs"))

    def sign(inside: Column) -> Column:
        return F.when(inside, F.lit("1")).otherwise(F.lit("0"))

    def step(acc: Column, mark: Column) -> Column:
        between = F.repeat(sign(acc["depth"] > 0), mark["at"] - acc["next"])
        here = sign((acc["depth"] > 0) | (mark["turn"] > 0))
        return F.struct(
            F.greatest(F.lit(0), acc["depth"] + mark["turn"]).alias("depth"), (mark["at"] + 1).alias("next"),
            F.concat(acc["signs"], between, here).alias("signs"),
        )

    return F.aggregate(marks, start, step, lambda acc: F.concat(acc["signs"], F.repeat(sign(acc["depth"] > 0), F.size(words) - acc["next"])))


def rules_tokens(texts: DataFrame, keys: list[str], rules: str, flavour: str | None = None) -> DataFrame:
    """One row per word or symbol of rules text, flavour paragraphs after it. All within the text's own row: nothing is shuffled."""
    paragraphs = F.split(T.smart_quotes(F.coalesce(F.col(rules), F.lit(""))), "\n")
    listed = F.transform(paragraphs, lambda p: F.struct(p.alias("paragraph"), F.lit(False).alias("flavour")))
    if flavour is not None:
        extra = F.filter(F.split(T.smart_quotes(F.coalesce(F.col(flavour), F.lit(""))), "\n"), lambda p: ~is_blank(p))
        listed = F.concat(listed, F.transform(extra, lambda p: F.struct(p.alias("paragraph"), F.lit(True).alias("flavour"))))
    rows = texts.select(*keys, F.posexplode(listed).alias("paragraph_no", "_p")).select(
        *keys, F.col("paragraph_no").cast("bigint"), "_p.paragraph", "_p.flavour"
    )
    opening = F.filter(F.split(T.ability_word(F.col("paragraph")), f"{T.WHITE}+"), lambda w: w != "")
    rows = scale.once(
        rows,
        keyword=T.is_keyword_line(F.col("paragraph")) & ~F.col("flavour"),
        _opening=F.when(F.col("paragraph").contains(" — "), F.size(opening)).otherwise(F.lit(0)),
        _words=T.words(F.col("paragraph")),
    )
    bracketed = F.col("paragraph").contains("(") | F.col("paragraph").contains(")")
    rows = scale.once(rows, _signs=F.when(bracketed, bracket_signs(F.col("_words")))).drop("paragraph")
    def pieces(word: Column, at: Column) -> Column:
        """The pieces of one word in order; a word without a brace is one."""
        sign = F.substr(F.col("_signs"), at + 1, F.lit(1)) == "1"
        italic = (at < F.col("_opening")) | F.coalesce(sign, F.lit(False))

        def piece(k: Column, text: Column, symbol: Column) -> Column:
            return F.struct(at.cast("bigint").alias("word_no"), k.cast("bigint").alias("piece_no"), text.alias("text"), symbol.alias("symbol"), italic.alias("_italic"))

        cut = F.transform(T.runs(word, C.SYMBOL_PATTERN), lambda r, k: piece(k, r["text"], r["symbol"]))
        return F.when(word.contains("{"), cut).otherwise(F.array(piece(F.lit(0), word, F.lit(False))))

    listed = F.flatten(F.transform("_words", pieces))
    out = rows.select(*keys, "paragraph_no", "flavour", "keyword", F.inline(listed))
    word = ~F.col("symbol")
    return out.select(
        *keys, "paragraph_no", "word_no", "piece_no", "text", "symbol",
        (word & (F.col("_italic") | F.col("flavour"))).alias("italic"),
        (word & F.col("keyword")).alias("keyword"), (word & F.col("flavour")).alias("flavour"),
    )


def held_out_leaks(reference: DataFrame, evaluation: DataFrame, text: str) -> DataFrame:
    """Reference rows whose whole key is also an evaluation key. Keys are letters and digits only."""
    keyed = reference.withColumn("key", T.key_letters(F.col(text))).where(F.col("key") != "")
    known = evaluation.select(T.key_letters(F.col(text)).alias("key")).where(F.col("key") != "").distinct()
    return keyed.join(known, "key", "left_semi")


def held_out_flags(reference: DataFrame, evaluation: DataFrame, text: str) -> DataFrame:
    """Reference rows with `leak`, 1 where the key is an evaluation key. Blank keys match nothing and are dealt out evenly."""
    key = T.key_letters(F.col(text))
    known = evaluation.select(key.alias("key")).where(F.col("key") != "").distinct().withColumn("leak", F.lit(1))
    blank = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*reference.columns), F.lit(4096)).cast("string"))
    keyed = reference.withColumn("key", key)
    keyed = keyed.withColumn("key", F.when(F.coalesce(F.col("key"), F.lit("")) == "", blank).otherwise(F.col("key")))
    return keyed.join(known, "key", "left").withColumn("leak", F.coalesce("leak", F.lit(0))).drop("key")


def held_out_clean(reference: DataFrame, evaluation: DataFrame, text: str) -> DataFrame:
    keyed = reference.withColumn("key", T.key_letters(F.col(text)))
    known = evaluation.select(T.key_letters(F.col(text)).alias("key")).where(F.col("key") != "").distinct()
    return keyed.join(known, "key", "left_anti")
