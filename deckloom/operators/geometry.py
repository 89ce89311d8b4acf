"""Boxes of one face against the rules of the layout. A face is one row; nothing is paired by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import arrays as A
from deckloom.functions import boxes as B
from deckloom.operators import briefs, scale
from deckloom.operators.proof import present, problem

NO_BOXES = f"array<{B.BOX}>"


def detected(raw: DataFrame, keep: list[str]) -> DataFrame:
    """A stored detection cleaned up: usable boxes, tab outranked by its enlarged corner, marks sifted.

    Input columns title, type, pt, pt_detail, name hold one raw box, rules, spare, marks hold lists.
    A mark that is the tab itself goes (judged against the first look's tab), and so does a mark
    at least half of which lies on the name.
    """
    none = F.array().cast(NO_BOXES)
    names = {"title": "title", "type": "type", "pt": "_pt", "pt_detail": "_detail", "name": "name"}
    kept = raw.select(*keep, *[F.col(k).alias(f"_raw_{k}") for k in [*names, "rules", "spare", "marks"]])
    first = scale.once(
        kept,
        **{new: B.parse(F.col(f"_raw_{k}")) for k, new in names.items()},
        **{k: F.coalesce(B.parse_all(F.col(f"_raw_{k}")), none) for k in ("rules", "spare", "marks")},
    )
    named_over = F.col("name").isNotNull()
    marks = F.filter(
        "_marks",
        lambda m: ~B.is_the_tab(m, F.col("_pt"))
        & (~named_over | (B.share_inside(m, F.col("name")) < C.NAME_MARK_OVERLAP)),
    )
    tab = F.when(F.col("_detail").isNotNull(), B.from_crop(F.col("_detail"))).otherwise(F.col("_pt"))
    sifted = scale.once(first.withColumnRenamed("marks", "_marks"), pt=tab, marks=marks)
    return sifted.select(*keep, "title", "type", "pt", "rules", "spare", "marks", "name")


def surfaces() -> Column:
    """Every surface that is printed into."""
    one = F.filter(F.array("title", "type", "pt"), lambda b: b.isNotNull())
    return F.concat(one, "rules")


def is_offending(mark: Column, printed: Column) -> Column:
    """Shaped like a line of writing, or touching a printed surface or its near edge."""
    touches = F.exists(printed, lambda s: B.share_inside(mark, B.grown(s)) > 0)
    return B.is_line_shaped(mark) | touches


def offending_marks(panels: DataFrame, keep: list[str]) -> DataFrame:
    """One row per mark with its verdict: `exists` over the row's own surfaces, no pairs are emitted."""
    judged = A.let(
        surfaces(),
        lambda printed: F.transform(
            "marks", lambda m: F.struct(m.alias("box"), is_offending(m, printed).alias("offending"))
        ),
    )
    return panels.select(*keep, F.posexplode(judged).alias("ord", "_m")).select(
        *keep, F.col("ord").cast("bigint"), "_m.box.*", "_m.offending"
    )


def audit(power: Column, paragraphs: Column, overflowed: Column) -> Column:
    """Layout problems of a detected face, worst first."""
    title, type_, tab = F.col("title"), F.col("type"), F.col("pt")
    strips = F.col("rules")
    top_rule = F.array_min(F.transform(strips, lambda s: s["y0"]))
    offenders = A.let(surfaces(), lambda printed: F.size(F.filter("marks", lambda m: is_offending(m, printed))))
    blank = (
        F.size("spare")
        + F.when(power.isNull() & tab.isNotNull(), 1).otherwise(0)
        + F.greatest(F.lit(0), F.size(strips) - F.greatest(F.lit(1), paragraphs))
    )

    def share(col: Column) -> Column:
        return F.format_number(col, 3)

    return present(
        [
            F.when(title.isNull(), problem("missing_title", F.lit("no title surface"))),
            F.when(type_.isNull(), problem("missing_type", F.lit("no type surface"))),
            F.when(F.size(strips) == 0, problem("missing_rules", F.lit("no rules surface"))),
            F.when(power.isNotNull() & tab.isNull(), problem("missing_pt", F.lit("a printed strength has no box"))),
            F.when(
                title["y0"] > C.TITLE_MAX_Y,
                problem("title_out_of_order", F.concat(F.lit("title plate at y="), share(title["y0"]))),
            ),
            F.when(type_["y0"] < title["y0"], problem("type_above_title", F.lit("type plate above the title"))),
            F.when(top_rule < type_["y0"], problem("rules_above_type", F.lit("rules strip above the type plate"))),
            F.when(
                B.width(title) < C.TITLE_MIN_WIDTH,
                problem("title_too_narrow", F.concat(F.lit("title plate width "), share(B.width(title)))),
            ),
            F.when(
                B.width(type_) < C.TYPE_MIN_WIDTH,
                problem("type_too_narrow", F.concat(F.lit("type plate width "), share(B.width(type_)))),
            ),
            F.when(overflowed, problem("text_too_small", F.lit("rules text does not fit at a readable size"))),
            F.when(
                blank > 0, problem("blank_surface", F.concat(F.lit("surfaces left blank: "), blank.cast("string")))
            ),
            F.when(
                offenders > 0, problem("painted_marks", F.concat(F.lit("painted marks: "), offenders.cast("string")))
            ),
        ]
    )


def cost_shortfall(tokens: Column) -> Column:
    """How far the name runs into the room the cost needs; null when it does not, or a box is missing."""
    title, name = F.col("title"), F.col("name")
    starts = title["x1"] - briefs.cost_width(tokens, B.height(title))
    ends = name["x1"] + C.COST_GAP
    return F.when(title.isNotNull() & name.isNotNull() & (tokens > 0) & ~(starts >= ends), ends - starts)


def collision(tokens: Column) -> Column:
    short = cost_shortfall(tokens)
    detail = F.concat(F.lit("the name must end further left by "), F.format_number(short, 3))
    return present([F.when(short.isNotNull(), problem("cost_no_room", detail))])


def ordered(panels: DataFrame, boxes: str, keep: list[str]) -> DataFrame:
    """Boxes top to bottom with their place."""
    return panels.select(*keep, F.posexplode(B.by_top(F.col(boxes))).alias("place", "_b")).select(
        *keep, F.col("place").cast("bigint"), "_b.*"
    )
