"""Proofreading on the documented examples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from deckloom.functions import text as T
from deckloom.operators import proof

FACE = "name string, mana_cost string, type_line string, oracle_text string, power string, toughness string, loyalty string"
BOLT = ("Lightning Bolt", "{R}", "Instant", "Deal 3 damage to any target.", None, None, None)
CLEAN = [("title_plate", "Lightning Bolt"), ("type_strip", "Instant"), ("rules_panel", "Deal 3 damage to any target.")]


def codes(spark, face, patches, title=True, **how):
    df = spark.createDataFrame([(*face, patches, title)], FACE + ", patches array<struct<where:string,text:string>>, has_title boolean")
    found = df.select(proof.proofread(F.col("patches"), F.col("has_title"), **how).alias("p")).first().p
    return [p.code for p in found]


def cost(spark, wanted, blind, *sighted):
    face = (BOLT[0], wanted, *BOLT[2:])
    patches = CLEAN + [("cost", s) for s in sighted]
    return codes(spark, face, patches, cost_lettered=True, cost_printed=F.lit(blind))


def test_equal_text_passes(spark):
    assert codes(spark, BOLT, CLEAN) == []
    upper = [(w, t.upper()) for w, t in CLEAN]
    assert codes(spark, BOLT, upper) == []


@pytest.mark.parametrize(
    "patches, expected",
    [
        ([*CLEAN[:1], ("type_strip", "Sorcery"), CLEAN[2]], ["text_wrong"]),
        (CLEAN[:2], ["text_missing"]),
        ([*CLEAN, (None, "TM 2024")], ["text_extra"]),
        ([*CLEAN, ("artwork", "runes")], []),
        ([*CLEAN, ("tab", "1/1")], ["text_extra"]),
        ([*CLEAN[:2], ("rules_panel", "Deal 3 damage"), ("rules_panel", "to any target.")], []),
    ],
)
def test_fields(spark, patches, expected):
    assert codes(spark, BOLT, patches) == expected


def test_missing_title_comes_first(spark):
    assert codes(spark, BOLT, CLEAN[1:], title=False) == ["missing_title", "text_missing"]


def test_star_toughness_and_only(spark):
    goyf = ("Goyf", "", "Creature", "", "*", "1+*", None)
    assert codes(spark, goyf, [("title_plate", "Goyf"), ("type_strip", "Creature"), ("tab", "*/1+*")]) == []
    assert codes(spark, BOLT, CLEAN[:1], only=["title_plate"]) == []
    assert codes(spark, BOLT, CLEAN, only=["title_plate"]) == ["text_extra"]


@pytest.mark.parametrize(
    "wanted, blind, sighted, expected",
    [
        ("{1}{1}", "{11}", ["{11}"], ["cost_wrong"]),
        ("{G/W}{U}", "{W/G}{U}", ["{G/W}{U}"], []),
        ("{2}{G}", "{G}{2}", ["{G}{2}"], ["cost_wrong"]),
        ("{G/W}", "{G}{W}", ["{G}{W}"], ["cost_wrong"]),
        ("{R}", "{?}", ["{R}"], ["cost_wrong"]),
        ("{R}", "{R}", ["{R}", "{R}"], ["cost_wrong"]),
        ("{R}", "{R}", ["{U}"], ["cost_wrong"]),
        ("{R}", "", [], ["text_missing"]),
        ("", "{R}", [], ["text_extra"]),
        ("{R}", "{R}", [], []),
    ],
)
def test_costs(spark, wanted, blind, sighted, expected):
    assert cost(spark, wanted, blind, *sighted) == expected


def test_a_missing_cost_reading_is_an_error(spark):
    with pytest.raises(ValueError):
        codes(spark, BOLT, CLEAN, cost_lettered=True)
    with pytest.raises(Exception, match="no reading of its cost"):
        codes(spark, BOLT, CLEAN, cost_lettered=True, cost_printed=F.lit(None).cast("string"))


def test_loose_patches_are_counted_in_full_and_four_are_shown(spark):
    patches = CLEAN + [("edge", "a"), (None, "b"), ("edge", "c"), (None, "d"), ("edge", "e")]
    df = spark.createDataFrame([(*BOLT, patches, True)], FACE + ", patches array<struct<where:string,text:string>>, has_title boolean")
    detail = df.select(proof.proofread(F.col("patches"), F.col("has_title")).alias("p")).first().p[0].detail
    assert detail == "5 loose: a; c; e; b"


def test_text_forms(spark):
    df = spark.createDataFrame([("“It’s”  {T}—x y", "{2}{g/w} {ZZ} it's \"so\"", "Straße ﬁ")], "a string, b string, c string")
    row = df.select(
        T.normalise(F.col("a")).alias("n"), T.symbol_tokens(F.col("b")).alias("t"), T.symbol_runs(F.col("b")).alias("r"),
        T.smart_quotes(F.col("b")).alias("q"), T.normalise_unicode(F.col("c")).alias("u"),
        T.is_keyword_line(F.lit("Flying, vigilance")).alias("k"), T.byte_sum(F.lit("Sol Ring")).alias("s"),
        T.pack_slug(F.lit("Hulk, Bruce  B")).alias("p"), T.job_slug(F.lit("-Hulk, Bruce  B!")).alias("j"),
    ).first()
    assert row.n == "\"it's\" t-x y"
    assert row.t == ["2", "G/W", "ZZ"]
    assert [(r.text, r.symbol) for r in row.r] == [("{2}", True), ("{g/w}", True), (" {ZZ} it's \"so\"", False)]
    assert row.q.endswith("it’s “so”")
    assert row.u == "strasse fi" and row.k and row.s == 734
    assert row.p == "hulk-bruce-b" and row.j == "hulk-bruce-b"


def test_rules_tokens(spark):
    df = spark.createDataFrame([(1, "Alliance — Gain {G}. (It's) x\nFlying) (a (b) c) d", "Smash!")], "id int, t string, f string")
    rows = proof.rules_tokens(df, ["id"], "t", "f").orderBy("paragraph_no", "word_no", "piece_no").collect()
    shown = [(r.text, r.italic, r.symbol, r.flavour) for r in rows]
    assert shown == [
        ("Alliance", True, False, False), ("—", False, False, False), ("Gain", False, False, False),
        ("{G}", False, True, False), (".", False, False, False), ("(It’s)", False, False, False), ("x", False, False, False),
        ("Flying)", False, False, False), ("(a", True, False, False), ("(b)", True, False, False), ("c)", True, False, False),
        ("d", False, False, False), ("Smash!", True, False, True),
    ]


def test_held_out_keys_are_whole(spark):
    ref = spark.createDataFrame([("Sol Ring!",), ("Sol",), ("Ring of Sol",)], "t string")
    ev = spark.createDataFrame([("sol-ring",)], "t string")
    assert [r.t for r in proof.held_out_leaks(ref, ev, "t").collect()] == ["Sol Ring!"]
    assert proof.held_out_clean(ref, ev, "t").count() == 2


def plain_tokens(text):
    """(paragraph, word, piece, text, symbol, italic) by walking over the words."""
    out = []
    for no, paragraph in enumerate(text.split("\n")):
        ability = re.match(r"([A-Z][A-Za-z'’ ]{2,24}) — ", paragraph)
        depth, cursor = 0, 0
        for k, word in enumerate(re.findall(r"\S+", paragraph)):
            cursor = paragraph.index(word, cursor)
            opens, closes = word.count("("), word.count(")")
            italic = bool(ability and cursor < ability.end(1)) or depth > 0 or opens > closes
            depth = max(0, depth + opens - closes)
            cursor += len(word)
            for j, piece in enumerate(p for p in re.split(r"(\{[^}]{1,6}\})", word) if p):
                symbol = bool(re.fullmatch(r"\{[^}]{1,6}\}", piece))
                out.append((no, k, j, piece, symbol, italic and not symbol))
    return out


def test_brackets_that_nest_close_early_and_hold_symbols(spark):
    rng = random.Random(8)
    texts = ["", "a (b c) d", ") a (b", "((a) b) c", "a ) ) ( b", "Landfall — x (y {T}: z{2}w) q", "(a\nb) c", "x" + " (y" * 300 + " z)" * 299 + " end"]
    texts += [" ".join(rng.choice(["a", "(b", "c)", "(d)", "((e", "{2}{R}", "f).", ")(", "g"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in proof.rules_tokens(df, ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.paragraph_no, r.word_no, r.piece_no, r.text, r.symbol, r.italic))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(plain_tokens(text)), text


def test_tokens_are_one_scan_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "a (b)")], "id int, text string")
    plan = proof.rules_tokens(df, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and "Window" not in plan and "Union" not in plan
