"""List text, names and faces: the documented shapes and their answers."""

import random

from pyspark.sql import functions as F

from deckloom.operators import catalogue, lists
from deckloom.sources import catalogue as sources

LIST = """Deck
4 Lightning Bolt
4x Brainstorm
1 Craterhoof Behemoth (MH1) 149
2 Bonecrusher Giant (ELD) 115 *F*
Sol Ring

// a note
# another
Sideboard:
1 Fire // Ice"""

CARDS = [
    '{"id":"b","name":"Day // Night","layout":"transform","flavor_text":"card","color_identity":["G"],'
    '"image_uris":{"art_crop":"card-art"},"type_line":"Creature // Land","card_faces":['
    '{"name":"Day","mana_cost":"{R}","power":"1","toughness":null,"image_uris":{},"colors":["R"]},'
    '{"name":"Night","flavor_text":null,"colors":[],"image_uris":{"art_crop":"back-art"}},{"name":"Third"}]}',
    '{"id":"a","name":"Fire // Ice","layout":"split","mana_cost":"{1}","type_line":"Instant // Instant",'
    '"card_faces":[{"name":"Fire"},{"name":"Ice"}],"color_identity":["R","U"],"promo_types":["universesbeyond"]}',
    '{"id":"c","name":"Fire","layout":"normal","type_line":"Instant"}',
    '{"id":"d","name":"Siege of X","layout":"transform","type_line":"Battle — Siege","card_faces":[{"name":"Siege of X"},{"name":"Y"}]}',
    '{"id":"e","name":"Big Plane","layout":"planar","type_line":"Plane"}',
]


def cards(spark):
    return sources.typed_cards(spark.createDataFrame([(c,) for c in CARDS], "doc string"), "doc")


def entries(spark, text):
    texts = spark.createDataFrame([(1, text)], "list_id int, text string")
    return lists.parse_entries(lists.explode_lines(texts, "text", ["list_id"]))


def test_list_lines(spark):
    rows = [(r.quantity, r.name) for r in entries(spark, LIST).orderBy("line_no").collect()]
    assert rows == [
        (4, "Lightning Bolt"), (4, "Brainstorm"), (1, "Craterhoof Behemoth"), (2, "Bonecrusher Giant"),
        (1, "Sol Ring"), (1, "Fire // Ice"),
    ]


def test_a_quantity_beyond_64_bits_is_reported(spark):
    planned = catalogue.plan_lines(entries(spark, "99999999999999999999 Fire\n2 Fire\n99999999999999999999 Nothing"), cards(spark))
    got = [(r.disposition, r.reason) for r in planned.orderBy("line_no").collect()]
    assert got == [("unsupported", "quantity_too_large"), ("entry", None), ("unresolved", None)]
    row = catalogue.credits(planned, "list_id").head()
    assert (row.lines, row.entries, row.unsupported, row.unresolved, row.credits) == (3, 1, 1, 1, 2)


def test_every_line_break_counts(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i"
    assert [r.name for r in entries(spark, text).orderBy("line_no").collect()] == list("abcdefghi")


def test_front_name(spark):
    df = spark.createDataFrame([("Fire // Ice",), ("Craterhoof Behemoth",)], "n string")
    assert [r[0] for r in df.select(catalogue.front_name(F.col("n"))).collect()] == ["Fire", "Craterhoof Behemoth"]


def test_absent_and_null_differ(spark):
    rows = {(r.card_id, r.face_position): r for r in catalogue.faces(cards(spark)).collect()}
    front, back, split = rows["b", "FRONT"], rows["b", "BACK"], rows["a", "SINGLE"]
    assert ("b", "SINGLE") not in rows and len([k for k in rows if k[0] == "b"]) == 2
    assert front.flavor_text == "card" and back.flavor_text is None  # absent falls back, null does not
    assert front.toughness is None and front.type_line == "Creature // Land"
    assert front.art_crop == "card-art" and back.art_crop == "back-art"  # an empty object falls through
    assert back.colors == [] and back.color_identity == ["G"]  # identity is the card's
    assert split.is_crossover and [p.name for p in split.parts] == ["Fire", "Ice"] and not split.is_dfc


def test_names_resolve_to_the_smallest_id(spark):
    lines = spark.createDataFrame([("fire",), ("FIRE // ICE",), ("Day",), ("Night",), ("Day // Nig",)], "name string")
    found = {r.name: r.card_id for r in catalogue.resolve(lines, cards(spark)).collect()}
    assert found == {"fire": "a", "FIRE // ICE": "a", "Day": "b", "Night": None, "Day // Nig": None}


def test_plan(spark):
    text = "2 Day\n1 fire\n1 Nobody\n1 Nobody\n1 Siege of X\n3 Big Plane"
    planned = catalogue.plan_lines(entries(spark, text), cards(spark))
    got = [(r.name, r.disposition, r.reason) for r in planned.orderBy("line_no").collect()]
    assert got == [
        ("Day", "entry", None), ("fire", "entry", None), ("Nobody", "unresolved", None), ("Nobody", "unresolved", None),
        ("Siege of X", "unsupported", "battle"), ("Big Plane", "unsupported", "planar"),
    ]
    once = catalogue.unresolved(entries(spark, text), cards(spark), "list_id", ["line_no"]).collect()
    assert [(r.name, r.line_no) for r in once] == [("Nobody", 2)]
    total = catalogue.credits(planned, "list_id").first()
    assert (total.lines, total.entries, total.unsupported, total.unresolved, total.faces, total.credits) == (6, 2, 2, 2, 3, 5)


def test_art_comes_from_the_oldest_ordinary_printing(spark):
    rows = [
        ("n1", "Bolt", "SINGLE", True, "skin", "skin text", 2026), ("n2", "Bolt", "SINGLE", False, "alpha", "old", 1993),
        ("n3", "Bolt", "SINGLE", False, "beta", "older?", 1994), ("n4", "Hero", "SINGLE", True, "hero", "smash", 2026),
    ]
    faces = spark.createDataFrame(
        rows, "card_id string, display_name string, face_position string, is_crossover boolean, art_crop string, flavor_text string, released int"
    )
    got = {r.card_id: (r.reference_art, r.reference_flavor, r.licensed) for r in catalogue.art_reference(faces).collect()}
    assert got == {
        "n1": ("alpha", "old", False), "n2": ("alpha", "old", False), "n3": ("beta", "older?", False), "n4": (None, "", True),
    }


def test_spec_problems(spark):
    specs = [
        '{"why":"w","cards":["a"],"art_style":"x"}', '{"why":"w","cards":["a"],"art_stile":"x"}', '{"cards":["a"]}',
        '{"why":"w","cards":[]}',
    ]
    df = spark.createDataFrame(list(enumerate(specs)), "i int, s string")
    got = [list(r[0]) for r in df.orderBy("i").select(sources.spec_problems(F.col("s"))).collect()]
    assert got == [[], ["unknown:art_stile"], ["no_why"], ["no_cards"]]


def test_lists_and_cards_from_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "one.txt").write_text(LIST)
    (tmp_path / "cards.json").write_text("\n".join(CARDS))
    (tmp_path / "spec.json").write_text('{"cards":["a"]}')
    assert sources.read_lists(spark, str(tmp_path / "l")).count() == 1
    assert sources.read_cards(spark, str(tmp_path / "cards.json")).count() == len(CARDS)
    assert list(sources.read_specs(spark, str(tmp_path / "spec.json")).first().problems) == ["no_why"]


def test_requests(spark):
    rows = [("X", " ", None, None), (None, "1 Bolt", "n" * 501, None), ("ART_ONLY", "b" * 20001, None, " my style "), ("", "1 Bolt", "n" * 500, "s" * 600)]
    df = spark.createDataFrame(rows, "mode string, text string, notes string, custom string")
    reasons = lists.request_violations(F.col("mode"), F.col("text"), {"notes": F.col("notes")})
    style = lists.fold_custom_style(F.lit("ink"), F.col("custom"))
    got = [(list(r.p), r.s) for r in df.select(reasons.alias("p"), style.alias("s")).collect()]
    assert got == [(["mode", "list_required"], "ink"), (["notes_too_long"], "ink"), (["list_too_long"], "my style"), ([], "s" * 500)]
    lines = spark.createDataFrame([(1,)] * 61 + [(2,)] * 60, "list_id int")
    assert [r.list_id for r in lists.over_cap(lines, "list_id").collect()] == [1]


def test_lookup_needs_no_size_setting(spark):
    from deckloom.operators import catalogue

    lines = spark.createDataFrame([(1, "Sol Ring"), (2, "Fire"), (3, "None such"), (4, None)], "line_no int, name string")
    cards = spark.createDataFrame([("a", "Sol Ring"), ("b", "Fire // Ice"), ("c", "Sol Ring")], "card_id string, name string")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "1", had):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = {r["line_no"]: r["card_id"] for r in catalogue.resolve(lines, cards).collect()}
            assert got == {1: "a", 2: "b", 3: None, 4: None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def plain_entry(line):
    """Quantity and name of one trimmed line, sign by sign."""
    digits = len(line) - len(line.lstrip("0123456789"))
    white = " \t\x0b\x0c"
    quantity, rest = 1, line
    if digits:
        after = line[digits:].lstrip(white)
        gap = len(line) - digits - len(after)
        if after[:1] in ("x", "X") and after[1:2] and after[1] in white and after[1:].strip(white):
            quantity, rest = int(line[:digits]), after[1:].lstrip(white)
        elif gap and after:
            quantity, rest = int(line[:digits]), after
    for at in range(1, len(rest)):
        if rest[at] in white and rest[at - 1] not in white:
            bracket = rest[at:].lstrip(white)
            if bracket[:1] == "(" and bracket.find(")") > 1:
                return quantity, rest[:at].strip()
    return quantity, rest.strip()


def test_entries_sign_by_sign(spark):
    rng = random.Random(12)
    parts = ["3", "12", "x", "X", " ", "  ", "\t", "Bolt", "xenon", "(", ")", "()", "(M10)", " (A) 12 *F*", "//", "é", "99999999999999999999"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))).strip() for _ in range(3000)]
    lines = [x for x in dict.fromkeys(lines) if x]
    got = {r.line: (r.quantity, r.name) for r in lists.parse_entries(spark.createDataFrame([(x, x) for x in lines], "raw string, line string").withColumnRenamed("raw", "kept"), "line").withColumnRenamed("kept", "line").collect()}
    for line in lines:
        quantity, name = plain_entry(line)
        assert got[line] == (quantity if quantity < 2**63 else None, name), line
