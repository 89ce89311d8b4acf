"""Catalogue queries: faces, rejection, printings, symbols, options, briefs, file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import text as T
from deckloom.operators import briefs, catalogue
from deckloom.plans import views as V
from deckloom.plans.registry import query
from deckloom.sources import catalogue as sources


def faces(spark, sf):
    return catalogue.faces(V.cards(spark, sf), keep=["released"])


def joined(column: str):
    return F.array_join(column, ",").alias(column)


@query(
    "s2_catalogue_documents",
    """SELECT card_id, name, layout, CASE WHEN two THEN tl || ' // Land' ELSE tl END AS type_line,
  CASE k % 4 WHEN 1 THEN 'absent' WHEN 2 THEN 'null' ELSE 'listed' END AS promo_state FROM v_card""",
    ("v_card",),
)
def catalogue_documents(spark, sf):
    promo = F.variant_get("data", "$.promo_types", "variant")
    state = F.when(promo.isNull(), "absent").when(F.is_variant_null(promo), "null").otherwise("listed")
    return V.cards(spark, sf).select(
        "card_id", "name", "layout", F.variant_get("data", "$.type_line", "string").alias("type_line"),
        state.alias("promo_state"),
    )


@query(
    "s3_symbol_documents",
    """
SELECT token, file, count(*) AS documents, bool_and(cost) AS appears_in_mana_costs FROM (
  SELECT '{' || p_size || '}' AS token, p_size || '.svg' AS file, p_size < 17 AS cost FROM part
  UNION ALL SELECT '{T}', 'T.svg', false FROM part)
GROUP BY token, file
""",
)
def symbol_documents(spark, sf):
    document = F.expr(
        """concat('{"{', p_size, '}":{"file":"', p_size, '.svg","english":"', p_name, '","represents_mana":true,',
           '"appears_in_mana_costs":', p_size < 17, '},"{T}":{"file":"T.svg","english":"tap this permanent",',
           '"represents_mana":false,"appears_in_mana_costs":false}}')"""
    )
    rows = sources.symbol_rows(V.table(spark, sf, "part").select(document.alias("document")), "document")
    return rows.groupBy("token", "file").agg(
        F.count(F.lit(1)).alias("documents"), F.bool_and("appears_in_mana_costs").alias("appears_in_mana_costs")
    )


SPEC_SQL = """SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props
  WHEN 1 THEN replace(props, '{', '{"why":"w","cards":["a"],') WHEN 2 THEN replace(props, '{"k"', '{"why":"w","cards":["a"],"bead"')
  ELSE replace(props, '{"k"', '{"cards":[],"lettered":true,"why"') END AS spec FROM {events}"""


def specs(spark, sf):
    return V.table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '{', '{"why":"w","cards":["a"],')
           WHEN 2 THEN replace(props, '{"k"', '{"why":"w","cards":["a"],"bead"')
           ELSE replace(props, '{"k"', '{"cards":[],"lettered":true,"why"') END AS spec""",
    )


@query(
    "s5_spec_audit",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no_cards;no_why;unknown:k' WHEN 1 THEN 'unknown:k' WHEN 2 THEN ''
  ELSE 'no_cards' END AS problems FROM events""",
)
def spec_audit(spark, sf):
    return specs(spark, sf).select("event_id", F.array_join(sources.spec_problems(F.col("spec")), ";").alias("problems"))


@query(
    "o3_unknown_keys",
    "SELECT DISTINCT 'k' AS key FROM events WHERE event_id % 4 < 2 AND props LIKE '%k%'",
)
def unknown_keys(spark, sf):
    keys = specs(spark, sf).select(F.explode(F.json_object_keys("spec")).alias("key")).distinct()
    known = C.SPEC_OPTION_KEYS + C.SPEC_OTHER_KEYS
    return keys.where(~F.col("key").isin(*known))


@query(
    "s6_latest_write",
    """SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_write(spark, sf):
    events = V.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return catalogue.latest(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "p4_faces",
    """SELECT card_id, face_position, face_position <> 'SINGLE' AS is_dfc, layout, display_name, name, mana_cost, type_line,
  oracle_text, flavor_text, power, toughness, loyalty, array_to_string(colors, ',') AS colors,
  array_to_string(identity, ',') AS color_identity, art_crop, crossover AS is_crossover, n_parts FROM v_face""",
    ("v_face",),
)
def face_rows(spark, sf):
    return faces(spark, sf).select(
        "card_id", "face_position", "is_dfc", "layout", "display_name", *catalogue.FACE_TEXT, joined("colors"),
        joined("color_identity"), "art_crop", "is_crossover",
        F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_parts"),
    )


@query("p5_crossover", "SELECT card_id, crossover AS is_crossover FROM v_card", ("v_card",))
def crossover(spark, sf):
    promo = F.variant_get("data", "$.promo_types", "array<string>")
    return V.cards(spark, sf).select("card_id", catalogue.is_crossover(promo).alias("is_crossover"))


@query(
    "p6_rejection",
    """SELECT card_id, CASE WHEN layout = 'art_series' THEN layout WHEN lower(tl) LIKE '%battle%' THEN 'battle' END AS reason
FROM v_card""",
    ("v_card",),
)
def rejections(spark, sf):
    type_line = F.variant_get("data", "$.type_line", "string")
    return V.cards(spark, sf).select("card_id", catalogue.rejection(F.col("layout"), type_line).alias("reason"))


@query(
    "p8_option_lookup",
    """
SELECT p_partkey, asked, COALESCE(a.text, b.text, asked) AS meaning FROM (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NATION_' || (p_partkey % 30) WHEN 1 THEN 'nation no ' || (p_partkey % 30)
         ELSE p_name END AS asked FROM part) p
LEFT JOIN (SELECT n_name AS key, 'land of region ' || n_regionkey AS text FROM nation) a ON asked = a.key
LEFT JOIN (SELECT lower('Nation No ' || n_nationkey) AS label, 'land of region ' || n_regionkey AS text FROM nation) b
  ON lower(asked) = b.label
""",
)
def option_lookup(spark, sf):
    options = V.table(spark, sf, "nation").selectExpr(
        "n_name AS key", "concat('Nation No ', n_nationkey) AS label", "concat('land of region ', n_regionkey) AS text"
    )
    asked = V.table(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE p_partkey % 3 WHEN 0 THEN concat('NATION_', p_partkey % 30) WHEN 1 THEN concat('nation no ', p_partkey % 30)
           ELSE p_name END AS asked""",
    )
    return briefs.option_text(asked, options, "asked", "meaning")


@query(
    "p9_option_listing",
    """SELECT n_name AS key, 'Nation ' || n_nationkey AS label, COALESCE(r_name, 'Other') AS "group"
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""",
)
def option_listing(spark, sf):
    nation, region = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    options = nation.selectExpr("n_name AS key", "concat('Nation ', n_nationkey) AS label")
    groups = nation.join(region.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("key"), F.col("r_name").alias("group")
    )
    return briefs.option_listing(options, groups)


@query(
    "p10_coarse_screen",
    f"""SELECT doc_id, regexp_matches(text, '(?i){C.SCREEN_PATTERN}') AS screened,
  length(text) + CASE WHEN regexp_matches(text, '(?i){C.SCREEN_PATTERN}') THEN {len(briefs.COARSE_NOTE)} ELSE 0 END AS chars
FROM documents""",
)
def coarse_screen(spark, sf):
    text = F.col("text")
    return V.documents(spark, sf).select(
        "doc_id", briefs.names_a_screen(text).alias("screened"),
        F.length(briefs.with_coarse_note(text)).cast("bigint").alias("chars"),
    )


#: Names of nations stand in for a table of phrases.
CAMERAS_SQL = "(SELECT list(n_name ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 8)"
MOMENTS_SQL = "(SELECT list(n_name ORDER BY n_nationkey) FROM nation WHERE n_nationkey >= 8 AND n_nationkey < 15)"
STAGING_SQL = f"""{CAMERAS_SQL}[CAST(seed % 8 AS INTEGER) + 1] AS camera,
  {MOMENTS_SQL}[CAST((seed // 8) % 7 AS INTEGER) + 1] AS moment"""


def phrases(spark, sf):
    nations = V.table(spark, sf, "nation")
    return (
        briefs.phrase_list(nations, "n_nationkey", "n_name", C.STAGING_CAMERAS),
        briefs.phrase_list(nations.where(F.col("n_nationkey") >= C.STAGING_CAMERAS), "n_nationkey", "n_name", C.STAGING_MOMENTS),
    )


@query(
    "p11_staging",
    f"""SELECT name, seed, {STAGING_SQL} FROM (
  SELECT name, CAST(list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) AS BIGINT) AS seed
  FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer))""",
)
def staging(spark, sf):
    names = V.table(spark, sf, "part").select(F.col("p_name").alias("name")).unionAll(
        V.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    )
    camera, moment = briefs.staging(F.col("name"), *phrases(spark, sf))
    return names.select("name", T.byte_sum(F.col("name")).alias("seed"), camera.alias("camera"), moment.alias("moment"))


SUBJECT_SQL = """CASE WHEN NOT crossover THEN 'Name: ' || name
    WHEN contains(type_line, '—') THEN 'Subject: a ' || CASE WHEN contains(string_split(type_line, '—')[1], 'Legendary') THEN 'legendary ' ELSE '' END
      || lower(trim(type_line[strpos(type_line, '—') + 1:]))
    ELSE 'Subject: a ' || lower(trim(type_line)) END"""
SCRUB_SQL = """replace(replace(oracle_text, name, 'this creature'), trim(string_split(name, ',')[1]), 'this creature')"""


@query(
    "p12_subject",
    f"SELECT card_id, face_position, {SUBJECT_SQL} AS subject, {SCRUB_SQL} AS rules FROM v_face",
    ("v_face",),
)
def subjects(spark, sf):
    return faces(spark, sf).select(
        "card_id", "face_position",
        briefs.subject(F.col("name"), F.col("type_line"), F.col("is_crossover")).alias("subject"),
        briefs.scrub(F.col("oracle_text"), F.col("name")).alias("rules"),
    )


BRANCH_SQL = """CASE WHEN len(identity) = 0 THEN 'colourless' WHEN list_distinct(identity) = ['W'] THEN 'white'
  WHEN list_distinct(identity) = ['B'] THEN 'black' ELSE 'coloured' END"""
NAMES_SQL = """array_to_string(list_transform(identity, lambda c: CASE c WHEN 'W' THEN 'white' WHEN 'U' THEN 'blue'
  WHEN 'B' THEN 'black' WHEN 'R' THEN 'red' WHEN 'G' THEN 'green' END), ' and ')"""


@query(
    "p14_colour_branch",
    f"SELECT card_id, {BRANCH_SQL} AS branch, {NAMES_SQL} AS names FROM v_card",
    ("v_card",),
)
def colour_branches(spark, sf):
    identity = F.variant_get("data", "$.color_identity", "array<string>")
    from deckloom.functions import colour

    return V.cards(spark, sf).select(
        "card_id", briefs.colour_branch(identity).alias("branch"), colour.colour_names(identity).alias("names")
    )


P = briefs.PHRASES


@query(
    "p13_art_briefs",
    f"""
SELECT card_id, face_position, concat_ws(chr(10), '{P["opening"]}', {SUBJECT_SQL}, 'Type: ' || type_line,
  CASE WHEN oracle_text <> '' THEN 'Rules text: ' || CASE WHEN crossover THEN {SCRUB_SQL} ELSE oracle_text END END,
  CASE WHEN COALESCE(flavor_text, '') <> '' AND NOT crossover THEN 'Flavour text: ' || flavor_text END,
  CASE branch WHEN 'colourless' THEN '{P["colourless"]}' WHEN 'white' THEN '{P["white"]}' WHEN 'black' THEN '{P["black"]}'
    ELSE 'The ' || names || ' belongs to the light; surfaces keep their own colour.' END,
  CASE WHEN art_crop IS NOT NULL THEN '{P["reference"]} Show it ' || camera || ', ' || moment || '.' END,
  CASE WHEN style <> '' THEN 'Art style: ' || style || CASE WHEN style LIKE '%halftone%' THEN '{briefs.COARSE_NOTE}' ELSE '' END || '.' END,
  CASE WHEN direction IS NOT NULL THEN 'Composition: ' || direction || '.' END,
  'Palette to use: moonlit.' || CASE branch WHEN 'colourless' THEN '' WHEN 'black' THEN ' Take its materials, never its warmth.'
    ELSE ' Where the two disagree, the ' || names || ' wins.' END,
  '{P["quality"]}', '{P["output"]}',
  CASE WHEN k % 9 = 0 THEN 'Rejected before, fix this: matted; busy.' END) AS brief
FROM (SELECT *, {STAGING_SQL} FROM (
  SELECT *, {BRANCH_SQL} AS branch, {NAMES_SQL} AS names,
    CASE k % 3 WHEN 0 THEN 'bold halftone comic' WHEN 1 THEN 'oil painting' ELSE '' END AS style,
    CASE WHEN k % 2 = 0 THEN 'a tight crop' END AS direction,
    CAST(list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) AS BIGINT) AS seed FROM v_face))
""",
    ("v_face",),
)
def art_briefs(spark, sf):
    k = F.col("card_id").cast("bigint")
    style = F.when(k % 3 == 0, "bold halftone comic").when(k % 3 == 1, "oil painting").otherwise("")
    corrections = F.when(k % 9 == 0, F.array(F.lit("matted"), F.lit("busy"))).otherwise(F.array().cast("array<string>"))
    brief = briefs.art_brief(
        F.col("name"), F.col("type_line"), F.col("oracle_text"), F.col("flavor_text"), F.col("color_identity"),
        F.col("is_crossover"), F.col("art_crop").isNotNull(), style, F.when(k % 2 == 0, "a tight crop"),
        F.lit("moonlit"), corrections, *phrases(spark, sf),
    )
    return faces(spark, sf).select("card_id", "face_position", brief.alias("brief"))


@query(
    "p15_strip_height",
    f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, asked, CASE WHEN total <= CAST({1 / 3!r} AS DOUBLE) THEN 'a third'
  WHEN total <= CAST(0.42 AS DOUBLE) THEN 'two fifths' WHEN total <= 0.5 THEN 'half' ELSE '55%' END AS budget
FROM (SELECT *, COALESCE(asked, CAST({1 / 6!r} AS DOUBLE)) + CAST({1 / 10 + 1 / 16!r} AS DOUBLE) AS total FROM (
  SELECT *, CASE WHEN need > 0 THEN least(CAST({1 / 3!r} AS DOUBLE), greatest(CAST(0.125 AS DOUBLE),
    ceil(need / CAST(0.02 AS DOUBLE)) * CAST(0.02 AS DOUBLE))) END AS asked
  FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity / 130 END AS need FROM lineitem)))
""",
)
def strip_heights(spark, sf):
    need = F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_quantity") / 130)
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        briefs.strip_height(need).alias("asked"), briefs.surface_budget(need).alias("budget"),
    )


PER_PIP = C.PIP_PITCH * C.PIP_OF_NAME * C.NAME_CARD_SIZE * C.CARD_ASPECT / C.TITLE_PLATE_WIDTH


@query(
    "p16_cost_room",
    f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  least(CAST(0.7 AS DOUBLE), greatest(CAST(0.12 AS DOUBLE), n * CAST({PER_PIP!r} AS DOUBLE) + CAST(0.04 AS DOUBLE))) AS room,
  CASE WHEN n > 0 THEN (n + greatest(0, n - 1) * CAST(0.14 AS DOUBLE)) * (greatest(CAST(0.018 AS DOUBLE),
    least(CAST({C.NAME_CARD_SIZE * C.PIP_OF_NAME!r} AS DOUBLE), l_tax * CAST(0.72 AS DOUBLE))) * CAST(0.75 AS DOUBLE))
    * CAST({C.CARD_ASPECT!r} AS DOUBLE) + CAST(0.045 AS DOUBLE) ELSE 0.0 END AS width
FROM (SELECT *, l_linenumber - 1 AS n FROM lineitem)
""",
)
def cost_rooms(spark, sf):
    tokens = F.col("l_linenumber") - 1
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        briefs.cost_room(tokens).alias("room"), briefs.cost_width(tokens, F.col("l_tax")).alias("width"),
    )


@query(
    "p17_file_stems",
    r"""
SELECT source, id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || suffix AS job_stem,
  replace(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]', '-', 'g'), '^-+|-+$', '', 'g'), '--', '-') || suffix AS pack_stem
FROM (SELECT 'card' AS source, card_id || face_position AS id, name,
        CASE face_position WHEN 'SINGLE' THEN '' ELSE '-' || lower(face_position) END AS suffix FROM v_face
      UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), url, '' FROM pages)
""",
    ("v_face",),
)
def file_stems(spark, sf):
    named = faces(spark, sf).select(
        F.lit("card").alias("source"), F.concat("card_id", "face_position").alias("id"), "name", "face_position"
    ).unionAll(
        V.table(spark, sf, "pages").select(
            F.lit("page"), F.col("page_id").cast("string"), "url", F.lit("SINGLE")
        )
    )
    name, position = F.col("name"), F.col("face_position")
    return named.select(
        "source", "id", T.file_stem(name, position).alias("job_stem"),
        T.file_stem(name, position, T.pack_slug).alias("pack_stem"),
    )


@query(
    "p23_needs_tab",
    """SELECT card_id, face_position, power IS NOT NULL AS composited, power IS NOT NULL OR loyalty IS NOT NULL AS lettered
FROM v_face""",
    ("v_face",),
)
def tabs(spark, sf):
    return faces(spark, sf).select(
        "card_id", "face_position",
        catalogue.needs_tab(F.col("power"), F.col("loyalty"), F.lit(False)).alias("composited"),
        catalogue.needs_tab(F.col("power"), F.col("loyalty"), F.lit(True)).alias("lettered"),
    )


@query(
    "j5_art_reference",
    """
WITH first_printing AS (SELECT display_name, card_id AS old_id FROM (
    SELECT display_name, card_id, row_number() OVER (PARTITION BY display_name ORDER BY released, card_id) AS rn
    FROM v_face WHERE NOT crossover) WHERE rn = 1)
SELECT f.card_id, f.face_position,
  CASE WHEN NOT f.crossover THEN f.art_crop ELSE o.art_crop END AS reference_art,
  CASE WHEN NOT f.crossover THEN COALESCE(f.flavor_text, '') ELSE COALESCE(o.flavor_text, '') END AS reference_flavor,
  f.crossover AND p.old_id IS NULL AS licensed
FROM v_face f LEFT JOIN first_printing p ON f.crossover AND p.display_name = f.display_name
LEFT JOIN v_face o ON f.crossover AND o.card_id = p.old_id AND o.face_position = f.face_position
""",
    ("v_face",),
)
def art_references(spark, sf):
    return catalogue.art_reference(faces(spark, sf))


@query(
    "j11_refusal_routing",
    """SELECT p_partkey, p_name AS name, p_name IN ('Hulk, Bruce Banner', 'Spider-Man, Web-Slinger')
  OR p_name IN (SELECT p_name FROM part WHERE p_type = 'PROMO' AND p_size > 40) AS fallback FROM part""",
)
def refusal_routing(spark, sf):
    part = V.table(spark, sf, "part")
    memo = part.where("p_type = 'PROMO' AND p_size > 40").select(F.col("p_name").alias("name"))
    return catalogue.route_refused(part.select("p_partkey", F.col("p_name").alias("name")), memo)


@query(
    "o4_refused_names",
    """SELECT DISTINCT name FROM (SELECT p_name AS name FROM part WHERE p_type = 'PROMO' UNION ALL
  SELECT 'Hulk, Bruce Banner' UNION ALL SELECT 'Spider-Man, Web-Slinger')""",
)
def refused(spark, sf):
    return catalogue.refused_names(V.table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_name").alias("name")))


@query(
    "o5_shared_values",
    """
SELECT 'archetype' AS kind, r_name AS value FROM (SELECT r_name FROM region INTERSECT
  SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0)
UNION ALL
SELECT 'hued:' || card_id, array_to_string(list_sort(list_filter(list_distinct(identity), lambda c: c IN ('R', 'G', 'U', 'B'))), ',')
FROM v_card
""",
    ("v_card",),
)
def shared(spark, sf):
    region, nation = V.table(spark, sf, "region"), V.table(spark, sf, "nation")
    indebted = V.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    available = (
        nation.join(indebted, "n_nationkey").select(F.col("n_regionkey").alias("r_regionkey")).distinct()
        .join(region, "r_regionkey").select("r_name")
    )
    both = catalogue.shared_values(region.select("r_name"), available)
    identity = F.variant_get("data", "$.color_identity", "array<string>")
    hued = F.array_intersect(identity, F.array(*[F.lit(m) for m in C.HUED_MANA]))
    return both.select(F.lit("archetype").alias("kind"), F.col("r_name").alias("value")).unionAll(
        V.cards(spark, sf).select(F.concat(F.lit("hued:"), "card_id"), F.array_join(F.array_sort(hued), ","))
    )


COST_OK = ", ".join(f"'{t.strip('{}')}'" for t, _, in_costs in C.SYMBOLS if in_costs)
KNOWN = ", ".join(
    f"'{t.strip('{}')}'" for t, _, _ in C.SYMBOLS
)


@query(
    "j12_symbol_audit",
    f"""SELECT token, count(*) AS uses, token IN ({KNOWN}) AS known, token IN ({COST_OK}) AS allowed
FROM (SELECT unnest(regexp_extract_all(mana_cost, '\\{{([^}}]{{1,6}})\\}}', 1)) AS token FROM v_face) GROUP BY token""",
    ("v_face",),
)
def symbol_audit(spark, sf):
    found = F.regexp_extract_all(F.coalesce("mana_cost", F.lit("")), F.lit(C.SYMBOL_PATTERN), F.lit(1))
    costs = faces(spark, sf).select(found.alias("tokens"))
    return catalogue.symbol_audit(costs, sources.symbol_dimension(spark))


@query(
    "j13_declared_sources",
    """
SELECT d.archetype, d.stem, f.path, f.path IS NOT NULL AS present
FROM (SELECT DISTINCT p_brand AS archetype, replace(p_name, ' ', '_') || p_partkey % 3 AS stem FROM part WHERE p_size % 2 = 0) d
LEFT JOIN (SELECT stem, max(path) AS path FROM (SELECT replace(p_name, ' ', '_') || p_partkey % 3 AS stem,
    'decks/' || p_size || '/' || replace(p_name, ' ', '_') || p_partkey % 3 || '.png' AS path FROM part WHERE p_size % 5 = 0)
  GROUP BY stem) f USING (stem)
""",
)
def declared_sources(spark, sf):
    part = V.table(spark, sf, "part").withColumn("stem", F.expr("concat(replace(p_name, ' ', '_'), p_partkey % 3)"))
    declared = part.where("p_size % 2 = 0").select(F.col("p_brand").alias("archetype"), "stem").distinct()
    files = part.where("p_size % 5 = 0").select(F.expr("concat('decks/', p_size, '/', stem, '.png')").alias("path"))
    return catalogue.declared_sources(declared, files)


@query(
    "f2_symbol_tokens",
    r"""SELECT card_id, face_position, array_to_string(list_transform(regexp_extract_all(mana_cost, '\{([^}]{1,6})\}', 1),
  lambda t: CASE t WHEN 'G/W' THEN 'G/W' WHEN 'W/P' THEN 'P/W' ELSE upper(t) END), ' ') AS tokens FROM v_face""",
    ("v_face",),
)
def symbol_tokens(spark, sf):
    tokens = F.array_join(T.symbol_tokens(F.col("mana_cost")), " ")
    return faces(spark, sf).select(
        "card_id", "face_position", F.when(F.col("mana_cost").isNotNull(), tokens).alias("tokens")
    )


@query(
    "f3_symbol_runs",
    r"""
SELECT card_id, face_position, ord - 1 AS ord, run[1] AS text, run[2] = 's' AS symbol FROM (
  SELECT card_id, face_position, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS ord FROM (
    SELECT card_id, face_position, list_filter(flatten(list_transform(list_zip(
        string_split_regex(oracle_text, '(?i)\{T\}'), regexp_extract_all(oracle_text, '(?i)\{T\}')),
        lambda p: [[p[1], 't'], [p[2], 's']])), lambda r: COALESCE(r[1], '') <> '') AS runs FROM v_face))
""",
    ("v_face",),
)
def symbol_runs(spark, sf):
    return faces(spark, sf).select(
        "card_id", "face_position", F.posexplode(T.symbol_runs(F.col("oracle_text"))).alias("ord", "run")
    ).select("card_id", "face_position", F.col("ord").cast("bigint"), "run.*")
