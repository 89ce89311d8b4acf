"""Catalogue cards: faces, rejection, name lookup, printings, plans.

A card keeps its whole document as VARIANT. That is what lets an absent key and an explicit null
differ: a missing path is SQL null and a stored null is a variant null, so `coalesce` over variants
falls back exactly when the key is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import arrays as A
from deckloom.operators import scale

FACE_TEXT = ["name", "mana_cost", "type_line", "oracle_text", "flavor_text", "power", "toughness", "loyalty"]
BLANK_WHEN_ABSENT = {"mana_cost", "type_line", "oracle_text", "flavor_text"}


def front_name(name: Column) -> Column:
    return F.trim(F.get(F.split(name, C.NAME_SEPARATOR), F.lit(0)))


def rejection(layout: Column, type_line: Column) -> Column:
    """Why a card cannot be planned, or null."""
    return F.when(layout.isin(*C.UNSUPPORTED_LAYOUTS), layout).when(
        F.contains(F.lower(F.coalesce(type_line, F.lit(""))), F.lit("battle")), F.lit("battle")
    )


def is_crossover(promo_types: Column) -> Column:
    return F.coalesce(F.array_contains(promo_types, C.CROSSOVER_PROMO), F.lit(False))


def needs_tab(power: Column, loyalty: Column, lettered: Column) -> Column:
    return power.isNotNull() | (lettered & loyalty.isNotNull())


def face_count(layout: Column, data: Column) -> Column:
    listed = F.size(F.variant_get(data, "$.card_faces", "array<variant>"))
    return F.when(layout.isin(*C.TWO_SIDED_LAYOUTS), F.least(F.coalesce(listed, F.lit(0)), F.lit(2))).otherwise(F.lit(1))


def _sides(layout: Column, data: Column) -> Column:
    """The face documents to make: the first two of a two-sided card, else one that is absent."""
    listed = F.variant_get(data, "$.card_faces", "array<variant>")
    alone = F.array(F.lit(None).cast("variant"))
    return F.when(layout.isin(*C.TWO_SIDED_LAYOUTS), F.slice(listed, 1, 2)).otherwise(alone)


def _picked(face: Column, data: Column, key: str) -> Column:
    return F.coalesce(F.variant_get(face, f"$.{key}", "variant"), F.variant_get(data, f"$.{key}", "variant"))


def _text(face: Column, data: Column, key: str) -> Column:
    value = _picked(face, data, key)
    got = F.variant_get(value, "$", "string")
    return F.when(value.isNull(), F.lit("")).otherwise(got) if key in BLANK_WHEN_ABSENT else got


def _position(layout: Column, index: Column) -> Column:
    single = ~layout.isin(*C.TWO_SIDED_LAYOUTS)
    return F.when(single, F.lit("SINGLE")).when(index == 0, F.lit("FRONT")).otherwise(F.lit("BACK"))


def face_list(layout: Column, data: Column) -> Column:
    """The faces of a card inside its row, narrow: position, name, cost."""
    return F.transform(
        _sides(layout, data),
        lambda face, i: F.struct(
            _position(layout, i).alias("face_position"),
            _text(face, data, "name").alias("face_name"),
            _text(face, data, "mana_cost").alias("mana_cost"),
        ),
    )


def faces(cards: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per face to make: FRONT and BACK for the two-sided layouts, else SINGLE.

    Input: card_id, name, layout, data VARIANT. Every printed field comes from the face when its
    key is there, even null, and from the card otherwise; colour identity is the card's alone; an
    empty `image_uris` falls through.
    """
    layout, data, face = F.col("layout"), F.col("data"), F.col("face")
    tall = cards.select(
        *keep, "card_id", "layout", "data", F.col("name").alias("display_name"),
        F.posexplode(_sides(layout, data)).alias("ord", "face"),
    )
    none_listed = F.array().cast("array<string>")

    def strings(value: Column) -> Column:
        return F.when(value.isNull(), none_listed).otherwise(F.variant_get(value, "$", "array<string>"))

    def images(document: Column) -> Column:
        found = F.variant_get(document, "$.image_uris", "map<string,string>")
        return F.when(F.size(found) > 0, found)

    position = _position(layout, F.col("ord"))
    return tall.select(
        *keep,
        "card_id",
        position.alias("face_position"),
        (position != "SINGLE").alias("is_dfc"),
        "layout",
        "display_name",
        *[_text(face, data, key).alias(key) for key in FACE_TEXT],
        strings(_picked(face, data, "colors")).alias("colors"),
        strings(F.variant_get(data, "$.color_identity", "variant")).alias("color_identity"),
        F.coalesce(images(face), images(data))["art_crop"].alias("art_crop"),
        is_crossover(F.variant_get(data, "$.promo_types", "array<string>")).alias("is_crossover"),
        F.when(position == "SINGLE", F.variant_get(data, "$.card_faces", "array<struct<name:string,mana_cost:string>>"))
        .alias("parts"),
    )


def aliases(name: Column) -> Column:
    """Every name a card answers to: each prefix of the name that ends at a separator, lower case."""

    def prefixes(parts: Column) -> Column:
        return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), C.NAME_SEPARATOR))

    return A.let(F.split(F.lower(name), C.NAME_SEPARATOR), prefixes)


def alias_index(cards: DataFrame, carry: list[str] = ()) -> DataFrame:
    """alias → the matching card with the smallest id, and the columns carried with it.

    "Equal, or starts with the name and a separator" is a theta join; listing the aliases makes it
    an equi-join. The argmin merges before the shuffle, so a much reprinted name stays cheap.
    """
    listed = cards.select("card_id", *carry, F.explode(aliases(F.col("name"))).alias("alias"))
    return listed.groupBy("alias").agg(F.min(F.struct("card_id", *carry)).alias("_card")).select("alias", "_card.*")


def resolve(lines: DataFrame, cards: DataFrame, name: str = "name", carry: list[str] = ()) -> DataFrame:
    """Left join of asked names to their card. `card_id` is null where nothing answers.

    An ordinary equi-join: Spark broadcasts an index that measures small, and splits the partitions of
    names asked for far more often than the rest at run time.
    """
    keyed = lines.withColumn("alias", F.lower(F.col(name)))
    return scale.lookup(keyed, alias_index(cards, carry), ["alias"]).drop("alias")


def plan_lines(lines: DataFrame, cards: DataFrame, carry_faces: bool = False) -> DataFrame:
    """Every line with its disposition: entry, unsupported (with the reason) or unresolved.

    A line whose quantity does not fit 64 bits (null after parsing) is unsupported, so no sum leaves it out unseen.
    """
    carry = ["reason", "faces"] + (["face_list"] if carry_faces else [])
    rated = cards.select(
        "card_id",
        "name",
        rejection(F.col("layout"), F.variant_get("data", "$.type_line", "string")).alias("reason"),
        face_count(F.col("layout"), F.col("data")).alias("faces"),
        face_list(F.col("layout"), F.col("data")).alias("face_list"),
    ).select("card_id", "name", *carry)
    placed = resolve(lines, rated, carry=carry)
    if "quantity" in lines.columns:
        too_large = F.col("card_id").isNotNull() & F.col("quantity").isNull()
        placed = placed.withColumn("reason", F.coalesce("reason", F.when(too_large, "quantity_too_large")))
    disposition = (
        F.when(F.col("card_id").isNull(), "unresolved").when(F.col("reason").isNotNull(), "unsupported")
        .otherwise("entry")
    )
    return placed.withColumn("disposition", disposition)


def unresolved(lines: DataFrame, cards: DataFrame, list_id: str, order: list[str]) -> DataFrame:
    """Names nothing answers to, one row per list and spelling, with the place first seen."""
    from deckloom.operators import lists

    asked = lists.first_seen(lines, [list_id, "name"], order).withColumn("alias", F.lower("name"))
    known = alias_index(cards).select("alias")
    return asked.join(known, "alias", "left_anti").drop("alias")


def plan_faces(lines: DataFrame, cards: DataFrame) -> DataFrame:
    """Entry lines times the faces of their card; the quantity is carried. One join in all."""
    planned = plan_lines(lines, cards, carry_faces=True).where(F.col("disposition") == "entry")
    return planned.select(*lines.columns, "card_id", F.inline("face_list"))


def credits(planned: DataFrame, list_id: str) -> DataFrame:
    """Per list: lines by disposition, faces to make, and faces times quantity."""
    is_entry = F.col("disposition") == "entry"
    return planned.groupBy(list_id).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(is_entry).alias("entries"),
        F.count_if(F.col("disposition") == "unsupported").alias("unsupported"),
        F.count_if(F.col("disposition") == "unresolved").alias("unresolved"),
        F.coalesce(F.sum(F.when(is_entry, F.col("faces"))), F.lit(0)).cast("bigint").alias("faces"),
        F.coalesce(F.sum(F.when(is_entry, F.col("faces") * F.col("quantity"))), F.lit(0)).cast("bigint").alias("credits"),
    )


def art_reference(faces_: DataFrame) -> DataFrame:
    """Art and flavour to work from. Needs faces plus `released`.

    A crossover face takes them from the oldest printing of its name that is not one, same side;
    with no such printing it is licensed only. Other faces keep their own.
    """
    ordinary = faces_.where(~F.col("is_crossover"))
    seen = F.struct("released", "card_id", "art_crop", "flavor_text")
    sides = ["SINGLE", "FRONT", "BACK"]
    oldest = ordinary.groupBy("display_name").agg(
        F.min(F.struct("released", "card_id")).alias("_first"),
        *[F.min(F.when(F.col("face_position") == side, seen)).alias(f"_{side}") for side in sides],
    )
    own = faces_.where(~F.col("is_crossover")).select(
        "card_id",
        "face_position",
        F.col("art_crop").alias("reference_art"),
        F.coalesce("flavor_text", F.lit("")).alias("reference_flavor"),
        F.lit(False).alias("licensed"),
    )
    skins = scale.lookup(faces_.where("is_crossover"), oldest, ["display_name"])
    side = F.lit(None)
    for name in sides:
        side = F.when(F.col("face_position") == name, F.col(f"_{name}")).otherwise(side)
    matched = F.when(side["card_id"] == F.col("_first.card_id"), side)
    return own.unionByName(
        skins.select(
            "card_id",
            "face_position",
            matched["art_crop"].alias("reference_art"),
            F.coalesce(matched["flavor_text"], F.lit("")).alias("reference_flavor"),
            F.col("_first").isNull().alias("licensed"),
        )
    )


def route_refused(faces_: DataFrame, memo: DataFrame, name: str = "name") -> DataFrame:
    """Flag faces whose name was refused before: in the seed or in the memo table."""
    known = memo.select(F.col("name").alias(name)).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) | F.col(name).isin(*C.REFUSED_SEED)
    return faces_.join(known, name, "left").withColumn("fallback", hit).drop("_hit")


def refused_names(memo: DataFrame) -> DataFrame:
    """Seed and memo as one sorted set."""
    seed = memo.sparkSession.createDataFrame([(n,) for n in C.REFUSED_SEED], "name string")
    return memo.select("name").unionByName(seed).distinct().orderBy("name")


def symbol_audit(costs: DataFrame, symbols: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Per cost token: uses, whether a symbol exists, whether it may stand in a cost.

    `symbols` is the fixed symbol dimension (84 rows), so it is broadcast.
    """
    from deckloom.functions import text as T

    used = (
        costs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
        .withColumn("file", T.symbol_file(F.col("token")))
    )
    dim = symbols.groupBy("file").agg(F.bool_or("appears_in_mana_costs").alias("in_costs"))
    return used.join(F.broadcast(dim), "file", "left").select(
        "token", "uses", F.col("in_costs").isNotNull().alias("known"),
        F.coalesce("in_costs", F.lit(False)).alias("allowed"),
    )


def declared_sources(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Declared (archetype, stem) with the file found for it. Files of one stem collapse to the greatest path."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    found = files.withColumn("stem", stem).groupBy("stem").agg(F.max("path").alias("path"))
    return declared.join(found, "stem", "left").withColumn("present", F.col("path").isNotNull())


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the last write per key. `order` must tell any two writes apart."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    newest = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[f"_row.{c}" for c in [*order, *rest]])


def shared_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values in both, once each."""
    return left.intersect(right)
