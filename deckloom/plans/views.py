"""Card-like views over the star-schema test tables. Plain column expressions, no shuffles but one join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from deckloom.operators import scale
from deckloom.sources import catalogue as sources


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _base(name: str, key: str) -> Column:
    return F.concat_ws(" ", F.col(name), (F.col(key) % 10).cast("string"))


def card_documents(spark: SparkSession, sf: str) -> DataFrame:
    """part → p_partkey, released, document: one JSON card each, with absent and explicit null keys."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return part.selectExpr(
        "p_partkey", "p_size", "p_type", "concat(p_name, ' ', p_partkey % 10) AS base",
        "cast(replace(p_brand, 'Brand#', '') AS int) AS brand", "p_partkey AS k",
    ).selectExpr(
        "*",
        """CASE WHEN k % 2 = 0 THEN base WHEN k % 10 = 5 THEN concat(base, ' // ', p_type, ' // Tail')
           ELSE concat(base, ' // ', p_type) END AS name""",
        """CASE p_type WHEN 'LARGE' THEN 'transform' WHEN 'STANDARD' THEN 'modal_dfc' WHEN 'MEDIUM' THEN 'split'
           WHEN 'PROMO' THEN 'art_series' ELSE 'normal' END AS layout""",
        """CASE WHEN p_type = 'SMALL' AND p_size % 2 = 0 THEN 'Battle — Siege'
           WHEN k % 4 = 0 THEN 'Legendary Creature — Elf Warrior' WHEN k % 4 = 1 THEN 'Instant'
           WHEN k % 4 = 2 THEN 'Creature — Goblin' ELSE 'Legendary Planeswalker — Sage' END AS tl""",
        """CASE p_size % 6 WHEN 0 THEN '{2}{G}' WHEN 1 THEN '{G/W}{U}' WHEN 2 THEN '{X}{R}{R}'
           WHEN 3 THEN '{W/P}{1}' WHEN 4 THEN '' ELSE '{17}{T}{ZZ}' END AS cost""",
        r"""CASE k % 4 WHEN 0 THEN concat('Flying, vigilance\\nWhenever ', base, " attacks, draw. ({T}: It isn't free.)")
           WHEN 1 THEN concat(base, ' deals 3 damage. {ZZ}') WHEN 2 THEN 'Alliance — Gain 1 life.\\n\\nTrample'
           ELSE '+1: Draw a card.' END AS rules""",
        """CASE brand % 6 WHEN 0 THEN '' WHEN 1 THEN '"W"' WHEN 2 THEN '"U"' WHEN 3 THEN '"B"' WHEN 4 THEN '"R"'
           ELSE '"G"' END AS first_colour""",
        """CASE WHEN k % 5 <> 0 OR brand % 6 = 0 THEN '' WHEN brand % 6 = 1 THEN ',"U"' WHEN brand % 6 = 2 THEN ',"B"'
           WHEN brand % 6 = 3 THEN ',"R"' WHEN brand % 6 = 4 THEN ',"G"' ELSE ',"W"' END AS second_colour""",
        "p_type IN ('LARGE', 'STANDARD') AS two",
    ).select(
        "p_partkey",
        F.col("p_size").alias("released"),
        F.concat(
            F.expr("""concat('{"id":"', lpad(k, 12, '0'), '","name":"', name, '","layout":"', layout, '"')"""),
            F.expr("""concat(',"type_line":"', tl, CASE WHEN two THEN ' // Land' ELSE '' END, '"')"""),
            F.expr("""CASE WHEN NOT two THEN concat(',"mana_cost":"', cost, '"')
                           WHEN k % 2 = 0 THEN '' ELSE ',"mana_cost":"{9}"' END"""),
            F.expr("""CASE WHEN two THEN '' ELSE concat(',"oracle_text":"', rules, '"') END"""),
            F.expr("""CASE WHEN NOT two AND k % 2 = 0 THEN ',"power":"2","toughness":"3"'
                           WHEN two AND k % 11 = 0 THEN ',"power":"7"' ELSE '' END"""),
            F.expr("""CASE WHEN NOT two AND k % 4 = 3 THEN ',"loyalty":"3"' ELSE '' END"""),
            F.expr("""CASE WHEN k % 6 = 0 THEN concat(',"flavor_text":"Flavour ', k, '"') ELSE '' END"""),
            F.expr("""concat(',"color_identity":[', first_colour, second_colour, ']')"""),
            F.expr("""concat(',"colors":[', first_colour, ']')"""),
            F.expr("""CASE k % 4 WHEN 0 THEN ',"promo_types":["universesbeyond","foil"]' WHEN 1 THEN ''
                           WHEN 2 THEN ',"promo_types":null' ELSE ',"promo_types":["foil"]' END"""),
            F.expr("""CASE WHEN k % 3 <> 0 THEN concat(',"image_uris":{"art_crop":"art/', k, '"}') ELSE '' END"""),
            F.expr("""CASE WHEN two THEN concat(',"card_faces":[{"name":"', base, '","mana_cost":"', cost,
                        '","oracle_text":"', rules, '"', CASE WHEN k % 5 = 0 THEN '' ELSE concat(',"type_line":"', tl, '"') END,
                        CASE WHEN k % 2 = 0 THEN ',"power":"1","toughness":null,"image_uris":{}'
                             ELSE concat(',"image_uris":{"art_crop":"art/', k, '/front"}') END,
                        '},{"name":"', p_type, '","type_line":"Land","colors":[]',
                        CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ',"mana_cost":null' ELSE ',"mana_cost":""' END,
                        CASE WHEN k % 2 = 1 THEN concat(',"flavor_text":"Back ', k, '"') ELSE '' END, '}',
                        CASE WHEN k % 7 = 0 THEN ',{"name":"Third"}' ELSE '' END, ']')
                      WHEN layout = 'split' THEN concat(',"card_faces":[{"name":"', base, '","mana_cost":"', cost,
                        '"},{"name":"', p_type, '","mana_cost":"{1}"}]') ELSE '' END"""),
            F.lit("}"),
        ).alias("document"),
    )


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """released, card_id, name, layout, data VARIANT."""
    return sources.typed_cards(card_documents(spark, sf), "document", keep=["released"])


LIST_ORDER = ["line", "part", "supp"]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem ⋈ part → list_id, line, part, supp (their order), raw: one list line per row."""
    item = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("bigint").alias("qty"),
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type")
    rows = (
        item.join(part, "part")
        .withColumn("base", _base("p_name", "part"))
        .withColumn("n", F.col("part") + F.col("supp") * 3 + F.col("line"))
    )
    raw = F.expr(
        """CASE WHEN n % 13 = 0 THEN CASE WHEN n % 2 = 0 THEN concat('# ', base) ELSE ' Sideboard:' END
                WHEN n % 11 = 0 THEN concat(qty, ' Unknown ', part)
                WHEN n % 7 = 0 THEN concat(qty, ' ', base, ' (SET) 12')
                WHEN n % 5 = 0 THEN concat(qty, 'x ', base, ' // ', p_type)
                WHEN n % 3 = 0 THEN upper(base) WHEN n % 17 = 0 THEN '  '
                ELSE concat(qty, ' ', base) END"""
    )
    return scale.once(rows, raw=raw).select("list_id", *LIST_ORDER, "raw")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """orders → job_id, status, worker_pid, created."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS job_id",
        "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 3 END AS worker_pid",
        "o_orderdate AS created",
        "o_custkey % 8 + 1 AS faces",
    )


RESULT_ORDER = ["finished", "line", "part", "supp"]


def results(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem → one finished face per row, in completion order RESULT_ORDER within its job."""
    return results_of(table(spark, sf, "lineitem"))


def results_of(lineitem: DataFrame) -> DataFrame:
    """The same over a batch or a stream of lineitem rows."""
    return lineitem.selectExpr(
        "l_orderkey AS job_id", "l_shipdate AS finished", "cast(l_linenumber AS bigint) AS line",
        "l_partkey AS part", "l_suppkey AS supp",
        "concat('Card ', l_partkey % 50) AS name",
        "CASE WHEN l_returnflag = 'R' THEN 'engine fault' END AS error",
        """CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber % 3 WHEN 0 THEN array('cost_wrong')
           WHEN 1 THEN array('text_wrong', 'cost_wrong') ELSE array('busy') END
           ELSE cast(array() AS array<string>) END AS problems""",
        "CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE cast(l_quantity AS bigint) END AS seconds",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount + l_tax END AS title_y",
        "l_quantity / 150 AS strip_height",
        "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 0.125 + (l_partkey % 10) / 50 END AS asked",
        "cast(l_quantity AS bigint) AS quantity",
    ).withColumn(
        "status",
        F.expr("CASE WHEN error IS NOT NULL THEN 'failed' WHEN size(problems) > 0 THEN 'unsound' ELSE 'ok' END"),
    )


def level(top: int) -> Column:
    """Embedding values as whole numbers 0..top, inside the row."""
    return F.transform(
        "embedding",
        lambda e: F.least(
            F.lit(top), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5252) / 1.0504 * top + 0.5).cast("int"))
        ),
    )


def scaled(spark: SparkSession, sf: str, top: int) -> DataFrame:
    """embeddings → image_id, label, raw."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label", "embedding")
    return scale.once(rows, raw=level(top)).drop("embedding")


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """8×8 grey images: image_id, batch, width, height, px in reading order."""
    return scaled(spark, sf, 255).select(
        "image_id", "label",
        F.when(F.col("label") < 5, "baseline").otherwise("batch").alias("batch"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("raw").alias("px"),
    )


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """8×8 colour images: image_id, label, width, height, r, g, b. Every value gives a pixel, so that hues occur."""

    def channel(times: int, shift: int) -> Column:
        return F.transform("raw", lambda v: ((v * times + shift) % 256).cast("int"))

    return scaled(spark, sf, 255).select(
        "image_id", "label", F.lit(8).alias("width"), F.lit(8).alias("height"),
        channel(1, 0).alias("r"), channel(3, 17).alias("g"), channel(7, 101).alias("b"),
    )


CANVAS_SIDE = 40


def _painted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Paint each image's canvas. What a pixel is comes first, once; its channels follow from that."""
    side, last = CANVAS_SIDE, CANVAS_SIDE - 1
    along = F.sequence(F.lit(0), F.lit(last))
    block = F.array(*[F.lit(i // 5) for i in range(side)])
    kind, depth = F.col("image_id") % 5, F.col("image_id") % 6
    white, margin = -1, -2

    def pixel(x: Column, y: Column) -> Column:
        nearest_x, nearest_y = F.least(x, last - x), F.least(y, last - y)
        return (
            F.when((kind == 3) & (nearest_x + nearest_y < 8 + depth), F.lit(white))
            .when((kind < 3) & (F.least(nearest_x, nearest_y) < depth), F.lit(margin))
            .otherwise(F.get("raw", F.get(block, y) * 8 + F.get(block, x)))
        )

    codes = F.flatten(F.transform(along, lambda y: F.transform(along, lambda x: pixel(x, y))))

    def channel(times: int, shift: int, colours: tuple[int, int, int]) -> Column:
        edge = F.when(kind == 0, F.lit(colours[0])).when(kind == 1, F.lit(colours[1])).otherwise(F.lit(colours[2]))
        return F.transform(
            "_codes",
            lambda v: F.when(v >= 0, ((v * times + shift) % 256).cast("int")).when(v == white, F.lit(255)).otherwise(edge),
        )

    sized = rows.select("image_id", "label", F.lit(side).alias("width"), F.lit(side).alias("height"), "raw", *keep)
    coded = scale.once(sized, _codes=codes).drop("raw")
    return scale.once(
        coded, r=channel(1, 0, (4, 240, 50)), g=channel(3, 17, (6, 235, 53)), b=channel(7, 101, (9, 225, 60))
    ).drop("_codes")


SHEET_SIDE = 200


#: Bytes of sheets that a task hands on at a time.
SHEET_BATCH = 4 << 20


def _sheet_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each image's sheet in blue-green-red bytes in place of its cells. A sheet is hundreds of times its cells, so a batch leaves in parts."""
    side = SHEET_SIDE
    line = np.minimum(np.arange(side), side - 1 - np.arange(side))
    edge, corner = np.minimum(line[:, None], line), line[:, None] + line
    margins, arcs = [edge < 5 * k for k in range(6)], [corner < 8 + k for k in range(6)]
    count = max(1, SHEET_BATCH // (3 * side * side))
    for batch in batches:
        for start in range(0, batch.num_rows, count):
            part, data = batch.slice(start, count), []
            for cells, k in zip(part.column("raw").to_pylist(), part.column("image_id").to_pylist()):
                cell = np.asarray(cells, np.int32).reshape(8, 8)
                colours = np.stack([cell * 7 + 101, cell * 3 + 17, cell], axis=-1).astype(np.uint8)  # modulo 256
                pixels = colours.repeat(side // 8, axis=1).repeat(side // 8, axis=0)
                if k % 5 < 3:
                    pixels[margins[k % 6]] = ((9, 6, 4), (225, 235, 240), (60, 53, 50))[k % 5]
                elif k % 5 == 3:
                    pixels[arcs[k % 6]] = 255
                data.append(pixels.tobytes())
            yield pa.RecordBatch.from_arrays([part.column("image_id"), part.column("label"), pa.array(data, pa.binary())], names=["image_id", "label", "data"])


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """200×200 colour images as the image source stores them: each grid cell is a 25×25 block, inside a margin.

    The margin is id % 6 * 5 pixels deep; its colour goes by id % 5: black, cream, flat dark grey, paper white in
    triangles of 8 + id % 6 pixels in the corners only, or none.
    """
    cells = scaled(spark, sf, 255).select("image_id", "label", "raw")
    painted = cells.mapInArrow(_sheet_bytes, StructType([cells.schema["image_id"], cells.schema["label"], StructField("data", BinaryType())]))
    stored = F.struct(F.lit(SHEET_SIDE).alias("width"), F.lit(SHEET_SIDE).alias("height"), F.lit(3).alias("nChannels"), "data")
    return painted.select("image_id", "label", stored.alias("image"))


def _box_columns(source: str) -> list[Column]:
    def raw(j: int) -> Column:
        a, b, c, d = (F.get(source, F.lit(4 * j + i)) for i in range(4))

        def part(v: Column, n: int) -> Column:
            return F.floor(v / n).cast("int")

        if j == 0:
            top, tall, left, right = part(a * a, 1400), part(c, 8), part(b, 3), 1000 - part(d, 3)
        elif j == 1:
            top, tall, left, right = 300 + part(a, 2), part(c, 8), part(b, 2), 1000 - part(d, 2)
        elif j == 2:
            top, tall, left, right = 600 + part(a, 2), part(c, 5), 600 + part(b, 3), 800 + part(d, 4)
        elif j < 7:
            top, tall, left, right = 400 + 60 * j + part(a, 4), part(c, 6), part(b, 4), 1000 - part(d, 4)
        else:
            top, tall, left, right = a, part(c, 20) - 20, b, b + part(d, 2) - 150
        flipped = (a + d) % 7 == 0
        low, high = F.when(flipped, top + tall).otherwise(top), F.when(flipped, top).otherwise(top + tall)
        return F.array(low, left, high, right)

    k = F.col("image_id")
    return [
        k.alias("face_id"),
        raw(0).alias("title"), raw(1).alias("type"), raw(2).alias("pt"),
        F.array(*[raw(j) for j in range(3, 7)]).alias("rules"),
        F.when(k % 3 == 0, F.array(raw(7), raw(8))).alias("spare"),
        F.array(*[raw(j) for j in range(9, 16)]).alias("marks"),
        F.when(k % 4 == 0, raw(15)).alias("pt_detail"),
        F.when(k % 5 == 0, raw(14)).alias("name"),
        F.when(k % 2 == 0, F.lit("2")).alias("power"),
        F.when(k % 6 == 1, F.lit("3")).alias("loyalty"),
        (k % 4).cast("int").alias("paragraphs"),
        (k % 8 == 3).alias("overflowed"),
        (k % 11).cast("int").alias("tokens"),
    ]


def raw_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One detection per embedding: face_id and raw [ymin, xmin, ymax, xmax] boxes 0-1000, as stored.

    title, type, pt, pt_detail, name, rules[4], spare[2], marks[7], plus what is known of the face.
    """
    return scaled(spark, sf, 1000).select(*_box_columns("raw"))


def canvas_strips(spark: SparkSession, sf: str) -> DataFrame:
    """Canvases with the raw rules boxes of the same face in the same row, so pixels need no join."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label", "embedding")
    leveled = scale.once(rows, raw=level(255), raw_k=level(1000)).drop("embedding")
    return _painted(leveled.select("image_id", "label", "raw", *_box_columns("raw_k")), ["rules"])


def expected(spark: SparkSession, sf: str) -> DataFrame:
    """conversations → what each face must say (one face per turn)."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS face_id",
        "concat(role, ' ', conv_id) AS name",
        "concat('Turn — ', turn) AS type_line",
        "text AS oracle_text",
        "CASE turn % 4 WHEN 0 THEN '{2}{G}' WHEN 1 THEN '{G/W}{U}' WHEN 2 THEN '' ELSE '{1}{1}' END AS mana_cost",
        "CASE WHEN turn % 3 = 0 THEN cast(turn AS string) END AS power",
        "CASE WHEN turn % 3 = 0 THEN '1+*' END AS toughness",
        "CASE WHEN turn % 3 = 1 THEN '4' END AS loyalty",
    )


def read_back(spark: SparkSession, sf: str) -> DataFrame:
    """conversations → what was read on each face: has_title, cost_printed, patches ARRAY<STRUCT<where, text>>."""
    base = table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS face_id", "conv_id AS c", "turn", "role", "split(text, '\\n') AS rows",
        "CASE turn % 4 WHEN 0 THEN '{2}{G}' WHEN 1 THEN '{W/G}{U}' WHEN 2 THEN '' ELSE '{11}' END AS seen",
    )

    def patch(where: str, text: str) -> str:
        return f"array(named_struct('where', cast({where} AS string), 'text', {text}))"

    none = "cast(array() AS array<struct<where:string,text:string>>)"
    return base.selectExpr(
        "face_id",
        "c % 9 <> 0 AS has_title",
        "CASE WHEN c % 17 = 0 THEN '{?}' WHEN c % 6 = 0 THEN '' ELSE seen END AS cost_printed",
        f"""concat(
            {patch("'title_plate'", "CASE WHEN c % 3 = 0 THEN upper(concat(role, ' ', c)) ELSE concat(role, ' ', c) END")},
            CASE WHEN c % 11 = 0 THEN {none} ELSE {patch("'type_strip'", "concat('turn  - ', turn)")} END,
            transform(CASE WHEN c % 5 = 0 THEN slice(rows, 1, size(rows) - 1) ELSE rows END,
                      r -> named_struct('where', cast('rules_panel' AS string), 'text', r)),
            CASE WHEN turn % 4 = 2 THEN {none} WHEN c % 13 = 0 THEN concat({patch("'cost'", "seen")}, {patch("'cost'", "seen")})
                 ELSE {patch("'cost'", "seen")} END,
            CASE WHEN turn % 3 = 0 THEN {patch("'tab'", "concat(turn, '/1+*')")}
                 WHEN turn % 3 = 1 THEN {patch("'tab'", "'5'")}
                 WHEN c % 4 = 0 THEN {patch("'tab'", "'1/1'")} ELSE {none} END,
            CASE WHEN c % 7 = 0 THEN concat({patch("NULL", "'™ 2024'")}, {patch("'artwork'", "'runes'")},
                 {patch("'edge'", "'  '")}, {patch("'edge'", "'No. 7'")}) ELSE {none} END
        ) AS patches""",
    )
