"""Layout, colour, structure and margin rules on both sides of their limits, on small drawn images."""

import colorsys
import struct
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckloom import constants as C
from deckloom.functions import boxes as B
from deckloom.functions import colour as K
from deckloom.functions import images as I
from deckloom.operators import audit, colours, geometry, margins, structure, surfaces
from deckloom.plans import views as V
from deckloom.sources import images, pictures

SOUND = {"title": (0.10, 0.06, 0.90, 0.12), "type": (0.10, 0.60, 0.90, 0.66), "rules": [(0.10, 0.67, 0.90, 0.90)],
         "pt": (0.80, 0.85, 0.93, 0.95), "spare": [], "marks": [], "name": None}
PANELS = ", ".join(f"{k} {B.BOX}" for k in ("title", "type", "pt", "name")) + ", " + ", ".join(
    f"{k} array<{B.BOX}>" for k in ("rules", "spare", "marks")
)


def layout(spark, power="5", paragraphs=1, **changes):
    p = {**SOUND, **changes}
    df = spark.createDataFrame([tuple(p[k] for k in ("title", "type", "pt", "name", "rules", "spare", "marks"))], PANELS)
    found = geometry.audit(F.lit(power), F.lit(paragraphs), F.lit(False))
    return [x.code for x in df.select(found.alias("p")).first().p]


@pytest.mark.parametrize("wide, bad", [(0.253, True), (0.562, False), (0.911, False)])
def test_type_width(spark, wide, bad):
    assert (layout(spark, type=(0.02, 0.60, 0.02 + wide, 0.66)) == ["type_too_narrow"]) == bad


@pytest.mark.parametrize("wide, bad", [(0.517, True), (0.681, False), (0.880, False)])
def test_title_width(spark, wide, bad):
    assert (layout(spark, title=(0.02, 0.06, 0.02 + wide, 0.12)) == ["title_too_narrow"]) == bad


def test_layout_rules(spark):
    assert layout(spark) == []
    assert layout(spark, title=None) == ["missing_title"]
    assert layout(spark, pt=None) == ["missing_pt"]
    assert layout(spark, power=None) == ["blank_surface"]
    assert layout(spark, rules=[]) == ["missing_rules"]
    assert layout(spark, spare=[(0.1, 0.5, 0.9, 0.55)]) == ["blank_surface"]
    assert layout(spark, rules=SOUND["rules"] * 2) == ["blank_surface"]
    assert layout(spark, rules=SOUND["rules"] * 2, paragraphs=2) == []
    assert layout(spark, marks=[(0.85, 0.61, 0.89, 0.65)]) == ["painted_marks"]
    assert layout(spark, marks=[(0.4, 0.3, 0.5, 0.4)]) == []
    assert layout(spark, marks=[(0.2, 0.3, 0.6, 0.33)]) == ["painted_marks"]
    assert layout(spark, title=(0.10, 0.30, 0.90, 0.36)) == ["title_out_of_order"]


def image(spark, width, height, paint, **more):
    pixels = [paint(i % width, i // width) for i in range(width * height)]
    r, g, b = ([p[c] for p in pixels] for c in range(3))
    row = (1, width, height, r, g, b, *more.values())
    return spark.createDataFrame([row], "image_id int, width int, height int, r array<int>, g array<int>, b array<int>"
                                 + "".join(f", {k} array<string>" for k in more))


@pytest.mark.parametrize(
    "rgb, identity, bad",
    [
        ((40, 190, 70), ["G"], False), ((40, 90, 210), ["R"], True), ((150, 60, 200), ["G"], True),
        ((150, 60, 200), ["B"], False), ((190, 188, 182), [], False), ((190, 188, 182), ["W"], False),
    ],
)
def test_flat_colours(spark, rgb, identity, bad):
    df = image(spark, 8, 8, lambda x, y: rgb, identity=identity)
    found = colours.profile(df, ["identity"]).select(colours.identity_problem(F.col("identity")).alias("p")).first().p
    assert bool(found) == bad


def test_own_share(spark):
    def paint(x, y):
        return (40, 190, 70) if x < 44 else (40, 90, 210) if x < 84 else (150, 60, 200)

    df = image(spark, 100, 1, paint, identity=["B"])
    found = colours.profile(df, ["identity"]).select(colours.identity_problem(F.col("identity")).alias("p")).first().p
    assert [p.detail for p in found] == ["own colour only 0.16"]


def test_hue_limits(spark):
    degrees = spark.createDataFrame([(d,) for d in (0.0, 24.99, 25.0, 44.9, 45.0, 70.0, 170.0, 200.0, 255.0, 300.0, 344.9, 345.0)], "d double")
    got = [r[0] for r in degrees.select(K.hue_bucket(F.col("d"))).collect()]
    assert got == ["red", "red", "orange", "orange", "yellow", "green", "cyan", "blue", "purple", "magenta", "magenta", "red"]


STORED = "image_id int, image struct<width: int, height: int, nChannels: int, data: binary>"


def stored(spark, *pictures):
    """Pictures (red, green, blue on the last axis) as the image source stores them."""
    rows = [(i, None if p is None else (p.shape[1], p.shape[0], 3, p[:, :, ::-1].astype(np.uint8).tobytes())) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, STORED)


def drawn(width, height, paint):
    return np.array([[paint(x, y) for x in range(width)] for y in range(height)])


def depth(spark, side, paint):
    row = margins.trim_rectangle(stored(spark, drawn(side, side, paint)), "image", ["image_id"]).first()
    return row.top, row.bottom, row.left, row.right


def scene(x, y):
    return ((x * 37 + y * 11) % 180 + 40, (x * 17 + y * 53) % 180 + 40, (x * 7 + y * 29) % 180 + 40)


def edge(side, x, y):
    return min(x, y, side - 1 - x, side - 1 - y)


@pytest.mark.parametrize(
    "margin, colour, cut",
    [
        (4, (244, 239, 227), 4),  # a cream mat goes
        (4, (50, 53, 60), 4),  # so does a flat dark one
        (4, (1, 1, 1), 4),  # and a black void
        (14, (244, 239, 227), 0),  # past the ceiling it is the picture
        (0, (0, 0, 0), 0),
    ],
)
def test_margins(spark, margin, colour, cut):
    got = depth(spark, 80, lambda x, y: colour if edge(80, x, y) < margin else scene(x, y))
    assert got == (cut,) * 4


def test_three_sides_are_no_mat(spark):
    def paint(x, y):
        return (244, 239, 227) if min(x, y, 79 - x) < 4 else scene(x, y)

    assert depth(spark, 80, paint) == (0, 0, 0, 0)


def brute_corner(side, paint):
    def light(x, y):
        return min(paint(x, y)) > 242

    limit, reach, depths = int(side * 0.05), int(side * 0.2), []
    for p in [*range(0, reach, 4), *range(side - reach, side, 4)]:
        for at in (lambda o: (p, o), lambda o: (p, side - 1 - o), lambda o: (o, p), lambda o: (side - 1 - o, p)):
            depths.append(next((o for o in range(limit) if not light(*at(o))), limit))
    deepest = sorted(depths)[int(len(depths) * 0.98)]
    return 0 if deepest >= limit else deepest


@pytest.mark.parametrize("radius, corners", [(16, 4), (16, 3), (40, 4)])
def test_rounded_card_on_white(spark, radius, corners):
    side = 400

    def paint(x, y):
        cx, cy = min(x, side - 1 - x), min(y, side - 1 - y)
        outside = cx < radius and cy < radius and (radius - cx) ** 2 + (radius - cy) ** 2 > radius**2
        return (255, 255, 255) if outside and (corners == 4 or x < side // 2 or y < side // 2) else scene(x, y)

    want = brute_corner(side, paint) if corners == 4 else 0
    assert (want > 0) == (radius == 16 and corners == 4)
    assert depth(spark, side, paint) == (want,) * 4


def grey(spark, width, height, paint):
    px = [paint(i % width, i // width) for i in range(width * height)]
    return spark.createDataFrame([(1, "b", width, height, px)], "image_id int, batch string, width int, height int, px array<int>")


def test_structure_sees_plates_and_not_noise(spark):
    noise = lambda x, y: (x * 7919 + y * 104729 + x * y * 31) % 90 + 80

    def plates(x, y):
        return 250 if y % 30 < 10 else noise(x, y)

    def measured(paint):
        return structure.measure(grey(spark, 60, 90, paint), ["image_id"]).first()

    assert measured(noise).ruled_rows == 0
    assert measured(plates).ruled_rows >= 5 and measured(plates).widest_edge > 0.62
    flat = measured(lambda x, y: 0 if edge(60, x, min(y, 59)) < 8 or y > 80 else noise(x, y))
    assert flat.band_structure < 1.0


def test_components_and_badge(spark):
    def paint(x, y):
        return 200 if (x in range(54, 58) and y in range(2, 10)) or (x == 5 and y == 5) or (x == 6 and y == 6) else 90

    parts = surfaces.components(grey(spark, 60, 12, paint), ["image_id"])
    boxes = sorted((c.mass, c.x0, c.y0, c.x1, c.y1) for c in parts.first().islands)
    assert boxes == [(1, 5, 5, 6, 6), (1, 6, 6, 7, 7), (32, 54, 2, 58, 10)]
    assert [p.code for p in parts.select(surfaces.badge_problem().alias("p")).first().p] == ["painted_marks"]
    small = surfaces.components(grey(spark, 20, 12, paint), ["image_id"])
    assert small.select(surfaces.badge_problem().alias("p")).first().p == []


def test_contrast_gate(spark):
    for level, bad in ((200, False), (90, True)):
        df = image(spark, 40, 40, lambda x, y: (level,) * 3).withColumn("rules", F.array(B.box(*[F.lit(v) for v in (0.1, 0.5, 0.9, 0.9)])))
        strips = surfaces.strips(df, ["image_id"])
        assert bool(strips.select(surfaces.contrast_problem().alias("p")).first().p) == bad


def test_audit_order(spark):
    one = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit("").alias("detail")))
    sets = {n: one(n) for n in ("layout", "collision", "colour", "matte", "contrast", "cover", "badge", "text", "title_text")}
    modes = spark.createDataFrame([(m, b, s) for m in audit.ORDER for b in (True, False) for s in (True, False)], "m string, b boolean, s boolean")
    for r in modes.withColumn("p", audit.by_mode(F.col("m"), F.col("b"), F.col("s"), sets)).collect():
        want = [n for n in audit.ORDER[r.m] if (n != "matte" or r.b) and not (n == "collision" and r.m == "lettered" and not r.s)]
        assert [p.code for p in r.p] == want


def png(path, width, height, paint):
    raw = b"".join(b"\x00" + bytes(v for x in range(width) for v in paint(x, y)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_from_files(spark, tmp_path):
    (tmp_path / "deck").mkdir()
    paint = lambda x, y: (x * 10, y * 20, 7)
    for name in ("deck/a.png", "deck/a-blank.png", "sheet.png", "b.png"):
        png(tmp_path / name, 5, 3, paint)
    rows = images.read_images(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["a.png", "b.png"]
    assert rows[0].width == 5 and rows[0].height == 3
    assert rows[0].r == [x * 10 for _ in range(3) for x in range(5)] and rows[0].g == [y * 20 for y in range(3) for _ in range(5)]
    assert set(rows[0].b) == {7}


def test_parts_match_a_flood_over_pixels():
    """Runs merged by search against a plain walk, on dense, sparse, striped and empty masks."""
    rng = np.random.default_rng(3)
    masks = [rng.random((h, w)) < p for h, w, p in ((1, 1, 1), (1, 30, 0.5), (30, 1, 0.5), (40, 50, 0.6), (40, 50, 0.1), (20, 20, 0))]
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k:21 - k] = spiral[20 - k, k:21 - k] = spiral[k:21 - k, k] = spiral[k:21 - k, 20 - k] = True
        spiral[k + 1, k] = False
    for mask in [*masks, spiral]:
        left, wanted = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
        while left:
            todo, part = [min(left)], []
            left.discard(todo[0])
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if near in left:
                        left.discard(near)
                        todo.append(near)
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            wanted.append({"mass": len(part), "x0": min(xs), "y0": min(ys), "x1": max(xs) + 1, "y1": max(ys) + 1})
        assert surfaces.parts_of(mask) == wanted


def test_kernels_hold_at_the_published_size():
    """1792 x 2400 in well under the half second a core that scoring may take, and right on a drawn line."""
    grid = np.full((2400, 1792), 40, np.uint8)
    grid[1200] = 240
    began = time.perf_counter()
    rows, widest, band, inside = structure.image_metrics(grid, 3.0, 0.5, 0.02, 0.06)
    energy, ratio = surfaces.edge_strength(grid, 2 / 3, 1.0)
    assert time.perf_counter() - began < 5  # a loaded machine; about a tenth of a second is usual
    assert (rows, widest, band) == (2, 1.0, 0.0) and inside > 0
    assert (energy, ratio) == (0.0, 0.0)


def test_stored_and_decoded_images_measure_alike(spark):
    """Bytes in one step against channels, grey, metrics; an undecodable image keeps its row with nulls."""
    raw = np.random.default_rng(5).integers(0, 256, (12, 10, 3), dtype=np.uint8)
    rows = [(1, (10, 12, 3, bytearray(raw.tobytes()))), (2, (-1, -1, -1, None))]
    stored = spark.createDataFrame(rows, "image_id long, image struct<width:int,height:int,nChannels:int,data:binary>")
    direct = {r.image_id: r for r in structure.measure_stored(stored, "image", ["image_id"], 1.0, 0.25, 0.25, 0.25).collect()}
    decoded = images.decode(stored.where("image_id = 1"), "image", ["image_id"])
    grey = decoded.select("image_id", "width", "height", I.grey(F.col("r"), F.col("g"), F.col("b")).alias("px"))
    assert direct[1] == structure.measure(grey, ["image_id"], 1.0, 0.25, 0.25, 0.25).first()
    assert direct[2].ruled_rows is None and direct[2].interior_energy is None


def plain_margins(picture):
    """Margins of one picture, pixel by pixel: black depths, matted share, mat depths, corner."""
    height, width = picture.shape[:2]
    short = min(height, width)
    at = {
        "top": (lambda o, p: picture[o, p], width), "bottom": (lambda o, p: picture[height - 1 - o, p], width),
        "left": (lambda o, p: picture[p, o], height), "right": (lambda o, p: picture[p, width - 1 - o], height),
    }

    def walk(side, limit, step, match):
        get, across = at[side]
        for o in range(limit):
            line = [match(get(o, p)) for p in range(0, across, step)]
            if sum(line) / len(line) < 0.9:
                return o
        return limit

    def median(values):
        values, n = sorted(values), len(values)
        return (values[(n - 1) // 2] + values[n // 2]) / 2

    def deviation(pixels):
        return max(median([abs(v - median(c)) for v in c]) for c in zip(*pixels))

    ring = [tuple(map(int, at[s][0](int(short * 0.012), p))) for s in at for p in range(0, at[s][1], max(1, width // 60))]
    light = [p for p in ring if min(p) > 185]
    is_light = len(light) >= 0.55 * len(ring)
    colour = tuple(sorted(c)[len(c) // 2] for c in zip(*(light if is_light else ring)))
    near = lambda p: all(abs(int(a) - b) <= 26 for a, b in zip(p, colour))
    same = [p for p in ring if near(p)]
    if is_light:
        share = 0.0 if deviation(light) > 4 else len(same) / len(ring)
    elif max(colour) > 32 and len(same) >= 0.98 * len(ring) and deviation(same) <= 2:
        share = len(same) / len(ring)
    else:
        share = len(light) / len(ring)
    black = [walk(s, int(short * 0.3), max(1, width // 40), lambda p: max(p) <= 32) for s in at]
    mats = [walk(s, int(short * 0.1), max(1, at[s][1] // 40), near) for s in at]
    boxes = [picture[y : y + 8, x : x + 8].min(axis=2) > 242 for x in (0, width - 8) for y in (0, height - 8)]
    limit, reach, runs = int(short * 0.05), int(short * 0.2), []
    for s, (get, across) in at.items():
        for p in [*range(0, reach, 4), *range(across - reach, across, 4)]:
            runs.append(next((o for o in range(limit) if min(get(o, p)) <= 242), limit))
    deepest = sorted(runs)[int(len(runs) * 0.98)]
    corner = deepest if all(b.sum() > 32 for b in boxes) and deepest < limit else 0
    return [*black, share, *mats, corner]


def framed(width, height, depth, colour, seed):
    rng = np.random.default_rng(seed)
    picture = rng.integers(0, 256, (height, width, 3))
    y, x = np.mgrid[:height, :width]
    edge = np.minimum.reduce([x, y, width - 1 - x, height - 1 - y])
    picture[edge < depth] = np.clip(np.array(colour) + rng.integers(-2, 3, ((edge < depth).sum(), 3)), 0, 255)
    return picture


def test_margins_equal_a_walk_over_pixels(spark):
    pictures = [
        framed(w, h, d, colour, i)
        for i, (w, h, d, colour) in enumerate([
            (120, 200, 0, (0, 0, 0)), (120, 200, 5, (244, 239, 227)), (200, 120, 9, (3, 4, 5)), (90, 90, 30, (10, 9, 8)),
            (161, 203, 7, (60, 90, 120)), (240, 180, 11, (254, 254, 254)), (64, 64, 6, (190, 200, 210)), (40, 300, 3, (30, 31, 33)),
        ])
    ]
    white = framed(400, 400, 0, (0, 0, 0), 9)
    y, x = np.mgrid[:400, :400]
    white[np.minimum(x, 399 - x) + np.minimum(y, 399 - y) < 12] = 255
    pictures.append(white)
    got = margins.measure_margins(stored(spark, *pictures), "image", ["image_id"]).orderBy("image_id").collect()
    names = [c for part in margins.PARTS.values() for c in part]
    for row, picture in zip(got, pictures):
        assert [row[c] for c in names] == plain_margins(picture)
    assert got[-1].corner > 0


def test_pictures_without_pixels_have_no_margins(spark):
    empty = spark.createDataFrame([(0, None), (1, (-1, -1, -1, bytearray()))], STORED)
    rows = margins.trim_rectangle(empty, "image", ["image_id"]).collect()
    assert all(r.top is None and r.depth is None for r in rows) and len(rows) == 2
    assert margins.trim_rectangle(empty.limit(0), "image", ["image_id"]).collect() == []


def test_tiny_and_grey_pictures(spark):
    grey = spark.createDataFrame([(0, (1, 1, 1, bytearray([250]))), (1, (3, 2, 1, bytearray(6)))], STORED)
    rows = margins.measure_margins(grey, "image", ["image_id"]).collect()
    assert [r.matted for r in rows] == [1.0, 0.0]


def test_published_size_is_quick_and_small():
    picture = np.ascontiguousarray(framed(1792, 2400, 40, (244, 239, 227), 1).astype(np.uint8))
    parts = tuple(margins.PARTS)
    margins.image_margins(picture, parts)
    tracemalloc.start()
    began = time.perf_counter()
    found = margins.image_margins(picture, parts)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:4] == [0, 0, 0, 0] and found[5:9] == [40, 40, 40, 40]
    assert took < 0.5 and most < 8_000_000


def test_sheets_reach_every_branch_of_the_trim(spark, sf):
    rows = margins.measure_margins(V.sheets(spark, sf), "image", ["image_id"]).collect()
    assert {r.corner for r in rows} == {0, 8, 9}
    assert any(min(r[c] for c in margins.BLACKS) >= 2 for r in rows) and any(r.matted >= 0.55 for r in rows)


def plain_bucket(r, g, b):
    """The bucket of one colour by the standard library, or None."""
    hue, saturation, value = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
    if saturation <= 0.3 or value <= 0.25:
        return None
    degrees = hue * 360
    for name, low, high, _ in C.HUE_BUCKETS:
        if low <= degrees < high or (low > high and (degrees >= low or degrees < high)):
            return name


def test_every_hue_is_counted_as_by_the_standard_library(spark):
    rng = np.random.default_rng(3)
    some = np.concatenate([rng.integers(0, 256, (4000, 3)), [[0, 0, 0], [255, 255, 255], [255, 0, 0], [0, 255, 255], [77, 54, 54]]])
    names = [plain_bucket(*map(int, p)) for p in some]
    want = [len(some), sum(n is not None for n in names), *(names.count(b) for b in colours.BUCKETS)]
    assert colours.counts_of(*some.T) == want
    arrays = spark.createDataFrame([(1, *some.T.tolist()), (2, None, None, None), (3, [], [], [])], "image_id int, r array<int>, g array<int>, b array<int>")
    got = [list(r)[1:] for r in colours.profile(arrays).orderBy("image_id").collect()]
    assert got == [want, [None] * 10, [0] * 10]
    files = stored(spark, some[None], None)
    assert [list(r)[1:] for r in colours.profile_stored(files, "image", ["image_id"]).orderBy("image_id").collect()] == [want, [None] * 10]
    shown = colours.profile(arrays).select("image_id", colours.saturated_share().alias("s"), colours.identity_problem(F.array(F.lit("G"))).alias("p"))
    assert [r.s is None for r in shown.orderBy("image_id").collect()] == [False, True, True]
    plan = colours.profile(arrays)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_the_table_of_colours_is_the_same_count():
    rng = np.random.default_rng(4)
    pixels = rng.integers(0, 256, (colours.LOOKED_UP + 5, 3), dtype=np.uint8)
    looked_up = colours.counts_of(*pixels.T)
    parts = [colours.counts_of(*part.T) for part in np.array_split(pixels, 3)]
    assert looked_up == [sum(c) for c in zip(*parts)]
    picture = rng.integers(0, 256, (2400 * 1792, 3), dtype=np.uint8)
    began = time.perf_counter()
    colours.counts_of(*picture.T)
    assert time.perf_counter() - began < 1


def test_rule_sets_are_asked_for_by_mode(spark):
    modes = [audit.ART_ONLY, audit.COMPOSITED, audit.LETTERED, audit.NAME_ONLY]
    rows = [(i, m, b, s) for i, (m, b, s) in enumerate((m, b, s) for m in modes for b in (True, False) for s in (True, False))]
    df = spark.createDataFrame(rows, "face int, mode string, borderless boolean, stamped boolean")
    names = sorted({n for listed in audit.ORDER.values() for n in listed})
    one = F.array(F.struct(F.lit("x").alias("code"), F.lit("").alias("detail")))
    for name in names:  # a set that is not needed adds nothing, one that is needed does
        sets = {n: (one if n == name else F.lit(None).cast(audit.PROBLEMS)) for n in names}
        k = F.col("mode"), F.col("borderless"), F.col("stamped")
        got = df.select(audit.needed(name, *k).alias("n"), F.size(audit.by_mode(*k, sets)).alias("p")).collect()
        assert all(r.n == (r.p == 1) for r in got), name


def test_problems_meet_in_one_shuffle(spark):
    faces = spark.createDataFrame([(1,), (2,), (3,)], "face_id long")
    found = [
        spark.createDataFrame([(1, [("a", "")]), (9, [("b", "")])], f"face_id long, colour {audit.PROBLEMS}"),
        spark.createDataFrame([(1, None, [("c", "")]), (2, [], None)], f"face_id long, matte {audit.PROBLEMS}, text {audit.PROBLEMS}"),
    ]
    joined = audit.gather(faces, "face_id", found)
    got = {r.face_id: [None if x is None else [p.code for p in x] for x in (r.colour, r.matte, r.text)] for r in joined.collect()}
    assert got == {1: [["a"], None, ["c"]], 2: [None, [], None], 3: [None, None, None]}
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") <= 1


def files_below(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_picture_files_are_written_once_whatever_fails(spark, tmp_path):
    spark.dataSource.register(pictures.PictureFiles)
    rng = np.random.default_rng(5)
    drawn_ = {f"card-{i}.png": rng.integers(0, 256, (3 + i, 5, 3)) for i in range(6)}
    rows = spark.createDataFrame([(n, pictures.png_bytes(p.astype(np.uint8))) for n, p in drawn_.items()], "name string, data binary").repartition(3)
    path = tmp_path / "shelf"

    def save(df, batch, to=str(path)):
        df.write.format("picture_files").mode("append").option("batch", batch).save(to)

    @F.pandas_udf("string")
    def torn(name):
        if (name == "card-4.png").any():
            raise RuntimeError("lost")
        return name

    with pytest.raises(Exception, match="lost"):
        save(rows.withColumn("name", torn("name")), "1")
    assert files_below(path) == []
    for _ in range(2):  # a repeated batch replaces itself
        save(rows, "1")
        names = [f.split("/")[-1] for f in files_below(path)]
        assert sorted(names) == sorted(drawn_) and all(f.startswith("batch=1/task=") for f in files_below(path))
    save(rows.limit(1).withColumn("name", F.lit("other.png")), "2", path.as_uri())
    assert len(files_below(path)) == 7
    save(rows.limit(0), "2")
    assert len(files_below(path)) == 6
    with pytest.raises(Exception, match="append"):
        rows.write.format("picture_files").mode("overwrite").save(str(path))
    (path / "batch=1" / "torn.png").write_bytes(pictures.PNG + b"no more")
    read = {r.path.rsplit("/", 1)[-1]: r for r in images.read_images(spark, str(path)).collect()}
    assert read.pop("torn.png").error == "cannot be decoded"
    for name, picture in drawn_.items():
        got = read[name]
        assert (got.width, got.height, got.error) == (5, picture.shape[0], None)
        assert [got.r, got.g, got.b] == [picture[:, :, c].ravel().tolist() for c in range(3)]


def test_sheets_leave_a_task_in_bounded_batches(spark):
    import pyarrow as pa

    from deckloom.plans import views as V

    cells = pa.array([[k % 256] * 64 for k in range(500)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([0] * 500, pa.int32()), cells], names=["image_id", "label", "raw"])
    out = list(V._sheet_bytes(iter([batch])))
    assert sum(b.num_rows for b in out) == 500 and [k for b in out for k in b.column("image_id").to_pylist()] == list(range(500))
    assert max(b.column("data").nbytes for b in out) <= (4 << 20) + 4096


def test_whole_images_reach_python_in_batches_of_few_megabytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    images = spark.range(0, 60, 1, 1).select(F.expr("cast(repeat('x', 500000) AS binary)").alias("data"))
    counts = [r.n for r in images.mapInArrow(sizes, "n long").collect()]
    assert sum(counts) == 60 and max(counts) <= 18
