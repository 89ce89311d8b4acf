"""The derived views again, as DuckDB SQL, so that each query can be checked against plain SQL."""

VIEWS: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def _view(name: str, sql: str, needs: list[str] = ()) -> None:
    VIEWS[name] = sql
    NEEDS[name] = list(needs)


_view(
    "v_card",
    """
SELECT k, lpad(CAST(k AS VARCHAR), 12, '0') AS card_id, p_size AS released, p_size, p_type, base,
  CASE WHEN k % 2 = 0 THEN base WHEN k % 10 = 5 THEN base || ' // ' || p_type || ' // Tail'
       ELSE base || ' // ' || p_type END AS name,
  CASE p_type WHEN 'LARGE' THEN 'transform' WHEN 'STANDARD' THEN 'modal_dfc' WHEN 'MEDIUM' THEN 'split'
       WHEN 'PROMO' THEN 'art_series' ELSE 'normal' END AS layout,
  CASE WHEN p_type = 'SMALL' AND p_size % 2 = 0 THEN 'Battle — Siege'
       WHEN k % 4 = 0 THEN 'Legendary Creature — Elf Warrior' WHEN k % 4 = 1 THEN 'Instant'
       WHEN k % 4 = 2 THEN 'Creature — Goblin' ELSE 'Legendary Planeswalker — Sage' END AS tl,
  CASE p_size % 6 WHEN 0 THEN '{2}{G}' WHEN 1 THEN '{G/W}{U}' WHEN 2 THEN '{X}{R}{R}'
       WHEN 3 THEN '{W/P}{1}' WHEN 4 THEN '' ELSE '{17}{T}{ZZ}' END AS cost,
  CASE k % 4 WHEN 0 THEN 'Flying, vigilance' || chr(10) || 'Whenever ' || base || ' attacks, draw. ({T}: It isn''t free.)'
       WHEN 1 THEN base || ' deals 3 damage. {ZZ}' WHEN 2 THEN 'Alliance — Gain 1 life.' || chr(10) || chr(10) || 'Trample'
       ELSE '+1: Draw a card.' END AS rules,
  CASE brand % 6 WHEN 0 THEN [] WHEN 1 THEN ['W'] WHEN 2 THEN ['U'] WHEN 3 THEN ['B'] WHEN 4 THEN ['R'] ELSE ['G'] END
    AS first_colour,
  list_concat(
    CASE brand % 6 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['W'] WHEN 2 THEN ['U'] WHEN 3 THEN ['B'] WHEN 4 THEN ['R'] ELSE ['G'] END,
    CASE WHEN k % 5 <> 0 OR brand % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN brand % 6 = 1 THEN ['U'] WHEN brand % 6 = 2 THEN ['B']
         WHEN brand % 6 = 3 THEN ['R'] WHEN brand % 6 = 4 THEN ['G'] ELSE ['W'] END) AS identity,
  p_type IN ('LARGE', 'STANDARD') AS two,
  k % 4 = 0 AS crossover
FROM (SELECT p_partkey AS k, p_size, p_type, p_name || ' ' || (p_partkey % 10) AS base,
             CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand FROM part)
""",
)

_view(
    "v_face",
    """
SELECT c.k, c.card_id, c.released, c.name AS display_name, c.layout, c.identity, c.crossover, c.two, pos AS face_position,
  CASE pos WHEN 'SINGLE' THEN c.name WHEN 'FRONT' THEN base ELSE p_type END AS name,
  CASE WHEN pos IN ('SINGLE', 'FRONT') THEN cost
       WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN '' ELSE '{9}' END
       WHEN k % 3 = 1 THEN NULL ELSE '' END AS mana_cost,
  CASE WHEN pos = 'SINGLE' THEN tl WHEN pos = 'FRONT' THEN CASE WHEN k % 5 = 0 THEN tl || ' // Land' ELSE tl END
       ELSE 'Land' END AS type_line,
  CASE WHEN pos IN ('SINGLE', 'FRONT') THEN rules ELSE '' END AS oracle_text,
  CASE WHEN pos = 'BACK' AND k % 2 = 1 THEN 'Back ' || k WHEN k % 6 = 0 THEN 'Flavour ' || k ELSE '' END AS flavor_text,
  CASE WHEN pos = 'SINGLE' THEN CASE WHEN k % 2 = 0 THEN '2' END
       WHEN pos = 'FRONT' AND k % 2 = 0 THEN '1' WHEN k % 11 = 0 THEN '7' END AS power,
  CASE WHEN pos = 'SINGLE' AND k % 2 = 0 THEN '3' END AS toughness,
  CASE WHEN pos = 'SINGLE' AND k % 4 = 3 THEN '3' END AS loyalty,
  CASE WHEN pos = 'BACK' THEN CAST([] AS VARCHAR[]) ELSE first_colour END AS colors,
  CASE WHEN pos = 'FRONT' AND k % 2 = 1 THEN 'art/' || k || '/front'
       WHEN k % 3 <> 0 THEN 'art/' || k END AS art_crop,
  CASE WHEN pos = 'SINGLE' AND layout = 'split' THEN 2 END AS n_parts
FROM (SELECT *, unnest(CASE WHEN two THEN ['FRONT', 'BACK'] ELSE ['SINGLE'] END) AS pos FROM v_card) c
""",
    ["v_card"],
)

_view(
    "v_request",
    """
SELECT l_orderkey AS list_id, line, part, supp,
  CASE WHEN n % 13 = 0 THEN CASE WHEN n % 2 = 0 THEN '# ' || base ELSE ' Sideboard:' END
       WHEN n % 11 = 0 THEN qty || ' Unknown ' || part WHEN n % 7 = 0 THEN qty || ' ' || base || ' (SET) 12'
       WHEN n % 5 = 0 THEN qty || 'x ' || base || ' // ' || p_type WHEN n % 3 = 0 THEN upper(base)
       WHEN n % 17 = 0 THEN '  ' ELSE qty || ' ' || base END AS raw
FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp,
             CAST(l_quantity AS BIGINT) AS qty, p_name || ' ' || (l_partkey % 10) AS base, p_type,
             l_partkey + l_suppkey * 3 + l_linenumber AS n
      FROM lineitem JOIN part ON l_partkey = p_partkey)
""",
)

_view(
    "v_entry",
    """
SELECT list_id, line, part, supp,
  COALESCE(CAST(NULLIF(regexp_extract(txt, '^(?:(\\d+)\\s*[xX]?\\s+)?(.+?)(?:\\s+\\([^)]+\\).*)?$', 1), '') AS BIGINT), 1) AS quantity,
  trim(regexp_extract(txt, '^(?:(\\d+)\\s*[xX]?\\s+)?(.+?)(?:\\s+\\([^)]+\\).*)?$', 2)) AS name
FROM (SELECT *, trim(raw) AS txt FROM v_request)
WHERE txt <> '' AND NOT starts_with(txt, '#') AND NOT starts_with(txt, '//')
  AND rtrim(lower(txt), ':') NOT IN ('deck', 'sideboard', 'commander', 'companion', 'maybeboard', 'tokens')
""",
    ["v_request"],
)

_view(
    "v_alias",
    """
SELECT alias, min(card_id) AS card_id FROM (
  SELECT card_id, lower(array_to_string(string_split(name, ' // ')[1:n], ' // ')) AS alias
  FROM (SELECT card_id, name, unnest(range(1, len(string_split(name, ' // ')) + 1)) AS n FROM v_card))
GROUP BY alias
""",
    ["v_card"],
)

_view(
    "v_plan",
    """
SELECT e.*, c.card_id,
  CASE WHEN c.layout IN ('planar', 'scheme', 'vanguard', 'art_series', 'emblem', 'augment', 'host') THEN c.layout
       WHEN lower(tl) LIKE '%battle%' THEN 'battle' END AS reason,
  CASE WHEN c.two THEN 2 WHEN c.card_id IS NOT NULL THEN 1 END AS faces,
  CASE WHEN c.card_id IS NULL THEN 'unresolved'
       WHEN c.layout IN ('planar', 'scheme', 'vanguard', 'art_series', 'emblem', 'augment', 'host')
         OR lower(tl) LIKE '%battle%' THEN 'unsupported' ELSE 'entry' END AS disposition
FROM v_entry e LEFT JOIN v_alias a ON lower(e.name) = a.alias LEFT JOIN v_card c ON a.card_id = c.card_id
""",
    ["v_entry", "v_alias", "v_card"],
)

_view(
    "v_jobs",
    """
SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 3 END AS worker_pid, o_orderdate AS created,
  o_custkey % 8 + 1 AS faces
FROM orders
""",
)

_view(
    "v_results",
    """
SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN len(problems) > 0 THEN 'unsound' ELSE 'ok' END AS status
FROM (SELECT l_orderkey AS job_id, l_shipdate AS finished, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part,
  l_suppkey AS supp, 'Card ' || (l_partkey % 50) AS name, CASE WHEN l_returnflag = 'R' THEN 'engine fault' END AS error,
  CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber % 3 WHEN 0 THEN ['cost_wrong'] WHEN 1 THEN ['text_wrong', 'cost_wrong']
       ELSE ['busy'] END ELSE CAST([] AS VARCHAR[]) END AS problems,
  CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS seconds,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount + l_tax END AS title_y,
  l_quantity / 150 AS strip_height,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(0.125 AS DOUBLE) + CAST(l_partkey % 10 AS DOUBLE) / 50 END AS asked,
  CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem)
""",
)


def _scaled(top: int) -> str:
    return (
        f"SELECT vec_id, label, list_transform(embedding, lambda e: least({top}, greatest(0, CAST(floor((CAST(e AS DOUBLE) + "
        f"CAST(0.5252 AS DOUBLE)) / CAST(1.0504 AS DOUBLE) * {top} + CAST(0.5 AS DOUBLE)) AS INTEGER)))) AS raw FROM embeddings"
    )


_view("v_scaled", _scaled(255))
_view("v_scaled_k", _scaled(1000))

_view(
    "v_grid",
    """
SELECT vec_id AS image_id, label, CASE WHEN label < 5 THEN 'baseline' ELSE 'batch' END AS batch,
  pos // 8 AS y, pos % 8 AS x, raw[pos + 1] AS v
FROM (SELECT *, unnest(range(0, 64)) AS pos FROM v_scaled)
""",
    ["v_scaled"],
)

_view(
    "v_rgb",
    """
SELECT vec_id AS image_id, label, pos, raw[pos + 1] AS r, (raw[pos + 1] * 3 + 17) % 256 AS g, (raw[pos + 1] * 7 + 101) % 256 AS b
FROM (SELECT *, unnest(range(0, 64)) AS pos FROM v_scaled)
""",
    ["v_scaled"],
)

_view(
    "v_canvas",
    """
SELECT image_id, label, x, y,
  CASE WHEN kind = 3 AND corner < 8 + depth THEN 255 WHEN kind = 0 AND edge < depth THEN 4
       WHEN kind = 1 AND edge < depth THEN 240 WHEN kind = 2 AND edge < depth THEN 50 ELSE cell % 256 END AS r,
  CASE WHEN kind = 3 AND corner < 8 + depth THEN 255 WHEN kind = 0 AND edge < depth THEN 6
       WHEN kind = 1 AND edge < depth THEN 235 WHEN kind = 2 AND edge < depth THEN 53 ELSE (cell * 3 + 17) % 256 END AS g,
  CASE WHEN kind = 3 AND corner < 8 + depth THEN 255 WHEN kind = 0 AND edge < depth THEN 9
       WHEN kind = 1 AND edge < depth THEN 225 WHEN kind = 2 AND edge < depth THEN 60 ELSE (cell * 7 + 101) % 256 END AS b
FROM (SELECT image_id, label, x, y, depth, kind, raw[(y // 5) * 8 + x // 5 + 1] AS cell,
        least(x, y, 39 - x, 39 - y) AS edge, least(x, 39 - x) + least(y, 39 - y) AS corner
      FROM (SELECT vec_id AS image_id, label, raw, vec_id % 6 AS depth, vec_id % 5 AS kind, pos % 40 AS x, pos // 40 AS y
            FROM (SELECT *, unnest(range(0, 1600)) AS pos FROM v_scaled)))
""",
    ["v_scaled"],
)

# the sampled pixels of 200-pixel sheets: bands 60 lines deep, the ring, the runs and boxes of corners
_view(
    "v_sheet",
    """
SELECT image_id, use, side, o, p,
  CASE WHEN kind = 3 AND corner < 8 + depth THEN 255 WHEN kind = 0 AND edge < depth * 5 THEN 4
       WHEN kind = 1 AND edge < depth * 5 THEN 240 WHEN kind = 2 AND edge < depth * 5 THEN 50 ELSE cell END AS r,
  CASE WHEN kind = 3 AND corner < 8 + depth THEN 255 WHEN kind = 0 AND edge < depth * 5 THEN 6
       WHEN kind = 1 AND edge < depth * 5 THEN 235 WHEN kind = 2 AND edge < depth * 5 THEN 53 ELSE (cell * 3 + 17) % 256 END AS g,
  CASE WHEN kind = 3 AND corner < 8 + depth THEN 255 WHEN kind = 0 AND edge < depth * 5 THEN 9
       WHEN kind = 1 AND edge < depth * 5 THEN 225 WHEN kind = 2 AND edge < depth * 5 THEN 60 ELSE (cell * 7 + 101) % 256 END AS b
FROM (SELECT vec_id AS image_id, vec_id % 6 AS depth, vec_id % 5 AS kind, use, side, o, p, raw[(y // 25) * 8 + x // 25 + 1] AS cell,
        least(x, y, 199 - x, 199 - y) AS edge, least(x, 199 - x) + least(y, 199 - y) AS corner
      FROM v_scaled, (
        SELECT use, side, o, p, CASE side WHEN 'left' THEN o WHEN 'right' THEN 199 - o ELSE p END AS x,
               CASE side WHEN 'top' THEN o WHEN 'bottom' THEN 199 - o ELSE p END AS y
        FROM (SELECT unnest(['top', 'bottom', 'left', 'right']) AS side), (
          SELECT 'band' AS use, o, p FROM range(0, 60) t(o), range(0, 200, 5) u(p)
          UNION ALL SELECT 'ring', 2, p FROM range(0, 200, 3) u(p)
          UNION ALL SELECT 'arc', o, p FROM range(0, 10) t(o), range(0, 40, 4) u(p)
          UNION ALL SELECT 'arc', o, p FROM range(0, 10) t(o), range(160, 200, 4) u(p)
          UNION ALL SELECT 'box', o, p FROM range(0, 8) t(o), range(0, 8) u(p))
        WHERE use <> 'box' OR side IN ('top', 'bottom')
        UNION ALL SELECT 'box', 'far ' || side, o, p, p, CASE side WHEN 'top' THEN o ELSE 199 - o END
        FROM (SELECT unnest(['top', 'bottom']) AS side), range(0, 8) t(o), range(192, 200) u(p)))
""",
    ["v_scaled"],
)
KEPT = {"v_sheet"}  # read many times, so worked out once

# surface, first group, count; the raw box of group j follows views.raw_boxes
_view(
    "v_rawbox",
    """
SELECT face_id, j,
  CASE WHEN (a + d) % 7 = 0 THEN top + tall ELSE top END AS ymin, lft AS xmin,
  CASE WHEN (a + d) % 7 = 0 THEN top ELSE top + tall END AS ymax, rgt AS xmax
FROM (
  SELECT *,
    CASE WHEN j = 0 THEN a * a // 1400 WHEN j = 1 THEN 300 + a // 2 WHEN j = 2 THEN 600 + a // 2
         WHEN j < 7 THEN 400 + 60 * j + a // 4 ELSE a END AS top,
    CASE WHEN j < 2 THEN c // 8 WHEN j = 2 THEN c // 5 WHEN j < 7 THEN c // 6 ELSE c // 20 - 20 END AS tall,
    CASE WHEN j = 0 THEN b // 3 WHEN j = 1 THEN b // 2 WHEN j = 2 THEN 600 + b // 3 WHEN j < 7 THEN b // 4 ELSE b END AS lft,
    CASE WHEN j = 0 THEN 1000 - d // 3 WHEN j = 1 THEN 1000 - d // 2 WHEN j = 2 THEN 800 + d // 4
         WHEN j < 7 THEN 1000 - d // 4 ELSE b + d // 2 - 150 END AS rgt
  FROM (SELECT vec_id AS face_id, j, raw[4 * j + 1] AS a, raw[4 * j + 2] AS b, raw[4 * j + 3] AS c, raw[4 * j + 4] AS d
        FROM (SELECT *, unnest(range(0, 16)) AS j FROM v_scaled_k)))
""",
    ["v_scaled_k"],
)

# usable boxes after the clean-up a detection gets: surface name, place from the top
_view(
    "v_usable",
    """
SELECT face_id, j, CASE WHEN j = 0 THEN 'title' WHEN j = 1 THEN 'type' WHEN j = 2 THEN 'pt' WHEN j < 7 THEN 'rules'
       WHEN j < 9 THEN 'spare' ELSE 'marks' END AS surface,
  xmin / 1000 AS x0, ymin / 1000 AS y0, xmax / 1000 AS x1, ymax / 1000 AS y1
FROM v_rawbox
WHERE xmax / 1000 - xmin / 1000 >= CAST(0.02 AS DOUBLE) AND ymax / 1000 - ymin / 1000 >= CAST(0.005 AS DOUBLE)
  AND (j NOT IN (7, 8) OR face_id % 3 = 0)
""",
    ["v_rawbox"],
)

_view(
    "v_panels",
    """
SELECT f.face_id, t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1, k.x0 AS kx0, k.y0 AS ky0, k.x1 AS kx1, k.y1 AS ky1,
  -- the tab of the first look decides which marks are the tab; the enlarged corner then replaces it
  p.x0 AS qx0, p.y0 AS qy0, p.x1 AS qx1, p.y1 AS qy1,
  CASE WHEN d.face_id IS NOT NULL THEN CAST(0.56 AS DOUBLE) + d.x0 * (CAST(1.0 AS DOUBLE) - CAST(0.56 AS DOUBLE)) ELSE p.x0 END AS px0,
  CASE WHEN d.face_id IS NOT NULL THEN CAST(0.56 AS DOUBLE) + d.y0 * (CAST(1.0 AS DOUBLE) - CAST(0.56 AS DOUBLE)) ELSE p.y0 END AS py0,
  CASE WHEN d.face_id IS NOT NULL THEN CAST(0.56 AS DOUBLE) + d.x1 * (CAST(1.0 AS DOUBLE) - CAST(0.56 AS DOUBLE)) ELSE p.x1 END AS px1,
  CASE WHEN d.face_id IS NOT NULL THEN CAST(0.56 AS DOUBLE) + d.y1 * (CAST(1.0 AS DOUBLE) - CAST(0.56 AS DOUBLE)) ELSE p.y1 END AS py1,
  n.x0 AS nx0, n.y0 AS ny0, n.x1 AS nx1, n.y1 AS ny1,
  CASE WHEN f.face_id % 2 = 0 THEN '2' END AS power, CASE WHEN f.face_id % 6 = 1 THEN '3' END AS loyalty,
  f.face_id % 4 AS paragraphs, f.face_id % 8 = 3 AS overflowed, f.face_id % 11 AS tokens
FROM (SELECT DISTINCT face_id FROM v_rawbox) f
LEFT JOIN v_usable t ON t.face_id = f.face_id AND t.j = 0
LEFT JOIN v_usable k ON k.face_id = f.face_id AND k.j = 1
LEFT JOIN v_usable p ON p.face_id = f.face_id AND p.j = 2
LEFT JOIN v_usable d ON d.face_id = f.face_id AND d.j = 15 AND f.face_id % 4 = 0
LEFT JOIN v_usable n ON n.face_id = f.face_id AND n.j = 14 AND f.face_id % 5 = 0
""",
    ["v_rawbox", "v_usable"],
)

# marks left after the tab itself and the marks over the name are taken out
_view(
    "v_mark",
    """
SELECT m.face_id, m.j, m.x0, m.y0, m.x1, m.y1
FROM v_usable m JOIN v_panels p USING (face_id)
WHERE m.surface = 'marks'
  AND NOT ((m.x0 + m.x1) / 2 > CAST(0.68 AS DOUBLE) AND (m.y0 + m.y1) / 2 > CAST(0.72 AS DOUBLE)
    AND (qx0 IS NULL OR ((qx1 - qx0) * (qy1 - qy0) > 0
         AND (m.x1 - m.x0) * (m.y1 - m.y0) >= (qx1 - qx0) * (qy1 - qy0) * CAST(0.55 AS DOUBLE))))
  AND (nx0 IS NULL OR greatest(0.0, least(m.x1, nx1) - greatest(m.x0, nx0)) * greatest(0.0, least(m.y1, ny1) - greatest(m.y0, ny0))
       / ((m.x1 - m.x0) * (m.y1 - m.y0)) < 0.5)
""",
    ["v_usable", "v_panels"],
)

_view(
    "v_expected",
    """
SELECT conv_id * 1000 + turn AS face_id, conv_id AS c, turn, role || ' ' || conv_id AS name, 'Turn — ' || turn AS type_line,
  text AS oracle_text,
  CASE turn % 4 WHEN 0 THEN '{2}{G}' WHEN 1 THEN '{G/W}{U}' WHEN 2 THEN '' ELSE '{1}{1}' END AS mana_cost,
  CASE WHEN turn % 3 = 0 THEN turn || '/1+*' WHEN turn % 3 = 1 THEN '4' ELSE '' END AS tab
FROM conversations
""",
)

_view(
    "v_patch",
    """
SELECT face_id, c, turn, COALESCE(p.w, 'other') AS surface, p.t AS text, ord
FROM (SELECT face_id, c, turn, unnest(ps) AS p, unnest(range(0, len(ps))) AS ord FROM (
  SELECT conv_id * 1000 + turn AS face_id, conv_id AS c, turn,
    list_concat([{'w': 'title_plate', 't': CASE WHEN conv_id % 3 = 0 THEN upper(role || ' ' || conv_id) ELSE role || ' ' || conv_id END}],
    list_concat(CASE WHEN conv_id % 11 = 0 THEN [] ELSE [{'w': 'type_strip', 't': 'turn  - ' || turn}] END,
    list_concat(list_transform(CASE WHEN conv_id % 5 = 0 THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1]
                   ELSE string_split(text, chr(10)) END, lambda r: {'w': 'rules_panel', 't': r}),
    list_concat(CASE WHEN turn % 4 = 2 THEN [] WHEN conv_id % 13 = 0 THEN [{'w': 'cost', 't': seen}, {'w': 'cost', 't': seen}]
                   ELSE [{'w': 'cost', 't': seen}] END,
    list_concat(CASE WHEN turn % 3 = 0 THEN [{'w': 'tab', 't': turn || '/1+*'}] WHEN turn % 3 = 1 THEN [{'w': 'tab', 't': '5'}]
                   WHEN conv_id % 4 = 0 THEN [{'w': 'tab', 't': '1/1'}] ELSE [] END,
    CASE WHEN conv_id % 7 = 0 THEN [{'w': CAST(NULL AS VARCHAR), 't': '™ 2024'}, {'w': 'artwork', 't': 'runes'},
           {'w': 'edge', 't': '  '}, {'w': 'edge', 't': 'No. 7'}] ELSE [] END))))) AS ps
  FROM (SELECT *, CASE turn % 4 WHEN 0 THEN '{2}{G}' WHEN 1 THEN '{W/G}{U}' WHEN 2 THEN '' ELSE '{11}' END AS seen
        FROM conversations)))
WHERE trim(p.t) <> ''
""",
)


def with_views(body: str, *names: str) -> str:
    """The query with every view it needs, in order, as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    listed = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in KEPT else ''}({VIEWS[name].strip()})" for name in ordered)
    extra = body.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if extra.upper().startswith(opening):
            return f"{opening}{listed},\n{extra[len(opening):]}" if listed else extra
    return f"WITH {listed}\n{extra}" if listed else extra
