"""SQL of the queries' results for an engine with standard SQL, lists and recursive queries.

Written apart from the Spark expressions: joins and recursion take the place of windows, folds
and labelling where that gives another way to the same rows.
"""

from __future__ import annotations

from vellumspark.functions.letters import CATEGORIES, GUIDES, LETTERS, PANGRAMS, PUNCTUATION

LEVELS = """levels AS (SELECT vec_id, i - 1 AS i, CAST(floor(255.0 * (CAST(e[i] AS DOUBLE) - lo) / (hi - lo) + 0.5) AS INTEGER) AS g
 FROM (SELECT vec_id, embedding AS e, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, unnest(range(1, 65)) AS i FROM embeddings))"""
SMALL = f"{LEVELS}, px AS (SELECT vec_id AS image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, g FROM levels)"
SHEETS = f"{LEVELS}, px AS (SELECT vec_id // 64 AS image_id, CAST(i AS INTEGER) AS x, CAST(vec_id % 64 AS INTEGER) AS y, g FROM levels)"
INK = f"{SMALL}, ink AS (SELECT image_id, x, y, CASE WHEN g < 110 THEN 255 ELSE 0 END AS ink FROM px)"


def box(source: str, value: str, radius: int, name: str) -> str:
    """A CTE with the sum and count of every pixel's clipped square frame, by a join on neighbours."""
    return f"""{name} AS (SELECT a.image_id, a.x, a.y, a.{value} AS v, sum(b.s) AS s, sum(b.n) AS n FROM {source} AS a
 JOIN (SELECT c.image_id, c.x, c.y, sum(d.{value}) AS s, count(*) AS n FROM {source} AS c JOIN {source} AS d ON c.image_id = d.image_id AND c.y = d.y AND d.x BETWEEN c.x - {radius} AND c.x + {radius} GROUP BY ALL) AS b
 ON a.image_id = b.image_id AND a.x = b.x AND b.y BETWEEN a.y - {radius} AND a.y + {radius} GROUP BY ALL)"""


def morph(source: str, name: str, how: str, radius: int = 1) -> str:
    full = (2 * radius + 1) ** 2
    value = "max(b.ink)" if how == "max" else f"CASE WHEN count(*) = {full} THEN min(b.ink) ELSE 0 END"
    return f"""{name} AS (SELECT a.image_id, a.x, a.y, {value} AS ink FROM {source} AS a JOIN {source} AS b
 ON a.image_id = b.image_id AND abs(a.x - b.x) <= {radius} AND abs(a.y - b.y) <= {radius} GROUP BY a.image_id, a.x, a.y)"""


def components(source: str, width: int) -> str:
    """CTEs ``lab`` (image_id, x, y, label) of the ink of ``source``: labels spread until every pixel has its component's least place."""
    return f"""dark AS (SELECT image_id, x, y FROM {source} WHERE ink = 255),
spread AS (SELECT image_id, x, y, y * {width} + x AS l FROM dark UNION
 SELECT d.image_id, d.x, d.y, s.l FROM spread AS s JOIN dark AS d ON d.image_id = s.image_id AND abs(d.x - s.x) <= 1 AND abs(d.y - s.y) <= 1),
root AS (SELECT image_id, x, y, min(l) AS root FROM spread GROUP BY image_id, x, y),
lab AS (SELECT image_id, x, y, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS INTEGER) AS label FROM root)"""


STATS = """stats AS (SELECT image_id, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM lab GROUP BY image_id, label)"""

OTSU = """h AS (SELECT image_id, g, count(*) AS n FROM px GROUP BY image_id, g),
c AS (SELECT a.image_id, a.g, sum(b.n) AS wb, sum(b.n * b.g) AS sb FROM h AS a JOIN h AS b ON a.image_id = b.image_id AND b.g <= a.g GROUP BY a.image_id, a.g),
t AS (SELECT image_id, sum(n) AS n, sum(n * g) AS s FROM h GROUP BY image_id),
v AS (SELECT c.image_id, c.g, CAST(wb AS DOUBLE) * (n - wb) * (CAST(sb AS DOUBLE) / wb - CAST(s - sb AS DOUBLE) / (n - wb)) * (CAST(sb AS DOUBLE) / wb - CAST(s - sb AS DOUBLE) / (n - wb)) AS v FROM c JOIN t ON c.image_id = t.image_id WHERE wb < n),
best AS (SELECT image_id, g, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, g) AS k FROM v WHERE v > 0),
otsu AS (SELECT t.image_id, CAST(coalesce(best.g, 0) AS INTEGER) AS threshold FROM t LEFT JOIN best ON t.image_id = best.image_id AND best.k = 1)"""

SYMBOLS = """ln AS (SELECT item_id, li, string_split(text, chr(10))[li + 1] AS line FROM (SELECT item_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS li FROM benchmark)),
wd AS (SELECT item_id, li, wi, string_split(line, ' ')[wi + 1] AS word FROM (SELECT item_id, li, line, unnest(range(0, len(string_split(line, ' ')))) AS wi FROM ln)),
sy AS (SELECT item_id, li, wi, ci, lower(word[ci + 1]) AS c FROM (SELECT item_id, li, wi, word, unnest(range(0, length(word))) AS ci FROM wd))"""

COMPS = """comps AS (SELECT l_partkey // 26 AS image_id, l_orderkey * 7 + l_linenumber AS label, CAST(l_orderkey % 60 AS INTEGER) AS x, CAST(l_suppkey % 40 AS INTEGER) AS y,
 1 + CAST(l_quantity AS INTEGER) % 20 AS w, CAST(1 + l_partkey % 15 AS INTEGER) AS h FROM lineitem)"""
CHARS = """chars AS (SELECT p_partkey // 26 AS image_id, substr('abcdefghijklmnopqrstuvwxyz', CAST(p_partkey % 26 AS INTEGER) + 1, 1) AS char, CAST(p_partkey % 53 AS INTEGER) AS x, CAST(p_partkey % 37 AS INTEGER) AS y,
 CAST(3 + p_size % 12 AS INTEGER) AS w, CAST(3 + p_partkey % 9 AS INTEGER) AS h FROM part)"""


def overlaps(a: str, b: str) -> str:
    side = lambda at, size: f"greatest(0, least(a.{at} + a.{size}, b.{at} + b.{size}) - greatest(a.{at}, b.{at}))"
    area = f"{side('x', 'w')} * {side('y', 'h')}"
    return f"ov AS (SELECT a.image_id, b.char, a.label, {area} AS overlap, CAST({area} AS DOUBLE) / (a.w * a.h) AS inside FROM {a} AS a JOIN {b} AS b ON a.image_id = b.image_id WHERE {area} > 0)"


MATCHED = """good AS (SELECT * FROM ov WHERE inside >= 0.3),
spare AS (SELECT image_id, char, label, row_number() OVER (PARTITION BY image_id, char ORDER BY overlap DESC, label) AS k FROM ov WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.image_id = ov.image_id AND good.char = ov.char)),
kept AS (SELECT image_id, char, label FROM good UNION ALL SELECT image_id, char, label FROM spare WHERE k = 1)"""

LETTER_ROWS = ", ".join(f"({i}, '{c}', '{name}')" for i, c in enumerate(LETTERS) for name, chars in CATEGORIES.items() if c in chars)
DRAWN = "drawn AS (SELECT user_id AS session_id, CAST(event_id % 43 AS INTEGER) AS place, event_id, value FROM events)"

#: Absolute commands of the order paths: (path_id, n, type, x, y, x1, y1, x2, y2), the close after the last line.
PATHS = """nl AS (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CAST(l_quantity AS INTEGER) AS a, CAST(l_partkey % 97 AS INTEGER) AS b FROM lineitem),
walk AS (SELECT path_id, n, 'M' AS type, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, CAST(NULL AS DOUBLE) AS x2, CAST(NULL AS DOUBLE) AS y2 FROM nl WHERE n = 1
 UNION ALL SELECT nl.path_id, nl.n, CASE nl.n WHEN 5 THEN 'Q' WHEN 6 THEN 'C' ELSE 'L' END,
  CASE nl.n WHEN 2 THEN a WHEN 3 THEN w.x + a WHEN 4 THEN w.x WHEN 5 THEN w.x + b WHEN 6 THEN b ELSE w.x - a END,
  CASE nl.n WHEN 2 THEN b WHEN 3 THEN w.y WHEN 4 THEN b WHEN 5 THEN w.y + a WHEN 6 THEN a ELSE w.y + b END,
  CASE nl.n WHEN 5 THEN w.x + a WHEN 6 THEN a END, CASE nl.n WHEN 5 THEN w.y + b WHEN 6 THEN b END,
  CASE nl.n WHEN 6 THEN a + 5 END, CASE nl.n WHEN 6 THEN b + 3 END
 FROM walk AS w JOIN nl ON nl.path_id = w.path_id AND nl.n = w.n + 1),
cmds AS (SELECT * FROM walk UNION ALL SELECT path_id, max(n) + 1, 'Z', NULL, NULL, NULL, NULL, NULL, NULL FROM walk GROUP BY path_id),
bb AS (SELECT path_id, least(min(x), min(x1), min(x2)) AS min_x, least(min(y), min(y1), min(y2)) AS min_y, greatest(max(x), max(x1), max(x2)) AS max_x, greatest(max(y), max(y1), max(y2)) AS max_y FROM cmds GROUP BY path_id)"""

#: The carrier's text, for the queries that read it as SVG.
DTEXT = """steps AS (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CAST(l_quantity AS INTEGER) AS a, CAST(l_partkey % 97 AS INTEGER) AS b FROM lineitem),
dt AS (SELECT path_id, string_agg(CASE n WHEN 1 THEN 'M' || a || ' ' || b WHEN 2 THEN 'L' || a || ',' || b WHEN 3 THEN 'h' || a WHEN 4 THEN 'V' || b WHEN 5 THEN 'q' || a || ' ' || b || ' ' || b || ' ' || a
 WHEN 6 THEN 'C' || a || ' ' || b || ' ' || (a + 5) || ' ' || (b + 3) || ' ' || b || ' ' || a ELSE 'l-' || a || ' ' || b END, '' ORDER BY n) || 'Z' AS d FROM steps GROUP BY path_id)"""


def glyphs(chars: str) -> str:
    """CTEs of the font: ``g`` (path_id, font_id, char, k, y0, rise, bearing, advance) of glyphs with a box, letter or punctuation."""
    symbols = "[" + ", ".join(f"'{c}'" for c in chars) + "]"
    marks = ", ".join(f"('{c}', CAST({s} AS DOUBLE), {o})" for c, (s, o) in PUNCTUATION.items())
    return f"""marks(mark, share, lift) AS (VALUES {marks}),
gl AS (SELECT path_id, path_id // {len(chars)} AS font_id, {symbols}[CAST(path_id % {len(chars)} AS INTEGER) + 1] AS char, min_x, min_y, max_x - min_x AS w, max_y - min_y AS h FROM bb WHERE max_x <> min_x AND max_y <> min_y),
gm AS (SELECT gl.*, share, coalesce(lift, 0) AS lift FROM gl LEFT JOIN marks ON gl.char = marks.mark)"""


def scaled(reference: str | None) -> str:
    low, high = f"(1 - CAST({GUIDES['descender']} AS DOUBLE))", f"(1 - CAST({GUIDES['ascender']} AS DOUBLE))"
    uniform = "share IS NULL" if reference else "FALSE"
    ref = reference or "1.0"
    return f"""gk AS (SELECT *, CASE WHEN {uniform} THEN 1000 / (({high} - {low}) * CAST({ref} AS DOUBLE)) WHEN share IS NOT NULL THEN 1000 * share / greatest(h, 1.0) ELSE 1000.0 / greatest(h, 1.0) END AS k,
 CASE WHEN {uniform} THEN {low} * CAST({ref} AS DOUBLE) ELSE min_y END AS y0, -200 + CASE WHEN {uniform} THEN 0 ELSE lift END AS rise FROM gm),
gs AS (SELECT *, floor(w * k + 0.5) AS sw FROM gk),
g AS (SELECT *, CAST(floor(sw * CAST(0.12 AS DOUBLE) + 0.5) AS BIGINT) AS bearing, CAST(sw + 2 * floor(sw * CAST(0.12 AS DOUBLE) + 0.5) AS BIGINT) AS advance FROM gs)"""


POINTS = """SELECT g.path_id, g.char, g.advance, g.bearing, CAST(c.n - 1 AS INTEGER) AS i, c.type, floor((c.x - g.min_x) * g.k + g.bearing + 0.5) AS x, floor((c.y - g.y0) * g.k + g.rise + 0.5) AS y
FROM g JOIN cmds AS c ON g.path_id = c.path_id"""

LIMITED = """opens AS (SELECT user_id, min(ts) AS st FROM events GROUP BY user_id UNION ALL
 SELECT o.user_id, min(e.ts) FROM opens AS o JOIN events AS e ON e.user_id = o.user_id AND e.ts >= o.st + INTERVAL 1 DAY GROUP BY o.user_id, o.st),
within AS (SELECT e.user_id, e.event_id, e.ts, max(o.st) AS st FROM events AS e JOIN opens AS o ON o.user_id = e.user_id AND o.st <= e.ts GROUP BY e.user_id, e.event_id, e.ts),
turns AS (SELECT *, row_number() OVER (PARTITION BY user_id, st ORDER BY ts, event_id) AS k FROM within),
decided AS (SELECT user_id AS client, event_id AS id, ts, k <= 2 AS allowed, CAST(greatest(0, 2 - k) AS INTEGER) AS remaining, st + INTERVAL 1 DAY AS reset FROM turns)"""
DECISIONS = f"WITH RECURSIVE {LIMITED} SELECT client, id, ts, allowed, remaining, reset FROM decided"

STROKES = """pe AS (SELECT user_id AS "user", event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, floor(value) AS y,
 coalesce(CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END, 0.5) AS pressure FROM events),
downs AS (SELECT "user", seq AS first, row_number() OVER (PARTITION BY "user" ORDER BY seq) AS stroke_id, lead(seq) OVER (PARTITION BY "user" ORDER BY seq) AS next FROM pe WHERE event_type = 'signup'),
ends AS (SELECT d."user", d.stroke_id, min(e.seq) AS last FROM downs AS d JOIN pe AS e ON e."user" = d."user" AND e.event_type = 'error' AND e.seq > d.first AND (d.next IS NULL OR e.seq < d.next) GROUP BY ALL),
st AS (SELECT d."user", d.stroke_id, e.seq, e.x, e.y, e.pressure FROM downs AS d LEFT JOIN ends AS n ON n."user" = d."user" AND n.stroke_id = d.stroke_id
 JOIN pe AS e ON e."user" = d."user" AND e.seq >= d.first AND (d.next IS NULL OR e.seq < d.next) AND (n.last IS NULL OR e.seq <= n.last))"""


def outlines(points: str, size: float) -> str:
    """CTEs of the outline ``op`` ("user", stroke_id, k, x, y) around strokes ``points`` ("user", stroke_id, seq, x, y, pressure): smoothed by recursion, one union per part."""
    share, eighth = f"CAST({1 - 0.85 * 0.6!r} AS DOUBLE)", "CAST(0.7071067811865476 AS DOUBLE)"
    side = lambda s, name: f"""SELECT "user", stroke_id, {0 if s > 0 else 2} AS part, {"k" if s > 0 else "-k"} AS o, 0 AS j, x + r * ({-s} * ((ay + byy) / len)) AS x, y + r * ({s} * ((ax + bx) / len)) AS y FROM dirs WHERE NOT turned
 UNION ALL SELECT "user", stroke_id, {0 if s > 0 else 2}, {"k" if s > 0 else "-k"}, j, x + r * CASE j WHEN {0 if s > 0 else 3} THEN {-s} * ay WHEN {1 if s > 0 else 2} THEN ({-s} * ay + ax) * {eighth} WHEN {2 if s > 0 else 1} THEN ax ELSE {-s} * byy END,
  y + r * CASE j WHEN {0 if s > 0 else 3} THEN {s} * ax WHEN {1 if s > 0 else 2} THEN ({s} * ax + ay) * {eighth} WHEN {2 if s > 0 else 1} THEN ay ELSE {s} * bx END FROM dirs, (VALUES (0), (1), (2), (3)) AS js(j) WHERE turned"""  # noqa: E731
    cap = lambda part, where, x, y: f"""SELECT "user", stroke_id, {part}, 0, j, x + r * CASE j WHEN 0 THEN ({x} - {y}) * {eighth} WHEN 1 THEN {x} ELSE ({x} + {y}) * {eighth} END, y + r * CASE j WHEN 0 THEN ({y} + {x}) * {eighth} WHEN 1 THEN {y} ELSE ({y} - {x}) * {eighth} END
  FROM dirs, (VALUES (0), (1), (2)) AS js(j) WHERE {where}"""  # noqa: E731
    return f"""sp AS MATERIALIZED (SELECT "user", stroke_id, row_number() OVER (PARTITION BY "user", stroke_id ORDER BY seq) AS k, x, y, greatest(CAST(0.01 AS DOUBLE), CAST({size} AS DOUBLE) * (0.5 - CAST(0.15 AS DOUBLE) * (0.5 - pressure))) AS r FROM {points}),
sm AS (SELECT "user", stroke_id, k, x, y, CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy, r FROM sp WHERE k = 1
 UNION ALL SELECT "user", stroke_id, k, nx, ny, CASE WHEN l > 0 THEN mx / l ELSE dx END, CASE WHEN l > 0 THEN my / l ELSE dy END, r
 FROM (SELECT *, sqrt(mx * mx + my * my) AS l FROM (SELECT *, nx - x AS mx, ny - y AS my FROM (SELECT p."user", p.stroke_id, p.k, sm.x, sm.y, sm.dx, sm.dy, sm.x + (p.x - sm.x) * {share} AS nx, sm.y + (p.y - sm.y) * {share} AS ny, p.r FROM sm JOIN sp AS p ON p."user" = sm."user" AND p.stroke_id = sm.stroke_id AND p.k = sm.k + 1)))),
wy AS (SELECT *, count(*) OVER (PARTITION BY "user", stroke_id) AS n, coalesce(lead(dx) OVER w, dx) AS wx, coalesce(lead(dy) OVER w, dy) AS wyy FROM sm WINDOW w AS (PARTITION BY "user", stroke_id ORDER BY k)),
wz AS (SELECT *, CASE WHEN wx = 0 AND wyy = 0 THEN CAST(1 AS DOUBLE) ELSE wx END AS bx, wyy AS byy FROM wy WHERE n > 1),
dd AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN bx ELSE dx END AS ax, CASE WHEN dx = 0 AND dy = 0 THEN byy ELSE dy END AS ay FROM wz),
dirs AS MATERIALIZED (SELECT *, ax * bx + ay * byy < 0 AS turned, sqrt((ax + bx) * (ax + bx) + (ay + byy) * (ay + byy)) AS len FROM dd),
ou AS ({side(1, "left")} UNION ALL {cap(1, "k = n", "ax", "ay")} UNION ALL {side(-1, "right")} UNION ALL {cap(3, "k = 1", "(-bx)", "(-byy)")}),
op AS MATERIALIZED (SELECT "user", stroke_id, row_number() OVER (PARTITION BY "user", stroke_id ORDER BY part, o, j) AS k, x, y FROM ou)"""


STROKE_PATHS = f"""{outlines("st", 8.0)}, p AS (SELECT "user", stroke_id, k, count(*) OVER (PARTITION BY "user", stroke_id) AS n, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM op WINDOW w AS (PARTITION BY "user", stroke_id ORDER BY k)),
m AS (SELECT *, printf('%.2f,%.2f', floor(x * 100 + 0.5) / 100, floor(y * 100 + 0.5) / 100) AS here, printf('%.2f,%.2f', floor((x + nx) / 2 * 100 + 0.5) / 100, floor((y + ny) / 2 * 100 + 0.5) / 100) AS mid FROM p),
sq AS (SELECT "user", stroke_id, 'M' || max(CASE WHEN k = 1 THEN here END) || ' Q' || max(CASE WHEN k = 2 THEN here || ' ' || mid END) || ' T' || string_agg(CASE WHEN k > 2 AND k < n THEN mid || ' ' END, '' ORDER BY k) || 'Z' AS d FROM m GROUP BY "user", stroke_id),
svg AS (SELECT a."user", a.stroke_id, coalesce(sq.d, '') AS d FROM (SELECT DISTINCT "user", stroke_id FROM st) AS a LEFT JOIN sq ON sq."user" = a."user" AND sq.stroke_id = a.stroke_id)"""

#: Pixels of the small canvas inside each stroke's outline by winding numbers: every edge against every pixel right of it.
STROKE_PIXELS = f"""sc AS (SELECT "user", stroke_id, seq, x * CAST(0.2 AS DOUBLE) AS x, y / 50 + 1 AS y, pressure FROM st), {outlines("sc", 2.0)},
qp AS (SELECT "user", stroke_id, k, count(*) OVER (PARTITION BY "user", stroke_id) AS n, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM op WINDOW w AS (PARTITION BY "user", stroke_id ORDER BY k)),
qc AS (SELECT "user", stroke_id, k, CASE WHEN k = 2 THEN px ELSE (px + x) / 2 END AS ax, CASE WHEN k = 2 THEN py ELSE (py + y) / 2 END AS ay, x AS bx, y AS byy, (x + nx) / 2 AS cx, (y + ny) / 2 AS cy FROM qp WHERE k > 1 AND k < n),
ql AS (SELECT "user", stroke_id, k * 4 + j AS k, u * ax + v * bx + w * cx AS x, u * ay + v * byy + w * cy AS y FROM qc, (SELECT j, (1 - j / CAST(4 AS DOUBLE)) * (1 - j / CAST(4 AS DOUBLE)) AS u, 2 * (j / CAST(4 AS DOUBLE)) * (1 - j / CAST(4 AS DOUBLE)) AS v, (j / CAST(4 AS DOUBLE)) * (j / CAST(4 AS DOUBLE)) AS w FROM (VALUES (1), (2), (3), (4)) AS js(j))
 UNION ALL SELECT "user", stroke_id, 0, x, y FROM op WHERE k = 1),
qe AS (SELECT "user", stroke_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first(x) OVER w) AS bx, coalesce(lead(y) OVER w, first(y) OVER w) AS byy FROM ql WINDOW w AS (PARTITION BY "user", stroke_id ORDER BY k)),
pixel AS (SELECT x, y FROM (SELECT unnest(range(0, 20)) AS x), (SELECT unnest(range(0, 12)) AS y)),
wn AS (SELECT "user", stroke_id, pixel.x, pixel.y, sum(CASE WHEN byy > ay THEN 1 ELSE -1 END) AS wind FROM qe JOIN pixel ON least(ay, byy) <= pixel.y + 0.5 AND pixel.y + 0.5 < greatest(ay, byy) AND ax + (pixel.y + 0.5 - ay) * (bx - ax) / (byy - ay) <= pixel.x + 0.5 GROUP BY ALL),
inked AS (SELECT "user" AS session_id, substr('abcdefg', CAST(stroke_id % 7 AS INTEGER) + 1, 1) AS letter, stroke_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM wn WHERE wind <> 0)"""
LETTER_LIST = "[" + ", ".join(f"'{c}'" for c in LETTERS) + "]"


def seeded(key: str, seed: int, n: int) -> str:
    return f"CAST(('0x' || md5({key} || ':{seed}')[1:8]) AS BIGINT) % {n}"


def hue(shift: str) -> str:
    q = 0.55 + 0.7 - 0.55 * 0.7
    p = 2 * 0.55 - q
    t = f"(CASE WHEN h + {shift} < 0 THEN h + {shift} + 1 WHEN h + {shift} > 1 THEN h + {shift} - 1 ELSE h + {shift} END)"
    p, q = f"CAST({p!r} AS DOUBLE)", f"CAST({q!r} AS DOUBLE)"
    v = f"CASE WHEN {t} < CAST(1 AS DOUBLE) / 6 THEN {p} + ({q} - {p}) * 6 * {t} WHEN {t} < 0.5 THEN {q} WHEN {t} < CAST(2 AS DOUBLE) / 3 THEN {p} + ({q} - {p}) * (CAST(2 AS DOUBLE) / 3 - {t}) * 6 ELSE {p} END"
    return f"CAST(floor(({v}) * 255 + 0.5) AS INTEGER)"


THIRD = "CAST(1 AS DOUBLE) / 3"
SIZE_TEXT = "CASE WHEN path_id % 3 = 0 THEN 'width=\"' || (path_id % 50 + 1) || '.5px\" height=\"' || (path_id % 40 + 1) || '\"' END"

SQL = {
    "gray_luma": f"""WITH {LEVELS}, ch AS (SELECT vec_id // 3 AS image_id, i, coalesce(max(CASE WHEN vec_id % 3 = 0 THEN g END), 0) AS r, coalesce(max(CASE WHEN vec_id % 3 = 1 THEN g END), 0) AS gr, coalesce(max(CASE WHEN vec_id % 3 = 2 THEN g END), 0) AS b FROM levels GROUP BY ALL)
SELECT image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(floor(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * gr + CAST(0.114 AS DOUBLE) * b + 0.5) AS INTEGER) AS g FROM ch""",
    "raster_invert": f"WITH {SMALL} SELECT image_id, x, y, 255 - g AS g FROM px",
    "raster_blur5x5": f"WITH {SMALL}, {box('px', 'g', 2, 'bl')} SELECT image_id, x, y, CAST(floor(CAST(s AS DOUBLE) / n + 0.5) AS INTEGER) AS g FROM bl",
    "adaptive_threshold": f"WITH {SHEETS}, {box('px', 'g', 10, 'bl')} SELECT image_id, x, y, CASE WHEN v < CAST(s AS DOUBLE) / n - 10 THEN 255 ELSE 0 END AS ink FROM bl",
    "histogram256": f"WITH {SMALL} SELECT image_id, g, count(*) AS n FROM px GROUP BY image_id, g",
    "otsu_threshold": f"WITH {SMALL}, {OTSU} SELECT image_id, threshold FROM otsu",
    "dilate_3x3": f"WITH {INK}, {morph('ink', 'm', 'max')} SELECT * FROM m",
    "erode_3x3": f"WITH {INK}, {morph('ink', 'm', 'min')} SELECT * FROM m",
    "close_3x3": f"WITH {INK}, {morph('ink', 'd', 'max')}, {morph('d', 'm', 'min')} SELECT * FROM m",
    "close_2x2_identity": f"WITH {INK} SELECT * FROM ink",
    "component_stats": f"WITH RECURSIVE {INK}, {components('ink', 8)}, {STATS} SELECT * FROM stats",
    "component_label_map": f"WITH RECURSIVE {INK}, {components('ink', 8)}, {STATS} SELECT lab.image_id, lab.x, lab.y, CASE WHEN area >= 3 THEN lab.label ELSE -1 END AS label FROM lab JOIN stats ON lab.image_id = stats.image_id AND lab.label = stats.label",
    "remove_small_components": f"WITH RECURSIVE {INK}, {components('ink', 8)}, {STATS} SELECT ink.image_id, ink.x, ink.y, CASE WHEN area >= 3 THEN 255 ELSE 0 END AS ink FROM ink LEFT JOIN lab ON ink.image_id = lab.image_id AND ink.x = lab.x AND ink.y = lab.y LEFT JOIN stats ON lab.image_id = stats.image_id AND lab.label = stats.label",
    "component_neighbours": f"WITH {INK}, d AS (SELECT image_id, x, y FROM ink WHERE ink = 255) SELECT a.image_id, a.x, a.y, count(b.x) AS degree FROM d AS a LEFT JOIN d AS b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.image_id, a.x, a.y",
    "ink_bounds": f"WITH {INK} SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ink WHERE ink = 255 GROUP BY image_id",
    "single_glyph_center": f"""WITH {INK}, b AS (SELECT image_id, min(x) AS left_x, min(y) AS top_y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ink WHERE ink = 255 AND image_id % 9 <> 0 GROUP BY image_id)
SELECT ink.image_id, CAST(x - left_x + (greatest(w, h) + 20 - w) // 2 AS INTEGER) AS x, CAST(y - top_y + (greatest(w, h) + 20 - h) // 2 AS INTEGER) AS y, 255 AS ink, greatest(w, h) + 20 AS width, greatest(w, h) + 20 AS height FROM ink JOIN b ON ink.image_id = b.image_id WHERE ink = 255
UNION ALL SELECT image_id, x, y, 0, 8, 8 FROM px WHERE image_id NOT IN (SELECT image_id FROM b)""",
    "photo_preprocess": f"""WITH RECURSIVE {SHEETS}, {box('px', 'g', 2, 'b5')}, soft AS (SELECT image_id, x, y, CAST(floor(CAST(s AS DOUBLE) / n + 0.5) AS INTEGER) AS g FROM b5), {box('soft', 'g', 10, 'bl')},
ink AS (SELECT image_id, x, y, CASE WHEN v < CAST(s AS DOUBLE) / n - 12 THEN 255 ELSE 0 END AS ink FROM bl), {components('ink', 64)}, {STATS}
SELECT ink.image_id, ink.x, ink.y, CASE WHEN area >= 5 THEN 255 ELSE 0 END AS ink FROM ink LEFT JOIN lab ON ink.image_id = lab.image_id AND ink.x = lab.x AND ink.y = lab.y LEFT JOIN stats ON lab.image_id = stats.image_id AND lab.label = stats.label""",
    "glyph_preprocess": f"WITH {SMALL}, {OTSU} SELECT px.image_id, x, y, CASE WHEN g <= threshold THEN 255 ELSE 0 END AS ink FROM px JOIN otsu ON px.image_id = otsu.image_id",
    "recognized_first_letters": f"""WITH {SYMBOLS}, ok AS (SELECT *, row_number() OVER (PARTITION BY item_id, c ORDER BY li, wi, ci) AS k FROM sy WHERE regexp_matches(c, '^[a-z]$') AND 2 + (li + wi + ci) % 4 >= 3)
SELECT item_id AS image_id, c AS char, CAST(wi * 12 + ci * 5 AS DOUBLE) AS x, CAST(li * 20 AS DOUBLE) AS y, CAST(2 + (li + wi + ci) % 4 AS DOUBLE) AS w, CAST(9 AS DOUBLE) AS h, CAST((li * 31 + wi * 17 + ci * 7) % 100 AS DOUBLE) / 100.0 AS confidence FROM ok WHERE k = 1""",
    "unique_chars": "WITH o AS (SELECT doc_id, c, instr(t, c) AS pos FROM (SELECT doc_id, lower(text) AS t, unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c FROM documents)) SELECT documents.doc_id, coalesce(string_agg(c, '' ORDER BY pos), '') AS chars FROM documents LEFT JOIN o ON documents.doc_id = o.doc_id AND pos > 0 GROUP BY documents.doc_id",
    "pangram_coverage": f"WITH {DRAWN}, l(place, letter, category) AS (VALUES {LETTER_ROWS}), p(pangram_id, text) AS (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(PANGRAMS))
    + f"""), o AS (SELECT pangram_id, c, instr(lower(text), c) AS pos FROM (SELECT *, unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c FROM p)),
s AS (SELECT DISTINCT session_id, CAST({seeded('session_id', 1, 8)} AS INTEGER) AS pangram_id FROM drawn), h AS (SELECT DISTINCT session_id, letter FROM drawn JOIN l ON l.place = drawn.place)
SELECT s.session_id, s.pangram_id, string_agg(c, '' ORDER BY pos) AS chars, CAST(count(*) AS INTEGER) AS n, CAST(count(h.letter) AS INTEGER) AS drawn FROM s JOIN o ON o.pangram_id = s.pangram_id AND pos > 0 LEFT JOIN h ON h.session_id = s.session_id AND h.letter = o.c GROUP BY s.session_id, s.pangram_id""",
    "letter_categories": f"WITH l(place, letter, category) AS (VALUES {LETTER_ROWS}), c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), '')) AS c FROM part) GROUP BY c) SELECT place, letter, category, CAST(CASE category WHEN 'ascender' THEN 0.05 WHEN 'descender' THEN 0.92 ELSE 0.31 END AS DOUBLE) AS guide, n FROM l JOIN c ON c.c = l.letter",
    "bbox_rescale": f"""WITH {COMPS}, s AS (SELECT *, CASE WHEN image_id % 10 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(128 AS DOUBLE) / 300 END AS sx, CAST(64 AS DOUBLE) / 200 AS sy FROM comps)
SELECT image_id, label, CAST(floor(x * sx + 0.5) AS INTEGER) AS x, CAST(floor(y * sy + 0.5) AS INTEGER) AS y, greatest(1, CAST(floor(w * sx + 0.5) AS INTEGER)) AS w, greatest(1, CAST(floor(h * sy + 0.5) AS INTEGER)) AS h FROM s""",
    "bbox_overlap_join": f"WITH {COMPS}, {CHARS}, {overlaps('comps', 'chars')} SELECT image_id, char, label, overlap FROM ov WHERE inside >= 0.3",
    "bbox_match_fallback": f"WITH {COMPS}, {CHARS}, {overlaps('comps', 'chars')}, {MATCHED} SELECT * FROM kept",
    "char_crop": f"""WITH RECURSIVE {INK}, {components('ink', 8)}, {STATS}, quad(char, x, y, w, h) AS (VALUES ('a', 0, 0, 4, 4), ('b', 4, 0, 4, 4), ('c', 0, 4, 4, 4), ('d', 4, 4, 4, 4)),
quads AS (SELECT vec_id AS image_id, quad.* FROM embeddings, quad), {overlaps('stats', 'quads')}, {MATCHED},
own AS (SELECT lab.image_id, kept.char, lab.x, lab.y FROM lab JOIN kept ON lab.image_id = kept.image_id AND lab.label = kept.label),
b AS (SELECT image_id, char, greatest(0, min(x) - 1) AS x1, greatest(0, min(y) - 1) AS y1, least(8, max(x) + 2) AS x2, least(8, max(y) + 2) AS y2 FROM own GROUP BY image_id, char)
SELECT own.image_id, own.char, x2 - x1 AS width, y2 - y1 AS height, x - x1 AS x, y - y1 AS y FROM own JOIN b ON own.image_id = b.image_id AND own.char = b.char""",
    "saved_glyphs": f"WITH {DRAWN} SELECT session_id, place, value FROM (SELECT *, row_number() OVER (PARTITION BY session_id, place ORDER BY event_id DESC) AS k FROM drawn) WHERE k = 1",
    "undrawn_letters": f"WITH {DRAWN}, l(place, letter, category) AS (VALUES {LETTER_ROWS}) SELECT s.session_id, l.letter FROM (SELECT DISTINCT session_id FROM drawn) AS s, l WHERE NOT EXISTS (SELECT 1 FROM drawn WHERE drawn.session_id = s.session_id AND drawn.place = l.place)",
    "draw_progress": f"WITH {DRAWN} SELECT session_id, count(DISTINCT place) AS n, CAST(count(DISTINCT place) AS DOUBLE) / 43 AS share FROM drawn GROUP BY session_id",
    "svg_extract_paths": f"WITH {DTEXT} SELECT path_id, 0 AS i, d FROM dt UNION ALL SELECT path_id, 1, 'M1 1 Z' FROM dt WHERE path_id % 2 = 0",
    "svg_viewbox": f"WITH {DTEXT} SELECT path_id, CASE path_id % 3 WHEN 0 THEN path_id % 50 + 1.5 WHEN 1 THEN CAST(path_id % 50 + 1 AS DOUBLE) END AS width, CASE WHEN path_id % 3 < 2 THEN CAST(path_id % 40 + 1 AS DOUBLE) END AS height FROM dt",
    "svg_scale": f"WITH {DTEXT} SELECT path_id, CASE WHEN path_id % 5 <> 0 THEN CAST(0.1 AS DOUBLE) END AS scale, CASE WHEN path_id % 5 <> 0 AND path_id % 3 < 2 THEN CAST(path_id % 40 + 1 AS DOUBLE) / CAST(0.1 AS DOUBLE) END AS traced_height FROM dt",
    "svg_parse_path": f"WITH RECURSIVE {PATHS} SELECT path_id, CAST(n - 1 AS INTEGER) AS i, type, x, y, x1, y1, x2, y2 FROM cmds",
    "path_bbox": f"WITH RECURSIVE {PATHS} SELECT * FROM bb",
    "font_coords_letter": f"WITH RECURSIVE {PATHS}, {glyphs('abcdefghijklmnopqrstuvwxyz')}, {scaled(None)} {POINTS}",
    "font_coords_punctuation": f"WITH RECURSIVE {PATHS}, {glyphs(''.join(PUNCTUATION))}, {scaled(None)} {POINTS}",
    "font_coords_uniform": f"WITH RECURSIVE {PATHS}, {glyphs(LETTERS)}, {scaled('7560.0')} {POINTS}",
    "glyph_table": f"""WITH RECURSIVE {PATHS}, {glyphs(LETTERS)}, {scaled(None)}, c AS (SELECT path_id, CAST(count(*) AS INTEGER) AS n FROM cmds GROUP BY path_id)
SELECT font_id, lower(char) AS name, unicode(lower(char)) AS code, advance, n FROM g JOIN c ON g.path_id = c.path_id UNION ALL SELECT font_id, upper(char), unicode(upper(char)), advance, n FROM g JOIN c ON g.path_id = c.path_id WHERE lower(char) <> upper(char)
UNION ALL SELECT DISTINCT font_id, '.notdef', 0, 600, 10 FROM g UNION ALL SELECT DISTINCT font_id, 'space', 32, 250, 0 FROM g""",
    "rate_limit_batch": DECISIONS,
    "rate_limit_stream": DECISIONS,
    "request_validation": f"""WITH RECURSIVE {LIMITED}, s AS (SELECT id, ts, reset, CASE WHEN id % 13 = 0 THEN 403 WHEN NOT allowed THEN 429 WHEN id % 17 = 0 THEN 503 WHEN id % 5 < 2 THEN 415 WHEN id % 7 = 0 THEN 4001 WHEN id % 7 = 1 THEN 4002 WHEN id % 7 IN (2, 3) THEN 4003
 WHEN id % 11 = 0 THEN 5021 WHEN id % 11 = 1 THEN 4291 WHEN id % 11 = 2 THEN 5022 ELSE 200 END AS s FROM decided),
n AS (SELECT *, CASE WHEN s IN (4001, 4002, 4003) THEN 400 WHEN s IN (5021, 5022) THEN 502 WHEN s = 4291 THEN 429 ELSE s END AS status FROM s)
SELECT id, CAST(status AS INTEGER) AS status, CASE s WHEN 403 THEN 'origin' WHEN 429 THEN 'rate' WHEN 503 THEN 'key' WHEN 415 THEN 'content type' WHEN 4001 THEN 'json' WHEN 4002 THEN 'missing' WHEN 4003 THEN 'base64' WHEN 5021 THEN 'denied' WHEN 4291 THEN 'upstream rate' WHEN 5022 THEN 'upstream' END AS error,
 CASE WHEN id % 3 = 0 THEN '10.0.0.' || (id % 200) WHEN id % 2 = 0 THEN '172.16.0.' || (id % 200) ELSE 'unknown' END AS ip, CASE WHEN status = 429 THEN CAST(ceil((epoch_us(reset) - epoch_us(ts)) / 1000000.0) AS BIGINT) END AS retry_after FROM n""",
    "origin_policy": """WITH o AS (SELECT page_id, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://[^/?#]+)', 1) AS own FROM pages),
c AS (SELECT page_id, own, CASE WHEN page_id % 7 = 0 THEN 'http://localhost:3000' WHEN page_id % 7 = 1 THEN 'https://app.example.com' ELSE own END AS origin FROM o),
a AS (SELECT page_id, origin, CASE WHEN page_id % 7 < 2 OR origin = CASE WHEN page_id % 2 = 0 THEN own ELSE 'https://api.example.com' END THEN origin END AS allowed FROM c)
SELECT page_id, origin, allowed, CASE WHEN allowed IS NULL THEN 403 ELSE 204 END AS status FROM a""",
    "base64_roundtrip": "SELECT doc_id, CAST(length(to_base64(encode(text))) AS INTEGER) AS n, md5(to_base64(encode(text))) AS md5, TRUE AS same FROM documents",
    "data_url_parse": "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'font/sfnt' ELSE 'image/png' END AS mime, text FROM benchmark",
    "font_format_sniff": """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 2 AND text LIKE 'wOF2%' THEN 'woff2' ELSE 'truetype' END AS format FROM documents)
SELECT doc_id, format, CASE format WHEN 'woff2' THEN 'font/woff2' ELSE 'font/sfnt' END AS mime, '@font-face { font-family: "Hand"; src: url("u' || doc_id || '") format("' || format || '"); }' AS css FROM f""",
    "name_sanitise": r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '   ' WHEN p_partkey % 10 = 1 THEN '漢字!' WHEN p_partkey % 10 = 2 THEN chr(9) || p_name || chr(10) WHEN p_partkey % 10 > 3 THEN '  ' || p_name || '  #' || p_brand || '! ' END AS name FROM part)
SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(coalesce(name, ''), chr(9) || chr(10) || ' ')), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), ''), 'you') AS name FROM n""",
    "date_slug": "SELECT o_orderkey, lower(strftime(o_orderdate, '%b')) || day(o_orderdate) AS slug FROM orders",
    "confidence_buckets": "SELECT doc_id, CASE WHEN doc_id % 101 > 80 THEN 'green' WHEN doc_id % 101 > 50 THEN 'yellow' ELSE 'red' END AS bucket, doc_id % 101 AS percent FROM labels",
    "label_palette": f"WITH t AS (SELECT vec_id, (vec_id * CAST(137.508 AS DOUBLE)) % 360 / 360.0 AS h FROM embeddings) SELECT vec_id, {hue(THIRD)} AS r, {hue('0')} AS g, {hue('(-' + THIRD + ')')} AS b FROM t",
    "stroke_sessions": f'WITH {STROKES} SELECT "user", stroke_id, count(*) AS n, min(seq) AS first, max(seq) AS last, CAST(floor(sum(pressure) * 100 + 0.5) AS BIGINT) AS pressure FROM st GROUP BY "user", stroke_id',
    "stroke_stream_batches": f"""WITH {STROKES} SELECT st."user", st.stroke_id, count(*) AS n, min(seq) AS first, max(seq) AS last, CAST(floor(sum(pressure) * 100 + 0.5) AS BIGINT) AS pressure FROM st JOIN downs AS d ON d."user" = st."user" AND d.stroke_id = st.stroke_id
 LEFT JOIN ends AS n ON n."user" = st."user" AND n.stroke_id = st.stroke_id WHERE d.next IS NOT NULL OR n.last IS NOT NULL GROUP BY st."user", st.stroke_id""",
    "stroke_outline": f"""WITH RECURSIVE {STROKES}, {outlines("st", 8.0)} SELECT "user", stroke_id, CAST(k - 1 AS INTEGER) AS i, CAST(floor(x * 1000 + 0.5) AS BIGINT) AS x, CAST(floor(y * 1000 + 0.5) AS BIGINT) AS y FROM op""",
    "stroke_svg_path": f"WITH RECURSIVE {STROKES}, {STROKE_PATHS} SELECT * FROM svg",
    "stroke_raster": f"""WITH RECURSIVE {STROKES}, {STROKE_PIXELS}, lv(times, g) AS (SELECT 1, 141 UNION ALL SELECT times + 1, CAST(floor(g + (26 - g) * 0.5 + 0.5) AS INTEGER) FROM lv WHERE times < 2000),
c AS (SELECT session_id, letter, x, y, count(*) AS times FROM inked GROUP BY ALL) SELECT session_id, letter, x, y, lv.g FROM c JOIN lv ON lv.times = c.times""",
    "saved_letters": f"""WITH RECURSIVE {STROKES}, {STROKE_PIXELS}, f AS (SELECT DISTINCT "user" AS session_id, stroke_id, substr('abcdefg', CAST(stroke_id % 7 AS INTEGER) + 1, 1) AS letter FROM op),
l AS (SELECT session_id, letter, max(stroke_id) AS stroke_id FROM f GROUP BY session_id, letter),
t AS (SELECT l.session_id, l.letter, pixel.x, pixel.y, CASE WHEN i.x IS NULL THEN 255 ELSE 26 END AS g FROM l CROSS JOIN pixel LEFT JOIN inked AS i ON i.session_id = l.session_id AND i.stroke_id = l.stroke_id AND i.x = pixel.x AND i.y = pixel.y)
SELECT session_id, letter, count(*) AS n, CAST(sum(255 - g) AS BIGINT) AS ink, CAST(sum(g * (x + 100 * y)) AS BIGINT) AS mark FROM t GROUP BY session_id, letter""",
    "session_json_roundtrip": """WITH s AS (SELECT event_id, event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS intact, event_type FROM events)
SELECT event_id, intact, CASE WHEN intact THEN 'Rk9OVA' || event_id END AS font, CASE WHEN intact THEN 'a,' || event_type END AS chars FROM s""",
    "random_pick_seeded": f"""WITH {DRAWN}, l(place, letter, category) AS (VALUES {LETTER_ROWS}), u AS (SELECT s.session_id, l.letter FROM (SELECT DISTINCT session_id FROM drawn) AS s, l WHERE NOT EXISTS (SELECT 1 FROM drawn WHERE drawn.session_id = s.session_id AND drawn.place = l.place))
SELECT session_id, letter FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md5(session_id || ':' || letter || ':7'), letter) AS k FROM u) WHERE k = 1""",
    "trace_edges": f"""WITH {INK}, d AS (SELECT image_id, x, y FROM ink WHERE ink = 255), side(side, dx, dy) AS (VALUES ('left', -1, 0), ('right', 1, 0), ('up', 0, -1), ('down', 0, 1))
SELECT d.image_id, d.x, d.y, side.side FROM d, side WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE o.image_id = d.image_id AND o.x = d.x + dx AND o.y = d.y + dy)""",
    "trace_outlines": f"WITH {INK} SELECT image_id, count(*) AS area FROM ink WHERE ink = 255 GROUP BY image_id",
    "trace_curves": f"""WITH {INK}, d AS (SELECT image_id, x, y FROM ink WHERE ink = 255), side(dx, dy) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
e AS (SELECT d.image_id, count(*) AS edges FROM d, side WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE o.image_id = d.image_id AND o.x = d.x + dx AND o.y = d.y + dy) GROUP BY d.image_id)
SELECT d.image_id, count(*) AS ink, any_value(edges) AS edges, TRUE AS close FROM d JOIN e ON d.image_id = e.image_id GROUP BY d.image_id""",
    "reference_height": f"""WITH {DRAWN}, l(place, letter, category) AS (VALUES {LETTER_ROWS}), h AS (SELECT session_id AS font_id, event_id, category = 'number' AS digit, letter, CASE WHEN event_id % 3 <> 0 THEN floor(value) ELSE 0 END AS height FROM drawn JOIN l ON drawn.place = l.place),
f AS (SELECT font_id, height, row_number() OVER (PARTITION BY font_id ORDER BY digit DESC, CASE WHEN digit THEN letter END, event_id) AS k FROM h WHERE height > 0)
SELECT a.font_id, f.height AS reference FROM (SELECT DISTINCT font_id FROM h) AS a LEFT JOIN f ON a.font_id = f.font_id AND k = 1""",
    "note_colour": "SELECT event_id, CASE event_type WHEN 'click' THEN '#ffe0b2' WHEN 'error' THEN '#ffcdd2' ELSE '#fff9c4' END AS colour FROM events",
    "font_readback": f"""WITH RECURSIVE {PATHS}, {glyphs(LETTERS)}, {scaled(None)}, r AS (SELECT font_id, char, 0 AS capital, unicode(lower(char)) AS code, advance FROM g UNION ALL SELECT font_id, char, 1, unicode(upper(char)), advance FROM g WHERE lower(char) <> upper(char))
SELECT font_id, code, row_number() OVER (PARTITION BY font_id ORDER BY char, capital) + 1 AS glyph, least(advance, 32000) AS advance FROM r UNION ALL SELECT DISTINCT font_id, 32, 1, 250 FROM g""",
    "font_outlines": f"""WITH RECURSIVE {PATHS}, {glyphs(LETTERS)}, {scaled(None)}, pt AS (SELECT g.font_id, g.char, CAST(c.n - 1 AS INTEGER) AS i, CASE WHEN c.type = 'Q' THEN 'C' ELSE c.type END AS type,
 CAST(greatest(-16000, least(16000, floor((c.x - g.min_x) * g.k + g.bearing + 0.5))) AS BIGINT) AS x, CAST(greatest(-16000, least(16000, floor((c.y - g.y0) * g.k + g.rise + 0.5))) AS BIGINT) AS y FROM g JOIN cmds AS c ON g.path_id = c.path_id WHERE c.type <> 'Z')
SELECT font_id, unicode(lower(char)) AS code, i, type, x, y FROM pt UNION ALL SELECT font_id, unicode(upper(char)), i, type, x, y FROM pt WHERE lower(char) <> upper(char)""",
    "drawn_font_codes": f"""WITH {SMALL}, {OTSU}, dc AS (SELECT DISTINCT image_id // 43 AS font_id, {LETTER_LIST}[CAST(image_id % 43 AS INTEGER) + 1] AS char FROM px JOIN otsu USING (image_id) WHERE g <= threshold)
SELECT font_id, unicode(lower(char)) AS code FROM dc UNION SELECT font_id, unicode(upper(char)) FROM dc UNION SELECT font_id, 32 FROM dc""",
    "recognition_status": "SELECT item_id AS image_id, CASE item_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN 'no annotation' WHEN 2 THEN 'no pages' ELSE 'ok' END AS status FROM benchmark",
    "label_counts": f"WITH RECURSIVE {INK}, {components('ink', 8)}, {STATS} SELECT image_id, count(*) AS n_components, CAST(sum(area) AS BIGINT) AS n_pixels FROM stats WHERE area >= 3 GROUP BY image_id",
    "font_registry": """WITH l AS (SELECT coalesce(lang, 'none') || '-' || (doc_id % 4) AS family, max(doc_id) AS k FROM documents GROUP BY 1),
u AS (SELECT family, CASE WHEN k % 3 = 0 THEN 'woff2' ELSE 'truetype' END AS format, 'data:font/' || CASE WHEN k % 3 = 0 THEN 'woff2' ELSE 'sfnt' END || ';base64,' || to_base64(encode(CASE WHEN k % 3 = 0 THEN 'wOF2' ELSE 'true' END || md5(CAST(k AS VARCHAR)))) AS url FROM l)
SELECT family, format, md5(url) AS url_md5, md5('@font-face { font-family: "' || family || '"; src: url("' || url || '") format("' || format || '"); }') AS css_md5 FROM u""",
    "font_status": f"""WITH RECURSIVE {PATHS}, {glyphs(LETTERS)}, n AS (SELECT font_id, count(*) + count(CASE WHEN lower(char) <> upper(char) THEN 1 END) + 2 AS n, string_agg(lower(char), '' ORDER BY lower(char)) AS chars FROM gm WHERE font_id % 10 <> 0 GROUP BY font_id)
SELECT a.font_id, CASE WHEN n.n IS NULL THEN 'no valid glyphs' ELSE 'ok' END AS status, n.n AS n_glyphs, n.chars FROM (SELECT DISTINCT path_id // 43 AS font_id FROM bb) AS a LEFT JOIN n ON n.font_id = a.font_id""",
    "font_names": rf"SELECT c_custkey, 'hand-of-' || CASE WHEN c_custkey % 4 <> 0 THEN regexp_replace(regexp_replace(lower(c_name), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') ELSE 'you' END || '-' || ({seeded('c_custkey', 3, 900)} + 100) AS name FROM customer",
    "pangram_shuffle": f"""WITH s AS (SELECT DISTINCT user_id, {seeded('user_id', 1, 8)} AS a, {seeded('user_id', 2, 7)} AS b FROM events)
SELECT user_id, CAST(a AS INTEGER) AS pangram, CAST(CASE WHEN b >= a THEN b + 1 ELSE b END AS INTEGER) AS next FROM s""",
    "raster_rgba": f"WITH {INK} SELECT image_id, x, y, 255 - ink AS r, 255 - ink AS g, 255 - ink AS b, 255 AS a FROM ink",
    "response_headers": """WITH p AS (SELECT page_id, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://[^/?#]+)', 1) AS own FROM pages), ok AS (SELECT * FROM p WHERE page_id % 3 <> 0 AND own <> '')
SELECT page_id, 'Content-Type' AS header, 'application/json' AS value FROM p UNION ALL SELECT page_id, 'Access-Control-Max-Age', CASE WHEN page_id IN (SELECT page_id FROM ok) THEN '86400' ELSE '1' END FROM p
UNION ALL SELECT page_id, 'Access-Control-Allow-Origin', own FROM ok UNION ALL SELECT page_id, 'Access-Control-Allow-Methods', 'POST, OPTIONS' FROM ok UNION ALL SELECT page_id, 'Access-Control-Allow-Headers', 'Content-Type' FROM ok""",
    "stroke_replay": f"""WITH RECURSIVE {STROKES}, {STROKE_PATHS} SELECT "user", CAST(row_number() OVER (PARTITION BY "user" ORDER BY stroke_id) AS INTEGER) AS turn, stroke_id, '#1a1a1a' AS fill, md5(d) AS md5 FROM svg WHERE d <> ''""",
    "file_sink": "SELECT 'kind-' || (item_id % 3) || '/' || item_id || '.txt' AS name, strlen(text) AS n_bytes, md5(text) AS md5 FROM benchmark WHERE text <> ''",
    "session_store": """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'signup' OR event_id % 3 = 2 THEN 'draw' WHEN event_id % 3 = 1 THEN 'playground' ELSE 'session' END AS slot FROM events),
k AS (SELECT user_id, slot, max(event_id) AS seq FROM e WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id, slot),
gone AS (SELECT user_id, slots.slot, max(event_id) AS seq FROM e, (VALUES ('session'), ('playground'), ('draw')) AS slots(slot) WHERE event_type = 'error' OR event_type = 'signup' AND slots.slot = 'draw' GROUP BY user_id, slots.slot)
SELECT k.user_id AS session_id, k.slot, CASE WHEN k.slot = 'playground' AND k.seq % 2 = 0 THEN 't' || k.seq END AS text, CASE WHEN k.slot = 'playground' AND k.seq % 2 = 0 THEN CAST(k.seq % 40 AS DOUBLE) END AS size,
 CASE WHEN k.slot = 'draw' AND k.seq % 4 <> 0 THEN 'AA' || k.seq END AS letter FROM k LEFT JOIN gone ON gone.user_id = k.user_id AND gone.slot = k.slot WHERE (gone.seq IS NULL OR gone.seq < k.seq) AND NOT (k.slot = 'playground' AND k.seq % 2 = 1)""",
    "letter_navigation": """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_type = 'click' THEN 'go' WHEN event_type = 'error' THEN 'skip' WHEN event_type = 'signup' AND event_id % 31 = 0 THEN 'finish' ELSE 'next' END AS action,
 CAST(event_id * 7 % 43 AS INTEGER) AS go, event_id % 7 <> 0 AS inked FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 0 AS letter, CAST(0 AS BIGINT) AS drawn, FALSE AS over FROM events
 UNION ALL SELECT user_id, event_id, k, CASE WHEN over OR action = 'finish' THEN letter WHEN action = 'next' THEN CASE WHEN inked AND len(spare) > 0 THEN spare[CAST(('0x' || md5(user_id || ':' || event_id)[1:8]) AS BIGINT) % len(spare) + 1] ELSE letter END WHEN action = 'go' THEN go ELSE least(letter + 1, 42) END,
  CASE WHEN over OR action = 'skip' OR action = 'go' AND go = letter THEN drawn ELSE saved END, over OR action = 'finish' OR action = 'skip' AND letter = 42 OR action = 'next' AND inked AND len(spare) = 0
 FROM (SELECT *, list_filter(range(0, 43), lambda i: (saved // CAST(pow(2, i) AS BIGINT)) % 2 = 0) AS spare FROM (SELECT e.*, s.letter, s.drawn, s.over, CASE WHEN inked AND (s.drawn // CAST(pow(2, s.letter) AS BIGINT)) % 2 = 0 THEN s.drawn + CAST(pow(2, s.letter) AS BIGINT) ELSE s.drawn END AS saved
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT user_id AS session_id, event_id AS seq, CAST(letter AS INTEGER) AS letter, drawn, over FROM s WHERE k > 0""",
}

#: The pictures' dark pixels: ink, ink inside the boxes' green frames, labels below their number, crops side by side.
SQL["debug_files"] = f"""WITH RECURSIVE {INK}, {components('ink', 8)}, c AS (SELECT image_id, count(DISTINCT label) AS n FROM lab GROUP BY image_id),
cr AS ({SQL["char_crop"]}), cw AS (SELECT image_id, max(width) + 8 AS cell FROM cr GROUP BY image_id),
cs AS (SELECT cr.image_id, (dense_rank() OVER (PARTITION BY cr.image_id ORDER BY char) - 1) * cell + 4 + x AS x, 4 + y AS y FROM cr JOIN cw ON cw.image_id = cr.image_id),
d AS (SELECT 'ink' AS stage, image_id, x, y, ink = 255 AS dark FROM ink UNION ALL SELECT 'boxes', image_id, x, y, ink = 255 AND x % 4 IN (1, 2) AND y % 4 IN (1, 2) FROM ink
 UNION ALL SELECT 'labels', lab.image_id, x, y, label < n FROM lab JOIN c ON c.image_id = lab.image_id UNION ALL SELECT 'crops', image_id, x, y, TRUE FROM cs)
SELECT stage, image_id, count(CASE WHEN dark THEN 1 END) AS inked, CAST(coalesce(sum(CASE WHEN dark THEN y * 8 + x END), 0) AS BIGINT) AS places FROM d GROUP BY stage, image_id"""
