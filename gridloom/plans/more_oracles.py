"""SQL for queries whose rows need more than one aggregate: neighbourhood windows, reach by recursion, hulls by all pairs."""

from __future__ import annotations

from gridloom.plans.raster_queries import LAB, LOG, ORACLES as RASTER, PX, SOBEL, TOPHAT
from gridloom.plans.shape_queries import FR, PL, VEC

ORACLES: dict[str, str] = {}

_STEP = "greatest(abs(p.x - q.x), abs(p.y - q.y)) + (sqrt(2.0) - 1) * least(abs(p.x - q.x), abs(p.y - q.y))"
ORACLES["signed_chamfer"] = f"""WITH {PX}, k AS (SELECT p.image, p.y, p.x, coalesce(min({_STEP}) FILTER (q.v > 60), 0) - coalesce(min({_STEP}) FILTER (q.v <= 60), 0) AS s FROM px p JOIN px q ON q.image = p.image GROUP BY 1, 2, 3)
SELECT image, round(min(s), 4) AS lo, round(max(s), 4) AS hi FROM k GROUP BY image"""

_ROW, _COLUMN = "(PARTITION BY image, y ORDER BY x)", "(PARTITION BY image, x ORDER BY y)"
ORACLES["delta_e_gradient"] = f"""WITH {PX}, {LAB.replace("lab AS (", "lab AS MATERIALIZED (")}, d AS (SELECT image, {" + ".join(f"pow(coalesce(lead({c}) OVER {w}, {c}) - coalesce(lag({c}) OVER {w}, {c}), 2)" for w in (_ROW, _COLUMN) for c in "lab")} AS s FROM lab)
SELECT image, round(max(0.5 * sqrt(s)), 4) AS max_de, round(avg(0.5 * sqrt(s)), 4) AS mean_de FROM d GROUP BY image"""

ORACLES["livewire_cost"] = f"""{SOBEL}, {LOG}, z AS (SELECT p.image, p.y, p.x FROM r p JOIN r l ON l.image = p.image AND l.y = p.y AND l.x = p.x - 1 JOIN r u ON u.image = p.image AND u.x = p.x AND u.y = p.y - 1
WHERE p.x < 30 AND p.y < 63 AND ((p.r >= 0) <> (l.r >= 0) OR (p.r >= 0) <> (u.r >= 0))),
m AS (SELECT image, y, x, sqrt(gx * gx + gy * gy) AS m, max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY image) AS top FROM g)
SELECT m.image, round(sum(0.02 + 0.45 * (1 - CASE WHEN top > 0 THEN m / top ELSE 0 END) + CASE WHEN z.image IS NULL THEN 0.35 ELSE 0 END), 3) AS total FROM m LEFT JOIN z ON z.image = m.image AND z.y = m.y AND z.x = m.x GROUP BY m.image"""

ORACLES["crease_spine"] = f"""{TOPHAT}, {LOG}, v AS MATERIALIZED (SELECT image, y, x, round(greatest(0, r) + t, 6) AS v FROM t JOIN r USING (image, y, x)),
g AS (SELECT *, coalesce(lead(v) OVER {_ROW}, v) - coalesce(lag(v) OVER {_ROW}, v) AS dx, coalesce(lead(v) OVER {_COLUMN}, v) - coalesce(lag(v) OVER {_COLUMN}, v) AS dy, max(v) OVER (PARTITION BY image) AS top FROM v),
h AS (SELECT *, CASE WHEN abs(dx) >= 0.4142 * abs(dy) THEN sign(dx) ELSE 0 END AS ax, CASE WHEN abs(dy) >= 0.4142 * abs(dx) THEN sign(dy) ELSE 0 END AS ay FROM g WHERE v > 0.12 * top)
SELECT h.image, CAST(count(*) AS BIGINT) AS spine_pixels, round(max(h.v), 4) AS max_valley FROM h LEFT JOIN v p ON p.image = h.image AND p.y = h.y + ay AND p.x = h.x + ax LEFT JOIN v q ON q.image = h.image AND q.y = h.y - ay AND q.x = h.x - ax
WHERE h.v >= coalesce(p.v, 0) AND h.v >= coalesce(q.v, 0) GROUP BY 1"""

ORACLES["canny_edges"] = f"""{SOBEL.replace("WITH", "WITH RECURSIVE", 1)}, m AS (SELECT image, y, x, gx, gy, gx * gx + gy * gy AS m FROM g),
n AS (SELECT *, CASE WHEN abs(gx) >= abs(gy) THEN greatest(coalesce(lag(m) OVER {_ROW}, m), coalesce(lead(m) OVER {_ROW}, m)) ELSE greatest(coalesce(lag(m) OVER {_COLUMN}, m), coalesce(lead(m) OVER {_COLUMN}, m)) END AS beside, sqrt(max(m) OVER (PARTITION BY image)) AS top FROM m),
k AS MATERIALIZED (SELECT image, y, x, sqrt(m) >= 0.24 * top AS strong FROM n WHERE m >= beside AND m > 0 AND sqrt(m) >= 0.08 * top),
s AS (SELECT image, y, x FROM k WHERE strong UNION SELECT k.image, k.y, k.x FROM s JOIN k ON k.image = s.image AND abs(k.y - s.y) <= 1 AND abs(k.x - s.x) <= 1)
SELECT image, CAST(count(*) AS BIGINT) AS edge_pixels FROM s GROUP BY image"""

#: Parseval: the spectrum's sum over all frequencies is the samples' sum of squares.
ORACLES["power_spectrum"] = f"WITH {FR} SELECT clip, frame, round(sum(s * s), 1) AS total FROM f GROUP BY 1, 2"

ORACLES["stream_sessions"] = "SELECT user_id, CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY 1"

ORACLES["turning_function"] = f"""WITH {PL}, l AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS l, atan2(ny - y, nx - x) AS a FROM sg), s AS (SELECT *, a - lag(a) OVER (PARTITION BY poly ORDER BY i) AS d FROM l WHERE l > 0),
t AS (SELECT poly, i, l, coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), 0) AS turn FROM s),
c AS (SELECT poly, l, sum(turn) OVER (PARTITION BY poly ORDER BY i) AS theta, sum(l) OVER (PARTITION BY poly ORDER BY i) AS e, sum(l) OVER (PARTITION BY poly) / 32 AS step FROM t)
SELECT poly, CAST(count(*) AS BIGINT) AS bins, round(sum(theta), 3) AS total FROM c JOIN range(32) k ON k.range >= ceil((e - l) / step - 0.5) AND k.range <= ceil(e / step - 0.5) - 1 GROUP BY poly"""

ORACLES["polyline_outline"] = f"""WITH {PL}, n AS (SELECT *, CAST(greatest(1, floor(2 * sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)))) AS BIGINT) AS n FROM sg), k AS (SELECT *, unnest(range(n + 1)) AS k FROM n)
SELECT poly, CAST(count(*) AS BIGINT) AS pixels FROM (SELECT DISTINCT poly, floor(x + (nx - x) * k / n + 0.5) AS px, floor(y + (ny - y) * k / n + 0.5) AS py FROM k) GROUP BY poly"""

_ASSIGNED = "a{i} AS (SELECT id, vec, arg_min(c, (round(d, 9), c)) AS c FROM (SELECT v.id, v.vec, k.c, list_sum(list_transform(list_zip(v.vec, k.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i} k) GROUP BY 1, 2)"
_MEANS = "c{j} AS (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY j) AS m FROM (SELECT c, j, avg(x) AS m FROM (SELECT c, unnest(vec) AS x, generate_subscripts(vec, 1) AS j FROM a{i}) GROUP BY 1, 2) GROUP BY 1) n ON n.c = o.c)"
ORACLES["kmeans_lloyd"] = f"WITH {VEC}, c0 AS (SELECT id AS c, vec AS m FROM v WHERE id < 4), {', '.join(_ASSIGNED.format(i=i) + ', ' + _MEANS.format(i=i, j=i + 1) for i in range(3))}, {_ASSIGNED.format(i=3)} SELECT c, CAST(count(*) AS BIGINT) AS n FROM a3 GROUP BY c"


def hull_sides(points: str, key: str) -> str:
    """The sides (key, x0, y0, x1, y1) of the convex hulls of distinct points (key, x, y): pairs with no point to their
    right, none on their line beyond them."""
    return f"""SELECT a.{key}, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {points} a JOIN {points} b ON b.{key} = a.{key} AND (b.x <> a.x OR b.y <> a.y) JOIN {points} c ON c.{key} = a.{key} GROUP BY 1, 2, 3, 4, 5
HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0 AND count(*) FILTER ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) NOT BETWEEN 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) = 0"""


ORACLES["convex_hull"] = f"""WITH {PL}, u AS MATERIALIZED (SELECT DISTINCT poly, x, y FROM pl), h AS MATERIALIZED ({hull_sides("u", "poly")}),
s AS (SELECT poly, count(*) AS n, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM h GROUP BY poly),
k AS (SELECT h.poly, max(pl.i) AS i FROM h JOIN pl ON pl.poly = h.poly AND pl.x = h.x0 AND pl.y = h.y0 GROUP BY h.poly, h.x0, h.y0),
e AS (SELECT poly, i AS a, coalesce(lead(i) OVER w, first_value(i) OVER w) AS b FROM k WINDOW w AS (PARTITION BY poly ORDER BY i)),
d AS (SELECT e.poly, e.a, max(abs((p.x - f.x) * (t.y - f.y) - (p.y - f.y) * (t.x - f.x)) / sqrt((t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y))) AS deep FROM e JOIN pl f ON f.poly = e.poly AND f.i = e.a JOIN pl t ON t.poly = e.poly AND t.i = e.b
  JOIN pl p ON p.poly = e.poly AND CASE WHEN e.a < e.b THEN p.i BETWEEN e.a AND e.b ELSE p.i >= e.a OR p.i <= e.b END WHERE f.x <> t.x OR f.y <> t.y GROUP BY 1, 2)
SELECT q.poly, CAST(coalesce(s.n, 1) AS BIGINT) AS hull_n, CAST((SELECT count(*) FROM d WHERE d.poly = q.poly AND deep > 2) AS BIGINT) AS defects, round(coalesce(s.area, 0), 3) AS area FROM (SELECT DISTINCT poly FROM pl) q LEFT JOIN s ON s.poly = q.poly"""

ORACLES["tightness"] = f"""WITH {PX}, m AS (SELECT image, y, min(x) AS lo, max(x) AS hi, count(*) AS n FROM px WHERE v > 60 GROUP BY 1, 2), u AS MATERIALIZED (SELECT image, lo AS x, y FROM m UNION SELECT image, hi, y FROM m),
h AS ({hull_sides("u", "image")}) SELECT h.image, round(abs(sum(x0 * y1 - x1 * y0)) / 2 / (SELECT sum(n) FROM m WHERE m.image = h.image), 4) AS tightness FROM h GROUP BY h.image"""

_BAND = f"WITH {PX}, lb AS (SELECT image, y, x, CAST(v // 50 AS INTEGER) AS label FROM px), ad AS (SELECT DISTINCT a.image, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b FROM lb a JOIN lb b ON a.image = b.image AND a.label <> b.label AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)))"
ORACLES["region_colouring"] = f"{_BAND} SELECT image, CAST(count(DISTINCT l) AS BIGINT) AS n_faces, CAST(count(*) / 2 AS BIGINT) AS n_adj, CAST(0 AS BIGINT) AS conflicts FROM (SELECT image, unnest([a, b]) AS l FROM ad) GROUP BY image"

_CELLS = """c AS (SELECT p.image, p.y, p.x, (p.v < 90)::INT AS a, (r.v < 90)::INT AS b, (d.v < 90)::INT AS c, (e.v < 90)::INT AS d FROM px p
JOIN px r ON r.image = p.image AND r.y = p.y AND r.x = p.x + 1 JOIN px d ON d.image = p.image AND d.x = p.x AND d.y = p.y + 1 JOIN px e ON e.image = p.image AND e.x = p.x + 1 AND e.y = p.y + 1)"""
ORACLES["dual_contouring"] = f"WITH {PX}, {_CELLS} SELECT image, CAST(count(*) FILTER (a + b + c + d BETWEEN 1 AND 3) AS BIGINT) AS n_vertices, CAST(count(*) FILTER (a <> b AND y > 0) + count(*) FILTER (a <> c AND x > 0) AS BIGINT) AS n_edges FROM c GROUP BY image"

ORACLES["evaluate_mask"] = f"""SELECT a.image, iou, f1, tightness, megapixels FROM ({RASTER['mask_iou']}) a JOIN ({RASTER['boundary_f1']}) b ON a.image = b.image
JOIN ({ORACLES['tightness'].replace(", 4) AS tightness", ", 6) AS tightness")}) c ON c.image = a.image JOIN (WITH {PX} SELECT image, round(count(*) / 1e6, 6) AS megapixels FROM px WHERE v > 60 GROUP BY image) d ON d.image = a.image"""

_TURNED = "SELECT poly AS grp, i, x + 3 AS x, y * 1.25 AS y FROM pl"
ORACLES["evaluate_polyline"] = f"""WITH {PL}, o AS ({_TURNED}), ab AS (SELECT p.poly, p.i, min((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) AS d FROM pl p JOIN o ON o.grp = p.poly GROUP BY 1, 2),
ba AS (SELECT p.grp AS poly, p.i, min((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) AS d FROM o p JOIN pl o ON o.poly = p.grp GROUP BY 1, 2),
m AS (SELECT poly, max(sqrt(d)) AS m1, avg(sqrt(d)) AS a1, sqrt(avg(d)) AS rmse FROM ab GROUP BY 1), n AS (SELECT poly, max(sqrt(d)) AS m2, avg(sqrt(d)) AS a2 FROM ba GROUP BY 1),
l AS (SELECT poly, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS length, sum(sqrt((nx - x) * (nx - x) + 1.5625 * (ny - y) * (ny - y))) AS other_length FROM sg GROUP BY 1)
SELECT poly, round(greatest(m1, m2), 4) AS hausdorff, round((a1 + a2) / 2, 4) AS chamfer, round(rmse, 4) AS rmse, round(length, 3) AS length, round(other_length, 3) AS other_length FROM m JOIN n USING (poly) JOIN l USING (poly)"""

ORACLES["pad_grow"] = f"""WITH {PX}, b AS (SELECT image, greatest(0, min(x) - 3) AS bx, greatest(0, min(y) - 3) AS by_, least(31, max(x) + 4) AS ex, least(64, max(y) + 4) AS ey FROM px WHERE v > 127 GROUP BY image)
SELECT px.image, CAST(37 * 70 AS BIGINT) AS n, CAST(sum((x + 3) * v) AS BIGINT) AS mx, CAST(max(ex - bx) AS INTEGER) AS w, CAST(max(ey - by_) AS INTEGER) AS h FROM px JOIN b USING (image) GROUP BY 1"""

ORACLES["gradient_between"] = f"""WITH {PX}, n AS (SELECT image, y, x, v, lead(v) OVER {_ROW} AS r, lead(v) OVER {_COLUMN} AS d FROM px), e AS (SELECT *, lead(r) OVER {_COLUMN} AS e FROM n)
SELECT image, round(sum(abs((r + e) / 2.0 - (v + d) / 2.0)), 4) AS dx, round(sum(abs((d + e) / 2.0 - (v + r) / 2.0)), 4) AS dy FROM e WHERE x < 30 AND y < 63 GROUP BY image"""

#: Tokens of several letters: a place where two conversations' roles differ counts once.
ORACLES["token_errors"] = """WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'a' WHEN 'assistant' THEN 'b' ELSE 'c' END, '' ORDER BY turn) AS s FROM conversations GROUP BY 1)
SELECT conv_id, round(levenshtein(s, 'ababab') / 6.0, 6) AS per FROM t"""

ORACLES["label_edges"] = f"WITH {PX}, lb AS (SELECT image, y, x, v // 100 AS label FROM px) SELECT image, CAST(count(*) FILTER (label <> coalesce(r, label) OR label <> coalesce(d, label)) AS BIGINT) AS edge FROM (SELECT *, lead(label) OVER {_ROW} AS r, lead(label) OVER {_COLUMN} AS d FROM lb) GROUP BY image"
