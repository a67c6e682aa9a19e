"""Search grids over boundaries of the driver's suppliers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegrid.functions import geo as Z
from placegrid.operators import grid as G
from placegrid.operators import state as S
from placegrid.plans.registry import query

SIZE = 1000.0
# A concave five-sided ring, and a triangle east of it, in degrees times `k`.
RING = ((0.0, 0.0), (0.005, 0.03), (0.03, 0.025), (0.014, 0.012), (0.028, 0.004))
EAST = ((0.002, 0.06), (0.011, 0.08), (0.021, 0.065))
# A ring that crosses itself.
BOW = ((0.002, 0.06), (0.021, 0.08), (0.021, 0.065), (0.004, 0.079))
# Two rectangles that overlap: south, west, north, east; no centre on half a millionth of a degree.
PLOTS = ((0.0, 0.0, 0.0203173, 0.0307291), (0.0101377, 0.0113719, 0.0517437, 0.0811913))


def boundaries(t, second=EAST, first=RING):
    def ring(points) -> Column:
        return F.array(
            *[
                F.struct(
                    (F.col("clat") + F.lit(a) * F.col("k")).alias("lat"),
                    (F.col("clng") + F.lit(b) * F.col("k")).alias("lng"),
                )
                for a, b in points
            ]
        )

    rings = F.when(F.col("two"), F.array(ring(first), ring(second))).otherwise(F.array(ring(first)))
    return t.boundary.select("boundary_id", rings.alias("rings"))


def _ring_rows(points, r: int, where: str) -> str:
    values = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(points))
    return (
        f"SELECT boundary_id, {r} AS ring, p.pos AS pos, clat + CAST(p.a AS DOUBLE) * k AS lat, clng + CAST(p.b AS DOUBLE) * k AS lng "
        f"FROM v_boundary, (VALUES {values}) AS p(pos, a, b){where}"
    )


def _poly(coefficients: dict[int, float], xi: str, eta: str, trig: str, hyp: str) -> str:
    return " + ".join(f"({c!r}) * {trig}({2 * j} * {xi}) * {hyp}({2 * j} * {eta})" for j, c in coefficients.items())


# The oracle's own statement of the projection: third-flattening powers written out once.
_F = 1 / 298.257223563
_n = _F / (2 - _F)
_QA = 0.9996 * 6378137.0 / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_QE = 2 * math.sqrt(_n) / (1 + _n)
_FWD = {
    1: _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    2: 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    3: 61 * _n**3 / 240 - 103 * _n**4 / 140,
    4: 49561 * _n**4 / 161280,
}
_INV = {
    1: _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    2: _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    3: 17 * _n**3 / 480 - 37 * _n**4 / 840,
    4: 4397 * _n**4 / 161280,
}
_GEO = {
    1: 2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    2: 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    3: 56 * _n**3 / 15 - 136 * _n**4 / 35,
    4: 4279 * _n**4 / 630,
}


def _project(source: str, out: str) -> str:
    """CTEs adding x, y to rows with lat, lng, epsg."""
    return f"""
{out}_a AS (SELECT *, radians((epsg % 100 - 1) * 6 - 177) AS l0, sin(radians(lat)) AS sn FROM {source}),
{out}_b AS (SELECT *, sinh(atanh(sn) - {_QE!r} * atanh({_QE!r} * sn)) AS tt, radians(lng) - l0 AS dl FROM {out}_a),
{out}_c AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta FROM {out}_b),
{out} AS (SELECT * EXCLUDE (l0, sn, tt, dl, xi, eta), 500000.0 + {_QA!r} * (eta + {_poly(_FWD, 'xi', 'eta', 'cos', 'sinh')}) AS x,
  CASE WHEN epsg > 32700 THEN 10000000.0 ELSE 0.0 END + {_QA!r} * (xi + {_poly(_FWD, 'xi', 'eta', 'sin', 'cosh')}) AS y FROM {out}_c)"""


def _unproject(source: str, out: str) -> str:
    """CTEs adding lat, lng to rows with x, y, epsg."""
    geo = " + ".join(f"({c!r}) * sin({2 * j} * chi)" for j, c in _GEO.items())
    return f"""
{out}_a AS (SELECT *, (y - CASE WHEN epsg > 32700 THEN 10000000.0 ELSE 0.0 END) / {_QA!r} AS xi, (x - 500000.0) / {_QA!r} AS eta FROM {source}),
{out}_b AS (SELECT *, xi - ({_poly(_INV, 'xi', 'eta', 'sin', 'cosh')}) AS xi1, eta - ({_poly(_INV, 'xi', 'eta', 'cos', 'sinh')}) AS eta1 FROM {out}_a),
{out}_c AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM {out}_b),
{out} AS (SELECT * EXCLUDE (xi, eta, xi1, eta1, chi), degrees(chi + {geo}) AS lat,
  degrees(radians((epsg % 100 - 1) * 6 - 177) + atan2(sinh(eta1), cos(xi1))) AS lng FROM {out}_c)"""


_POINTS = f"""
points AS ({_ring_rows(RING, 0, '')} UNION ALL {_ring_rows(EAST, 1, ' WHERE two')}),
edges AS (SELECT *, lead(lat, 1, first) OVER w AS lat2, lead(lng, 1, first_lng) OVER w AS lng2 FROM (SELECT *,
    first_value(lat) OVER r AS first, first_value(lng) OVER r AS first_lng FROM points WINDOW r AS (PARTITION BY boundary_id, ring ORDER BY pos))
  WINDOW w AS (PARTITION BY boundary_id, ring ORDER BY pos)),
moments AS (SELECT boundary_id, ring, any_value(first) AS y0, any_value(first_lng) AS x0, sum(c) AS a2, sum((dx1 + dx2) * c) AS sx, sum((dy1 + dy2) * c) AS sy
  FROM (SELECT *, dx1 * dy2 - dx2 * dy1 AS c FROM (SELECT *, lng - first_lng AS dx1, lng2 - first_lng AS dx2, lat - first AS dy1, lat2 - first AS dy2 FROM edges))
  GROUP BY ALL),
centres AS (SELECT boundary_id, sum(abs(a2) * (y0 + sy / (3 * a2))) / sum(abs(a2)) AS clat, sum(abs(a2) * (x0 + sx / (3 * a2))) / sum(abs(a2)) AS clng
  FROM moments GROUP BY ALL),
zones AS (SELECT *, CAST(CASE WHEN clat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((clng + 180) / 6) AS INTEGER) % 60 + 1 AS INTEGER) AS epsg FROM centres),
zoned AS (SELECT e.boundary_id, e.ring, e.pos, e.lat, e.lng, z.epsg FROM edges e JOIN zones z ON e.boundary_id = z.boundary_id),
{_project('zoned', 'metres')},
bounds AS (SELECT boundary_id, epsg, min(x) AS minx, min(y) AS miny, CAST(ceil((max(x) - min(x)) / 1000) AS BIGINT) AS nx,
  CAST(ceil((max(y) - min(y)) / 1000) AS BIGINT) AS ny FROM metres GROUP BY ALL),
cand AS (SELECT b.*, ix, iy FROM bounds b, unnest(range(b.nx)) AS i(ix), unnest(range(b.ny)) AS j(iy))"""

# Every square against every edge: clip the edge to the square, or test its middle by even-odd.
_HITS = f"""{_POINTS},
unit AS (SELECT m.boundary_id, m.ring, m.pos, (m.x - b.minx) / 1000 AS x1, (m.y - b.miny) / 1000 AS y1 FROM metres m JOIN bounds b ON m.boundary_id = b.boundary_id),
segs AS (SELECT *, lead(x1, 1, fx) OVER w AS x2, lead(y1, 1, fy) OVER w AS y2 FROM (SELECT *, first_value(x1) OVER r AS fx, first_value(y1) OVER r AS fy FROM unit
    WINDOW r AS (PARTITION BY boundary_id, ring ORDER BY pos)) WINDOW w AS (PARTITION BY boundary_id, ring ORDER BY pos)),
tests AS (SELECT c.boundary_id, c.ix, c.iy, s.ring,
    greatest(0, CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN ix AND ix + 1 THEN 0 ELSE 2 END ELSE least((ix - x1) / (x2 - x1), (ix + 1 - x1) / (x2 - x1)) END,
      CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN iy AND iy + 1 THEN 0 ELSE 2 END ELSE least((iy - y1) / (y2 - y1), (iy + 1 - y1) / (y2 - y1)) END) AS t0,
    least(1, CASE WHEN x2 = x1 THEN 1 ELSE greatest((ix - x1) / (x2 - x1), (ix + 1 - x1) / (x2 - x1)) END,
      CASE WHEN y2 = y1 THEN 1 ELSE greatest((iy - y1) / (y2 - y1), (iy + 1 - y1) / (y2 - y1)) END) AS t1,
    (x1 <= ix + 0.5) <> (x2 <= ix + 0.5) AND y1 + (ix + 0.5 - x1) / nullif(x2 - x1, 0) * (y2 - y1) > iy + 0.5 AS above
  FROM cand c JOIN segs s ON c.boundary_id = s.boundary_id),
per_ring AS (SELECT boundary_id, ix, iy, ring, bool_or(t0 <= t1) AS touch, count(*) FILTER (above) % 2 = 1 AS inside FROM tests GROUP BY ALL),
hits AS (SELECT boundary_id, ix, iy FROM per_ring GROUP BY ALL HAVING bool_or(touch OR inside))"""
_CELLS = f"""{_HITS},
numbered AS (SELECT h.*, b.epsg, b.minx + ix * 1000 AS x0, b.miny + iy * 1000 AS y0,
    row_number() OVER (PARTITION BY h.boundary_id ORDER BY ix, iy) - 1 AS cell_idx FROM hits h JOIN bounds b ON h.boundary_id = b.boundary_id)"""
_BOXED = f"""{_CELLS},
corners AS (SELECT n.* EXCLUDE (x0, y0), c AS corner, x0 + CASE WHEN c IN (1, 2) THEN 1000 ELSE 0 END AS x, y0 + CASE WHEN c IN (2, 3) THEN 1000 ELSE 0 END AS y
  FROM numbered n, (VALUES (0), (1), (2), (3)) AS q(c)),
{_unproject('corners', 'degs')},
quads AS (SELECT boundary_id, cell_idx, max(lat) AS n, min(lat) AS s, max(lng) AS e, min(lng) AS w, list(lat ORDER BY corner) AS la, list(lng ORDER BY corner) AS lo
  FROM degs GROUP BY ALL),
areas AS (SELECT *, (lo[2] - lo[1]) * (la[3] - la[1]) - (lo[3] - lo[1]) * (la[2] - la[1]) AS a1,
  (lo[3] - lo[1]) * (la[4] - la[1]) - (lo[4] - lo[1]) * (la[3] - la[1]) AS a2 FROM quads),
boxes AS (SELECT boundary_id, boundary_id || printf('_%04d', cell_idx) AS cell_id, n, s, e, w,
  ((la[1] + la[2] + la[3]) / 3 * a1 + (la[1] + la[3] + la[4]) / 3 * a2) / (a1 + a2) AS centroid_lat,
  ((lo[1] + lo[2] + lo[3]) / 3 * a1 + (lo[1] + lo[3] + lo[4]) / 3 * a2) / (a1 + a2) AS centroid_lon FROM areas)"""
_ROUNDED = ("centroid_lat", "centroid_lon", "bbox_north", "bbox_south", "bbox_east", "bbox_west")
_BOX_SQL = """round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon, round(n, 6) AS bbox_north,
  round(s, 6) AS bbox_south, round(e, 6) AS bbox_east, round(w, 6) AS bbox_west"""


def _projected(t, second=EAST):
    return G.projected_edges(boundaries(t, second))


def _grid(t):
    return G.generate_grid(boundaries(t), SIZE, F.col("boundary_id"))


@query("J6", """
SELECT boundary_id, CASE WHEN two THEN CAST(2 AS BIGINT) ELSE 1 END AS rings, CASE WHEN two THEN CAST(3 AS BIGINT) ELSE 5 END AS fewest_points,
  true AS valid FROM v_boundary""")
def rings_valid(t):
    return G.rings_valid(boundaries(t))


# Every edge against every other one of its ring.
@query("J6", f"""
WITH points AS ({_ring_rows(RING, 0, '')} UNION ALL {_ring_rows(BOW, 1, ' WHERE two')}),
e AS (SELECT boundary_id, ring, pos, lng AS x1, lat AS y1, count(*) OVER (PARTITION BY boundary_id, ring) AS n,
    coalesce(lead(lng) OVER w, first_value(lng) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
  FROM points WINDOW w AS (PARTITION BY boundary_id, ring ORDER BY pos)),
t AS (SELECT a.boundary_id, a.ring,
    sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS p,
    sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS q
  FROM e a JOIN e b ON a.boundary_id = b.boundary_id AND a.ring = b.ring AND b.pos - a.pos BETWEEN 2 AND a.n - 2),
bad AS (SELECT DISTINCT boundary_id FROM t WHERE p < 0 AND q < 0)
SELECT boundary_id, CASE WHEN two THEN CAST(2 AS BIGINT) ELSE 1 END AS rings, CASE WHEN two THEN CAST(4 AS BIGINT) ELSE 5 END AS fewest_points,
  boundary_id NOT IN (SELECT boundary_id FROM bad) AS valid FROM v_boundary""")
def crossed_rings(t):
    return G.rings_valid(boundaries(t, BOW))


def _lobes(points) -> tuple:
    """The two triangles of a ring of four points whose first and third side cross."""
    (ay, ax), (by, bx), (cy, cx), (dy, dx) = points
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ((bx - ax) * (dy - cy) - (by - ay) * (dx - cx))
    middle = (ay + t * (by - ay), ax + t * (bx - ax))
    return (points[0], middle, points[3]), (middle, points[1], points[2])


# The ring cut at its crossing: two simple rings in its place.
_CUT = " UNION ALL ".join(_ring_rows(lobe, i, " WHERE two") for i, lobe in enumerate(_lobes(BOW), 1))
_CUT_HITS = _HITS.replace(_ring_rows(EAST, 1, " WHERE two"), _CUT)


@query("J6 H6", f"WITH {_CUT_HITS} SELECT boundary_id, ix, iy FROM hits")
def repaired_cells(t):
    projected = _projected(t, BOW)
    return G.cells_in_boundary(projected, G.grid_bounds(projected, SIZE), SIZE)


def _plots_sql() -> str:
    """Sums of both rectangles less their common part, which is a rectangle too."""
    (s1, w1, n1, e1), (s2, w2, n2, e2) = PLOTS
    common = (max(s1, s2), max(w1, w2), min(n1, n2), min(e1, e2))
    parts = [(*PLOTS[0], 1), (*PLOTS[1], 1), (*common, -1)]
    area = [(n - s) * (e - w) * sign for s, w, n, e, sign in parts]
    lat = sum(a * (s + n) / 2 for a, (s, w, n, e, _) in zip(area, parts)) / sum(area)
    lng = sum(a * (w + e) / 2 for a, (s, w, n, e, _) in zip(area, parts)) / sum(area)
    return f"""WITH c AS (SELECT boundary_id, clat + k * CASE WHEN two THEN {lat!r} ELSE {(s1 + n1) / 2!r} END::DOUBLE AS lat,
    clng + k * CASE WHEN two THEN {lng!r} ELSE {(w1 + e1) / 2!r} END::DOUBLE AS lng FROM v_boundary)
SELECT boundary_id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lng + 180) / 6) AS INTEGER) % 60 + 1 AS INTEGER) AS epsg,
  round(lat, 6) AS centroid_lat, round(lng, 6) AS centroid_lng FROM c"""


@query("H6 J1", _plots_sql())
def union_zones(t):
    first, second = (((s, w), (n, w), (n, e), (s, e)) for s, w, n, e in PLOTS)
    zones = G.zones(G.edges(boundaries(t, second, first)))
    return zones.select(
        "boundary_id", "epsg", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lng", 6).alias("centroid_lng")
    )


@query("J1", f"""WITH {_POINTS}
SELECT boundary_id, epsg, round(clat, 6) AS centroid_lat, round(clng, 6) AS centroid_lng FROM zones""")
def utm_zones(t):
    zones = G.zones(G.edges(boundaries(t)))
    return zones.select(
        "boundary_id", "epsg", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lng", 6).alias("centroid_lng")
    )


@query("J2", f"WITH {_POINTS} SELECT boundary_id, CAST(ring AS INTEGER) AS ring, CAST(pos AS INTEGER) AS pos, round(x, 4) AS x, round(y, 4) AS y FROM metres")
def project_utm(t):
    return _projected(t).select(
        "boundary_id", "ring", "pos", F.round("x1", 4).alias("x"), F.round("y1", 4).alias("y")
    )


# Coordinates of every discovery through the projection and back.
@query("J5 J2", "SELECT place_id, o1, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v_discovered WHERE lat IS NOT NULL")
def unprojected_points(t):
    points = t.discovered.filter("lat is not null").withColumn("epsg", Z.utm_zone("lat", "lng"))
    there = Z.project_utm(points, "lat", "lng", "epsg").drop("lat", "lng")
    return Z.unproject_utm(there, "x", "y", "epsg").select(
        "place_id", "o1", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")
    )


@query("J3", f"WITH {_POINTS} SELECT boundary_id, ix, iy, round(minx + ix * 1000, 4) AS x0, round(miny + iy * 1000, 4) AS y0 FROM cand")
def grid_candidates(t):
    cells = G.grid_candidates(G.grid_bounds(_projected(t), SIZE), SIZE)
    return cells.select("boundary_id", "ix", "iy", F.round("x0", 4).alias("x0"), F.round("y0", 4).alias("y0"))


@query("D14 J4 H6", f"WITH {_HITS} SELECT boundary_id, ix, iy FROM hits")
def cells_in_boundary(t):
    projected = _projected(t)
    return G.cells_in_boundary(projected, G.grid_bounds(projected, SIZE), SIZE)


@query("F14", f"WITH {_CELLS} SELECT boundary_id, ix, iy, cell_idx, boundary_id || printf('_%04d', cell_idx) AS cell_id FROM numbered")
def number_cells(t):
    projected = _projected(t)
    hits = G.cells_in_boundary(projected, G.grid_bounds(projected, SIZE), SIZE)
    return G.number_cells(hits, F.col("boundary_id"))


@query("J5 J1 J2 J4 F14", f"WITH {_BOXED} SELECT boundary_id, cell_id, {_BOX_SQL} FROM boxes")
def generate_grid(t):
    return _grid(t).select("boundary_id", "cell_id", *[F.round(c, 6).alias(c) for c in _ROUNDED])


def _rounded_grid(t):
    return _grid(t).select("cell_id", *[F.round(c, 3).alias(c) for c in _ROUNDED])


@query("B6", f"""WITH {_BOXED}, r AS (SELECT cell_id, round(n, 3) AS n, round(s, 3) AS s, round(e, 3) AS e, round(w, 3) AS w FROM boxes)
SELECT cell_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || e || ',' || s || '],['
  || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]}},"properties":{{"cell_id":"' || cell_id || '"}}}}' AS value FROM r""")
def cell_features(t):
    return G.cell_features(_rounded_grid(t))


def _cell_states(t):
    """Work state on grid cells: orders spread over the first cells of the suppliers' grids."""
    key = F.col("seq")
    cell = F.format_string("B%d_%04d", key % 100, key % 7)
    return t.state_cells.withColumn("cell_id", cell)


@query("D7 E3 C19", f"""WITH {_BOXED},
st AS (SELECT 'B' || (seq % 100) || printf('_%04d', seq % 7) AS cell_id, status, CASE WHEN place_count = 'x' THEN 0 ELSE CAST(place_count AS BIGINT) END AS n,
  CASE status WHEN 'in_progress' THEN 3 WHEN 'done' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END * 1000000000000 + seq AS k
  FROM v_state_cells WHERE status NOT IN ('', 'queued', 'pending')),
one AS (SELECT cell_id, arg_max(status, k) AS status, arg_max(n, k) AS place_count FROM st GROUP BY ALL)
SELECT b.cell_id, round(w, 6) AS bbox_west, round(s, 6) AS bbox_south, status, place_count FROM boxes b JOIN one ON b.cell_id = one.cell_id""")
def touched_grid(t):
    grid = _grid(t).select(
        "cell_id", F.round("bbox_west", 6).alias("bbox_west"), F.round("bbox_south", 6).alias("bbox_south")
    )
    return G.touched_grid(grid, S.collapse_cells(_cell_states(t), ["seq"], skip_untouched=True))
