"""Morph queries: triangles held against the empty-circle property, blends against a join of pixels with triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.operators import morphs
from loomwork.plans import imaging

#: Shares of the second image. The first keeps all places multiples of 1 / 131,072, so that they can be told as integers.
MESH_ALPHA, BLEND_ALPHA, SCALE = 0.25, 0.3719, 131072


def blend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, height, width, pixels_a, pixels_b, points_a, points_b): each image with the one ten ids on.

    Four landmarks of 16 bits of the image each, one a quarter: no four points lie on an empty circle, so there is but one mesh.
    """
    part = lambda k: (F.element_at("p", k) * 256 + F.element_at("p", k + 1)) / F.lit(32768.0)
    point = lambda k: F.struct((F.lit(1.0 + 3 * (k % 2)) + part(2 * k + 1)).alias("x"), (F.lit(1.0 + 3 * (k // 2)) + part(2 * k + 9)).alias("y"))
    colour = F.flatten(F.transform("p", lambda p: F.array(p, p, p)))
    ready = imaging.gray(spark, sf_dir).select("vec_id", colour.alias("pixels"), F.array(*[point(k) for k in range(4)]).alias("points"))
    a = ready.select("vec_id", F.col("pixels").alias("pixels_a"), F.col("points").alias("points_a"))
    b = ready.select((F.col("vec_id") - 10).alias("vec_id"), F.col("pixels").alias("pixels_b"), F.col("points").alias("points_b"))
    named = F.concat_ws("_", F.lit("blend"), "vec_id", F.col("vec_id") + 10).alias("name")
    return a.join(b, "vec_id").select(named, F.lit(8).alias("height"), F.lit(8).alias("width"), "pixels_a", "pixels_b", "points_a", "points_b")


def morph_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles of every pair, corners as x:y in parts of a pixel."""
    whole = lambda v: (v * SCALE).cast("long").cast("string")
    corners = F.array_join(F.transform("target", lambda p: F.concat_ws(":", whole(p["x"]), whole(p["y"]))), " ")
    return morphs.meshes(blend_pairs(spark, sf_dir), MESH_ALPHA).select("name", F.col("t").cast("int").alias("t"), corners.alias("corners"))


def morph_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair mixed along its triangles: the hash of one of the three equal channels."""
    done = morphs.morph_pixels(blend_pairs(spark, sf_dir), BLEND_ALPHA)
    first = F.filter("pixels", lambda v, i: i % 3 == 0)
    return done.select("name", F.sha2(F.array_join(first.cast("array<string>"), " "), 256).alias("sha256"))


def _mesh_sql(alpha: float) -> str:
    """Points, all their triples with circles, and of these the triangles whose circle holds no other point, numbered by corners."""
    part = lambda k: f"((p[{k}] * 256 + p[{k + 1}]) / 32768::DOUBLE)"
    points = ", ".join(f"{{'x': {1.0 + 3 * (k % 2)}::DOUBLE + {part(2 * k + 1)}, 'y': {1.0 + 3 * (k // 2)}::DOUBLE + {part(2 * k + 9)}}}" for k in range(4))
    border = ", ".join(f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE}}" for x, y in ((0, 0), (3.5, 0), (7, 0), (0, 3.5), (7, 3.5), (0, 7), (3.5, 7), (7, 7)))
    mixed = lambda v: f"{1.0 - alpha!r}::DOUBLE * a.{v} + {alpha!r}::DOUBLE * b.{v} AS {v}"
    return f"""{imaging.GRAY}, l AS (SELECT vec_id, p, [{points}, {border}] AS points FROM g),
  pair AS (SELECT 'blend_' || a.vec_id || '_' || b.vec_id AS name, a.p AS pa, b.p AS pb, a.points AS aa, b.points AS bb FROM l a JOIN l b ON b.vec_id = a.vec_id + 10),
  pt AS (SELECT name, i, a, b, {mixed("x")}, {mixed("y")} FROM (SELECT name, i, aa[i + 1] AS a, bb[i + 1] AS b FROM pair, (SELECT unnest(range(12)) AS i))),
  three AS (SELECT u.name, u.i AS i, v.i AS j, w.i AS k, u.x AS x0, u.y AS y0, v.x AS x1, v.y AS y1, w.x AS x2, w.y AS y2, [u.a, v.a, w.a] AS a, [u.b, v.b, w.b] AS b,
    (v.x - u.x) * (w.y - u.y) - (w.x - u.x) * (v.y - u.y) AS area FROM pt u JOIN pt v ON u.name = v.name AND u.i < v.i JOIN pt w ON u.name = w.name AND v.i < w.i),
  circle AS (SELECT *, ((y2 - y0) * e - (y1 - y0) * f) / (2 * area) AS ox, ((x1 - x0) * f - (x2 - x0) * e) / (2 * area) AS oy
    FROM (SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS e, (x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0) AS f FROM three WHERE abs(area) > 1e-9)),
  held AS (SELECT DISTINCT c.name, c.i, c.j, c.k FROM circle c JOIN pt s ON s.name = c.name AND s.i NOT IN (c.i, c.j, c.k)
    AND (s.x - c.x0 - ox) * (s.x - c.x0 - ox) + (s.y - c.y0 - oy) * (s.y - c.y0 - oy) < (ox * ox + oy * oy) * (1 - 1e-9::DOUBLE)),
  mesh AS (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY i, j, k) - 1)::INT AS t FROM circle ANTI JOIN held USING (name, i, j, k))"""


def _blend_sql() -> str:
    """Pixels joined with the triangles they lie in, the last counts; both images sampled there and mixed."""
    at = lambda n, v: f"s0 * {n}[1].{v} + s1 * {n}[2].{v} + s2 * {n}[3].{v} AS {n}_{v}"

    def value(p: str, n: str) -> str:
        corner = lambda dy, dx: f"{p}[{imaging._mirror(f'floor({n}_y)::INT + {dy}')} * 8 + {imaging._mirror(f'floor({n}_x)::INT + {dx}')} + 1]"
        fy, fx = f"({n}_y - floor({n}_y))", f"({n}_x - floor({n}_x))"
        return f"({corner(0, 0)} * (1 - {fx}) * (1 - {fy}) + {corner(0, 1)} * {fx} * (1 - {fy}) + ({corner(1, 0)} * (1 - {fx}) * {fy}) + {corner(1, 1)} * {fx} * {fy})"

    mix = f"least(greatest(round_even({1.0 - BLEND_ALPHA!r}::DOUBLE * {value('pa', 'a')} + {BLEND_ALPHA!r}::DOUBLE * {value('pb', 'b')}, 0), 0), 255)::INT"
    return f"""WITH {_mesh_sql(BLEND_ALPHA)},
  px AS (SELECT name, t, n, a, b, ((n % 8 - x0) * (y2 - y0) - (x2 - x0) * (n // 8 - y0)) / area AS s1, ((x1 - x0) * (n // 8 - y0) - (n % 8 - x0) * (y1 - y0)) / area AS s2
    FROM mesh, (SELECT unnest(range(64)) AS n) WHERE abs(area) >= 1e-6::DOUBLE),
  within AS (SELECT *, 1 - s1 - s2 AS s0 FROM px WHERE least(1 - s1 - s2, s1, s2) >= -1e-9::DOUBLE),
  placed AS (SELECT name, n, {", ".join(at(n, v) for n in "ab" for v in "xy")} FROM within QUALIFY row_number() OVER (PARTITION BY name, n ORDER BY t DESC) = 1)
  SELECT name, sha256(string_agg(v::VARCHAR, ' ' ORDER BY n)) AS sha256 FROM (SELECT name, n, {mix} AS v FROM placed JOIN pair USING (name)) GROUP BY name"""


QUERIES = {"morph_meshes": morph_meshes, "morph_blends": morph_blends}
ORACLES = {
    "morph_meshes": f"""WITH {_mesh_sql(MESH_ALPHA)} SELECT name, t, {" || ' ' || ".join(f"(x{k} * {SCALE})::BIGINT || ':' || (y{k} * {SCALE})::BIGINT" for k in range(3))} AS corners FROM mesh""",
    "morph_blends": _blend_sql(),
}
