"""Queries over contours, masks and dose grids, each with its DuckDB equivalent, which tests every cell by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, voxels
from ..sources.standins import view, with_views

N = 32  # rows and columns of a plane
SX, SY, DZ = 2.0, 2.5, 3.0

EDGES = """e AS (SELECT patient_id, structure_id, k, contour_no, r AS r0, c AS c0, coalesce(lead(r) OVER o, first_value(r) OVER o) AS r1, coalesce(lead(c) OVER o, first_value(c) OVER o) AS c1
  FROM contour_point WINDOW o AS (PARTITION BY patient_id, structure_id, k, contour_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
lv AS (SELECT * FROM e WHERE abs(r0 - r1) > 1e-8 + 1e-5 * abs(r1))"""
MASK = (
    EDGES
    + f""", px AS (SELECT s.*, y.r, x.c FROM (SELECT DISTINCT patient_id, structure_id, k FROM e) s CROSS JOIN (SELECT unnest(range({N})) AS r) y CROSS JOIN (SELECT unnest(range({N})) AS c) x),
mask AS (SELECT px.patient_id, px.structure_id, px.k, px.r, px.c FROM px JOIN lv ON lv.patient_id = px.patient_id AND lv.structure_id = px.structure_id AND lv.k = px.k
  WHERE (r0 > px.r + 0.5) <> (r1 > px.r + 0.5) AND px.c + 0.5 < (c1 - c0) * (px.r + 0.5 - r0) / (r1 - r0) + c0 GROUP BY ALL HAVING count(*) % 2 = 1),
side AS (SELECT m.*, EXISTS (SELECT 1 FROM mask n WHERE n.patient_id = m.patient_id AND n.structure_id = m.structure_id AND n.k = m.k AND n.r = m.r AND n.c = m.c - 1)::INT AS w,
  EXISTS (SELECT 1 FROM mask n WHERE n.patient_id = m.patient_id AND n.structure_id = m.structure_id AND n.k = m.k AND n.r = m.r AND n.c = m.c + 1)::INT AS e,
  EXISTS (SELECT 1 FROM mask n WHERE n.patient_id = m.patient_id AND n.structure_id = m.structure_id AND n.k = m.k AND n.r = m.r - 1 AND n.c = m.c)::INT AS u,
  EXISTS (SELECT 1 FROM mask n WHERE n.patient_id = m.patient_id AND n.structure_id = m.structure_id AND n.k = m.k AND n.r = m.r + 1 AND n.c = m.c)::INT AS d FROM mask m)"""
)


def _points(spark, sf):
    return view(spark, sf, "contour_point")


def _spans(spark, sf):
    return raster.mask_spans(_points(spark, sf), N, N)


def g3_mask_cells(spark, sf):
    return raster.cells(_spans(spark, sf))


ASKED = """asked AS (SELECT c.c_custkey AS id, s.structure_id, s.structure_id % 7 AS patient_id, CASE c.c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END AS k,
  c.c_custkey % 31 + CAST(0.3 AS DOUBLE) AS y, (c.c_custkey * 7) % 31 + CAST(0.6 AS DOUBLE) AS x FROM {customer} c JOIN (SELECT s_suppkey AS structure_id, count(*) OVER () AS n FROM {supplier}) s ON s.structure_id = c.c_custkey % s.n)"""


def _body(cte: str) -> str:
    return cte.split(" AS (", 1)[1].rsplit(")", 1)[0]


def _asked(spark, sf):
    """ASKED with the number of structures as one row, so that points meet their structure by its id and not all structures."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("structure_id"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id")).crossJoin(F.broadcast(supplier.agg(F.count("*").alias("n"))))
    k = F.element_at(F.array(*(F.lit(v) for v in (1, 2, 3, 5))), (F.col("id") % 4 + 1).cast("int"))
    x = c.withColumn("structure_id", F.col("id") % F.col("n")).join(supplier, "structure_id")
    return x.select("id", "structure_id", (F.col("structure_id") % 7).alias("patient_id"), k.alias("k"), (F.col("id") % 31 + F.lit(0.3)).alias("y"), (F.col("id") * 7 % 31 + F.lit(0.6)).alias("x"))


def g4_points_inside(spark, sf):
    return raster.inside(_points(spark, sf), _asked(spark, sf)).select("id", "structure_id", "k", "inside")


def a9_voxel_counts(spark, sf):
    return raster.voxel_counts(_spans(spark, sf))


def g5_interior(spark, sf):
    i = raster.interior(_spans(spark, sf))
    return i.groupBy("patient_id", "structure_id", "k").agg(F.count("*").alias("cells"), F.sum(F.col("interior").cast("int")).alias("interior"))


def g8_geometry(spark, sf):
    g = raster.geometry(_spans(spark, sf), SX, SY, DZ, 0.027)
    return g.select("patient_id", "structure_id", *(F.round(c, 6).alias(c) for c in ("volume_cc", "surface_mm2", "rss", "complexity")))


def t8_containment(spark, sf):
    return raster.contained(_spans(spark, sf))


def a10_union_dilated(spark, sf):
    """Each patient's union of masks, widened by one cell."""
    return raster.dilated(raster.union_cells(_spans(spark, sf)), N, N)


def a8_centroids(spark, sf):
    return raster.centroids(_points(spark, sf), N, N)


def x18_contour_areas(spark, sf):
    a = raster.areas(_points(spark, sf))
    return a.select("patient_id", "structure_id", "k", "contour_no", F.round("signed_area", 6).alias("signed_area"), F.round("length", 6).alias("length"))


def g20_column_crossings(spark, sf):
    return raster.column_crossings(_points(spark, sf), 9.3).select("patient_id", "structure_id", "k", "no", F.round("y", 6).alias("y"))


def a14_expanded_box(spark, sf):
    return raster.expanded_box(_spans(spark, sf), 7.0, SX, SY, N, N)


def w4_slice_thickness(spark, sf):
    return raster.thickness(view(spark, sf, "slice_position"), 3.0)


def a12_median_step(spark, sf):
    return raster.median_step(view(spark, sf, "slice_position"))


def j3_nearest_slice(spark, sf):
    asked = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 7).alias("patient_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 400 * 0.125 - 3).alias("at"))
    return raster.nearest_slice(asked, view(spark, sf, "slice_position"))


def _dose(spark, sf):
    return view(spark, sf, "dose_voxel")


def a6_hottest_voxel(spark, sf):
    return voxels.hottest(_dose(spark, sf))


def t20_hottest_outside(spark, sf):
    return voxels.hottest_outside(_dose(spark, sf), _spans(spark, sf))


def s4_summed_grids(spark, sf):
    """A patient's voxels as two phases' grids, added again."""
    d = _dose(spark, sf)
    two = d.withColumn("grid_id", F.lit("a")).unionByName(d.withColumn("grid_id", F.lit("b")).withColumn("dose_gy", F.col("dose_gy") * 0.5))
    return voxels.summed(two)


def a7_view_bounds(spark, sf):
    return voxels.view_bounds(_dose(spark, sf), 30.0)


def d4_masked_summary(spark, sf):
    """Dose statistics of each structure from the voxels of its mask."""
    m = voxels.masked(_dose(spark, sf), _spans(spark, sf))
    return m.groupBy("patient_id", "structure_id").agg(F.count("*").alias("n"), F.round(F.avg("dose_gy"), 6).alias("mean_gy"), F.min("dose_gy").alias("min_gy"), F.max("dose_gy").alias("max_gy"))


SAMPLED = """asked AS (SELECT l_orderkey * 8 + l_linenumber AS id, min(CAST(floor(l_orderkey / 16384) AS BIGINT)) AS patient_id, min(l_orderkey % 16) AS k, min(l_discount * 300 - 1) AS y, min(l_tax * 400) AS x, min(l_quantity * 0.4 - 1) AS z FROM {lineitem} GROUP BY 1)"""


def _sampled(spark, sf):
    return spark.sql(_body(SAMPLED), lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))


def g9_bilinear(spark, sf):
    return voxels.bilinear(_sampled(spark, sf).drop("z"), _dose(spark, sf), N, N).select("id", F.round("dose_gy", 6).alias("dose_gy"))


def g10_nearest(spark, sf):
    return voxels.nearest(_sampled(spark, sf).drop("z"), _dose(spark, sf), N, N).select("id", F.round("dose_gy", 6).alias("dose_gy"))


def g11_between_planes(spark, sf):
    d = _dose(spark, sf)
    planes = d.groupBy("patient_id", "k").agg((F.first("k") * 1.25).alias("z"))
    return voxels.between_planes(_sampled(spark, sf).drop("k"), d, planes, N, N).select("id", F.round("dose_gy", 6).alias("dose_gy"))


def g21_gradient(spark, sf):
    return voxels.gradient(_dose(spark, sf), SX, SY).select("patient_id", "k", "r", "c", F.round("gradient", 6).alias("gradient"))


QUERIES = {
    f.__name__: f
    for f in (
        g3_mask_cells, g4_points_inside, a9_voxel_counts, g5_interior, g8_geometry, t8_containment, a10_union_dilated, a8_centroids, x18_contour_areas, g20_column_crossings, a14_expanded_box, w4_slice_thickness,
        a12_median_step, j3_nearest_slice, a6_hottest_voxel, t20_hottest_outside, s4_summed_grids, a7_view_bounds, d4_masked_summary, g9_bilinear, g10_nearest, g11_between_planes, g21_gradient,
    )
}


def _m(body: str, *more: str) -> str:
    return with_views("WITH " + MASK + body, "contour_point", *more)


def _bil(y: str, x: str) -> str:
    """Corner rows and weights of q(y, x), by arithmetic."""
    return f"""cn AS (SELECT q.*, n.a, n.b, least(floor({y})::BIGINT + n.a, {N - 1}) AS r, least(floor({x})::BIGINT + n.b, {N - 1}) AS c,
      (CASE n.a WHEN 1 THEN {y} - floor({y}) ELSE 1 - ({y} - floor({y})) END) * (CASE n.b WHEN 1 THEN {x} - floor({x}) ELSE 1 - ({x} - floor({x})) END) AS w
    FROM q CROSS JOIN (SELECT 0 AS a, 0 AS b UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1) n WHERE {y} >= 0 AND {y} <= {N - 1} AND {x} >= 0 AND {x} <= {N - 1})"""


CC = f"({SX * SY * DZ / 1000}::DOUBLE)"

ORACLE_SQL = {
    "g3_mask_cells": _m(" SELECT * FROM mask"),
    "g4_points_inside": with_views(
        "WITH " + EDGES + ", " + ASKED.format(customer="customer", supplier="supplier") + """ SELECT a.id, a.structure_id, a.k, (SELECT count(*) FROM lv WHERE lv.patient_id = a.patient_id AND lv.structure_id = a.structure_id AND lv.k = a.k
        AND (r0 > a.y) <> (r1 > a.y) AND a.x < (c1 - c0) * (a.y - r0) / (r1 - r0) + c0) % 2 = 1 AS inside FROM asked a""",
        "contour_point",
    ),
    "a9_voxel_counts": _m(" SELECT patient_id, structure_id, count(*) AS voxels FROM mask GROUP BY 1, 2"),
    "g5_interior": _m(" SELECT patient_id, structure_id, k, count(*) AS cells, sum(w * e * u * d)::BIGINT AS interior FROM side GROUP BY 1, 2, 3"),
    "g8_geometry": _m(
        f""", sl AS (SELECT patient_id, structure_id, k, count(*) * {SX}::DOUBLE * {SY} AS area, sum(2 - w - e) * {SY}::DOUBLE + sum(2 - u - d) * {SX}::DOUBLE AS edge FROM side GROUP BY 1, 2, 3),
        g AS (SELECT patient_id, structure_id, sum(area * {DZ}::DOUBLE) AS mm3, sum(edge * {DZ}::DOUBLE) + min_by(area, k) + max_by(area, k) AS s FROM sl GROUP BY 1, 2)
        SELECT patient_id, structure_id, round(mm3 / 1000, 6) AS volume_cc, round(s, 6) AS surface_mm2, round(cbrt(mm3 / 1000 / 0.027), 6) AS rss, round(s / pow(36 * pi() * mm3 * mm3, 1.0 / 3), 6) - 1 AS complexity FROM g"""
    ).replace("round(s / pow(36 * pi() * mm3 * mm3, 1.0 / 3), 6) - 1", "round(s / pow(36 * pi() * mm3 * mm3, 1.0 / 3) - 1, 6)"),
    "t8_containment": _m(" , n AS (SELECT patient_id, structure_id, count(*) AS n FROM mask GROUP BY 1, 2), j AS (SELECT a.patient_id, a.structure_id AS part, b.structure_id AS whole, count(*) AS s FROM mask a JOIN mask b ON a.patient_id = b.patient_id AND a.k = b.k AND a.r = b.r AND a.c = b.c AND a.structure_id <> b.structure_id GROUP BY 1, 2, 3) SELECT j.patient_id, part, whole FROM j JOIN n ON n.patient_id = j.patient_id AND n.structure_id = part WHERE s = n"),
    "a10_union_dilated": _m(f" SELECT DISTINCT m.patient_id, m.k, m.r + a.d AS r, m.c + b.d AS c FROM mask m CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) b WHERE m.r + a.d BETWEEN 0 AND {N - 1} AND m.c + b.d BETWEEN 0 AND {N - 1}"),
    "a8_centroids": with_views(f"SELECT patient_id, structure_id, greatest(0, least({N - 1}, round_even(avg(r), 0)::INT)) AS r, greatest(0, least({N - 1}, round_even(avg(c), 0)::INT)) AS c, round_even(avg(k), 0)::INT AS k FROM contour_point GROUP BY 1, 2", "contour_point"),
    "x18_contour_areas": with_views("WITH " + EDGES + " SELECT patient_id, structure_id, k, contour_no, round(sum(c0 * r1 - c1 * r0) / 2, 6) AS signed_area, round(sum(sqrt((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0))), 6) AS length FROM e GROUP BY 1, 2, 3, 4", "contour_point"),
    "g20_column_crossings": with_views("WITH " + EDGES + " SELECT patient_id, structure_id, k, row_number() OVER (PARTITION BY patient_id, structure_id, k ORDER BY y)::INT AS no, round(y, 6) AS y FROM (SELECT *, r0 + (9.3::DOUBLE - c0) * (r1 - r0) / (c1 - c0) AS y FROM e WHERE c0 <= 9.3::DOUBLE AND c1 > 9.3::DOUBLE OR c1 <= 9.3::DOUBLE AND c0 > 9.3::DOUBLE)", "contour_point"),
    "a14_expanded_box": _m(f" SELECT patient_id, structure_id, greatest(0, min(r) - 3) AS r0, least({N - 1}, max(r) + 3) AS r1, greatest(0, min(c) - 4) AS c0, least({N - 1}, max(c) + 4) AS c1 FROM mask GROUP BY 1, 2"),
    "w4_slice_thickness": with_views("SELECT patient_id, k, z, CASE WHEN up IS NULL AND down IS NULL THEN 3.0 WHEN up IS NULL THEN down WHEN down IS NULL THEN up ELSE (up + down) / 2 END AS thickness FROM (SELECT *, lead(z) OVER w - z AS up, z - lag(z) OVER w AS down FROM slice_position WINDOW w AS (PARTITION BY patient_id ORDER BY z))", "slice_position"),
    "a12_median_step": with_views("SELECT patient_id, quantile_cont(s, 0.5) AS median_step, min(s) AS least_step FROM (SELECT patient_id, z - lag(z) OVER (PARTITION BY patient_id ORDER BY z) AS s FROM slice_position) WHERE s > 1e-6 GROUP BY 1", "slice_position"),
    "j3_nearest_slice": with_views("WITH a AS (SELECT c_custkey % 7 AS patient_id, c_custkey AS id, (c_custkey % 400 * 0.125 - 3)::DOUBLE AS at FROM customer) SELECT a.patient_id, a.id, a.at, min_by(s.k, (abs(s.z - a.at), s.k)) AS k FROM a JOIN slice_position s USING (patient_id) GROUP BY 1, 2, 3", "slice_position"),
    "a6_hottest_voxel": with_views("SELECT patient_id, dose_gy, k, r, c FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY dose_gy DESC, k, r, c) AS n FROM dose_voxel) WHERE n = 1", "dose_voxel"),
    "t20_hottest_outside": _m(" SELECT patient_id, dose_gy, k, r, c FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY dose_gy DESC, k, r, c) AS n FROM dose_voxel v WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.patient_id = v.patient_id AND m.k = v.k AND m.r = v.r AND m.c = v.c)) WHERE n = 1", "dose_voxel"),
    "s4_summed_grids": with_views("SELECT patient_id, k, r, c, dose_gy + dose_gy * 0.5 AS dose_gy FROM dose_voxel", "dose_voxel"),
    "a7_view_bounds": with_views("SELECT patient_id, k, min(c) AS c0, max(c) AS c1, min(r) AS r0, max(r) AS r1 FROM dose_voxel WHERE dose_gy >= 30 GROUP BY 1, 2", "dose_voxel"),
    "d4_masked_summary": _m(" SELECT patient_id, structure_id, count(*) AS n, round(avg(dose_gy), 6) AS mean_gy, min(dose_gy) AS min_gy, max(dose_gy) AS max_gy FROM mask JOIN dose_voxel USING (patient_id, k, r, c) GROUP BY 1, 2", "dose_voxel"),
    "g9_bilinear": with_views("WITH " + SAMPLED.format(lineitem="lineitem") + ", q AS (SELECT * FROM asked), " + _bil("q.y", "q.x") + ", g AS (SELECT id, sum(w * dose_gy) AS d FROM cn JOIN dose_voxel v USING (patient_id, k, r, c) GROUP BY 1) SELECT a.id, round(coalesce(d, 0), 6) AS dose_gy FROM asked a LEFT JOIN g USING (id)", "dose_voxel"),
    "g10_nearest": with_views("WITH " + SAMPLED.format(lineitem="lineitem") + " SELECT a.id, round(coalesce(v.dose_gy, 0), 6) AS dose_gy FROM asked a LEFT JOIN dose_voxel v ON v.patient_id = a.patient_id AND v.k = a.k AND v.r = round_even(a.y, 0) AND v.c = round_even(a.x, 0)", "dose_voxel"),
    "g11_between_planes": with_views(
        "WITH " + SAMPLED.format(lineitem="lineitem") + """, pl AS (SELECT patient_id, k, k * 1.25::DOUBLE AS z0, lead(k) OVER w AS k1, lead(k) OVER w * 1.25::DOUBLE AS z1 FROM (SELECT DISTINCT patient_id, k FROM dose_voxel) WINDOW w AS (PARTITION BY patient_id ORDER BY k)),
        hit AS (SELECT a.id, a.patient_id, a.y, a.x, p.k AS ka, p.k1 AS kb, (a.z - z0) / (z1 - z0) AS t, row_number() OVER (PARTITION BY a.id ORDER BY z0) AS n FROM asked a JOIN pl p ON p.patient_id = a.patient_id AND a.z >= z0 AND a.z <= z1),
        q AS (SELECT id, patient_id, y, x, ka AS k, 1 - t AS wz FROM hit WHERE n = 1 UNION ALL SELECT id, patient_id, y, x, kb, t FROM hit WHERE n = 1), """ + _bil("q.y", "q.x") + """,
        g AS (SELECT id, sum(w * wz * dose_gy) AS d FROM cn JOIN dose_voxel v USING (patient_id, k, r, c) GROUP BY 1) SELECT a.id, round(coalesce(d, 0), 6) AS dose_gy FROM asked a LEFT JOIN g USING (id)""",
        "dose_voxel",
    ),
    "g21_gradient": with_views(
        f"""WITH g AS (SELECT *, lag(dose_gy) OVER a AS xa, lead(dose_gy) OVER a AS xb, coalesce(lead(c) OVER a, c) - coalesce(lag(c) OVER a, c) AS nx, lag(dose_gy) OVER b AS ya, lead(dose_gy) OVER b AS yb, coalesce(lead(r) OVER b, r) - coalesce(lag(r) OVER b, r) AS ny
          FROM dose_voxel WINDOW a AS (PARTITION BY patient_id, k, r ORDER BY c), b AS (PARTITION BY patient_id, k, c ORDER BY r)),
        s AS (SELECT *, CASE WHEN nx > 0 THEN (coalesce(xb, dose_gy) - coalesce(xa, dose_gy)) / (nx * {SX}::DOUBLE) ELSE 0 END AS gx, CASE WHEN ny > 0 THEN (coalesce(yb, dose_gy) - coalesce(ya, dose_gy)) / (ny * {SY}::DOUBLE) ELSE 0 END AS gy FROM g)
        SELECT patient_id, k, r, c, round(sqrt(gx * gx + gy * gy), 6) AS gradient FROM s""",
        "dose_voxel",
    ),
}
