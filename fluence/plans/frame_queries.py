"""Queries over frames, blocks and target surroundings, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, raster
from ..sources.standins import view, with_views
from . import geometry_queries as gq

P = "patient_id"
N, SX, SY, DZ = gq.N, gq.SX, gq.SY, gq.DZ
ACROSS, DOWN = [0.6, 0.8, 0.0], [-0.8, 0.6, 0.0]
DOSE = [0.8, 0.6, 0.0], [-0.6, 0.8, 0.0], 3.0, 2.0

# vertices in patient coordinates; some polygons have two points, some structures no name
XYZ = """vertex AS (SELECT patient_id, structure_id, k * 10 + contour_no AS contour_no, i,
    CASE WHEN structure_id % 4 = 0 THEN ' ' ELSE 'S' || CAST(structure_id AS VARCHAR(20)) END AS name,
    CASE WHEN structure_id % 3 = 0 THEN NULL ELSE '0,0,' || CAST(structure_id % 256 AS VARCHAR(20)) END AS colour,
    CAST(10 + 1.2 * c - 2.0 * r AS DOUBLE) AS x, CAST(1.6 * c + 1.5 * r - 5 AS DOUBLE) AS y, CAST(k * 2.6 - 0.4 AS DOUBLE) AS z
    FROM {contour_point} WHERE NOT (structure_id % 11 = 3 AND i >= 2))"""
# evenly spaced slices for every second patient
PLACED = """placed AS (SELECT patient_id, k, CASE WHEN patient_id % 2 = 0 THEN CAST(k * 2.5 AS DOUBLE) ELSE z END AS z, CAST(10 + k AS DOUBLE) AS ox FROM {slice_position})"""
# frames of grids, a few of which differ from the others by little or by much
FRAMES = """frame AS (SELECT c_nationkey AS patient_id, c_custkey AS grid_id, CASE WHEN c_custkey % 17 = 0 THEN 33 ELSE 32 END AS cols,
    CAST(c_custkey % 5 * 0.0001 + CASE WHEN c_custkey % 13 = 0 THEN 0.01 ELSE 0 END AS DOUBLE) AS ox,
    CAST(3 + CASE WHEN c_custkey % 19 = 0 THEN 0.001 ELSE 0 END AS DOUBLE) AS dz, CAST(CASE WHEN c_custkey % 23 = 0 THEN 0.001 ELSE 0 END AS DOUBLE) AS tilt FROM {customer})"""


def _vertices(spark, sf):
    v = spark.sql(gq._body(XYZ), contour_point=view(spark, sf, "contour_point"))
    return v.select(P, "structure_id", "contour_no", "i", "name", "colour", F.array("x", "y", "z").alias("xyz"))


def _placed(spark, sf):
    s = spark.sql(gq._body(PLACED), slice_position=view(spark, sf, "slice_position"))
    return s.select(P, "k", "z", F.array("ox", F.lit(-5.0), "z").alias("origin"))


def s5_contours(spark, sf):
    c = frames.contours(_vertices(spark, sf), _placed(spark, sf), ACROSS, DOWN, SX, SY)
    return c.select(P, "structure_id", "k", "contour_no", "i", "name", "colour", F.round("r", 6).alias("r"), F.round("c", 6).alias("c"))


def g7_slice_transforms(spark, sf):
    t = frames.slice_transforms(_placed(spark, sf), (ACROSS, DOWN, SX, SY), DOSE, [2.0, 3.0, -4.0])
    return t.select(P, "k", *(F.round(c, 6).alias(c) for c in ("position", "m00", "m01", "m10", "m11", "o0", "o1")))


#: sample places off the grid's lines, so that rounding in the frame moves none over an edge
OFF_LINES = gq.SAMPLED.replace("l_discount * 300 - 1", "l_discount * 300 - 0.997").replace("l_tax * 400", "l_tax * 400 + 0.003")


def g12_sampled_at(spark, sf):
    a = spark.sql(gq._body(OFF_LINES), lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    (a0, a1, _), (d0, d1, _), x, y = ACROSS, DOWN, F.col("x") * SX, F.col("y") * SY
    xyz = F.array(x * a0 + y * d0 + 7.0, x * a1 + y * d1 - 3.0, F.col("z").cast("double"))
    d = gq._dose(spark, sf)
    planes = d.groupBy(P, "k").agg((F.first("k") * 1.25).alias("z"))
    got = frames.sampled_at(a.select(P, "id", xyz.alias("xyz")), d, planes, (ACROSS, DOWN, SX, SY), [7.0, -3.0, 0.0], N, N)
    return got.select("id", F.round("dose_gy", 6).alias("dose_gy"))


def a7_orthogonal_bounds(spark, sf):
    return frames.orthogonal_bounds(gq._dose(spark, sf), 45.0, SX, SY, DZ)


def g19_side_plane(spark, sf):
    p = frames.side_plane(gq._dose(spark, sf), 5, SY, DZ)
    return p.select(P, "line", "r", F.round("dose_gy", 6).alias("dose_gy"))


def g22_blocks(spark, sf):
    s = gq._spans(spark, sf)
    box = raster.expanded_box(s, 3.0, SX, SY, N, N).join(s.groupBy(P, "structure_id").agg(F.min("k").cast("bigint").alias("k0"), F.max("k").cast("bigint").alias("k1")), [P, "structure_id"])
    return frames.blocks(gq._dose(spark, sf), box)


def w6_running_length(spark, sf):
    x = frames.running_length(view(spark, sf, "contour_point"))
    return x.select(P, "structure_id", "k", "contour_no", "i", F.round("along", 6).alias("along"), F.round("length", 6).alias("length"))


def u2_without_nested(spark, sf):
    return frames.without_nested(gq._spans(spark, sf))


def t22_target_doses(spark, sf):
    d = gq._dose(spark, sf)
    grids = d.withColumn("grid_id", F.lit("a")).unionByName(d.withColumn("grid_id", F.lit("b")).withColumn("dose_gy", F.col("dose_gy") * 0.5))
    spans = gq._spans(spark, sf)
    key = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("combined")), (F.col("structure_id") % 3 + 1).cast("int"))
    x = frames.target_doses(grids, spans.select(P, "structure_id").distinct().withColumn("source_key", key), spans)
    return x.groupBy(P, "structure_id", "source_key").agg(F.count("*").alias("n"), F.round(F.avg("dose_gy"), 6).alias("mean_gy"), F.max("dose_gy").alias("max_gy"))


def s4_geometry_faults(spark, sf):
    f = spark.sql(gq._body(FRAMES), customer=spark.read.parquet(f"{sf}/customer.parquet"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return frames.geometry_faults(f.select(
        P, "grid_id", F.array(F.lit(16), F.lit(32), "cols").alias("shape"), F.array("ox", F.lit(-5.0), F.lit(2.0)).alias("origin"),
        F.array(F.lit(SX), F.lit(SY), "dz").alias("spacing"), F.array(one, zero, zero, zero, one, "tilt").alias("orientation"),
    ))


QUERIES = {
    f.__name__: f
    for f in (
        s5_contours, g7_slice_transforms, g12_sampled_at, a7_orthogonal_bounds, g19_side_plane, g22_blocks, w6_running_length,
        u2_without_nested, t22_target_doses, s4_geometry_faults,
    )
}

_DOSE_MEAN = "SELECT patient_id, structure_id, source_key, count(*) AS n, round(avg(dose_gy * f), 6) AS mean_gy, max(dose_gy * f) AS max_gy"

ORACLE_SQL = {
    "s5_contours": with_views(
        "WITH " + XYZ.format(contour_point="contour_point") + ",\n" + PLACED.format(slice_position="slice_position") + f""",
        big AS (SELECT patient_id, structure_id, contour_no, avg(z) AS pos FROM vertex GROUP BY 1, 2, 3 HAVING count(*) >= 3),
        near AS (SELECT b.patient_id, structure_id, contour_no, arg_min(k, (abs(p.z - pos), k)) AS k FROM big b JOIN placed p USING (patient_id) GROUP BY 1, 2, 3)
        SELECT v.patient_id, v.structure_id, p.k, v.contour_no, v.i, CASE WHEN trim(name) = '' THEN 'ROI ' || v.structure_id ELSE name END AS name,
          coalesce(colour, '255,255,0') AS colour, round(((x - ox) * -0.8::DOUBLE + (y + 5) * 0.6::DOUBLE) / {SY}::DOUBLE, 6) AS r,
          round(((x - ox) * 0.6::DOUBLE + (y + 5) * 0.8::DOUBLE) / {SX}::DOUBLE, 6) AS c
        FROM vertex v JOIN near n USING (patient_id, structure_id, contour_no) JOIN placed p ON p.patient_id = v.patient_id AND p.k = n.k""",
        "contour_point", "slice_position",
    ),
    "g7_slice_transforms": with_views(
        "WITH " + PLACED.format(slice_position="slice_position") + f""" SELECT patient_id, k, round(z, 6) AS position,
        round(0.96::DOUBLE * {SY} / 2, 6) AS m00, round(0.28::DOUBLE * {SX} / 2, 6) AS m01, round(-0.28::DOUBLE * {SY} / 3, 6) AS m10, round(0.96::DOUBLE * {SX} / 3, 6) AS m11,
        round(((ox - 2) * -0.6::DOUBLE + (-5 - 3) * 0.8::DOUBLE) / 2, 6) AS o0, round(((ox - 2) * 0.8::DOUBLE + (-5 - 3) * 0.6::DOUBLE) / 3, 6) AS o1 FROM placed""",
        "slice_position",
    ),
    "g12_sampled_at": gq.ORACLE_SQL["g11_between_planes"].replace(gq.SAMPLED.format(lineitem="lineitem"), OFF_LINES.format(lineitem="lineitem")),
    "a7_orthogonal_bounds": with_views(
        f"""SELECT patient_id, min(r) AS side_0, max(r) AS side_1, min(k) * ({DZ}::DOUBLE / {SY}) AS side_top, max(k) * ({DZ}::DOUBLE / {SY}) AS side_bottom,
        min(c) AS front_0, max(c) AS front_1, min(k) * ({DZ}::DOUBLE / {SX}) AS front_top, max(k) * ({DZ}::DOUBLE / {SX}) AS front_bottom
        FROM dose_voxel WHERE dose_gy >= 45 GROUP BY 1""",
        "dose_voxel",
    ),
    "g19_side_plane": with_views(
        f"""WITH pl AS (SELECT * FROM dose_voxel WHERE c = 5), n AS (SELECT patient_id, max(k) + 1 AS n, greatest(1, round_even((max(k) + 1) * ({DZ}::DOUBLE / {SY}), 0)::BIGINT) AS o FROM pl GROUP BY 1),
        l AS (SELECT *, CASE WHEN o > 1 THEN line * (n - 1) / (o - 1)::DOUBLE ELSE 0 END AS pos FROM (SELECT *, unnest(range(o)) AS line FROM n))
        SELECT l.patient_id, line, r, round(sum(dose_gy * greatest(0, 1 - abs(pl.k - pos))), 6) AS dose_gy FROM l JOIN pl ON pl.patient_id = l.patient_id AND abs(pl.k - pos) < 1 GROUP BY 1, 2, 3""",
        "dose_voxel",
    ),
    "g22_blocks": gq._m(
        f""", bx AS (SELECT patient_id, structure_id, min(k) AS k0, max(k) AS k1, greatest(0, min(r) - 2) AS r0, least({N - 1}, max(r) + 2) AS r1,
          greatest(0, min(c) - 2) AS c0, least({N - 1}, max(c) + 2) AS c1 FROM mask GROUP BY 1, 2)
        SELECT bx.patient_id, structure_id, v.k - k0 AS k, v.r - r0 AS r, v.c - c0 AS c, dose_gy FROM bx JOIN dose_voxel v
          ON v.patient_id = bx.patient_id AND v.k BETWEEN k0 AND k1 AND v.r BETWEEN r0 AND r1 AND v.c BETWEEN c0 AND c1""",
        "dose_voxel",
    ),
    "w6_running_length": with_views(
        "WITH " + gq.EDGES + """, s AS (SELECT a.*, (SELECT coalesce(sum(sqrt(pow(y.r - x.r, 2) + pow(y.c - x.c, 2))), 0) FROM contour_point x JOIN contour_point y
            ON y.patient_id = x.patient_id AND y.structure_id = x.structure_id AND y.k = x.k AND y.contour_no = x.contour_no AND y.i = x.i + 1
            WHERE x.patient_id = a.patient_id AND x.structure_id = a.structure_id AND x.k = a.k AND x.contour_no = a.contour_no AND y.i <= a.i) AS along FROM contour_point a),
        t AS (SELECT patient_id, structure_id, k, contour_no, sum(sqrt(pow(r1 - r0, 2) + pow(c1 - c0, 2))) AS length FROM e GROUP BY 1, 2, 3, 4)
        SELECT patient_id, structure_id, k, contour_no, i, round(along, 6) AS along, round(length, 6) AS length FROM s JOIN t USING (patient_id, structure_id, k, contour_no)""",
        "contour_point",
    ),
    "u2_without_nested": gq._m(
        """, n AS (SELECT patient_id, structure_id, count(*) AS n FROM mask GROUP BY 1, 2),
        j AS (SELECT a.patient_id, a.structure_id AS part, b.structure_id AS whole, count(*) AS s FROM mask a JOIN mask b
          ON a.patient_id = b.patient_id AND a.k = b.k AND a.r = b.r AND a.c = b.c AND a.structure_id <> b.structure_id GROUP BY 1, 2, 3),
        t AS (SELECT j.* FROM j JOIN n ON n.patient_id = j.patient_id AND n.structure_id = part WHERE s = n)
        SELECT * FROM mask m WHERE NOT EXISTS (SELECT 1 FROM t JOIN mask p ON p.patient_id = t.patient_id AND p.structure_id = t.part
          WHERE t.patient_id = m.patient_id AND t.whole = m.structure_id AND p.k = m.k AND p.r = m.r AND p.c = m.c)"""
    ),
    "t22_target_doses": gq._m(
        """, x AS (SELECT m.patient_id, m.structure_id, CASE m.structure_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'combined' END AS source_key,
          CASE m.structure_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 1.5 END::DOUBLE AS f, dose_gy FROM mask m JOIN dose_voxel USING (patient_id, k, r, c)) """
        + _DOSE_MEAN.replace("max(dose_gy * f)", "max(CASE WHEN f = 1.5 THEN dose_gy + dose_gy * 0.5 ELSE dose_gy * f END)") + " FROM x GROUP BY 1, 2, 3",
        "dose_voxel",
    ),
    "s4_geometry_faults": "WITH " + FRAMES.format(customer="customer") + """, b AS (SELECT *, first_value(cols) OVER w AS rc, first_value(ox) OVER w AS ro, first_value(dz) OVER w AS rz, first_value(tilt) OVER w AS rt
        FROM frame WINDOW w AS (PARTITION BY patient_id ORDER BY grid_id))
        SELECT patient_id, grid_id, CASE WHEN cols <> rc THEN 'shape' WHEN abs(ox - ro) > 1e-3 + 1e-5 * abs(ox) THEN 'origin' WHEN abs(dz - rz) > 1e-6 + 1e-5 * abs(dz) THEN 'spacing'
          WHEN abs(tilt - rt) > 1e-6 + 1e-5 * abs(tilt) THEN 'orientation' END AS fault FROM b""",
}
