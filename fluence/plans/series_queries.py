"""Queries over series and grids by orientation and over what targets hold, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, series, targets
from ..sources.standins import view
from . import surface_queries as sq

P, S = sq.P, sq.S


def s2_oriented_series(spark, sf):
    """A customer's orders as slices of an oblique series: the normal is (-0.8, 0.6, 0), or the third axis for every third series."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    flat = F.col("o_custkey") % 3 == 0
    vector = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    key = F.col("o_orderkey").cast("double")
    files = o.select(
        F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("file_no"),
        F.array(key * 0.5, F.col("o_orderkey") % 7 * 0.01, -key * 1.5).alias("origin"),
        F.when(flat, vector(2, 0, 0)).otherwise(vector(3, 4, 0)).alias("across"), F.when(flat, vector(0, 5, 0)).otherwise(vector(0, 0, -1)).alias("down"),
        F.when(F.col("o_orderkey") % 2 == 0, 2.5).alias("thickness_mm"), F.when(F.col("o_orderkey") % 4 > 0, 1.5).alias("slope"), F.when(F.col("o_orderkey") % 5 > 0, -10.0).alias("intercept"),
        F.array(F.col("o_totalprice"), key).alias("values"),
    )
    x = series.series_from_orientation(files, ["series"])
    return x.select("series", F.col("k").cast("long").alias("k"), "file_no", F.round("position", 6).alias("position"), F.round("spacing_mm", 6).alias("spacing_mm"), F.round(F.col("values")[0], 4).alias("first"), F.round(F.col("values")[1], 4).alias("second"))


def s3_frame_grids(spark, sf):
    """A customer's orders as frames of an oblique grid, a third of the grids with the default offsets."""
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    n = F.size("x")
    uneven = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * 2.5 + i % 3 * 0.25)
    key = F.col("o_custkey").cast("double")
    vector = lambda *v: F.array(*(F.lit(float(c)) for c in v))
    g = o.select(
        F.col("o_custkey").alias("grid"), F.array(key, key * 2, F.lit(-4.0)).alias("origin"), vector(3, 4, 0).alias("across"), vector(0, 0, -2).alias("down"),
        F.when(F.col("o_custkey") % 3 > 0, uneven).alias("offsets"), F.when(F.col("o_custkey") % 2 > 0, 0.001).alias("scaling"), F.transform("x", lambda v: F.array(v["o_totalprice"])).alias("frames"),
    )
    x = series.grid_from_frames(g, ["grid"])
    return x.select("grid", F.col("k").cast("long").alias("k"), *(F.round(F.col("origin")[i], 6).alias(c) for i, c in enumerate("xyz")), F.round("position", 6).alias("position"), F.round("spacing_mm", 6).alias("spacing_mm"), F.round(F.col("dose_gy")[0], 6).alias("dose_gy"))


def t9_nested_rows(spark, sf):
    """Targets with what they hold; lesions of even patients and cords are picked by hand."""
    spans, every = sq._spans(spark, sf), view(spark, sf, "target_structure")
    s = every.withColumn("listable", F.lit(True)).withColumn("nested", F.regexp_like("name_norm", F.lit("^(PTV|GTV|CTV)"))).withColumn("manual", ((F.col("role") == 4) & (F.col("patient_id") % 2 == 0)) | (F.col("role") == 6))
    held = raster.contained(spans)
    return targets.nested_rows(s, sq._targets(spark, sf), held, raster.voxel_counts(spans)).select(P, "target", "part", "name_norm", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (s2_oriented_series, s3_frame_grids, t9_nested_rows)}

ORACLE_SQL = {
    "s2_oriented_series": """WITH p AS (SELECT o_custkey AS series, o_orderkey AS file_no, CASE WHEN o_custkey % 3 = 0 THEN -o_orderkey * 1.5::DOUBLE ELSE -0.8::DOUBLE * (o_orderkey * 0.5::DOUBLE) + 0.6::DOUBLE * (o_orderkey % 7 * 0.01::DOUBLE) END AS position,
          o_totalprice AS v, o_orderkey::DOUBLE AS w, CASE WHEN o_orderkey % 4 > 0 THEN 1.5::DOUBLE ELSE 1 END AS slope, CASE WHEN o_orderkey % 5 > 0 THEN -10.0::DOUBLE ELSE 0 END AS cut FROM orders),
        q AS (SELECT *, row_number() OVER o - 1 AS k, position - lag(position) OVER o AS gap FROM p WINDOW o AS (PARTITION BY series ORDER BY position, file_no)),
        st AS (SELECT series, coalesce(abs(quantile_cont(gap, 0.5)), CASE WHEN min(file_no) % 2 = 0 THEN 2.5::DOUBLE ELSE 1 END) AS spacing_mm FROM q GROUP BY 1)
        SELECT series, k, file_no, round(position, 6) AS position, round(spacing_mm, 6) AS spacing_mm, round(v * slope + cut, 4) AS first, round(w * slope + cut, 4) AS second FROM q JOIN st USING (series)""",
    "s3_frame_grids": """WITH f AS (SELECT o_custkey AS grid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_totalprice AS v FROM orders),
        g AS (SELECT *, CASE WHEN grid % 3 > 0 THEN k * 2.5::DOUBLE + k % 3 * 0.25::DOUBLE ELSE k::DOUBLE END AS shift FROM f),
        d AS (SELECT *, shift - lag(shift) OVER (PARTITION BY grid ORDER BY k) AS gap FROM g), st AS (SELECT grid, coalesce(abs(quantile_cont(gap, 0.5)), 1) AS spacing_mm FROM d GROUP BY 1)
        SELECT grid, k, round(grid - 0.8::DOUBLE * shift, 6) AS x, round(grid * 2 + 0.6::DOUBLE * shift, 6) AS y, -4.0::DOUBLE AS z, round(-0.8::DOUBLE * grid + 0.6::DOUBLE * (grid * 2) + shift, 6) AS position, round(spacing_mm, 6) AS spacing_mm,
          round(v * CASE WHEN grid % 2 > 0 THEN 0.001::DOUBLE ELSE 1 END, 6) AS dose_gy FROM d JOIN st USING (grid)""",
    "t9_nested_rows": sq._q(
        """, pt AS (SELECT *, role = 4 AND patient_id % 2 = 0 OR role = 6 AS manual FROM target_structure WHERE regexp_matches(name_norm, '^(PTV|GTV|CTV)') OR role = 6),
        x AS (SELECT h.patient_id, t.structure_id AS target, p.structure_id AS part, p.name_norm, p.rx_gy, p.manual, row_number() OVER (PARTITION BY h.patient_id, p.structure_id ORDER BY cnt.n, t.name_norm, t.structure_id) AS no
          FROM held h JOIN tg t ON t.patient_id = h.patient_id AND t.structure_id = h.whole JOIN cnt ON cnt.patient_id = h.patient_id AND cnt.structure_id = h.whole JOIN pt p ON p.patient_id = h.patient_id AND p.structure_id = h.part WHERE p.name_norm <> t.name_norm)
        SELECT patient_id, target, part, name_norm, row_number() OVER (PARTITION BY patient_id, target ORDER BY CASE substr(name_norm, 1, 3) WHEN 'PTV' THEN 0 WHEN 'GTV' THEN 1 WHEN 'CTV' THEN 2 ELSE 3 END, rx_gy NULLS LAST, name_norm, part) AS place
        FROM x WHERE NOT manual OR no = 1"""
    ),
}
