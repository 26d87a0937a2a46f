"""Queries over the further operators, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extras, plans, raster, targets
from ..sources.standins import view, with_views
from . import dvh_queries as dq
from . import geometry_queries as gq

P = "patient_id"


def g2_round_trip(spark, sf):
    """Grid to patient coordinates and back, in a tilted plane."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    q = o.select("o_orderkey", (F.col("o_orderkey") % 100 * 0.5).alias("r"), (F.col("o_custkey") % 90 * 0.25).alias("c"), F.array(F.lit(-10.0), F.lit(4.0), F.col("o_orderkey") % 7 * 3.0).alias("origin"), F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0)).alias("across"), F.array(F.lit(-4.0), F.lit(3.0), F.lit(0.0)).alias("down"))
    x = extras.to_grid(extras.to_patient(q, 2.0, 2.5), 2.0, 2.5)
    return x.select("o_orderkey", *(F.round(F.element_at("xyz", i + 1), 6).alias(n) for i, n in enumerate("xyz")), F.round("row", 6).alias("row"), F.round("column", 6).alias("column"))


def g14_filled_masks(spark, sf):
    c = raster.cells(gq._spans(spark, sf))
    return extras.filled(c.select("patient_id", "structure_id", F.col("k").cast("bigint").alias("k"), "r", "c"), gq.N, gq.N)


def a11_slice_range(spark, sf):
    e = view(spark, sf, "contour_point").groupBy(P).agg((F.min("k") * 2.5).alias("z0"), (F.max("k") * 2.5).alias("z1"))
    return extras.slice_range(view(spark, sf, "slice_position"), e, 10.0)


def j8_overlapping_boxes(spark, sf):
    return extras.overlapping_boxes(extras.boxes(gq._spans(spark, sf)))


def s6_prescriptions(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    q = o.groupBy(F.col("o_custkey").alias("plan_uid")).agg(F.collect_list(F.round(F.col("o_totalprice") / 10000, 2)).alias("target_doses"), F.collect_list((F.col("o_orderkey") % 9).cast("bigint")).alias("group_fractions"), F.array(F.lit("boost"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("to ptv  "), F.col("o_custkey").cast("string"))).otherwise("other")).alias("descriptions"))
    return extras.prescriptions(q)


def p10_required_structures(spark, sf):
    g = view(spark, sf, "goal").select(P, "structure")
    s = view(spark, sf, "structure").select(P, F.col("structure").alias("name_norm"))
    return extras.required_structures(g, plans.listable(s))


def s2_assembled_slices(spark, sf):
    s = view(spark, sf, "slice_position").select(P, F.col("z").alias("position"), F.lit(1.5).cast("double").alias("slope"), F.lit(-10.0).cast("double").alias("intercept"), (F.col("k") * 3.0).alias("raw"))
    return extras.assembled(s, 3.0)


def t17_target_rows(spark, sf):
    """Which texts a target row has; the numbers in them are compared by other queries."""
    totals = dq._curves(spark, sf)
    q = totals.withColumn("reference_gy", F.col("patient_id") % 9 * 10.0 - 5)
    rows = targets.table_rows(targets.measured(q, dq.W))
    return rows.select(P, "structure", "reference_text", F.regexp_replace("coverage_text", "^[0-9.]+%", "n%").alias("coverage_shape"), (F.col("minimum_text") != "").alias("has_minimum"))


def s18_need_recompute(spark, sf):
    totals = dq._curves(spark, sf)
    q = totals.withColumn("reference_gy", F.col("patient_id") % 9 * 10.0 - 5)
    rows = targets.table_rows(targets.measured(q, dq.W)).withColumn("notes_text", F.when(F.col("patient_id") % 4 == 0, "").otherwise("noted"))
    return targets.need_recompute(rows, F.col("patient_id") % 2 == 0)


def t18_saved_notes(spark, sf):
    made = dq._stored(spark, sf)
    typed = made.withColumn("note_text", F.when(F.col("patient_id") % 3 == 0, F.col("note_text")).when(F.col("patient_id") % 3 == 1, F.concat("note_text", F.lit("    mine "))).otherwise(" other "))
    return targets.saved_notes(made, typed)


def x12_note_keys(spark, sf):
    g = view(spark, sf, "goal")
    return g.select("goal_no", t.note_key(t.normal_name(F.col("structure")), F.col("metric"), F.col("comparator"), F.col("value_text")).alias("note_key"), t.target_note_key(F.trim("structure"), F.when(F.col("goal_no") % 2 == 0, F.col("set_id"))).alias("target_key"))


def x8_number_texts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", t.number_text(F.col("p_size") / 8).alias("eighths"), t.number_text(F.col("p_size").cast("double")).alias("whole"))


def u3_isodose_volumes(spark, sf):
    """T12 with unit weights: each structure's volume at or above several doses, in one pass."""
    from ..operators import voxels

    m = voxels.masked(view(spark, sf, "dose_voxel"), gq._spans(spark, sf)).withColumn("weight", F.lit(1.0))
    return voxels.thresholds(m, 0.125, [5.0, 15.0, 25.0, 35.0])


QUERIES = {f.__name__: f for f in (g2_round_trip, g14_filled_masks, a11_slice_range, j8_overlapping_boxes, s6_prescriptions, p10_required_structures, s2_assembled_slices, t17_target_rows, s18_need_recompute, t18_saved_notes, x12_note_keys, x8_number_texts, u3_isodose_volumes)}

REF = "(patient_id % 9 * 10.0 - 5)::DOUBLE"
ORACLE_SQL = {
    "g2_round_trip": """WITH q AS (SELECT o_orderkey, o_orderkey % 100 * 0.5::DOUBLE AS r, o_custkey % 90 * 0.25::DOUBLE AS c, o_orderkey % 7 * 3.0::DOUBLE AS z FROM orders)
        SELECT o_orderkey, round(-10 + c * 2 * 0.6 - r * 2.5 * 0.8, 6) AS x, round(4 + c * 2 * 0.8 + r * 2.5 * 0.6, 6) AS y, round(z, 6) AS z, round(r, 6) AS "row", round(c, 6) AS "column" FROM q""",
    "g14_filled_masks": gq._m(f""", bg AS (SELECT px.* FROM px ANTI JOIN mask m ON m.patient_id = px.patient_id AND m.structure_id = px.structure_id AND m.k = px.k AND m.r = px.r AND m.c = px.c),
        fl AS (SELECT * FROM bg)
        SELECT patient_id, structure_id, k::BIGINT AS k, r, c FROM mask
        UNION SELECT b.patient_id, b.structure_id, b.k::BIGINT, b.r, b.c FROM bg b WHERE EXISTS (SELECT 1 FROM mask m WHERE m.patient_id = b.patient_id AND m.structure_id = b.structure_id AND m.k = b.k AND m.r = b.r AND m.c < b.c)
          AND EXISTS (SELECT 1 FROM mask m WHERE m.patient_id = b.patient_id AND m.structure_id = b.structure_id AND m.k = b.k AND m.r = b.r AND m.c > b.c)
          AND EXISTS (SELECT 1 FROM mask m WHERE m.patient_id = b.patient_id AND m.structure_id = b.structure_id AND m.k = b.k AND m.c = b.c AND m.r < b.r)
          AND EXISTS (SELECT 1 FROM mask m WHERE m.patient_id = b.patient_id AND m.structure_id = b.structure_id AND m.k = b.k AND m.c = b.c AND m.r > b.r)"""),
    "a11_slice_range": with_views("WITH e AS (SELECT patient_id, min(k) * 2.5 AS z0, max(k) * 2.5 AS z1 FROM contour_point GROUP BY 1) SELECT s.patient_id, min(k) AS k0, max(k) AS k1 FROM slice_position s JOIN e USING (patient_id) WHERE z BETWEEN z0 - 10 AND z1 + 10 GROUP BY 1", "contour_point", "slice_position"),
    "j8_overlapping_boxes": gq._m(", b AS (SELECT patient_id, structure_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM mask GROUP BY 1, 2) SELECT a.patient_id, a.structure_id, b.structure_id AS other FROM b a JOIN b ON a.patient_id = b.patient_id AND a.structure_id < b.structure_id AND a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1"),
    "s6_prescriptions": "SELECT o_custkey AS plan_uid, max(round(o_totalprice / 10000, 2)) AS rx_gy, sum(o_orderkey % 9)::BIGINT AS fractions, CASE WHEN o_custkey % 2 = 0 THEN 'PTV ' || o_custkey::VARCHAR ELSE '' END AS target_norm FROM orders GROUP BY 1",
    "p10_required_structures": with_views(r"SELECT DISTINCT s.patient_id, s.structure AS name_norm FROM structure s JOIN goal g ON g.patient_id = s.patient_id AND upper(trim(regexp_replace(g.structure, '\s+', ' ', 'g'))) = s.structure", "structure", "goal"),
    "s2_assembled_slices": with_views("WITH o AS (SELECT *, (row_number() OVER w - 1)::INT AS n, z - lag(z) OVER w AS gap FROM slice_position WINDOW w AS (PARTITION BY patient_id ORDER BY z)), m AS (SELECT patient_id, abs(quantile_cont(gap, 0.5)) AS step FROM o GROUP BY 1) SELECT patient_id, n AS k, z AS position, coalesce(step, 3.0) AS step, k * 3.0::DOUBLE * 1.5::DOUBLE - 10 AS value FROM o JOIN m USING (patient_id)", "slice_position"),
    "t17_target_rows": dq._sample(f" SELECT patient_id, structure, CASE WHEN {REF} > 0 THEN (patient_id % 9 * 10 - 5)::VARCHAR || '.00' ELSE '' END AS reference_text, CASE WHEN {REF} > 0 THEN 'n% @ ' || (patient_id % 9 * 10 - 5)::VARCHAR || '.00 Gy' ELSE '' END AS coverage_shape, {REF} > 0 AS has_minimum FROM tot"),
    "s18_need_recompute": dq._sample(f" SELECT patient_id, bool_or({REF} <= 0 OR patient_id % 4 = 0) AS recompute FROM tot GROUP BY 1"),
    "t18_saved_notes": with_views("WITH " + dq.STORED + " SELECT patient_id, note_key, CASE patient_id % 3 WHEN 1 THEN 'mine' ELSE 'other' END AS note_text FROM stored WHERE patient_id % 3 <> 0", "goal"),
    "x12_note_keys": with_views(r"SELECT goal_no, concat_ws('||', upper(trim(regexp_replace(structure, '\s+', ' ', 'g'))), trim(metric), trim(comparator), trim(value_text)) AS note_key, CASE WHEN goal_no % 2 = 0 THEN 'TARGET||' || set_id || '||' || trim(structure) ELSE 'TARGET||' || trim(structure) END AS target_key FROM goal", "goal"),
    "x8_number_texts": "SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN (p_size // 8)::VARCHAR ELSE (p_size / 8)::VARCHAR END AS eighths, p_size::VARCHAR AS whole FROM part",
    "u3_isodose_volumes": gq._m(" SELECT patient_id, structure_id, " + ", ".join(f"sum(CASE WHEN dose_gy >= {x} THEN 0.125::DOUBLE ELSE 0 END) AS v{i}" for i, x in enumerate((5, 15, 25, 35))) + " FROM mask JOIN dose_voxel USING (patient_id, k, r, c) GROUP BY 1, 2", "dose_voxel"),
}
