"""Queries over sampling and targets, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plans, raster, sampling, targets, voxels
from ..sources.standins import view, with_views
from . import dvh_queries as dq
from . import geometry_queries as gq
from . import plan_queries as pq

P = "patient_id"
SCALE, SUB, W = 2, 3, 0.5
N = gq.N


def g6_occupancy(spark, sf):
    return sampling.occupancy(view(spark, sf, "contour_point"), SCALE, N, N, SUB).select("patient_id", "structure_id", "k", "r", "c", F.round("share", 6).alias("share"))


def x15_oversampling(spark, sf):
    g = raster.geometry(gq._spans(spark, sf), gq.SX, gq.SY, gq.DZ, 0.0001)
    m = g.select("patient_id", "structure_id", F.round("rss", 6).alias("rss"), F.round("complexity", 6).alias("complexity"))
    return sampling.oversampling(m).select("patient_id", "structure_id", F.round("power", 6).alias("power"), "factor")


def g13_resampled(spark, sf):
    d = view(spark, sf, "dose_voxel")
    planes = d.groupBy("patient_id", "k").agg((F.first("k") * 1.25).alias("z"))
    out = sampling.resampled(d, planes, view(spark, sf, "slice_position"), N, N, 0.5, 1.25, 0.75, 0.5)
    return out.groupBy("patient_id", "k").agg(F.count("*").alias("n"), F.round(F.sum("dose_gy"), 4).alias("dose"), F.round(F.max("dose_gy") + 1e-9, 6).alias("top"))


def t7_target_metrics(spark, sf):
    totals = dq._curves(spark, sf)
    return targets.measured(totals.withColumn("reference_gy", F.col("patient_id") % 9 * 10.0 - 5), W).select(P, "structure", "reference_gy", "min_gy", "max_gy", F.round("coverage_pct", 6).alias("coverage_pct"))


def t9_nested_targets(spark, sf):
    return raster.parents(gq._spans(spark, sf))


def t10_competing_targets(spark, sf):
    return raster.competitors(gq._spans(spark, sf))


def t3_fraction_counts(spark, sf):
    names = plans.sorted_targets(pq._named(spark, sf)).select(P, "name_norm").distinct()
    own = pq._assigned(spark, sf).groupBy(P, "name_norm").agg(F.min("plan_uid").alias("plan_uid"))
    return targets.fraction_counts(names, view(spark, sf, "plan_phase"), own)


def t4_default_reference(spark, sf):
    """T4 over the assignment of T1 and T2, and the dose that T5 infers from each target's smallest dose."""
    names = plans.sorted_targets(pq._named(spark, sf)).select(P, "name_norm").distinct()
    own = pq._assigned(spark, sf).groupBy(P, "name_norm").agg(F.max("phase_rx_gy").alias("phase_rx_gy"))
    guess = plans.inferred_srs(names.filter("patient_id % 3 = 0").withColumn("min_gy", 15.0 + (F.length("name_norm") * 7 + F.col("patient_id")) % 11))
    return plans.default_reference(names, view(spark, sf, "plan_phase"), own, F.col("patient_id") % 2 == 0, guess)


def d6_strategies(spark, sf):
    g = raster.geometry(gq._spans(spark, sf), gq.SX, gq.SY, gq.DZ, 0.027)
    name = F.when(F.col("structure_id") % 5 == 0, "BODY").otherwise(F.concat(F.lit("S"), (F.col("structure_id") % 4).cast("string")))
    return sampling.strategy(g.withColumn("name_norm", name)).select(P, "name_norm", "structure_id", "strategy")


def d10_volume_axis(spark, sf):
    """Curves of odd patients as if saved without volumes in cc."""
    c = dq._curves(spark, sf)
    points = dq.dvh.curve(c, W).withColumn("volume_cc", F.when(F.col("patient_id") % 2 == 0, F.col("volume_cc")))
    return dq.dvh.volume_axis(points, c).select(P, "structure", "bin", F.round("volume_cc", 6).alias("volume_cc"))


def j14_parent_references(spark, sf):
    spans = gq._spans(spark, sf)
    rows = spans.select(P, "structure_id").distinct().filter("structure_id % 9 <> 4").withColumn("reference_gy", F.col("structure_id") + 0.5)
    return targets.with_parents(rows, raster.parents(spans))


def t23_coverage_lines(spark, sf):
    """Saved texts for some targets; the others' coverage at their phase's dose, else at the dose in their name."""
    n = pq._named(spark, sf).filter("name_norm like 'PTV%'").groupBy(P, "name_norm").agg(F.max("rx_gy").alias("rx_gy"), F.min("ordinal").alias("o"))
    own = pq._assigned(spark, sf).groupBy(P, "name_norm").agg(F.max("phase_rx_gy").alias("phase_rx_gy"))
    saved = n.filter("o % 3 = 0").select(P, "name_norm", F.when(F.col("o") % 2 == 0, F.concat(F.lit(" 95.0% @ "), F.col("o").cast("string"))).otherwise(" ").alias("coverage_text"))
    fresh = n.filter("o % 5 <> 1").select(P, "name_norm", ((F.col("o") * 37 % 1000) / 10 + 0.04).alias("coverage_pct"))
    return targets.coverage_lines(n.join(own, [P, "name_norm"], "left"), saved, fresh)


def t24_review_list(spark, sf):
    s = plans.nested_order(plans.listable(pq._named(spark, sf)))
    d = view(spark, sf, "dose_voxel")
    return targets.review_list(s, voxels.hottest_outside(d, gq._spans(spark, sf)), voxels.hottest(d))


def t25_volume_lines(spark, sf):
    g = view(spark, sf, "structure").filter("ordinal % 2 = 0").select(P, "structure", (F.col("patient_id") + 0.5).alias("volume_cc"))
    return targets.volume_lines(g, dq._curves(spark, sf)).select(P, "structure", F.round("volume_cc", 6).alias("volume_cc"))


def o5_focus(spark, sf):
    s = plans.sorted_targets(pq._named(spark, sf))
    return targets.focus(s, pq._assigned(spark, sf).select(P, "name_norm").distinct())


def t19_presentation_rows(spark, sf):
    """Every text of the target table with its numbers; structures of odd place stand within AF."""
    totals = dq._curves(spark, sf)
    q = targets.measured(totals.withColumn("reference_gy", F.col("patient_id") % 9 * 10.0 - 5), W)
    nudged = [F.col(c) + 1e-9 for c in ("min_gy", "max_gy", "coverage_pct")]  # exact halves, which engines print differently, go up
    rows = targets.table_rows(q.select(P, "structure", "reference_gy", *(c.alias(n) for c, n in zip(nudged, ("min_gy", "max_gy", "coverage_pct"), strict=True))))
    rows = rows.withColumn("name", F.col("structure")).withColumn("parent", F.when(F.col("structure").isin("NF", "NO"), "AF")).withColumn("notes_text", F.when(F.col("patient_id") % 2 == 0, F.concat("structure", F.lit(" seen"))))
    keys = rows.filter("patient_id % 3 = 0").select(P, F.when(F.col("parent").isNull(), F.concat(F.lit("TARGET||"), "name")).otherwise(F.concat_ws("||", F.lit("TARGET"), "parent", "name")).alias("note_key"))
    shown = targets.presentation_rows(rows, keys.withColumn("note_text", F.lit("typed")))
    return shown.select(P, "structure", "reference_text", "coverage_text", "minimum_text", "maximum_text", "note_key", "note_title", "note_text", "is_primary")


QUERIES = {f.__name__: f for f in (g6_occupancy, x15_oversampling, g13_resampled, t7_target_metrics, t9_nested_targets, t10_competing_targets, t3_fraction_counts, t4_default_reference, d6_strategies, d10_volume_axis, j14_parent_references, t23_coverage_lines, t24_review_list, t25_volume_lines, o5_focus, t19_presentation_rows)}

F2 = N * SCALE
OCC = f"""e AS (SELECT patient_id, structure_id, k, contour_no, r * {SCALE} AS r0, c * {SCALE} AS c0, coalesce(lead(r) OVER o, first_value(r) OVER o) * {SCALE} AS r1, coalesce(lead(c) OVER o, first_value(c) OVER o) * {SCALE} AS c1
  FROM contour_point WINDOW o AS (PARTITION BY patient_id, structure_id, k, contour_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
lv AS (SELECT * FROM e WHERE abs(r0 - r1) > 1e-8 + 1e-5 * abs(r1)),
px AS (SELECT s.*, y.r, x.c FROM (SELECT DISTINCT patient_id, structure_id, k FROM e) s CROSS JOIN (SELECT unnest(range({F2})) AS r) y CROSS JOIN (SELECT unnest(range({F2})) AS c) x),
mask AS (SELECT px.patient_id, px.structure_id, px.k, px.r, px.c FROM px JOIN lv ON lv.patient_id = px.patient_id AND lv.structure_id = px.structure_id AND lv.k = px.k
  WHERE (r0 > px.r + 0.5) <> (r1 > px.r + 0.5) AND px.c + 0.5 < (c1 - c0) * (px.r + 0.5 - r0) / (r1 - r0) + c0 GROUP BY ALL HAVING count(*) % 2 = 1),
nb AS (SELECT m.*, (SELECT count(*) FROM mask n WHERE n.patient_id = m.patient_id AND n.structure_id = m.structure_id AND n.k = m.k AND abs(n.r - m.r) + abs(n.c - m.c) = 1) AS around FROM mask m),
sp AS (SELECT nb.*, r + (a.i + 0.5) / {SUB}.0 AS y, c + (b.i + 0.5) / {SUB}.0 AS x FROM nb CROSS JOIN (SELECT unnest(range({SUB})) AS i) a CROSS JOIN (SELECT unnest(range({SUB})) AS i) b WHERE around < 4),
ins AS (SELECT sp.patient_id, sp.structure_id, sp.k, sp.r, sp.c, ((SELECT count(*) FROM lv WHERE lv.patient_id = sp.patient_id AND lv.structure_id = sp.structure_id AND lv.k = sp.k AND (r0 > sp.y) <> (r1 > sp.y) AND sp.x < (c1 - c0) * (sp.y - r0) / (r1 - r0) + c0) % 2)::DOUBLE AS inside FROM sp),
occ AS (SELECT patient_id, structure_id, k, r, c, 1.0::DOUBLE AS share FROM nb WHERE around = 4 UNION ALL SELECT patient_id, structure_id, k, r, c, avg(inside) FROM ins GROUP BY 1, 2, 3, 4, 5)"""


def _mu(x: str, a: float, b: float, c: float, d: float) -> str:
    up = "1.0" if a == b else f"CASE WHEN {x} <= {a} THEN 0 WHEN {x} < {b} THEN ({x} - ({a})) / ({b}::DOUBLE - ({a})) ELSE 1 END"
    down = "1.0" if c == d else f"CASE WHEN {x} >= {d} THEN 0 WHEN {x} > {c} THEN ({d} - {x}) / ({d}::DOUBLE - ({c})) ELSE 1 END"
    return f"least({up}, {down})"


_R, _C, _O = sampling.RSS, sampling.COMPLEXITY, sampling.OUTPUT
GEOMETRY = gq.MASK + f""", sl AS (SELECT patient_id, structure_id, k, count(*) * {gq.SX}::DOUBLE * {gq.SY} AS area, sum(2 - w - e) * {gq.SY}::DOUBLE + sum(2 - u - d) * {gq.SX}::DOUBLE AS edge FROM side GROUP BY 1, 2, 3),
g AS (SELECT patient_id, structure_id, sum(area * {gq.DZ}::DOUBLE) AS mm3, sum(edge * {gq.DZ}::DOUBLE) + min_by(area, k) + max_by(area, k) AS s FROM sl GROUP BY 1, 2),
gm AS (SELECT patient_id, structure_id, round(cbrt(mm3 / 1000 / 0.0001), 6) AS rss, greatest(round(s / pow(36 * pi() * mm3 * mm3, 1.0 / 3) - 1, 6), 0) AS complexity FROM g)"""

NESTED = ", n AS (SELECT patient_id, structure_id, count(*) AS n FROM mask GROUP BY 1, 2), j AS (SELECT a.patient_id, a.structure_id AS part, b.structure_id AS whole, count(*) AS s FROM mask a JOIN mask b ON a.patient_id = b.patient_id AND a.k = b.k AND a.r = b.r AND a.c = b.c AND a.structure_id <> b.structure_id GROUP BY 1, 2, 3)"

ORACLE_SQL = {
    "d6_strategies": with_views(
        "WITH " + GEOMETRY + """, nm AS (SELECT patient_id, structure_id, mm3 / 1000 AS cc, CASE WHEN structure_id % 5 = 0 THEN 'BODY' ELSE 'S' || (structure_id % 4)::VARCHAR END AS name_norm FROM g),
        la AS (SELECT patient_id, name_norm, max(structure_id) AS structure_id, max_by(cc, structure_id) AS cc FROM nm GROUP BY 1, 2)
        SELECT patient_id, name_norm, structure_id, CASE WHEN name_norm = 'BODY' THEN 'voxels' WHEN cc <= 5 THEN 'small' ELSE 'samples' END AS strategy FROM la""",
        "contour_point",
    ),
    "d10_volume_axis": dq._sample(" SELECT c.patient_id, c.structure, c.bin, round(CASE WHEN c.patient_id % 2 = 0 THEN c.volume_cc ELSE c.volume_pct * t.volume_cc / 100 END, 6) AS volume_cc FROM curve c JOIN tot t USING (patient_id, structure)"),
    "j14_parent_references": gq._m(NESTED + """, pr AS (SELECT j.patient_id, part, min_by(whole, (w.n, whole)) AS parent FROM j JOIN n p ON p.patient_id = j.patient_id AND p.structure_id = part AND s = p.n JOIN n w ON w.patient_id = j.patient_id AND w.structure_id = whole GROUP BY 1, 2),
        ro AS (SELECT patient_id, structure_id, structure_id + 0.5::DOUBLE AS ref FROM n WHERE structure_id % 9 <> 4)
        SELECT ro.patient_id, ro.structure_id, parent, CASE WHEN parent IS NULL THEN ro.ref ELSE up.ref END AS reference_gy FROM ro LEFT JOIN pr ON pr.patient_id = ro.patient_id AND part = ro.structure_id LEFT JOIN ro up ON up.patient_id = ro.patient_id AND up.structure_id = parent"""),
    "t23_coverage_lines": pq.recursive(pq._n(
        "," + pq.ASSIGNED + """, tg AS (SELECT patient_id, name_norm, max(rx_gy)::DOUBLE AS rx_gy, min(ordinal) AS o FROM named WHERE starts_with(name_norm, 'PTV') GROUP BY 1, 2),
        own AS (SELECT patient_id, name_norm, max(phase_rx_gy) AS rx FROM assigned GROUP BY 1, 2)
        SELECT patient_id, name_norm, 'Coverage ' || tx AS line FROM (SELECT tg.patient_id, tg.name_norm, coalesce(CASE WHEN o % 3 = 0 AND o % 2 = 0 THEN '95.0% @ ' || o::VARCHAR END,
          CASE WHEN o % 5 <> 1 AND rx_gy IS NOT NULL THEN printf('%.1f', (o * 37 % 1000) / 10.0 + 0.04) || '% @ ' || printf('%.2f', coalesce(own.rx, rx_gy)) || ' Gy' END) AS tx FROM tg LEFT JOIN own USING (patient_id, name_norm)) WHERE tx IS NOT NULL"""
    )),
    "g6_occupancy": with_views("WITH " + OCC + " SELECT patient_id, structure_id, k, r, c, round(share, 6) AS share FROM occ", "contour_point"),
    "x15_oversampling": with_views(
        "WITH " + GEOMETRY + f""", ru AS (SELECT patient_id, structure_id, {_mu('rss', *_R['very_small'])} AS vh, greatest(least({_mu('rss', *_R['small'])}, {_mu('complexity', *_C['high'])}), least({_mu('rss', *_R['medium'])}, {_mu('complexity', *_C['high'])})) AS hi,
          greatest(least({_mu('rss', *_R['small'])}, {_mu('complexity', *_C['low'])}), least({_mu('rss', *_R['medium'])}, {_mu('complexity', *_C['low'])})) AS no, {_mu('rss', *_R['large'])} AS lo FROM gm),
        xs AS (SELECT i / 1000.0::DOUBLE - 1.0 AS x FROM (SELECT unnest(range(3001)) AS i)),
        ag AS (SELECT patient_id, structure_id, x, greatest(least({_mu('x', *_O['low'])}, lo), least({_mu('x', *_O['normal'])}, no), least({_mu('x', *_O['high'])}, hi), least({_mu('x', *_O['very_high'])}, vh)) AS m FROM ru CROSS JOIN xs),
        pw AS (SELECT patient_id, structure_id, CASE WHEN sum(m) > 0 THEN sum(x * m) / sum(m) ELSE 0 END AS power FROM ag GROUP BY 1, 2)
        SELECT patient_id, structure_id, round(power, 6) AS power, greatest(0.5::DOUBLE, least(4.0::DOUBLE, pow(2.0, round_even(greatest(-1, least(2, power)), 0)))) AS factor FROM pw""",
        "contour_point",
    ),
    "g13_resampled": with_views(
        f"""WITH dp AS (SELECT DISTINCT patient_id, k, k * 1.25::DOUBLE AS z FROM dose_voxel), ns AS (SELECT s.patient_id, s.k AS image_k, min_by(dp.k, (abs(dp.z - s.z), dp.k)) AS k FROM slice_position s JOIN dp USING (patient_id) GROUP BY 1, 2),
        q AS (SELECT ns.patient_id, ns.image_k, ns.k, y.i AS pr, x.i AS pc, y.i * 0.5::DOUBLE + 1.25 AS y, x.i * 0.75::DOUBLE + 0.5 AS x FROM ns CROSS JOIN (SELECT unnest(range({N})) AS i) y CROSS JOIN (SELECT unnest(range({N})) AS i) x), """
        + gq._bil("q.y", "q.x") + """, g AS (SELECT patient_id, image_k, pr, pc, sum(w * dose_gy) AS d FROM cn JOIN dose_voxel v USING (patient_id, k, r, c) GROUP BY 1, 2, 3, 4)
        SELECT q.patient_id, q.image_k AS k, count(*) AS n, round(sum(coalesce(d, 0)), 4) AS dose, round(max(coalesce(d, 0)) + 1e-9, 6) AS top FROM q LEFT JOIN g ON g.patient_id = q.patient_id AND g.image_k = q.image_k AND g.pr = q.pr AND g.pc = q.pc GROUP BY 1, 2""",
        "slice_position", "dose_voxel",
    ),
    "t7_target_metrics": dq._sample("," + dq.STEP + ", asked AS (SELECT patient_id, structure, (patient_id % 9 * 10.0 - 5)::DOUBLE AS dose FROM tot)," + dq.v_sql("asked") + " SELECT t.patient_id, t.structure, v.dose AS reference_gy, min_gy, max_gy, CASE WHEN v.dose > 0 THEN round(v_pct, 6) END AS coverage_pct FROM tot t JOIN v_at v USING (patient_id, structure)"),
    "t19_presentation_rows": dq._sample(
        "," + dq.STEP + ", asked AS (SELECT patient_id, structure, (patient_id % 9 * 10.0 - 5)::DOUBLE AS dose FROM tot)," + dq.v_sql("asked") + """, x AS (SELECT t.patient_id, t.structure, v.dose AS ref, min_gy + 1e-9 AS lo, max_gy + 1e-9 AS hi, CASE WHEN v.dose > 0 THEN v_pct + 1e-9 END AS cov,
          CASE WHEN t.structure IN ('NF', 'NO') THEN 'AF' END AS parent, CASE WHEN t.patient_id % 2 = 0 THEN t.structure || ' seen' ELSE '' END AS made, CASE WHEN t.patient_id % 3 = 0 THEN 'typed' ELSE '' END AS typed FROM tot t JOIN v_at v USING (patient_id, structure))
        SELECT patient_id, structure, CASE WHEN ref > 0 THEN printf('%.2f', ref) ELSE '' END AS reference_text,
          CASE WHEN cov IS NOT NULL THEN printf('%.1f%% @ %.2f Gy', cov, ref) WHEN ref > 0 THEN printf('@ %.2f Gy', ref) ELSE '' END AS coverage_text,
          CASE WHEN cov IS NOT NULL THEN printf('%.1f%%', lo / ref * 100) ELSE '' END AS minimum_text, CASE WHEN cov IS NOT NULL THEN printf('%.1f%%', hi / ref * 100) ELSE '' END AS maximum_text,
          'TARGET||' || CASE WHEN parent IS NULL THEN '' ELSE parent || '||' END || structure AS note_key, structure || CASE WHEN parent IS NULL THEN '' ELSE ' within ' || parent END || ' target review' AS note_title,
          CASE WHEN made = '' THEN typed WHEN typed = '' THEN made ELSE made || '    ' || typed END AS note_text, parent IS NULL AS is_primary FROM x"""
    ),
    "t9_nested_targets": gq._m(" , n AS (SELECT patient_id, structure_id, count(*) AS n FROM mask GROUP BY 1, 2), j AS (SELECT a.patient_id, a.structure_id AS part, b.structure_id AS whole, count(*) AS s FROM mask a JOIN mask b ON a.patient_id = b.patient_id AND a.k = b.k AND a.r = b.r AND a.c = b.c AND a.structure_id <> b.structure_id GROUP BY 1, 2, 3), ct AS (SELECT j.* FROM j JOIN n ON n.patient_id = j.patient_id AND n.structure_id = part WHERE s = n) SELECT ct.patient_id, part, min_by(whole, (n.n, whole)) AS parent FROM ct JOIN n ON n.patient_id = ct.patient_id AND n.structure_id = whole GROUP BY 1, 2"),
    "t10_competing_targets": gq._m(" , n AS (SELECT patient_id, structure_id, count(*) AS n FROM mask GROUP BY 1, 2), j AS (SELECT a.patient_id, a.structure_id AS part, b.structure_id AS whole, count(*) AS s FROM mask a JOIN mask b ON a.patient_id = b.patient_id AND a.k = b.k AND a.r = b.r AND a.c = b.c AND a.structure_id <> b.structure_id GROUP BY 1, 2, 3), ct AS (SELECT j.* FROM j JOIN n ON n.patient_id = j.patient_id AND n.structure_id = part WHERE s = n) SELECT a.patient_id, a.structure_id AS target, b.structure_id AS rival FROM n a JOIN n b USING (patient_id) WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.patient_id = a.patient_id AND (part = a.structure_id AND whole = b.structure_id OR whole = a.structure_id AND part = b.structure_id))"),
    "t3_fraction_counts": pq.recursive(pq._n("," + pq.ASSIGNED + ", ow AS (SELECT a.patient_id, name_norm, min_by(fractions, plan_uid) AS f FROM assigned a JOIN plan_phase USING (patient_id, plan_uid) GROUP BY 1, 2), fx AS (SELECT patient_id, count(DISTINCT fractions) AS m, max(fractions) AS f FROM avail WHERE fractions > 0 GROUP BY 1) SELECT DISTINCT n.patient_id, n.name_norm, coalesce(ow.f, CASE WHEN fx.m = 1 THEN fx.f END, 0) AS fraction_count FROM named n LEFT JOIN ow USING (patient_id, name_norm) LEFT JOIN fx USING (patient_id) WHERE starts_with(n.name_norm, 'PTV')")),
    "t4_default_reference": pq.recursive(pq._n(
        "," + pq.ASSIGNED + """, ow AS (SELECT patient_id, name_norm, max(phase_rx_gy) AS rx FROM assigned GROUP BY 1, 2), phs AS (SELECT patient_id, sum(rx_gy) AS s, count(DISTINCT CASE WHEN fractions > 0 THEN fractions END) AS m, max(fractions) AS f FROM avail GROUP BY 1),
        b AS (SELECT DISTINCT n.patient_id, n.name_norm, ow.rx, s, coalesce(m = 1 AND f = 1 AND n.patient_id % 2 = 0, false) AS one, coalesce(m = 1 AND f > 1 AND n.patient_id % 2 = 0, false) AS many, n.patient_id % 2 = 0 AS st, CASE WHEN n.patient_id % 3 = 0 THEN CASE WHEN abs(mg - 18) <= abs(mg - 21) AND abs(mg - 18) <= abs(mg - 24) THEN 18.0 WHEN abs(mg - 21) <= abs(mg - 24) THEN 21.0 ELSE 24.0 END END AS srs,
          try_cast(nullif(regexp_replace(n.name_norm, '[^0-9]', '', 'g'), '') AS DOUBLE) AS raw FROM (SELECT *, 15.0 + (length(name_norm) * 7 + patient_id) % 11 AS mg FROM named) n LEFT JOIN ow USING (patient_id, name_norm) LEFT JOIN phs USING (patient_id) WHERE starts_with(n.name_norm, 'PTV'))
        SELECT patient_id, name_norm, round((CASE WHEN rx > 0 THEN rx WHEN raw >= 100 THEN raw / 100 WHEN (raw IS NULL OR raw < 100) AND one AND srs IS NOT NULL THEN srs WHEN (raw IS NULL OR raw < 100) AND many THEN s WHEN st AND srs IS NOT NULL THEN srs ELSE s END)::DOUBLE, 2) AS reference_gy FROM b"""
    )),
    "t24_review_list": with_views(
        "WITH " + pq.NAMED + ", " + gq.MASK + """, li AS (SELECT * FROM named WHERE NOT regexp_matches(name_norm, '^Z|COUCH|RAIL|BB')),
        od AS (SELECT patient_id, name_norm, row_number() OVER (PARTITION BY patient_id ORDER BY CASE left(name_norm, 3) WHEN 'PTV' THEN 0 WHEN 'GTV' THEN 1 WHEN 'CTV' THEN 2 ELSE 3 END, rx_gy ASC NULLS LAST, name_norm, ordinal) AS place FROM li),
        al AS (SELECT patient_id, CASE WHEN starts_with(name_norm, 'PTV') THEN 0 ELSE 3 END AS rank, place AS no, name_norm AS shown FROM od
          UNION ALL SELECT DISTINCT patient_id, 1, 0, 'Max Tissue' FROM dose_voxel v WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.patient_id = v.patient_id AND m.k = v.k AND m.r = v.r AND m.c = v.c)
          UNION ALL SELECT DISTINCT patient_id, 2, 0, 'Max Dose' FROM dose_voxel)
        SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY rank, no, shown)::INT AS row, shown FROM al""",
        "named_structure", "plan_phase", "contour_point", "dose_voxel",
    ),
    "t25_volume_lines": with_views("WITH " + dq.HIST.strip() + ", gv AS (SELECT patient_id, structure, patient_id + 0.5::DOUBLE AS v FROM structure WHERE ordinal % 2 = 0) SELECT patient_id, structure, round(coalesce(v, volume_cc), 6) AS volume_cc FROM tot FULL JOIN gv USING (patient_id, structure)", "dose_sample", "structure"),
    "o5_focus": pq.recursive(pq._n("," + pq.ASSIGNED + ", ow AS (SELECT DISTINCT patient_id, name_norm, 1 AS has FROM assigned), so AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY rx_gy ASC NULLS LAST, name_norm, ordinal) AS place FROM named WHERE starts_with(name_norm, 'PTV')) SELECT patient_id, max_by(name_norm, (coalesce(has, 0), place)) AS focus FROM so LEFT JOIN ow USING (patient_id, name_norm) GROUP BY 1")),
}
