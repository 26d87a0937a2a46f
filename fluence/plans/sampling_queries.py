"""Curves of structures sampled at their own resolution, each with its DuckDB equivalent or a plain version in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dvh, raster, sampling, small
from ..shipping import kept, merged
from ..sources.standins import view, with_views
from . import geometry_queries as gq
from . import target_queries as tq

P, S = "patient_id", ["patient_id", "structure_id"]
N, SX, SY, DZ = gq.N, gq.SX, gq.SY, gq.DZ
VOXEL_CC = SX * SY * DZ / 1000
SUB = 6


def _places(spark, sf):
    """Contours, doses, the dose grid's planes and where the contours' slices stand."""
    points, d = view(spark, sf, "target_point"), view(spark, sf, "target_dose")
    planes = d.select(P, "k", (F.col("k") * DZ).alias("z")).distinct()
    where = points.select(P, "k").distinct().select(P, "k", (F.col("k") * DZ).alias("z"), F.lit(DZ).alias("thickness"))
    return points, d, planes, where


def _geometry(points):
    """Volumes, sizes in dose voxels and complexity of all structures, each in one task: a structure's rows are shuffled once, and small
    shuffled tables are not joined to a few tasks."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return raster.geometry(raster.mask_spans(points.repartition(parts, *S), N, N), SX, SY, DZ, VOXEL_CC)


def _factors(geometry):
    """Each structure's factor from its size in dose voxels and its complexity."""
    m = geometry.select(*S, F.round("rss", 6).alias("rss"), F.round("complexity", 6).alias("complexity"))
    return sampling.oversampling(m).select(*S, "factor")


def _sampled_curves(points, d, planes, where):
    return sampling.curves(points, d, planes, where, F.col("factor"), N, N, SX, SY, SUB)


def d3_high_accuracy(spark, sf):
    """Every structure sampled at the factor that X15 gives it, as whole curves with bins of 0.05 Gy."""
    points, *places = _places(spark, sf)
    c = dvh.curve(_sampled_curves(points.join(merged(_factors(_geometry(points))), S), *places))
    return c.select(P, "structure", "bin", F.round("dose_gy", 6).alias("dose_gy"), F.round(F.col("volume_cc") + 1e-9, 6).alias("volume_cc"), F.round(F.col("volume_pct") + 1e-9, 4).alias("volume_pct"))


def d2_sampled_totals(spark, sf):
    """What the samples add up to, and each structure's factor."""
    points, *places = _places(spark, sf)
    factors = kept(_factors(_geometry(points)))
    totals = _sampled_curves(points.join(merged(factors), S), *places).join(merged(factors.withColumnRenamed("structure_id", "structure")), [P, "structure"])
    return totals.select(P, "structure", "factor", *(F.round(c, 6).alias(c) for c in ("volume_cc", "mean_gy", "min_gy", "max_gy")), "n_samples", "n_bins")


def _strategies(geometry, spark, sf):
    """Volumes and strategies: the brain stands for the body."""
    name = F.when(F.col("name_norm") == "BRAIN", "BODY").otherwise(F.col("name_norm"))
    named = view(spark, sf, "target_structure").select(*S, name.alias("name_norm"))
    return sampling.strategy(geometry.join(merged(named), S).select(*S, "name_norm", "volume_cc"))


def _small(points, where, strategies):
    """Structures of 5 cc at most, with what their models need: every slice's place and the smallest step."""
    few = strategies.filter("strategy = 'small'").select(*S)
    return points.join(merged(few), S, "left_semi"), where.withColumn("base", F.lit(DZ))


def g18_small_models(spark, sf):
    """The cells of small structures' models, by slice between slices."""
    points, _, _, where = _places(spark, sf)
    m = small.model(*_small(points, where, _strategies(_geometry(points), spark, sf)), N, N, SX, SY)
    return m.groupBy(*S, "k").agg(F.count("*").alias("cells"), F.round(F.sum("share"), 6).alias("area"), F.round(F.max("z"), 6).alias("z"), F.round(F.max("step"), 6).alias("step"))


def d5_small_curves(spark, sf):
    """Whole curves of small structures with bins of 0.01 Gy."""
    points, d, planes, where = _places(spark, sf)
    c = dvh.curve(small.curves(*_small(points, where, _strategies(_geometry(points), spark, sf)), d, planes, N, N, SX, SY), small.WIDTH)
    return c.select(P, "structure", "bin", *(F.round(x, 6).alias(x) for x in ("dose_gy", "volume_cc", "volume_pct")))


def d6_curves_by_strategy(spark, sf):
    """All three branches, each for its own structures, united in the order of the structures."""
    points, d, planes, where = _places(spark, sf)
    geometry = kept(_geometry(points))
    strategies = kept(_strategies(geometry, spark, sf))
    of = lambda name: strategies.filter(F.col("strategy") == name).select(*S)
    whole = points.join(merged(of("voxels")), S, "left_semi")
    middle = points.join(merged(_factors(geometry.join(merged(of("samples")), S, "left_semi"))), S)
    branches = {
        "voxels": small.voxel_totals(raster.mask_spans(whole, N, N), d, VOXEL_CC),
        "samples": _sampled_curves(middle, d, planes, where),
        "small": small.curves(*_small(points, where, strategies), d, planes, N, N, SX, SY),
    }
    x = small.by_strategy(strategies, branches)
    return x.select(*S, "name_norm", "strategy", "place", *(F.round(c, 6).alias(c) for c in ("volume_cc", "mean_gy", "min_gy", "max_gy")))


QUERIES = {f.__name__: f for f in (d2_sampled_totals, d3_high_accuracy, g18_small_models, d5_small_curves, d6_curves_by_strategy)}

W = dvh.WIDTH
_FACTOR = tq.ORACLE_SQL["x15_oversampling"]
_FACTOR = _FACTOR[_FACTOR.index("e AS (SELECT patient_id, structure_id, k, contour_no, r AS r0") :].replace("contour_point", "target_point").replace("/ 0.0001", f"/ {VOXEL_CC}")
_HEAD, _TAIL = _FACTOR.rsplit("SELECT patient_id, structure_id, round(power, 6) AS power,", 1)
_SAMPLES = (
    "WITH " + _HEAD.rstrip() + ",\nfa AS (SELECT patient_id, structure_id," + _TAIL + f"""),
fe AS (SELECT patient_id, structure_id, k, r0 * factor AS r0, c0 * factor AS c0, r1 * factor AS r1, c1 * factor AS c1 FROM e JOIN fa USING (patient_id, structure_id)),
fl AS MATERIALIZED (SELECT * FROM fe WHERE abs(r0 - r1) > 1e-8 + 1e-5 * abs(r1)),
fx AS (SELECT s.patient_id, s.structure_id, s.k, s.factor, y.r, x.c FROM (SELECT DISTINCT e.patient_id, e.structure_id, e.k, factor FROM e JOIN fa USING (patient_id, structure_id)) s
  JOIN (SELECT unnest(range({4 * N})) AS r) y ON y.r < {N} * factor JOIN (SELECT unnest(range({4 * N})) AS c) x ON x.c < {N} * factor),
fk AS MATERIALIZED (SELECT fx.patient_id, fx.structure_id, fx.k, fx.factor, fx.r, fx.c FROM fx JOIN fl ON fl.patient_id = fx.patient_id AND fl.structure_id = fx.structure_id AND fl.k = fx.k
  WHERE (r0 > fx.r + 0.5) <> (r1 > fx.r + 0.5) AND fx.c + 0.5 < (c1 - c0) * (fx.r + 0.5 - r0) / (r1 - r0) + c0 GROUP BY ALL HAVING count(*) % 2 = 1),
fn AS MATERIALIZED (SELECT m.*, (SELECT count(*) FROM fk n WHERE n.patient_id = m.patient_id AND n.structure_id = m.structure_id AND n.k = m.k AND abs(n.r - m.r) + abs(n.c - m.c) = 1) AS around FROM fk m),
fp AS (SELECT fn.*, r + (a.i + 0.5) / {SUB}.0 AS y, c + (b.i + 0.5) / {SUB}.0 AS x FROM fn CROSS JOIN (SELECT unnest(range({SUB})) AS i) a CROSS JOIN (SELECT unnest(range({SUB})) AS i) b WHERE around < 4),
fi AS (SELECT fp.*, (SELECT count(*) FROM fl WHERE fl.patient_id = fp.patient_id AND fl.structure_id = fp.structure_id AND fl.k = fp.k AND (r0 > fp.y) <> (r1 > fp.y)
  AND fp.x < (c1 - c0) * (fp.y - r0) / (r1 - r0) + c0) % 2 AS hit FROM fp),
oc AS (SELECT patient_id, structure_id, k, factor, r, c, 1.0::DOUBLE AS share FROM fn WHERE around = 4 UNION ALL SELECT patient_id, structure_id, k, factor, r, c, avg(hit) FROM fi GROUP BY 1, 2, 3, 4, 5, 6),
nz AS (SELECT *, greatest(1, round_even(greatest(1, factor), 0))::INT AS n FROM oc WHERE share > 0),
sm AS MATERIALIZED (SELECT patient_id, structure_id, row_number() OVER () AS id, (r + 0.5) / factor AS y, (c + 0.5) / factor AS x, k * {DZ}::DOUBLE + ((i + 0.5) / n - 0.5) * {DZ}::DOUBLE AS z,
  share * ({SX * SY}::DOUBLE / (factor * factor)) * {DZ}::DOUBLE / (1000 * n) AS weight FROM (SELECT *, unnest(range(n)) AS i FROM nz)),
pl AS (SELECT patient_id, k, k * {DZ}::DOUBLE AS z0, lead(k) OVER w AS k1, lead(k) OVER w * {DZ}::DOUBLE AS z1 FROM (SELECT DISTINCT patient_id, k FROM target_dose) WINDOW w AS (PARTITION BY patient_id ORDER BY k)),
hit AS (SELECT a.id, a.patient_id, a.y, a.x, p.k AS ka, p.k1 AS kb, (a.z - z0) / (z1 - z0) AS t, row_number() OVER (PARTITION BY a.id ORDER BY z0) AS n FROM sm a JOIN pl p ON p.patient_id = a.patient_id AND a.z >= z0 AND a.z <= z1),
q AS (SELECT id, patient_id, y, x, ka AS k, 1 - t AS wz FROM hit WHERE n = 1 UNION ALL SELECT id, patient_id, y, x, kb, t FROM hit WHERE n = 1), """ + gq._bil("q.y", "q.x") + f""",
gd AS (SELECT id, sum(w * wz * dose_gy) AS d FROM cn JOIN target_dose v USING (patient_id, k, r, c) GROUP BY 1),
tp AS (SELECT patient_id, ceil(greatest(max(dose_gy), {W}) / {W})::INT AS n FROM target_dose GROUP BY 1),
al AS MATERIALIZED (SELECT sm.patient_id, sm.structure_id AS structure, sm.weight, coalesce(d, 0) AS dose, n FROM sm LEFT JOIN gd USING (id) JOIN tp USING (patient_id))"""
)

ORACLE_SQL = {
    "d2_sampled_totals": with_views(
        _SAMPLES + """ SELECT al.patient_id, structure, any_value(factor) AS factor, round(sum(weight), 6) AS volume_cc, round(sum(dose * weight) / sum(weight), 6) AS mean_gy, round(min(dose), 6) AS min_gy, round(max(dose), 6) AS max_gy,
        count(*) AS n_samples, max(n) AS n_bins FROM al JOIN fa ON fa.patient_id = al.patient_id AND fa.structure_id = structure GROUP BY 1, 2""",
        "target_point", "target_dose",
    ),
    "d3_high_accuracy": with_views(
        _SAMPLES + f""", hs AS (SELECT patient_id, structure, least(floor(dose / {W})::INT, n - 1) AS bin, sum(weight) AS cc FROM al GROUP BY 1, 2, 3),
        ax AS (SELECT DISTINCT patient_id, structure, unnest(range(n + 1)) AS bin FROM (SELECT DISTINCT patient_id, structure, n FROM al)),
        cu AS (SELECT ax.*, coalesce(sum(cc) OVER (PARTITION BY ax.patient_id, ax.structure ORDER BY ax.bin DESC), 0) AS v FROM ax LEFT JOIN hs ON hs.patient_id = ax.patient_id AND hs.structure = ax.structure AND hs.bin = ax.bin)
        SELECT patient_id, structure, bin::INT AS bin, round(bin * {W}::DOUBLE, 6) AS dose_gy, round(v + 1e-9, 6) AS volume_cc, round(v / max(v) OVER (PARTITION BY patient_id, structure) * 100 + 1e-9, 4) AS volume_pct FROM cu""",
        "target_point", "target_dose",
    ),
}
