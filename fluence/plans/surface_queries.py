"""Queries over distances in three dimensions and what targets own by them; SQL measures every cell against every cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, surfaces, targets, voxels
from ..shipping import kept, merged
from ..sources.standins import view, with_views
from . import geometry_queries as gq

P, S = "patient_id", ["patient_id", "structure_id"]
N, SX, SY, DZ = gq.N, gq.SX, gq.SY, gq.DZ
SLICES = 16
MARGIN = 6.0
#: Dose at or above which T16 counts.
LEVEL = 21.0


def _spans(spark, sf):
    """Masks as spans, written once for the branches of a query."""
    return merged(kept(raster.mask_spans(view(spark, sf, "target_point"), N, N)))


def _dose(spark, sf):
    return merged(view(spark, sf, "target_dose"))


def _targets(spark, sf):
    return merged(view(spark, sf, "target_structure").filter(F.startswith("name_norm", F.lit("PTV"))))


def _rivals(t, spans):
    """Every target of the patient except those nested with it."""
    theirs = spans.join(t.select(*S), S, "left_semi")
    return merged(kept(targets.competing(t, raster.contained(theirs))))


def g15_distance(spark, sf):
    spans = _spans(spark, sf)
    blocks = surfaces.widened(surfaces.boxes(spans), MARGIN, SX, SY, DZ, SLICES, N, N)
    return surfaces.distances(spans, blocks, SX, SY, DZ).select(*S, "k", "r", "c", F.round("outside", 6).alias("outside"), F.round("inside", 6).alias("inside"))


def g16_within_margin(spark, sf):
    x = surfaces.within_margin(_spans(spark, sf), 3.2, SX, SY, DZ, SLICES, N, N)
    return x.select(*S, "k", "r", "c", F.round("outside", 6).alias("distance"))


def _owned(spark, sf):
    spans, t = _spans(spark, sf), _targets(spark, sf)
    rivals = _rivals(t, spans)
    asked = t.select(*S, (F.col("rx_gy") / 2).alias("least_gy"))
    blocks = surfaces.support_blocks(asked, rivals, spans, _dose(spark, sf))
    return surfaces.owned_lines(spans, blocks, rivals, SX, SY, DZ)


def t11_ownership(spark, sf):
    """Every cell that a target owns a share of."""
    lines = _owned(spark, sf).select(*S, "k", "r", "c0", F.posexplode("weights").alias("at", "w")).filter("w > 0")
    return lines.select(*S, "k", "r", (F.col("c0") + F.col("at")).alias("c"), F.round("w", 6).alias("weight"))


def t12_owned_volumes(spark, sf):
    w = surfaces.weighted_voxels(_owned(spark, sf), _dose(spark, sf))
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), (F.col("rx_gy") * f).alias("threshold_gy")) for n, f in (("rx", 1.0), ("half", 0.5)))))
    levels = _targets(spark, sf).select(*S, level.alias("x")).select(*S, "x.*")
    return surfaces.owned_volumes(w, levels, SX * SY * DZ / 1000).select(*S, "level", "threshold_gy", F.round("volume_cc", 6).alias("volume_cc"))


def t13_stereotactic_indices(spark, sf):
    spans, t, d = _spans(spark, sf), _targets(spark, sf), _dose(spark, sf)
    every = merged(view(spark, sf, "target_structure"))
    named = lambda name: every.filter(F.col("name_norm") == name).select(*S)
    brain = spans.join(named("BRAIN"), S, "left_semi")
    held = raster.contained(spans.join(t.select(*S).unionByName(named("GTV")), S, "left_semi"))
    lesion = held.join(named("GTV").withColumnRenamed("structure_id", "part"), [P, "part"]).select(P, F.col("part").alias("structure_id"), "whole")
    inner = spans.join(merged(lesion), S).select(P, F.col("whole").alias("structure_id"), "k", "r", "c_lo", "c_hi")
    seen = voxels.masked(d, spans).join(t.select(*S, "rx_gy"), S)
    cover = seen.groupBy(*S).agg((F.avg((F.col("dose_gy") >= F.col("rx_gy")).cast("int")) * 100).alias("coverage_pct"))
    x = surfaces.stereotactic(t.join(merged(cover), S).select(*S, "rx_gy", "coverage_pct", "fractions"), _rivals(t, spans), spans, d, brain, inner, SX, SY, DZ)
    return x.select(*S, *(F.round(c, 6).alias(c) for c in ("volume_cc", "ci", "pci", "gi", "brain_cc")))


def t14_margin_weights(spark, sf):
    spans, t = _spans(spark, sf), _targets(spark, sf)
    blocks, near = surfaces.margin_blocks(spans, _rivals(t, spans), MARGIN, SX, SY, DZ, SLICES, N, N)
    lines = surfaces.owned_lines(spans, blocks, near, SX, SY, DZ, MARGIN).select(*S, "k", "r", "c0", F.posexplode("weights").alias("at", "w")).filter("w > 0")
    return lines.select(*S, "k", "r", (F.col("c0") + F.col("at")).alias("c"), F.round("w", 6).alias("weight"))


def t15_margin_volumes(spark, sf):
    spans, t, d = _spans(spark, sf), _targets(spark, sf), _dose(spark, sf)
    asked = t.select(*S, (F.col("rx_gy") / 2).alias("threshold_gy"))
    x = surfaces.margin_volumes(asked, _rivals(t, spans), spans, d, MARGIN, SX, SY, DZ, SLICES, N, N)
    return x.select(*S, "threshold_gy", F.round("volume_cc", 6).alias("volume_cc"))


def t16_threshold_volumes(spark, sf):
    spans, t = _spans(spark, sf), _targets(spark, sf)
    asked = t.select(*S, F.lit(LEVEL).alias("threshold_gy"))
    x = surfaces.threshold_volumes(asked, _rivals(t, spans), spans, _dose(spark, sf), SX, SY, DZ)
    return x.select(*S, "threshold_gy", F.round("volume_cc", 6).alias("volume_cc"))


QUERIES = {f.__name__: f for f in (g15_distance, g16_within_margin, t11_ownership, t12_owned_volumes, t13_stereotactic_indices, t14_margin_weights, t15_margin_volumes, t16_threshold_volumes)}

_MASK = gq.MASK.split(",\nside AS")[0].replace("contour_point", "target_point")
_BOX = "min(k) AS k0, max(k) AS k1, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1"
_DIST = f"pow({SX}::DOUBLE * (a.c - b.c), 2) + pow({SY}::DOUBLE * (a.r - b.r), 2) + pow({DZ}::DOUBLE * (a.k - b.k), 2)"
_WIDE = ", ".join(
    f"greatest(0, {a}0 - {int(-(-MARGIN // step))}) AS {a}0, least({n - 1}, {a}1 + {int(-(-MARGIN // step))}) AS {a}1" for a, step, n in (("k", DZ, SLICES), ("r", SY, N), ("c", SX, N))
)
_RIVALS = """tg AS (SELECT * FROM target_structure WHERE name_norm LIKE 'PTV%'),
bx AS (SELECT patient_id, structure_id, """ + _BOX + """ FROM mask GROUP BY 1, 2),
cnt AS (SELECT patient_id, structure_id, count(*) AS n FROM mask GROUP BY 1, 2),
shared AS (SELECT a.patient_id, a.structure_id AS part, b.structure_id AS whole, count(*) AS s FROM mask a JOIN mask b ON a.patient_id = b.patient_id AND a.k = b.k AND a.r = b.r AND a.c = b.c AND a.structure_id <> b.structure_id GROUP BY 1, 2, 3),
held AS (SELECT shared.* FROM shared JOIN cnt ON cnt.patient_id = shared.patient_id AND cnt.structure_id = part WHERE s = n),
rv AS (SELECT a.patient_id, a.structure_id AS target, b.structure_id AS rival FROM tg a JOIN tg b USING (patient_id) WHERE a.structure_id = b.structure_id
  OR NOT EXISTS (SELECT 1 FROM held WHERE held.patient_id = a.patient_id AND (part = a.structure_id AND whole = b.structure_id OR part = b.structure_id AND whole = a.structure_id)))"""


def _support(least: str) -> str:
    """Blocks around the voxels at or above a dose of target t and around its rivals."""
    return f"""sup AS (SELECT t.patient_id, t.structure_id, {_BOX.replace('(k)', '(v.k)').replace('(r)', '(v.r)').replace('(c)', '(v.c)')} FROM tg t JOIN target_dose v ON v.patient_id = t.patient_id AND v.dose_gy >= {least} GROUP BY 1, 2),
bl AS (SELECT patient_id, structure_id, min(k0) AS k0, max(k1) AS k1, min(r0) AS r0, max(r1) AS r1, min(c0) AS c0, max(c1) AS c1 FROM
  (SELECT * FROM sup UNION ALL SELECT sup.patient_id, sup.structure_id, b.k0, b.k1, b.r0, b.r1, b.c0, b.c1 FROM sup JOIN rv ON rv.patient_id = sup.patient_id AND target = sup.structure_id JOIN bx b ON b.patient_id = sup.patient_id AND b.structure_id = rival) GROUP BY 1, 2)"""


#: The distance of every cell of a block to every rival's mask, and from inside it to the block's background.
_FIELDS = f"""fb AS (SELECT DISTINCT bl.patient_id, k0, k1, r0, r1, c0, c1, rival FROM bl JOIN rv ON rv.patient_id = bl.patient_id AND target = bl.structure_id),
fc AS (SELECT fb.*, k, r, c FROM fb, (SELECT unnest(range({SLICES})) AS k) x, (SELECT unnest(range({N})) AS r) y, (SELECT unnest(range({N})) AS c) z WHERE k BETWEEN k0 AND k1 AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1),
fm AS (SELECT fc.*, m.c IS NOT NULL AS own FROM fc LEFT JOIN mask m ON m.patient_id = fc.patient_id AND m.structure_id = fc.rival AND m.k = fc.k AND m.r = fc.r AND m.c = fc.c),
fo AS (SELECT a.patient_id, a.k0, a.k1, a.r0, a.r1, a.c0, a.c1, a.rival, a.k, a.r, a.c, sqrt(min({_DIST})) AS d FROM fm a JOIN mask b ON b.patient_id = a.patient_id AND b.structure_id = a.rival WHERE NOT a.own GROUP BY ALL),
fi AS (SELECT a.patient_id, a.k0, a.k1, a.r0, a.r1, a.c0, a.c1, a.rival, a.k, a.r, a.c, sqrt(min({_DIST})) AS d FROM fm a JOIN fm b ON b.patient_id = a.patient_id AND b.rival = a.rival AND b.k0 = a.k0 AND b.k1 = a.k1 AND b.r0 = a.r0
  AND b.r1 = a.r1 AND b.c0 = a.c0 AND b.c1 = a.c1 WHERE a.own AND NOT b.own GROUP BY ALL),
fd AS (SELECT *, d AS o FROM fo UNION ALL SELECT *, 0.0 FROM fi)"""


def _weights(eligible: str = "true") -> str:
    return f"""fw AS (SELECT bl.patient_id, bl.structure_id, f.rival, f.k, f.r, f.c, f.d, min(f.d) OVER w AS low, min(CASE WHEN f.rival = bl.structure_id THEN f.d END) OVER w AS mine FROM bl JOIN rv ON rv.patient_id = bl.patient_id AND rv.target = bl.structure_id
  JOIN fd f ON f.patient_id = bl.patient_id AND f.rival = rv.rival AND f.k0 = bl.k0 AND f.k1 = bl.k1 AND f.r0 = bl.r0 AND f.r1 = bl.r1 AND f.c0 = bl.c0 AND f.c1 = bl.c1 AND {eligible}
  WINDOW w AS (PARTITION BY bl.patient_id, bl.structure_id, f.k, f.r, f.c)),
ow AS (SELECT patient_id, structure_id, k, r, c, 1.0::DOUBLE / sum((d <= low + 1e-6 + 1e-5 * low)::INT) AS weight FROM fw WHERE mine <= low + 1e-6 + 1e-5 * low GROUP BY 1, 2, 3, 4, 5)"""


_NEAR = f"""wd AS (SELECT patient_id, structure_id, {_WIDE} FROM bx),
nr AS (SELECT rv.* FROM rv JOIN wd a ON a.patient_id = rv.patient_id AND a.structure_id = target JOIN wd b ON b.patient_id = rv.patient_id AND b.structure_id = rival
  WHERE a.k1 >= b.k0 AND b.k1 >= a.k0 AND a.r1 >= b.r0 AND b.r1 >= a.r0 AND a.c1 >= b.c0 AND b.c1 >= a.c0),
bl AS (SELECT nr.patient_id, target AS structure_id, min(k0) AS k0, max(k1) AS k1, min(r0) AS r0, max(r1) AS r1, min(c0) AS c0, max(c1) AS c1 FROM nr JOIN wd ON wd.patient_id = nr.patient_id AND wd.structure_id = rival GROUP BY 1, 2)"""
_MARGIN = _NEAR + ",\n" + _FIELDS.replace("JOIN rv ON rv.patient_id = bl.patient_id AND target", "JOIN nr AS rv ON rv.patient_id = bl.patient_id AND target") + ",\n" + _weights(f"f.o <= {MARGIN}").replace("JOIN rv ON", "JOIN nr AS rv ON")


def _q(body: str, *parts: str, recursive: bool = False) -> str:
    sql = with_views("WITH " + ",\n".join([_MASK, _RIVALS, *parts]) + body, "target_point", "target_structure", "target_dose")
    for name in ("mask", "fm", "fd", "ow"):
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else sql


_OWNED = (_support("t.rx_gy / 2"), _FIELDS, _weights())
CC = gq.CC

ORACLE_SQL = {
    "g15_distance": _q(
        f""" SELECT a.patient_id, a.structure_id, a.k, a.r, a.c, round(coalesce(o.d, 0), 6) AS outside, round(coalesce(i.d, 0), 6) AS inside FROM cl a
        LEFT JOIN (SELECT a.patient_id, a.structure_id, a.k, a.r, a.c, sqrt(min({_DIST})) AS d FROM cl a JOIN mask b USING (patient_id, structure_id) WHERE NOT a.own GROUP BY ALL) o USING (patient_id, structure_id, k, r, c)
        LEFT JOIN (SELECT a.patient_id, a.structure_id, a.k, a.r, a.c, sqrt(min({_DIST})) AS d FROM cl a JOIN cl b USING (patient_id, structure_id) WHERE a.own AND NOT b.own GROUP BY ALL) i USING (patient_id, structure_id, k, r, c)""",
        f"""wb AS (SELECT patient_id, structure_id, {_WIDE} FROM bx),
cl AS (SELECT wb.patient_id, wb.structure_id, x.k, y.r, z.c, m.c IS NOT NULL AS own FROM wb JOIN (SELECT unnest(range({SLICES})) AS k) x ON x.k BETWEEN k0 AND k1 JOIN (SELECT unnest(range({N})) AS r) y ON y.r BETWEEN r0 AND r1
  JOIN (SELECT unnest(range({N})) AS c) z ON z.c BETWEEN c0 AND c1 LEFT JOIN mask m ON m.patient_id = wb.patient_id AND m.structure_id = wb.structure_id AND m.k = x.k AND m.r = y.r AND m.c = z.c)""",
    ),
    "g16_within_margin": _q(
        f""" SELECT z.patient_id, z.structure_id, z.k, z.r, z.c, round(sqrt(min({_DIST.replace('a.', 'z.')})), 6) AS distance FROM
        (SELECT DISTINCT m.patient_id, m.structure_id, m.k + x.k AS k, m.r + y.r AS r, m.c + w.c AS c FROM mask m, (SELECT unnest(range(-2, 3)) AS k) x, (SELECT unnest(range(-2, 3)) AS r) y, (SELECT unnest(range(-2, 3)) AS c) w
          WHERE m.k + x.k BETWEEN 0 AND {SLICES - 1} AND m.r + y.r BETWEEN 0 AND {N - 1} AND m.c + w.c BETWEEN 0 AND {N - 1}) z JOIN mask b USING (patient_id, structure_id) GROUP BY ALL HAVING sqrt(min({_DIST.replace('a.', 'z.')})) <= 3.2"""
    ),
    "t11_ownership": _q(" SELECT patient_id, structure_id, k, r, c, round(weight, 6) AS weight FROM ow", *_OWNED),
    "t12_owned_volumes": _q(
        f""", lv AS (SELECT patient_id, structure_id, 'rx' AS level, rx_gy AS threshold_gy FROM tg UNION ALL SELECT patient_id, structure_id, 'half', rx_gy * 0.5 FROM tg)
        SELECT lv.*, round(coalesce(sum(weight * {CC}), 0), 6) AS volume_cc FROM lv LEFT JOIN (SELECT ow.*, dose_gy FROM ow JOIN target_dose USING (patient_id, k, r, c)) w
          ON w.patient_id = lv.patient_id AND w.structure_id = lv.structure_id AND dose_gy >= threshold_gy GROUP BY ALL""".replace(", lv AS", ", lvl AS").replace("lv.", "lvl.").replace("FROM lv ", "FROM lvl "),
        *_OWNED,
    ),
    "t13_stereotactic_indices": _q(
        f""", own AS (SELECT ow.*, dose_gy, t.rx_gy, t.fractions FROM ow JOIN target_dose USING (patient_id, k, r, c) JOIN tg t USING (patient_id, structure_id)),
        vol AS (SELECT patient_id, structure_id, sum(CASE WHEN dose_gy >= rx_gy THEN weight * {CC} ELSE 0 END) AS iso, sum(CASE WHEN dose_gy >= rx_gy / 2 THEN weight * {CC} ELSE 0 END) AS half FROM own GROUP BY 1, 2),
        brain AS (SELECT m.* FROM mask m JOIN target_structure USING (patient_id, structure_id) WHERE name_norm = 'BRAIN'),
        lesion AS (SELECT h.patient_id, h.whole AS structure_id, m.k, m.r, m.c FROM held h JOIN target_structure s ON s.structure_id = part AND name_norm = 'GTV' JOIN mask m ON m.patient_id = h.patient_id AND m.structure_id = part),
        tis AS (SELECT own.patient_id, own.structure_id, sum(weight * {CC}) AS v FROM own JOIN brain b ON b.patient_id = own.patient_id AND b.k = own.k AND b.r = own.r AND b.c = own.c
          WHERE fractions = 1 AND dose_gy >= 12 AND NOT EXISTS (SELECT 1 FROM lesion l WHERE l.patient_id = own.patient_id AND l.structure_id = own.structure_id AND l.k = own.k AND l.r = own.r AND l.c = own.c)
            OR fractions = 5 AND dose_gy >= 24 GROUP BY 1, 2),
        cov AS (SELECT patient_id, structure_id, avg((dose_gy >= rx_gy)::INT) AS cover FROM mask JOIN target_dose USING (patient_id, k, r, c) JOIN tg USING (patient_id, structure_id) GROUP BY 1, 2)
        SELECT t.patient_id, t.structure_id, round(n * {CC}, 6) AS volume_cc, round(coalesce(iso, 0) / (n * {CC}), 6) AS ci, round(CASE WHEN iso > 0 THEN cover * cover * (n * {CC}) / iso ELSE 0 END, 6) AS pci,
          round(CASE WHEN iso > 0 THEN half / iso ELSE 0 END, 6) AS gi, round(CASE WHEN fractions IN (1, 5) AND t.patient_id IN (SELECT patient_id FROM brain) THEN coalesce(v, 0) END, 6) AS brain_cc
        FROM tg t JOIN cnt USING (patient_id, structure_id) JOIN cov USING (patient_id, structure_id) LEFT JOIN vol USING (patient_id, structure_id) LEFT JOIN tis USING (patient_id, structure_id)
        WHERE EXISTS (SELECT 1 FROM bl WHERE bl.patient_id = t.patient_id AND bl.structure_id = t.structure_id)""",
        _support("least(t.rx_gy / 2, CASE t.fractions WHEN 1 THEN 12 WHEN 5 THEN 24 END)"), _FIELDS, _weights(),
    ),
    "t14_margin_weights": _q(" SELECT patient_id, structure_id, k, r, c, round(weight, 6) AS weight FROM ow", _MARGIN),
    "t15_margin_volumes": _q(
        f""", hot AS (SELECT bl.patient_id, bl.structure_id, v.k, v.r, v.c FROM bl JOIN tg USING (patient_id, structure_id) JOIN target_dose v ON v.patient_id = bl.patient_id AND dose_gy >= rx_gy / 2 AND v.k BETWEEN k0 AND k1 AND v.r BETWEEN r0 AND r1 AND v.c BETWEEN c0 AND c1),
        free AS MATERIALIZED (SELECT bl.patient_id, bl.structure_id, f.k, f.r, f.c, f.r IN (r0, r1) OR f.c IN (c0, c1) AS rim FROM bl, (SELECT k, r, c FROM (SELECT unnest(range({SLICES})) AS k), (SELECT unnest(range({N})) AS r), (SELECT unnest(range({N})) AS c)) f
          WHERE k BETWEEN k0 AND k1 AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 AND NOT EXISTS (SELECT 1 FROM hot h WHERE h.patient_id = bl.patient_id AND h.structure_id = bl.structure_id AND h.k = f.k AND h.r = f.r AND h.c = f.c)),
        reach AS (SELECT patient_id, structure_id, k, r, c FROM free WHERE rim UNION SELECT f.patient_id, f.structure_id, f.k, f.r, f.c FROM reach, (SELECT unnest([[0, 1], [0, -1], [1, 0], [-1, 0]]) AS s) n, free f
          WHERE f.patient_id = reach.patient_id AND f.structure_id = reach.structure_id AND f.k = reach.k AND f.r = reach.r + s[1] AND f.c = reach.c + s[2]),
        any_hot AS (SELECT DISTINCT patient_id, structure_id, k FROM hot)
        SELECT t.patient_id, t.structure_id, t.rx_gy / 2 AS threshold_gy, round(coalesce(sum(weight) FILTER (WHERE a.k IS NOT NULL AND x.k IS NULL) * {CC}, 0), 6) AS volume_cc FROM tg t LEFT JOIN ow USING (patient_id, structure_id)
        LEFT JOIN any_hot a ON a.patient_id = ow.patient_id AND a.structure_id = ow.structure_id AND a.k = ow.k
        LEFT JOIN reach x ON x.patient_id = ow.patient_id AND x.structure_id = ow.structure_id AND x.k = ow.k AND x.r = ow.r AND x.c = ow.c GROUP BY 1, 2, 3""",
        _MARGIN, recursive=True,
    ),
    "t16_threshold_volumes": _q(
        f""" SELECT t.patient_id, t.structure_id, {LEVEL}::DOUBLE AS threshold_gy, round(coalesce(sum(weight) * {CC}, 0), 6) AS volume_cc FROM tg t
        LEFT JOIN (SELECT ow.* FROM ow JOIN target_dose USING (patient_id, k, r, c) WHERE dose_gy >= {LEVEL}) w USING (patient_id, structure_id) GROUP BY 1, 2""",
        _support(str(LEVEL)), _FIELDS, _weights(),
    ),
}
