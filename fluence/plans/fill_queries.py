"""Queries over holes in three dimensions and isodose volumes near a structure; SQL floods the background cell by cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fills, surfaces
from ..shipping import kept
from ..sources.standins import view, with_views
from . import surface_queries as sq

P, S = sq.P, sq.S
#: Doses at or above which a cell is in a mask: one for each structure of g14, in order of their ids.
LEVELS = (10.0, 15.0, 20.0)
#: Millimetres around a structure, as for small targets.
NEAR = 5.0


def g14_filled_volumes(spark, sf):
    """Three isodoses of every grid of 8 x 8 x 8 cells with their cavities, as merged spans."""
    cell = view(spark, sf, "fine_dose").withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("structure_id"), F.lit(v).alias("level")) for i, v in enumerate(LEVELS)))))
    hot = kept(fills.as_spans(cell.filter("dose_gy >= x.level").select(P, "x.structure_id", "k", "r", "c")))
    return fills.filled_volumes(hot, surfaces.boxes(hot))


def g21_margin_isodose(spark, sf):
    """Each target at half of its dose and at LEVEL, by whole cells and by shares."""
    t = sq._targets(spark, sf).select(*S, F.explode(F.array(F.col("rx_gy") / 2, F.lit(sq.LEVEL))).alias("threshold_gy"))
    x = fills.margin_isodose(t, sq._spans(spark, sf), sq._dose(spark, sf), NEAR, sq.SX, sq.SY, sq.DZ, sq.SLICES, sq.N, sq.N)
    return x.select(*S, "threshold_gy", F.round("volume_cc", 6).alias("volume_cc"), F.round("share_cc", 6).alias("share_cc"))


QUERIES = {f.__name__: f for f in (g14_filled_volumes, g21_margin_isodose)}

_WIDE = ", ".join(
    f"greatest(0, min({a}) - {int(-(-NEAR // step))}) AS {a}0, least({n - 1}, max({a}) + {int(-(-NEAR // step))}) AS {a}1" for a, step, n in (("k", sq.DZ, sq.SLICES), ("r", sq.SY, sq.N), ("c", sq.SX, sq.N))
)


def _reach(name: str, free: str, keys: str, rim: str, steps: str) -> str:
    """Free cells that side-by-side cells join to the rim."""
    same = " AND ".join(f"f.{x} = g.{x}" for x in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, k, r, c FROM {free} WHERE {rim} UNION SELECT {', '.join('f.' + x for x in keys.split(', '))}, f.k, f.r, f.c FROM {name} g,
  (SELECT unnest({steps}) AS s) n, {free} f WHERE {same} AND f.k = g.k + s[1] AND f.r = g.r + s[2] AND f.c = g.c + s[3])"""


_FLAT = "[[0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]"
_SOLID = "[[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]"
_SLOPE = """CASE WHEN lag(dose_gy) OVER {w} IS NULL AND lead(dose_gy) OVER {w} IS NULL THEN 0 ELSE (coalesce(lead(dose_gy) OVER {w}, dose_gy) - coalesce(lag(dose_gy) OVER {w}, dose_gy))
  / (((lag(dose_gy) OVER {w} IS NOT NULL)::INT + (lead(dose_gy) OVER {w} IS NOT NULL)::INT) * {step}::DOUBLE) END"""

ORACLE_SQL = {
    "g14_filled_volumes": with_views(
        f"""WITH hot AS MATERIALIZED (SELECT patient_id, s.id AS structure_id, k, r, c FROM fine_dose, (VALUES {', '.join(f'({i}::BIGINT, {v}::DOUBLE)' for i, v in enumerate(LEVELS))}) s(id, level) WHERE dose_gy >= level),
        bx AS (SELECT patient_id, structure_id, {sq._BOX} FROM hot GROUP BY 1, 2),
        free AS MATERIALIZED (SELECT patient_id, structure_id, x.k, y.r, z.c, x.k IN (k0, k1) OR y.r IN (r0, r1) OR z.c IN (c0, c1) AS rim FROM bx, (SELECT unnest(range(8)) AS k) x, (SELECT unnest(range(8)) AS r) y, (SELECT unnest(range(8)) AS c) z
          WHERE x.k BETWEEN k0 AND k1 AND y.r BETWEEN r0 AND r1 AND z.c BETWEEN c0 AND c1 AND NOT EXISTS (SELECT 1 FROM hot h WHERE h.patient_id = bx.patient_id AND h.structure_id = bx.structure_id AND h.k = x.k AND h.r = y.r AND h.c = z.c)),
        {_reach('reach', 'free', 'patient_id, structure_id', 'rim', _SOLID)},
        whole AS (SELECT patient_id, structure_id, k, r, c FROM hot UNION SELECT patient_id, structure_id, k, r, c FROM free f WHERE NOT EXISTS
          (SELECT 1 FROM reach g WHERE g.patient_id = f.patient_id AND g.structure_id = f.structure_id AND g.k = f.k AND g.r = f.r AND g.c = f.c))
        SELECT patient_id, structure_id, k, r, min(c)::BIGINT AS c_lo, (max(c) + 1)::BIGINT AS c_hi FROM (SELECT *, c - row_number() OVER (PARTITION BY patient_id, structure_id, k, r ORDER BY c) AS run FROM whole) GROUP BY patient_id, structure_id, k, r, run""",
        "fine_dose",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "g21_margin_isodose": sq._q(
        f""", asked AS (SELECT patient_id, structure_id, rx_gy / 2 AS threshold_gy FROM tg UNION ALL SELECT patient_id, structure_id, {sq.LEVEL}::DOUBLE FROM tg),
        bl AS (SELECT patient_id, structure_id, {_WIDE} FROM mask GROUP BY 1, 2),
        gr AS MATERIALIZED (SELECT a.*, f.k, f.r, f.c, coalesce(v.dose_gy, 0) AS dose_gy, f.k IN (k0, k1) AS lid, f.r IN (r0, r1) OR f.c IN (c0, c1) AS side FROM asked a JOIN bl USING (patient_id, structure_id)
          JOIN (SELECT k, r, c FROM (SELECT unnest(range({sq.SLICES})) AS k), (SELECT unnest(range({sq.N})) AS r), (SELECT unnest(range({sq.N})) AS c)) f ON f.k BETWEEN k0 AND k1 AND f.r BETWEEN r0 AND r1 AND f.c BETWEEN c0 AND c1
          LEFT JOIN target_dose v ON v.patient_id = a.patient_id AND v.k = f.k AND v.r = f.r AND v.c = f.c),
        cold AS MATERIALIZED (SELECT * FROM gr WHERE dose_gy < threshold_gy),
        {_reach('flat', 'cold', 'patient_id, structure_id, threshold_gy', 'side', _FLAT)},
        {_reach('solid', 'cold', 'patient_id, structure_id, threshold_gy', 'side OR lid', _SOLID)},
        sl AS (SELECT *, {_SLOPE.format(w='wk', step=sq.DZ)} AS gk, {_SLOPE.format(w='wr', step=sq.SY)} AS gw, {_SLOPE.format(w='wc', step=sq.SX)} AS gc FROM gr
          WINDOW wk AS (PARTITION BY patient_id, structure_id, threshold_gy, r, c ORDER BY k), wr AS (PARTITION BY patient_id, structure_id, threshold_gy, k, c ORDER BY r), wc AS (PARTITION BY patient_id, structure_id, threshold_gy, k, r ORDER BY c)),
        ds AS (SELECT patient_id, structure_id, a.k, a.r, a.c FROM (SELECT DISTINCT patient_id, structure_id, k, r, c FROM gr) a JOIN mask b USING (patient_id, structure_id) GROUP BY ALL
          HAVING min(pow({sq.SX}::DOUBLE * (a.c - b.c), 2) + pow({sq.SY}::DOUBLE * (a.r - b.r), 2) + pow({sq.DZ}::DOUBLE * (a.k - b.k), 2)) <= {NEAR * NEAR})
        SELECT a.patient_id, a.structure_id, a.threshold_gy, round(coalesce(sum((z.k IS NULL)::INT) FILTER (WHERE s.k IS NOT NULL), 0) * {sq.CC}, 6) AS volume_cc,
          round(coalesce(sum(CASE WHEN w.k IS NULL THEN 1.0 ELSE greatest(0, least(1, 0.5 + (dose_gy - a.threshold_gy) / greatest(sqrt(gk * gk + gw * gw + gc * gc), 1e-3) / sqrt({sq.SX * sq.SX + sq.SY * sq.SY + sq.DZ * sq.DZ}::DOUBLE))) END) FILTER (WHERE s.k IS NOT NULL), 0) * {sq.CC}, 6) AS share_cc
        FROM asked a LEFT JOIN (SELECT sl.* FROM sl SEMI JOIN ds USING (patient_id, structure_id, k, r, c)) s USING (patient_id, structure_id, threshold_gy)
        LEFT JOIN flat z ON z.patient_id = s.patient_id AND z.structure_id = s.structure_id AND z.threshold_gy = s.threshold_gy AND z.k = s.k AND z.r = s.r AND z.c = s.c
        LEFT JOIN solid w ON w.patient_id = s.patient_id AND w.structure_id = s.structure_id AND w.threshold_gy = s.threshold_gy AND w.k = s.k AND w.r = s.r AND w.c = s.c GROUP BY 1, 2, 3""",
        recursive=True,
    ),
}
