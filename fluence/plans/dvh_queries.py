"""Queries over dose samples and goals, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dvh, goals
from ..sources.standins import view, with_views

W = 0.5  # bin width of the registered queries: about 200 bins

# The DuckDB side, in steps that queries share.
HIST = f"""
top AS (SELECT patient_id, max(dose_gy) AS m FROM dose_sample GROUP BY 1),
binned AS (SELECT s.*, ceil(greatest(m, {W}) / {W})::INT AS n FROM dose_sample s JOIN top USING (patient_id) WHERE weight_cc > 0),
placed AS (SELECT *, least(floor(greatest(0, least(dose_gy, n * {W})) / {W}), n - 1)::INT AS bin FROM binned),
hist AS (SELECT patient_id, structure, n, bin, sum(weight_cc) AS cc, sum(dose_gy * weight_cc) AS dcc, min(dose_gy) AS lo, max(dose_gy) AS hi, count(*) AS cnt FROM placed GROUP BY 1, 2, 3, 4),
tot AS (SELECT patient_id, structure, sum(cc) AS volume_cc, sum(dcc) / sum(cc) AS mean_gy, min(lo) AS min_gy, max(hi) AS max_gy, sum(cnt)::BIGINT AS n_samples, max(n) AS n FROM hist GROUP BY 1, 2),
edge AS (SELECT patient_id, structure, volume_cc AS total, unnest(range(0, n + 1))::INT AS bin FROM tot),
curve AS (SELECT e.patient_id, e.structure, e.bin, e.bin * {W}::DOUBLE AS dose_gy, sum(coalesce(cc, 0)) OVER w AS volume_cc, sum(coalesce(cc, 0)) OVER w / total * 100 AS volume_pct
  FROM edge e LEFT JOIN hist h ON e.patient_id = h.patient_id AND e.structure = h.structure AND e.bin = h.bin
  WINDOW w AS (PARTITION BY e.patient_id, e.structure ORDER BY e.bin DESC ROWS UNBOUNDED PRECEDING))"""

STEP = """
step AS (SELECT *, lead(dose_gy) OVER w AS d1, lead(volume_cc) OVER w AS cc1, lead(volume_pct) OVER w AS pct1, lag(dose_gy) OVER w AS d0, lag(volume_pct) OVER w AS pct0, lag(volume_cc) OVER w AS cc0
  FROM curve WINDOW w AS (PARTITION BY patient_id, structure ORDER BY bin))"""


def v_sql(asked: str, name: str = "v_at") -> str:
    """asked: a relation with patient_id, structure, dose."""
    return f"""
{name} AS (SELECT q.patient_id, q.structure, q.dose,
    CASE WHEN q.dose <= 0 THEN f.cc ELSE coalesce(s.volume_cc + (q.dose - s.dose_gy) / (s.d1 - s.dose_gy) * (s.cc1 - s.volume_cc), 0) END AS v_cc,
    CASE WHEN q.dose <= 0 THEN 100.0 ELSE coalesce(s.volume_pct + (q.dose - s.dose_gy) / (s.d1 - s.dose_gy) * (s.pct1 - s.volume_pct), 0) END AS v_pct
  FROM {asked} q JOIN (SELECT patient_id, structure, volume_cc AS cc FROM tot) f USING (patient_id, structure)
  LEFT JOIN step s ON s.patient_id = q.patient_id AND s.structure = q.structure AND q.dose >= s.dose_gy AND q.dose < s.d1)"""


def d_sql(asked: str, axis: str = "pct", name: str = "d_at") -> str:
    """asked: a relation with patient_id, structure, volume."""
    v, v0, limit = (f"volume_{axis}", f"{axis}0", "100.0" if axis == "pct" else "greatest(volume_cc, 0)")
    return f"""
{name}_q AS (SELECT q.*, t.min_gy, t.max_gy, greatest(0.0, least(q.volume, {limit})) AS tgt FROM {asked} q JOIN tot t USING (patient_id, structure)),
{name}_f AS (SELECT patient_id, structure, max({v}) AS whole FROM curve GROUP BY 1, 2),
{name}_c AS (SELECT q.patient_id, q.structure, q.volume, min_by(s.dose_gy + (q.tgt - s.{v}) / (s.{v0} - s.{v}) * (s.d0 - s.dose_gy), s.bin) AS hit
  FROM {name}_q q JOIN step s ON s.patient_id = q.patient_id AND s.structure = q.structure AND s.{v} < q.tgt AND s.{v0} >= q.tgt GROUP BY 1, 2, 3),
{name} AS (SELECT q.patient_id, q.structure, q.volume, CASE WHEN tgt <= 0 THEN max_gy WHEN tgt >= whole THEN min_gy ELSE hit END AS dose_gy
  FROM {name}_q q JOIN {name}_f USING (patient_id, structure) LEFT JOIN {name}_c c ON c.patient_id = q.patient_id AND c.structure = q.structure AND c.volume = q.volume)"""


def _hist(spark, sf):
    return dvh.histogram(view(spark, sf, "dose_sample"), W)


def _curves(spark, sf):
    return dvh.curves(_hist(spark, sf))


def r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


def up(name: str):
    """Rounded to six places; exact halves, which engines reach with different last bits, go up."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


def a1_weighted_histogram(spark, sf):
    return _hist(spark, sf).select("patient_id", "structure", "bin", r("hist_cc"), r("dose_cc"), "min_gy", "max_gy", "n_samples")


def a2_cumulative_curve(spark, sf):
    return dvh.curve(_curves(spark, sf), W).select("patient_id", "structure", "bin", r("dose_gy"), r("volume_cc"), r("volume_pct"))


def d1_curve_summary(spark, sf):
    return _curves(spark, sf).select("patient_id", "structure", r("volume_cc"), r("mean_gy"), "min_gy", "max_gy", "n_samples", "n_bins")


def a3_unweighted_curve(spark, sf):
    return dvh.unweighted(view(spark, sf, "dose_sample").filter("weight_cc > 0")).select("patient_id", "structure", "bin", "dose_gy", r("volume_pct"))


def a4_fast_summary(spark, sf):
    """Voxel count times voxel volume, mean, minimum and maximum."""
    s = view(spark, sf, "dose_sample").filter("weight_cc > 0")
    return s.groupBy("patient_id", "structure").agg(F.count("*").alias("voxel_count"), F.round(F.count("*") * 0.008, 6).alias("volume_cc"), F.round(F.avg("dose_gy"), 6).alias("mean_gy"), F.min("dose_gy").alias("min_gy"), F.max("dose_gy").alias("max_gy"))


def a5_bin_edges(spark, sf):
    top = view(spark, sf, "dose_sample").groupBy("patient_id").agg(F.max("dose_gy").alias("m"))
    return top.select("patient_id", F.explode(F.sequence(F.lit(0), dvh.bin_count(F.col("m"), W))).alias("bin")).select("patient_id", "bin", (F.col("bin") * W).alias("edge_gy"))


DOSES, VOLUMES = (-1.0, 0.0, 12.3, 20.0, 47.25, 99.9, 300.0), (-5.0, 0.0, 0.5, 33.3, 95.0, 99.99, 100.0, 120.0)


def _asked(spark, sf, name, values):
    """Every curve with each of the values."""
    return _curves(spark, sf).withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))


def _asked_sql(name, values):
    return f"asked AS (SELECT patient_id, structure, unnest([{', '.join(map(str, values))}])::DOUBLE AS {name} FROM tot)"


def d7_volume_at_dose(spark, sf):
    got = _asked(spark, sf, "dose", DOSES).withColumn("v", dvh.v_at(F.col("dose"), W))
    return got.select("patient_id", "structure", "dose", "v.*").select("patient_id", "structure", "dose", up("v_cc"), up("v_pct"))


def d8_dose_at_volume_pct(spark, sf):
    got = _asked(spark, sf, "volume", VOLUMES).withColumn("dose_gy", dvh.d_at(F.col("volume"), width=W))
    return got.select("patient_id", "structure", "volume", up("dose_gy"))


def d9_dose_at_volume_cc(spark, sf):
    got = _asked(spark, sf, "volume", (-1.0, 0.0, 2.5, 300.0, 1e9)).withColumn("dose_gy", dvh.d_at(F.col("volume"), "volume_cc", W))
    return got.select("patient_id", "structure", "volume", up("dose_gy"))


def w10_truncated_curve(spark, sf):
    return dvh.truncated(_curves(spark, sf), W).select("patient_id", "structure", "bin", r("volume_pct"))


def a13_max_plotted_dose(spark, sf):
    return dvh.largest_plotted(_curves(spark, sf), W)


def d11_curve_readout(spark, sf):
    held = F.greatest(F.lit(0.0), F.least("dose", dvh.truncated_end() * W))
    got = _asked(spark, sf, "dose", DOSES).withColumn("v", dvh.v_at(held, W))
    return got.select("patient_id", "structure", "dose", "v.*").select("patient_id", "structure", "dose", r("v_cc"), r("v_pct"))


def d13_hottest_volume(spark, sf):
    return dvh.hottest_volume(view(spark, sf, "dose_sample"), 75.5).select("patient_id", "structure", up("dose_gy"))


def _evaluated(spark, sf):
    curves = _curves(spark, sf)
    return goals.evaluate(view(spark, sf, "goal"), curves, W)


def c2_evaluate_goals(spark, sf):
    return _evaluated(spark, sf).select("patient_id", "structure", "goal_no", "metric", "comparator", "value_text", r("actual_value"), "actual_unit", "passed", "status")


def d12_constraint_markers(spark, sf):
    return dvh.markers(goals.parsed(view(spark, sf, "goal")), _curves(spark, sf)).select("patient_id", "structure", "goal_no", r("x_gy"), r("y_pct"))


def c3_evaluate_with_reuse(spark, sf):
    """Saved results of every third goal's structures stand, others are evaluated."""
    fresh = _evaluated(spark, sf).select("patient_id", "structure", "goal_no", "status")
    saved = fresh.filter("patient_id % 3 = 0 and structure <> 'RF'").withColumn("status", F.lit("saved"))
    selected = view(spark, sf, "structure").filter("ordinal <> 2").select("patient_id", "structure")
    return goals.with_reuse(selected, saved, fresh)


def _typed(spark, sf):
    """What reviewers typed, made from the goals: some repeat goals in other spelling, some do not parse."""
    g = view(spark, sf, "goal")
    return g.select("patient_id", "structure", F.lower("metric").alias("metric"), F.when(F.col("goal_no") % 3 == 0, F.concat(F.trim("comparator"), F.lit("  "), F.lower("value_text"))).when(F.col("goal_no") % 3 == 1, F.concat(F.lit("<= "), F.col("goal_no").cast("string"), F.lit(" Gy"))).otherwise("soon").alias("goal_text"), (F.col("goal_no") + 1000000).alias("typed_no"))


TYPED = """typed AS (SELECT patient_id, structure, lower(metric) AS metric, CASE WHEN goal_no % 3 = 0 THEN trim(comparator) || '  ' || lower(value_text) WHEN goal_no % 3 = 1 THEN '<= ' || goal_no::VARCHAR || ' Gy' ELSE 'soon' END AS goal_text, goal_no + 1000000 AS typed_no FROM goal)"""


def c4_custom_goals(spark, sf):
    return goals.custom_goals(_typed(spark, sf), view(spark, sf, "goal"))


def j12_custom_only(spark, sf):
    merged = goals.custom_goals(_typed(spark, sf), view(spark, sf, "goal"))
    return goals.custom_only(merged.filter("source = 'sheet'"), merged)


def c5_min_volume(spark, sf):
    curves = _curves(spark, sf)
    return goals.min_volume(view(spark, sf, "goal"), curves, "NF", "BRAND", W)


def _stored(spark, sf):
    g = view(spark, sf, "goal").filter("goal_no % 4 = 0")
    key = t.note_key(t.normal_name(F.col("structure")), F.col("metric"), F.col("comparator"), F.col("value_text"))
    return g.groupBy("patient_id", key.alias("note_key")).agg(F.concat(F.lit("seen "), F.min("goal_no").cast("string")).alias("note_text"))


def c7_report_rows(spark, sf):
    curves = _curves(spark, sf)
    bladder = goals.min_volume(view(spark, sf, "goal"), curves, "NF", "BRAND", W)
    return goals.presented(goals.evaluate(view(spark, sf, "goal"), curves, W), _stored(spark, sf), bladder)


def u4_merged_notes(spark, sf):
    script = _stored(spark, sf)
    user = script.filter("patient_id % 2 = 0").withColumn("note_text", F.when(F.col("patient_id") % 4 == 0, F.concat("note_text", F.lit("    more"))).otherwise("own"))
    return goals.merged_notes(script, user)


def c9_recompute(spark, sf):
    return goals.to_recompute(view(spark, sf, "structure"), _hist(spark, sf))


PARSED = r"""
g0 AS (SELECT *, upper(trim(regexp_replace(structure, '\s+', ' ', 'g'))) AS s, upper(replace(trim(metric), ' ', '')) AS mk, trim(value_text) AS vt, trim(comparator) AS cmp FROM goal),
g1 AS (SELECT *, regexp_extract(vt, '^\s*([<>]=?|=)?\s*([-+]?\d*\.?\d+)\s*([A-Za-z%]+)?\s*$', ['c', 'n', 'u']) AS one, regexp_extract(vt, '^\s*([-+]?\d*\.?\d+)\s*-\s*([-+]?\d*\.?\d+)\s*([A-Za-z%]+)?\s*$', ['a', 'b', 'u']) AS two,
  try_cast(nullif(regexp_extract(mk, '^V([-+]?\d*\.?\d+)(GY)?$', 1), '') AS DOUBLE) AS v_dose,
  try_cast(nullif(regexp_extract(mk, '^D([-+]?\d*\.?\d+)(CC|%)$', 1), '') AS DOUBLE) AS d_value, regexp_extract(mk, '^D([-+]?\d*\.?\d+)(CC|%)$', 2) AS d_unit FROM g0),
pg AS (SELECT patient_id, set_id, goal_no, s AS structure, metric, cmp AS comparator, value_text, mk, v_dose, d_value, d_unit,
  CASE WHEN one.n <> '' THEN try_cast(one.n AS DOUBLE) WHEN two.a <> '' THEN try_cast(two.a AS DOUBLE) END AS goal_value,
  CASE WHEN one.n <> '' THEN upper(one.u) WHEN two.a <> '' THEN upper(two.u) ELSE vt END AS goal_unit,
  CASE WHEN two.b <> '' THEN try_cast(two.b AS DOUBLE) END AS lim FROM g1)"""

EVALUATED = (
    PARSED
    + ", pv AS (SELECT DISTINCT patient_id, structure, v_dose AS dose FROM pg JOIN tot USING (patient_id, structure) WHERE v_dose IS NOT NULL),"
    + v_sql("pv")
    + ", gd AS (SELECT pg.*, t.mean_gy, t.min_gy, t.max_gy, CASE WHEN d_unit = '%' THEN d_value WHEN d_unit = 'CC' AND t.volume_cc > 0 THEN 100 * d_value / t.volume_cc END AS d_pct FROM pg JOIN tot t USING (patient_id, structure)),"
    + " pd AS (SELECT DISTINCT patient_id, structure, d_pct AS volume FROM gd WHERE d_pct IS NOT NULL),"
    + d_sql("pd")
    + """, ev AS (SELECT gd.*, CASE WHEN mk IN ('MEAN', 'DMEAN') THEN mean_gy WHEN mk IN ('MAX', 'DMAX') THEN max_gy WHEN mk IN ('MIN', 'DMIN') THEN gd.min_gy
    WHEN gd.v_dose IS NOT NULL THEN CASE WHEN goal_unit = '%' THEN v_pct ELSE v_cc END ELSE d_at.dose_gy END AS actual_value,
    CASE WHEN gd.v_dose IS NOT NULL THEN CASE WHEN goal_unit = '%' THEN '%' ELSE 'CC' END ELSE 'GY' END AS actual_unit
  FROM gd LEFT JOIN v_at ON v_at.patient_id = gd.patient_id AND v_at.structure = gd.structure AND v_at.dose = gd.v_dose
  LEFT JOIN d_at ON d_at.patient_id = gd.patient_id AND d_at.structure = gd.structure AND d_at.volume = gd.d_pct),
es AS (SELECT *, CASE WHEN actual_value IS NULL OR goal_value IS NULL THEN ''
    WHEN comparator = '<' AND actual_value < goal_value OR comparator = '<=' AND actual_value <= goal_value OR comparator = '>' AND actual_value > goal_value OR comparator = '>=' AND actual_value >= goal_value THEN 'pass'
    WHEN comparator IN ('<', '<=') AND actual_value <= lim OR comparator IN ('>', '>=') AND actual_value >= lim THEN 'variation'
    WHEN comparator IN ('<', '<=', '>', '>=') THEN 'fail'
    WHEN comparator IN ('=', '==') THEN CASE WHEN abs(actual_value - goal_value) <= 1e-8 + 1e-5 * abs(goal_value) THEN 'pass' ELSE 'fail' END ELSE '' END AS status FROM ev)"""
)

KEY = "upper(replace(trim(metric), ' ', '')) || '|' || trim(comparator) || '|' || upper(trim(value_text))"
MERGED = (
    TYPED
    + rf""", ty AS (SELECT patient_id, upper(trim(regexp_replace(structure, '\s+', ' ', 'g'))) AS structure, trim(metric) AS metric, regexp_extract(goal_text, '^\s*(<=|>=|<|>|==|=)\s*(.+?)\s*$', 1) AS comparator, regexp_extract(goal_text, '^\s*(<=|>=|<|>|==|=)\s*(.+?)\s*$', 2) AS value_text, typed_no FROM typed),
old AS (SELECT patient_id, upper(trim(regexp_replace(structure, '\s+', ' ', 'g'))) AS structure, metric, comparator, value_text, goal_no AS no, 'sheet' AS source, {KEY} AS key FROM goal),
new AS (SELECT *, {KEY} AS key, row_number() OVER (PARTITION BY patient_id, structure, {KEY} ORDER BY typed_no) AS rn FROM ty WHERE comparator <> '' AND structure <> '' AND metric <> ''),
merged AS (SELECT patient_id, structure, metric, comparator, value_text, no, source FROM old UNION ALL
  SELECT patient_id, structure, metric, comparator, value_text, typed_no, 'custom' FROM new WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.patient_id = new.patient_id AND old.structure = new.structure AND old.key = new.key))"""
)

MIN_VOLUME = """ bladder AS (SELECT pg.patient_id, pg.structure, max(CASE WHEN goal_unit = '%' AND goal_value > 0 THEN v_cc / (goal_value / 100) END) AS need, coalesce(max(CASE WHEN goal_unit = 'CC' THEN (v_cc > goal_value + 1e-6)::INT END), 0) AS over_cc
  FROM pg JOIN v_at ON v_at.patient_id = pg.patient_id AND v_at.structure = pg.structure AND v_at.dose = pg.v_dose
  WHERE pg.structure = 'NF' AND contains(upper(set_id), 'BRAND') AND comparator IN ('<', '<=', '=', '==') AND goal_value IS NOT NULL GROUP BY 1, 2),
bnote AS (SELECT patient_id, structure, CASE WHEN over_cc = 1 THEN 'Min volume n/a' ELSE 'Min volume ' || ceil(need - 1e-9)::BIGINT::VARCHAR || ' cc' END AS note FROM bladder WHERE over_cc = 1 OR need > 0)"""

NOTE_KEY = "concat_ws('||', structure, trim(metric), trim(comparator), trim(value_text))"
STORED = rf"""stored AS (SELECT patient_id, note_key, 'seen ' || min(goal_no)::VARCHAR AS note_text FROM
  (SELECT patient_id, goal_no, concat_ws('||', upper(trim(regexp_replace(structure, '\s+', ' ', 'g'))), trim(metric), trim(comparator), trim(value_text)) AS note_key FROM goal WHERE goal_no % 4 = 0) GROUP BY 1, 2)"""


def _compose(a: str, b: str) -> str:
    c, s = f"trim(coalesce({a}, ''))", f"trim(coalesce({b}, ''))"
    return f"CASE WHEN {c} = '' THEN {s} WHEN {s} = '' THEN {c} WHEN {s} = {c} OR starts_with({s}, {c} || '    ') THEN {s} ELSE {c} || '    ' || {s} END"


def _sample(body: str) -> str:
    return with_views("WITH " + HIST.strip() + body, "dose_sample")


def _goal(body: str) -> str:
    return with_views("WITH " + HIST.strip() + "," + STEP + "," + EVALUATED + body, "dose_sample", "goal")


QUERIES = {
    f.__name__: f
    for f in (
        a1_weighted_histogram, a2_cumulative_curve, a3_unweighted_curve, a4_fast_summary, a5_bin_edges, a13_max_plotted_dose, c2_evaluate_goals, c3_evaluate_with_reuse, c4_custom_goals,
        c5_min_volume, c7_report_rows, c9_recompute, d1_curve_summary, d7_volume_at_dose, d8_dose_at_volume_pct, d9_dose_at_volume_cc, d11_curve_readout, d12_constraint_markers,
        d13_hottest_volume, j12_custom_only, u4_merged_notes, w10_truncated_curve,
    )
}

TRUNCATED = ", cut AS (SELECT *, min(CASE WHEN volume_pct <= 1e-6 THEN bin END) OVER (PARTITION BY patient_id, structure) AS stop FROM curve), kept AS (SELECT * FROM cut WHERE stop IS NULL OR bin <= greatest(stop, 1))"

ORACLE_SQL = {
    "a1_weighted_histogram": _sample(" SELECT patient_id, structure, bin, round(cc, 6) AS hist_cc, round(dcc, 6) AS dose_cc, lo AS min_gy, hi AS max_gy, cnt AS n_samples FROM hist"),
    "a2_cumulative_curve": _sample(" SELECT patient_id, structure, bin, round(dose_gy, 6) AS dose_gy, round(volume_cc, 6) AS volume_cc, round(volume_pct, 6) AS volume_pct FROM curve"),
    "d1_curve_summary": _sample(" SELECT patient_id, structure, round(volume_cc, 6) AS volume_cc, round(mean_gy, 6) AS mean_gy, min_gy, max_gy, n_samples, n AS n_bins FROM tot"),
    "a3_unweighted_curve": with_views(
        """WITH s AS (SELECT * FROM dose_sample WHERE weight_cc > 0), top AS (SELECT patient_id, greatest(max(dose_gy), 0.001) AS m FROM s GROUP BY 1),
        b AS (SELECT s.patient_id, structure, m, least(greatest(floor(dose_gy / (m / 256)) - CASE WHEN floor(dose_gy / (m / 256)) * (m / 256) > dose_gy THEN 1 ELSE 0 END + CASE WHEN (floor(dose_gy / (m / 256)) + 1) * (m / 256) <= dose_gy THEN 1 ELSE 0 END, 0), 255)::INT AS bin FROM s JOIN top USING (patient_id)),
        h AS (SELECT patient_id, structure, bin, m, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT patient_id, structure, sum(n) AS total, max(m) AS m FROM h GROUP BY 1, 2),
        e AS (SELECT *, unnest(range(0, 256))::INT AS bin FROM t)
        SELECT e.patient_id, e.structure, e.bin, e.bin * e.m / 256 AS dose_gy, round(sum(coalesce(h.n, 0)) OVER (PARTITION BY e.patient_id, e.structure ORDER BY e.bin DESC ROWS UNBOUNDED PRECEDING) / total * 100, 6) AS volume_pct
        FROM e LEFT JOIN h ON h.patient_id = e.patient_id AND h.structure = e.structure AND h.bin = e.bin""",
        "dose_sample",
    ),
    "a4_fast_summary": with_views("SELECT patient_id, structure, count(*) AS voxel_count, round(count(*) * 0.008::DOUBLE, 6) AS volume_cc, round(avg(dose_gy), 6) AS mean_gy, min(dose_gy) AS min_gy, max(dose_gy) AS max_gy FROM dose_sample WHERE weight_cc > 0 GROUP BY 1, 2", "dose_sample"),
    "a5_bin_edges": with_views(f"SELECT patient_id, bin::INT AS bin, bin * {W}::DOUBLE AS edge_gy FROM (SELECT patient_id, unnest(range(0, ceil(greatest(max(dose_gy), {W}) / {W})::INT + 1)) AS bin FROM dose_sample GROUP BY 1)", "dose_sample"),
    "d7_volume_at_dose": _sample("," + STEP + ", " + _asked_sql("dose", DOSES) + "," + v_sql("asked") + " SELECT patient_id, structure, dose, round(v_cc + 1e-9, 6) AS v_cc, round(v_pct + 1e-9, 6) AS v_pct FROM v_at"),
    "d8_dose_at_volume_pct": _sample("," + STEP + ", " + _asked_sql("volume", VOLUMES) + "," + d_sql("asked") + " SELECT patient_id, structure, volume, round(dose_gy + 1e-9, 6) AS dose_gy FROM d_at"),
    "d9_dose_at_volume_cc": _sample("," + STEP + ", " + _asked_sql("volume", (-1.0, 0.0, 2.5, 300.0, 1e9)) + "," + d_sql("asked", "cc") + " SELECT patient_id, structure, volume, round(dose_gy + 1e-9, 6) AS dose_gy FROM d_at"),
    "w10_truncated_curve": _sample(TRUNCATED + " SELECT patient_id, structure, bin, round(volume_pct, 6) AS volume_pct FROM kept"),
    "a13_max_plotted_dose": _sample(TRUNCATED + " SELECT patient_id, greatest(max(dose_gy), 1.0) AS max_plotted_gy FROM kept GROUP BY 1"),
    "d11_curve_readout": _sample(
        "," + STEP + TRUNCATED + f", raw AS (SELECT patient_id, structure, unnest([{', '.join(map(str, DOSES))}])::DOUBLE AS wanted FROM tot), stop AS (SELECT patient_id, structure, max(dose_gy) AS stop FROM kept GROUP BY 1, 2), asked AS (SELECT DISTINCT patient_id, structure, greatest(0, least(wanted, stop)) AS dose FROM raw JOIN stop USING (patient_id, structure)),"
        + v_sql("asked") + " SELECT r.patient_id, r.structure, r.wanted AS dose, round(v_cc, 6) AS v_cc, round(v_pct, 6) AS v_pct FROM raw r JOIN stop s USING (patient_id, structure) JOIN v_at v ON v.patient_id = r.patient_id AND v.structure = r.structure AND v.dose = greatest(0, least(r.wanted, s.stop))"
    ),
    "d13_hottest_volume": with_views(
        """WITH s AS (SELECT patient_id, structure, dose_gy, sum(weight_cc) AS w FROM dose_sample WHERE weight_cc > 0 GROUP BY 1, 2, 3),
        c AS (SELECT *, sum(w) OVER k AS cum FROM s WINDOW k AS (PARTITION BY patient_id, structure ORDER BY dose_gy DESC ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT *, lag(cum) OVER k AS c0, lag(dose_gy) OVER k AS d0 FROM c WINDOW k AS (PARTITION BY patient_id, structure ORDER BY dose_gy DESC))
        SELECT patient_id, structure, round(coalesce(min_by(CASE WHEN cum >= 75.5 THEN CASE WHEN c0 IS NULL THEN dose_gy ELSE d0 + (75.5 - c0) / (cum - c0) * (dose_gy - d0) END END, CASE WHEN cum >= 75.5 THEN cum END), min(dose_gy)) + 1e-9, 6) AS dose_gy FROM p GROUP BY 1, 2""",
        "dose_sample",
    ),
    "c2_evaluate_goals": _goal(" SELECT patient_id, structure, goal_no, metric, comparator, value_text, round(actual_value, 6) AS actual_value, actual_unit, CASE status WHEN 'pass' THEN true WHEN 'fail' THEN false END AS passed, status FROM es"),
    "d12_constraint_markers": _goal(
        """ SELECT * FROM (SELECT patient_id, structure, goal_no, round(CASE WHEN v_dose IS NOT NULL AND goal_value IS NOT NULL THEN v_dose WHEN d_value IS NOT NULL AND goal_value IS NOT NULL AND goal_unit IN ('', 'GY') THEN goal_value END, 6) AS x_gy,
        round(CASE WHEN v_dose IS NOT NULL AND goal_value IS NOT NULL THEN CASE WHEN goal_unit = '%' THEN goal_value WHEN volume_cc > 0 THEN 100 * goal_value / volume_cc END
          WHEN d_value IS NOT NULL AND goal_value IS NOT NULL AND goal_unit IN ('', 'GY') THEN CASE WHEN d_unit = '%' THEN d_value WHEN volume_cc > 0 THEN 100 * d_value / volume_cc END END, 6) AS y_pct
        FROM pg JOIN tot USING (patient_id, structure)) WHERE x_gy IS NOT NULL AND y_pct IS NOT NULL"""
    ),
    "c3_evaluate_with_reuse": with_views(
        "WITH " + HIST.strip() + "," + STEP + "," + EVALUATED + """, sel AS (SELECT patient_id, structure FROM structure WHERE ordinal <> 2)
        SELECT patient_id, structure, goal_no, CASE WHEN patient_id % 3 = 0 AND structure <> 'RF' THEN 'saved' ELSE status END AS status FROM es JOIN sel USING (patient_id, structure)""",
        "dose_sample", "goal", "structure",
    ),
    "c4_custom_goals": with_views("WITH " + MERGED + " SELECT * FROM merged", "goal"),
    "j12_custom_only": with_views("WITH " + MERGED + f", k AS (SELECT patient_id, structure, {KEY} AS key, source FROM merged) SELECT patient_id, structure, key, min(CASE source WHEN 'sheet' THEN 0 ELSE 1 END) = 1 AS custom_only FROM k GROUP BY 1, 2, 3", "goal"),
    "c5_min_volume": _goal("," + MIN_VOLUME + " SELECT * FROM bnote"),
    "c7_report_rows": _goal(
        "," + MIN_VOLUME + ", " + STORED + f""", pl AS (SELECT *, row_number() OVER (PARTITION BY patient_id, structure ORDER BY goal_no) AS place, {NOTE_KEY} AS note_key FROM es),
        j AS (SELECT pl.*, st.note_text, concat_ws('    ', CASE WHEN status = 'variation' AND lim IS NOT NULL THEN 'Acceptable Variation' END, CASE WHEN place = 1 THEN b.note END) AS computed
          FROM pl LEFT JOIN stored st ON st.patient_id = pl.patient_id AND st.note_key = pl.note_key LEFT JOIN bnote b ON b.patient_id = pl.patient_id AND b.structure = pl.structure)
        SELECT patient_id, structure, place::INT AS place, CASE WHEN place = 1 THEN structure ELSE '' END AS shown_name, trim(metric) AS metric, trim(comparator || ' ' || trim(value_text)) AS goal_text, status,
          trim(metric) || ' ' || trim(comparator || ' ' || trim(value_text)) AS goal_line, {_compose('computed', 'note_text')} AS note FROM j"""
    ),
    "u4_merged_notes": with_views(
        "WITH " + STORED + f""", usr AS (SELECT patient_id, note_key, CASE WHEN patient_id % 4 = 0 THEN note_text || '    more' ELSE 'own' END AS note_text FROM stored WHERE patient_id % 2 = 0)
        SELECT patient_id, note_key, {_compose('s.note_text', 'u.note_text')} AS note_text FROM stored s FULL JOIN usr u USING (patient_id, note_key)""",
        "goal",
    ),
    "c9_recompute": with_views(
        "WITH " + HIST.strip() + """, have AS (SELECT DISTINCT patient_id, structure, 1 AS h FROM hist), per AS (SELECT patient_id, count(*) AS n, sum(coalesce(h, 0)) AS m FROM structure LEFT JOIN have USING (patient_id, structure) GROUP BY 1)
        SELECT patient_id, m < n AS recompute, (CASE WHEN m < n THEN n ELSE 0 END)::BIGINT AS n_compute FROM per""",
        "dose_sample", "structure",
    ),
}
