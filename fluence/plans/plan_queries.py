"""Queries over plan phases, structure names and texts, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import plans
from ..sources.standins import view, with_views

P = "patient_id"

NAMED = r"""named AS (SELECT *, upper(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS name_norm,
  CASE WHEN starts_with(upper(trim(regexp_replace(name, '\s+', ' ', 'g'))), 'PTV') THEN try_cast(nullif(regexp_replace(upper(name), '[^0-9]', '', 'g'), '') AS DOUBLE) / 100 END AS rx_gy FROM named_structure),
avail AS (SELECT * FROM plan_phase WHERE rx_gy > 0 AND dose_grid_id <> '')"""


def _named(spark, sf):
    return plans.named(view(spark, sf, "named_structure"))


def p1_normalised_names(spark, sf):
    return _named(spark, sf).select(P, "ordinal", "name_norm", "rx_gy", "target_like")


def p2_listable(spark, sf):
    s = _named(spark, sf)
    hidden = s.filter("ordinal % 11 = 3").select(P, "name_norm").distinct()
    return plans.listable(s, hidden).select(P, "ordinal", "name_norm")


def p3_mask_candidates(spark, sf):
    s = _named(spark, sf)
    return plans.mask_candidates(s, s.filter("name_norm like 'LUNG%'").select(P, "name_norm").distinct())


def p4_brain(spark, sf):
    return plans.brain(_named(spark, sf))


def p6_dose_levels(spark, sf):
    d = plans.dose_levels(_named(spark, sf))
    return d.select(P, F.array_join(F.transform("levels", lambda x: F.round(x * 100).cast("bigint").cast("string")), ",").alias("levels"), "lowest")


def p8_available_phases(spark, sf):
    return plans.available(view(spark, sf, "plan_phase")).select(P, "plan_uid", "rx_gy")


def _levels(spark, sf):
    """Level texts from account balances: some negative, some repeated, some no number."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select((F.col("c_custkey") % 10).alias(P), F.col("c_custkey").alias("place"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit(" "), (F.floor("c_acctbal") % 40).cast("string"), F.lit(".5 "))).alias("level_text"))


def p12_isodose_levels(spark, sf):
    return plans.isodose_levels(_levels(spark, sf))


def p13_default_isodoses(spark, sf):
    d = plans.default_isodoses(view(spark, sf, "plan_phase"), plans.dose_levels(_named(spark, sf)), 4)
    return d.select(P, F.posexplode("levels").alias("place", "level")).select(P, "place", F.round("level", 6).alias("level"))


def p14_total_rx(spark, sf):
    refs = _named(spark, sf).filter("rx_gy is not null").select(P, F.col("rx_gy").alias("reference_gy"))
    return plans.total_rx(view(spark, sf, "plan_phase"), refs)


def p15_wash_floor(spark, sf):
    return plans.wash_floor(view(spark, sf, "plan_phase"), plans.dose_levels(_named(spark, sf))).select(P, F.round("floor_gy", 6).alias("floor_gy"))


def o1_sorted_targets(spark, sf):
    return plans.sorted_targets(_named(spark, sf)).select(P, "ordinal", "name_norm", "place")


def o2_display_order(spark, sf):
    s = _named(spark, sf)
    sheet = s.filter("ordinal % 3 = 0").groupBy(P, "name_norm").agg(F.max("ordinal").alias("sheet_no"))
    return plans.display_order(s, sheet).select(P, "ordinal", "place")


def o3_nested_order(spark, sf):
    return plans.nested_order(_named(spark, sf)).select(P, "ordinal", "place")


def s7_plan_summary(spark, sf):
    return plans.plan_summary(view(spark, sf, "plan_phase")).select(P, "rx_gy", "fractions", "phases", "label", F.round("gy_per_fraction", 6).alias("gy_per_fraction"))


def s11_fractionation(spark, sf):
    f = plans.fractionation(view(spark, sf, "plan_phase"))
    doses = F.array_join(F.transform("dose_per_fraction", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",")
    return f.select(P, doses.alias("doses"), F.array_join(F.col("fraction_counts").cast("array<string>"), ",").alias("fraction_counts"))


def j2_phase_grid(spark, sf):
    """Phases with the grid of their plan; the first grid that names a plan counts; '' where there is none."""
    phases = view(spark, sf, "plan_phase")
    grids = phases.filter("dose_grid_id <> ''").select("plan_uid", "dose_grid_id").unionByName(phases.filter("rx_gy > 30").select("plan_uid", F.concat(F.lit("late-"), "plan_uid").alias("dose_grid_id")))
    first = grids.groupBy("plan_uid").agg(F.min("dose_grid_id").alias("grid"))
    return phases.join(first, "plan_uid", "left").select(P, "plan_uid", F.coalesce("grid", F.lit("")).alias("grid"))


def t1_assigned_phases(spark, sf):
    return plans.assigned_phases(plans.sorted_targets(_named(spark, sf)), view(spark, sf, "plan_phase")).select(P, "name_norm", "plan_uid", F.round("phase_rx_gy", 6).alias("phase_rx_gy"))


def _assigned(spark, sf):
    """T1 and T2 over all patients."""
    return plans.assigned_phases(plans.sorted_targets(_named(spark, sf)), view(spark, sf, "plan_phase"))


BLOCKS = """block AS (SELECT p_partkey % (SELECT count(*) FROM {supplier}) AS patient_id, p_partkey AS block_no,
  CASE p_size % 6 WHEN 0 THEN 'D/F ' || CAST(p_size % 7 AS VARCHAR(20)) || '.4' WHEN 1 THEN 'F ' || CAST(p_size % 9 * 5 AS VARCHAR(20)) WHEN 2 THEN 'NA' WHEN 3 THEN 'D/F 2' WHEN 4 THEN 'other' ELSE 'F 31' END AS label
  FROM {part} WHERE p_partkey % 4 = 1)"""


def s10_chosen_blocks(spark, sf):
    """Each patient's constraint block by its plans' doses a fraction and fraction counts."""
    body = BLOCKS.split(" AS (", 1)[1].rsplit(")", 1)[0]
    blocks = spark.sql(body, **{n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("part", "supplier")})
    return plans.chosen_block(blocks, plans.fractionation(view(spark, sf, "plan_phase")))


SETS = """sets AS (SELECT c_custkey AS no, CASE c_custkey % 5 WHEN 0 THEN ' srs   fsrt ' WHEN 1 THEN 'Prostate SBRT' WHEN 2 THEN 'SRS FSRT 5' WHEN 3 THEN NULL ELSE c_mktsegment END AS set_id FROM {customer})"""


def p11_set_flags(spark, sf):
    sets = spark.sql(SETS.split(" AS (", 1)[1].rsplit(")", 1)[0], customer=spark.read.parquet(f"{sf}/customer.parquet"))
    return plans.set_flags(sets)


def _typed(spark, sf):
    """Reference doses as typed for some targets; some are no doses."""
    n = _named(spark, sf).filter("name_norm like 'PTV%'").groupBy(P, "name_norm").agg(F.min("ordinal").alias("o"))
    text = F.when(F.col("o") % 4 == 0, F.concat(F.lit(" "), (F.col("o") % 60).cast("string"), F.lit(".25 "))).when(F.col("o") % 4 == 1, "-3").when(F.col("o") % 4 == 2, "soon")
    return n.select(P, "name_norm", text.alias("dose_text"))


def t6_reference_doses(spark, sf):
    """Typed dose, assigned phase, name; the combined dose gives values for some targets only."""
    n = _named(spark, sf).filter("name_norm like 'PTV%'").groupBy(P, "name_norm").agg(F.max("rx_gy").alias("rx_gy"))
    sampled = n.filter("patient_id % 5 <> 0").select(P, "name_norm", (F.length("name_norm") % 2 == 0).alias("covered"))
    return plans.referred(n, view(spark, sf, "plan_phase"), _assigned(spark, sf), _typed(spark, sf), sampled)


def t5_inferred_srs(spark, sf):
    low = view(spark, sf, "dose_sample").groupBy(P, F.col("structure").alias("name_norm")).agg((F.min("dose_gy") + F.count("*") % 9 + 15).alias("min_gy"))
    return plans.inferred_srs(low).select(P, "name_norm", "srs_rx_gy")


TEXTS = """texts AS (SELECT o_orderkey AS id, CASE o_orderkey % 12
  WHEN 0 THEN 'D/F ' || CAST(o_custkey % 9 AS VARCHAR(20)) || '.5' WHEN 1 THEN ' n/a ' WHEN 2 THEN 'plan F ' || CAST(o_custkey % 40 AS VARCHAR(20)) WHEN 3 THEN 'D / F2'
  WHEN 4 THEN 'V20Gy  <= ' WHEN 5 THEN 'D 95 % ≥' WHEN 6 THEN '<= ' || CAST(o_custkey AS VARCHAR(20)) || ' cc' WHEN 7 THEN '12.5 CM3 or so' WHEN 8 THEN '== 7 gy' WHEN 9 THEN '   ' WHEN 10 THEN o_orderpriority ELSE '>20.0%  ' END AS txt FROM {orders})"""


def _texts(spark, sf):
    body = TEXTS.split(" AS (", 1)[1].rsplit(")", 1)[0]
    return spark.sql(body, orders=spark.read.parquet(f"{sf}/orders.parquet"))


def x10_parsed_texts(spark, sf):
    """X1, X2, X5, X9, X10 and X11 on the same texts."""
    s = _texts(spark, sf).withColumns({"v": t.goal_value(F.col("txt")), "g": t.goal_input(F.col("txt")), "c": t.script_clause(F.col("txt")), "b": t.block_label(F.col("txt")), "s": t.script_goal(F.col("txt"))})
    return s.select("id", F.col("v.value").alias("value"), F.col("v.unit").alias("unit"), F.col("g.comparator").alias("comparator"), F.col("g.value").alias("goal"), F.col("c.metric").alias("clause_metric"), F.col("c.comparator").alias("clause_comparator"), F.col("b.kind").alias("block_kind"), F.col("b.value").alias("block_value"), F.col("s").alias("script_goal"))


def x14_membership(spark, sf):
    """Trapezoids, with and without shoulders, on discounts."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")  # noqa: E741
    x = F.col("l_tax") * 20
    return l.select("l_orderkey", "l_linenumber", F.round(t.trapezoid(x, 0.3, 0.6, 0.9, 1.4), 6).alias("middle"), F.round(t.trapezoid(x, 0.2, 0.2, 0.5, 1.1), 6).alias("low"), F.round(t.trapezoid(x, 0.5, 1.2, 1.6, 1.6), 6).alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_normalised_names, p2_listable, p3_mask_candidates, p4_brain, p6_dose_levels, p8_available_phases, p12_isodose_levels, p13_default_isodoses, p14_total_rx, p15_wash_floor, o1_sorted_targets,
        o2_display_order, o3_nested_order, s7_plan_summary, s11_fractionation, j2_phase_grid, t1_assigned_phases, t5_inferred_srs, s10_chosen_blocks, p11_set_flags, t6_reference_doses, x10_parsed_texts, x14_membership,
    )
}


# T1 and T2 in SQL: the walk over a patient's targets, one a step, with the level reached and the phases used.
ASSIGNED = """
pt AS (SELECT patient_id, name_norm, rx_gy, row_number() OVER (PARTITION BY patient_id ORDER BY rx_gy ASC NULLS LAST, name_norm, ordinal) AS place FROM named WHERE starts_with(name_norm, 'PTV')),
ph AS (SELECT patient_id, count(*) AS n, list({'plan_uid': plan_uid, 'rx': rx_gy::DOUBLE, 'target': target_norm, 'label': label} ORDER BY plan_uid) AS phases FROM avail GROUP BY 1),
one AS (SELECT pt.patient_id, name_norm, place, phases[1].plan_uid AS plan_uid, phases[1].rx AS rx, name_norm = phases[1].target AS exact, abs(rx_gy - phases[1].rx) AS gap FROM pt JOIN ph USING (patient_id) WHERE n = 1),
single AS (SELECT patient_id, coalesce(min_by(name_norm, place) FILTER (exact), min_by(name_norm, (gap, name_norm)) FILTER (gap <= 0.5)) AS name_norm, max(plan_uid) AS plan_uid, max(rx) AS phase_rx_gy FROM one GROUP BY 1),
st AS (SELECT pt.patient_id, name_norm, rx_gy::DOUBLE AS rx_gy, phases, row_number() OVER (PARTITION BY pt.patient_id ORDER BY place) AS no FROM pt JOIN ph USING (patient_id) WHERE n > 1 AND rx_gy IS NOT NULL),
walk AS (SELECT patient_id, 0::BIGINT AS no, 0.0::DOUBLE AS level, []::VARCHAR[] AS used, NULL::VARCHAR AS name_norm, NULL::VARCHAR AS plan_uid, NULL::DOUBLE AS phase_rx_gy FROM ph WHERE n > 1
  UNION ALL
  SELECT patient_id, no, CASE WHEN more > 0 AND best IS NULL THEN level ELSE rx_gy END, CASE WHEN take THEN list_append(used, best.plan_uid) ELSE used END,
    CASE WHEN take THEN name_norm END, CASE WHEN take THEN best.plan_uid END, CASE WHEN take THEN more END
  FROM (SELECT *, coalesce(more > 0 AND (best.gap <= 0.5 OR best.other = 0), false) AS take
    FROM (SELECT s.patient_id, s.no, w.level, w.used, s.rx_gy, s.name_norm, greatest(s.rx_gy - w.level, 0.0) AS more,
        list_sort(list_transform(list_filter(s.phases, lambda p: NOT list_contains(w.used, p.plan_uid)), lambda p: {'gap': abs(p.rx - greatest(s.rx_gy - w.level, 0.0)), 'other': CASE WHEN p.target = s.name_norm THEN 0 ELSE 1 END, 'label': p.label, 'plan_uid': p.plan_uid}))[1] AS best
      FROM walk w JOIN st s ON s.patient_id = w.patient_id AND s.no = w.no + 1))),
assigned AS (SELECT patient_id, name_norm, plan_uid, phase_rx_gy FROM single WHERE name_norm IS NOT NULL UNION ALL SELECT patient_id, name_norm, plan_uid, phase_rx_gy FROM walk WHERE name_norm IS NOT NULL)"""

# S11 in SQL: values in order of plans, without any close to an earlier one.
FRACTIONS = """
fv AS (SELECT patient_id, list(rx_gy::DOUBLE / fractions ORDER BY plan_uid) FILTER (rx_gy > 0 AND fractions > 0) AS d, list(fractions ORDER BY plan_uid) FILTER (fractions > 0) AS f FROM plan_phase GROUP BY 1),
fr AS (SELECT patient_id, list_reduce(list_prepend([]::DOUBLE[], list_transform(coalesce(d, []), lambda v: [v])), lambda acc, v: CASE WHEN len(list_filter(acc, lambda y: abs(y - v[1]) <= 0.01)) > 0 THEN acc ELSE list_concat(acc, v) END) AS dose_per_fraction,
  list_reduce(list_prepend([]::INT[], list_transform(coalesce(f, []), lambda v: [v])), lambda acc, v: CASE WHEN list_contains(acc, v[1]) THEN acc ELSE list_concat(acc, v) END) AS fraction_counts FROM fv)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _n(body: str) -> str:
    return with_views("WITH " + NAMED + body, "named_structure", "plan_phase")


def _trap(a, b, c, d):
    x = "(l_tax * 20)"
    low = f"{x} < {a}" if a != b else "false"
    high = f"{x} > {d}" if c != d else "false"
    rise = f"({x} - {a}) / ({b}::DOUBLE - {a})" if a != b else "1.0"
    fall = f"({d} - {x}) / ({d}::DOUBLE - {c})" if c != d else "1.0"
    return f"round(CASE WHEN {low} OR {high} THEN 0.0 WHEN {x} >= {b} AND {x} <= {c} THEN 1.0 WHEN {x} < {b} THEN {rise} ELSE {fall} END::DOUBLE, 6)"


LEVELS = "lv AS (SELECT patient_id, list(DISTINCT rx_gy ORDER BY rx_gy) AS levels, min(rx_gy) AS lowest FROM named WHERE rx_gy IS NOT NULL GROUP BY 1)"
NUM = r"[-+]?\d*\.?\d+"

ORACLE_SQL = {
    "t1_assigned_phases": recursive(_n("," + ASSIGNED + " SELECT patient_id, name_norm, plan_uid, round(phase_rx_gy, 6) AS phase_rx_gy FROM assigned")),
    "s11_fractionation": _n(
        "," + FRACTIONS + """ SELECT patient_id, coalesce(array_to_string(list_transform(dose_per_fraction, lambda v: round(v * 1000)::BIGINT::VARCHAR), ','), '') AS doses,
        coalesce(array_to_string(list_transform(fraction_counts, lambda v: v::VARCHAR), ','), '') AS fraction_counts FROM fr"""
    ),
    "p13_default_isodoses": _n(
        ", " + LEVELS + """, tt AS (SELECT patient_id, sum(rx_gy)::DOUBLE AS total FROM avail GROUP BY 1),
        al AS (SELECT patient_id, list_concat(CASE WHEN total > 0 THEN [total] ELSE []::DOUBLE[] END, list_reverse(coalesce(levels::DOUBLE[], []::DOUBLE[]))) AS l FROM tt FULL JOIN lv USING (patient_id)),
        kp AS (SELECT patient_id, list_reduce(list_prepend([]::DOUBLE[], list_transform(l, lambda v: [v])), lambda acc, v: CASE WHEN len(list_filter(acc, lambda y: abs(y - v[1]) <= 0.05)) > 0 THEN acc ELSE list_concat(acc, v) END)[1:4] AS k FROM al)
        SELECT patient_id, u.i::INT AS place, round(k[u.i + 1], 6) AS level FROM kp JOIN (SELECT unnest(range(4)) AS i) u ON u.i < len(k)"""
    ),
    "s10_chosen_blocks": with_views(
        "WITH " + BLOCKS.format(part="part", supplier="supplier") + "," + FRACTIONS + f""",
        lb AS (SELECT *, regexp_matches(upper(trim(label)), '^N/?A$') AS na, try_cast(nullif(regexp_extract(label, 'D/F ({NUM})', 1), '') AS DOUBLE) AS df, try_cast(nullif(regexp_extract(label, '^F ({NUM})', 1), '') AS DOUBLE) AS fc, count(*) OVER (PARTITION BY patient_id) AS n FROM block),
        gp AS (SELECT lb.*, list_filter(list_transform(CASE WHEN df IS NOT NULL THEN dose_per_fraction WHEN fc IS NOT NULL THEN fraction_counts::DOUBLE[] END, lambda v: abs(v - coalesce(df, fc))), lambda g: g <= 0.05)[1] AS gap FROM lb LEFT JOIN fr USING (patient_id)),
        rk AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN gap IS NOT NULL THEN 1 WHEN na THEN 2 ELSE 3 END AS rank FROM gp)
        SELECT patient_id, block_no, label FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY rank, coalesce(gap, 0), CASE WHEN rank = 2 THEN -block_no ELSE block_no END) AS rn FROM rk) WHERE rn = 1""",
        "plan_phase",
    ),
    "p11_set_flags": "WITH " + SETS.format(customer="customer") + r" SELECT no, set_id, upper(trim(regexp_replace(coalesce(set_id, ''), '\s+', ' ', 'g'))) = 'SRS FSRT' AS stereotactic, contains(upper(coalesce(set_id, '')), 'PROSTATE') AS prostate FROM sets",
    "t6_reference_doses": recursive(_n(
        "," + ASSIGNED + """, tg AS (SELECT patient_id, name_norm, max(rx_gy)::DOUBLE AS rx_gy, min(ordinal) AS o FROM named WHERE starts_with(name_norm, 'PTV') GROUP BY 1, 2),
        own AS (SELECT a.patient_id, name_norm, max(phase_rx_gy) AS rx, max(dose_grid_id) AS grid FROM assigned a JOIN plan_phase USING (patient_id, plan_uid) GROUP BY 1, 2),
        sole AS (SELECT patient_id, min(dose_grid_id) AS grid FROM avail GROUP BY 1 HAVING count(*) = 1),
        rf AS (SELECT tg.*, own.grid AS own, sole.grid AS only_grid, coalesce(CASE WHEN o % 4 = 0 THEN (o % 60) + 0.25::DOUBLE END, own.rx, tg.rx_gy, 0) AS reference_gy FROM tg LEFT JOIN own USING (patient_id, name_norm) LEFT JOIN sole USING (patient_id))
        SELECT patient_id, name_norm, reference_gy, coalesce(own, CASE WHEN reference_gy > 0 AND patient_id % 5 <> 0 AND length(name_norm) % 2 = 1 THEN only_grid END, 'combined') AS source FROM rf"""
    )),
    "p1_normalised_names": _n(" SELECT patient_id, ordinal, name_norm, rx_gy, regexp_matches(name_norm, '^(PTV|GTV|CTV)') AS target_like FROM named"),
    "p2_listable": _n(", hid AS (SELECT DISTINCT patient_id, name_norm FROM named WHERE ordinal % 11 = 3) SELECT patient_id, ordinal, name_norm FROM named n WHERE NOT regexp_matches(name_norm, '^Z|COUCH|RAIL|BB') AND NOT EXISTS (SELECT 1 FROM hid h WHERE h.patient_id = n.patient_id AND h.name_norm = n.name_norm)"),
    "p3_mask_candidates": _n(" SELECT patient_id, name_norm, min(ordinal) AS ordinal FROM named WHERE regexp_matches(name_norm, '^(PTV|GTV|CTV|LUNG)') OR starts_with(name_norm, 'BRAIN') AND NOT contains(name_norm, 'BRAINSTEM') GROUP BY 1, 2"),
    "p4_brain": _n(" SELECT patient_id, name_norm AS brain, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY (name_norm = 'BRAIN') DESC, CASE WHEN name_norm = 'BRAIN' THEN ordinal ELSE -ordinal END) AS rn FROM named WHERE starts_with(name_norm, 'BRAIN') AND NOT contains(name_norm, 'BRAINSTEM')) WHERE rn = 1"),
    "p6_dose_levels": _n(", " + LEVELS + " SELECT patient_id, array_to_string(list_transform(levels, lambda x: round(x * 100)::BIGINT::VARCHAR), ',') AS levels, lowest FROM lv"),
    "p8_available_phases": _n(" SELECT patient_id, plan_uid, rx_gy FROM avail"),
    "p12_isodose_levels": """WITH t AS (SELECT c_custkey % 10 AS patient_id, c_custkey AS place, try_cast(trim(CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey::VARCHAR ELSE ' ' || (floor(c_acctbal)::BIGINT % 40)::VARCHAR || '.5 ' END) AS DOUBLE) AS level FROM customer)
        SELECT patient_id, min_by(level, place) AS level, min(place) AS place FROM t WHERE level > 0 GROUP BY patient_id, round(level, 3)""",
    "p14_total_rx": _n(" SELECT patient_id, coalesce(s, m) AS total_rx_gy FROM (SELECT patient_id, sum(rx_gy) AS s FROM avail GROUP BY 1) FULL JOIN (SELECT patient_id, max(rx_gy) AS m FROM named WHERE rx_gy IS NOT NULL GROUP BY 1) USING (patient_id)"),
    "p15_wash_floor": _n(", " + LEVELS + " SELECT patient_id, round(0.95::DOUBLE * coalesce(lowest, rx, 0), 6) AS floor_gy FROM (SELECT patient_id, min(CASE WHEN rx_gy > 0 THEN rx_gy END)::DOUBLE AS rx FROM plan_phase GROUP BY 1) FULL JOIN lv USING (patient_id)"),
    "o1_sorted_targets": _n(" SELECT patient_id, ordinal, name_norm, row_number() OVER (PARTITION BY patient_id ORDER BY rx_gy ASC NULLS LAST, name_norm, ordinal)::INT AS place FROM named WHERE starts_with(name_norm, 'PTV')"),
    "o2_display_order": _n(", sh AS (SELECT patient_id, name_norm, max(ordinal) AS sheet_no FROM named WHERE ordinal % 3 = 0 GROUP BY 1, 2) SELECT patient_id, ordinal, row_number() OVER (PARTITION BY patient_id ORDER BY CASE WHEN starts_with(name_norm, 'PTV') THEN 0 ELSE 1 END, coalesce(sheet_no, 1000000), ordinal)::INT AS place FROM named LEFT JOIN sh USING (patient_id, name_norm)"),
    "o3_nested_order": _n(" SELECT patient_id, ordinal, row_number() OVER (PARTITION BY patient_id ORDER BY CASE left(name_norm, 3) WHEN 'PTV' THEN 0 WHEN 'GTV' THEN 1 WHEN 'CTV' THEN 2 ELSE 3 END, rx_gy ASC NULLS LAST, name_norm, ordinal)::INT AS place FROM named"),
    "s7_plan_summary": _n(" SELECT patient_id, s AS rx_gy, f AS fractions, n AS phases, label, round(CASE WHEN f > 0 THEN s / f END, 6) AS gy_per_fraction FROM (SELECT patient_id, sum(greatest(rx_gy, 0))::DOUBLE AS s, sum(greatest(fractions, 0))::BIGINT AS f, count(*) AS n, min_by(label, plan_uid) AS label FROM plan_phase GROUP BY 1)"),
    "j2_phase_grid": _n(", g AS (SELECT plan_uid, dose_grid_id FROM plan_phase WHERE dose_grid_id <> '' UNION ALL SELECT plan_uid, 'late-' || plan_uid FROM plan_phase WHERE rx_gy > 30), f AS (SELECT plan_uid, min(dose_grid_id) AS grid FROM g GROUP BY 1) SELECT patient_id, plan_uid, coalesce(grid, '') AS grid FROM plan_phase LEFT JOIN f USING (plan_uid)"),
    "t5_inferred_srs": with_views(
        "WITH m AS (SELECT patient_id, structure AS name_norm, min(dose_gy) + count(*) % 9 + 15 AS d FROM dose_sample GROUP BY 1, 2) SELECT patient_id, name_norm, (CASE WHEN abs(d - 18) <= abs(d - 21) AND abs(d - 18) <= abs(d - 24) THEN 18 WHEN abs(d - 21) <= abs(d - 24) THEN 21 ELSE 24 END)::DOUBLE AS srs_rx_gy FROM m",
        "dose_sample",
    ),
    "x10_parsed_texts": "WITH " + TEXTS.format(orders="orders") + rf""", q AS (SELECT id, trim(txt) AS v, txt, trim(regexp_replace(replace(replace(txt, '≤', '<='), '≥', '>='), '\s+', ' ', 'g')) AS c FROM texts),
        m AS (SELECT *, regexp_extract(v, '^\s*([<>]=?|=)?\s*({NUM})\s*([A-Za-z%]+)?\s*$', ['c', 'n', 'u']) AS g, regexp_extract(txt, '^\s*(<=|>=|<|>|==|=)\s*(.+?)\s*$', ['c', 'v']) AS i, regexp_extract(c, '^(.*?)(<=|>=|==|=|<|>)\s*$', ['m', 'c']) AS k,
          try_cast(nullif(regexp_extract(v, '(?i)\bD\s*/\s*F\b\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS df, try_cast(nullif(regexp_extract(v, '(?i)\bF\b\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS fc,
          upper(v) IN ('NA', 'N/A') AS na, try_cast(nullif(regexp_extract(c, '(?i)({NUM})\s*(%|CC|CM3|GY)', 1), '') AS DOUBLE) AS sn, upper(regexp_extract(c, '(?i)({NUM})\s*(%|CC|CM3|GY)', 2)) AS su, try_cast(nullif(regexp_extract(c, '({NUM})', 1), '') AS DOUBLE) AS bn FROM q),
        z AS (SELECT *, CASE WHEN sn = round(sn) THEN sn::BIGINT::VARCHAR ELSE sn::VARCHAR END AS st, CASE WHEN bn = round(bn) THEN bn::BIGINT::VARCHAR ELSE bn::VARCHAR END AS bt FROM m)
        SELECT id, CASE WHEN g.n <> '' THEN try_cast(g.n AS DOUBLE) END AS value, CASE WHEN g.n <> '' THEN upper(g.u) ELSE v END AS unit, nullif(i.c, '') AS comparator, CASE WHEN i.c <> '' THEN i.v END AS goal,
          CASE WHEN k.c <> '' AND replace(k.m, ' ', '') <> '' THEN replace(k.m, ' ', '') END AS clause_metric, CASE WHEN k.c <> '' AND replace(k.m, ' ', '') <> '' THEN k.c END AS clause_comparator,
          CASE WHEN na THEN 'na' WHEN df IS NOT NULL THEN 'dose_per_fraction' WHEN fc IS NOT NULL THEN 'fraction_count' ELSE '' END AS block_kind, CASE WHEN NOT na THEN coalesce(df, fc) END AS block_value,
          CASE WHEN su = '%' THEN st || '%' WHEN su IN ('CC', 'CM3') THEN st || ' cc' WHEN su = 'GY' THEN st || ' Gy' WHEN bn IS NOT NULL THEN bt ELSE c END AS script_goal FROM z""",
    "x14_membership": f"SELECT l_orderkey, l_linenumber, {_trap(0.3, 0.6, 0.9, 1.4)} AS middle, {_trap(0.2, 0.2, 0.5, 1.1)} AS low, {_trap(0.5, 1.2, 1.6, 1.6)} AS high FROM lineitem",
}
