"""Decision tables and closed-form cases of the dose operators."""

import math
import random

import pytest
from fluence.functions import text as t
from fluence.operators import dvh, extras, goals, plans, raster, sampling, targets, voxels
from fluence.sources import sheets
from pyspark.sql import functions as F


def column(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_goal_values(spark):
    got = column(spark, [("30%",), ("<= 12.5 cc",), ("20gy",), ("12.5 cm3",), ("",), ("n/a",), (".5",), ("-3",)], "v string", t.goal_value(F.col("v")))
    assert [tuple(x[0]) for x in got] == [(30.0, "%"), (12.5, "CC"), (20.0, "GY"), (None, "12.5 cm3"), (None, ""), (None, "n/a"), (0.5, ""), (-3.0, "")]
    got = column(spark, [("30-35%",), ("1 - 2 Gy",), ("30",)], "v string", t.goal_range(F.col("v")))
    assert [tuple(x[0]) for x in got] == [(30.0, 35.0, "%"), (1.0, 2.0, "GY"), (None, None, "")]


CASES = [
    (29.0, 30.0, None, "<", "pass"), (30.0, 30.0, None, "<", "fail"), (30.0, 30.0, None, "<=", "pass"), (32.0, 30.0, 35.0, "<=", "variation"), (35.0, 30.0, 35.0, "<=", "variation"), (36.0, 30.0, 35.0, "<=", "fail"),
    (31.0, 30.0, None, ">", "pass"), (30.0, 30.0, None, ">", "fail"), (30.0, 30.0, None, ">=", "pass"), (28.0, 30.0, 25.0, ">=", "variation"), (24.0, 30.0, 25.0, ">=", "fail"), (30.0, 30.0, None, "=", "pass"),
    (30.0001, 30.0, None, "==", "pass"), (31.0, 30.0, None, "=", "fail"), (30.0, 30.0, None, "~", ""), (None, 30.0, None, "<", ""), (30.0, None, None, "<", ""),
]


def test_verdicts(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, a double, g double, l double, c string, want string")
    bad = df.withColumn("got", goals.verdict(F.col("a"), F.col("g"), F.col("l"), F.col("c"))).filter("got <> want").collect()
    assert not bad


def test_texts(spark):
    assert [x[0] for x in column(spark, [(0.5, "%"), (12.345, "cc"), (3.0, "GY"), (None, "GY"), (math.nan, "%"), (1.5, "kg")], "v double, u string", t.metric_text(F.col("v"), F.col("u")))] == ["0.5%", "12.35 cc", "3.00 Gy", "n/a", "n/a", "1.50 kg"]
    assert [x[0] for x in column(spark, [("a", "a    b"), ("a", "b"), ("", "b"), ("a", None), ("a", "ab")], "c string, s string", t.compose_notes(F.col("c"), F.col("s")))] == ["a    b", "a    b", "b", "a", "a    ab"]
    assert [x[0] for x in column(spark, [("Doe^Jane^Q^Dr^Jr",), ("Doe^Jane",), ("Doe",), (None,), ("^Jane",)], "n string", sheets.person_name(F.col("n")))] == ["Dr Jane Q Doe Jr", "Jane Doe", "Doe", "", "Jane"]
    assert [x[0] for x in column(spark, [("PTV_7000",), (" ptv 54",), ("GTV 12",), ("PTV",)], "n string", t.ptv_rx(F.col("n")))] == [70.0, 0.54, None, None]
    assert [list(x[0]) for x in column(spark, [("Lung_L/R, Heart",), (" ",), ("a,,b",)], "n string", sheets.structure_names(F.col("n")))] == [["Lung_L", "Lung_R", "Heart"], [], ["a", "b"]]


def dose(spark, rows):
    return spark.createDataFrame(rows, "patient_id long, structure string, dose_gy double, weight_cc double")


def test_uniform_dose(spark):
    h = dvh.histogram(dose(spark, [(1, "A", 50.0, 1.0)] * 4 + [(1, "A", 70.0, -1.0)]), 0.5)
    s, of = dvh.summary(h), dvh.curves(h)
    r = s.first()
    assert of.select(s.columns).first() == r
    assert (r.volume_cc, r.mean_gy, r.min_gy, r.max_gy, r.n_samples) == (4.0, 50.0, 50.0, 50.0, 4)
    asked = s.select("patient_id", "structure").withColumn("volume", F.explode(F.array(F.lit(0.0), F.lit(50.0), F.lit(100.0))))
    got = {r.volume: r.dose_gy for r in dvh.dose_at_volume(of, asked, width=0.5).collect()}
    assert got[0.0] == got[100.0] == 50.0 and 50.0 <= got[50.0] <= 50.5


def test_last_edge_and_monotone_curve(spark):
    h = dvh.histogram(dose(spark, [(1, "A", 60.0, 2.0), (1, "A", 0.0, 1.0), (1, "A", -3.0, 1.0)]), 0.5)
    assert {(r.bin, r.hist_cc) for r in h.collect()} == {(119, 2.0), (0, 2.0)}
    pct = [r.volume_pct for r in dvh.curve(dvh.curves(h), 0.5).orderBy("bin").collect()]
    assert pct[0] == 100 and pct[-1] == 0 and all(a >= b for a, b in zip(pct, pct[1:], strict=False)) and len(pct) == 121


def square(k, no, lo, hi):
    return [(1, 1, k, no, i, float(r), float(c)) for i, (r, c) in enumerate([(lo, lo), (lo, hi), (hi, hi), (hi, lo)])]


def contours(spark, rows):
    return spark.createDataFrame(rows, "patient_id long, structure_id long, k long, contour_no int, i int, r double, c double")


def test_squares_and_holes(spark):
    points = contours(spark, square(0, 0, 2, 6) + square(1, 0, 1, 9) + square(1, 1, 3, 6) + [(1, 1, 2, 0, i, 1.0, float(i)) for i in range(2)])
    spans = raster.mask_spans(points, 12, 12)
    assert {r.k: r.cells for r in raster.perimeter(spans).collect()} == {0: 16, 1: 64 - 9}
    assert {r.k: (r.across, r.along) for r in raster.perimeter(spans).collect()}[0] == (8, 8)
    solid = extras.filled(raster.cells(spans), 12, 12)
    assert {r.k: r["count"] for r in solid.groupBy("k").count().collect()} == {0: 16, 1: 64}


def test_summed_grids_of_other_shapes_are_an_error(spark):
    rows = [("a", 1, 0, 0, 0, 1.0), ("a", 1, 0, 0, 1, 1.0), ("b", 1, 0, 0, 0, 2.0)]
    with pytest.raises(Exception, match="different shapes"):
        voxels.summed(spark.createDataFrame(rows, "grid_id string, patient_id long, k long, r long, c long, dose_gy double")).collect()


def test_oversampling_limits(spark):
    m = spark.createDataFrame([(1, 3.0, 0.1), (2, 100.0, 0.1), (3, 20.0, 0.1), (4, 20.0, 2.0)], "i int, rss double, complexity double")
    got = {r.i: r.factor for r in sampling.oversampling(m).collect()}
    assert got == {1: 4.0, 2: 0.5, 3: 1.0, 4: 2.0}


def test_occupancy_adds_up_to_area(spark):
    points = contours(spark, [(1, 1, 0, 0, i, r, c) for i, (r, c) in enumerate([(2.0, 2.0), (2.0, 9.0), (8.0, 5.0)])])
    got = sampling.occupancy(points, 4, 12, 12, 6).agg(F.sum("share")).first()[0] / 16
    assert got == pytest.approx(21.0, abs=0.8)


def test_target_rows(spark):
    rows = [(1, "A", 50.0, 45.0, 55.0, 97.25), (1, "B", 50.0, None, None, None), (1, "C", 0.0, 1.0, 2.0, None)]
    got = {r.structure: tuple(r)[2:] for r in targets.table_rows(spark.createDataFrame(rows, "patient_id long, structure string, reference_gy double, min_gy double, max_gy double, coverage_pct double")).collect()}
    assert got["A"][0] == "50.00" and got["A"][2:] == ("90.0%", "110.0%") and got["A"][1].endswith("@ 50.00 Gy") and got["B"] == ("50.00", "@ 50.00 Gy", "", "") and got["C"] == ("", "", "", "")


def test_empty_tables(spark):
    empty = dose(spark, [])
    assert dvh.curve(dvh.curves(dvh.histogram(empty))).collect() == [] and dvh.hottest_volume(empty, 1.0).collect() == []
    assert raster.mask_spans(contours(spark, []), 4, 4).collect() == []


def plain_assignment(targets, phases):
    """T1 and T2 by plain loops: targets (name, dose) in order, phases (plan, dose, target, label)."""
    if len(phases) == 1:
        plan, rx, made_for, _ = phases[0]
        named = [n for n, _ in targets if n == made_for]
        near = sorted((abs(d - rx), n) for n, d in targets if d is not None)
        name = named[0] if named else near[0][1] if near and near[0][0] <= 0.5 else None
        return {(name, plan, rx)} if name else set()
    level, left, out = 0.0, list(phases), set()
    for name, dose in targets:
        if dose is None:
            continue
        more = max(dose - level, 0.0)
        if more > 0:
            if not left:
                break
            gap, other, _, plan = min((abs(rx - more), made_for != name, label, plan) for plan, rx, made_for, label in left)
            if gap <= 0.5 or not other:
                out.add((name, plan, more))
                left = [p for p in left if p[0] != plan]
        level = dose
    return out


def test_assignment_against_plain_loops(spark):
    rng = random.Random(6)
    names, phases, want = [], [], set()
    for patient in range(150):
        doses = sorted(rng.sample([20.0, 30.0, 40.0, 45.0, 50.0, 50.3, 60.0, 70.0], rng.randrange(5)))
        ptv = [(f"PTV{d:.1f}", d) for d in doses] + ([("PTVX", None)] if rng.random() < 0.3 else [])
        steps = [b - a for a, b in zip([0.0, *doses], doses)] or [50.0]
        mine = []
        for i in range(rng.randrange(4)):
            made_for = rng.choice([n for n, _ in ptv] + ["PTV99"])
            mine.append((f"p{patient}-{i}", rng.choice(steps) + rng.choice([0.0, 0.0, 0.4, -0.5, 3.0]), made_for, rng.choice("ab")))
        mine = [m for m in mine if m[1] > 0]
        names += [(patient, i, n, d) for i, (n, d) in enumerate(ptv, 1)]
        phases += [(patient, *m, "grid", 5) for m in mine] + [(patient, f"q{patient}", 50.0, "PTV1", "z", "", 5)]
        if mine and ptv:
            want |= {(patient, *x) for x in plain_assignment(ptv, mine)}
    t = spark.createDataFrame(names, "patient_id long, place int, name_norm string, rx_gy double")
    p = spark.createDataFrame(phases, "patient_id long, plan_uid string, rx_gy double, target_norm string, label string, dose_grid_id string, fractions int")
    got = {(r.patient_id, r.name_norm, r.plan_uid, r.phase_rx_gy) for r in plans.assigned_phases(t, p).collect()}
    assert {(*x[:3], round(x[3], 9)) for x in got} == {(*x[:3], round(x[3], 9)) for x in want} and len(want) > 100
