"""Structures on grids finer than the dose's: what their tasks make is held against the steps in Spark; samples are not shuffled."""

import os
import re

import numpy as np
import pytest
from fluence import registry
from fluence.operators import dvh, fills, fine, raster, sampling, small, voxels
from fluence.shipping import shared_dir
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
POINTS = "patient_id long, structure_id long, k long, contour_no int, i int, r double, c double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shapes(rng, planes, contours):
    """Stars with holes, beyond the grid on every side, with level edges and vertices on centre lines."""
    out = []
    for k in range(planes):
        for no in range(contours):
            n, at = int(rng.integers(2, 14)), rng.uniform(-1, 11, 2)
            a = np.sort(rng.uniform(0, 2 * np.pi, n))
            rc = at + np.stack([np.sin(a), np.cos(a)], 1) * rng.uniform(0.5, 7, (n, 1))
            rc = np.round(rc * 4) / 4 if k % 2 else rc
            out += [(k, no, i, float(r), float(c)) for i, (r, c) in enumerate(rc)]
    return out


@pytest.mark.parametrize(("scale", "sub", "held"), [(2.0, 3, 1 << 18), (0.5, 6, 1), (8.0, 10, 5000)])
def test_shares_are_those_of_occupancy(spark, monkeypatch, scale, sub, held):
    monkeypatch.setattr(fine, "CELLS", held)
    vertex = shapes(np.random.default_rng(5), 6, 3)
    points = spark.createDataFrame([(1, 1, *v) for v in vertex], POINTS)
    want = {(x.k, x.r, x.c): x.share for x in sampling.occupancy(points, scale, 10, 9, sub).collect()}
    k, no, _, r, c = (np.array(v) for v in zip(*vertex, strict=True))
    r, c, high, wide = r * scale, c * scale, int(10 * scale), int(9 * scale)
    got = {}
    for p, rr, cc, share in fine.by_plane(fine.shares(k, no, r, c, fine.box_of(r, c, high, wide), high, sub)):
        assert not got.keys() & {(p, *x) for x in zip(rr, cc, strict=True)}
        got |= dict(zip(((p, *x) for x in zip(rr.tolist(), cc.tolist(), strict=True)), share.tolist(), strict=True))
    assert want and got == want


def test_doses_are_those_between_planes(spark):
    """Heights on, between and beyond uneven planes, cells without a dose or with two, a plane without any, and a single plane."""
    rng = np.random.default_rng(2)
    cells = [(1, k, int(r), int(c), float(d)) for k in (0, 2, 3) for r, c, d in zip(rng.integers(0, 6, 20), rng.integers(0, 5, 20), rng.uniform(0, 9, 20), strict=True)]
    dose = spark.createDataFrame(cells, "patient_id long, k long, r long, c long, dose_gy double")
    for zs in ({0: -1.0, 1: 0.5, 2: 4.0, 3: 4.5}, {2: 1.0}):
        planes = spark.createDataFrame([(1, k, z) for k, z in zs.items()], "patient_id long, k long, z double")
        near = fine.dose_planes(spark.createDataFrame([(1, 7, -9.0, 9.0)], "patient_id long, structure_id long, low double, high double"), dose, planes, 6, 5)
        doses = fine.Doses(near.toArrow(), 2.0, (0, 12, 0, 10), 6, 5)
        r, c = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(10), indexing="ij"))
        heights = [-2.0, -1.0, -0.3, 0.5, 1.0, 4.0, 4.2, 4.5, 5.0]
        got = {(z, i): d for z in heights for i, d in enumerate(doses.at(z, r, c))}
        asked = spark.createDataFrame([(1, i, z, (float(a) + 0.5) / 2, (float(b) + 0.5) / 2) for z in heights for i, (a, b) in enumerate(zip(r, c, strict=True))], "patient_id long, id long, z double, y double, x double")
        want = {(x.z, x.id): x.dose_gy for x in voxels.between_planes(asked, dose, planes, 6, 5).collect()}
        assert any(want.values()) and got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_planes_far_from_a_structure_are_not_dealt(spark):
    planes = spark.createDataFrame([(1, k, 2.0 * k) for k in range(6)], "patient_id long, k long, z double")
    dose = spark.createDataFrame([(1, k, 0, 0, 1.0) for k in range(6)], "patient_id long, k long, r long, c long, dose_gy double")
    ranges = spark.createDataFrame([(1, 1, 3.0, 5.0), (1, 2, 20.0, 30.0)], "patient_id long, structure_id long, low double, high double")
    got = {(x.structure_id, x.z): x.cells is not None for x in fine.dose_planes(ranges, dose, planes, 4, 4).collect()}
    assert len(got) == 12 and {k for k, held in got.items() if held} == {(1, 2.0), (1, 4.0), (1, 6.0), (2, 10.0)}


def test_curves_are_those_of_histograms(spark, monkeypatch):
    """Doses on bin edges, beyond the axis and below 0, samples without weight; summed a few at a time."""
    rng = np.random.default_rng(3)
    dose, weight = np.r_[rng.integers(-2, 40, 200) * 0.05, 0.1, 9.0], np.r_[rng.uniform(0.1, 2, 200), 0.0, 1.5]
    top = spark.createDataFrame([(1, 1.7)], "patient_id long, max_dose double")
    rows = spark.createDataFrame([(1, 4, float(d), float(w)) for d, w in zip(dose, weight, strict=True)], "patient_id long, structure long, dose_gy double, weight_cc double")
    want = dvh.curves(dvh.histogram(rows, 0.05, top)).collect()[0].asDict(recursive=True)
    monkeypatch.setattr(fine, "CELLS", 30)
    parts = zip(np.array_split(dose, 20), np.array_split(weight, 20), strict=True)
    got = fine._curve([1, 4], parts, 1.7, 0.05).to_pylist()[0]
    assert list(got) == list(want) and [x["bin"] for x in got["steps"]] == [x["bin"] for x in want["steps"]]
    assert [x["cc"] for x in got.pop("steps")] == pytest.approx([x["cc"] for x in want.pop("steps")]) and got == pytest.approx(want)
    assert fine._curve([1, 4], [(dose[200:201], weight[200:201])], 1.7, 0.05).num_rows == 0


def test_samples_stay_in_the_task_of_their_structure(spark):
    """Every sample was a row that was joined to its planes and shuffled: 6 copies of sf0.1 took minutes, 60 did not end."""
    for name in ("d2_sampled_totals", "d3_high_accuracy", "d5_small_curves", "d6_curves_by_strategy"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "FlatMapCoGroupsInArrow" in text and not re.search(r"Exchange hashpartitioning\([^)]*\b(structure|bin)#\d+L?, \d+\), REPARTITION|weight_cc#", text), name
    assert "Exchange" not in plan(registry.QUERIES["d3_high_accuracy"](spark, SF)).split("FlatMapCoGroupsInArrow")[0]


def test_models_write_nothing(spark):
    """Points, rings and their joins were written uncompressed, which filled the disk as patients grew."""
    held = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    before = held()
    assert registry.QUERIES["g18_small_models"](spark, SF).count() and held() == before


def test_an_outline_is_measured_by_rows(spark):
    """Every cell was shuffled twice; touching spans have no edge between them."""
    spans = spark.createDataFrame([(1, 1, 0, r, a, b) for r, a, b in ((1, 0, 3), (1, 3, 5), (1, 7, 9), (2, 1, 8), (4, 2, 3))], "patient_id long, structure_id long, k long, r long, c_lo long, c_hi long")
    cell = {(1, c) for c in (0, 1, 2, 3, 4, 7, 8)} | {(2, c) for c in range(1, 8)} | {(4, 2)}
    open_ = lambda steps: sum((r + a, c + b) not in cell for r, c in cell for a, b in steps)
    assert [tuple(x) for x in raster.perimeter(spans).select("cells", "across", "along").collect()] == [(15, open_(((0, 1), (0, -1))), open_(((1, 0), (-1, 0))))]
    assert not re.search(r"hashpartitioning\([^)]*\bc#", plan(raster.perimeter(spans)))


def test_equal_metrics_are_decided_once_in_many_tasks(spark):
    m = spark.createDataFrame([(1, 8.0, 0.3), (2, 8.0, 0.3), (3, None, 0.3), (4, None, 0.3), (5, 30.0, 0.1)], "i int, rss double, complexity double")
    got = sampling.oversampling(m)
    assert got.columns == ["i", "rss", "complexity", "power", "factor"] and re.search(r"hashpartitioning\(rss#\d+, complexity#\d+, 4\), REPARTITION_BY_NUM", plan(got))
    rows = {x.i: (x.power, x.factor) for x in got.collect()}
    assert len(rows) == 5 and rows[1] == rows[2] and rows[3] == rows[4]


def test_a_curve_lists_its_edges_without_searching_its_steps(spark):
    h = spark.createDataFrame([(1, "A", 0.7, 1.0), (1, "A", 2.2, 2.0), (1, "A", 0.1, 4.0)], "patient_id long, structure string, dose_gy double, weight_cc double")
    c = dvh.curve(dvh.curves(dvh.histogram(h, 0.5)), 0.5)
    assert "element_at" not in c._jdf.queryExecution().optimizedPlan().toString()
    assert [(x.bin, x.volume_cc) for x in c.orderBy("bin").collect()] == [(0, 7.0), (1, 3.0), (2, 2.0), (3, 2.0), (4, 2.0), (5, 0.0)]


def test_turns_are_compared_in_any_number_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    ring, before = rng.uniform(0, 9, (2, 70, 2))
    want = small.turned(ring, before)
    r, c = ring.T
    one = ring[::-1] if np.sum(c * np.roll(r, -1) - np.roll(c, -1) * r) < 0 else ring
    best = min((np.roll(one, k, axis=0) for k in range(70)), key=lambda x: float(np.sum((before - x) ** 2)))
    assert (want == best).all()
    monkeypatch.setattr(small, "TURNS", 1)
    assert (small.turned(ring, before) == best).all()


def test_an_isodose_near_a_structure_is_made_in_one_task(spark):
    """Every cell of every block was written, and shuffled for its gradient along each axis; spans beyond the grid count nowhere."""
    text = plan(registry.QUERIES["g21_margin_isodose"](spark, SF))
    assert "FlatMapCoGroupsInArrow" in text and not re.search(r"hashpartitioning\([^)]*\b(r|c)#", text)
    spans = spark.createDataFrame([(1, 1, 1, 1, 1, 3), (1, 1, 1, -4, 1, 3), (1, 2, 9, 9, 0, 1)], "patient_id long, structure_id long, k long, r long, c_lo long, c_hi long")
    dose = spark.createDataFrame([(1, k, r, c, 9.0) for k in range(3) for r in range(4) for c in range(4) if (k, r, c) != (1, 1, 1)], "patient_id long, k long, r long, c long, dose_gy double")
    targets = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 5.0)], "patient_id long, structure_id long, threshold_gy double")
    got = {(x.patient_id, x.structure_id): (x.volume_cc, x.share_cc) for x in fills.margin_isodose(targets, spans, dose, 0.5, 1.0, 1.0, 1.0, 3, 4, 4).collect()}
    assert got[1, 2] == got[2, 1] == (0.0, 0.0) and got[1, 1] == pytest.approx((0.002, 0.002))
