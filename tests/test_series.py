"""Series and grids by orientation, and nested targets with manual ones, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluence.operators import series, targets

SLICES = "series long, file_no long, origin array<double>, across array<double>, down array<double>, thickness_mm double, slope double, intercept double, values array<double>, extra string"


def test_oblique_series_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in range(6):
        a = rng.normal(size=3)
        d = np.cross(a, rng.normal(size=3))
        n = np.cross(a / np.linalg.norm(a), d / np.linalg.norm(d))
        files = [(i, rng.normal(size=3) * 40, rng.random(2)) for i in range(1 if s == 5 else 7)]
        at = sorted((float(o @ n), i, v) for i, o, v in files)
        step = abs(float(np.median(np.diff([p for p, *_ in at])))) if len(at) > 1 else 4.5
        want[s] = [(k, i, p, step, (v * 2 - 3).tolist()) for k, (p, i, v) in enumerate(at)]
        # only the first file's orientation counts
        rows += [(s, i, o.tolist(), (a * 3 if i == 0 else -a).tolist(), d.tolist(), 4.5, 2.0, -3.0, v.tolist(), "x") for i, o, v in files]
    got = {}
    for r in series.series_from_orientation(spark.createDataFrame(rows, SLICES), ["series"]).orderBy("series", "k").collect():
        got.setdefault(r.series, []).append((r.k, r.file_no, pytest.approx(r.position, abs=1e-9), pytest.approx(r.spacing_mm, abs=1e-9), pytest.approx(list(r["values"]))))
    assert got == want


def test_series_with_nulls_ties_and_no_rows(spark):
    i, j = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, 2, [0.0, 0.0, 5.0], i, j, None, None, None, [1.0], ""), (1, 1, [9.0, 9.0, 5.0], i, j, None, None, None, None, ""), (1, 3, None, i, j, None, 2.0, 0.0, [1.0], ""), (2, 1, [0.0, 0.0, 0.0], None, j, 1.0, 1.0, 0.0, [1.0], ""), (3, 1, [0.0, 0.0, 7.0], i, j, None, 2.0, None, [4.0], "")]
    df = spark.createDataFrame(rows, SLICES)
    got = [tuple(r) for r in series.series_from_orientation(df, ["series"]).orderBy("series", "k").collect()]
    assert got == [(1, 0, 1, 5.0, 0.0, None), (1, 1, 2, 5.0, 0.0, [1.0]), (3, 0, 1, 7.0, 1.0, [8.0])]
    assert series.series_from_orientation(df.limit(0), ["series"]).collect() == []
    with pytest.raises(Exception, match="length zero"):
        series.series_from_orientation(df.filter("series = 3").withColumn("down", F.array(*[F.lit(0.0)] * 3)), ["series"]).collect()


def test_grids_from_frames(spark):
    kind = "grid long, origin array<double>, across array<double>, down array<double>, offsets array<double>, scaling double, frames array<array<double>>"
    o, a, d = [1.0, 2.0, 3.0], [3.0, 4.0, 0.0], [0.0, 0.0, -1.0]
    rows = [(1, o, a, d, [0.0, -2.0, -5.0, -6.0], 0.5, [[1.0], [2.0], [3.0], [None]]), (2, o, a, d, None, None, [[4.0, 5.0], [6.0, 7.0]]), (3, o, a, d, [7.0], 2.0, [[1.0]]), (4, o, a, d, None, 1.0, []), (5, o, a, d, None, 1.0, None)]
    df = spark.createDataFrame(rows, kind)
    got = {(r.grid, r.k): r for r in series.grid_from_frames(df, ["grid"]).collect()}
    n = np.array([-0.8, 0.6, 0.0])
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (3, 0)]
    for (g, k), r in got.items():
        off = {1: [0, -2, -5, -6], 2: [0, 1], 3: [7]}[g][k]
        assert np.allclose(r.origin, np.array(o) + off * n) and r.position == pytest.approx(float(np.array(o) @ n) + off)
        assert r.spacing_mm == pytest.approx({1: 2.0, 2: 1.0, 3: 1.0}[g])
    assert got[1, 1].dose_gy == [1.0] and got[1, 3].dose_gy == [None] and got[2, 1].dose_gy == [6.0, 7.0] and got[3, 0].dose_gy == [2.0]
    with pytest.raises(Exception, match="other numbers of offsets"):
        series.grid_from_frames(spark.createDataFrame([(1, o, a, d, [0.0], 1.0, [[1.0], [2.0]])], kind), ["grid"]).collect()


def test_nested_rows_with_manual_ones(spark):
    """A manual part stands under its smallest target only, ties by name; others under every target; order by kind, dose, name."""
    kind = "patient_id long, structure_id long, name_norm string, rx_gy double, listable boolean, nested boolean, manual boolean"
    s = spark.createDataFrame([(1, 1, "PTV A", 50.0, True, True, False), (1, 2, "PTV B", 60.0, True, True, None), (1, 3, "CTV", None, True, True, False), (1, 4, "NODE", None, True, False, True), (1, 5, "GTV", None, True, True, True),
        (1, 6, "ZGTV", None, False, True, False), (1, 7, "LUNG", None, True, False, False), (1, 8, "PTV A", 50.0, True, True, False), (2, 4, "NODE", None, None, None, True)], kind)
    t = spark.createDataFrame([(1, 1), (1, 2), (1, 1)], "patient_id long, structure_id long")
    pairs = [(1, p, w) for p in (3, 4, 5, 6, 7, 8) for w in (1, 2)] + [(1, 2, 1)]
    held = spark.createDataFrame(pairs, "patient_id long, part long, whole long")
    sizes = lambda a, b: spark.createDataFrame([(1, 1, a), (1, 2, b)], "patient_id long, structure_id long, voxels long")
    rows = lambda z: sorted((r.target, r.place, r.part) for r in targets.nested_rows(s, t, held, z).collect())
    assert rows(sizes(90, 40)) == [(1, 1, 2), (1, 2, 3), (2, 1, 8), (2, 2, 5), (2, 3, 3), (2, 4, 4)]
    assert rows(sizes(40, 40)) == [(1, 1, 2), (1, 2, 5), (1, 3, 3), (1, 4, 4), (2, 1, 8), (2, 2, 3)]
    assert targets.nested_rows(s, t.limit(0), held, sizes(1, 1)).collect() == []


def test_presentation_rows_with_nulls_and_repeats(spark):
    kind = "patient_id long, structure_id long, name string, parent string, reference_text string, coverage_text string, minimum_text string, maximum_text string, notes_text string, stored_text string"
    rows = spark.createDataFrame([(1, 1, "ptv  a", None, "20.00", " 95.0% ", None, "", "hot", "clash"), (1, 2, "GTV", "PTV A", None, None, None, None, None, None), (1, 1, "ptv  a", None, "20.00", " 95.0% ", None, "", "hot", "clash")], kind)
    notes = spark.createDataFrame([(1, "TARGET||PTV A", "hot    mine"), (1, "TARGET||PTV A", "zz"), (1, "TARGET||PTV A||GTV", "seen"), (2, "TARGET||GTV", None)], "patient_id long, note_key string, note_text string")
    out = targets.presentation_rows(rows, notes)
    got = sorted((r.note_key, r.note_title, r.note_text, r.is_primary, r.coverage_text, r.minimum_text) for r in out.collect())
    primary = ("TARGET||PTV A", "ptv  a target review", "hot    mine", True, "95.0%", "")
    assert got == [primary, primary, ("TARGET||PTV A||GTV", "GTV within PTV A target review", "seen", False, "", "")]
    assert targets.presentation_rows(rows.limit(0), notes).collect() == []
