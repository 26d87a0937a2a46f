"""Steps whose tables grow: what they cost is read off their plans, results are held against plain loops."""

import itertools
import re
from pathlib import Path

import numpy as np
from fluence import registry
from fluence.operators import dvh, frames, raster, sampling, surfaces, voxels
from fluence.plans import geometry_queries as gq
from fluence.shipping import kept, stored_bytes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_rows_are_as_large_as_they_are(spark):
    """Rows that encode to almost nothing were taken for a small table, which is broadcast."""
    same = kept(spark.range(2_000_000).select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")))
    assert int(same._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 30_000_000
    other = spark.range(20_000_000).select(F.col("id").alias("a"))
    assert "Broadcast" not in plan(same.join(other, "a"))


def test_no_cell_or_point_of_occupancy_is_shuffled(spark):
    points = spark.createDataFrame([(1, 1, 0, 0, i, float(r), float(c)) for i, (r, c) in enumerate([(1.25, 1.5), (1.25, 6.5), (4.0, 5.0), (6.5, 6.25), (6.0, 1.0)])], "patient_id long, structure_id long, k long, contour_no int, i int, r double, c double")
    occ = sampling.occupancy(points, 2, 8, 8, 3)
    assert not [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan(occ)) if re.search(r"\bc#", x)]
    fine = points.withColumn("r", F.col("r") * 2).withColumn("c", F.col("c") * 2)
    cell = raster.interior(raster.mask_spans(fine, 16, 16)).filter("not interior")
    at = F.array(*(F.lit((i + 0.5) / 3) for i in range(3)))
    asked = cell.withColumn("dy", F.explode(at)).withColumn("dx", F.explode(at)).select(*raster.SLICE, F.struct("r", "c", "dy", "dx").alias("id"), (F.col("r") + F.col("dy")).alias("y"), (F.col("c") + F.col("dx")).alias("x"), "r", "c")
    want = {(r.r, r.c): r.share for r in raster.inside(fine, asked).groupBy("r", "c").agg(F.avg(F.col("inside").cast("double")).alias("share")).collect()}
    got = {(r.r, r.c): r.share for r in occ.collect()}
    assert want and {k: got[k] for k in want} == want and set(got.values()) - {1.0}


def test_each_sample_has_its_own_dose(spark):
    """Samples of one id were added up; cells without a dose count as 0, doses of one cell are added."""
    grid = spark.createDataFrame([(1, 0, 0, 0, 4.0), (1, 0, 0, 1, 8.0), (1, 0, 1, 1, 2.0), (1, 1, 0, 0, 1.0), (1, 1, 0, 0, 1.0)], "patient_id long, k long, r long, c long, dose_gy double")
    asked = spark.createDataFrame([(1, 7, 0, 0.0, 0.5), (1, 7, 0, 0.5, 0.5), (1, 8, 5, 0.0, 0.0), (1, 9, 0, -0.1, 0.0)], "patient_id long, id long, k long, y double, x double")
    assert sorted((r.id, r.y, r.dose_gy) for r in voxels.bilinear(asked, grid, 2, 2).collect()) == [(7, 0.0, 6.0), (7, 0.5, 3.5), (8, 0.0, 0.0), (9, -0.1, 0.0)]
    planes = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0)], "patient_id long, k long, z double")
    where = spark.createDataFrame([(1, 7, 0.5, 0.0, 0.0), (1, 7, 2.0, 0.0, 0.0), (1, 8, 2.5, 0.0, 0.0), (2, 9, 1.0, 0.0, 0.0)], "patient_id long, id long, z double, y double, x double")
    got = voxels.between_planes(where, grid, planes, 2, 2)
    assert sorted((r.id, r.z, r.dose_gy) for r in got.collect()) == [(7, 0.5, 3.5), (7, 2.0, 2.0), (8, 2.5, 0.0), (9, 1.0, 0.0)]


def test_equal_masks_are_compared_once(spark):
    """Twelve structures of three masks, and one whose row is cut in two spans."""
    shapes = {"big": [(0, 0, 0, 6), (0, 1, 0, 6)], "cut": [(0, 0, 0, 3), (0, 0, 3, 6), (0, 1, 0, 6)], "small": [(0, 1, 2, 4)], "away": [(3, 1, 0, 2)]}
    of = {i: ("big", "small", "away")[i % 3] for i in range(12)} | {12: "cut"}
    spans = spark.createDataFrame([(1, i, *s) for i, name in of.items() for s in shapes[name]], "patient_id long, structure_id long, k long, r long, c_lo long, c_hi long")
    cells = {i: {(k, r, c) for k, r, lo, hi in shapes[name] for c in range(lo, hi)} for i, name in of.items()}
    held = {(a, b) for a, b in itertools.permutations(of, 2) if cells[a] <= cells[b]}
    members, between = raster.mask_classes(spans)
    assert members.select("rep").distinct().count() == 4 and between.count() == 4
    assert sorted((r.part, r.whole) for r in raster.contained(spans).collect()) == sorted(held)
    want = {a: min((len(cells[b]), b) for x, b in held if x == a)[1] for a in {a for a, _ in held}}
    assert {r.part: r.parent for r in raster.parents(spans).collect()} == want
    rivals = [(a, b) for a in of for b in of if a == b or ((a, b) not in held and (b, a) not in held)]
    assert sorted((r.target, r.rival) for r in raster.competitors(spans).collect()) == sorted(rivals)
    few = spans.filter("structure_id in (0, 1, 2, 4)")
    left = {i: set(cells[i]) for i in (0, 1, 2, 4)}
    for a, b in held:
        if a in left and b in left:
            left[b] -= cells[a]
    assert sorted((r.structure_id, r.k, r.r, r.c) for r in frames.without_nested(few).collect()) == sorted((i, *x) for i in left for x in left[i])


def test_a_dose_is_held_once_and_not_for_every_step(spark):
    """The end of the truncated curve was looked for again at every step of the curve."""
    text = registry.QUERIES["d11_curve_readout"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("filter(steps") <= 2


def test_points_meet_their_structure_only(spark):
    assert not re.search(r"NestedLoopJoin \w+, Inner", plan(gq._asked(spark, SF)))


def test_batches_of_planes_and_rows_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    f = np.where(rng.random((40, 30)) < 0.3, rng.random((40, 30)) * 50, np.inf)
    few = surfaces.envelope(f, np.arange(40) * 1.5)
    monkeypatch.setattr(surfaces, "FEW", 0)
    assert np.allclose(surfaces.envelope(f, np.arange(40) * 1.5), few)
    spans = spark.createDataFrame([(1, s, k, r, 3 - s, 5 + k % 2) for s in (1, 2) for k in (1, 2, 4) for r in (2, 3, 5)], "patient_id long, structure_id long, k long, r long, c_lo long, c_hi long")
    blocks = surfaces.widened(surfaces.boxes(spans), 4.0, 2.0, 2.5, 3.0, 8, 9, 9)
    rows = lambda: sorted(map(tuple, surfaces.distances(spans, blocks, 2.0, 2.5, 3.0).collect()))
    monkeypatch.setattr(surfaces, "CELLS", 1)
    alone = rows()
    monkeypatch.setattr(surfaces, "CELLS", 150)
    assert alone and rows() == alone
    lines = surfaces.plane_lines(spans, blocks.withColumn("owners", F.array("structure_id")), 2.0, 2.5)
    assert not re.search(r"FlatMapGroupsInArrow \[[^\]]*\bk#", plan(lines))


def test_patients_rows_are_dealt_to_as_many_tasks_as_are_set(spark):
    """Shuffled partitions were joined to ones of 64 MB, whose rows took gigabytes of a task; a3 shuffled its edges for a join."""
    for name in ("a2_cumulative_curve", "a3_unweighted_curve", "d8_dose_at_volume_pct"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert re.search(r"hashpartitioning\(patient_id#\d+L, 4\), REPARTITION_BY_NUM", text), name
        assert not re.search(r"hashpartitioning\([^)]*\bbin#\d+, \d+\), ENSURE_REQUIREMENTS[^\n]*\n[^\n]*Exchange", text)


def test_the_plain_curve_lists_every_bin(spark):
    doses = {"A": [0.0, 3.0, 3.0, 7.9, 8.0], "B": [0.5, -1.0]}
    rows = spark.createDataFrame([(1, s, d) for s, x in doses.items() for d in x], "patient_id long, structure string, dose_gy double")
    got = {(r.structure, r.bin): (r.dose_gy, r.volume_pct) for r in dvh.unweighted(rows, 8).collect()}
    place = lambda d: min(max(int(d // 1.0), 0), 7)
    assert got == {(s, b): (float(b), sum(place(d) >= b for d in x) / len(x) * 100) for s, x in doses.items() for b in range(8)}


def test_samples_are_dealt_before_they_are_summed(spark):
    """The sums of a scan's task took memory by the size of its split; they were shuffled twice."""
    for name in ("a2_cumulative_curve", "d8_dose_at_volume_pct", "a13_max_plotted_dose"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 1, name


def test_larger_inputs_are_dealt_to_more_tasks(spark, monkeypatch):
    """A fixed number of tasks took memory as their rows grew."""
    size = Path(SF, "lineitem.parquet").stat().st_size
    for name in ("d9_dose_at_volume_cc", "t17_target_rows", "t7_target_metrics", "a13_max_plotted_dose"):
        few = sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
        with monkeypatch.context() as m:
            m.setattr(dvh, "TASK_BYTES", 10_000, raising=False)
            many = registry.QUERIES[name](spark, SF)
            assert re.search(rf"hashpartitioning\(patient_id#\d+L, {-(-size // 10_000)}\), REPARTITION_BY_NUM", plan(many)), name
            assert few and sorted(map(str, many.collect())) == few


def test_sizes_of_files_are_listed(spark, tmp_path):
    """Names that are escaped or look like patterns, files of several tables, and rows of no file."""
    paths = [str(tmp_path / x) for x in ("a b%20c", "x{y}")]
    for n, path in enumerate(paths):
        spark.range(1000 * (n + 1)).write.parquet(path)
    a, b = spark.read.parquet(paths[0]), spark.read.parquet(str(tmp_path / "x?y?"))
    held = lambda path: sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
    assert stored_bytes(a) == held(paths[0]) and stored_bytes(a.join(b.filter("id > 5"), "id")) == held(paths[0]) + held(paths[1])
    assert stored_bytes(spark.range(5)) == 0


def test_tables_of_targets_are_not_collected(spark):
    """Targets, spans and rivals were broadcast from the driver by every join, and one plan held all of a query's steps."""
    for name in ("t12_owned_volumes", "t13_stereotactic_indices", "t14_margin_weights", "t15_margin_volumes"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "BroadcastHashJoin" not in text, name
        assert name != "t13_stereotactic_indices" or "FlatMapGroupsInArrow" not in text
