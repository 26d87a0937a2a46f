"""Frames and blocks: contours from patient coordinates to slices, image to dose-grid transforms, samples at patient coordinates,
planes across slices, blocks, running lengths, and targets' own doses and surroundings.

A frame is its unit directions `across` (one column on) and `down` (one row on), lists of three numbers, and its spacings sx, sy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import voxels as vx
from .extras import dot
from .raster import CONTOUR, SLICE, S, cells, mask_classes, nearest_slice

P = "patient_id"
#: What a contour's structure is called and coloured where a file says nothing.
DEFAULT_NAME, DEFAULT_COLOUR = "ROI ", "255,255,0"


def _unit(v):
    n = math.sqrt(sum(x * x for x in v))
    if not n:
        raise ValueError("an orientation has length zero")
    return [x / n for x in v]


def _normal(across, down):
    (a, b, c), (d, e, f) = _unit(across), _unit(down)
    return [b * f - c * e, c * d - a * f, a * e - b * d]


def _lits(v):
    return F.array(*(F.lit(float(x)) for x in v))


def _slice_of(asked: DataFrame, slices: DataFrame) -> DataFrame:
    """Asked (patient_id, id, at) with its slice of (patient_id, k, z), k ascending by one. Evenly spaced slices are counted off,
    half steps to even; among others the nearest is taken, the lower one on a tie."""
    gap = F.col("z") - F.lag("z").over(Window.partitionBy(P).orderBy("z"))
    step = slices.withColumn("gap", gap).groupBy(P).agg(
        F.min("z").alias("z0"), F.min("k").alias("k0"), F.count("*").alias("n"), F.percentile("gap", 0.5).alias("dz"), F.min("gap").alias("least"), F.max("gap").alias("most")
    )
    slack = F.abs(F.col("dz")) * 1e-5 + 1e-3
    even = (F.abs(F.col("dz")) > 1e-6) & (F.col("dz") - F.col("least") <= slack) & (F.col("most") - F.col("dz") <= slack)
    step = step.select(P, "z0", "k0", "n", "dz", F.coalesce(even, F.lit(False)).alias("even"))
    both = asked.join(step, P)
    k = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.rint((F.col("at") - F.col("z0")) / F.col("dz")).cast("bigint")))
    counted = both.filter("even").select(P, "id", "at", (F.col("k0") + k).alias("k"))
    return counted.unionByName(nearest_slice(both.filter("not even").select(P, "id", "at"), slices))


def contours(points: DataFrame, slices: DataFrame, across, down, sx: float, sy: float) -> DataFrame:
    """Polygon vertices (S, contour_no, i, xyz, name, colour) of slices (patient_id, k, z, origin) as contour rows in each slice's
    row and column. Polygons of fewer than three points go; a polygon lies in the slice nearest to its mean position along the
    normal; structures without a name or colour get the default ones."""
    key = [*S, "contour_no"]
    mean = points.groupBy(*key).agg(F.count("*").alias("n"), F.avg(dot(F.col("xyz"), _lits(_normal(across, down)))).alias("at"))
    asked = mean.filter("n >= 3").select(P, F.struct("structure_id", "contour_no").alias("id"), "at")
    at = _slice_of(asked, slices.select(P, "k", "z")).select(P, F.col("id.structure_id").alias("structure_id"), F.col("id.contour_no").alias("contour_no"), "k")
    x = points.join(at, key).join(slices.select(P, "k", "origin"), [P, "k"])
    rel = F.zip_with("xyz", "origin", lambda a, o: a - o)
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.concat(F.lit(DEFAULT_NAME), F.col("structure_id").cast("string"))).otherwise(F.col("name"))
    r, c = dot(rel, _lits(_unit(down))) / sy, dot(rel, _lits(_unit(across))) / sx
    return x.select(*CONTOUR, "i", name.alias("name"), F.coalesce("colour", F.lit(DEFAULT_COLOUR)).alias("colour"), r.alias("r"), c.alias("c"))


def slice_transforms(slices: DataFrame, image, dose, first_origin) -> DataFrame:
    """For slices (patient_id, k, origin) of the frame image = (across, down, sx, sy), the affine from a slice's row and column to
    those of the frame dose, whose first plane begins at first_origin: two rows m.., an offset and the position along the normal."""
    (ia, idn, isx, isy), (da, dd, dsx, dsy) = image, dose
    ia, idn, da, dd, normal = _unit(ia), _unit(idn), _unit(da), _unit(dd), _normal(da, dd)
    inner = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    position = dot(F.col("origin"), _lits(normal))
    along = position - inner(first_origin, normal)
    rel = F.array(*(F.element_at("origin", j + 1) - first_origin[j] - along * normal[j] for j in range(3)))
    return slices.select(
        P, "k", position.alias("position"),
        *(F.lit(float(v)).alias(n) for n, v in {
            "m00": inner(idn, dd) * isy / dsy, "m01": inner(ia, dd) * isx / dsy, "m10": inner(idn, da) * isy / dsx, "m11": inner(ia, da) * isx / dsx,
        }.items()),
        (dot(rel, _lits(dd)) / dsy).alias("o0"), (dot(rel, _lits(da)) / dsx).alias("o1"),
    )


def sampled_at(asked: DataFrame, voxels: DataFrame, planes: DataFrame, frame, first_origin, rows: int, cols: int) -> DataFrame:
    """Asked (patient_id, id, xyz) with the dose between the eight voxels around it; 0 outside the grid (planes patient_id, k, z)."""
    across, down, sx, sy = frame
    rel = F.zip_with("xyz", _lits(first_origin), lambda a, o: a - o)
    at = asked.select(P, "id", dot(F.col("xyz"), _lits(_normal(across, down))).alias("z"), (dot(rel, _lits(_unit(down))) / sy).alias("y"), (dot(rel, _lits(_unit(across))) / sx).alias("x"))
    return vx.between_planes(at, voxels, planes, rows, cols).select(P, "id", "dose_gy")


def orthogonal_bounds(voxels: DataFrame, least: float, sx: float, sy: float, sz: float) -> DataFrame:
    """The boxes of voxels at or above a threshold seen from the side (rows by slices) and from the front (columns by slices);
    slices are stretched to the in-plane spacing. Partial extremes are combined before the shuffle."""
    b = voxels.filter(F.col("dose_gy") >= least).groupBy(P).agg(*(f(v).alias(f"{v}{i}") for v in "krc" for i, f in enumerate((F.min, F.max))))
    k = lambda s, i: (F.col(f"k{i}") * (sz / max(s, 1e-6)))
    return b.select(
        P, F.col("r0").alias("side_0"), F.col("r1").alias("side_1"), k(sy, 0).alias("side_top"), k(sy, 1).alias("side_bottom"),
        F.col("c0").alias("front_0"), F.col("c1").alias("front_1"), k(sx, 0).alias("front_top"), k(sx, 1).alias("front_bottom"),
    )


def side_plane(voxels: DataFrame, column: int, sy: float, sz: float) -> DataFrame:
    """Each grid's plane of one column (slices by rows), its slices resampled to the row spacing with both ends kept. Only the
    voxels of that column are read; each new line takes at most two slices."""
    plane = voxels.filter(F.col("c") == column).select(P, "k", "r", "dose_gy")
    n = plane.groupBy(P).agg((F.max("k") + 1).alias("n")).withColumn("out", F.greatest(F.lit(1), F.rint(F.col("n") * (sz / max(sy, 1e-6))).cast("bigint")))
    line = n.withColumn("line", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("out") - 1)))
    at = F.when(F.col("out") > 1, F.col("line") * (F.col("n") - 1) / (F.col("out") - 1)).otherwise(0.0)
    k0 = F.floor("at")
    pair = F.array(F.struct(k0.alias("k"), (1 - (F.col("at") - k0)).alias("w")), F.struct(F.least(k0 + 1, F.col("n") - 1).alias("k"), (F.col("at") - k0).alias("w")))
    want = line.withColumn("at", at).select(P, "line", F.explode(pair).alias("x")).select(P, "line", "x.k", "x.w").filter("w > 0")
    return plane.join(want, [P, "k"]).groupBy(P, "line", "r").agg(F.sum(F.col("w") * F.col("dose_gy")).alias("dose_gy"))


def blocks(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The voxels within each box (S, k0, k1, r0, r1, c0, c1; ends included), counted from the box's corner. Boxes are joined as
    rows of voxels, so no grid meets all boxes of its patient."""
    b = boxes.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("r", F.explode(F.sequence("r0", "r1")))
    hit = voxels.join(b, [P, "k", "r"]).filter((F.col("c") >= F.col("c0")) & (F.col("c") <= F.col("c1")))
    return hit.select(*S, *((F.col(v) - F.col(f"{v}0")).alias(v) for v in "krc"), "dose_gy")


def running_length(points: DataFrame) -> DataFrame:
    """How far along its closed outline each vertex is from the first, and the outline's length."""
    o = Window.partitionBy(*CONTOUR).orderBy("i")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.coalesce(F.hypot(F.col("r") - F.lag("r").over(o), F.col("c") - F.lag("c").over(o)), F.lit(0.0))
    close = F.hypot(F.last("r").over(whole) - F.first("r").over(whole), F.last("c").over(whole) - F.first("c").over(whole))
    x = points.withColumn("step", step).withColumn("close", close)
    return x.select(*CONTOUR, "i", F.sum("step").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("along"), (F.sum("step").over(whole) + F.col("close")).alias("length"))


def without_nested(spans: DataFrame) -> DataFrame:
    """The cells of each structure that no structure within it has."""
    members, held = mask_classes(spans)
    # of equal masks each is within the others, so nothing is left of them
    alone = members.groupBy(P, "rep").agg(F.count("*").alias("n")).filter("n = 1").select(P, F.col("rep").alias("structure_id"))
    inner = held.select(P, F.col("whole").alias("structure_id"), "part").join(alone, S, "left_semi")
    inner = inner.join(cells(spans).withColumnRenamed("structure_id", "part"), [P, "part"]).select(*S, "k", "r", "c")
    return cells(spans.join(alone, S, "left_semi")).join(inner, [*SLICE, "r", "c"], "left_anti")


def target_doses(grids: DataFrame, targets: DataFrame, spans: DataFrame) -> DataFrame:
    """The voxels of each target (S, source_key) in the dose that its source names: one grid (grid_id, V, dose_gy), or `combined`,
    the sum of the patient's grids. Sums are made only where a target asks for them."""
    asked = targets.filter("source_key = 'combined'").select(P).distinct()
    whole = vx.summed(grids.join(asked, P, "left_semi")).withColumn("source_key", F.lit("combined"))
    every = grids.withColumnRenamed("grid_id", "source_key").unionByName(whole)
    s = spans.join(targets, S).select(*S, "source_key", "k", "r", "c_lo", "c_hi")
    return every.join(s, [P, "source_key", "k", "r"]).filter((F.col("c") >= F.col("c_lo")) & (F.col("c") < F.col("c_hi"))).drop("c_lo", "c_hi")


def geometry_faults(frames: DataFrame) -> DataFrame:
    """Each grid (patient_id, grid_id, shape, origin, spacing, orientation) against the patient's first by id: the first of shape,
    origin, spacing and orientation that differs beyond its tolerance, else null."""
    cols = ("shape", "origin", "spacing", "orientation")
    first = frames.groupBy(P).agg(F.min_by(F.struct(*cols), "grid_id").alias("ref"))
    x = frames.join(first, P)

    def far(name, atol):
        pairs = F.zip_with(f"ref.{name}", name, lambda a, b: F.abs(a - b) <= atol + 1e-5 * F.abs(b))
        return F.when((F.size(f"ref.{name}") != F.size(name)) | ~F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False))), name)

    fault = F.coalesce(F.when(F.col("ref.shape") != F.col("shape"), "shape"), far("origin", 1e-3), far("spacing", 1e-6), far("orientation", 1e-6))
    return x.select(P, "grid_id", fault.alias("fault"))
