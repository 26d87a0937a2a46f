"""From contours and a dose grid to weighted samples: fractional occupancy, oversampling, sampling between planes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import merged
from . import dvh, fine, raster, voxels

S = raster.SLICE

# Trapezoids of the fuzzy oversampling decision.
RSS = {"very_small": (0.0, 0.0, 7.0, 12.0), "small": (7.0, 10.0, 12.0, 18.0), "medium": (14.0, 18.0, 34.0, 72.0), "large": (36.0, 72.0, 100.0, 100.0)}
COMPLEXITY = {"low": (0.0, 0.0, 0.2, 0.6), "high": (0.2, 0.6, 2.0, 2.0)}
OUTPUT = {"low": (-1.0, -1.0, -0.75, -0.25), "normal": (-0.75, -0.25, 0.25, 0.75), "high": (0.25, 0.75, 1.25, 1.75), "very_high": (1.25, 1.75, 2.0, 2.0)}
STEPS = 3000
#: The finest grid, in cells of the dose grid.
FINEST = 8


def membership(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 outside (a, d), 1 from b to c, straight between; an end that is level with its neighbour stays at 1 beyond it."""
    up = F.lit(1.0) if a == b else F.when(x <= a, 0.0).when(x < b, (x - a) / (b - a)).otherwise(1.0)
    down = F.lit(1.0) if c == d else F.when(x >= d, 0.0).when(x > c, (d - x) / (d - c)).otherwise(1.0)
    return F.least(up, down)


def oversampling(metrics: DataFrame, least: float = 0.5, most: float = 4.0) -> DataFrame:
    """Metrics (…, rss, complexity) with power and factor: four rules, the greatest of the outputs cut at them, its centre of mass on
    3001 points from -1 to 2, rounded half to even, as a power of two within limits.

    Structures of the same metrics are decided once; what is decided is dealt to as many tasks as the session sets, as a small
    table takes long."""
    keys = ["rss", "complexity"]
    parts = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decided = _decided(metrics.select(*keys).repartition(parts, *keys).distinct(), least, most).withColumnsRenamed({c: f"_{c}" for c in keys})
    return metrics.join(decided, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*(f"_{c}" for c in keys))


def _decided(metrics: DataFrame, least: float, most: float) -> DataFrame:
    rss, comp = F.greatest("rss", F.lit(0.0)), F.greatest("complexity", F.lit(0.0))
    r = {k: membership(rss, *v) for k, v in RSS.items()}
    c = {k: membership(comp, *v) for k, v in COMPLEXITY.items()}
    rules = {"very_high": r["very_small"], "high": F.greatest(F.least(r["small"], c["high"]), F.least(r["medium"], c["high"])), "normal": F.greatest(F.least(r["small"], c["low"]), F.least(r["medium"], c["low"])), "low": r["large"]}
    out = metrics.withColumns({f"_{k}": v for k, v in rules.items()})
    xs = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: i / 1000.0 - 1.0)
    mu = lambda x: F.greatest(*(F.least(membership(x, *OUTPUT[k]), F.col(f"_{k}")) for k in OUTPUT))
    at = F.transform(xs, lambda x: F.struct(x.alias("x"), mu(x).alias("m")))
    sums = F.aggregate(at, F.struct(F.lit(0.0).alias("xm"), F.lit(0.0).alias("m")), lambda acc, p: F.struct((acc["xm"] + p["x"] * p["m"]).alias("xm"), (acc["m"] + p["m"]).alias("m")))
    out = out.withColumn("_s", sums).withColumn("power", F.when(F.col("_s.m") > 0, F.col("_s.xm") / F.col("_s.m")).otherwise(0.0))
    factor = F.pow(F.lit(2.0), F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("power")))))
    return out.withColumn("factor", F.greatest(F.lit(least), F.least(F.lit(most), factor))).drop("_s", *(f"_{k}" for k in rules))


def z_offsets(thickness: Column, factor: Column) -> Column:
    """Centred offsets within a slab, as many as the factor (at least one)."""
    n = F.greatest(F.lit(1), F.rint(F.greatest(F.lit(1.0), factor)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i + 0.5) / n - 0.5) * thickness)


def occupancy(points: DataFrame, scale: Column | float, rows: int, cols: int, sub: int) -> DataFrame:
    """The share of every cell that is inside, of grids `scale` times finer (a number, or a column of points that is one for each
    structure, up to FINEST): 1 for interior cells, for border cells the share of sub x sub points. Rows are (SLICE, r, c, scale,
    share).

    Points are dealt out by slice; what is shuffled after that are rows of cells, with their spans and where the lines of points cross
    the contours. Cells are made at the end, and a border cell counts its points by the crossings of its row."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = points.withColumn("scale", (scale if isinstance(scale, Column) else F.lit(scale)).cast("double"))
    fine = fine.withColumn("r", F.col("r") * F.col("scale")).withColumn("c", F.col("c") * F.col("scale")).repartition(parts, *S)
    per = fine.groupBy(*S).agg(F.max("scale").alias("scale"))
    spans = raster.mask_spans(fine, rows * FINEST, cols * FINEST).join(per, S).filter(F.col("r") < F.floor(rows * F.col("scale")))
    spans = spans.withColumn("c_hi", F.least("c_hi", F.floor(cols * F.col("scale")))).filter("c_lo < c_hi")
    lines = raster.by_row(spans, F.max("scale").alias("scale")).join(raster.row_crossings(fine, sub), [*S, "r"], "left")
    cell = raster.row_cells(lines, "scale", "crossings")

    def left_of(x):
        """How many of a cell's points in one line are left of x; exact by comparison with the points beside the quotient."""
        point = lambda j: F.col("c") + (j + 0.5) / sub
        j = F.greatest(F.lit(0), F.least(F.lit(sub), F.ceil((x - F.col("c")) * sub - 0.5)))
        near = j + F.when((j < sub) & (point(j) < x), 1).otherwise(0) - F.when((j > 0) & (point(j - 1) >= x), 1).otherwise(0)
        return F.when(x <= F.col("c"), 0).when(x >= F.col("c") + 1, sub).otherwise(near)

    hits = F.aggregate("crossings", F.lit(0).cast("bigint"), lambda acc, e: acc + e["sign"] * left_of(e["x"]))
    share = F.when(F.col("interior"), 1.0).otherwise(F.coalesce(hits, F.lit(0)) / float(sub * sub))
    return cell.select(*S, "r", "c", "scale", share.alias("share"))


def curves(points: DataFrame, dose: DataFrame, planes: DataFrame, positions: DataFrame, scale: Column | float, rows: int, cols: int, sx: float, sy: float, sub: int = 6, width: float = dvh.WIDTH) -> DataFrame:
    """Dvh.curves of every occupied cell, sampled at its centre and at each offset of its slab, on an axis that ends at the whole
    grid's largest dose; a structure's samples stay in one task (fine.curves).

    scale is a number, or a column of points with each structure's factor (X15), so structures of all factors are sampled in one
    run. positions (patient_id, k, z, thickness) places slices; planes (patient_id, k, z) places the dose grid's."""
    wanted = scale if isinstance(scale, Column) else F.lit(float(scale))
    at = points.join(merged(positions), ["patient_id", "k"])
    x = at.select(*S, "contour_no", "i", *(F.col(c).cast("double").alias(c) for c in ("r", "c", "z", "thickness")), F.greatest(F.lit(0.5), F.least(F.lit(4.0), wanted)).cast("double").alias("scale"), z_offsets(F.col("thickness"), wanted).alias("offsets"))

    def slabs(table):
        t = table.sort_by([("z", "ascending"), ("k", "ascending"), ("contour_no", "ascending"), ("i", "ascending")])
        k, s = t.column("k").to_numpy(), float(t.column("scale")[0].as_py())
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        plane = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        r, c = (t.column(x).to_numpy() * s for x in ("r", "c"))
        high, wide = int(np.floor(rows * s)), int(np.floor(cols * s))
        box = fine.box_of(r, c, high, wide)
        z, thickness = (t.column(x).to_numpy()[first] for x in ("z", "thickness"))
        offsets = [np.array(t.column("offsets")[int(j)].as_py()) for j in first]

        def cut():
            for p, *cells in fine.by_plane(fine.shares(plane, t.column("contour_no").to_numpy(), r, c, box, high, sub)):
                n = len(offsets[p])
                yield z[p] + offsets[p], np.full(n, sx * sy / (s * s) * thickness[p] / (1000 * n)), *cells

        return s, box, cut()

    return fine.curves(x, dose, planes, rows, cols, width, slabs)


def strategy(geometry: DataFrame, small_cc: float = 5.0) -> DataFrame:
    """How each structure's curve (patient_id, structure_id, name_norm, volume_cc) is made: by voxels for BODY, finely for
    small volumes, else by samples. Of structures with one name the last counts."""
    last = geometry.groupBy("patient_id", "name_norm").agg(F.max_by(F.struct("structure_id", "volume_cc"), "structure_id").alias("x")).select("patient_id", "name_norm", "x.*")
    return last.withColumn("strategy", F.when(F.col("name_norm") == "BODY", "voxels").when(F.col("volume_cc") <= small_cc, "small").otherwise("samples"))


def resampled(dose: DataFrame, planes: DataFrame, image_slices: DataFrame, rows: int, cols: int, scale_r: float, shift_r: float, scale_c: float, shift_c: float) -> DataFrame:
    """Dose on an image grid: each image slice (patient_id, k, z) takes the nearest dose plane, bilinear in it; integer cells map
    without a half-cell shift."""
    near = raster.nearest_slice(image_slices.select("patient_id", F.col("k").cast("bigint").alias("id"), F.col("z").alias("at")), planes)
    # one row for each image slice until its doses are read, so that no cell is shuffled
    held = near.select("patient_id", F.col("id").alias("image_k"), "k").join(voxels.grids(dose, rows, cols), ["patient_id", "k"], "left")
    at = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.struct(r.alias("r"), c.alias("c"), voxels.between("plane", r * scale_r + shift_r, c * scale_c + shift_c, rows, cols).alias("dose_gy")))))
    return held.select("patient_id", F.col("image_k").alias("k"), F.explode(at).alias("x")).select("patient_id", "k", "x.r", "x.c", "x.dose_gy")
