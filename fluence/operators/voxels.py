"""Dose grids as voxel rows (patient_id, k, r, c, dose_gy): sums, maxima, bounds, sampling and masks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import cells

V = ["patient_id", "k", "r", "c"]


def hottest(voxels: DataFrame) -> DataFrame:
    """Each grid's largest dose and its voxel, the first in slice, row, column order; NaN does not count."""
    key = F.struct("dose_gy", (-F.col("k")).alias("k"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))
    return voxels.filter(~F.isnan("dose_gy")).groupBy("patient_id").agg(F.max(key).alias("x")).select("patient_id", F.col("x.dose_gy").alias("dose_gy"), (-F.col("x.k")).alias("k"), (-F.col("x.r")).alias("r"), (-F.col("x.c")).alias("c"))


def hottest_outside(voxels: DataFrame, spans: DataFrame) -> DataFrame:
    """The largest dose outside every given structure; one anti-join, no sort."""
    return hottest(voxels.join(cells(spans).select(*V).distinct(), V, "left_anti"))


def summed(grids: DataFrame) -> DataFrame:
    """Grids (grid_id, V, dose_gy) of a patient's phases, added voxel by voxel; a patient whose grids have other shapes is an error."""
    shape = grids.groupBy("patient_id", "grid_id").agg(F.max("r").alias("r"), F.max("c").alias("c"), F.max("k").alias("k"))
    bad = shape.groupBy("patient_id").agg((F.countDistinct("r", "c", "k") > 1).alias("bad"))
    out = grids.groupBy(*V).agg(F.sum("dose_gy").alias("dose_gy"))
    checked = out.join(bad, "patient_id").withColumn("ok", F.assert_true(~F.col("bad"), "dose grids of one patient have different shapes"))
    return checked.filter("ok is null").drop("bad", "ok")


def view_bounds(voxels: DataFrame, least: float) -> DataFrame:
    """For each slice the box of voxels at or above a threshold."""
    return voxels.filter(F.col("dose_gy") >= least).groupBy("patient_id", "k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"))


def masked(voxels: DataFrame, spans: DataFrame) -> DataFrame:
    """The voxels of every structure; spans are joined by row, then cut by column, so only spans are shuffled."""
    s = spans.select("patient_id", "structure_id", "k", "r", "c_lo", "c_hi")
    return voxels.join(s, ["patient_id", "k", "r"]).filter((F.col("c") >= F.col("c_lo")) & (F.col("c") < F.col("c_hi"))).drop("c_lo", "c_hi")


def grids(voxels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each plane (patient_id, k) as one row: plane, an array of lines of doses. Cells and lines without a dose are null; doses of one
    cell are added."""
    v = voxels.filter(F.col("dose_gy").isNotNull() & (F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols)).select(*V, "dose_gy").repartition("patient_id", "k")
    cell = F.array_sort(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), F.col("dose_gy").cast("double").alias("d"))))
    lines = v.groupBy("patient_id", "k", F.col("r").cast("int").alias("r")).agg(cell.alias("x"))
    # a whole line is taken as it is; others look for each column
    whole = (F.size("x") == cols) & ~F.array_contains(F.transform("x", lambda e, i: e["c"] == i), False)
    one = lambda i: F.aggregate("x", F.lit(None).cast("double"), lambda acc, e: F.when(e["c"] == i, F.coalesce(acc, F.lit(0.0)) + e["d"]).otherwise(acc))
    line = F.when(whole, F.transform("x", lambda e: e["d"])).otherwise(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), one))
    planes = lines.select("patient_id", "k", "r", line.alias("line")).groupBy("patient_id", "k").agg(F.collect_list(F.struct("r", "line")).alias("x"))
    at = lambda i: F.get(F.filter("x", lambda e: e["r"] == i), F.lit(0))["line"]
    return planes.select("patient_id", "k", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), at).alias("plane"))


def between(plane: str | Column, y: Column, x: Column, rows: int, cols: int) -> Column:
    """The dose between four corners of a plane of grids(); 0 outside, edges included; corners without a dose count as 0, the upper
    neighbour stays in the grid."""
    p = F.col(plane) if isinstance(plane, str) else plane
    r0, c0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    fr, fc = y - r0, x - c0
    r1, c1 = F.least(r0 + 1, F.lit(rows - 1)), F.least(c0 + 1, F.lit(cols - 1))
    of = lambda r, c, w: F.coalesce(w * F.get(F.get(p, r), c), F.lit(0.0))
    got = of(r0, c0, (1 - fr) * (1 - fc)) + of(r0, c1, (1 - fr) * fc) + of(r1, c0, fr * (1 - fc)) + of(r1, c1, fr * fc)
    return F.when((y >= 0) & (y <= rows - 1) & (x >= 0) & (x <= cols - 1), got).otherwise(0.0)


def bilinear(asked: DataFrame, voxels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Asked (patient_id, id, k, y, x) with the dose between its four corners; 0 outside, edges included. A sample meets its
    plane once, so each is shuffled once."""
    got = asked.join(grids(voxels, rows, cols), ["patient_id", "k"], "left")
    return got.select(*asked.columns, between("plane", F.col("y"), F.col("x"), rows, cols).alias("dose_gy"))


def nearest(asked: DataFrame, voxels: DataFrame, rows: int, cols: int) -> DataFrame:
    """The dose of the nearest voxel, halves to even; 0 outside."""
    q = asked.withColumn("r", F.rint("y").cast("bigint")).withColumn("c", F.rint("x").cast("bigint"))
    return q.join(voxels, V, "left").select(*asked.columns, F.coalesce("dose_gy", F.lit(0.0)).alias("dose_gy"))


def between_planes(asked: DataFrame, voxels: DataFrame, planes: DataFrame, rows: int, cols: int) -> DataFrame:
    """Asked (patient_id, id, z, y, x) between the two planes (patient_id, k, z) around z, bilinear in each; 0 outside the
    planes' range; a single plane counts everywhere. A patient's planes are one array, in which each sample looks up its pair."""
    stack = planes.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("z", "k"))).alias("planes"))
    below = F.filter("planes", lambda p: p["z"] <= F.col("z"))
    # a sample on a plane belongs to the pair below it, but on the first plane to the first pair
    under = F.filter("planes", lambda p: p["z"] < F.col("z"))
    at = F.greatest(F.size(under), F.least(F.size(below), F.lit(1)))
    a = asked.join(stack, "patient_id", "left").withColumn("n", F.size("planes")).withColumn("at", F.when(F.col("n") == 1, 1).otherwise(at))
    a = a.withColumn("at", F.when(F.expr("at > 0 and (n = 1 or at < n)"), F.col("at")))
    low, high = F.get("planes", F.col("at") - 1), F.get("planes", F.col("at"))
    a = a.select(*asked.columns, "at", low["z"].alias("z0"), high["z"].alias("z1"))
    # a sample meets both of its planes in one row
    pair = stack.select("patient_id", F.posexplode("planes").alias("no", "p"), "planes").select("patient_id", (F.col("no") + 1).alias("at"), F.col("p.k").alias("k0"), F.get("planes", F.col("no") + 1)["k"].alias("k1"))
    grid = grids(voxels, rows, cols)
    pair = pair.join(grid.withColumnsRenamed({"k": "k0", "plane": "plane0"}), ["patient_id", "k0"], "left").join(grid.withColumnsRenamed({"k": "k1", "plane": "plane1"}), ["patient_id", "k1"], "left")
    got = a.join(pair.select("patient_id", "at", "plane0", "plane1"), ["patient_id", "at"], "left")
    t = F.coalesce((F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0")), F.lit(0.0))
    on = lambda plane: between(plane, F.col("y"), F.col("x"), rows, cols)
    dose = F.when(F.col("z1").isNull(), on("plane0")).otherwise((1 - t) * on("plane0") + t * on("plane1"))
    return got.select(*asked.columns, F.when(F.col("at").isNull(), 0.0).otherwise(dose).alias("dose_gy"))


def thresholds(weighted: DataFrame, cc: float, levels: list[float]) -> DataFrame:
    """T12 and T13's volumes: Σ weight times voxel volume at or above each level, all levels in one pass."""
    return weighted.groupBy("patient_id", "structure_id").agg(*(F.sum(F.when(F.col("dose_gy") >= x, F.col("weight") * cc).otherwise(0.0)).alias(f"v{i}") for i, x in enumerate(levels)))


def gradient(voxels: DataFrame, sx: float, sy: float) -> DataFrame:
    """Central differences in the plane, one-sided at edges, as the length of the gradient."""
    row, col = Window.partitionBy("patient_id", "k", "r").orderBy("c"), Window.partitionBy("patient_id", "k", "c").orderBy("r")

    def slope(w, name, step):
        a, b = F.lag("dose_gy").over(w), F.lead("dose_gy").over(w)
        pa, pb = F.lag(name).over(w), F.lead(name).over(w)
        top, bottom = F.coalesce(b, "dose_gy") - F.coalesce(a, "dose_gy"), F.coalesce(pb, name) - F.coalesce(pa, name)
        return F.when(bottom > 0, top / (bottom * step)).otherwise(0.0)

    return voxels.withColumn("gx", slope(row, "c", sx)).withColumn("gy", slope(col, "r", sy)).select(*V, F.hypot("gx", "gy").alias("gradient"))
