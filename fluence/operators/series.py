"""Image series and dose grids put together from slices and frames by their orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extras import dot, unit


def normal(across: Column, down: Column) -> Column:
    """The direction across a plane's rows and columns, of length one."""
    a, d = unit(across), unit(down)
    at = lambda v, i: F.element_at(v, i + 1)
    return unit(F.array(*(at(a, i) * at(d, j) - at(a, j) * at(d, i) for i, j in ((1, 2), (2, 0), (0, 1)))))


def series_from_orientation(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Slices (keys, file_no, origin, across, down, step_mm, thickness_mm, slope, intercept, values) in order of their position along
    the normal of the series' first file: k, position, spacing_mm and values scaled.

    spacing_mm is the absolute median distance between neighbours; a single slice has its thickness, 1 mm without one. Missing
    slopes are 1 and intercepts 0; slices at one place come by file_no; slices without an origin are left out, as are series whose
    first file has no orientation. Values are scaled where they stand: the sort moves only what a slice's row holds."""
    first = slices.groupBy(*keys).agg(F.min_by(F.struct("across", "down", "thickness_mm"), "file_no").alias("lead"))
    first = first.filter("lead.across is not null and lead.down is not null")
    first = first.select(*keys, normal(F.col("lead.across"), F.col("lead.down")).alias("normal"), F.coalesce("lead.thickness_mm", F.lit(1.0)).alias("alone"))
    x = slices.filter("origin is not null").join(first, keys).withColumn("position", dot(F.col("origin"), F.col("normal")))
    o = Window.partitionBy(*keys).orderBy("position", "file_no")
    at = x.select(*keys, "file_no", "position", "alone").withColumn("k", F.row_number().over(o) - 1).withColumn("gap", F.col("position") - F.lag("position").over(o))
    step = at.groupBy(*keys).agg(F.coalesce(F.abs(F.percentile("gap", 0.5)), F.abs(F.first("alone"))).alias("spacing_mm"))
    slope, intercept = F.coalesce("slope", F.lit(1.0)), F.coalesce("intercept", F.lit(0.0))
    scaled = F.transform("values", lambda v: v * slope + intercept)
    return slices.select(*keys, "file_no", scaled.alias("values")).join(at.drop("alone", "gap"), [*keys, "file_no"]).join(step, keys).select(*keys, "k", "file_no", "position", "spacing_mm", "values")


def grid_from_frames(grids: DataFrame, keys: list[str]) -> DataFrame:
    """S3: grids (keys, origin, across, down, offsets, scaling, frames: an array of values for each frame) as frames: k, frame origin
    (origin and offset along the normal), position, spacing_mm and dose_gy.

    Without offsets frame k stands k mm off. spacing_mm is the absolute median distance of frames, 1 mm for a single one. A
    missing scaling is 1; grids without frames have no rows; a list of offsets of another length than frames is an error."""
    g = grids.filter(F.size("frames") > 0).withColumn("n", normal(F.col("across"), F.col("down")))
    g = g.withColumn("offsets", F.coalesce("offsets", F.transform(F.sequence(F.lit(0), F.size("frames") - 1), lambda i: i.cast("double"))))
    fault = F.raise_error(F.lit("a grid has other numbers of offsets and of frames")).cast("array<double>")
    g = g.withColumn("offsets", F.when(F.size("offsets") == F.size("frames"), F.col("offsets")).otherwise(fault))
    base = dot(F.col("origin"), F.col("n"))
    gaps = F.array_sort(F.transform(F.sequence(F.lit(2), F.size("offsets")), lambda i: F.element_at("offsets", i) - F.element_at("offsets", i - 1)))
    half = F.size("gaps") / 2
    low, high = F.element_at("gaps", F.greatest(F.lit(1), F.ceil(half)).cast("int")), F.element_at("gaps", (F.floor(half) + 1).cast("int"))
    g = g.withColumn("gaps", F.when(F.size("offsets") > 1, gaps)).withColumn("spacing_mm", F.when(F.col("gaps").isNull(), 1.0).otherwise(F.abs(low + high) / 2))
    f = g.select(*keys, "origin", "n", base.alias("base"), "spacing_mm", F.coalesce("scaling", F.lit(1.0)).alias("scaling"), F.posexplode(F.arrays_zip("offsets", "frames")).alias("k", "f"))
    along = F.zip_with("origin", "n", lambda x, d: x + F.col("f.offsets") * d)
    return f.select(*keys, "k", along.alias("origin"), (F.col("base") + F.col("f.offsets")).alias("position"), "spacing_mm", F.transform("f.frames", lambda v: v * F.col("scaling")).alias("dose_gy"))
