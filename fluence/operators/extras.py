"""Further geometry and set operators: frames, hole filling, margins, slice ranges, box overlaps, prescriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .raster import S, SLICE

P = "patient_id"


def unit(v: Column) -> Column:
    """G1: a direction of length one; a zero direction is an error."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.raise_error(F.lit("an orientation has length zero")).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def to_patient(points: DataFrame, sx: float, sy: float) -> DataFrame:
    """(r, c) to x, y, z with a grid's origin and orientation (origin, across, down): column steps go across, row steps down."""
    a, d = unit(F.col("across")), unit(F.col("down"))
    at = lambda i: F.element_at("origin", i + 1) + F.col("c") * sx * F.element_at(a, i + 1) + F.col("r") * sy * F.element_at(d, i + 1)
    return points.withColumn("xyz", F.array(at(0), at(1), at(2)))


def to_grid(points: DataFrame, sx: float, sy: float) -> DataFrame:
    """G2 back: x, y, z to fractional row and column of the plane through origin."""
    v = F.zip_with("xyz", "origin", lambda x, o: x - o)
    return points.withColumn("row", dot(v, unit(F.col("down"))) / sy).withColumn("column", dot(v, unit(F.col("across"))) / sx)


def filled(cell: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each slice's mask (SLICE, r, c) with its holes: background that no path of side-by-side cells joins to the plane's border.

    One plane at a time is flooded in a task, so memory is bounded by a plane; planes spread over the cluster."""

    def fill(frame):
        import numpy as np
        import pandas as pd

        mask = np.zeros((rows + 2, cols + 2), bool)
        mask[frame["r"] + 1, frame["c"] + 1] = True
        free, seen = ~mask, np.zeros_like(mask)
        seen[0, :] = seen[-1, :] = seen[:, 0] = seen[:, -1] = True
        while True:
            wider = seen.copy()
            wider[1:] |= seen[:-1]
            wider[:-1] |= seen[1:]
            wider[:, 1:] |= seen[:, :-1]
            wider[:, :-1] |= seen[:, 1:]
            wider &= free
            if (wider == seen).all():
                break
            seen = wider
        r, c = np.nonzero(~seen[1:-1, 1:-1])
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in SLICE}, "r": r, "c": c})

    return cell.groupBy(*SLICE).applyInPandas(fill, "patient_id long, structure_id long, k long, r long, c long")


def slice_range(slices: DataFrame, extents: DataFrame, margin: float) -> DataFrame:
    """Extents (patient_id, z0, z1) as the first and last slice (patient_id, k, z) within a margin of them."""
    hit = slices.join(extents, P).filter((F.col("z") >= F.col("z0") - margin) & (F.col("z") <= F.col("z1") + margin))
    return hit.groupBy(P).agg(F.min("k").alias("k0"), F.max("k").alias("k1"))


def overlapping_boxes(boxes: DataFrame) -> DataFrame:
    """Pairs of a patient's structures whose boxes (S, r0, r1, c0, c1) overlap; a patient has few structures."""
    b = boxes.select(P, F.col("structure_id").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("r0", "r1", "c0", "c1")))
    meet = (F.col("r0") <= F.col("o_r1")) & (F.col("o_r0") <= F.col("r1")) & (F.col("c0") <= F.col("o_c1")) & (F.col("o_c0") <= F.col("c1"))
    return boxes.join(b, P).filter(meet & (F.col("structure_id") < F.col("other"))).select(P, "structure_id", "other")


def prescriptions(plans: DataFrame) -> DataFrame:
    """Plans (plan_uid, target_doses, group_fractions, descriptions): the largest target dose, fractions in sum, and what follows PTV
    (itself included) in the first description that has it."""
    named = F.filter(F.transform("descriptions", t.normal_name), lambda d: F.contains(d, F.lit("PTV")))
    return plans.select("plan_uid", F.coalesce(F.array_max("target_doses"), F.lit(0.0)).alias("rx_gy"), F.aggregate("group_fractions", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("fractions"), F.coalesce(F.regexp_extract(F.try_element_at(named, F.lit(1)), "PTV.*", 0), F.lit("")).alias("target_norm"))


def required_structures(goals: DataFrame, structures: DataFrame) -> DataFrame:
    """P10: listable structures that own goals in a set."""
    return structures.join(goals.select(P, t.normal_name(F.col("structure")).alias("name_norm")).distinct(), [P, "name_norm"], "left_semi").select(P, "name_norm").distinct()


def assembled(slices: DataFrame, default_step: float) -> DataFrame:
    """Slices (patient_id, position, slope, intercept, raw) in order of position: index, step (the median distance, absolute)
    and values scaled."""
    o = Window.partitionBy(P).orderBy("position")
    x = slices.withColumn("k", F.row_number().over(o) - 1).withColumn("gap", F.col("position") - F.lag("position").over(o))
    step = x.groupBy(P).agg(F.abs(F.percentile("gap", 0.5)).alias("step"))
    return x.join(step, P).select(P, "k", "position", F.coalesce("step", F.lit(float(default_step))).alias("step"), (F.col("raw") * F.col("slope") + F.col("intercept")).alias("value"))


def boxes(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*S).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c_lo").alias("c0"), F.max(F.col("c_hi") - 1).alias("c1"))
