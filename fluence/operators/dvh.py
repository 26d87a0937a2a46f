"""Dose-volume histograms from weighted samples, and what is read from them.

Samples are (patient_id, structure, dose_gy, weight_cc). A histogram is made in one pass over them; curves() holds a structure's
whole curve in one row (its falling steps as an array), from which every D and V value is read without another join or
shuffle; curve() lists a row for each bin edge. Bins are `width` wide from 0 to
the patient's largest dose; the last bin includes its right edge; doses outside are counted in the end bins, while
minimum, maximum and mean use the doses as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import stored_bytes

KEYS = ["patient_id", "structure"]
WIDTH = 0.05
TASK_BYTES = 4_000_000  # of input files for a task of by_patient: about 200,000 samples


def bin_count(max_dose: Column, width: float) -> Column:
    """A5."""
    w = max(width, 1e-6)
    return F.ceil(F.greatest(max_dose, F.lit(float(width))) / F.lit(w)).cast("int")


def bin_of(dose: Column, width: float) -> Column:
    """The bin of a dose on an axis without end; floor is corrected against both edges, as a quotient may fall on the wrong side."""
    w = F.lit(max(width, 1e-6))
    held = F.greatest(F.lit(0.0), dose)
    b = F.floor(held / w)
    return b - F.when(b * w > held, 1).otherwise(0) + F.when((b + 1) * w <= held, 1).otherwise(0)


def by_patient(rows: DataFrame) -> DataFrame:
    """rows dealt by patient to as many tasks as the session sets, or to one for each TASK_BYTES of their files where these are more, for
    steps that sort them: with a fixed number a task's memory grows as its rows do, and Spark would join small shuffled partitions to
    ones of 64 MB, which are many times larger once they are sorted and grouped."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-stored_bytes(rows) // TASK_BYTES)), "patient_id")


def histogram(samples: DataFrame, width: float = WIDTH, max_dose: DataFrame | None = None) -> DataFrame:
    """A1: sums by bin of the samples of positive weight; the axis ends at max_dose(patient_id, max_dose), or the patient's
    largest sample. One pass: a patient's samples meet, are summed by bins without end and find the end. They are dealt before they are
    summed: the sums of a scan's task, of which nearly every sample had its own, took memory by the size of its split."""
    good = F.col("weight_cc") > 0
    rows = by_patient(samples).groupBy(*KEYS, bin_of(F.col("dose_gy"), width).alias("at")).agg(
        F.sum(F.when(good, F.col("weight_cc"))).alias("hist_cc"),
        F.sum(F.when(good, F.col("dose_gy") * F.col("weight_cc"))).alias("dose_cc"),
        F.min(F.when(good, F.col("dose_gy"))).alias("min_gy"),
        F.max(F.when(good, F.col("dose_gy"))).alias("max_gy"),
        F.count(F.when(good, F.lit(1))).alias("n_samples"),
        F.max(F.when(~F.isnan("dose_gy"), F.col("dose_gy"))).alias("top"),
    )
    if max_dose is None:
        rows = rows.withColumn("max_dose", F.max("top").over(Window.partitionBy("patient_id")))
    else:
        rows = rows.join(max_dose, "patient_id")
    placed = rows.filter("n_samples > 0").withColumn("n_bins", bin_count(F.col("max_dose"), width))
    return placed.groupBy(*KEYS, "n_bins", F.least("at", F.col("n_bins") - 1).cast("int").alias("bin")).agg(
        F.sum("hist_cc").alias("hist_cc"),
        F.sum("dose_cc").alias("dose_cc"),
        F.min("min_gy").alias("min_gy"),
        F.max("max_gy").alias("max_gy"),
        F.sum("n_samples").alias("n_samples"),
    )


def summary(hist: DataFrame) -> DataFrame:
    """D1's scalars: volume, mean, minimum, maximum and samples for each curve."""
    return hist.groupBy(*KEYS).agg(
        F.sum("hist_cc").alias("volume_cc"),
        (F.sum("dose_cc") / F.sum("hist_cc")).alias("mean_gy"),
        F.min("min_gy").alias("min_gy"),
        F.max("max_gy").alias("max_gy"),
        F.sum("n_samples").alias("n_samples"),
        F.max("n_bins").alias("n_bins"),
    )


def curves(hist: DataFrame) -> DataFrame:
    """A row for each structure: the scalars of summary, and steps: the occupied bins, rising, each with the volume in it and above."""
    falling = Window.partitionBy(*KEYS).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumn("above", F.sum("hist_cc").over(falling))
    return rows.groupBy(*KEYS).agg(
        F.sum("hist_cc").alias("volume_cc"),
        (F.sum("dose_cc") / F.sum("hist_cc")).alias("mean_gy"),
        F.min("min_gy").alias("min_gy"),
        F.max("max_gy").alias("max_gy"),
        F.sum("n_samples").alias("n_samples"),
        F.max("n_bins").alias("n_bins"),
        F.array_sort(F.collect_list(F.struct("bin", F.col("above").alias("cc")))).alias("steps"),
    )


def curve(of: DataFrame, width: float = WIDTH) -> DataFrame:
    """A2: of curves(): a row for each edge with the volume that gets at least its dose, in cc and %, and a last point of
    volume 0. Edges of empty bins are there."""
    ends = F.concat("steps", F.array(F.struct(F.col("n_bins").alias("bin"), F.lit(0.0).alias("cc"))))
    # beside each step the edge after the one before it, so that no step looks for it in an array made again
    firsts = F.concat(F.array(F.lit(0)), F.transform("steps", lambda x: x["bin"] + 1))
    parts = F.zip_with(firsts, ends, lambda first, x: F.struct(first.alias("first"), x["bin"].alias("last"), x["cc"].alias("cc")))
    rows = of.select(*KEYS, F.col("volume_cc").alias("whole"), F.explode(parts).alias("p")).select(*KEYS, "whole", "p.cc", F.explode(F.sequence("p.first", "p.last")).alias("bin"))
    return rows.select(*KEYS, "bin", (F.col("bin") * F.lit(max(width, 1e-6))).alias("dose_gy"), F.col("cc").alias("volume_cc"), (F.col("cc") / F.col("whole") * 100).alias("volume_pct"))


def unweighted(samples: DataFrame, bins: int = 256) -> DataFrame:
    """A3 and A4: the cumulative curve of equal weights in `bins` bins up to the patient's largest dose (at least 0.001), in % of the count."""
    top = samples.groupBy("patient_id").agg(F.greatest(F.max("dose_gy"), F.lit(1e-3)).alias("top"))
    w = F.col("top") / bins
    b = F.floor(F.greatest(F.lit(0.0), F.least("dose_gy", "top")) / w)
    b = b - F.when(b * w > F.col("dose_gy"), 1).otherwise(0) + F.when((b + 1) * w <= F.col("dose_gy"), 1).otherwise(0)
    hist = by_patient(samples.select(*KEYS, "dose_gy")).join(top, "patient_id").withColumn("bin", F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")).groupBy(*KEYS, "bin").agg(F.count("*").alias("n"), F.max("top").alias("top"))
    falling = Window.partitionBy(*KEYS).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumn("above", F.sum("n").over(falling))
    of = rows.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.max("top").alias("top"), F.array_sort(F.collect_list(F.struct("bin", "above"))).alias("steps"))
    ends = F.concat("steps", F.array(F.struct(F.lit(bins - 1).alias("bin"), F.lit(0).cast("long").alias("above"))))
    parts = F.transform(ends, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at(ends, F.greatest(i, F.lit(1)))["bin"] + 1).alias("first"), x["bin"].alias("last"), x["above"].alias("above")))
    edges = of.select(*KEYS, "total", "top", F.explode(F.filter(parts, lambda p: p["first"] <= p["last"])).alias("p")).select(*KEYS, "total", "top", "p.above", F.explode(F.sequence("p.first", "p.last")).alias("bin"))
    return edges.select(*KEYS, "bin", (F.col("bin") * F.col("top") / bins).alias("dose_gy"), (F.col("above") / F.col("total") * 100).alias("volume_pct"))


def v_at(dose: Column, width: float = WIDTH) -> Column:
    """D7 on a row of curves(): (v_cc, v_pct) at a dose: linear between edges, the end values outside; null for no dose."""
    w = F.lit(max(width, 1e-6))
    held = F.greatest(F.lit(0.0), F.least(dose, F.col("n_bins") * w))
    above = lambda edge: F.aggregate("steps", F.lit(0.0), lambda acc, x: F.when(x["bin"] >= edge, F.greatest(acc, x["cc"])).otherwise(acc))
    # an array of one element names a value, which is then computed once and not again for every step
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def between(d, b, a0, a1):
        share = (d - b * w) / ((b + 1) * w - b * w)
        pct0, pct1 = a0 / F.col("volume_cc") * 100, a1 / F.col("volume_cc") * 100
        return F.struct((a0 + share * (a1 - a0)).alias("v_cc"), (pct0 + share * (pct1 - pct0)).alias("v_pct"))

    def at(d):
        place = F.struct(d.alias("d"), F.least(bin_of(d, width), F.col("n_bins") - 1).alias("b"))
        ends = lambda q: F.struct(q["d"].alias("d"), q["b"].alias("b"), above(q["b"]).alias("a0"), above(q["b"] + 1).alias("a1"))
        return once(place, lambda q: once(ends(q), lambda e: between(e["d"], e["b"], e["a0"], e["a1"])))

    return F.when(dose.isNotNull(), once(held, at))


def d_at(volume: Column, axis: str = "volume_pct", width: float = WIDTH) -> Column:
    """D8 (axis volume_pct) and D9 (axis volume_cc) on a row of curves(): the dose that a volume gets.

    0 or less gives the largest dose; the whole volume or more the smallest; else linear behind the last edge that still has it."""
    w, pct = F.lit(max(width, 1e-6)), axis == "volume_pct"
    value = (lambda x: x / F.col("volume_cc") * 100) if pct else (lambda x: x)
    t = F.greatest(F.lit(0.0), F.least(volume, F.lit(100.0) if pct else F.greatest("volume_cc", F.lit(0.0))))
    have = F.filter("steps", lambda x: value(x["cc"]) >= t)
    last, after = F.try_element_at(have, F.lit(-1)), F.try_element_at("steps", F.size(have) + 1)
    v0, v1 = value(last["cc"]), F.coalesce(value(after["cc"]), F.lit(0.0))
    at, before = (last["bin"] + 1) * w, last["bin"] * w
    inner = at + (t - v1) / (v0 - v1) * (before - at)
    return F.when(volume.isNull(), None).when(t <= 0, F.col("max_gy")).when(t >= value(F.element_at("steps", 1)["cc"]), F.col("min_gy")).otherwise(F.coalesce(inner, "max_gy"))


def volume_at_dose(of: DataFrame, asked: DataFrame, width: float = WIDTH) -> DataFrame:
    """asked(KEYS, dose) with v_cc and v_pct of curves()."""
    got = asked.join(of.select(*KEYS, "volume_cc", "n_bins", "steps"), KEYS).withColumn("v", v_at(F.col("dose"), width))
    return got.select(*asked.columns, "v.v_cc", "v.v_pct")


def dose_at_volume(of: DataFrame, asked: DataFrame, axis: str = "volume_pct", width: float = WIDTH) -> DataFrame:
    """asked(KEYS, volume) with dose_gy of curves()."""
    got = asked.join(of.select(*KEYS, "volume_cc", "min_gy", "max_gy", "steps"), KEYS)
    return got.select(*asked.columns, d_at(F.col("volume"), axis, width).alias("dose_gy"))


def truncated_end(least: float = 1e-6) -> Column:
    """W10 on a row of curves(): the first edge at or below `least` %, but the second at least."""
    shown = F.filter("steps", lambda x: x["cc"] / F.col("volume_cc") * 100 > least)
    return F.least(F.greatest(F.coalesce(F.try_element_at(shown, F.lit(-1))["bin"] + 1, F.lit(0)), F.lit(1)), F.col("n_bins"))


def truncated(of: DataFrame, width: float = WIDTH, least: float = 1e-6) -> DataFrame:
    """The edges of curves() up to the truncated end."""
    ends = of.select(*KEYS, truncated_end(least).alias("end"))
    return curve(of, width).join(ends, KEYS).filter("bin <= end").drop("end")


def largest_plotted(of: DataFrame, width: float = WIDTH) -> DataFrame:
    """For each patient the largest dose of its truncated curves, at least 1."""
    return of.groupBy("patient_id").agg(F.greatest(F.max(truncated_end() * F.lit(max(width, 1e-6))), F.lit(1.0)).alias("max_plotted_gy"))


def readout(of: DataFrame, asked: DataFrame, width: float = WIDTH) -> DataFrame:
    """V in % and cc of curves() at a dose that is held within the truncated curve."""
    end = truncated_end() * F.lit(max(width, 1e-6))
    got = asked.join(of, KEYS).withColumn("v", v_at(F.greatest(F.lit(0.0), F.least("dose", end)), width))
    return got.select(*KEYS, "dose", "v.v_cc", "v.v_pct")


def hottest_volume(samples: DataFrame, cc: Column | float) -> DataFrame:
    """The dose that the hottest `cc` get: doses falling, their volumes summed, linear between steps; the smallest dose beyond all volume."""
    hot = Window.partitionBy(*KEYS).orderBy(F.desc("dose_gy"))
    # equal doses are one step, which also bounds what one window partition sorts
    steps = samples.filter(F.col("weight_cc") > 0).groupBy(*KEYS, "dose_gy").agg(F.sum("weight_cc").alias("w"))
    run = steps.withColumn("sum", F.sum("w").over(hot.rowsBetween(Window.unboundedPreceding, 0))).withColumn("sum0", F.lag("sum").over(hot)).withColumn("d0", F.lag("dose_gy").over(hot))
    ask = cc if isinstance(cc, Column) else F.lit(float(cc))
    share = (ask - F.col("sum0")) / (F.col("sum") - F.col("sum0"))
    at = F.when(F.col("sum0").isNull(), F.col("dose_gy")).otherwise(F.col("d0") + share * (F.col("dose_gy") - F.col("d0")))
    return run.groupBy(*KEYS).agg(F.min_by(F.when(F.col("sum") >= ask, at), F.when(F.col("sum") >= ask, F.col("sum"))).alias("inner"), F.min("dose_gy").alias("least")).select(*KEYS, F.coalesce("inner", "least").alias("dose_gy"))


def markers(goals: DataFrame, totals: DataFrame) -> DataFrame:
    """Where a goal stands on the plot: a V goal at (dose, volume %), cc in % of the structure; a D goal at (value, %)."""
    g = goals.join(totals.select(*KEYS, "volume_cc"), KEYS)
    v = F.col("v_dose").isNotNull() & F.col("goal_value").isNotNull()
    d = (F.col("d_value").isNotNull()) & F.col("goal_value").isNotNull() & F.col("goal_unit").isin("", "GY")
    x = F.when(v, F.col("v_dose")).when(d, F.col("goal_value"))
    pct = F.when(F.col("volume_cc") > 0, 100 * F.col("goal_value") / F.col("volume_cc"))
    y = F.when(v & (F.col("goal_unit") == "%"), F.col("goal_value")).when(v, pct).when(d & (F.col("d_unit") == "%"), F.col("d_value")).when(d, F.when(F.col("volume_cc") > 0, 100 * F.col("d_value") / F.col("volume_cc")))
    return g.select(*KEYS, "goal_no", x.alias("x_gy"), y.alias("y_pct")).filter("x_gy is not null and y_pct is not null")


def volume_axis(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Points (KEYS, bin, volume_pct, volume_cc) with the volume in cc where a curve was saved without it: the share of its total."""
    t = totals.select(*KEYS, F.col("volume_cc").alias("whole"))
    return points.join(t, KEYS).withColumn("volume_cc", F.coalesce("volume_cc", F.col("volume_pct") * F.col("whole") / 100)).drop("whole")
