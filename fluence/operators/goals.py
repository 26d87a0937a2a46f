"""Clinical goals: parsing, evaluation against curves, custom goals, notes and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import dvh

K = dvh.KEYS


def parsed(goals: DataFrame) -> DataFrame:
    """goals (patient_id, set_id, goal_no, structure, metric, comparator, value_text) with their normal names, keys and numbers."""
    key = t.metric_key(F.col("metric"))
    out = goals.withColumn("structure", t.normal_name(F.col("structure"))).withColumn("metric_key", key)
    out = out.withColumn("one", t.goal_value(F.col("value_text"))).withColumn("two", t.goal_range(F.col("value_text")))
    out = out.withColumn("use_two", F.col("one.value").isNull() & F.col("two.first").isNotNull())
    return (
        out.withColumn("goal_value", F.when(F.col("use_two"), F.col("two.first")).otherwise(F.col("one.value")))
        .withColumn("goal_unit", F.when(F.col("use_two"), F.col("two.unit")).otherwise(F.col("one.unit")))
        .withColumn("variation_limit", F.col("two.second"))
        .withColumn("v_dose", t.v_threshold(F.col("metric_key")))
        .withColumn("d", t.d_volume(F.col("metric_key")))
        .withColumn("d_value", F.col("d.value"))
        .withColumn("d_unit", F.col("d.unit"))
        .withColumn("comparator", F.trim("comparator"))
        .drop("one", "two", "use_two", "d")
    )


def verdict(actual: Column, goal: Column, limit: Column, comparator: Column) -> Column:
    """pass, variation, fail, or '' where it cannot be told. A range's second number is the limit of variation, inclusive."""
    low, high = comparator.isin("<", "<="), comparator.isin(">", ">=")
    primary = F.when(comparator == "<", actual < goal).when(comparator == "<=", actual <= goal).when(comparator == ">", actual > goal).when(comparator == ">=", actual >= goal)
    within = F.when(low, actual <= limit).when(high, actual >= limit)
    close = F.abs(actual - goal) <= 1e-8 + 1e-5 * F.abs(goal)
    return (
        F.when(actual.isNull() | goal.isNull(), "")
        .when(low | high, F.when(primary, "pass").when(limit.isNotNull() & within, "variation").otherwise("fail"))
        .when(comparator.isin("=", "=="), F.when(close, "pass").otherwise("fail"))
        .otherwise("")
    )


def measured(goals: DataFrame, of: DataFrame, width: float = dvh.WIDTH) -> DataFrame:
    """Parsed goals of structures that have a curve, with actual_value and actual_unit (J1 and the choice of metric): one
    join with dvh.curves, in whose rows every metric is read.

    A V goal in % is read in %, any other V goal in cc; D in cc is read as a share of the structure's volume."""
    g = goals.join(of.select(*K, "volume_cc", "mean_gy", "min_gy", "max_gy", "n_bins", "steps"), K)
    pct = F.when(F.col("d_unit") == "%", F.col("d_value")).when((F.col("d_unit") == "CC") & (F.col("volume_cc") > 0), 100 * F.col("d_value") / F.col("volume_cc"))
    g = g.withColumn("v", dvh.v_at(F.col("v_dose"), width)).withColumn("d_gy", dvh.d_at(pct, width=width))
    g = g.select("*", "v.v_cc", "v.v_pct").drop("v", "steps", "n_bins")
    m = F.col("metric_key")
    value = (
        F.when(m.isin("MEAN", "DMEAN"), F.col("mean_gy"))
        .when(m.isin("MAX", "DMAX"), F.col("max_gy"))
        .when(m.isin("MIN", "DMIN"), F.col("min_gy"))
        .when(F.col("v_dose").isNotNull(), F.when(F.col("goal_unit") == "%", F.col("v_pct")).otherwise(F.col("v_cc")))
        .otherwise(F.col("d_gy"))
    )
    unit = F.when(F.col("v_dose").isNotNull() & ~m.isin("MEAN", "DMEAN", "MAX", "DMAX", "MIN", "DMIN"), F.when(F.col("goal_unit") == "%", "%").otherwise("CC")).otherwise("GY")
    return g.withColumn("actual_value", value).withColumn("actual_unit", unit).drop("v_cc", "v_pct", "d_gy")


def evaluate(goals: DataFrame, of: DataFrame, width: float = dvh.WIDTH) -> DataFrame:
    """Every goal of a structure with a curve: actual value, unit and text, status, passed (null for variation)."""
    out = measured(parsed(goals), of, width)
    out = out.withColumn("status", verdict(F.col("actual_value"), F.col("goal_value"), F.col("variation_limit"), F.col("comparator")))
    return out.withColumn("passed", F.when(F.col("status") == "pass", True).when(F.col("status") == "fail", False)).withColumn("actual_text", t.metric_text(F.col("actual_value"), F.col("actual_unit")))


def with_reuse(selected: DataFrame, saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Of the selected structures, saved evaluations where a structure has any, fresh ones for the others."""
    chosen = saved.join(selected, K, "left_semi")
    missing = selected.join(saved.select(*K).distinct(), K, "left_anti")
    return chosen.unionByName(fresh.select(chosen.columns).join(missing, K, "left_semi"))


def goal_key(metric: Column, comparator: Column, value_text: Column) -> Column:
    return F.concat_ws("|", t.metric_key(metric), F.trim(comparator), F.upper(F.trim(value_text)))


def custom_goals(typed: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing goals, then what reviewers typed (patient_id, structure, metric, goal_text, typed_no) where it
    parses, names a structure and a metric, and is not in the structure's set already; of equal ones the first."""
    g = t.goal_input(F.col("goal_text"))
    new = typed.withColumn("g", g).filter("g.comparator is not null").filter((F.trim("structure") != "") & (F.trim("metric") != ""))
    new = new.select("patient_id", t.normal_name(F.col("structure")).alias("structure"), F.trim("metric").alias("metric"), F.col("g.comparator").alias("comparator"), F.col("g.value").alias("value_text"), "typed_no")
    new = new.withColumn("key", goal_key(F.col("metric"), F.col("comparator"), F.col("value_text")))
    first = new.groupBy(*K, "key").agg(F.min_by(F.struct("metric", "comparator", "value_text", "typed_no"), "typed_no").alias("x")).select(*K, "key", "x.*")
    old = existing.withColumn("structure", t.normal_name(F.col("structure"))).withColumn("key", goal_key(F.col("metric"), F.col("comparator"), F.col("value_text")))
    added = first.join(old.select(*K, "key"), [*K, "key"], "left_anti")
    return old.select(*K, "metric", "comparator", "value_text", F.col("goal_no").alias("no"), F.lit("sheet").alias("source")).unionByName(added.select(*K, "metric", "comparator", "value_text", F.col("typed_no").alias("no"), F.lit("custom").alias("source")))


def custom_only(sheet: DataFrame, custom: DataFrame) -> DataFrame:
    """Distinct keys of all goals, flagged where only the custom set has them."""
    key = goal_key(F.col("metric"), F.col("comparator"), F.col("value_text"))
    both = sheet.select(*K, key.alias("key"), F.lit(0).alias("c")).unionByName(custom.select(*K, key.alias("key"), F.lit(1).alias("c")))
    return both.groupBy(*K, "key").agg((F.min("c") == 1).alias("custom_only"))


def min_volume(goals: DataFrame, of: DataFrame, name: str, set_part: str, width: float = dvh.WIDTH) -> DataFrame:
    """For each patient's structure `name` in sets whose id contains `set_part`: the volume at which every upper V goal in % would
    hold, or n/a where a goal in cc is exceeded. Patients without a percent goal have no row unless n/a."""
    g = parsed(goals).filter((F.col("structure") == name) & F.contains(F.upper("set_id"), F.lit(set_part)) & F.col("v_dose").isNotNull() & F.col("comparator").isin("<", "<=", "=", "==") & F.col("goal_value").isNotNull())
    m = g.join(of.filter("volume_cc > 0").select(*K, "volume_cc", "n_bins", "steps"), K).withColumn("v_cc", dvh.v_at(F.col("v_dose"), width)["v_cc"])
    need = F.max(F.when((F.col("goal_unit") == "%") & (F.col("goal_value") > 0), F.col("v_cc") / (F.col("goal_value") / 100)))
    over = F.max(F.when(F.col("goal_unit") == "CC", (F.col("v_cc") > F.col("goal_value") + 1e-6).cast("int")))
    out = m.groupBy(*K).agg(need.alias("need"), F.coalesce(over, F.lit(0)).alias("over"))
    return out.filter("over = 1 or need > 0").select(*K, F.when(F.col("over") == 1, "Min volume n/a").otherwise(F.concat(F.lit("Min volume "), F.ceil(F.col("need") - 1e-9).cast("string"), F.lit(" cc"))).alias("note"))


def presented(evaluated: DataFrame, stored: DataFrame, bladder: DataFrame) -> DataFrame:
    """Report rows: the structure's name on its first goal only, goal and result texts, status, computed and stored note."""
    first = F.row_number().over(Window.partitionBy(*K).orderBy("goal_no"))
    rows = evaluated.withColumn("place", first).withColumn("note_key", t.note_key(F.col("structure"), F.col("metric"), F.col("comparator"), F.col("value_text")))
    rows = rows.join(stored.select("patient_id", "note_key", "note_text"), ["patient_id", "note_key"], "left").join(bladder.withColumnRenamed("note", "volume_note"), K, "left")
    computed = F.concat_ws("    ", F.when((F.col("status") == "variation") & F.col("variation_limit").isNotNull(), "Acceptable Variation"), F.when(F.col("place") == 1, F.col("volume_note")))
    goal = F.trim(F.concat_ws(" ", "comparator", F.trim("value_text")))
    return rows.select(
        *K,
        "place",
        F.when(F.col("place") == 1, F.col("structure")).otherwise("").alias("shown_name"),
        F.trim("metric").alias("metric"),
        goal.alias("goal_text"),
        "status",
        F.concat(F.trim("metric"), F.lit(" "), goal).alias("goal_line"),
        t.compose_notes(computed, F.col("note_text")).alias("note"),
    )


def merged_notes(script: DataFrame, user: DataFrame) -> DataFrame:
    """U4: notes of either origin by (patient_id, note_key); both are composed, the script's first."""
    both = script.select("patient_id", "note_key", F.col("note_text").alias("a")).join(user.select("patient_id", "note_key", F.col("note_text").alias("b")), ["patient_id", "note_key"], "full_outer")
    return both.select("patient_id", "note_key", t.compose_notes(F.col("a"), F.col("b")).alias("note_text"))


def to_recompute(selected: DataFrame, curves: DataFrame) -> DataFrame:
    """For each patient whether a curve is missing, and how many structures are then computed: all selected, or none."""
    have = curves.select(*K).distinct().withColumn("have", F.lit(1))
    per = selected.join(have, K, "left").groupBy("patient_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("have", F.lit(0))).alias("m"))
    return per.select("patient_id", (F.col("m") < F.col("n")).alias("recompute"), F.when(F.col("m") < F.col("n"), F.col("n")).otherwise(0).alias("n_compute"))
