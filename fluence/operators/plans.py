"""Plan phases and structure names: filters, orders, prescriptions, target assignment and reference doses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

P = "patient_id"


def named(structures: DataFrame) -> DataFrame:
    """Structures (patient_id, ordinal, name) with name_norm, rx_gy and whether the name is a target's."""
    n = t.normal_name(F.col("name"))
    return structures.withColumn("name_norm", n).withColumn("rx_gy", t.ptv_rx(F.col("name"))).withColumn("target_like", F.regexp_like(n, F.lit("^(PTV|GTV|CTV)")))


def listable(structures: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Names that are shown: none that begin with Z or hold COUCH, RAIL or BB, none that a reviewer hid (patient_id, name_norm)."""
    out = structures.filter(~F.regexp_like("name_norm", F.lit("^Z|COUCH|RAIL|BB")))
    return out.join(hidden, [P, "name_norm"], "left_anti") if hidden is not None else out


def mask_candidates(structures: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Targets, extra targets (patient_id, name_norm), and brain structures without brainstem; the first of each name."""
    n = F.col("name_norm")
    own = F.col("target_like") | (n.startswith("BRAIN") & ~F.contains(n, F.lit("BRAINSTEM")))
    if extra is not None:
        marked = structures.join(extra.withColumn("extra", F.lit(True)), [P, "name_norm"], "left")
        structures, own = marked, own | F.coalesce("extra", F.lit(False))
    return structures.filter(own).groupBy(P, "name_norm").agg(F.min("ordinal").alias("ordinal"))


def brain(structures: DataFrame) -> DataFrame:
    """The structure that counts as brain: BRAIN itself (the first), else the last BRAIN* without BRAINSTEM."""
    n = F.col("name_norm")
    exact = n == "BRAIN"
    rank = F.struct(exact.cast("int").alias("a"), F.when(exact, -F.col("ordinal")).otherwise(F.col("ordinal")).alias("b"))
    return structures.filter(n.startswith("BRAIN") & ~F.contains(n, F.lit("BRAINSTEM"))).groupBy(P).agg(F.max_by("name_norm", rank).alias("brain"), F.max_by("ordinal", rank).alias("ordinal"))


def dose_levels(structures: DataFrame) -> DataFrame:
    """Distinct PTV doses, rising, and the lowest."""
    return structures.filter("rx_gy is not null").groupBy(P).agg(F.array_sort(F.collect_set("rx_gy")).alias("levels"), F.min("rx_gy").alias("lowest"))


def available(phases: DataFrame) -> DataFrame:
    """Phases with a prescription and a dose grid."""
    return phases.filter((F.col("rx_gy") > 0) & (F.coalesce("dose_grid_id", F.lit("")) != ""))


def isodose_levels(texts: DataFrame) -> DataFrame:
    """Levels parsed from (patient_id, place, level_text): positive, at three decimals the first of equal ones."""
    v = F.trim("level_text").try_cast("double")
    return texts.withColumn("level", v).filter("level > 0").withColumn("at", F.round("level", 3)).groupBy(P, "at").agg(F.min_by("level", "place").alias("level"), F.min("place").alias("place")).drop("at")


def default_isodoses(phases: DataFrame, levels: DataFrame, slots: int = 6) -> DataFrame:
    """The total prescription, then PTV levels falling, without any within 0.05 of one that is kept; at most `slots`."""
    total = available(phases).groupBy(P).agg(F.sum("rx_gy").alias("total"))
    both = total.join(levels, P, "full_outer")
    wanted = F.concat(F.when(F.col("total") > 0, F.array("total")).otherwise(F.array().cast("array<double>")), F.reverse(F.coalesce("levels", F.array().cast("array<double>"))))
    kept = F.aggregate(wanted, F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(x - y) <= 0.05), acc).otherwise(F.array_append(acc, x)))
    return both.select(P, F.slice(kept, 1, slots).alias("levels"))


def total_rx(phases: DataFrame, references: DataFrame) -> DataFrame:
    """The sum over available phases, else the highest reference dose of the patient's targets (patient_id, reference_gy)."""
    a = available(phases).groupBy(P).agg(F.sum("rx_gy").alias("s"))
    b = references.groupBy(P).agg(F.max("reference_gy").alias("m"))
    return a.join(b, P, "full_outer").select(P, F.coalesce("s", "m").alias("total_rx_gy"))


def wash_floor(phases: DataFrame, levels: DataFrame) -> DataFrame:
    """0.95 of the lowest PTV level, else of the lowest prescription, else 0."""
    low = phases.groupBy(P).agg(F.min(F.when(F.col("rx_gy") > 0, F.col("rx_gy"))).alias("rx"))
    return low.join(levels.select(P, "lowest"), P, "full_outer").select(P, (0.95 * F.coalesce("lowest", "rx", F.lit(0.0))).alias("floor_gy"))


def sorted_targets(structures: DataFrame) -> DataFrame:
    """O1: PTVs by dose, those without one last, then by name; place from 1."""
    w = Window.partitionBy(P).orderBy(F.col("rx_gy").asc_nulls_last(), "name_norm", "ordinal")
    return structures.filter(F.col("name_norm").startswith("PTV")).withColumn("place", F.row_number().over(w))


def display_order(structures: DataFrame, sheet: DataFrame) -> DataFrame:
    """O2: PTVs first, then the order of the constraint sheet (patient_id, name_norm, sheet_no), then the original order."""
    w = Window.partitionBy(P).orderBy(F.when(F.col("name_norm").startswith("PTV"), 0).otherwise(1), F.coalesce("sheet_no", F.lit(1_000_000)), "ordinal")
    return structures.join(sheet, [P, "name_norm"], "left").withColumn("place", F.row_number().over(w))


def nested_keys() -> list[Column]:
    """O3's order: PTV, GTV, CTV, others; then dose; then name."""
    n = F.col("name_norm")
    rank = F.when(n.startswith("PTV"), 0).when(n.startswith("GTV"), 1).when(n.startswith("CTV"), 2).otherwise(3)
    return [rank, F.col("rx_gy").asc_nulls_last(), n]


def nested_order(structures: DataFrame) -> DataFrame:
    """O3: PTV, GTV, CTV, others; then dose; then name."""
    return structures.withColumn("place", F.row_number().over(Window.partitionBy(P).orderBy(*nested_keys(), "ordinal")))


def fractionation(phases: DataFrame) -> DataFrame:
    """Doses a fraction in encounter order, without any within 0.01 of an earlier one; and distinct fraction counts, in order."""
    p = phases.withColumn("dpf", F.when((F.col("rx_gy") > 0) & (F.col("fractions") > 0), F.col("rx_gy") / F.col("fractions")))
    lists = p.groupBy(P).agg(F.array_sort(F.collect_list(F.struct("plan_uid", "dpf", "fractions"))).alias("x"))
    dpf = F.filter(F.col("x.dpf"), lambda v: v.isNotNull())
    near = F.aggregate(dpf, F.array().cast("array<double>"), lambda acc, v: F.when(F.exists(acc, lambda y: F.abs(y - v) <= 0.01), acc).otherwise(F.array_append(acc, v)))
    return lists.select(P, near.alias("dose_per_fraction"), F.array_distinct(F.filter(F.col("x.fractions"), lambda v: v > 0)).alias("fraction_counts"))


def plan_summary(phases: DataFrame) -> DataFrame:
    """Prescriptions and fractions in sum, dose a fraction, phases."""
    s = phases.groupBy(P).agg(F.sum(F.when(F.col("rx_gy") > 0, F.col("rx_gy")).otherwise(0.0)).alias("rx_gy"), F.sum(F.when(F.col("fractions") > 0, F.col("fractions")).otherwise(0)).alias("fractions"), F.count("*").alias("phases"), F.min_by("label", "plan_uid").alias("label"))
    return s.withColumn("gy_per_fraction", F.when(F.col("fractions") > 0, F.col("rx_gy") / F.col("fractions")))


def chosen_block(blocks: DataFrame, fractions: DataFrame) -> DataFrame:
    """Each patient's constraint block (patient_id, block_no, label): a single one; else the one whose dose a fraction or
    fraction count is nearest (within 0.05, judged by the first plan value within it); else the last marked NA; else the first."""
    b = blocks.withColumn("l", t.block_label(F.col("label"))).join(fractions, P, "left")
    values = F.when(F.col("l.kind") == "dose_per_fraction", F.col("dose_per_fraction")).when(F.col("l.kind") == "fraction_count", F.col("fraction_counts").cast("array<double>"))
    gaps = F.filter(F.transform(values, lambda v: F.abs(v - F.col("l.value"))), lambda g: g <= 0.05)
    b = b.withColumn("gap", F.try_element_at(gaps, F.lit(1))).withColumn("n", F.count("*").over(Window.partitionBy(P)))
    rank = F.when(F.col("n") == 1, 0).when(F.col("gap").isNotNull(), 1).when(F.col("l.kind") == "na", 2).otherwise(3)
    key = F.struct(rank.alias("rank"), F.coalesce("gap", F.lit(0.0)).alias("gap"), F.when(rank == 2, -F.col("block_no")).otherwise(F.col("block_no")).alias("no"))
    return b.groupBy(P).agg(F.min_by(F.struct("block_no", "label"), key).alias("x")).select(P, "x.*")


def assigned_phases(targets: DataFrame, phases: DataFrame) -> DataFrame:
    """(patient_id, name_norm, plan_uid, phase_rx_gy). targets are sorted PTVs (O1).

    One available phase: the PTV of its name, else the nearest dose within 0.5 Gy. Several: PTVs by rising dose take the
    unused phase nearest to their dose beyond the last one's, ties by name then label; a gap over 0.5 Gy needs the name."""
    pt = targets.groupBy(P).agg(F.array_sort(F.collect_list(F.struct("place", "name_norm", "rx_gy"))).alias("ptv"))
    ph = available(phases).groupBy(P).agg(F.array_sort(F.collect_list(F.struct("plan_uid", "rx_gy", "target_norm", "label"))).alias("ph"))
    kind = "array<struct<name_norm:string,plan_uid:string,phase_rx_gy:double>>"
    both = pt.join(ph, P)
    only = F.element_at("ph", 1)
    exact = F.try_element_at(F.filter("ptv", lambda x: x["name_norm"] == only["target_norm"]), F.lit(1))
    nearest = F.array_min(F.transform(F.filter("ptv", lambda x: x["rx_gy"].isNotNull()), lambda x: F.struct(F.abs(x["rx_gy"] - only["rx_gy"]).alias("gap"), x["name_norm"].alias("name_norm"))))
    name = F.coalesce(exact["name_norm"], F.when(nearest["gap"] <= 0.5, nearest["name_norm"]))
    single = F.when(name.isNotNull(), F.array(F.struct(name.alias("name_norm"), only["plan_uid"].alias("plan_uid"), only["rx_gy"].alias("phase_rx_gy")))).otherwise(F.array().cast(kind))

    def walk(acc, x):
        more = F.greatest(x["rx_gy"] - acc["level"], F.lit(0.0))
        free = F.filter("ph", lambda p: ~F.array_contains(acc["used"], p["plan_uid"]))
        best = F.array_min(F.transform(free, lambda p: F.struct(F.abs(p["rx_gy"] - more).alias("gap"), F.when(p["target_norm"] == x["name_norm"], 0).otherwise(1).alias("other"), p["label"].alias("label"), p["plan_uid"].alias("plan_uid"))))
        take = (more > 0) & best.isNotNull() & ((best["gap"] <= 0.5) | (best["other"] == 0))
        stop = (more > 0) & best.isNull()
        # once no phase is left, the walk is over and the level stays
        return F.struct(
            F.when(stop, acc["level"]).otherwise(x["rx_gy"]).alias("level"),
            F.when(take, F.array_append(acc["used"], best["plan_uid"])).otherwise(acc["used"]).alias("used"),
            F.when(take, F.array_append(acc["out"], F.struct(x["name_norm"].alias("name_norm"), best["plan_uid"].alias("plan_uid"), more.alias("phase_rx_gy")))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0.0).alias("level"), F.array().cast("array<string>").alias("used"), F.array().cast(kind).alias("out"))
    several = F.aggregate(F.filter("ptv", lambda x: x["rx_gy"].isNotNull()), start, walk, lambda acc: acc["out"])
    got = both.select(P, F.explode(F.when(F.size("ph") == 1, single).otherwise(several)).alias("a")).select(P, "a.*")
    return got


def inferred_srs(targets: DataFrame, levels: tuple = (18.0, 21.0, 24.0)) -> DataFrame:
    """T5: targets (KEYS, min_gy) with the level nearest to the smallest dose, the first on a tie."""
    near = F.array_min(F.transform(F.array(*(F.lit(x) for x in levels)), lambda x: F.struct(F.abs(F.col("min_gy") - x).alias("gap"), x.alias("level"))))
    return targets.withColumn("srs_rx_gy", near["level"])


def default_reference(targets: DataFrame, phases: DataFrame, assigned: DataFrame, stereotactic: Column, inferred: DataFrame) -> DataFrame:
    """T4: the dose that a target's metrics refer to: its phase's; digits of 100 and more in hundredths; for stereotactic sets the
    inferred level (one fraction) or the phases' sum (several fractions); else the only phase's or the phases' sum."""
    ph = available(phases).groupBy(P).agg(F.count("*").alias("n_ph"), F.sum("rx_gy").alias("sum_rx"), F.array_distinct(F.filter(F.collect_list("fractions"), lambda v: v > 0)).alias("fx"))
    x = targets.join(ph, P, "left").join(assigned.select(P, "name_norm", "phase_rx_gy"), [P, "name_norm"], "left").join(inferred.select(P, "name_norm", "srs_rx_gy"), [P, "name_norm"], "left")
    raw = F.regexp_replace("name_norm", "[^0-9]", "").try_cast("double")
    one = stereotactic & (F.coalesce("n_ph", F.lit(0)) > 0) & (F.size("fx") == 1) & (F.element_at("fx", 1) == 1)
    many = stereotactic & (F.coalesce("n_ph", F.lit(0)) > 0) & (F.size("fx") == 1) & (F.element_at("fx", 1) > 1)
    ptv = F.col("name_norm").startswith("PTV")
    unclear = ptv & (raw.isNull() | (raw < 100))
    value = (
        F.when(F.col("phase_rx_gy") > 0, F.col("phase_rx_gy"))
        .when(raw >= 100, raw / 100)
        .when(unclear & one & F.col("srs_rx_gy").isNotNull(), F.col("srs_rx_gy"))
        .when(unclear & many, F.col("sum_rx"))
        .when(stereotactic & F.col("srs_rx_gy").isNotNull(), F.col("srs_rx_gy"))
        .otherwise(F.col("sum_rx"))
    )
    return x.select(*targets.columns, F.round(value, 2).alias("reference_gy"))


def set_flags(sets: DataFrame) -> DataFrame:
    """Of constraint sets (set_id) whether they are stereotactic ones, and whether they are for the prostate."""
    n = t.normal_name(F.coalesce("set_id", F.lit("")))
    return sets.withColumn("stereotactic", n == "SRS FSRT").withColumn("prostate", F.contains(n, F.lit("PROSTATE")))


def typed_dose(text: Column) -> Column:
    """A typed reference dose where it is a positive number, else null."""
    v = F.trim(text).try_cast("double")
    return F.when(v > 0, v)


def referred(targets: DataFrame, phases: DataFrame, assigned: DataFrame, typed: DataFrame, sampled: DataFrame) -> DataFrame:
    """Targets (patient_id, name_norm, rx_gy) with reference_gy and source.

    The reference is what a reviewer typed (patient_id, name_norm, dose_text), else the assigned phase's dose, else the dose in
    the name, else 0. The source is the assigned phase's grid, else the combined dose; where that is there (sampled: patient_id,
    name_norm, covered) but gives the target no values, the only available phase's grid."""
    grids = phases.select(P, "plan_uid", "dose_grid_id")
    own = assigned.join(grids, [P, "plan_uid"]).groupBy(P, "name_norm").agg(F.max("phase_rx_gy").alias("phase_rx_gy"), F.max("dose_grid_id").alias("own"))
    only = available(phases).groupBy(P).agg(F.count("*").alias("n"), F.min("dose_grid_id").alias("grid")).filter("n = 1").select(P, F.col("grid").alias("only"))
    over = typed.select(P, "name_norm", typed_dose(F.col("dose_text")).alias("typed_gy"))
    x = targets.join(own, [P, "name_norm"], "left").join(over, [P, "name_norm"], "left").join(only, P, "left").join(sampled, [P, "name_norm"], "left")
    reference = F.coalesce("typed_gy", "phase_rx_gy", "rx_gy", F.lit(0.0))
    fall_back = (reference > 0) & ~F.coalesce("covered", F.lit(True))
    return x.select(P, "name_norm", reference.alias("reference_gy"), F.coalesce("own", F.when(fall_back, F.col("only")), F.lit("combined")).alias("source"))
