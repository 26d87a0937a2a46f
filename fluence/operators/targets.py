"""Targets: metrics, nesting, competitors, fraction counts, rows of the target table and of the review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..shipping import merged
from . import dvh
from .plans import available, nested_keys

P = "patient_id"
K = dvh.KEYS


def measured(of: DataFrame, width: float = dvh.WIDTH) -> DataFrame:
    """T7 on rows of dvh.curves that have a reference_gy: the volume in % that gets the reference dose, with smallest and largest dose."""
    asked = F.when(F.col("reference_gy") > 0, F.col("reference_gy"))
    return of.withColumn("coverage_pct", dvh.v_at(asked, width)["v_pct"]).select(*K, "reference_gy", "min_gy", "max_gy", "coverage_pct")


def metrics(targets: DataFrame, of: DataFrame, width: float = dvh.WIDTH) -> DataFrame:
    """Targets (KEYS, reference_gy) by their curves (dvh.curves); null where a target has none."""
    return measured(targets.select(*K, "reference_gy").join(of, K, "left"), width)


def nested(containment: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each contained structure's parent: the smallest that contains it, then the smallest id. containment (patient_id, part, whole)."""
    s = sizes.select(P, F.col("structure_id").alias("whole"), "voxels")
    return containment.join(s, [P, "whole"]).groupBy(P, "part").agg(F.min_by("whole", F.struct("voxels", "whole")).alias("parent"))


def nested_rows(structures: DataFrame, targets: DataFrame, containment: DataFrame, sizes: DataFrame) -> DataFrame:
    """T9 with manual sub-volumes: under each target (targets: S) what it holds, in O3's order, as (patient_id, target, part, place).

    structures (patient_id, structure_id, name_norm, rx_gy, listable, nested, manual): a listable structure that is target-like
    (nested) stands under every target that holds it; a manual one only under the smallest of them, ties by name and id.
    containment (patient_id, part, whole), sizes (patient_id, structure_id, voxels). Structures of the target's own name and
    targets without anything held have no row; null flags are false."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    whole = targets.select(P, F.col("structure_id").alias("whole")).distinct().join(structures.select(P, F.col("structure_id").alias("whole"), F.col("name_norm").alias("whole_name")), [P, "whole"])
    whole = whole.join(sizes.select(P, F.col("structure_id").alias("whole"), "voxels"), [P, "whole"])
    part = structures.filter(yes("listable") & (yes("nested") | yes("manual"))).select(P, F.col("structure_id").alias("part"), "name_norm", "rx_gy", yes("manual").alias("manual"))
    held = containment.select(P, "part", "whole").join(whole, [P, "whole"]).join(part, [P, "part"]).filter("name_norm <> whole_name")
    best = F.row_number().over(Window.partitionBy(P, "part").orderBy("voxels", "whole_name", "whole"))
    held = held.withColumn("no", best).filter("not manual or no = 1")
    return held.withColumn("place", F.row_number().over(Window.partitionBy(P, "whole").orderBy(*nested_keys(), "part"))).select(P, F.col("whole").alias("target"), "part", "name_norm", "place")


def competing(targets: DataFrame, containment: DataFrame) -> DataFrame:
    """For each target all targets of the patient except those nested with it, itself included."""
    pairs = targets.select(P, F.col("structure_id").alias("target")).join(targets.select(P, F.col("structure_id").alias("rival")), P)
    both = containment.select(P, F.col("part").alias("target"), F.col("whole").alias("rival")).unionByName(containment.select(P, F.col("whole").alias("target"), F.col("part").alias("rival")))
    return pairs.join(merged(both.filter("target <> rival")), [P, "target", "rival"], "left_anti")


def fraction_counts(targets: DataFrame, phases: DataFrame, assigned: DataFrame) -> DataFrame:
    """The assigned phase's fractions, else the count that all available phases share, else 0."""
    per = available(phases).groupBy(P).agg(F.array_distinct(F.filter(F.collect_list("fractions"), lambda v: v > 0)).alias("fx"))
    own = assigned.join(phases.select(P, "plan_uid", "fractions"), [P, "plan_uid"]).select(P, "name_norm", "fractions")
    x = targets.join(own, [P, "name_norm"], "left").join(per, P, "left")
    return x.select(*targets.columns, F.coalesce("fractions", F.when(F.size("fx") == 1, F.element_at("fx", 1)), F.lit(0)).alias("fraction_count"))


def table_rows(measured: DataFrame) -> DataFrame:
    """Numbers as the target table shows them: doses in % of the reference, coverage with its dose, or only the dose."""
    ref = F.when(F.col("reference_gy") > 0, F.format_string("%.2f", "reference_gy")).otherwise("")
    known = F.col("min_gy").isNotNull() & F.col("max_gy").isNotNull() & F.col("coverage_pct").isNotNull()
    cover = F.when(known, F.concat(F.format_string("%.1f%% @ ", "coverage_pct"), ref, F.lit(" Gy"))).when(F.col("reference_gy") > 0, F.concat(F.lit("@ "), ref, F.lit(" Gy"))).otherwise("")
    show = lambda c: F.when(known, t.relative_dose_text(F.col(c), F.col("reference_gy"))).otherwise("")
    return measured.select(*K, ref.alias("reference_text"), cover.alias("coverage_text"), show("min_gy").alias("minimum_text"), show("max_gy").alias("maximum_text"))


def need_recompute(rows: DataFrame, stereotactic: Column) -> DataFrame:
    """Patients with a primary row that lacks coverage, minimum or maximum (or notes where the set is stereotactic)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lack = blank("coverage_text") | F.startswith("coverage_text", F.lit("@")) | blank("minimum_text") | blank("maximum_text") | (stereotactic & blank("notes_text"))
    return rows.groupBy(P).agg(F.max(lack.cast("int")).alias("x")).select(P, (F.col("x") == 1).alias("recompute"))


def review_list(structures: DataFrame, tissue: DataFrame, top: DataFrame) -> DataFrame:
    """PTVs in order, then rows for the hottest tissue and the largest dose where they are known, then the other structures."""
    s = structures.select(P, F.when(F.col("name_norm").startswith("PTV"), 0).otherwise(3).alias("rank"), F.col("place").alias("no"), F.col("name_norm").alias("shown"))
    a = tissue.filter("dose_gy is not null").select(P, F.lit(1).alias("rank"), F.lit(0).alias("no"), F.lit("Max Tissue").alias("shown"))
    b = top.filter("dose_gy is not null").select(P, F.lit(2).alias("rank"), F.lit(0).alias("no"), F.lit("Max Dose").alias("shown"))
    every = s.unionByName(a).unionByName(b)
    return every.withColumn("row", F.row_number().over(Window.partitionBy(P).orderBy("rank", "no", "shown"))).select(P, "row", "shown")


def volume_lines(geometry: DataFrame, totals: DataFrame) -> DataFrame:
    """A structure's volume: from its geometry, else from its curve."""
    both = totals.select(*K, F.col("volume_cc").alias("curve_cc")).join(geometry.select(*K, F.col("volume_cc").alias("geometry_cc")), K, "full_outer")
    return both.select(*K, F.coalesce("geometry_cc", "curve_cc").alias("volume_cc"))


def focus(targets: DataFrame, assigned: DataFrame) -> DataFrame:
    """The structure shown first: the last target that has a phase, else the last target. targets are sorted (place)."""
    x = targets.join(assigned.select(P, "name_norm", F.lit(1).alias("has")), [P, "name_norm"], "left")
    return x.groupBy(P).agg(F.max_by("name_norm", F.struct(F.coalesce("has", F.lit(0)), "place")).alias("focus"))


def saved_notes(computed: DataFrame, typed: DataFrame) -> DataFrame:
    """What a reviewer added to computed notes (patient_id, note_key, note_text): a leading computed note is cut off."""
    x = typed.join(computed.withColumnRenamed("note_text", "made"), [P, "note_key"], "left")
    made = F.trim(F.coalesce("made", F.lit("")))
    own = F.trim("note_text")
    cut = F.when((made != "") & F.startswith(own, made), F.trim(F.expr("substring(trim(note_text), length(trim(coalesce(made, ''))) + 1)"))).otherwise(own)
    return x.select(P, "note_key", cut.alias("note_text")).filter("note_text <> ''")


def coverage_lines(targets: DataFrame, saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """A line for each target (patient_id, name_norm, rx_gy, phase_rx_gy): its saved coverage text; else the fresh volume in %
    (patient_id, name_norm, coverage_pct) at its phase's dose, or at the dose in its name. Targets without either dose have none."""
    x = targets.join(saved.select(P, "name_norm", "coverage_text"), [P, "name_norm"], "left").join(fresh, [P, "name_norm"], "left")
    dose = F.coalesce("phase_rx_gy", "rx_gy")
    made = F.when(F.col("rx_gy").isNotNull() & F.col("coverage_pct").isNotNull(), F.concat(F.format_string("%.1f%% @ %.2f", "coverage_pct", dose), F.lit(" Gy")))
    text = F.coalesce(F.when(F.trim("coverage_text") != "", F.trim("coverage_text")), made)
    return x.filter(text.isNotNull()).select(P, "name_norm", F.concat(F.lit("Coverage "), text).alias("line"))


def with_parents(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Target rows (patient_id, structure_id, reference_gy); a nested one (parents: patient_id, part, parent) takes its
    parent's reference, a nested one without a parent among the rows none."""
    up = parents.select(P, F.col("part").alias("structure_id"), "parent")
    theirs = rows.select(P, F.col("structure_id").alias("parent"), F.col("reference_gy").alias("parent_gy"))
    x = rows.join(up, [P, "structure_id"], "left").join(theirs, [P, "parent"], "left")
    return x.select(P, "structure_id", "parent", F.when(F.col("parent").isNull(), F.col("reference_gy")).otherwise(F.col("parent_gy")).alias("reference_gy"))


def presentation_rows(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Target rows (patient_id, structure_id, name, parent, and the texts of table_rows, notes_text) as a table and its
    report show them: note_key, note_title, note_text, is_primary.

    A row without a parent is a primary one. notes (patient_id, note_key, note_text) are a reviewer's; of several for one key the
    smallest counts. Null texts are blank, rows without a note have the computed one; further columns stay, but for those named
    like the new ones or stored_text."""
    rows = rows.drop("note_key", "note_title", "note_text", "is_primary", "stored_text")
    primary = F.col("parent").isNull()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    stored = notes.groupBy(P, "note_key").agg(F.min("note_text").alias("stored_text"))
    title = F.when(primary, F.concat("name", F.lit(" target review"))).otherwise(F.concat("name", F.lit(" within "), "parent", F.lit(" target review")))
    x = rows.withColumn("note_key", t.target_note_key(t.normal_name(F.col("name")), t.normal_name(F.col("parent")))).join(stored, [P, "note_key"], "left")
    texts = ("reference_text", "coverage_text", "minimum_text", "maximum_text")
    return x.select(
        *(c for c in rows.columns if c not in {"notes_text", *texts}), *(blank(c) for c in texts), "note_key", title.alias("note_title"),
        t.compose_notes(F.col("notes_text"), F.col("stored_text")).alias("note_text"), primary.alias("is_primary"),
    )
