"""Constraint sheets and scripts as tables: cells (sheet, row, col, value, num, number_format) become blocks and goals; script
checks become goals and notes; file headers become a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

HEADERS = ["OAR", "METRIC", "GOAL", "VALUE"]


def blocks(cells: DataFrame) -> DataFrame:
    """(sheet, block_no, first_col, label): four neighbouring cells of row 1 that read OAR, METRIC, GOAL, VALUE in any case, taken
    from the left without overlap; the label stands above the first."""
    head = cells.filter("row = 1").select("sheet", "col", t.normal_name(F.coalesce("value", F.lit(""))).alias("h"))
    w = Window.partitionBy("sheet").orderBy("col")
    starts = head.filter(F.col("h") == HEADERS[0]).select("sheet", "col")
    for k in range(1, 4):
        starts = starts.join(head.filter(F.col("h") == HEADERS[k]).select("sheet", (F.col("col") - k).alias("col")), ["sheet", "col"], "left_semi")
    # equal headers cannot start within three columns of each other, as OAR would have to be METRIC, GOAL or VALUE
    label = cells.filter("row = 0").select("sheet", "col", F.trim(F.coalesce("value", F.lit(""))).alias("label"))
    return starts.join(label, ["sheet", "col"], "left").select("sheet", (F.row_number().over(w) - 1).alias("block_no"), F.col("col").alias("first_col"), F.coalesce("label", F.lit("")).alias("label"))


def block_rows(cells: DataFrame, found: DataFrame) -> DataFrame:
    """The body of each block, a row for each sheet row with any value: oar, metric, goal, value, num, number_format."""
    body = cells.filter("row >= 2").join(found, "sheet").filter((F.col("col") >= F.col("first_col")) & (F.col("col") < F.col("first_col") + 4)).withColumn("f", F.col("col") - F.col("first_col"))
    pick = lambda k, c: F.max(F.when(F.col("f") == k, F.col(c)))
    out = body.groupBy("sheet", "block_no", "row").agg(pick(0, "value").alias("oar"), pick(1, "value").alias("metric"), pick(2, "value").alias("goal"), pick(3, "value").alias("value"), pick(3, "num").alias("num"), pick(3, "number_format").alias("number_format"))
    return out.filter(F.coalesce(F.length(F.trim(F.concat_ws("", "oar", "metric", "goal", "value"))), F.lit(0)) > 0)


def structure_names(oar: Column) -> Column:
    """Names of a cell: cut at commas; X_L/R is X_L and X_R."""
    parts = F.filter(F.transform(F.split(oar, ","), lambda x: F.trim(x)), lambda x: x != "")
    side = "(?i)^(.+)_L/R$"
    return F.flatten(F.transform(parts, lambda x: F.when(F.regexp_like(x, F.lit(side)), F.transform(F.array(F.lit("_L"), F.lit("_R")), lambda s: F.concat(F.trim(F.regexp_extract(x, side, 1)), s))).otherwise(F.array(x))))


def goals(rows: DataFrame) -> DataFrame:
    """Goals of block rows: a row for each name; a number is written as a percentage if its format has % or its metric is a V
    metric and it lies in 0 to 1; rows without metric, comparator and value give no goal."""
    metric, comparator = F.trim(F.coalesce("metric", F.lit(""))), F.trim(F.coalesce("goal", F.lit("")))
    percent = F.contains(F.coalesce("number_format", F.lit("")), F.lit("%")) | (t.metric_key(metric).startswith("V") & F.col("num").between(0, 1))
    value = F.when(F.col("num").isNotNull(), F.when(percent, F.concat(t.number_text(F.col("num") * 100), F.lit("%"))).otherwise(t.number_text(F.col("num")))).otherwise(F.trim(F.coalesce("value", F.lit(""))))
    out = rows.select("sheet", "block_no", "row", metric.alias("metric"), comparator.alias("comparator"), value.alias("value_text"), F.posexplode(structure_names(F.coalesce("oar", F.lit("")))).alias("part", "structure"))
    out = out.withColumn("structure_norm", t.normal_name(F.col("structure")))
    return out.filter((F.col("structure_norm") != "") & (F.concat("metric", "comparator", "value_text") != ""))


def script_goals(checks: DataFrame) -> DataFrame:
    """Checks (patient_id, check_no, plan_name, template_name, first_clause, first_goal, second_clause, second_goal, result, comment)
    as goals with notes: two clauses each, PTVs left out, the plan's name before the template's, the first of equal goals."""
    name = t.normal_name(F.when(F.trim(F.coalesce("plan_name", F.lit(""))) != "", F.col("plan_name")).otherwise(F.col("template_name")))
    both = checks.withColumn("structure_norm", name).filter((F.col("structure_norm") != "") & ~F.col("structure_norm").startswith("PTV"))
    both = both.withColumn("x", F.explode(F.array(F.struct(F.lit(0).alias("no"), F.col("first_clause").alias("c"), F.col("first_goal").alias("g")), F.struct(F.lit(1).alias("no"), F.col("second_clause").alias("c"), F.col("second_goal").alias("g")))))
    both = both.withColumn("k", t.script_clause(F.col("x.c"))).withColumn("value_text", t.script_goal(F.col("x.g"))).filter("k.metric is not null and value_text <> ''")
    note = F.concat_ws("    ", F.when(F.trim(F.coalesce("result", F.lit(""))) != "", F.concat(F.lit("Eclipse: "), F.trim("result"))), F.when(F.trim(F.coalesce("comment", F.lit(""))) != "", F.concat(F.lit("Comment: "), F.trim("comment"))))
    rows = both.select("patient_id", "check_no", F.col("x.no").alias("clause_no"), "structure_norm", F.col("k.metric").alias("metric"), F.col("k.comparator").alias("comparator"), "value_text", note.alias("note"))
    first = F.row_number().over(Window.partitionBy("patient_id", "structure_norm", F.upper("metric"), "comparator", F.upper("value_text")).orderBy("check_no", "clause_no"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def person_name(name: Column) -> Column:
    """family^given^middle^prefix^suffix as prefix given middle family suffix."""
    p = F.transform(F.split(F.coalesce(name, F.lit("")), r"\^"), lambda x: F.trim(x))
    at = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    return F.array_join(F.filter(F.array(at(4), at(2), at(3), at(1), at(5)), lambda x: x != ""), " ")


def manifest(files: DataFrame) -> DataFrame:
    """For each patient the first structure set by path, the first script (a *_ctable.xml before others, then by name), and files by kind."""
    path = F.col("path")
    script = F.col("modality") == "XML"
    rank = F.struct(F.when(F.lower(path).endswith("_ctable.xml"), 0).otherwise(1).alias("a"), F.lower(path).alias("b"))
    return files.groupBy("patient_id").agg(
        F.min(F.when(F.col("modality") == "RTSTRUCT", path)).alias("structure_set"),
        F.min_by(F.when(script, path), F.when(script, rank)).alias("script"),
        *(F.sum((F.col("modality") == m).cast("int")).alias(f"n_{m.lower()}") for m in ("CT", "RTDOSE", "RTPLAN", "RTSTRUCT")),
    )


def signature(*columns: str) -> Column:
    """The first 16 hex digits of a SHA-256 over the columns' texts."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"), 256), 1, 16)


def stale(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Of (patient_id, path, size, mtime) whether a saved result may be used: the same files, each with a null-safe equal
    size and time; a saved null size or time is accepted."""
    both = current.join(saved.select("patient_id", "path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.lit(1).alias("old")), ["patient_id", "path"], "full_outer")
    same = F.col("size").isNotNull() & F.col("old").isNotNull() & (F.col("s").isNull() | (F.col("s") == F.col("size"))) & (F.col("m").isNull() | (F.col("m") == F.col("mtime")))
    return both.groupBy("patient_id").agg(F.min(F.coalesce(same, F.lit(False)).cast("int")).alias("x")).select("patient_id", (F.col("x") == 0).alias("recompute"))


def chosen_set(plans: DataFrame, available: DataFrame) -> DataFrame:
    """Plans (patient_id, wants_none, preferred, current) with the constraint set: none if asked for, the preferred one if it is there
    (patient_id, set_id, is_script), else the current one if it is there, else the script's, else none."""
    a = available.select("patient_id", "set_id")
    p = plans.join(a.select("patient_id", F.col("set_id").alias("preferred"), F.lit(1).alias("has_p")).distinct(), ["patient_id", "preferred"], "left")
    p = p.join(a.select("patient_id", F.col("set_id").alias("current"), F.lit(1).alias("has_c")).distinct(), ["patient_id", "current"], "left")
    s = available.filter("is_script").groupBy("patient_id").agg(F.min("set_id").alias("script"))
    pick = F.when(F.col("wants_none"), F.lit(None)).otherwise(F.coalesce(F.when(F.col("has_p") == 1, F.col("preferred")), F.when(F.col("has_c") == 1, F.col("current")), F.col("script")))
    return p.join(s, "patient_id", "left").select("patient_id", pick.alias("set_id"))
