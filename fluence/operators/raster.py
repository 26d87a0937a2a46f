"""Contours and masks. Contours are vertex rows (patient_id, structure_id, k, contour_no, i, r, c); masks are spans of columns
(c_lo to c_hi, exclusive) of a row, which keep a mask's size near its outline's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import kept, merged

S = ["patient_id", "structure_id"]
SLICE = [*S, "k"]
CONTOUR = [*SLICE, "contour_no"]


def edges(points: DataFrame) -> DataFrame:
    """Each vertex with the next one of its contour, the last with the first; contours of fewer than three points are left out."""
    w = Window.partitionBy(*CONTOUR)
    o = w.orderBy("i")
    first = F.first(F.struct("r", "c")).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct("r", "c")).over(o), first)
    return points.withColumn("n", F.count("*").over(w)).withColumn("x", nxt).filter("n >= 3").select(*CONTOUR, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("x.r").alias("r1"), F.col("x.c").alias("c1"))


def _level(e: DataFrame) -> DataFrame:
    """Without edges whose ends are in one row, nearly."""
    return e.filter(F.abs(F.col("r0") - F.col("r1")) > 1e-8 + 1e-5 * F.abs("r1"))


def mask_spans(points: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells whose centre is inside an odd number of the slice's contours, as spans of columns.

    An edge crosses the centre lines between its ends; crossings of a line are paired from the right; a contour whose count is
    odd, as its nearly level edges do not count, is closed at its left-most column."""
    left = F.greatest(F.floor(F.min("c0").over(Window.partitionBy(*CONTOUR))), F.lit(0)).cast("double")
    e = _level(edges(points).withColumn("left", left))
    low, high = F.greatest(F.floor(F.least("r0", "r1")), F.lit(0)), F.least(F.ceil(F.greatest("r0", "r1")), F.lit(rows - 1))
    at = e.filter(low <= high).withColumn("r", F.explode(F.sequence(low, high)))
    y = F.col("r") + 0.5
    at = at.filter((F.col("r0") > y) != (F.col("r1") > y)).select(*CONTOUR, "r", ((F.col("c1") - F.col("c0")) * (y - F.col("r0")) / (F.col("r1") - F.col("r0")) + F.col("c0")).alias("x"), "left")
    per = at.groupBy(*CONTOUR, "r").agg(F.collect_list("x").alias("x"), F.first("left").alias("left"))
    every = per.select(*SLICE, "r", F.explode(F.when(F.size("x") % 2 == 1, F.concat("x", F.array("left"))).otherwise(F.col("x"))).alias("x"))
    down = Window.partitionBy(*SLICE, "r").orderBy(F.desc("x"))
    pairs = every.withColumn("no", F.row_number().over(down)).withColumn("x0", F.lead("x").over(down)).filter("no % 2 = 1 and x0 is not null")
    cell = lambda v: F.greatest(F.lit(0), F.least(F.lit(cols), F.ceil(v - 0.5)))
    return pairs.select(*SLICE, "r", cell(F.col("x0")).alias("c_lo"), cell(F.col("x")).alias("c_hi")).filter("c_lo < c_hi")


def cells(spans: DataFrame) -> DataFrame:
    """Spans as cells (c)."""
    return spans.select(*SLICE, "r", F.explode(F.sequence(F.col("c_lo"), F.col("c_hi") - 1)).alias("c"))


def inside(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (SLICE, id, y, x), with whether the point is inside an odd number of its slice's contours. Edges are listed by the
    rows that they cross, so a point meets the edges of its row only."""
    e = _level(edges(points))
    e = e.withColumn("row", F.explode(F.sequence(F.floor(F.least("r0", "r1")), F.floor(F.greatest("r0", "r1")))))
    q = asked.withColumn("row", F.floor("y"))
    hit = q.join(e, [*SLICE, "row"]).filter(((F.col("r0") > F.col("y")) != (F.col("r1") > F.col("y"))) & (F.col("x") < (F.col("c1") - F.col("c0")) * (F.col("y") - F.col("r0")) / (F.col("r1") - F.col("r0")) + F.col("c0")))
    return asked.join(hit.groupBy(*SLICE, "id").agg(F.count("*").alias("n")), [*SLICE, "id"], "left").withColumn("inside", F.coalesce(F.col("n") % 2 == 1, F.lit(False))).drop("n")


def voxel_counts(spans: DataFrame) -> DataFrame:
    """A9."""
    return spans.groupBy(*S).agg(F.sum(F.col("c_hi") - F.col("c_lo")).alias("voxels"))


def by_row(spans: DataFrame, *more: Column) -> DataFrame:
    """A mask as one row for each of its rows: (SLICE, r, spans), with the spans of the rows before and after it (up, down; null without
    cells) and further aggregates."""
    rows = spans.groupBy(*SLICE, "r").agg(F.array_sort(F.collect_list(F.struct("c_lo", "c_hi"))).alias("spans"), *more)
    w = Window.partitionBy(*SLICE).orderBy("r")
    beside = lambda f, step: F.when(f("r").over(w) == F.col("r") + step, f("spans").over(w))
    return rows.withColumn("up", beside(F.lag, -1)).withColumn("down", beside(F.lead, 1))


def row_cells(rows: DataFrame, *columns: str) -> DataFrame:
    """G5 on rows of by_row: the cells (SLICE, r, c), whether all four neighbours in the slice are in the mask too, and further columns."""
    has = lambda name, c: F.coalesce(F.exists(name, lambda s: (s["c_lo"] <= c) & (c < s["c_hi"])), F.lit(False))
    m = rows.withColumn("c", F.explode(F.flatten(F.transform("spans", lambda s: F.sequence(s["c_lo"], s["c_hi"] - 1)))))
    c = F.col("c")
    return m.select(*SLICE, "r", "c", (has("spans", c - 1) & has("spans", c + 1) & has("up", c) & has("down", c)).alias("interior"), *columns)


def interior(spans: DataFrame) -> DataFrame:
    """A mask's cells, and whether all four neighbours in the slice are in it too; cells are only made at the end."""
    return row_cells(by_row(spans))


def row_crossings(points: DataFrame, sub: int) -> DataFrame:
    """Where the lines at (i + 0.5) / sub of every row cross the slice's contours: (SLICE, r, crossings), an array of x with sign. Of a line's
    crossings, from the right, every second sign is -1, so that a point is inside by the sum of the signs of the crossings
    right of it."""
    e = _level(edges(points))
    first = F.greatest(F.floor(F.least("r0", "r1") * sub) - 1, F.lit(0))
    at = e.withColumn("g", F.explode(F.sequence(first, F.greatest(first, F.floor(F.greatest("r0", "r1") * sub) + 1))))
    at = at.withColumn("r", F.floor(F.col("g") / sub)).withColumn("y", F.col("r") + (F.col("g") - F.col("r") * sub + 0.5) / sub)
    at = at.filter((F.col("r0") > F.col("y")) != (F.col("r1") > F.col("y")))
    x = (F.col("c1") - F.col("c0")) * (F.col("y") - F.col("r0")) / (F.col("r1") - F.col("r0")) + F.col("c0")
    at = at.select(*SLICE, "r", "g", x.alias("x"))
    no = F.row_number().over(Window.partitionBy(*SLICE, "r", "g").orderBy(F.desc("x")))
    signed = at.withColumn("sign", F.when(no % 2 == 1, 1).otherwise(-1))
    return signed.groupBy(*SLICE, "r").agg(F.collect_list(F.struct("x", "sign")).alias("crossings"))


def perimeter(spans: DataFrame) -> DataFrame:
    """Outline edges of each slice's mask, by direction: `across` edges face left or right, `along` edges up or down."""
    none = F.lit(0).cast("long")
    held = F.aggregate("spans", none, lambda n, s: n + s["c_hi"] - s["c_lo"])
    meets = F.aggregate("spans", F.struct(none.alias("n"), F.lit(None).cast("long").alias("end")), lambda x, s: F.struct((x["n"] + F.when(x["end"] == s["c_lo"], 1).otherwise(0)).alias("n"), s["c_hi"].cast("long").alias("end")))["n"]
    common = lambda t: F.aggregate("spans", none, lambda n, s: n + F.greatest(none, F.least(s["c_hi"], t["c_hi"]) - F.greatest(s["c_lo"], t["c_lo"])))
    shared = lambda name: F.aggregate(F.coalesce(F.col(name), F.array().cast("array<struct<c_lo:bigint,c_hi:bigint>>")), none, lambda n, t: n + common(t))
    sides = by_row(spans).select(*SLICE, held.alias("cells"), (F.size("spans") - meets).alias("runs"), (shared("up") + shared("down")).alias("beside"))
    total = sides.groupBy(*SLICE).agg(F.sum("cells").alias("cells"), F.sum("runs").alias("runs"), F.sum("beside").alias("beside"))
    return total.select(*SLICE, "cells", (2 * F.col("runs")).alias("across"), (2 * F.col("cells") - F.col("beside")).alias("along"))


def geometry(spans: DataFrame, sx: float, sy: float, thickness: float, dose_voxel_cc: float) -> DataFrame:
    """Volume, surface with the first and last slice's areas as caps, size in dose voxels (cube root), and complexity:
    surface over that of a sphere of the same volume, less one."""
    p = perimeter(spans).withColumn("area", F.col("cells") * (sx * sy)).withColumn("edge", F.col("across") * sy + F.col("along") * sx)
    s = p.groupBy(*S).agg(F.sum(F.col("area") * thickness).alias("mm3"), (F.sum(F.col("edge") * thickness) + F.min_by("area", "k") + F.max_by("area", "k")).alias("surface_mm2"))
    v = F.col("mm3") / 1000
    sphere = F.pow(F.lit(36 * 3.141592653589793) * F.col("mm3") * F.col("mm3"), F.lit(1 / 3))
    return s.select(*S, v.alias("volume_cc"), "surface_mm2", F.cbrt(v / dose_voxel_cc).alias("rss"), (F.col("surface_mm2") / sphere - 1).alias("complexity"))


def mask_classes(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A patient's structures by equal masks, and which masks hold which: members (S, rep), where rep is the smallest id with the same
    spans, and held (patient_id, part, whole, voxels, whole_voxels) over pairs of different reps. Only reps are compared, by the spans
    of their rows, so the work follows the number of different masks."""
    mask = spans.groupBy(*S).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("k", "r", "c_lo", "c_hi"))))).alias("mask"))
    masks = kept(mask.groupBy("patient_id", "mask").agg(F.min("structure_id").alias("rep"), F.collect_list("structure_id").alias("ids")))
    members = masks.select("patient_id", F.explode("ids").alias("structure_id"), "rep")
    rows = masks.select("patient_id", F.col("rep").alias("part"), F.explode("mask").alias("s")).select("patient_id", "part", "s.*")
    n = rows.groupBy("patient_id", "part").agg(F.sum(F.col("c_hi") - F.col("c_lo")).alias("voxels"))
    rows, n = merged(rows), merged(n)
    other = rows.select("patient_id", "k", "r", F.col("part").alias("whole"), F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"))
    both = rows.join(other, ["patient_id", "k", "r"]).filter("part <> whole and c_lo < hi and lo < c_hi")
    shared = both.groupBy("patient_id", "part", "whole").agg(F.sum(F.least("c_hi", "hi") - F.greatest("c_lo", "lo")).alias("shared"))
    held = shared.join(n, ["patient_id", "part"]).filter("shared = voxels").drop("shared")
    return kept(members), kept(held.join(n.select("patient_id", F.col("part").alias("whole"), F.col("voxels").alias("whole_voxels")), ["patient_id", "whole"]))


def members_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of reps (patient_id, part, whole) as pairs of all their members. Only the members of one side are shuffled; pairs are
    listed in place."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = lambda side: members.select("patient_id", F.col("rep").alias(side), F.col("structure_id").alias(f"{side}_id"))
    left = pairs.select("patient_id", "part", "whole").join(merged(of("part")), ["patient_id", "part"]).repartition(parts, "patient_id", "part_id", "whole")
    lists = members.groupBy("patient_id", F.col("rep").alias("whole")).agg(F.collect_list("structure_id").alias("ids"))
    return left.join(merged(lists), ["patient_id", "whole"]).select("patient_id", F.col("part_id").alias("part"), F.explode("ids").alias("whole"))


def contained(spans: DataFrame) -> DataFrame:
    """Ordered pairs of a patient's structures where every cell of `part` is in `whole`."""
    members, held = mask_classes(spans)
    same = members.groupBy("patient_id", F.col("rep").alias("part")).agg(F.count("*").alias("n")).filter("n > 1").select("patient_id", "part", F.col("part").alias("whole"))
    return members_of(held.select("patient_id", "part", "whole").unionByName(same), members).filter("part <> whole")


def parents(spans: DataFrame) -> DataFrame:
    """T9 from masks: each contained structure's parent (patient_id, part, parent): the smallest that contains it, then the smallest id.
    A mask's smallest holder is found once for all structures that have it; pairs of structures are not listed."""
    members, held = mask_classes(spans)
    best = held.groupBy("patient_id", F.col("part").alias("rep")).agg(F.min(F.struct(F.col("whole_voxels").alias("v"), F.col("whole").alias("parent"))).alias("best"), F.min("voxels").alias("voxels"))
    second = members.filter("structure_id <> rep").groupBy("patient_id", "rep").agg(F.min("structure_id").alias("second"))
    # a structure of the same mask is as small as a holder can be; of larger ids only the first has another one than rep
    x = members.join(second, ["patient_id", "rep"], "left").join(best, ["patient_id", "rep"], "left")
    twin = F.when(F.col("structure_id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    parent = F.when(twin.isNull() | ((F.col("best.v") == F.col("voxels")) & (F.col("best.parent") < twin)), F.col("best.parent")).otherwise(twin)
    return x.select("patient_id", F.col("structure_id").alias("part"), parent.alias("parent")).filter("parent is not null")


def competitors(spans: DataFrame) -> DataFrame:
    """T10 from masks, all structures being targets: (patient_id, target, rival), every pair but those nested in one another; a structure
    is its own rival. Masks are compared once, and pairs are listed in place."""
    members, held = mask_classes(spans)
    reps = members.filter("structure_id = rep").select("patient_id", "rep")
    pairs = reps.withColumnRenamed("rep", "part").join(reps.withColumnRenamed("rep", "whole"), "patient_id").filter("part <> whole")
    nested = held.select("patient_id", "part", "whole").unionByName(held.select("patient_id", F.col("whole").alias("part"), F.col("part").alias("whole")))
    apart = members_of(pairs.join(nested, ["patient_id", "part", "whole"], "left_anti"), members)
    every = apart.unionByName(members.select("patient_id", F.col("structure_id").alias("part"), F.col("structure_id").alias("whole")))
    return every.withColumnsRenamed({"part": "target", "whole": "rival"})


def union_cells(spans: DataFrame) -> DataFrame:
    """Cells of any structure of the patient."""
    return cells(spans).select("patient_id", "k", "r", "c").distinct()


def dilated(cell: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells and their eight neighbours within the plane."""
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    out = cell.withColumn("s", step).select("patient_id", "k", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return out.filter((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols)).distinct()


def centroids(points: DataFrame, rows: int, cols: int) -> DataFrame:
    """Half-even rounded mean row, column and slice of the vertices, within the grid."""
    return points.groupBy(*S).agg(F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.bround(F.avg("r")).cast("int"))).alias("r"), F.greatest(F.lit(0), F.least(F.lit(cols - 1), F.bround(F.avg("c")).cast("int"))).alias("c"), F.bround(F.avg("k")).cast("int").alias("k"))


def areas(points: DataFrame) -> DataFrame:
    """Signed area and outline length of every contour."""
    e = edges(points)
    return e.groupBy(*CONTOUR).agg((F.sum(F.col("c0") * F.col("r1") - F.col("c1") * F.col("r0")) / 2).alias("signed_area"), F.sum(F.hypot(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0"))).alias("length"))


def column_crossings(points: DataFrame, column: float) -> DataFrame:
    """Where each slice's contours cross a column, in order, numbered from 1."""
    e = edges(points).filter(((F.col("c0") <= column) & (F.col("c1") > column)) | ((F.col("c1") <= column) & (F.col("c0") > column)))
    y = F.col("r0") + (column - F.col("c0")) * (F.col("r1") - F.col("r0")) / (F.col("c1") - F.col("c0"))
    return e.select(*SLICE, y.alias("y")).withColumn("no", F.row_number().over(Window.partitionBy(*SLICE).orderBy("y")))


def expanded_box(spans: DataFrame, margin: float, sx: float, sy: float, rows: int, cols: int) -> DataFrame:
    """A structure's box, wider by a margin in whole cells and within the grid."""
    mr, mc = -(-margin // sy), -(-margin // sx)
    box = spans.groupBy(*S).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c_lo").alias("c0"), F.max(F.col("c_hi") - 1).alias("c1"))
    return box.select(*S, F.greatest(F.lit(0), F.col("r0") - int(mr)).alias("r0"), F.least(F.lit(rows - 1), F.col("r1") + int(mr)).alias("r1"), F.greatest(F.lit(0), F.col("c0") - int(mc)).alias("c0"), F.least(F.lit(cols - 1), F.col("c1") + int(mc)).alias("c1"))


def thickness(slices: DataFrame, fallback: float) -> DataFrame:
    """Half the way to both neighbours, the ends mirrored; a single slice has the fallback."""
    w = Window.partitionBy("patient_id").orderBy("z")
    up, down = F.lead("z").over(w) - F.col("z"), F.col("z") - F.lag("z").over(w)
    return slices.withColumn("up", up).withColumn("down", down).select("patient_id", "k", "z", F.coalesce((F.col("up") + F.col("down")) / 2, "up", "down", F.lit(float(fallback))).alias("thickness"))


def median_step(slices: DataFrame) -> DataFrame:
    """The median and the smallest of positive steps between neighbours."""
    step = F.col("z") - F.lag("z").over(Window.partitionBy("patient_id").orderBy("z"))
    return slices.withColumn("step", step).filter("step > 1e-6").groupBy("patient_id").agg(F.percentile("step", 0.5).alias("median_step"), F.min("step").alias("least_step"))


def nearest_slice(asked: DataFrame, slices: DataFrame) -> DataFrame:
    """Asked (patient_id, id, at) with the slice nearest to it, the lower one on a tie: the last slice at or below and
    the first at or above come from one ordered pass over both tables."""
    every = asked.select("patient_id", F.col("at").alias("p"), "id", F.lit(None).cast("bigint").alias("k")).unionByName(slices.select("patient_id", F.col("z").alias("p"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.col("k").cast("bigint").alias("k")))
    s = F.when(F.col("k").isNotNull(), F.struct("p", "k"))
    w = Window.partitionBy("patient_id").orderBy("p")
    below = F.last(s, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first(s, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    out = every.withColumn("lo", below).withColumn("hi", above).filter("id is not null")
    k = F.when(F.col("lo").isNull(), F.col("hi.k")).when(F.col("hi").isNull(), F.col("lo.k")).when(F.col("p") - F.col("lo.p") <= F.col("hi.p") - F.col("p"), F.col("lo.k")).otherwise(F.col("hi.k"))
    return out.select("patient_id", "id", F.col("p").alias("at"), k.alias("k")).filter("k is not null")
