"""Distances to surfaces in three dimensions, and what targets own by them.

A distance field is kept as lines: a row for each slice and row of a block, with an array over its columns. Exact distances come
in passes: planes' columns and rows in one group, then all slices of some rows in another, so a task holds one plane at a time, or
one row of all slices for the structures of a block, or as many as make up CELLS cells; neither grows with the number of patients.
Each pass is the lower envelope of parabolas, for all lines of a group at once.

A block is k0, k1, r0, r1, c0, c1, ends included; what lies outside a block is neither mask nor background.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import kept, merged
from .raster import cells

P = "patient_id"
S = [P, "structure_id"]
BOX = ["k0", "k1", "r0", "r1", "c0", "c1"]
#: So many parabolas are compared one by one.
FEW = 64
#: Cells of a block that one task holds at a time, for one structure: as many planes, or rows of all slices, as make them up.
CELLS = 1 << 18
_WORK = ", ".join(f"{c} long" for c in (P, *BOX))


def envelope(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (x[i] - x[j])^2 for every i and every column of f (rows at ascending x); inf stands for no parabola.
    Few parabolas are compared one by one, in whole arrays."""
    n, m = f.shape
    if n <= FEW:
        out = np.full((n, m), np.inf)
        for q in range(n):
            np.minimum(out, f[q] + ((x - x[q]) ** 2)[:, None], out=out)
        return out
    which, begin, top = np.zeros((n, m), np.int64), np.full((n + 1, m), -np.inf), np.full(m, -1)
    for q in range(n):
        live = np.flatnonzero(np.isfinite(f[q]))
        start = np.full(m, -np.inf)
        todo = live[top[live] >= 0]
        while len(todo):
            p = which[top[todo], todo]
            start[todo] = ((f[q, todo] + x[q] ** 2) - (f[p, todo] + x[p] ** 2)) / (2 * (x[q] - x[p]))
            todo = todo[start[todo] <= begin[top[todo], todo]]
            top[todo] -= 1
            start[todo[top[todo] < 0]] = -np.inf
            todo = todo[top[todo] >= 0]
        top[live] += 1
        which[top[live], live] = q
        begin[top[live], live] = start[live]
    out, at = np.full((n, m), np.inf), np.zeros(m, np.int64)
    some = np.flatnonzero(top >= 0)
    for i in range(n if len(some) else 0):
        todo = some
        while len(todo):
            todo = todo[at[todo] < top[todo]]
            todo = todo[begin[at[todo] + 1, todo] <= x[i]]
            at[todo] += 1
        p = which[at[some], some]
        out[i, some] = f[p, some] + (x[i] - x[p]) ** 2
    return out


def plane_squares(mask: np.ndarray, sx: float, sy: float) -> np.ndarray:
    """The squared distance of every cell of a plane, or of several (plane, row, column), to the nearest cell of its mask; inf
    without one."""
    rows, cols = mask.shape[-2:]
    c = np.arange(cols)
    left = np.maximum.accumulate(np.where(mask, c, -np.inf), axis=-1)
    right = np.minimum.accumulate(np.where(mask, c, np.inf)[..., ::-1], axis=-1)[..., ::-1]
    near = np.moveaxis((np.minimum(c - left, right - c) * sx) ** 2, -2, 0)
    return np.moveaxis(envelope(near.reshape(rows, -1), np.arange(rows) * sy).reshape(near.shape), 0, -2)


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[-1], dtype=np.int32)), pa.array(np.ascontiguousarray(a, np.float64).ravel()))


def plane_lines(spans: DataFrame, work: DataFrame, sx: float, sy: float) -> DataFrame:
    """First passes: for each structure of a block (work: S, BOX, owners) and each slice with a mask, lines of squared distances in
    the plane to the mask (outside) and to its background within the block (inside)."""

    def run(table):
        one = {c: table.column(c)[0].as_py() for c in (P, "structure_id", *BOX, "owners")}
        rows, cols = one["r1"] - one["r0"] + 1, one["c1"] - one["c0"] + 1
        ks, plane = np.unique(table.column("k").to_numpy(), return_inverse=True)
        n = len(ks) * rows
        mask = np.zeros((n, cols + 1), np.int64)
        line = plane * rows + table.column("r").to_numpy() - one["r0"]
        np.add.at(mask, (line, table.column("c_lo").to_numpy() - one["c0"]), 1)
        np.add.at(mask, (line, table.column("c_hi").to_numpy() - one["c0"]), -1)
        mask = (np.cumsum(mask, axis=1)[:, :cols] > 0).reshape(len(ks), rows, cols)
        both = [plane_squares(m, sx, sy).reshape(n, cols) for m in (mask, ~mask)]
        owners = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(one["owners"]) + 1, len(one["owners"]), dtype=np.int32)), pa.array(np.tile(np.array(one["owners"], np.int64), n)))
        fixed = [pa.array(np.full(n, one[c])) for c in (P, *BOX, "structure_id")]
        at = pa.array(np.repeat(ks, rows)), pa.array(np.tile(np.arange(rows) + one["r0"], len(ks)))
        return pa.Table.from_arrays([*fixed, owners, *at, *map(_lists, both)], names=[P, *BOX, "structure_id", "owners", "k", "r", "outside", "inside"])

    b = work.join(merged(spans.select(*S, "k", "r", "c_lo", "c_hi")), S)
    b = b.filter((F.col("k") >= F.col("k0")) & (F.col("k") <= F.col("k1")) & (F.col("r") >= F.col("r0")) & (F.col("r") <= F.col("r1")))
    b = b.withColumn("c_lo", F.greatest("c_lo", "c0")).withColumn("c_hi", F.least("c_hi", F.col("c1") + 1)).filter("c_lo < c_hi")
    b = b.select(*(F.col(c).cast("long").alias(c) for c in (P, *BOX, "structure_id")), "owners", *(F.col(c).cast("long").alias(c) for c in ("k", "r", "c_lo", "c_hi")))
    planes = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / ((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1))))
    return b.groupBy(P, *BOX, "structure_id", F.floor(F.col("k") / planes).alias("batch")).applyInArrow(run, f"{_WORK}, structure_id long, owners array<long>, k long, r long, outside array<double>, inside array<double>")


def _rows_held() -> Column:
    """The batch of a row: as many rows of all slices go together as make up CELLS."""
    wide = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / ((F.col("k1") - F.col("k0") + 1) * (F.col("c1") - F.col("c0") + 1))))
    return F.floor(F.col("r") / wide).alias("batch")


def _volume(table, columns: list[str]):
    """Of a group of plane_lines with some rows: its block, the rows, its structures with their owners, and their fields over (slice, row and
    column)."""
    box = {c: table.column(c)[0].as_py() for c in (P, *BOX)}
    slices, cols = box["k1"] - box["k0"] + 1, box["c1"] - box["c0"] + 1
    ids, k = table.column("structure_id").to_numpy(), table.column("k").to_numpy() - box["k0"]
    known, first, at = np.unique(ids, return_index=True, return_inverse=True)
    rows, line = np.unique(table.column("r").to_numpy(), return_inverse=True)
    owners = table.column("owners").take(pa.array(first)).to_pylist()
    fields = []
    for name, rest in columns:
        f = np.full((len(known), slices, len(rows), cols), rest)
        f[at, k, line] = table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, cols)
        fields.append(f.reshape(len(known), slices, -1))
    return box, rows, known, owners, fields


def _surface(field: np.ndarray, sz: float) -> np.ndarray:
    """The last pass over (structure, slice, column): distances from squares in the planes."""
    n, slices, cols = field.shape
    return np.sqrt(envelope(field.transpose(1, 0, 2).reshape(slices, -1), np.arange(slices) * sz)).reshape(slices, n, cols).transpose(1, 0, 2)


def _both(fields, sz):
    outside, inside = (_surface(f, sz) for f in fields)
    return outside, np.where(outside > 0, 0.0, inside)


def distances(spans: DataFrame, blocks: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    """For every cell of a structure's block (S, BOX) its distance to the structure (outside; 0 in it) and, for its own cells, to
    the nearest background of the block (inside; 0 elsewhere; null where the block has none), as (S, k, r, c, outside, inside)."""

    def run(table):
        box, rows, known, _, fields = _volume(table, [("outside", np.inf), ("inside", 0.0)])
        outside, inside = _both(fields, sz)
        slices, cols = outside.shape[1], outside.shape[2] // len(rows)
        n = len(known) * slices * len(rows)
        k = np.repeat(np.arange(slices) + box["k0"], len(rows))
        fixed = [pa.array(np.full(n, box[P])), pa.array(np.repeat(known, slices * len(rows))), pa.array(np.tile(k, len(known))), pa.array(np.tile(rows, len(known) * slices)), pa.array(np.full(n, box["c0"]))]
        return pa.Table.from_arrays([*fixed, _lists(outside.reshape(n, cols)), _lists(inside.reshape(n, cols))], names=[P, "structure_id", "k", "r", "c0", "outside", "inside"])

    work = blocks.select(*S, *BOX, F.array(F.col("structure_id").cast("long")).alias("owners"))
    lines = plane_lines(spans, work, sx, sy).groupBy(P, "structure_id", *BOX, _rows_held()).applyInArrow(run, f"{P} long, structure_id long, k long, r long, c0 long, outside array<double>, inside array<double>")
    cell = lines.select(*S, "k", "r", "c0", F.posexplode(F.arrays_zip("outside", "inside")).alias("at", "x"))
    return cell.select(*S, "k", "r", (F.col("c0") + F.col("at")).alias("c"), "x.outside", F.when(F.col("x.inside") != float("inf"), F.col("x.inside")).alias("inside"))


def within_margin(spans: DataFrame, margin: float, sx: float, sy: float, sz: float, slices: int, rows: int, cols: int) -> DataFrame:
    """The cells whose distance to a structure is at most a margin, its own included, as (S, k, r, c, outside)."""
    block = widened(boxes(spans), margin, sx, sy, sz, slices, rows, cols)
    return distances(spans, block, sx, sy, sz).filter(F.col("outside") <= margin).drop("inside")


def owned_lines(spans: DataFrame, blocks: DataFrame, rivals: DataFrame, sx: float, sy: float, sz: float, margin: float | None = None) -> DataFrame:
    """Each target's share of the cells of its block, as lines (S, k, r, c0, weights) that hold any.

    blocks (S, BOX) and rivals (patient_id, target, rival; a target is its own rival). A cell belongs to the rival whose surface is
    nearest, from outside or from inside (unsigned); rivals at one distance (1e-6 and 1e-5 of it) share it. With a margin only
    rivals within it count, and only cells within it of the target. Targets with the same block share its distances."""
    box = blocks.select(P, F.col("structure_id").alias("target"), *BOX)
    work = box.join(merged(rivals), [P, "target"]).groupBy(P, F.col("rival").alias("structure_id"), *BOX).agg(F.array_sort(F.collect_list(F.col("target").cast("long"))).alias("owners"))

    def run(table):
        box, rows, known, owners, fields = _volume(table, [("outside", np.inf), ("inside", 0.0)])
        outside, inside = _both(fields, sz)
        surface = np.where(outside > 0, outside, inside)
        if margin is not None:
            surface = np.where(outside <= margin, surface, np.inf)
        out, slices, cols = [], surface.shape[1], box["c1"] - box["c0"] + 1
        k_of, r_of = np.repeat(np.arange(slices) + box["k0"], len(rows)), np.tile(rows, slices)
        for target in sorted({t for x in owners for t in x}):
            own = np.flatnonzero(known == target)
            if not len(own):
                continue
            mine = surface[[i for i, x in enumerate(owners) if target in x]]
            if margin is None and len(mine) == 1:
                mine = np.zeros_like(mine)  # without rivals a target owns its block
            low = mine.min(axis=0)
            tied = (mine <= low + 1e-6 + 1e-5 * np.abs(low)) & np.isfinite(mine)
            d = mine[0] if len(mine) == 1 else surface[own[0]]
            held = (d <= low + 1e-6 + 1e-5 * np.abs(low)) & np.isfinite(d)
            weight = np.where(held, 1.0 / np.maximum(tied.sum(axis=0), 1), 0.0).reshape(-1, cols)
            lines = np.flatnonzero(weight.any(axis=1))
            out.append((np.full(len(lines), target), k_of[lines], r_of[lines], weight[lines]))
        none = np.zeros(0, np.int64)
        ids, k, r, weights = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, np.zeros((0, cols)))
        fixed = [pa.array(np.full(len(k), box[P])), pa.array(ids), pa.array(k), pa.array(r), pa.array(np.full(len(k), box["c0"]))]
        return pa.Table.from_arrays([*fixed, _lists(weights)], names=[P, "structure_id", "k", "r", "c0", "weights"])

    return plane_lines(spans, work, sx, sy).groupBy(P, *BOX, _rows_held()).applyInArrow(run, f"{P} long, structure_id long, k long, r long, c0 long, weights array<double>")


def weighted_voxels(lines: DataFrame, voxels: DataFrame) -> DataFrame:
    """The voxels (patient_id, k, r, c, dose_gy) of owned_lines with their weights; joined as rows of voxels."""
    at = F.col("c") - F.col("c0")
    hit = voxels.join(merged(lines), [P, "k", "r"]).filter((at >= 0) & (at < F.size("weights")))
    return hit.select(*S, "k", "r", "c", "dose_gy", F.get("weights", at.cast("int")).alias("weight")).filter("weight > 0")


def boxes(spans: DataFrame) -> DataFrame:
    """The box of every structure's mask, slices included."""
    return spans.groupBy(*S).agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c_lo").alias("c0"), F.max(F.col("c_hi") - 1).alias("c1"))


def widened(box: DataFrame, margin: float, sx: float, sy: float, sz: float, slices: int, rows: int, cols: int) -> DataFrame:
    """A14 with slices: boxes wider by a margin in whole cells, within the grid."""
    out = box
    for a, b, step, n in (("k0", "k1", sz, slices), ("r0", "r1", sy, rows), ("c0", "c1", sx, cols)):
        wide = int(-(-margin // step))
        out = out.withColumn(a, F.greatest(F.lit(0), F.col(a) - wide)).withColumn(b, F.least(F.lit(n - 1), F.col(b) + wide))
    return out


def _around(parts: DataFrame) -> DataFrame:
    """One box around all boxes of a target."""
    ends = [(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX]
    return parts.groupBy(*S).agg(*ends)


def support_blocks(targets: DataFrame, rivals: DataFrame, spans: DataFrame, voxels: DataFrame) -> DataFrame:
    """The block of each target (S, least_gy): the box around the voxels at or above least_gy and around all its rivals. Targets
    without such voxels have none. Boxes by dose are partial extremes before they are shuffled."""
    dose = voxels.join(merged(targets.select(P, "least_gy").distinct()), P).filter("least_gy > 0 and dose_gy >= least_gy")
    ends = [(F.min if c.endswith("0") else F.max)(c[0]).alias(c) for c in BOX]
    support = targets.join(merged(dose.groupBy(P, "least_gy").agg(*ends)), [P, "least_gy"]).select(*S, *BOX)
    theirs = boxes(spans).withColumnRenamed("structure_id", "rival").join(merged(rivals), [P, "rival"]).select(P, F.col("target").alias("structure_id"), *BOX)
    return _around(support.unionByName(theirs.join(merged(support.select(*S)), S, "left_semi")))


def margin_blocks(spans: DataFrame, rivals: DataFrame, margin: float, sx: float, sy: float, sz: float, slices: int, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """T14's blocks and rivals: those rivals whose widened boxes meet the target's, and the box around them."""
    wide = widened(boxes(spans), margin, sx, sy, sz, slices, rows, cols)
    own = wide.select(P, F.col("structure_id").alias("target"), *(F.col(c).alias(f"t_{c}") for c in BOX))
    pairs = rivals.join(merged(own), [P, "target"]).join(merged(wide.withColumnRenamed("structure_id", "rival")), [P, "rival"])
    for a in "krc":
        pairs = pairs.filter((F.col(f"t_{a}1") >= F.col(f"{a}0")) & (F.col(f"{a}1") >= F.col(f"t_{a}0")))
    return _around(pairs.select(P, F.col("target").alias("structure_id"), *BOX)), pairs.select(P, "target", "rival")


def owned_volumes(weighted: DataFrame, levels: DataFrame, cc: float) -> DataFrame:
    """Targets (S, level, threshold_gy) with the volume of what they own at or above each threshold."""
    v = levels.filter("threshold_gy > 0").join(merged(weighted), S)
    got = v.groupBy(*S, "level").agg(F.sum(F.when(F.col("dose_gy") >= F.col("threshold_gy"), F.col("weight") * cc).otherwise(0.0)).alias("volume_cc"))
    return levels.join(merged(got), [*S, "level"], "left").select(*S, "level", "threshold_gy", F.coalesce("volume_cc", F.lit(0.0)).alias("volume_cc"))


def within(cells: DataFrame, spans: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The cells (keys, k, r, c) that a mask (keys, k, r, c_lo, c_hi) has (left_semi) or has not (left_anti)."""
    s = spans.select(*keys, "k", "r", F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"))
    on = [cells[c] == s[c] for c in (*keys, "k", "r")]
    return cells.join(s, [*on, (cells["c"] >= s["lo"]) & (cells["c"] < s["hi"])], how)


def stereotactic(targets: DataFrame, rivals: DataFrame, spans: DataFrame, voxels: DataFrame, brain: DataFrame, inner: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    """Targets (S, rx_gy, coverage_pct, fractions) with volume_cc, ci, pci, gi and brain_cc, if any voxel reaches the least of
    their doses.

    brain (spans of each patient's one brain) counts at 12 Gy for one fraction, without the cells of inner (S, and the spans of
    structures within a target that are not tissue), and at 24 Gy for five; else brain_cc is null. Volumes are those of masks.
    All sums of a target are taken in one pass over what it owns."""
    cc = sx * sy * sz / 1000
    brain_gy = F.when(F.col("fractions") == 1, 12.0).when(F.col("fractions") == 5, 24.0)
    t = targets.filter("rx_gy > 0").withColumn("brain_gy", brain_gy).withColumn("least_gy", F.least(F.col("rx_gy") / 2, "brain_gy"))
    t = merged(kept(t))
    blocks = merged(kept(support_blocks(t.select(*S, "least_gy"), rivals, spans, voxels)))
    # written once, as the plan of all that follows, planned again after each of its stages, took the driver's memory
    lines = kept(owned_lines(spans, blocks, rivals, sx, sy, sz), plain=False)
    own = kept(weighted_voxels(lines, voxels).join(t, S).filter("dose_gy >= least_gy"))
    b = brain.select(F.col(P).alias("b_p"), F.col("k").alias("b_k"), F.col("r").alias("b_r"), "c_lo", "c_hi")
    own = own.join(merged(b), (F.col(P) == F.col("b_p")) & (F.col("k") == F.col("b_k")) & (F.col("r") == F.col("b_r")) & (F.col("c") >= F.col("c_lo")) & (F.col("c") < F.col("c_hi")), "left")
    not_tissue = cells(inner).distinct().withColumn("lesion", F.lit(True))
    own = own.join(merged(not_tissue), [*S, "k", "r", "c"], "left")
    counts = F.col("b_p").isNotNull() & (F.col("dose_gy") >= F.col("brain_gy")) & ~((F.col("fractions") == 1) & F.col("lesion").isNotNull())
    part = lambda ok: F.sum(F.when(ok, F.col("weight") * cc).otherwise(0.0))
    sums = own.groupBy(*S).agg(part(F.col("dose_gy") >= F.col("rx_gy")).alias("iso"), part(F.col("dose_gy") >= F.col("rx_gy") / 2).alias("half"), part(counts).alias("tissue"))
    volume = spans.groupBy(*S).agg((F.sum(F.col("c_hi") - F.col("c_lo")) * cc).alias("volume_cc"))
    x = t.join(merged(volume), S).join(blocks.select(*S), S).join(merged(sums), S, "left").join(merged(brain.select(P).distinct().withColumn("with_brain", F.lit(True))), P, "left")
    iso, half = F.coalesce("iso", F.lit(0.0)), F.coalesce("half", F.lit(0.0))
    cover = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coverage_pct") / 100))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return x.select(
        *S, "volume_cc", (iso / F.col("volume_cc")).alias("ci"), ratio(cover * cover * F.col("volume_cc"), iso).alias("pci"), ratio(half, iso).alias("gi"),
        F.when(F.col("brain_gy").isNotNull() & F.col("with_brain"), F.coalesce("tissue", F.lit(0.0))).alias("brain_cc"),
    )


def flooded(mask: np.ndarray) -> np.ndarray:
    """A plane with the background that no path of side-by-side cells joins to its edge: whole runs of a row, then of a column, at a time."""

    def spread(seen, free, axis):
        if axis:
            return spread(seen.T, free.T, 0).T
        flat, open_ = seen.ravel(), free.ravel()
        first = np.flatnonzero(np.r_[True, open_[1:] != open_[:-1]])  # the frame is free on both sides, so runs end with rows or at walls
        run = np.repeat(np.maximum.reduceat(flat, first), np.diff(np.append(first, len(flat))))
        return (run & open_).reshape(seen.shape)

    free = np.pad(~mask, 1, constant_values=True)
    seen = np.zeros_like(free)
    seen[0], seen[-1], seen[:, 0], seen[:, -1] = True, True, True, True
    while True:
        wider = spread(spread(seen, free, 0), free, 1)
        if (wider == seen).all():
            return ~seen[1:-1, 1:-1]
        seen = wider


def filled_in_blocks(cell: DataFrame, blocks: DataFrame) -> DataFrame:
    """G14 in the plane: cells (S, k, r, c) within their block (S, BOX), with the background that no path of side-by-side cells joins
    to the block's edge. A plane of a block is flooded in one task (flooded)."""

    def fill(table):
        one = {c: table.column(c)[0].as_py() for c in (*S, "k", *BOX)}
        mask = np.zeros((one["r1"] - one["r0"] + 1, one["c1"] - one["c0"] + 1), bool)
        mask[table.column("r").to_numpy() - one["r0"], table.column("c").to_numpy() - one["c0"]] = True
        r, c = np.nonzero(flooded(mask))
        fixed = [pa.array(np.full(len(r), one[x])) for x in (*S, "k")]
        return pa.Table.from_arrays([*fixed, pa.array(r + one["r0"]), pa.array(c + one["c0"])], names=[*S, "k", "r", "c"])

    b = cell.join(merged(blocks), S).select(*(F.col(c).cast("long").alias(c) for c in (*S, *BOX, "k", "r", "c")))
    b = b.filter((F.col("k") >= F.col("k0")) & (F.col("k") <= F.col("k1")) & (F.col("r") >= F.col("r0")) & (F.col("r") <= F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") <= F.col("c1")))
    return b.groupBy(*S, "k").applyInArrow(fill, f"{P} long, structure_id long, k long, r long, c long")


def margin_volumes(targets: DataFrame, rivals: DataFrame, spans: DataFrame, voxels: DataFrame, margin: float, sx: float, sy: float, sz: float, slices: int, rows: int, cols: int, extra: DataFrame | None = None) -> DataFrame:
    """Targets (S, threshold_gy) with the volume within a margin that is theirs and at or above the threshold, holes of each
    slice's isodose filled within the block; only cells of extra (patient_id, k, r, c_lo, c_hi), if given. 0 without any."""
    blocks, near = margin_blocks(spans, rivals, margin, sx, sy, sz, slices, rows, cols)
    lines = owned_lines(spans, blocks, near, sx, sy, sz, margin)
    hot = voxels.join(merged(targets.filter("threshold_gy > 0")), P).filter("dose_gy >= threshold_gy").select(*S, "k", "r", "c")
    iso = filled_in_blocks(hot, blocks)
    if extra is not None:
        iso = within(iso, extra, [P])
    at = F.col("c") - F.col("c0")
    hit = iso.join(merged(lines), [*S, "k", "r"]).filter((at >= 0) & (at < F.size("weights")))
    hit = hit.groupBy(*S).agg((F.sum(F.get("weights", at.cast("int"))) * (sx * sy * sz / 1000)).alias("volume_cc"))
    return targets.join(merged(hit), S, "left").select(*S, "threshold_gy", F.coalesce("volume_cc", F.lit(0.0)).alias("volume_cc"))


def threshold_volumes(targets: DataFrame, rivals: DataFrame, spans: DataFrame, voxels: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    """Targets (S, threshold_gy) with the volume at or above it that is theirs, in the block around that volume and the rivals.
    0 where no voxel reaches the threshold."""
    t = targets.select(*S, F.col("threshold_gy").alias("least_gy"))
    lines = owned_lines(spans, support_blocks(t, rivals, spans, voxels), rivals, sx, sy, sz)
    hit = weighted_voxels(lines, voxels).join(merged(t), S).filter("dose_gy >= least_gy").groupBy(*S).agg((F.sum("weight") * (sx * sy * sz / 1000)).alias("volume_cc"))
    return targets.join(merged(hit), S, "left").select(*S, "threshold_gy", F.coalesce("volume_cc", F.lit(0.0)).alias("volume_cc"))
