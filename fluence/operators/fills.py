"""Holes of masks in three dimensions, and isodose volumes near a structure.

Masks are spans (S, k, r, c_lo, c_hi), c_hi exclusive. Holes are found on runs of background, so a task holds the outline of one
structure's block and never its planes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import merged
from .surfaces import BOX, CELLS, P, S, boxes, envelope, flooded, plane_squares, widened

_SUMS = pa.schema([(P, pa.int64()), ("structure_id", pa.int64()), *((c, pa.float64()) for c in ("threshold_gy", "volume_cc", "share_cc"))])


def as_spans(cell: DataFrame, keys: list[str] = S) -> DataFrame:
    """Cells (keys, k, r, c), repeated ones once, as spans of neighbours in a row."""
    row = [*keys, "k", "r"]
    one = cell.select(*row, "c").distinct()
    run = one.withColumn("run", F.col("c") - F.row_number().over(Window.partitionBy(*row).orderBy("c")))
    return run.groupBy(*row, "run").agg(F.min("c").alias("c_lo"), (F.max("c") + 1).alias("c_hi")).drop("run")


def _gaps(low: np.ndarray, high: np.ndarray, lines: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """What spans leave of all lines. A place is line * (cols + 1) + column; spans may touch, overlap and come in any order."""
    width = cols + 1
    begin = np.arange(lines) * width
    low, high = np.r_[begin, low, begin + cols], np.r_[begin, high, begin + cols]
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    ok = (low[1:] > reach[:-1]) & (low[1:] // width == reach[:-1] // width)
    return reach[:-1][ok], low[1:][ok]


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first to last (exclusive), each with the number of its range."""
    n = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _closed(low: np.ndarray, high: np.ndarray, slices: int, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans with the runs of background that no path of side-by-side cells joins to a face of the block."""
    width, lines = cols + 1, slices * rows
    a, b = _gaps(low, high, lines, cols)
    line = a // width
    k, r = line // rows, line % rows
    ways = []
    for step, may in ((1, r < rows - 1), (rows, k < slices - 1)):
        near = np.flatnonzero(may)
        to = step * width
        i, j = _each(np.searchsorted(b, a[near] + to, "right"), np.searchsorted(a, b[near] + to, "left"))
        ways.append((near[i], j))
    source = np.concatenate([x for i, j in ways for x in (i, j)])
    target = np.concatenate([x for i, j in ways for x in (j, i)])
    order = np.argsort(source, kind="stable")
    target = target[order]
    at = np.searchsorted(source[order], np.arange(len(a) + 1))
    seen = (k == 0) | (k == slices - 1) | (r == 0) | (r == rows - 1) | (a % width == 0) | (b % width == cols)
    front = np.flatnonzero(seen)
    while len(front):  # every run and every way is visited once
        front = target[_each(at[front], at[front + 1])[1]]
        front = np.unique(front[~seen[front]])
        seen[front] = True
    return _gaps(a[seen], b[seen], lines, cols)


def filled_volumes(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """G14 in three dimensions: masks (S, k, r, c_lo, c_hi) within their block (S, BOX), with their cavities: background that no path of
    side-by-side cells, within and across slices, joins to a face of the block. Spans come back merged.

    All runs of one structure's block are in one task: their number grows with its outline, not with patients. Spans outside the
    block are cut off; structures without a block or without a span in it are left out; spans may repeat or overlap."""
    names = [*S, "k", "r", "c_lo", "c_hi"]

    def run(table):
        one = {c: table.column(c)[0].as_py() for c in (*S, *BOX)}
        slices, rows, cols = (one[f"{x}1"] - one[f"{x}0"] + 1 for x in "krc")
        col = {c: table.column(c).to_numpy() for c in names[2:]}
        at = ((col["k"] - one["k0"]) * rows + col["r"] - one["r0"]) * (cols + 1) - one["c0"]
        low, high = _closed(at + col["c_lo"], at + col["c_hi"], slices, rows, cols)
        line, start = np.divmod(low, cols + 1)
        out = [line // rows + one["k0"], line % rows + one["r0"], start + one["c0"], start + high - low + one["c0"]]
        return pa.Table.from_arrays([*(pa.array(np.full(len(low), one[c])) for c in S), *map(pa.array, out)], names=names)

    b = spans.select(*names).join(blocks.select(*S, *BOX), S)
    b = b.filter((F.col("k") >= F.col("k0")) & (F.col("k") <= F.col("k1")) & (F.col("r") >= F.col("r0")) & (F.col("r") <= F.col("r1")))
    b = b.withColumn("c_lo", F.greatest("c_lo", "c0")).withColumn("c_hi", F.least("c_hi", F.col("c1") + 1)).filter("c_lo < c_hi")
    b = b.select(*(F.col(c).cast("long").alias(c) for c in (*names, *BOX)))
    return b.groupBy(*S).applyInArrow(run, ", ".join(f"{c} long" for c in names))


def _cavities(mask: np.ndarray) -> np.ndarray:
    """A block's mask with its cavities, by _closed."""
    slices, rows, cols = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (0, 0), (0, 1))).ravel().astype(np.int8), prepend=0)
    if not edge.any():
        return mask
    low, high = _closed(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), slices, rows, cols)
    step = np.zeros(edge.size, np.int8)
    step[low], step[high] = 1, -1
    return np.cumsum(step, dtype=np.int8).reshape(slices, rows, cols + 1)[:, :, :cols] > 0


def _near(mask: np.ndarray, margin: float, sx: float, sy: float, sz: float) -> np.ndarray:
    """G16 in a block: the cells within a margin of its mask; distances across slices are made for as many rows as make up CELLS."""
    slices, rows, cols = mask.shape
    square, near = np.full(mask.shape, np.inf), np.zeros_like(mask)
    for k in np.flatnonzero(mask.any(axis=(1, 2))):
        square[k] = plane_squares(mask[k], sx, sy)
    few = max(1, CELLS // (slices * cols))
    for r in range(0, rows, few):
        some = square[:, r : r + few]
        near[:, r : r + few] = (np.sqrt(envelope(some.reshape(slices, -1), np.arange(slices) * sz)) <= margin).reshape(some.shape)
    return near


def _steepness(dose: np.ndarray, k: int, sx: float, sy: float, sz: float) -> np.ndarray:
    """The gradient of a block's dose in one slice, 0.001 Gy a mm at least: by both neighbours, at the ends by one, 0 for a single cell."""

    def slope(of, axis, at, step):
        n = of.shape[axis]
        up, down = (np.take(of, np.clip(at + s, 0, n - 1), axis) for s in (1, -1))
        count = (at < n - 1).astype(float) + (at > 0)
        wide = np.maximum(count, 1) * step
        return (up - down) / (wide if axis == of.ndim - 1 else wide.reshape(-1, *[1] * (of.ndim - 1 - axis)))

    gk = slope(dose, 0, np.array([k]), sz)[0]
    gr, gc = (slope(dose[k], axis, np.arange(dose.shape[axis + 1]), step) for axis, step in ((0, sy), (1, sx)))
    return np.maximum(np.sqrt(gk * gk + gr * gr + gc * gc), 1e-3)


def margin_isodose(
    targets: DataFrame, spans: DataFrame, voxels: DataFrame, margin: float, sx: float, sy: float, sz: float, slices: int, rows: int, cols: int
) -> DataFrame:
    """Targets (S, threshold_gy) with the volume at or above the threshold within a margin of the structure, in the box around it
    that is wider by the margin: volume_cc by whole cells, with holes of each slice filled; share_cc, for small structures, by the share
    of each cell that reaches the threshold: one half, and more or less by the distance to the isodose surface, (dose - threshold) over
    the gradient, in diagonals of a cell, 0 to 1; cells of the isodose with its cavities filled count whole.

    A structure's spans meet the cells of its block that have a dose in one task, which holds that block (about 20 bytes a cell) for
    all its thresholds; no cell without a dose is made before, and one row for each threshold leaves it.

    Cells without a dose have none. Both are 0 where the threshold is not positive or the structure has no mask; further columns
    are left out and repeated targets repeat."""
    cc, diagonal = sx * sy * sz / 1000, float(np.sqrt(sx * sx + sy * sy + sz * sz))
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = targets.filter("threshold_gy > 0").groupBy(*S).agg(F.array_sort(F.collect_set(F.col("threshold_gy").cast("double"))).alias("levels"))
    block = widened(boxes(spans), margin, sx, sy, sz, slices, rows, cols).join(merged(asked), S).select(*(F.col(c).cast("long").alias(c) for c in (*S, *BOX)), "levels")
    mask = spans.select(*(F.col(c).cast("long").alias(c) for c in (*S, "k", "r", "c_lo", "c_hi"))).join(merged(block), S)
    mask = mask.filter((F.col("k") >= F.col("k0")) & (F.col("k") <= F.col("k1")) & (F.col("r") >= F.col("r0")) & (F.col("r") <= F.col("r1")))
    mask = mask.withColumn("c_lo", F.greatest("c_lo", "c0")).withColumn("c_hi", F.least("c_hi", F.col("c1") + 1)).filter("c_lo < c_hi")
    cell = F.struct(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("dose_gy").cast("double").alias("d"))
    planes = voxels.filter("dose_gy is not null").groupBy(P, F.col("k").cast("long").alias("k")).agg(F.collect_list(cell).alias("cells"))
    held = planes.join(merged(block.drop("levels")), P).filter((F.col("k") >= F.col("k0")) & (F.col("k") <= F.col("k1")))
    inside = lambda x: (x["r"] >= F.col("r0")) & (x["r"] <= F.col("r1")) & (x["c"] >= F.col("c0")) & (x["c"] <= F.col("c1"))
    held = held.select(*(F.col(c).cast("long").alias(c) for c in S), "k", F.filter("cells", inside).alias("cells")).filter(F.size("cells") > 0)

    def run(table, grids):
        if not table.num_rows:
            return _SUMS.empty_table()
        one = {c: table.column(c)[0].as_py() for c in (*S, *BOX, "levels")}
        shape = tuple(one[f"{x}1"] - one[f"{x}0"] + 1 for x in "krc")
        step = np.zeros((*shape[:2], shape[2] + 1), np.int32)
        for name, sign in (("c_lo", 1), ("c_hi", -1)):
            np.add.at(step, tuple(table.column(x).to_numpy() - one[f"{x[0]}0"] for x in ("k", "r", name)), sign)
        near = _near(np.cumsum(step, axis=2)[:, :, :-1] > 0, margin, sx, sy, sz)
        dose = np.full(shape, -np.inf)
        for k, of in zip(grids.column("k").to_pylist(), grids.column("cells"), strict=True):
            r, c, d = (of.values.field(x).to_numpy() for x in ("r", "c", "d"))
            np.maximum.at(dose[k - one["k0"]], (r - one["r0"], c - one["c0"]), d)
        dose[np.isneginf(dose)] = 0.0
        hot = lambda of, level: (of >= level) | np.isnan(of)
        solid = [_cavities(hot(dose, x)) for x in one["levels"]]
        sums = np.zeros((len(solid), 2))
        for k in np.flatnonzero(near.any(axis=(1, 2))):
            steep = _steepness(dose, k, sx, sy, sz)
            for i, level in enumerate(one["levels"]):
                share = np.maximum(0.0, np.fmin(1.0, 0.5 + (dose[k] - level) / steep / diagonal))
                sums[i] += np.count_nonzero(flooded(hot(dose[k], level)) & near[k]), np.where(solid[i][k], 1.0, share)[near[k]].sum()
        n = len(sums)
        return pa.Table.from_arrays([*(pa.array([one[c]] * n, pa.int64()) for c in S), pa.array(one["levels"], pa.float64()), *(pa.array(sums[:, j] * cc) for j in (0, 1))], schema=_SUMS)

    got = mask.repartition(parts, *S).groupBy(*S).cogroup(held.repartition(parts, *S).groupBy(*S)).applyInArrow(run, f"{P} long, structure_id long, threshold_gy double, volume_cc double, share_cc double")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return targets.select(*S, F.col("threshold_gy").cast("double").alias("threshold_gy")).join(merged(got), [*S, "threshold_gy"], "left").select(*S, "threshold_gy", zero("volume_cc"), zero("share_cc"))
