"""One structure at a time on a grid finer than the dose's: the shares of its cells, the doses at their centres, its curve.

A group of rows is one structure, with the dose planes that it lies between; cells and samples live in its task only, a few slices
at a time, and what leaves it is a row with the whole curve (as dvh.curves gives it) or the cells of a small model. The rules
are those of raster.mask_spans, sampling.occupancy, voxels.between_planes and dvh.histogram."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import merged
from .fills import _each

P = "patient_id"
S = [P, "structure_id"]
#: Cells of the box of a structure's slices that are held at a time, and samples that are summed at a time.
CELLS = 1 << 18
CURVE = f"{P} long, structure long, volume_cc double, mean_gy double, min_gy double, max_gy double, n_samples long, n_bins int, steps array<struct<bin: int, cc: double>>"
_STEPS = pa.struct([("bin", pa.int32()), ("cc", pa.float64())])
_CURVE = pa.schema([(P, pa.int64()), ("structure", pa.int64()), *((c, pa.float64()) for c in ("volume_cc", "mean_gy", "min_gy", "max_gy")), ("n_samples", pa.int64()), ("n_bins", pa.int32()), ("steps", pa.list_(_STEPS))])


def _edges(plane: np.ndarray, contour: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple:
    """raster.edges of vertices in order of plane, contour and place, without nearly level ones: plane, contour's number, both ends;
    and each contour's left-most column."""
    first = np.flatnonzero(np.r_[True, (plane[1:] != plane[:-1]) | (contour[1:] != contour[:-1])])
    size = np.diff(np.append(first, len(r)))
    ring, after = np.repeat(np.arange(len(first)), size), np.arange(len(r)) + 1
    after[first + size - 1] = first
    ok = (size[ring] >= 3) & (np.abs(r - r[after]) > 1e-8 + 1e-5 * np.abs(r[after])) & np.isfinite(c + c[after])
    after = after[ok]
    return (plane[ok], ring[ok], r[ok], c[ok], r[after], c[after]), np.maximum(np.floor(np.minimum.reduceat(c, first)), 0)


def _crossed(edges: tuple, sub: int, rows: int) -> tuple:
    """Where the lines at (i + 0.5) / sub of every row cross edges: plane, contour's number, line, column."""
    plane, ring, r0, c0, r1, c1 = edges
    first = np.maximum(np.floor(np.minimum(r0, r1) * sub) - 1, 0).astype(np.int64)
    last = np.minimum(np.floor(np.maximum(r0, r1) * sub) + 1, rows * sub - 1).astype(np.int64)
    at, g = _each(first, last + 1)
    r = g // sub
    y = r + (g - r * sub + 0.5) / sub
    r0, c0, r1, c1 = r0[at], c0[at], r1[at], c1[at]
    ok = (r0 > y) != (r1 > y)
    x = (c1[ok] - c0[ok]) * (y[ok] - r0[ok]) / (r1[ok] - r0[ok]) + c0[ok]
    at = at[ok]
    return plane[at], ring[at], g[ok], x


def _from_right(line: np.ndarray, x: np.ndarray) -> tuple:
    """The order of crossings by line, from the right; each one's line and place in it."""
    order = np.lexsort((-x, line))
    line, n = line[order], np.arange(len(x))
    return order, line, n - np.maximum.accumulate(np.where(np.r_[True, line[1:] != line[:-1]], n, 0)) if len(x) else n


def box_of(r: np.ndarray, c: np.ndarray, rows: int, cols: int) -> tuple[int, int, int, int]:
    """Rows and columns of the grid around vertices, ends excluded, with two more on every side: all crossings and neighbours are in it or
    beyond the grid."""
    ends = lambda v, n: (max(int(np.floor(np.nanmin(v))) - 2, 0), min(int(np.ceil(np.nanmax(v))) + 3, n))
    return *ends(r, rows), *ends(c, cols)


def shares(plane: np.ndarray, contour: np.ndarray, r: np.ndarray, c: np.ndarray, box: tuple[int, int, int, int], rows: int, sub: int) -> Iterator[tuple]:
    """sampling.occupancy of vertices in cells of the fine grid, in order of plane (from 0), contour and place: planes, rows, columns and
    shares of the cells of a mask in their box, as many planes at a time as make up CELLS."""
    lo_r, lo_c, n_r, n_c = box[0], box[2], box[1] - box[0], box[3] - box[2]
    if n_r <= 0 or n_c <= 0:
        return
    edges, left = _edges(plane, contour, r, c)
    few = max(1, CELLS // (n_r * n_c))
    for p0 in range(0, int(plane[-1]) + 1, few):
        some = (edges[0] >= p0) & (edges[0] < p0 + few)
        if not some.any():
            continue
        near = (edges[0][some] - p0, *(v[some] for v in edges[1:]))
        n_p = int(near[0].max()) + 1
        mask = _mask(near, left, n_p, rows, lo_r, n_r, lo_c, n_c)
        hits = _hits(near, sub, n_p, rows, lo_r, n_r, lo_c, n_c)
        wide = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
        inner = wide[:, 1:-1, :-2] & wide[:, 1:-1, 2:] & wide[:, :-2, 1:-1] & wide[:, 2:, 1:-1]
        share = np.where(inner, 1.0, hits / float(sub * sub))[mask]
        at = np.nonzero(mask)
        yield at[0] + p0, at[1] + lo_r, at[2] + lo_c, share


def _mask(edges: tuple, left: np.ndarray, n_p: int, rows: int, lo_r: int, n_r: int, lo_c: int, n_c: int) -> np.ndarray:
    plane, ring, r, x = _crossed(edges, 1, rows)
    # a contour that crosses a line oddly is closed at its left-most column
    key, n = np.unique(ring * rows + r, return_counts=True)
    odd = key[n % 2 == 1]
    if len(odd):
        of = np.zeros(len(left), np.int64)
        of[ring] = plane
        plane, r, x = np.r_[plane, of[odd // rows]], np.r_[r, odd % rows], np.r_[x, left[odd // rows]]
    order, line, no = _from_right(plane * n_r + r - lo_r, x)
    x = x[order]
    at = np.flatnonzero((no[:-1] % 2 == 0) & (line[1:] == line[:-1]))
    low, high = (np.clip(np.ceil(v - 0.5).astype(np.int64) - lo_c, 0, n_c) for v in (x[at + 1], x[at]))
    width, size = n_c + 1, n_p * n_r * (n_c + 1)
    step = np.bincount(line[at] * width + low, minlength=size) - np.bincount(line[at] * width + high, minlength=size)
    return np.cumsum(step.reshape(n_p, n_r, width), axis=2)[:, :, :n_c] > 0


def _hits(edges: tuple, sub: int, n_p: int, rows: int, lo_r: int, n_r: int, lo_c: int, n_c: int) -> np.ndarray:
    """How many of the sub x sub points of each cell are inside: the signs of the crossings right of them, added up."""
    plane, _, g, x = _crossed(edges, sub, rows)
    order, line, no = _from_right(plane * (rows * sub) + g, x)
    x, sign = x[order], np.where(no % 2 == 0, 1.0, -1.0)
    row = line // (rows * sub) * n_r + line % (rows * sub) // sub - lo_r
    cell = np.floor(x)
    # points of the crossed cell left of x; exact by comparison with the points beside the quotient
    j = np.clip(np.ceil((x - cell) * sub - 0.5), 0, sub)
    point = lambda i: cell + (i + 0.5) / sub
    part = np.where(x > cell, j + ((j < sub) & (point(j) < x)) - ((j > 0) & (point(j - 1) >= x)), 0.0)
    width, size = n_c + 2, n_p * n_r * (n_c + 2)
    to = row * width + np.clip(cell - lo_c, -1, n_c).astype(np.int64) + 1
    whole, part = (np.bincount(to, sign * v, size).reshape(n_p, n_r, width) for v in (float(sub), part))
    right = np.cumsum(whole[:, :, ::-1], axis=2)[:, :, ::-1] - whole
    return (right + part)[:, :, 1:-1]


class Doses:
    """The dose planes (z, cells) of a group, read at the centres of fine cells in a box as voxels.between_planes does; what a plane has there
    is kept as long as slices lie beside it."""

    def __init__(self, table: pa.Table, scale: float, box: tuple[int, int, int, int], rows: int, cols: int) -> None:
        z = table.column("z").to_numpy()
        self.order = np.argsort(z, kind="stable")
        self.z, self.cells, self.grid, self.box, self.scale, self.held = z[self.order], table.column("cells").combine_chunks(), (rows, cols), box, scale, {}

    def _plane(self, i: int) -> np.ndarray:
        rows, cols = self.grid
        plane, cells = np.zeros((rows, cols)), self.cells[int(self.order[i])].values
        if cells is not None:
            np.add.at(plane, tuple(cells.field(x).to_numpy() for x in ("r", "c")), cells.field("d").to_numpy())
        y, x = ((np.arange(*ends) + 0.5) / self.scale for ends in (self.box[:2], self.box[2:]))
        r0, c0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        fr, fc = (y - r0)[:, None], (x - c0)[None]
        r1, c1 = np.minimum(r0 + 1, rows - 1), np.minimum(c0 + 1, cols - 1)
        r0, c0 = np.minimum(r0, rows - 1), np.minimum(c0, cols - 1)
        of = lambda a, b, w: w * plane[np.ix_(a, b)]
        got = of(r0, c0, (1 - fr) * (1 - fc)) + of(r0, c1, (1 - fr) * fc) + of(r1, c0, fr * (1 - fc)) + of(r1, c1, fr * fc)
        return np.where((y <= rows - 1)[:, None] & (x <= cols - 1)[None], got, 0.0).ravel()

    def at(self, z: float, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Doses of cells of the box at one height."""
        n, under, below = len(self.z), int(np.searchsorted(self.z, z, "left")), int(np.searchsorted(self.z, z, "right"))
        i = 1 if n == 1 else max(under, min(below, 1))
        if not 0 < i < n and n != 1:
            return np.zeros(len(r))
        self.held = {j: x for j, x in self.held.items() if j >= i - 2}
        for j in (i - 1, i)[:n]:
            if j not in self.held:
                self.held[j] = self._plane(j)
        flat = (r - self.box[0]) * (self.box[3] - self.box[2]) + c - self.box[2]
        low = self.held[i - 1][flat]
        if n == 1:
            return low
        t = (z - self.z[i - 1]) / (self.z[i] - self.z[i - 1])
        return (1 - t) * low + t * self.held[i][flat]


def _curve(key: list[int], samples: Iterable[tuple[np.ndarray, np.ndarray]], max_dose: float, width: float) -> pa.Table:
    """dvh.curves of samples (doses, weights) on an axis that ends at max_dose."""
    w = max(width, 1e-6)
    n_bins = int(np.ceil(max(max_dose, width) / w))
    hist, count, total, least, most, held, size = np.zeros(n_bins), np.zeros(n_bins, np.int64), 0.0, np.inf, -np.inf, [], 0

    def add():
        nonlocal hist, count, total, least, most
        dose, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        up = np.fmax(0.0, dose)
        b = np.floor(up / w)
        b = np.minimum(b - (b * w > up) + ((b + 1) * w <= up), n_bins - 1).astype(np.int64)
        hist, count = hist + np.bincount(b, weight, n_bins), count + np.bincount(b, minlength=n_bins)
        total, least, most = total + float(np.sum(dose * weight)), min(least, float(dose.min())), max(most, float(dose.max()))

    for x in samples:
        good = x[1] > 0
        x = x if good.all() else (x[0][good], x[1][good])
        if len(x[0]):
            held.append(x)
            size += len(x[0])
        if size > CELLS:
            add()
            held, size = [], 0
    if held:
        add()
    some = np.flatnonzero(count)
    if not len(some):
        return _CURVE.empty_table()
    above = np.cumsum(hist[some][::-1])[::-1]
    steps = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.StructArray.from_arrays([pa.array(some.astype(np.int32)), pa.array(above)], fields=list(_STEPS)))
    volume = float(above[0])
    one = [[key[0]], [key[1]], [volume], [total / volume], [least], [most], [int(count.sum())], [n_bins]]
    return pa.Table.from_arrays([*(pa.array(v, t) for v, t in zip(one, _CURVE.types, strict=False)), steps], schema=_CURVE)


def dose_planes(ranges: DataFrame, dose: DataFrame, planes: DataFrame, rows: int, cols: int) -> DataFrame:
    """Each structure's (S, low, high) share of the dose: a row for every plane (patient_id, k, z) of the patient; cells, its doses, are
    null for planes that no height from low to high lies beside."""
    w = Window.partitionBy(P).orderBy("z")
    beside = planes.withColumn("before", F.lag("z").over(w)).withColumn("after", F.lead("z").over(w))
    v = dose.filter(F.col("dose_gy").isNotNull() & (F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols))
    cell = F.struct(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("dose_gy").cast("double").alias("d"))
    x = beside.join(merged(v.groupBy(P, "k").agg(F.collect_list(cell).alias("cells"))), [P, "k"], "left").join(merged(ranges), P)
    near = F.coalesce(F.col("after") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("before") <= F.col("high"), F.lit(True))
    return x.select(*(F.col(c).cast("long").alias(c) for c in S), F.col("z").cast("double").alias("z"), F.when(near, F.col("cells")).alias("cells"))


def by_plane(found: Iterable[tuple]) -> Iterator[tuple]:
    """shares() one plane at a time: its number, rows, columns and shares."""
    for plane, *rest in found:
        ends = np.flatnonzero(np.r_[True, plane[1:] != plane[:-1], True]) if len(plane) else []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield int(plane[a]), *(x[a:b] for x in rest)


def curves(points: DataFrame, dose: DataFrame, planes: DataFrame, rows: int, cols: int, width: float, slabs: Callable, slack: Column | float = 0.0) -> DataFrame:
    """dvh.curves of every structure with a dose: points (S, z, thickness and what slabs asks) and, in their task, the planes beside them.

    slabs(table) gives the scale of the fine grid, the box of its cells and an iterator of (heights, weights of a whole cell, rows,
    columns, shares): cells of one slice, which are samples at each of its heights. These rise but for offsets in a slab, and lie up to
    slack beyond the slabs of points.
    Structures are dealt to as many tasks as the session sets, as small tables become many samples."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = dose.groupBy(P).agg(F.coalesce(F.max("dose_gy").cast("double"), F.lit(0.0)).alias("max_dose"))
    x = points.join(merged(top), P)
    ends = x.groupBy(*S).agg(F.min(F.col("z") - F.col("thickness") / 2 - slack).alias("low"), F.max(F.col("z") + F.col("thickness") / 2 + slack).alias("high"))
    near = dose_planes(ends, dose, planes, rows, cols).repartition(parts, *S)

    def run(table, grids):
        if not table.num_rows or not grids.num_rows:
            return _CURVE.empty_table()
        key = [table.column(c)[0].as_py() for c in S]
        scale, box, cut = slabs(table)
        doses = Doses(grids, scale, box, rows, cols)
        samples = ((doses.at(z, r, c), share * weight) for heights, weights, r, c, share in cut for z, weight in zip(heights, weights, strict=True))
        return _curve(key, samples, table.column("max_dose")[0].as_py(), width)

    of = x.select(*(F.col(c).cast("long").alias(c) for c in S), *(c for c in x.columns if c not in S)).repartition(parts, *S)
    return of.groupBy(*S).cogroup(near.groupBy(*S)).applyInArrow(run, CURVE)
