"""Small structures: a model between slices (G18), curves from it (D5), and each structure's curve by its strategy.

A structure with one contour a slice becomes rings of equally many points, turned to fit the slice before, between which further
slices are interpolated, closed by a point half a slab beyond either end. Where a slice has several contours, signed
distances of the filled planes are interpolated. Both go structure by structure (a few cubic centimetres at most, so a
group is small), with the shares of its cells and its samples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import merged
from . import fine, voxels
from .surfaces import plane_squares

P = "patient_id"
S = [P, "structure_id"]
# How finely small structures are made.
SCALE, SUB, WIDTH, LEAST_POINTS, LEAST_STEP_MM = 8, 10, 0.01, 64, 0.05
#: Points of turned rings that are compared at a time.
TURNS = 1 << 16


def resampled(ring: np.ndarray, n: int) -> np.ndarray:
    """N points at equal distances along a closed ring (points, 2), from its first point on."""
    closed = np.vstack([ring, ring[:1]])
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))])
    if along[-1] <= 1e-6:
        return np.repeat(ring[:1], n, axis=0)
    at = np.arange(n) * (along[-1] / n)
    return np.stack([np.interp(at, along, closed[:, j]) for j in (0, 1)], 1)


def turned(ring: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """A ring with its columns-to-rows area positive, begun where it fits the ring before best (the first such point)."""
    r, c = ring.T
    if np.sum(c * np.roll(r, -1) - np.roll(c, -1) * r) < 0:
        ring = ring[::-1]
    if before is None:
        return ring
    n = len(ring)
    some, misfit = max(1, TURNS // n), np.empty(n)
    for first in range(0, n, some):
        shift = np.arange(first, min(first + some, n))
        gone = before - ring[(np.arange(n) - shift[:, None]) % n]
        misfit[shift] = np.sum((gone * gone).reshape(len(shift), -1), axis=1)
    return np.roll(ring, int(np.argmin(misfit)), axis=0)


def levels(z: np.ndarray, thickness: np.ndarray, base: float, scale: float) -> tuple[np.ndarray, float]:
    """The heights of the interpolated slices and their step: base / scale about, over all slabs."""
    steps = np.diff(np.unique(z))
    base = min([base, *steps[steps > 1e-6].tolist()])
    low, high, step = z[0] - thickness[0] / 2, z[-1] + thickness[-1] / 2, max(base / scale, LEAST_STEP_MM)
    high = high if high > low else low + step
    n = max(1, int(np.ceil((high - low) / step)))
    return low + (np.arange(n) + 0.5) * ((high - low) / n), (high - low) / n


def _between(z: np.ndarray, at: float) -> tuple[int, int, float]:
    """The two anchors around a height and the share of the upper one; the ends reach outwards."""
    if at <= z[0] or at >= z[-1]:
        i = 0 if at <= z[0] else len(z) - 1
        return i, i, 0.0
    i = int(np.searchsorted(z, at, side="right"))
    return i - 1, i, (at - z[i - 1]) / (z[i] - z[i - 1]) if z[i] > z[i - 1] + 1e-6 else 0.0


def _stack(t: pa.Table, scale: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Interpolated slices of a structure with one contour a slice (i, r, c, z, thickness, base; in order of z and i): their heights, step
    and rings (slice, point, 2)."""
    z_all, rc = t.column("z").to_numpy(), np.stack([t.column(x).to_numpy() for x in ("r", "c")], 1)
    z, first = np.unique(z_all, return_index=True)
    parts = np.split(rc, first[1:])
    n = max(LEAST_POINTS, *map(len, parts))
    made = []
    for part in parts:
        made.append(turned(resampled(part, n), made[-1] if made else None))
    thickness = t.column("thickness").to_numpy()[first]
    heights, step = levels(z, thickness, float(t.column("base")[0].as_py()), scale)
    caps = [np.repeat(made[j].mean(axis=0)[None], n, axis=0) for j in (0, -1)]
    stack = np.stack([caps[0], *made, caps[1]])
    anchors = np.r_[z[0] - thickness[0] / 2, z, z[-1] + thickness[-1] / 2]
    out = []
    for at in heights:
        a, b, share = _between(anchors, at)
        out.append(stack[a] * (1 - share) + stack[b] * share)
    return heights, step, np.stack(out)


def rings(points: DataFrame, scale: float = SCALE) -> DataFrame:
    """Interpolated slices of structures with one contour a slice: points (SLICE, i, r, c, z, thickness, base) to contour rows with
    the new slices' k, z and step."""

    def run(table):
        heights, step, stack = _stack(table.sort_by([("z", "ascending"), ("i", "ascending")]), scale)
        m, n, _ = stack.shape
        flat = stack.reshape(m * n, 2)
        one = [pa.array(np.full(m * n, table.column(c)[0].as_py())) for c in S]
        rest = np.repeat(np.arange(m), n), np.zeros(m * n, np.int32), np.tile(np.arange(n, dtype=np.int32), m), flat[:, 0], flat[:, 1], np.repeat(heights, n), np.full(m * n, step)
        return pa.Table.from_arrays([*one, *map(pa.array, rest)], names=[*S, "k", "contour_no", "i", "r", "c", "z", "step"])

    x = points.select(*(F.col(c).cast("long").alias(c) for c in S), F.col("i").cast("int").alias("i"), *(F.col(c).cast("double").alias(c) for c in ("r", "c", "z", "thickness", "base")))
    return x.groupBy(*S).applyInArrow(run, f"{P} long, structure_id long, k long, contour_no int, i int, r double, c double, z double, step double")


def filled(mask: np.ndarray) -> np.ndarray:
    """A plane with the background that side-by-side cells do not join to its edge."""
    free = np.pad(~mask, 1, constant_values=True)
    seen = np.zeros_like(free)
    seen[0] = True
    while True:
        wider = seen.copy()
        wider[1:] |= seen[:-1]
        wider[:-1] |= seen[1:]
        wider[:, 1:] |= seen[:, :-1]
        wider[:, :-1] |= seen[:, 1:]
        wider &= free
        if (wider == seen).all():
            return ~seen[1:-1, 1:-1]
        seen = wider


def _solid(z: np.ndarray, thickness: np.ndarray, base: float, cells: Iterable[tuple], sx: float, sy: float, scale: float) -> tuple[np.ndarray, float, Iterator[tuple]]:
    """Interpolated slices of a structure with several contours in a slice: from the occupied cells (plane, r, c) of its planes at z, by signed
    distance of the filled planes: heights, step, and the cells of each new slice that has any (k, r, c)."""
    plane, r, c = (np.concatenate(x) for x in zip(*cells, strict=True))
    known, at = np.unique(plane, return_inverse=True)
    if not len(known):
        return z[:0], 0.0, iter(())
    z, thickness = z[known], thickness[known]
    masks = np.zeros((len(z), r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
    masks[at, r - r.min(), c - c.min()] = True
    masks = np.stack([filled(m) for m in masks])
    # a plane without background is deep inside everywhere
    deep = lambda m: np.sqrt(np.minimum(plane_squares(~m, sx / scale, sy / scale), 1e18))
    signed = [np.sqrt(plane_squares(m, sx / scale, sy / scale)) - deep(m) for m in masks]
    heights, step = levels(z, thickness, base, scale)

    def cut():
        for k, height in enumerate(heights):
            a, b, share = _between(z, height)
            rr, cc = np.nonzero(masks[a] if a == b else signed[a] * (1 - share) + signed[b] * share <= 0)
            if len(rr):
                yield k, rr + r.min(), cc + c.min()

    return heights, step, cut()


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("z", "ascending"), ("contour_no", "ascending"), ("i", "ascending")])


def _made(t: pa.Table, rows: int, cols: int, sx: float, sy: float, scale: int, sub: int) -> tuple[np.ndarray, float, tuple, Iterator[tuple]]:
    """G18 of one structure's points (k, contour_no, i, r, c, z, thickness, base; _sorted): the heights of its slices, their step, the box of
    its cells and, slice by slice, their numbers, rows, columns and shares."""
    high, wide, contour = rows * scale, cols * scale, t.column("contour_no").to_numpy()
    z_all = t.column("z").to_numpy()
    z, first, plane = np.unique(z_all, return_index=True, return_inverse=True)
    if not np.any((plane[1:] == plane[:-1]) & (contour[1:] != contour[:-1])):
        heights, step, stack = _stack(t, float(scale))
        m, n, _ = stack.shape
        r, c = (stack[:, :, j].ravel() * float(scale) for j in (0, 1))
        box = fine.box_of(r, c, high, wide)
        found = fine.by_plane(fine.shares(np.repeat(np.arange(m), n), np.zeros(m * n, np.int64), r, c, box, high, sub))
        return heights, step, box, ((k, *(x[share > 1e-6] for x in (rr, cc, share))) for k, rr, cc, share in found)
    r, c = (t.column(x).to_numpy() * float(scale) for x in ("r", "c"))
    box = fine.box_of(r, c, high, wide)
    cells = [(p[share > 1e-6], rr[share > 1e-6], cc[share > 1e-6]) for p, rr, cc, share in fine.shares(plane, contour, r, c, box, high, sub)]
    none = np.zeros(0, np.int64)
    heights, step, found = _solid(z, t.column("thickness").to_numpy()[first], float(t.column("base")[0].as_py()), cells or [(none, none, none)], sx, sy, scale)
    return heights, step, box, ((k, rr, cc, np.ones(len(rr))) for k, rr, cc in found)


def _placed(points: DataFrame, positions: DataFrame) -> DataFrame:
    x = points.join(merged(positions), [P, "k"])
    return x.select(*(F.col(c).cast("long").alias(c) for c in (*S, "k")), *(F.col(c).cast("int").alias(c) for c in ("contour_no", "i")), *(F.col(c).cast("double").alias(c) for c in ("r", "c", "z", "thickness", "base")))


def model(points: DataFrame, positions: DataFrame, rows: int, cols: int, sx: float, sy: float, scale: int = SCALE, sub: int = SUB) -> DataFrame:
    """The interpolated model of every structure of points as shares of cells of a grid `scale` times finer: (S, k, r, c, share, z,
    step). positions (patient_id, k, z, thickness, base) places slices; base is the smallest step of slices and dose planes.

    What is shuffled are the points: rings and cells are made in the task of their structure, as many tasks as the session sets."""
    schema = pa.schema([*((c, pa.int64()) for c in (*S, "k", "r", "c")), *((c, pa.float64()) for c in ("share", "z", "step"))])

    def run(table):
        heights, step, _, found = _made(_sorted(table), rows, cols, sx, sy, scale, sub)
        found = list(found)
        if not found:
            return schema.empty_table()
        k = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
        r, c, share = (np.concatenate([x[j] for x in found]) for j in (1, 2, 3))
        one = [np.full(len(k), table.column(x)[0].as_py()) for x in S]
        return pa.Table.from_arrays([*map(pa.array, (*one, k, r, c, share, heights[k], np.full(len(k), step)))], schema=schema)

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(points, positions).repartition(parts, *S).groupBy(*S).applyInArrow(run, f"{P} long, structure_id long, k long, r long, c long, share double, z double, step double")


def curves(points: DataFrame, positions: DataFrame, dose: DataFrame, planes: DataFrame, rows: int, cols: int, sx: float, sy: float, width: float = WIDTH) -> DataFrame:
    """Dvh.curves of the interpolated models, each cell a sample at its height between two dose planes, on axes that end at the grid's
    largest dose."""

    def slabs(table):
        heights, step, box, found = _made(_sorted(table), rows, cols, sx, sy, SCALE, SUB)
        weight = np.array([sx * sy / SCALE**2 * step / 1000])
        return float(SCALE), box, ((heights[k : k + 1], weight, *cells) for k, *cells in found)

    # a structure without thickness is one step high at least
    return fine.curves(_placed(points, positions), dose, planes, rows, cols, width, slabs, F.col("base") / SCALE + LEAST_STEP_MM)


def voxel_totals(spans: DataFrame, dose: DataFrame, voxel_cc: float) -> DataFrame:
    """D4 as totals: the grid's own voxels within a mask, all of one weight."""
    m = voxels.masked(dose, spans).groupBy(P, F.col("structure_id").alias("structure"))
    return m.agg((F.count("*") * voxel_cc).alias("volume_cc"), F.avg("dose_gy").alias("mean_gy"), F.min("dose_gy").alias("min_gy"), F.max("dose_gy").alias("max_gy"))


def by_strategy(strategies: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Strategies (sampling.strategy, with place) and, for each strategy, totals (patient_id, structure, volume_cc, mean_gy, min_gy,
    max_gy) of its structures: one row for each structure in the order of the structures."""
    totals = None
    for name, of in branches.items():
        t = of.select(P, F.col("structure").alias("structure_id"), F.lit(name).alias("strategy"), "volume_cc", "mean_gy", "min_gy", "max_gy")
        totals = t if totals is None else totals.unionByName(t)
    x = strategies.drop("volume_cc").join(totals, [P, "structure_id", "strategy"])
    return x.withColumn("place", F.row_number().over(Window.partitionBy(P).orderBy("structure_id")))
