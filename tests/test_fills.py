"""Cavities and isodose volumes near a structure against plain loops."""

import math
import random
from itertools import product

import numpy as np

from fluence.operators import fills, raster

BOX = "patient_id long, structure_id long, k0 long, k1 long, r0 long, r1 long, c0 long, c1 long"
SIDES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def flooded(mask, shape, sides=SIDES):
    """Cells that no path of free cells joins to a face (by sides), by a plain search."""
    every = set(product(*map(range, shape)))
    face = {p for p in every if any((p[i] in (0, shape[i] - 1)) for i in range(3) if any(s[i] for s in sides))}
    todo = [p for p in face if p not in mask]
    seen = set(todo)
    while todo:
        p = todo.pop()
        for d in sides:
            q = tuple(x + y for x, y in zip(p, d, strict=True))
            if q in every and q not in mask and q not in seen:
                seen.add(q)
                todo.append(q)
    return every - seen


def got_cells(df):
    out = {}
    for r in raster.cells(df).collect():
        out.setdefault(r.structure_id, set()).add((r.k, r.r, r.c))
    return out


def test_cavities_against_a_plain_search(spark):
    """Random masks of several densities, a closed shell, and one that leaks through another slice only; boxes away from 0."""
    rng, masks, shape = random.Random(4), {}, (6, 7, 8)
    for no in range(24):
        share = 0.5 + no % 6 * 0.08
        masks[no] = {p for p in product(*map(range, shape)) if rng.random() < share}
    shell = {p for p in product(range(1, 5), range(1, 6), range(1, 7)) if p[0] in (1, 4) or p[1] in (1, 5) or p[2] in (1, 6)}
    masks[100], masks[101] = shell, shell - {(1, 3, 3)}
    shift = (3, -2, 11)
    rows = [(1, no, *(int(x + y) for x, y in zip(p, shift, strict=True)), 5) for no, m in masks.items() for p in m]
    df = spark.createDataFrame(rows + rows[:50], "patient_id long, structure_id long, k long, r long, c long, extra int")
    blocks = spark.createDataFrame([(1, no, *(v for i in range(3) for v in (shift[i], shift[i] + shape[i] - 1))) for no in masks], BOX)
    got = got_cells(fills.filled_volumes(fills.as_spans(df), blocks))
    back = {no: {tuple(x - y for x, y in zip(p, shift, strict=True)) for p in cells} for no, cells in got.items()}
    for no, m in masks.items():
        assert back[no] == flooded(m, shape), no
    assert len(back[100]) == 4 * 5 * 6 and back[101] == masks[101]
    assert sum(len(back[no]) > len(m) for no, m in masks.items()) > 10


def test_spans_that_overlap_stand_outside_or_are_missing(spark):
    spans = spark.createDataFrame([(1, 1, 0, 0, -5, 2), (1, 1, 0, 0, 1, 4), (1, 1, 9, 0, 0, 2), (1, 2, 0, 0, 0, 1)], "patient_id long, structure_id long, k long, r long, c_lo long, c_hi long")
    blocks = spark.createDataFrame([(1, 1, 0, 1, 0, 1, 0, 5)], BOX)
    assert [tuple(r) for r in fills.filled_volumes(spans, blocks).collect()] == [(1, 1, 0, 0, 0, 4)]
    assert fills.filled_volumes(spans.limit(0), blocks).collect() == []


def test_margin_isodose_against_plain_loops(spark):
    rng, (slices, rows, cols), (sx, sy, sz), margin = random.Random(9), (6, 9, 9), (2.0, 2.5, 3.0), 4.0
    masks = {1: {(k, r, c) for k in (2, 3) for r in range(3, 6) for c in range(2, 6)}, 2: {(0, 0, 0)}, 3: {(5, 4, c) for c in (4, 6)}}
    dose = {p: 20 + 10 * math.sin(p[0] + p[1] * 0.8) + rng.random() * 8 for p in product(range(slices), range(rows), range(cols)) if rng.random() < 0.9}
    thresholds = [(1, 18.0), (1, 24.0), (2, 15.0), (3, 22.0), (3, 0.0), (4, 5.0), (1, 18.0)]
    spans = fills.as_spans(spark.createDataFrame([(7, s, *p) for s, m in masks.items() for p in m], "patient_id long, structure_id long, k long, r long, c long"))
    voxels = spark.createDataFrame([(7, *p, d) for p, d in dose.items()], "patient_id long, k long, r long, c long, dose_gy double")
    targets = spark.createDataFrame([(7, s, t, 0) for s, t in thresholds], "patient_id long, structure_id long, threshold_gy double, volume_cc int")
    got = sorted(tuple(r)[1:] for r in fills.margin_isodose(targets, spans, voxels, margin, sx, sy, sz, slices, rows, cols).collect())

    def plain(s, t):
        if t <= 0 or s not in masks:
            return 0.0, 0.0
        steps, size, m = (sz, sy, sx), (slices, rows, cols), masks[s]
        lo = [max(0, min(p[i] for p in m) - math.ceil(margin / steps[i])) for i in range(3)]
        hi = [min(size[i] - 1, max(p[i] for p in m) + math.ceil(margin / steps[i])) for i in range(3)]
        shape = tuple(b - a + 1 for a, b in zip(lo, hi, strict=True))
        d = np.zeros(shape)
        for p in product(*map(range, shape)):
            d[p] = dose.get(tuple(a + b for a, b in zip(p, lo, strict=True)), 0.0)
        hot = {p for p in product(*map(range, shape)) if d[p] >= t}
        near = {p for p in product(*map(range, shape)) if min(sum(((p[i] + lo[i] - q[i]) * steps[i]) ** 2 for i in range(3)) for q in m) <= margin**2}
        flat, solid = flooded(hot, shape, SIDES[2:]), flooded(hot, shape)
        slope = [np.gradient(d, h, axis=i) if shape[i] > 1 else np.zeros(shape) for i, h in enumerate(steps)]
        steep = np.maximum(np.sqrt(sum(x * x for x in slope)), 1e-3)
        share = np.clip(0.5 + (d - t) / steep / math.sqrt(sum(h * h for h in steps)), 0, 1)
        cc = sx * sy * sz / 1000
        return len(flat & near) * cc, sum(1.0 if p in solid else share[p] for p in near) * cc

    want = sorted((s, t, *plain(s, t)) for s, t in thresholds)
    assert len(got) == len(want) == 7
    assert np.allclose(np.array(got), np.array(want), atol=1e-9), (got, want)
    assert fills.margin_isodose(targets.limit(0), spans, voxels, margin, sx, sy, sz, slices, rows, cols).collect() == []
