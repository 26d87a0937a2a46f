"""Distances in three dimensions and ownership against plain loops over all cells."""

import numpy as np
import pytest
from fluence.operators import surfaces

SX, SY, SZ = 1.5, 2.0, 3.25
SHAPE = 5, 9, 10
SPANS = "patient_id long, structure_id long, k long, r long, c_lo long, c_hi long"
AXES = [a.ravel() for a in np.indices(SHAPE)]
CELLS = np.stack(AXES, 1)
AT = CELLS * [SZ, SY, SX]


def random_masks(seed=3):
    rng = np.random.default_rng(seed)
    masks = {s: np.zeros(SHAPE, bool) for s in (1, 2, 3, 4)}
    masks[1][1:4, 2:7, 1:6] = masks[2][0:3, 3:8, 4:9] = masks[3][2:5, 0:5, 5:10] = True
    masks[3] &= rng.random(SHAPE) < 0.7
    masks[4][2, 4, 3] = True
    return masks


def table(spark, masks, patient=1):
    rows = [(patient, s, *map(int, (k, r, c)), int(c) + 1) for s, m in masks.items() for k, r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, SPANS)


def far(mask, among):
    """The distance of every cell to the nearest of `among`, of the grid's cells where it is true."""
    hit = AT[(mask & among).ravel()]
    return np.sqrt(((AT[:, None] - hit[None]) ** 2).sum(2).min(1)).reshape(SHAPE) if len(hit) else np.full(SHAPE, np.inf)


def block_of(box):
    inside = np.zeros(SHAPE, bool)
    inside[box[0] : box[1] + 1, box[2] : box[3] + 1, box[4] : box[5] + 1] = True
    return inside


def weights(masks, target, rivals, box, margin=None):
    here = block_of(box)
    out = {s: far(masks[s], here) for s in rivals}
    surface = {s: np.where(masks[s], far(~masks[s], here), out[s]) for s in rivals}
    if margin is None and len(rivals) == 1:
        return here.astype(float)
    d = np.stack([surface[s] if margin is None else np.where(out[s] <= margin, surface[s], np.inf) for s in rivals])
    low = d.min(0)
    tied = np.isfinite(d) & (d <= low + 1e-6 + 1e-5 * low)
    return np.where(here & tied[rivals.index(target)], 1 / np.maximum(tied.sum(0), 1), 0.0)


def box_of(mask):
    return [int(v) for a in np.nonzero(mask) for v in (a.min(), a.max())]


def around(boxes):
    b = np.array(boxes)
    return [int(f(b[:, i])) for i, f in enumerate([np.min, np.max] * 3)]


def owned(df):
    got = {}
    for r in df.collect():
        for i, w in enumerate(r.weights):
            if w > 0:
                got[r.structure_id, r.k, r.r, r.c0 + i] = w
    return got


def listed(target, w):
    return {(target, *map(int, x)): float(w[tuple(x)]) for x in np.argwhere(w > 0)}


def rivals_of(spark, pairs):
    return spark.createDataFrame([(1, a, b) for a, b in pairs], "patient_id long, target long, rival long")


def test_envelope_is_the_minimum_of_parabolas():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        x = np.cumsum(rng.random(n) + 0.1)
        f = np.where(rng.random((n, 50)) < 0.4, np.inf, rng.random((n, 50)) * 20)
        assert np.allclose(surfaces.envelope(f, x), (f[None] + ((x[:, None] - x[None]) ** 2)[:, :, None]).min(1))


def test_distances_inside_and_outside(spark):
    masks = random_masks()
    blocks = spark.createDataFrame([(1, s, 0, 4, 1, 8, 0, 9) for s in masks] + [(1, 9, 0, 1, 0, 1, 0, 1)], "patient_id long, structure_id long, k0 int, k1 int, r0 int, r1 int, c0 int, c1 int")
    got = surfaces.distances(table(spark, masks), blocks, SX, SY, SZ).collect()
    here = block_of((0, 4, 1, 8, 0, 9))
    assert len(got) == 4 * here.sum()
    want = {s: (far(m, here), np.where(m, far(~m, here), 0.0)) for s, m in masks.items()}
    for r in got:
        o, i = (w[r.k, r.r, r.c] for w in want[r.structure_id])
        assert r.outside == pytest.approx(o) and r.inside == pytest.approx(i)


def test_a_mask_that_fills_its_block_has_no_inside(spark):
    one = table(spark, {1: np.ones(SHAPE, bool)})
    blocks = surfaces.boxes(one)
    got = surfaces.distances(one, blocks, SX, SY, SZ).select("outside", "inside").distinct().collect()
    assert [tuple(r) for r in got] == [(0.0, None)]
    assert surfaces.distances(one.limit(0), blocks.limit(0), SX, SY, SZ).collect() == []


def test_ownership_by_unsigned_distance(spark):
    """Deep in one target a cell may belong to another; blocks differ between targets; ties are shared; a lone target owns all."""
    masks = random_masks()
    pairs = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 1), (2, 3), (3, 3), (3, 2), (4, 4)]
    boxes = {1: (0, 4, 0, 8, 0, 9), 2: (0, 4, 0, 8, 0, 9), 3: (0, 4, 0, 7, 2, 9), 4: (1, 3, 3, 5, 2, 4)}
    blocks = spark.createDataFrame([(1, s, *b) for s, b in boxes.items()], "patient_id long, structure_id long, k0 int, k1 int, r0 int, r1 int, c0 int, c1 int")
    got = owned(surfaces.owned_lines(table(spark, masks), blocks, rivals_of(spark, pairs), SX, SY, SZ))
    want = {}
    for t, box in boxes.items():
        want |= listed(t, weights(masks, t, [b for a, b in pairs if a == t], box))
    assert got == pytest.approx(want)
    deep = [c for c in np.argwhere(masks[1] & ~masks[2] & ~masks[3]) if (1, *map(int, c)) not in want]
    assert deep  # the rule that this is about


def test_margin_limited_ownership(spark):
    masks, margin = random_masks(), 3.0
    pairs = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    blocks, near = surfaces.margin_blocks(table(spark, masks), rivals_of(spark, pairs), margin, SX, SY, SZ, *SHAPE)
    got = owned(surfaces.owned_lines(table(spark, masks), blocks, near, SX, SY, SZ, margin))
    wide = {}
    for s in (1, 2, 3):
        b = box_of(masks[s])
        steps = [int(np.ceil(margin / x)) for x in (SZ, SY, SX)]
        wide[s] = [max(0, b[0] - steps[0]), min(4, b[1] + steps[0]), max(0, b[2] - steps[1]), min(8, b[3] + steps[1]), max(0, b[4] - steps[2]), min(9, b[5] + steps[2])]
    want = {}
    for t in (1, 2, 3):
        want |= listed(t, weights(masks, t, [1, 2, 3], around(list(wide.values())), margin))
    assert got == pytest.approx(want)


def flood(mask):
    seen = {c for c in np.ndindex(mask.shape) if not mask[c] and (0 in c or c[0] == mask.shape[0] - 1 or c[1] == mask.shape[1] - 1)}
    todo = list(seen)
    while todo:
        r, c = todo.pop()
        for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and not mask[n] and n not in seen:
                seen.add(n)
                todo.append(n)
    return np.array([[(r, c) not in seen for c in range(mask.shape[1])] for r in range(mask.shape[0])])


def test_holes_in_blocks(spark):
    """A closed hole is filled, one that leaks through a winding gap is not, one that only touches a corner is."""
    plane = np.array([[c == "#" for c in row] for row in ["..........", ".####.####", ".#..#.#..#", ".#..#.#.##", ".####.#...", "......####", "#.#.......", ".#.######.", "...#....#.", "...#.####."]])
    rng = np.random.default_rng(4)
    planes = {0: plane, 1: rng.random((10, 10)) < 0.55, 2: rng.random((10, 10)) < 0.65}
    rows = [(1, 5, k, int(r), int(c)) for k, m in planes.items() for r, c in np.argwhere(m)]
    cell = spark.createDataFrame(rows, "patient_id long, structure_id long, k long, r long, c long")
    block = spark.createDataFrame([(1, 5, 0, 1, 1, 9, 0, 9)], "patient_id long, structure_id long, k0 int, k1 int, r0 int, r1 int, c0 int, c1 int")
    got = {(r.k, r.r, r.c) for r in surfaces.filled_in_blocks(cell, block).collect()}
    assert got == {(k, int(r) + 1, int(c)) for k in (0, 1) for r, c in np.argwhere(flood(planes[k][1:]))}


def dose_table(spark, seed=6):
    dose = np.round(np.random.default_rng(seed).random(SHAPE) * 30, 3)
    rows = [(1, *map(int, c), float(dose[tuple(c)])) for c in CELLS]
    return dose, spark.createDataFrame(rows, "patient_id long, k long, r long, c long, dose_gy double")


def test_indices_and_volumes(spark):
    masks, (dose, voxels) = random_masks(), dose_table(spark)
    spans, cc = table(spark, masks), SX * SY * SZ / 1000
    pairs = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    brain = np.zeros(SHAPE, bool)
    brain[:, 1:8, :] = True
    asked = {1: (20.0, 80.0, 1), 2: (25.0, 60.0, 5), 3: (29.5, 0.0, 3)}
    targets = spark.createDataFrame([(1, s, *x) for s, x in asked.items()] + [(1, 8, 20.0, 50.0, 1)], "patient_id long, structure_id long, rx_gy double, coverage_pct double, fractions int")
    inner = table(spark, {1: masks[4]})
    got = {r.structure_id: r for r in surfaces.stereotactic(targets, rivals_of(spark, pairs), spans, voxels, table(spark, {7: brain}), inner, SX, SY, SZ).collect()}
    assert set(got) == {1, 2, 3}
    for s, (rx, cover, fractions) in asked.items():
        gy = {1: 12.0, 5: 24.0}.get(fractions)
        least = min(rx / 2, gy or rx / 2)
        box = around([box_of(dose >= least), *(box_of(masks[b]) for b in (1, 2, 3))])
        w = weights(masks, s, [1, 2, 3], box)
        iso, half, volume = w[dose >= rx].sum() * cc, w[dose >= rx / 2].sum() * cc, masks[s].sum() * cc
        r = got[s]
        assert (r.volume_cc, r.ci, r.gi) == pytest.approx((volume, iso / volume, half / iso if iso else 0.0))
        assert r.pci == pytest.approx((cover / 100) ** 2 * volume / iso if iso else 0.0)
        tissue = brain & ~masks[4] if s == 1 else brain
        assert r.brain_cc == (pytest.approx(w[tissue & (dose >= gy)].sum() * cc) if gy else None)
    asked = spark.createDataFrame([(1, 1, 21.0), (1, 2, 99.0)], "patient_id long, structure_id long, threshold_gy double")
    got = {r.structure_id: r.volume_cc for r in surfaces.threshold_volumes(asked, rivals_of(spark, pairs), spans, voxels, SX, SY, SZ).collect()}
    w = weights(masks, 1, [1, 2, 3], around([box_of(dose >= 21), *(box_of(masks[b]) for b in (1, 2, 3))]))
    assert got == pytest.approx({1: w[dose >= 21].sum() * cc, 2: 0.0})


def test_margin_volumes(spark):
    masks, (dose, voxels) = random_masks(), dose_table(spark, 8)
    pairs, margin = [(a, b) for a in (1, 2) for b in (1, 2)], 3.0
    asked = spark.createDataFrame([(1, 1, 9.0), (1, 2, 99.0)], "patient_id long, structure_id long, threshold_gy double")
    brain = np.zeros(SHAPE, bool)
    brain[:, 1:7, 2:] = True
    args = rivals_of(spark, pairs), table(spark, {s: masks[s] for s in (1, 2)}), voxels, margin, SX, SY, SZ, *SHAPE
    steps = [int(np.ceil(margin / x)) for x in (SZ, SY, SX)]
    grow = lambda b: [max(0, b[0] - steps[0]), min(4, b[1] + steps[0]), max(0, b[2] - steps[1]), min(8, b[3] + steps[1]), max(0, b[4] - steps[2]), min(9, b[5] + steps[2])]
    box = around([grow(box_of(masks[s])) for s in (1, 2)])
    iso = np.zeros(SHAPE, bool)
    for k in range(box[0], box[1] + 1):
        iso[k, box[2] : box[3] + 1, box[4] : box[5] + 1] = flood((dose >= 9)[k, box[2] : box[3] + 1, box[4] : box[5] + 1])
    w = weights(masks, 1, [1, 2], box, margin)
    for extra in (None, brain):
        got = {r.structure_id: r.volume_cc for r in surfaces.margin_volumes(asked, *args, extra=None if extra is None else table(spark, {7: extra})).collect()}
        hit = iso if extra is None else iso & extra
        assert got == pytest.approx({1: w[hit].sum() * SX * SY * SZ / 1000, 2: 0.0})
