"""Interpolated models of small structures against plain loops."""

import math

import numpy as np
import pytest
from fluence.operators import sampling, small

POINTS = "patient_id long, structure_id long, k long, contour_no int, i int, r double, c double"
N, SX, SY = 20, 1.5, 2.0


def circle(r, c, radius, n=40, turn=0.0, back=False):
    a = [turn + 2 * math.pi * j / n for j in range(n)]
    pts = [(r + radius * math.sin(x), c + radius * math.cos(x)) for x in a]
    return pts[::-1] if back else pts


def rows(structure, k, *contours):
    return [(1, structure, k, no, i, float(r), float(c)) for no, pts in enumerate(contours) for i, (r, c) in enumerate(pts)]


def tables(spark, points, zs, thickness, base):
    where = [(1, k, float(z), float(t), float(base)) for k, (z, t) in enumerate(zip(zs, thickness, strict=True))]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(where, "patient_id long, k long, z double, thickness double, base double")


def inside(ring, y, x):
    hit = False
    for (r0, c0), (r1, c1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if abs(r0 - r1) > 1e-8 + 1e-5 * abs(r1) and (r0 > y) != (r1 > y) and x < (c1 - c0) * (y - r0) / (r1 - r0) + c0:
            hit = not hit
    return hit


def walk(ring, n):
    """n points at equal distances along a ring, found by walking."""
    closed = [*ring, ring[0]]
    total = sum(math.dist(a, b) for a, b in zip(closed, closed[1:], strict=False))
    out = []
    for j in range(n):
        left = total * j / n
        for a, b in zip(closed, closed[1:], strict=False):
            d = math.dist(a, b)
            if left <= d:
                out.append([a[0] + (b[0] - a[0]) * left / d, a[1] + (b[1] - a[1]) * left / d])
                break
            left -= d
    return np.array(out)


def plain_rings(slices, zs, thickness, base, scale):
    """(z, step, ring) of every interpolated slice."""
    n, made = max(64, *(len(s) for s in slices)), []
    for s in slices:
        ring = walk(s, n)
        area = sum(ring[i][1] * ring[(i + 1) % n][0] - ring[(i + 1) % n][1] * ring[i][0] for i in range(n))
        ring = ring[::-1] if area < 0 else ring
        if made:
            ring = min((np.roll(ring, k, axis=0) for k in range(n)), key=lambda x: float(((made[-1] - x) ** 2).sum()))
        made.append(ring)
    low, high = zs[0] - thickness[0] / 2, zs[-1] + thickness[-1] / 2
    step = max(min([base, *np.diff(zs)]) / scale, 0.05)
    m = math.ceil((high - low) / step)
    step = (high - low) / m
    at = [(low, np.repeat(made[0].mean(0)[None], n, 0)), *zip(zs, made, strict=True), (high, np.repeat(made[-1].mean(0)[None], n, 0))]
    for j in range(m):
        z = low + (j + 0.5) * step
        (z0, a), (z1, b) = next((p, q) for p, q in zip(at, at[1:], strict=False) if p[0] <= z < q[0])
        t = (z - z0) / (z1 - z0)
        yield z, step, a * (1 - t) + b * t


def test_rings_of_cones_and_offset_slices(spark):
    """Cones, rings that wander, rings begun elsewhere and running backwards, uneven slices."""
    zs, thickness = [0.0, 2.0, 5.0], [2.0, 2.5, 3.0]
    slices = [circle(8, 9, 2.0), circle(9, 10, 4.0, 52, 1.3, True), circle(10.5, 8.5, 1.5, 31, 4.0)]
    points, where = tables(spark, [x for k, s in enumerate(slices) for x in rows(4, k, s)], zs, thickness, 2.0)
    got = {}
    for r in small.rings(points.join(where, ["patient_id", "k"]), 4).collect():
        got.setdefault(r.k, (r.z, r.step, []))[2].append((r.i, r.r, r.c))
    want = list(plain_rings(slices, zs, thickness, 2.0, 4))
    assert len(got) == len(want)
    for k, (z, step, ring) in enumerate(want):
        assert got[k][:2] == pytest.approx((z, step))
        assert np.allclose([x[1:] for x in sorted(got[k][2])], ring, atol=1e-9)


def test_model_of_a_cone(spark):
    """Every cell's share by testing all its sub-points, and the volume of the body that the rings describe."""
    zs, thickness, scale, sub = [0.0, 2.0], [2.0, 2.0], 2, 4
    slices = [circle(8.13, 9.07, 3.0), circle(8.4, 9.3, 1.7)]
    points, where = tables(spark, [x for k, s in enumerate(slices) for x in rows(4, k, s)], zs, thickness, 2.0)
    m = small.model(points, where, N, N, SX, SY, scale, sub).collect()
    got = {(r.k, r.r, r.c): r.share for r in m}
    want = {}
    for k, (_, _, ring) in enumerate(plain_rings(slices, zs, thickness, 2.0, scale)):
        fine = ring * scale
        mask = {(r, c) for r in range(N * scale) for c in range(N * scale) if inside(fine, r + 0.5, c + 0.5)}
        for r, c in mask:
            if {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} <= mask:
                want[k, r, c] = 1.0
            else:
                share = np.mean([inside(fine, r + (i + 0.5) / sub, c + (j + 0.5) / sub) for i in range(sub) for j in range(sub)])
                if share > 0:
                    want[k, r, c] = share
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


def test_a_split_slice_is_interpolated_by_signed_distance(spark):
    """Two contours in one slice (one with a hole that is filled), one in the next."""
    zs, thickness, scale, sub = [0.0, 3.0], [2.0, 2.0], 2, 4
    first = [circle(7, 6, 2.6), circle(7, 13, 2.2), circle(7, 6, 1.0)]
    points, where = tables(spark, rows(5, 0, *first) + rows(5, 1, circle(7.2, 9.4, 3.1)), zs, thickness, 3.0)
    got = {(r.k, r.r, r.c) for r in small.model(points, where, N, N, SX, SY, scale, sub).collect()}
    occ = sampling.occupancy(points, float(scale), N, N, sub).filter("share > 1e-6").collect()
    r0, c0 = min(x.r for x in occ), min(x.c for x in occ)
    shape = max(x.r for x in occ) - r0 + 1, max(x.c for x in occ) - c0 + 1
    planes = np.zeros((2, *shape), bool)
    for x in occ:
        planes[x.k, x.r - r0, x.c - c0] = True
    planes = [flood(p) for p in planes]
    at = np.stack(np.indices(shape), -1).reshape(-1, 2) * [SY / scale, SX / scale]
    far = lambda m: np.sqrt(((at[:, None] - at[m.ravel()][None]) ** 2).sum(-1).min(1)).reshape(shape)
    signed = [far(p) - far(~p) for p in planes]
    want, k, z, step = set(), 0, -1.0, 1.25 / 1
    n = math.ceil(5.0 / (3.0 / scale))
    step = 5.0 / n
    for k in range(n):
        z = -1.0 + (k + 0.5) * step
        m = planes[0] if z <= 0 else planes[1] if z >= 3 else signed[0] * (1 - z / 3) + signed[1] * z / 3 <= 0
        want |= {(k, int(r) + r0, int(c) + c0) for r, c in np.argwhere(m)}
    assert got == want


def test_curves_of_a_graded_dose(spark):
    """Dose rises with the slices: volume, mean and ends of the curve follow; an empty table has none."""
    points, where = tables(spark, rows(4, 0, circle(8, 9, 3.0)) + rows(4, 1, circle(8, 9, 3.0)), [0.0, 2.0], [2.0, 2.0], 2.0)
    dose = spark.createDataFrame([(1, k, r, c, 10.0 * (k + 1)) for k in range(-2 + 2, 4) for r in range(N) for c in range(N)], "patient_id long, k long, r long, c long, dose_gy double")
    planes = spark.createDataFrame([(1, k, 2.0 * k - 2.0) for k in range(4)], "patient_id long, k long, z double")
    got = small.curves(points, where, dose, planes, N, N, SX, SY).collect()
    assert len(got) == 1 and got[0].structure == 4
    whole = 2.0 * 9 * math.pi * SX * SY / 1000 + 2 * (1 / 3) * 9 * math.pi * SX * SY / 1000  # a cylinder and two cones
    assert got[0].volume_cc == pytest.approx(whole, rel=0.03)  # cells whose centre is outside have no share
    assert got[0].mean_gy == pytest.approx(25.0, abs=0.2) and got[0].min_gy > 15 and got[0].max_gy < 35 and got[0].n_bins == 4000
    assert small.curves(points.limit(0), where, dose, planes, N, N, SX, SY).collect() == []
