"""Slices, frames and surroundings against plain versions."""

import numpy as np
import pytest
from fluence.operators import frames

P = "patient_id"


def test_slice_of(spark):
    """Even slices: half steps to even, ends clipped; uneven ones: nearest, ties to the lower."""
    slices = spark.createDataFrame([(1, k, 2.0 * k) for k in range(5)] + [(2, 0, 0.0), (2, 1, 2.0), (2, 2, 7.0)] + [(3, 0, 4.0)], "patient_id long, k long, z double")
    asked = [(1, 0, 1.0), (1, 1, 3.0), (1, 2, -9.0), (1, 3, 99.0), (1, 4, 4.9), (2, 5, 1.0), (2, 6, 4.5), (2, 7, 4.6), (2, 8, -3.0), (2, 9, 50.0), (3, 10, 0.0)]
    got = frames._slice_of(spark.createDataFrame(asked, "patient_id long, id long, at double"), slices)
    want = {0: 0, 1: 2, 2: 0, 3: 4, 4: 2, 5: 0, 6: 1, 7: 2, 8: 0, 9: 2, 10: 0}
    assert {r.id: r.k for r in got.collect()} == want


def test_transform_is_the_way_through_patient_coordinates(spark):
    image, dose, first = ([3.0, 4.0, 0.0], [-4.0, 3.0, 0.0], 2.0, 2.5), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 3.0, 1.5), [5.0, -1.0, 2.0]
    origin, r, c = np.array([10.0, 20.0, 30.0]), 4.0, 7.0
    x = spark.createDataFrame([(1, 0, origin.tolist())], "patient_id long, k long, origin array<double>")
    t = frames.slice_transforms(x, image, dose, first).first()
    xyz = origin + c * 2.0 * np.array([0.6, 0.8, 0.0]) + r * 2.5 * np.array([-0.8, 0.6, 0.0])
    assert t.m00 * r + t.m01 * c + t.o0 == pytest.approx((xyz[1] + 1.0) / 1.5)
    assert t.m10 * r + t.m11 * c + t.o1 == pytest.approx((xyz[0] - 5.0) / 3.0)
    assert t.position == pytest.approx(30.0)
    with pytest.raises(ValueError):
        frames.slice_transforms(x, ([0.0, 0.0, 0.0], *image[1:]), dose, first)


def test_geometry_faults(spark):
    one = [16, 32, 32], [0.0, -5.0, 2.0], [2.0, 2.5, 3.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [(1, 1, *one), (1, 2, one[0], [0.0005, -5.0, 2.0], *one[2:]), (1, 3, [16, 32, 33], *one[1:]), (1, 4, one[0], [0.0, -5.1, 2.0], *one[2:]), (1, 5, one[0], one[1], [2.0, 2.5], one[3]), (1, 6, *one[:3], [1.0, 0.0, 0.0, 0.0, 1.0, None])]
    f = spark.createDataFrame(rows, "patient_id long, grid_id long, shape array<int>, origin array<double>, spacing array<double>, orientation array<double>")
    assert {r.grid_id: r.fault for r in frames.geometry_faults(f).collect()} == {1: None, 2: None, 3: "shape", 4: "origin", 5: "spacing", 6: "orientation"}
