"""Focal operators over tiles against the same over one large array."""

import numpy as np
import pytest

from terrarisk.operators import mosaic as Q

ROWS, COLS = 6, 5


def tiles_of(spark, big, skip=()):
    n, m = big.shape[0] // ROWS, big.shape[1] // COLS
    rows = [(i * m + j, i, j, [float(v) for v in big[i * ROWS : (i + 1) * ROWS, j * COLS : (j + 1) * COLS].ravel()], "x") for i in range(n) for j in range(m) if (i, j) not in skip]
    return spark.createDataFrame(rows, "tile_id int, ti int, tj int, data array<double>, di string")


def back(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.ti * ROWS : (r.ti + 1) * ROWS, r.tj * COLS : (r.tj + 1) * COLS] = np.array(r.data, float).reshape(ROWS, COLS)
    return out


def window(big, r, k, radius):
    return big[max(r - radius, 0) : r + radius + 1, max(k - radius, 0) : k + radius + 1]


@pytest.mark.parametrize("radius", [1, 4, 13])
def test_fills(spark, radius):
    rng = np.random.default_rng(radius)
    big = rng.integers(0, 4, (3 * ROWS, 4 * COLS)).astype(float) * (rng.random((3 * ROWS, 4 * COLS)) < 0.4)
    most, mean = big.copy(), big.copy()
    size = sum(a * a + b * b <= radius * radius for a in range(-radius, radius + 1) for b in range(-radius, radius + 1))
    for r, k in zip(*np.where(big == 0)):
        most[r, k] = window(big, r, k, radius).max()
        mean[r, k] = sum(big[y, x] for y in range(len(big)) for x in range(big.shape[1]) if (y - r) ** 2 + (x - k) ** 2 <= radius * radius) / size
    t = tiles_of(spark, big).repartition(5)
    assert np.array_equal(back(Q.focal_max_fill(t, ROWS, COLS, radius), big.shape), most)
    assert np.allclose(back(Q.focal_mean_fill(t, ROWS, COLS, radius), big.shape), mean, atol=1e-12)


def test_slope(spark):
    big = np.random.default_rng(7).random((2 * ROWS, 3 * COLS)) * 100
    dy, dx = np.gradient(big, 10.0)
    assert np.allclose(back(Q.slope_grid(tiles_of(spark, big), ROWS, COLS, 10.0), big.shape), np.degrees(np.arctan(np.hypot(dx, dy))))


def test_odd_tiles(spark):
    """A hole in the mosaic, a missing pixel, a repeated place, a wrong size, no place, no tiles."""
    big = np.ones((2 * ROWS, 2 * COLS))
    big[0, 0], big[ROWS - 1, COLS - 1] = 0, np.nan
    t = tiles_of(spark, big, skip={(1, 1)})
    odd = spark.createDataFrame([(9, 0, 0, [5.0] * (ROWS * COLS), "x"), (10, 0, 1, [1.0], "x"), (11, None, 0, [5.0] * (ROWS * COLS), "x"), (12, 3, 0, None, "x")], t.schema)
    got = Q.focal_max_fill(t.unionByName(odd), ROWS, COLS, 2)
    assert sorted(r.tile_id for r in got.collect()) == [0, 1, 2]
    own = [r for r in got.collect() if r.tile_id == 0][0].data
    assert own[0] == 1.0 and own[-1] is None
    assert Q.slope_grid(t.limit(0), ROWS, COLS, 1.0).count() == 0
