"""Focal operators over a mosaic of equal tiles: windows reach into the neighbouring tiles.

tiles: tile_id, ti, tj (place of the tile in the mosaic, row of tiles from the south, column from the west) and data, a
dense row-major array from the south. Each tile ships to each neighbour within reach the strip that this one needs,
under the neighbour's place; a tile then meets its strips in one grouped function, which works on one dense window of
the tile and its halo. What is shipped grows with the borders, not with the tiles, and no task holds more than a tile
with its halo.

Defined results: a value at a tile's border is that of one large mosaic; where the mosaic has no tile the halo holds
NaN, and each operator says what it counts as. Missing pixels (NULL) are NaN too. Tiles of a wrong size, or without a
place, go; of several tiles at one place that with the smallest tile_id stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRIP = "ti long, tj long, di int, dj int, tile_id long, data array<double>"


def _overlap(shift: int, size: int, reach: int) -> tuple[slice, slice]:
    """For a neighbour `shift` tiles further: (its part that lies within reach, where that stands in the window)."""
    low, high = max(-reach, shift * size), min(size + reach, (shift + 1) * size)
    return slice(low - shift * size, high - shift * size), slice(low + reach, high + reach)


def _grid(values: pa.Array, shape: tuple[int, int]) -> np.ndarray:
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(shape)


def halo_windows(tiles: DataFrame, rows: int, cols: int, reach: int, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """tile_id, ti, tj, data: step(window) of each tile, where the window has rows + 2 reach rows and cols + 2 reach
    columns and step gives the rows by cols values of the tile within."""
    up, right = -(-reach // rows), -(-reach // cols)
    shifts = [(i, j) for i in range(-up, up + 1) for j in range(-right, right + 1)]

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [batch.column(c).to_pylist() for c in ("ti", "tj", "tile_id")]
            for n, cell in enumerate(batch.column("data")):
                g = _grid(cell.values, (rows, cols))
                strips = [g[_overlap(i, rows, reach)[0], _overlap(j, cols, reach)[0]].ravel() for i, j in shifts]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in strips])])
                columns = [
                    pa.array([place[0][n] - i for i, _ in shifts], pa.int64()), pa.array([place[1][n] - j for _, j in shifts], pa.int64()), pa.array([i for i, _ in shifts], pa.int32()), pa.array([j for _, j in shifts], pa.int32()),
                    pa.array([place[2][n]] * len(shifts), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(strips))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STRIP.split(", ")])

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("tile_id", "descending")])
        window, own = np.full((rows + 2 * reach, cols + 2 * reach), np.nan), None
        for i, j, tile_id, cell in zip(*(part.column(c).to_pylist() for c in ("di", "dj", "tile_id")), part.column("data")):
            (_, at_row), (_, at_col) = _overlap(i, rows, reach), _overlap(j, cols, reach)
            window[at_row, at_col] = _grid(cell.values, (at_row.stop - at_row.start, at_col.stop - at_col.start))
            own = tile_id if (i, j) == (0, 0) else own
        if own is None:  # strips for a place that has no tile
            return pa.table({c: pa.array([], k) for c, k in (("tile_id", pa.int64()), ("ti", pa.int64()), ("tj", pa.int64()), ("data", pa.list_(pa.float64())))})
        out = np.asarray(step(window), float).ravel()
        flat = pa.array(out, mask=np.isnan(out))
        return pa.table({"tile_id": pa.array([own], pa.int64()), "ti": pa.array([key[0].as_py()], pa.int64()), "tj": pa.array([key[1].as_py()], pa.int64()), "data": pa.ListArray.from_arrays(pa.array([0, rows * cols], pa.int32()), flat)})

    given = tiles.select(*[F.col(c).cast("long").alias(c) for c in ("tile_id", "ti", "tj")], F.col("data").cast("array<double>").alias("data"))
    given = given.filter((F.size("data") == rows * cols) & F.col("ti").isNotNull() & F.col("tj").isNotNull())
    return given.mapInArrow(ship, _STRIP).groupBy("ti", "tj").applyInArrow(meet, "tile_id long, ti long, tj long, data array<double>")


def focal_mean_fill(tiles: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """Zero pixels take the mean of the disc around them in the mosaic; beyond it, and for missing pixels, zero counts."""

    def step(window: np.ndarray) -> np.ndarray:
        g = window[radius : radius + rows, radius : radius + cols]
        full = np.nan_to_num(window)
        if not (g == 0).any() or not full.any():
            return g
        y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
        disc = (x * x + y * y <= radius * radius).astype(float)
        # a circular convolution of the window's size: what wraps around falls into the halo
        mean = np.fft.irfft2(np.fft.rfft2(full) * np.fft.rfft2(disc, full.shape), full.shape) / disc.sum()
        return np.where(g == 0, np.maximum(mean[2 * radius : 2 * radius + rows, 2 * radius : 2 * radius + cols], 0), g)

    return halo_windows(tiles, rows, cols, radius, step)


def focal_max_fill(tiles: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """Zero pixels take the largest value of the square around them in the mosaic, 0 where there is none above."""

    def step(window: np.ndarray) -> np.ndarray:
        g, most = window[radius : radius + rows, radius : radius + cols], np.nan_to_num(window)
        for axis in (0, 1):  # the largest of a square: along rows, then along columns
            most = np.lib.stride_tricks.sliding_window_view(most, 2 * radius + 1, axis).max(-1)
        return np.where(g == 0, np.maximum(most, 0), g)

    return halo_windows(tiles, rows, cols, radius, step)


def slope_grid(tiles: DataFrame, rows: int, cols: int, metres: float) -> DataFrame:
    """Slope in degrees by central differences across the tiles' borders; one-sided where a neighbour is missing."""

    def step(window: np.ndarray) -> np.ndarray:
        g = window[1:-1, 1:-1]

        def rise(before: np.ndarray, after: np.ndarray) -> np.ndarray:
            there = (~np.isnan(before)).astype(float) + ~np.isnan(after)
            return np.where(there > 0, (np.where(np.isnan(after), g, after) - np.where(np.isnan(before), g, before)) / (np.maximum(there, 1) * metres), 0.0)

        return np.degrees(np.arctan(np.hypot(rise(window[1:-1, :-2], window[1:-1, 2:]), rise(window[:-2, 1:-1], window[2:, 1:-1]))))

    return halo_windows(tiles, rows, cols, 1, step)
