"""What lies at or near places, found block by block: Spark deals places and features to blocks of the grid, and in a task a
block's places meet its features in numpy.

Distances in degrees without trigonometry leave few features of a place, whose exact distances decide; the margin covers
what the plane differs from the sphere within the reach. Of what a place meets only the answer leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EARTH_KM = 6371.0
DEGREE_KM = EARTH_KM * np.pi / 180
#: Pairs of a place and an edge that are looked at together.
PAIRS = 65_536


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column of doubles, NaN where NULL."""
    return np.concatenate([np.empty(0), *[np.asarray(c.to_numpy(zero_copy_only=False), float) for c in column.cast(pa.float64()).chunks]])


def exact_km(lat, lon, ax, ay, bx, by) -> np.ndarray:
    """As geometry.point_segment_km."""
    k = np.cos(np.radians(lat))
    dx, dy = (bx - ax) * k, by - ay
    size = dx * dx + dy * dy
    t = np.divide(((lon - ax) * k) * dx + (lat - ay) * dy, size, out=np.zeros_like(size), where=size != 0)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    y, x = ay + t * (by - ay), ax + t * (bx - ax)
    dlat, dlon = np.radians(y - lat) / 2, np.radians(x - lon) / 2
    a = np.sin(dlat) * np.sin(dlat) + np.cos(np.radians(lat)) * np.cos(np.radians(y)) * np.sin(dlon) * np.sin(dlon)
    return 2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _plane2(lat, lon, ax, ay, ex, ey) -> np.ndarray:
    """Squared degrees from places (a column) to edges (a row) from a by e; NaN as infinite."""
    k2 = np.cos(np.radians(lat)) ** 2
    u, v = lon - ax, lat - ay
    if ex.any() or ey.any():
        size = k2 * (ex * ex) + ey * ey
        t = (u * (k2 * ex) + v * ey) / np.where(size == 0, 1.0, size)
        np.clip(t, 0.0, 1.0, out=t)
        u -= t * ex
        v -= t * ey
    u *= u
    u *= k2
    v *= v
    u += v
    if np.isnan(u).any():
        u[np.isnan(u)] = np.inf
    return u


def nearest(lat, lon, ax, ay, bx, by, seq, code, reach: float, k: int | None = 1, hundredths: bool = False):
    """(place, edge, km) by their positions: of each code (whole numbers) the nearest edge within reach of each place, by
    distance, or by its hundredths of a km, then seq. With k, of all codes the k that are nearest; None for all."""
    order = np.lexsort((seq, code))
    ax, ay, bx, by, seq, code = (v[order] for v in (ax, ay, bx, by, seq, code))
    ex, ey = bx - ax, by - ay
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, int)
    each = np.diff(np.r_[start, len(code)])
    found = [[np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]]
    step = max(1, PAIRS // max(1, len(code)))
    for first in range(0, len(lat) if len(code) else 0, step):
        la, lo = lat[first : first + step, None], lon[first : first + step, None]
        d2 = _plane2(la, lo, ax, ay, ex, ey)
        # twice what plane and sphere differ by within the reach; near the poles all are looked at exactly
        slack = np.tan(np.radians(np.minimum(np.abs(la), 89.0))) * (1.2 * reach / EARTH_KM) + 1e-3
        slack = np.where(np.abs(la) + reach / 100 >= 88.0, np.inf, slack)
        best = np.sqrt(np.minimum.reduceat(d2, start, axis=1)) * DEGREE_KM
        if k is not None and k < len(start):
            last = np.partition(best, k - 1, axis=1)[:, k - 1 : k]
            best = np.where(best <= last * (1 + slack) ** 2 + 1e-6, best, -1.0)  # codes that aren't among the k
        most = np.where(best < 0, -1.0, np.minimum(best * (1 + slack) ** 2 + 0.011 * (1 + slack), reach * (1 + slack) + 1e-6))
        most = np.where(np.isnan(most), np.inf, most) / DEGREE_KM
        p, e = np.nonzero(d2 <= np.repeat(np.where(most < 0, -1.0, most * most), each, axis=1))
        km = exact_km(lat[first + p], lon[first + p], ax[e], ay[e], bx[e], by[e])
        near = km <= reach
        p, e, km = p[near] + first, e[near], km[near]
        far = np.floor(km * 100 + 0.5) if hundredths else km
        o = np.lexsort((km, seq[e], far, code[e], p))
        p, e, km, far = p[o], e[o], km[o], far[o]
        one = np.r_[True, (p[1:] != p[:-1]) | (code[e[1:]] != code[e[:-1]])] if len(p) else np.empty(0, bool)
        p, e, km, far = p[one], e[one], km[one], far[one]
        if k is not None and k < len(start):
            o = np.lexsort((seq[e], far, p))
            p, e, km = p[o], e[o], km[o]
            place = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, int)
            rank = np.arange(len(p)) - np.repeat(place, np.diff(np.r_[place, len(p)]))
            p, e, km = p[rank < k], e[rank < k], km[rank < k]
        for out, v in zip(found, (p, order[e], km)):
            out.append(v)
    return tuple(np.concatenate(v) for v in found)


def within(lat, lon, y, x, seq, reach: float):
    """(place, point, km) of all points within reach of each place, of those of one seq the nearest. Points in order of
    latitude are looked at only in the strip around a place."""
    order = np.argsort(y, kind="stable")
    strip = reach / DEGREE_KM * 1.02
    found = [[np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]]
    low, high = np.searchsorted(y[order], lat - strip, "left"), np.searchsorted(y[order], lat + strip, "right")
    total = np.cumsum(np.maximum(high - low, 0))
    first = 0
    while first < len(lat):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + 16 * PAIRS, "right")))
        n = np.maximum(high[first:last] - low[first:last], 0)
        p = np.repeat(np.arange(first, min(last, len(lat))), n)
        e = order[np.repeat(low[first:last] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        narrow = np.abs(lat[p]) + strip >= 88.0
        wide = strip / np.cos(np.radians(np.minimum(np.abs(lat[p]) + strip, 88.0)))
        kept = narrow | (np.abs(lon[p] - x[e]) <= wide)
        p, e = p[kept], e[kept]
        km = exact_km(lat[p], lon[p], x[e], y[e], x[e], y[e])
        p, e, km = p[km <= reach], e[km <= reach], km[km <= reach]
        o = np.lexsort((km, seq[e], p))
        p, e, km = p[o], e[o], km[o]
        one = np.r_[True, (p[1:] != p[:-1]) | (seq[e[1:]] != seq[e[:-1]])] if len(p) else np.empty(0, bool)
        for out, v in zip(found, (p[one], e[one], km[one])):
            out.append(v)
        first = last
    return tuple(np.concatenate(v) for v in found)


def _offsets(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins and ends in the flattened values; lists that are NULL are empty."""
    n = np.asarray(column.value_lengths().fill_null(0))
    return np.r_[0, np.cumsum(n)], column.flatten()


def first_zones(lat, lon, parts: pa.Array, seq, code):
    """(place, zone) by their positions: of each code the first polygon, by seq, that holds each place (geometry's
    contains_point: even-odd, in a part's first ring and in none of its holes)."""
    none = np.empty(0, int)
    if not len(seq) or not len(lat):
        return none, none
    order = np.lexsort((seq, code))
    code = code[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    of_row, structs = _offsets(parts.take(pa.array(order)))
    of_part, rings = _offsets(structs.field("rings"))
    of_ring, points = _offsets(rings)
    x, y = (np.asarray(points.field(c).to_numpy(zero_copy_only=False), float) for c in "xy")
    if len(x) < 2:
        return none, none
    edge = np.ones(len(x) - 1, bool)
    edge[of_ring[(of_ring > 0) & (of_ring < len(x))] - 1] = False  # from a ring's last point to the next one's first
    ax, ay, bx, by = x[:-1][edge], y[:-1][edge], x[1:][edge], y[1:][edge]
    edges_before = np.r_[0, np.cumsum(edge)]
    of_edges = edges_before[np.minimum(of_ring, len(edge))]
    is_hole = np.ones(len(of_ring) - 1, bool)
    is_hole[of_part[:-1][np.diff(of_part) > 0]] = False
    total = lambda v, at: (lambda s: s[:, at[1:]] - s[:, at[:-1]])(np.concatenate([np.zeros((len(v), 1), np.int32), np.cumsum(v, axis=1, dtype=np.int32)], axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (bx - ax), (by - ay)
        found, step = [[none], [none]], max(1, 4 * PAIRS // max(1, len(ax)))
        for first in range(0, len(lat), step):
            la, lo = lat[first : first + step, None], lon[first : first + step, None]
            crosses = ((ay > la) != (by > la)) & (lo < slope[0] * (la - ay) / slope[1] + ax)
            odd = total(crosses, of_edges) % 2
            held = total(np.where(is_hole, 2 * odd, odd), of_part) == 1  # in the first ring, in no hole
            hit = total(held, of_row) > 0
            rank = np.minimum.reduceat(np.where(hit, np.arange(len(order)), len(order)), start, axis=1)
            p, c = np.nonzero(rank < len(order))
            found[0].append(p + first)
            found[1].append(order[rank[p, c]])
    return tuple(np.concatenate(v) for v in found)


def whole(column: pa.ChunkedArray) -> np.ndarray:
    """A column of whole numbers; NULL sorts first."""
    return np.asarray(column.cast(pa.int64()).fill_null(-(2**63)).combine_chunks())


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal texts as equal whole numbers; NULL is a text too."""
    got = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return np.asarray((got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got).indices)
