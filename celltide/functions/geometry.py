"""Polygon geometry.

Area, perimeter, centroid, bounds and boundary distance are column expressions over an array of
(x, y) structs. Minimum rotated rectangles, rasters, traces and polygon intersections have no
SQL form and run as Arrow-batched numpy functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _next(coords: Column) -> Column:
    n = F.size(coords)
    return F.when(n > 0, F.concat(F.slice(coords, 2, F.greatest(n - 1, F.lit(0))), F.slice(coords, 1, 1))).otherwise(coords)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(coords: Column) -> Column:
    return _sum(F.zip_with(coords, _next(coords), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def area(coords: Column) -> Column:
    """Shoelace area."""
    return F.abs(signed_area(coords))


def degenerate(coords: Column, signed: Column | None = None) -> Column:
    """Fewer than three points, or no area. `signed`: the signed area, if a column holds it."""
    return (F.size(coords) < 3) | ((signed_area(coords) if signed is None else signed) == 0)


def perimeter(coords: Column, signed: Column | None = None) -> Column:
    """Length of the closed boundary; NaN for degenerate polygons."""
    edges = F.zip_with(
        coords, _next(coords), lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    )
    return F.when(degenerate(coords, signed), F.lit(float("nan"))).otherwise(_sum(edges))


def centroid(coords: Column, signed: Column | None = None) -> Column:
    """Area centroid; the mean of the points where there is no area."""
    a = signed_area(coords) if signed is None else signed
    nxt = _next(coords)
    cx = _sum(F.zip_with(coords, nxt, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    cy = _sum(F.zip_with(coords, nxt, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    n = F.size(coords)
    mean = lambda k: _sum(F.transform(coords, lambda p: p[k])) / n
    flat = a == 0
    return F.when(n > 0, F.struct(
        F.when(flat, mean("x")).otherwise(cx / (6 * a)).alias("x"), F.when(flat, mean("y")).otherwise(cy / (6 * a)).alias("y")
    ))


def bounds(coords: Column) -> Column:
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def boundary_closeness(coords: Column, width: Column, height: Column, signed: Column | None = None) -> Column:
    """Distance of the bounding box to the nearest image border; 0 for degenerate polygons."""
    b = bounds(coords)
    return F.when(degenerate(coords, signed), 0.0).otherwise(F.least(b["x0"], b["y0"], width - b["x1"], height - b["y1"]))


def consecutive_distances(coords: Column) -> Column:
    """Distances between neighbouring points (n - 1 of them)."""
    n = F.size(coords)
    return F.zip_with(
        F.slice(coords, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(coords, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])),
    )


def circularity(area_: Column, perimeter_: Column) -> Column:
    """4 pi A / P^2; NaN for P = 0."""
    return F.when(perimeter_ == 0, F.lit(float("nan"))).otherwise(4 * F.pi() * area_ / (perimeter_ * perimeter_))


# ---------------------------------------------------------------- numpy


def points(coords) -> np.ndarray:
    """(n, 2) array of one row's coordinates."""
    if coords is None or len(coords) == 0:
        return np.zeros((0, 2))
    first = coords[0]
    if isinstance(first, dict):
        return np.array([(p["x"], p["y"]) for p in coords], float)
    return np.asarray([tuple(p) for p in coords], float)


def shoelace(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull without collinear points (monotone chain)."""
    pts = np.unique(p, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def min_rectangle(p: np.ndarray) -> np.ndarray | None:
    """Corners of the rotated rectangle of least area; None for degenerate polygons."""
    if len(p) < 3 or shoelace(p) == 0:
        return None
    hull = convex_hull(p)
    if len(hull) < 3:
        return None
    best = None
    for e in np.roll(hull, -1, axis=0) - hull:  # one side lies on a hull edge
        u = e / np.hypot(*e)
        v = np.array([-u[1], u[0]])
        a, b = hull @ u, hull @ v
        size = (a.max() - a.min()) * (b.max() - b.min())
        if best is None or size < best[0] - 1e-12:
            best = (size, u, v, a.min(), a.max(), b.min(), b.max())
    _, u, v, a0, a1, b0, b1 = best
    return np.array([u * a + v * b for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1))])


def length_width(p: np.ndarray) -> tuple[float, float]:
    r = min_rectangle(p)
    if r is None:
        return float("nan"), float("nan")
    a, b = np.hypot(*(r[1] - r[0])), np.hypot(*(r[2] - r[1]))
    return float(max(a, b)), float(min(a, b))


def rectangle_sides_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longer and shorter rectangle sides of many convex polygons of m points each, given as (n, m) arrays."""
    ex, ey = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
    norm = np.hypot(ex, ey)
    best = np.full(len(x), np.inf)
    long, short = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for k in range(x.shape[1]):  # one side lies on an edge
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = ex[:, k : k + 1] / norm[:, k : k + 1], ey[:, k : k + 1] / norm[:, k : k + 1]
        a, b = x * u + y * v, y * u - x * v
        p, q = np.ptp(a, axis=1), np.ptp(b, axis=1)
        better = p * q < best - 1e-12
        best = np.where(better, p * q, best)
        long, short = np.where(better, np.maximum(p, q), long), np.where(better, np.minimum(p, q), short)
    return long, short


def _sides_of_lists(coords: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rectangle sides of a batch: convex polygons of equal size together, all others by their hulls."""
    n = len(coords)
    offsets = coords.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = coords.values
    xs = values.field("x").to_numpy(zero_copy_only=False).astype(float)
    ys = values.field("y").to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(offsets)
    size[coords.is_null().to_numpy(zero_copy_only=False)] = 0
    long, short = np.full(n, np.nan), np.full(n, np.nan)
    for m in np.unique(size[size > 2]).tolist():
        rows = np.flatnonzero(size == m)
        at = offsets[rows][:, None] + np.arange(m)
        x, y = xs[at], ys[at]
        ex, ey = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
        fx, fy = np.roll(ex, -1, 1), np.roll(ey, -1, 1)
        turn = ex * fy - ey * fx
        around = np.abs(np.arctan2(turn, ex * fx + ey * fy).sum(1))
        flat = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) == 0
        convex = ((turn >= 0).all(1) | (turn <= 0).all(1)) & (np.abs(around - 2 * np.pi) < 1e-6)
        fast = convex & ~flat
        if fast.any():
            long[rows[fast]], short[rows[fast]] = rectangle_sides_of(x[fast], y[fast])
        for i in np.flatnonzero(~convex & ~flat).tolist():
            long[rows[i]], short[rows[i]] = length_width(np.stack([x[i], y[i]], 1))
    return long, short


@F.arrow_udf(T.StructType([T.StructField("length", T.DoubleType()), T.StructField("width", T.DoubleType())]))
def rectangle_sides(coords: pa.Array) -> pa.Array:
    """Longer and shorter side of the minimum rotated rectangle; NaN for degenerate polygons."""
    long, short = _sides_of_lists(coords)
    return pa.StructArray.from_arrays([pa.array(long), pa.array(short)], names=["length", "width"])


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Intersection of a polygon with a convex one (Sutherland-Hodgman)."""
    if shoelace(clip) < 0:
        clip = clip[::-1]
    out = list(subject)
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if not out:
            break
        inside = lambda q: (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= 0  # noqa: B023, E731
        made = []
        for s, e in zip(out, out[1:] + out[:1]):
            if inside(s) != inside(e):
                d, f = e - s, b - a
                t = ((a[0] - s[0]) * f[1] - (a[1] - s[1]) * f[0]) / (d[0] * f[1] - d[1] * f[0])
                made.append(s + t * d)
            if inside(e):
                made.append(e)
        out = made
    return np.array(out) if out else np.zeros((0, 2))


def triangles(p: np.ndarray) -> list[np.ndarray]:
    """Ear clipping of a simple polygon."""
    p = p if shoelace(p) > 0 else p[::-1]
    left = list(range(len(p)))
    out = []

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    guard = 0
    while len(left) > 3 and guard < 4 * len(p) * len(p):
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = p[i], p[j], p[m]
            turn = cross(a, b, c)
            if turn < 0:
                continue
            if turn > 0 and any(
                min(cross(a, b, p[q]), cross(b, c, p[q]), cross(c, a, p[q])) > 0 for q in left if q not in (i, j, m)
            ):
                continue
            if turn > 0:
                out.append(np.array([a, b, c]))
            left.pop(k)
            break
        else:
            break
        guard += 1
    if len(left) == 3:
        out.append(p[left])
    return out


def intersection_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of overlap of two simple polygons, by triangles of both."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    if (a.max(0) <= b.min(0)).any() or (b.max(0) <= a.min(0)).any():
        return 0.0
    return float(sum(abs(shoelace(clip_convex(s, t))) for s in triangles(a) for t in triangles(b)))


@F.pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([intersection_area(points(x), points(y)) for x, y in zip(a, b)])


def raster(p: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre (column, row) lies in the polygon; a centre on an edge counts once (half-open rule)."""
    out = np.zeros((height, width), bool)
    if len(p) < 3:
        return out
    a, b = p, np.roll(p, -1, axis=0)
    for y in range(max(0, int(np.ceil(p[:, 1].min()))), min(height - 1, int(np.floor(p[:, 1].max()))) + 1):
        crosses = (a[:, 1] <= y) != (b[:, 1] <= y)
        s, e = a[crosses], b[crosses]
        xs = np.sort(s[:, 0] + (y - s[:, 1]) / (e[:, 1] - s[:, 1]) * (e[:, 0] - s[:, 0]))
        for x0, x1 in zip(xs[::2], xs[1::2]):
            lo, hi = max(0, int(np.ceil(x0))), min(width, int(np.ceil(x1)))
            out[y, lo:hi] = True
    return out


def pixels(p: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of `raster`, worked out inside the polygon's bounds only."""
    if len(p) < 3:
        return np.zeros(0, int), np.zeros(0, int)
    x0, y0 = (int(v) for v in np.maximum(np.floor(p.min(0)), 0))
    x1, y1 = (int(v) for v in np.minimum(np.ceil(p.max(0)) + 1, (width, height)))
    if x1 <= x0 or y1 <= y0:
        return np.zeros(0, int), np.zeros(0, int)
    y, x = np.nonzero(raster(p - (x0, y0), y1 - y0, x1 - x0))
    return y + y0, x + x0


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components numbered from 1 in row-major order of their first pixel."""
    h, w = mask.shape
    big = h * w
    lab = np.where(mask, np.arange(big).reshape(h, w), big)
    while True:  # least index spreads to the neighbours in the mask
        old = np.pad(lab, 1, constant_values=big)
        lab = np.minimum.reduce([old[1:-1, 1:-1], old[:-2, 1:-1], old[2:, 1:-1], old[1:-1, :-2], old[1:-1, 2:]])
        lab = np.where(mask, lab, big)
        lab[mask] = lab.ravel()[lab[mask]]  # and to the label of the label
        if (lab == old[1:-1, 1:-1]).all():
            break
    out = np.zeros((h, w), np.int32)
    if mask.any():
        _, inverse = np.unique(lab[mask], return_inverse=True)
        out[mask] = inverse + 1
    return out


def dilated(mask: np.ndarray, n: int) -> np.ndarray:
    """Widened by n pixels in both directions (square element)."""
    for axis in (0, 1):
        p = np.cumsum(np.pad(mask.astype(int), [(n + 1, n) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        hi, lo = [slice(None)] * 2, [slice(None)] * 2
        hi[axis], lo[axis] = slice(2 * n + 1, None), slice(None, -(2 * n + 1))
        mask = (p[tuple(hi)] - p[tuple(lo)]) > 0
    return mask


def closed(mask: np.ndarray, n: int) -> np.ndarray:
    """Widened, then narrowed again; what lies outside the image counts as empty."""
    wide = dilated(np.pad(mask, n + 1), n)
    return (~dilated(~wide, n))[n + 1 : -n - 1, n + 1 : -n - 1]


def trace(mask: np.ndarray) -> list[np.ndarray]:
    """Outer boundaries of the 4-connected components, as pixel-edge polygons, largest first."""
    lab = label_components(mask)
    out = []
    for k in range(1, int(lab.max()) + 1):
        part = np.pad(lab == k, 1)
        edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def add(s, e):
            edges.setdefault(s, []).append(e)  # noqa: B023

        ys, xs = np.nonzero(part)
        for y, x in zip(ys.tolist(), xs.tolist()):  # the region lies on the right of every edge
            if not part[y - 1, x]:
                add((x, y), (x + 1, y))
            if not part[y, x + 1]:
                add((x + 1, y), (x + 1, y + 1))
            if not part[y + 1, x]:
                add((x + 1, y + 1), (x, y + 1))
            if not part[y, x - 1]:
                add((x, y + 1), (x, y))
        start = min(edges, key=lambda p: (p[1], p[0]))
        loop, at, came = [start], start, (1, 0)
        while True:
            options = edges[at]
            # at a corner where the component touches itself, stay on the outside
            nxt = max(options, key=lambda e: (came[0] * (e[1] - at[1]) - came[1] * (e[0] - at[0]))) if len(options) > 1 else options[0]
            options.remove(nxt)
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            if at == start:
                break
            loop.append(at)
        p = np.array(loop, float) - 1
        turn = (np.roll(p, -1, axis=0) - p) != (p - np.roll(p, 1, axis=0))
        out.append(p[turn.any(axis=1)])
    return sorted(out, key=lambda q: -abs(shoelace(q)))
