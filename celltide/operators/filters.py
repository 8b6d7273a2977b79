"""Filters and suppression of detections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from celltide.functions import geometry as G
from celltide.functions import units as U


def finite(col: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    c = col.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def in_range(col: Column, vmin: float | None = None, vmax: float | None = None) -> Column:
    """Finite and within inclusive bounds, None being open; a NaN never passes, not even without bounds."""
    keep = finite(col)
    if vmin is not None:
        keep = keep & (col >= F.lit(vmin))
    if vmax is not None:
        keep = keep & (col <= F.lit(vmax))
    return keep


@dataclass
class CellFilter:
    """A range filter on a property column; bounds may carry a unit ('3 micrometer')."""

    vmin: object = None
    vmax: object = None
    column: str = ""

    def mask(self, properties: DataFrame) -> Column:
        unit = U.unit_of(properties, self.column)
        return in_range(F.col(self.column), U.magnitude(self.vmin, unit), U.magnitude(self.vmax, unit))


class AreaFilter(CellFilter):
    def __init__(self, vmin=None, vmax=None):
        super().__init__(vmin, vmax, "area")


class LengthFilter(CellFilter):
    def __init__(self, vmin=None, vmax=None):
        super().__init__(vmin, vmax, "length")


class WidthFilter(CellFilter):
    def __init__(self, vmin=None, vmax=None):
        super().__init__(vmin, vmax, "width")


class CircularityFilter(CellFilter):
    def __init__(self, vmin=None, vmax=None):
        super().__init__(vmin, vmax, "circularity")


class BoundaryClosenessFilter(CellFilter):
    def __init__(self, min_distance):
        super().__init__(min_distance, None, "boundary_closeness")


def combined_mask(properties: DataFrame, filters: Sequence[CellFilter]) -> Column:
    """AND of all filters; no filters keep everything, NaN rows included."""
    out = F.lit(True)
    for f in filters:
        out = out & f.mask(properties)
    return out


def apply_cell_filters(
    detections: DataFrame, filters: Sequence[CellFilter], properties: DataFrame, by: Sequence[str] = (), check: bool = True
) -> DataFrame:
    """The detections whose properties pass all filters; one that has no properties is an error."""
    keys = [*by, "id"]
    if check:
        missing = detections.join(properties.select(*keys), keys, "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"contour {missing[0]['id']} is not in the property table")
    return detections.join(properties.filter(combined_mask(properties, filters)).select(*keys), keys, "left_semi")


def removed(before: DataFrame, after: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    return before.join(after.select(*key), list(key), "left_anti")


def size_filter(df: DataFrame, min_area: float, max_area: float, area: Column | None = None) -> DataFrame:
    """Strictly between the bounds, in pixels."""
    a = G.area(F.col("coords")) if area is None else area
    return df.filter((a > min_area) & (a < max_area))


def tile_touch_filter(df: DataFrame, width: float, height: float, threshold: float = 10) -> DataFrame:
    """Detections at least `threshold` from the tile's border."""
    return df.filter(G.boundary_closeness(F.col("coords"), F.lit(float(width)), F.lit(float(height))) >= threshold)


# ---------------------------------------------------------------- ellipses


def fit_ellipse(p: np.ndarray) -> tuple[float, float] | None:
    """(minor, major) full axes of the least-squares ellipse of at least five points."""
    if len(p) < 5:
        return None
    c = p.mean(0)
    s = max(float(np.abs(p - c).max()), 1e-12)
    x, y = ((p - c) / s).T
    try:
        d1, d2 = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
        s1, s2, s3 = d1.T @ d1, d1.T @ d2, d2.T @ d2
        t = -np.linalg.solve(s3, s2.T)
        m = s1 + s2 @ t
        m = np.array([m[2] / 2, -m[1], m[0] / 2])
        _, vec = np.linalg.eig(m)
        vec = vec.real
        ok = 4 * vec[0] * vec[2] - vec[1] ** 2 > 0
        if not ok.any():
            return None
        a1 = vec[:, np.flatnonzero(ok)[0]]
        a, b, cc, d, e, f = *a1, *(t @ a1)
        q = np.array([[a, b / 2], [b / 2, cc]])
        centre = np.linalg.solve(-2 * q, np.array([d, e]))
        k = centre @ q @ centre - f
        ev = np.linalg.eigvalsh(q / k)
    except np.linalg.LinAlgError:
        return None
    if (ev <= 0).any():
        return None
    axes = 2 * s / np.sqrt(ev)
    return float(axes.min()), float(axes.max())


def ellipsoid_filter(df: DataFrame, min_ratio: float, max_ratio: float) -> DataFrame:
    """Polygons of five points or more whose ellipse has a width/height ratio in range and fits the area better than a rectangle."""

    @F.pandas_udf(T.BooleanType())
    def keep(coords: pd.Series) -> pd.Series:
        out = []
        for c in coords:
            p = G.points(c)
            axes, sides, a = fit_ellipse(p), G.length_width(p), abs(G.shoelace(p))
            if axes is None or np.isnan(sides[0]):
                out.append(False)
                continue
            ellipse = np.pi * axes[0] * axes[1] / 4
            out.append(min_ratio <= axes[0] / axes[1] <= max_ratio and abs(ellipse - a) < abs(sides[0] * sides[1] - a))
        return pd.Series(out)

    return df.filter(keep(F.col("coords")))


# ---------------------------------------------------------------- overlaps


def box_overlap(a: str, b: str, inclusive: float = 0.0) -> Column:
    """Overlap area of boxes a.(x0, y0, x1, y1) and b; `inclusive` 1 counts both end pixels."""
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")) + inclusive
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0")) + inclusive
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: str, inclusive: float = 0.0) -> Column:
    return (F.col(f"{a}.x1") - F.col(f"{a}.x0") + inclusive) * (F.col(f"{a}.y1") - F.col(f"{a}.y0") + inclusive)


def candidate_pairs(boxes: DataFrame, by: Sequence[str] = ("frame",), cell: float | None = None, key: str = "id") -> DataFrame:
    """Pairs (a, b) of a partition, a.key < b.key, whose boxes may overlap.

    With `cell`, boxes meet through the grid cells they touch instead of all against all, and a
    pair is given by the first cell the two share only.
    """
    row = F.struct(*boxes.columns)
    left, right = boxes.select(*by, row.alias("a")), boxes.select(*by, row.alias("b"))
    if cell is None:
        return left.join(right, list(by)).filter(F.col(f"a.{key}") < F.col(f"b.{key}")).select("a", "b")

    def cells(df: DataFrame, n: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"{n}.{lo}") / cell), F.floor(F.col(f"{n}.{hi}") / cell))
        return df.withColumn("_gx", F.explode(span("x0", "x1"))).withColumn("_gy", F.explode(span("y0", "y1")))

    met = cells(left, "a").join(cells(right, "b"), [*by, "_gx", "_gy"]).filter(F.col(f"a.{key}") < F.col(f"b.{key}"))
    first = (F.col("_gx") == F.floor(F.greatest("a.x0", "b.x0") / cell)) & (F.col("_gy") == F.floor(F.greatest("a.y0", "b.y0") / cell))
    return met.filter(first).select("a", "b")


def box_iou(pairs: DataFrame, inclusive: float = 1.0) -> DataFrame:
    """IoU of candidate pairs; pixel boxes count both ends."""
    inter = box_overlap("a", "b", inclusive)
    return pairs.withColumn("iou", inter / (box_area("a", inclusive) + box_area("b", inclusive) - inter))


def nms(df: DataFrame, threshold: float = 0.1, mode: str = "iou", by: Sequence[str] = ("frame",), geometry: str = "polygon", cell: float | None = None) -> DataFrame:
    """Non-greedy suppression: a detection goes if any of higher score order overlaps it enough.

    Order: score ascending, NULL as 0, ties by id; a suppressed detection still suppresses, so
    this is an anti-join. `mode` 'iou' divides by the union, 'i' by the own area. `geometry` 'box'
    uses x0, y0, x1, y1 (exact for rectangles), 'polygon' the coords. Fewer than three points or
    no area: dropped.
    """
    if mode not in ("iou", "i"):
        raise ValueError(f"unknown overlap mode {mode!r}")
    if geometry == "polygon":
        b = G.bounds(F.col("coords"))
        df0 = df.filter(~G.degenerate(F.col("coords")))
        boxed = df0.withColumns({k: b[k] for k in ("x0", "y0", "x1", "y1")})
    else:
        df0 = df.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        boxed = df0
    ranked = boxed.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.coalesce("score", F.lit(0.0)), "id")))
    pairs = candidate_pairs(ranked, by, cell, "_rank").filter(box_overlap("a", "b") > 0)
    if geometry == "polygon":
        inter, own = G.overlap_area(F.col("a.coords"), F.col("b.coords")), G.area(F.col("a.coords"))
        other = G.area(F.col("b.coords"))
    else:
        inter, own, other = box_overlap("a", "b"), box_area("a"), box_area("b")
    pairs = pairs.withColumn("_i", inter)
    share = F.col("_i") / ((own + other - F.col("_i")) if mode == "iou" else own)
    gone = pairs.filter(share >= threshold).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a.id").alias("id")).distinct()
    return df0.join(gone, [*by, "id"], "left_anti")


def non_max_suppression(df: DataFrame, iou: float = 0.3, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Drops a box if its overlap with a higher-scored one is more than `iou` of its own area."""
    pairs = candidate_pairs(df, by)
    inter = box_overlap("a", "b")
    lower = F.col("a.score") < F.col("b.score")
    upper = F.col("b.score") < F.col("a.score")
    gone = F.array(
        F.when(lower & (inter / box_area("a") > iou), F.col("a.id")), F.when(upper & (inter / box_area("b") > iou), F.col("b.id"))
    )
    lost = pairs.select(*[F.col(f"a.{k}").alias(k) for k in by], F.explode(gone).alias("id")).filter("id is not null").distinct()
    return df.join(lost, [*by, "id"], "left_anti")


def mask_nms(
    boxes: DataFrame, pixels: DataFrame, bbox_iou: float = 0.1, mask_iou: float = 0.4, min_score: float = 0.1, by: Sequence[str] = ("frame",)
) -> DataFrame:
    """Mask suppression: boxes must overlap first, then masks; dropped if the other's score is strictly higher. Non-greedy."""
    kept = boxes.filter(F.col("score") >= min_score)
    pairs = box_iou(candidate_pairs(kept, by)).filter(F.col("iou") > bbox_iou)
    near = pairs.select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.score").alias("si"), F.col("b.score").alias("sj"))
    px = pixels.select(*by, "id", "y", "x")
    sizes = px.groupBy(*by, "id").agg(F.count("*").alias("n"))
    both = near.join(px.withColumnRenamed("id", "i"), [*by, "i"]).join(px.withColumnRenamed("id", "j"), [*by, "j", "y", "x"])
    inter = both.groupBy(*by, "i", "j", "si", "sj").agg(F.count("*").alias("c"))
    inter = inter.join(sizes.select(*by, F.col("id").alias("i"), F.col("n").alias("ni")), [*by, "i"])
    inter = inter.join(sizes.select(*by, F.col("id").alias("j"), F.col("n").alias("nj")), [*by, "j"])
    hit = inter.filter(F.col("c") / (F.col("ni") + F.col("nj") - F.col("c")) > mask_iou)
    gone = hit.filter("si <> sj").select(*by, F.when(F.col("si") < F.col("sj"), F.col("i")).otherwise(F.col("j")).alias("id")).distinct()
    return kept.join(gone, [*by, "id"], "left_anti")


# ---------------------------------------------------------------- histograms


def shared_histogram(df: DataFrame, value: str, kept: Column | None = None, bins: int = 50) -> DataFrame:
    """bin, lower, before, after, removed: counts in shared bins over the finite range, the last bin closed."""
    v = F.col(value).cast("double")
    rows = df.filter(finite(F.col(value))).select(v.alias("_v"), (F.lit(True) if kept is None else kept).alias("_k"))
    edges = rows.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return _binned(rows.crossJoin(F.broadcast(edges)), bins)  # one row of edges


def _binned(rows: DataFrame, bins: int) -> DataFrame:
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return rows.groupBy(at.alias("bin"), (F.col("_lo") + at * width).alias("lower")).agg(
        F.count("*").alias("before"),
        F.count_if(F.col("_k")).alias("after"),
        F.count_if(~F.coalesce("_k", F.lit(False))).alias("removed"),
    )
