"""Image sequences: listing, metadata and the plug-in points for pixel formats.

Pixel decoding needs software that isn't part of the library, so readers, segmenters and trackers
are registered; a threshold segmenter and an overlap tracker in numpy serve as reference
implementations and as test doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from celltide.functions import geometry as G
from celltide.functions import scalars as S

FRAMES = "source_id string, frame int, h int, w int, pixels binary"
_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_reader(suffix: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader for a file suffix: (spark, path) -> frames."""
    _READERS[suffix.lower().lstrip(".")] = reader


def open_sequence(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Frames of a file by its suffix, or of a folder; no pixel is read before the query runs."""
    tail = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = tail.rsplit(".", 1)[-1] if "." in tail else ""
    if suffix in _READERS:
        if pattern is not None:
            raise ValueError("a file pattern is for folders only")
        return _READERS[suffix](spark, path)
    if suffix in ("nd2", "czi", "tif", "tiff"):
        raise NotImplementedError(f"register a reader for .{suffix} files")
    if suffix:
        raise ValueError(f"unknown sequence format .{suffix}")
    return folder_frames(listing(spark, path), pattern)


def listing(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """path, size, modified of the files, without their content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder_frames(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """source_id (the folder), frame, path: frame i is the i-th file in natural order."""
    kept = files.filter(S.is_frame_file(F.col("path"), pattern))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    order = W.partitionBy("source_id").orderBy(S.natural_key(F.col("path")))
    return kept.withColumn("source_id", folder).withColumn("frame", F.row_number().over(order) - 1).select("source_id", "frame", "path")


def layout(files: DataFrame, root: str, pattern: str | None = None) -> str:
    """'flat' if the folder itself holds frames, 'nested' if its direct subfolders do; neither is an error."""
    kept = files.filter(S.is_frame_file(F.col("path"), pattern))
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    depth = F.size(F.split(inner, "/"))
    found = kept.agg(F.count_if(depth == 1).alias("flat"), F.count_if(depth == 2).alias("nested")).first()
    if found.flat:
        return "flat"
    if found.nested:
        return "nested"
    raise ValueError(f"no frames in {root}")


def frames_of_arrays(spark: SparkSession, stack: np.ndarray, source_id: str = "memory") -> DataFrame:
    """Frames of a (T, H, W) array."""
    if stack.ndim != 3:
        raise ValueError("a stack has three axes (T, H, W)")
    t, h, w = stack.shape
    rows = [(source_id, i, h, w, stack[i].astype(np.float32).tobytes()) for i in range(t)]
    return spark.createDataFrame(rows, FRAMES)


def channel_pixels(frames: DataFrame) -> DataFrame:
    """source_id, frame, y, x, v: one row per pixel, decoded in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                img = np.frombuffer(r.pixels, np.float32).reshape(r.h, r.w)
                y, x = np.indices(img.shape)
                yield pd.DataFrame({"source_id": r.source_id, "frame": r.frame, "y": y.ravel(), "x": x.ravel(), "v": img.ravel().astype(float)})

    return frames.mapInPandas(run, "source_id string, frame int, y int, x int, v double")


def rotated_crop(frames: DataFrame, center: tuple[float, float], size: tuple[int, int], angle: float) -> DataFrame:
    """Frames cut by a rotated rectangle (width, height), linearly interpolated; outside is 0."""
    if any(isinstance(s, bool) or not isinstance(s, int) or s < 1 for s in size):
        raise ValueError("the crop size must be positive integers")
    w, h = size
    a = np.radians(angle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                img = np.frombuffer(r.pixels, np.float32).reshape(r.h, r.w)
                y, x = np.indices((h, w), float)
                u, v = x - (w - 1) / 2, y - (h - 1) / 2
                made = interpolate(img, center[0] + np.cos(a) * u - np.sin(a) * v, center[1] + np.sin(a) * u + np.cos(a) * v)
                out.append((r.source_id, r.frame, h, w, made.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["source_id", "frame", "h", "w", "pixels"])

    return frames.mapInPandas(run, FRAMES)


def interpolate(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear interpolation at (x, y); outside is 0."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    p = np.pad(img, 1)
    gx = lambda k: np.clip(x0 + 1 + k, 0, p.shape[1] - 1)
    gy = lambda k: np.clip(y0 + 1 + k, 0, p.shape[0] - 1)
    top = p[gy(0), gx(0)] * (1 - fx) + p[gy(0), gx(1)] * fx
    low = p[gy(1), gx(0)] * (1 - fx) + p[gy(1), gx(1)] * fx
    return top * (1 - fy) + low * fy


def rgb_composite(pixels: DataFrame, colors: dict[str, tuple[int, int, int]], by: Sequence[str] = ("frame",)) -> DataFrame:
    """by, y, x, r, g, b: each channel scaled to 0..255 over its frame and added in its colour, clipped.

    One channel of grey (255, 255, 255) gives the grey image.
    """
    whole = W.partitionBy(*by)
    scaled = pixels.select(
        *by, "y", "x", *[S.to_uint8(F.col(c), F.min(c).over(whole), F.max(c).over(whole)).alias(c) for c in colors]
    )
    mixed = [
        F.least(F.lit(255), sum((F.floor(F.col(c) * rgb[k] / 255) for c, rgb in colors.items()), F.lit(0))).cast("int").alias(n)
        for k, n in enumerate("rgb")
    ]
    return scaled.select(*by, "y", "x", *mixed)


def stretched(pixels: DataFrame, value: str = "v", percentiles: tuple[float, float] | None = None, by: Sequence[str] = ("frame",)) -> DataFrame:
    """`pixels` with `byte`: min-max (or percentile) scaling to 0..255, rounded to even; a value that isn't finite is an error."""
    v = F.col(value)
    low, high = (F.min(v), F.max(v)) if percentiles is None else tuple(F.percentile(v, F.lit(p / 100)) for p in percentiles)
    ends = pixels.groupBy(*by).agg(low.alias("_lo"), high.alias("_hi"))
    joined = pixels.join(ends, list(by))
    bad = F.raise_error(F.lit("intensities must be finite")).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    clipped = F.when(ok, F.greatest("_lo", F.least("_hi", v))).otherwise(bad)
    byte = F.when(F.col("_hi") > F.col("_lo"), F.rint((clipped - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(clipped * 0)
    return joined.withColumn("byte", byte.cast("int")).drop("_lo", "_hi")


def cell_colors(detections: DataFrame, colors: DataFrame, default: tuple[int, int, int] = (128, 128, 128)) -> DataFrame:
    """Each detection with its colour (id, r, g, b), the default where it has none."""
    out = detections.join(colors.select("id", F.struct("r", "g", "b").alias("_c")), "id", "left")
    fill = F.struct(*[F.lit(v).alias(k) for k, v in zip("rgb", default)])
    return out.withColumn("color", F.coalesce("_c", fill)).drop("_c")


# ---------------------------------------------------------------- masks


def mask_rows(detections: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """by, id, frame, label, y, x of the pixels whose centre lies in each polygon."""
    keep = [*by, "id", "frame", "label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [G.pixels(G.points(c), height, width) for c in batch["coords"]]
            times = [len(y) for y, _ in found]
            made = {k: np.repeat(batch[k].to_numpy(), times) for k in keep}
            ys, xs = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in (0, 1))
            yield pd.DataFrame({**made, "y": ys, "x": xs})

    schema = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keep) + ", y int, x int"
    return detections.select(*keep, "coords").mapInPandas(run, schema)


def polygons_of_masks(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, frame, label, coords, fragments: the largest outer boundary of each label, and the number of its parts."""
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in [*by, "frame", "label"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        mask = np.zeros((int(np.ptp(y)) + 1, int(np.ptp(x)) + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        parts = G.trace(mask)
        coords = [{"x": float(px + x.min()), "y": float(py + y.min())} for px, py in parts[0]]
        head = {k: [group[k].iloc[0]] for k in [*by, "frame", "label"]}
        return pd.DataFrame({**head, "coords": [coords], "fragments": [len(parts)]})

    kept = pixels.filter("label > 0")
    return kept.groupBy(*by, "frame", "label").applyInPandas(one, f"{kinds}, coords array<struct<x:double,y:double>>, fragments int")


def merge_colonies(detections: DataFrame, height: int, width: int, expand: int = 10) -> DataFrame:
    """frame, id, coords, area of blobs: masks widened by `expand` pixels, united, narrowed again.

    A raster form of dilate-unite-erode with a square element; ids are unique over all frames.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        m = expand + 1
        mask = np.zeros((height + 2 * m, width + 2 * m), bool)
        for c in group["coords"]:
            mask |= G.raster(G.points(c) + m, height + 2 * m, width + 2 * m)
        blob = G.closed(mask, expand)
        rows = [(int(group["frame"].iloc[0]), [{"x": float(x), "y": float(y)} for x, y in p - m], abs(G.shoelace(p))) for p in G.trace(blob)]
        return pd.DataFrame(rows, columns=["frame", "coords", "area"])

    blobs = detections.groupBy("frame").applyInPandas(one, "frame int, coords array<struct<x:double,y:double>>, area double")
    first = F.struct(F.array_min(F.transform("coords", lambda p: p["y"])), F.array_min(F.transform("coords", lambda p: p["x"])))
    return blobs.withColumn("id", F.row_number().over(W.orderBy("frame", first)).cast("bigint"))


# ---------------------------------------------------------------- models


class ThresholdSegmenter:
    """Reference segmenter: 4-connected components of pixels above a threshold."""

    def __init__(self, threshold: float, min_size: int = 1):
        self.threshold, self.min_size = threshold, min_size

    def __call__(self, frames: DataFrame) -> DataFrame:
        """source_id, frame, y, x, label of the mask pixels."""
        threshold, min_size = self.threshold, self.min_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    lab = G.label_components(np.frombuffer(r.pixels, np.float32).reshape(r.h, r.w) > threshold)
                    size = np.bincount(lab.ravel())
                    keep = np.flatnonzero(size >= min_size)
                    y, x = np.nonzero(np.isin(lab, keep[keep > 0]))
                    yield pd.DataFrame({"source_id": r.source_id, "frame": r.frame, "y": y, "x": x, "label": lab[y, x]})

        return frames.mapInPandas(run, "source_id string, frame int, y int, x int, label int")


class OverlapTracker:
    """Reference tracker: a detection's parent is the one of the frame before that it overlaps most."""

    def __call__(self, pixels: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
        """by, frame, label, parent_label, overlap."""
        before = pixels.select(*by, (F.col("frame") + 1).alias("frame"), "y", "x", F.col("label").alias("parent_label"))
        met = pixels.join(before, [*by, "frame", "y", "x"]).groupBy(*by, "frame", "label", "parent_label").agg(F.count("*").alias("overlap"))
        best = F.max_by(F.struct("parent_label", "overlap"), F.struct("overlap", -F.col("parent_label")))
        return met.groupBy(*by, "frame", "label").agg(best.alias("b")).select(*by, "frame", "label", "b.parent_label", "b.overlap")
