"""Property extraction: detections to a wide, unit-carrying property table.

An extractor yields columns; all scalar extractors of one call collapse into a single select, so
there is no join unless an extractor needs pixels or a time model. Extractors run in order and
may read the columns of earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from celltide import model
from celltide.functions import geometry as G
from celltide.functions import units as U


@dataclass
class Context:
    """What extractors may need besides the detections."""

    pixel_size: float | tuple[float, float] | None = None
    pixel_unit: str = "micrometer"
    height: float | None = None
    width: float | None = None
    timepoints: DataFrame | None = None
    time_unit: str | None = None
    pixels: DataFrame | None = None  # frame, y, x and one column per channel
    by: Sequence[str] = ()
    signed: Column | None = None  # set by extract(): the signed polygon area, computed once


@dataclass
class Extractor:
    """Base of all extractors: override `columns` (expressions) or `apply` (a relation)."""

    output_unit: str | None = None
    columns_: dict = field(default_factory=dict, repr=False)

    dim = 0
    name = ""

    def input_unit(self, ctx: Context) -> str:
        if self.dim == 0:
            return "dimensionless"
        base = ctx.pixel_unit
        return base if self.dim == 1 else f"{base} ** {self.dim}"

    def unit(self, ctx: Context) -> str:
        return self.output_unit or self.input_unit(ctx)

    def calibrated(self, value: Column, ctx: Context) -> Column:
        """Pixels to the output unit: one literal multiplication."""
        factor = U.pixel_unit(ctx.pixel_size, self.dim) if self.dim else 1.0
        scale, offset = U.affine(self.input_unit(ctx), self.unit(ctx))
        out = value * F.lit(factor * scale) if factor * scale != 1.0 else value
        return out + F.lit(offset) if offset else out

    def columns(self, ctx: Context) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, df: DataFrame, ctx: Context) -> tuple[DataFrame, dict[str, str]]:
        made = self.columns(ctx)
        return df.withColumns(made), {n: self.unit(ctx) for n in made}


class AreaEx(Extractor):
    dim, name = 2, "area"

    def columns(self, ctx):
        return {"area": self.calibrated(G.area(F.col("coords")) if ctx.signed is None else F.abs(ctx.signed), ctx)}


class PerimeterEx(Extractor):
    dim, name = 1, "perimeter"

    def columns(self, ctx):
        return {"perimeter": self.calibrated(G.perimeter(F.col("coords"), ctx.signed), ctx)}


class CircularityEx(Extractor):
    """Reads the area and perimeter columns extracted before it."""

    name = "circularity"

    def apply(self, df, ctx):
        for need in ("area", "perimeter"):
            if need not in df.columns:
                raise KeyError(f"circularity needs the {need} column: extract it first")
        return df.withColumn("circularity", G.circularity(F.col("area"), F.col("perimeter"))), {"circularity": "dimensionless"}


class LengthWidthEx(Extractor):
    """Sides of the minimum rotated rectangle, computed once for both columns."""

    dim, name = 1, "length"
    parts: Sequence[str] = ("length", "width")

    def __init__(self, prefix: str = "", output_unit: str | None = None):
        super().__init__(output_unit)
        self.prefix = prefix

    def apply(self, df, ctx):
        sides = df.withColumn("_sides", G.rectangle_sides(F.col("coords")))
        nan = F.lit(float("nan"))  # Arrow hands NaN back as NULL
        made = {f"{self.prefix}{p}": self.calibrated(F.coalesce(F.col(f"_sides.{p}"), nan), ctx) for p in self.parts}
        return sides.withColumns(made).drop("_sides"), {n: self.unit(ctx) for n in made}


class LengthEx(LengthWidthEx):
    parts = ("length",)


class WidthEx(LengthWidthEx):
    parts = ("width",)


class PositionEx(Extractor):
    dim, name = 1, "position"

    def columns(self, ctx):
        c = G.centroid(F.col("coords"), ctx.signed)
        return {f"position_{k}": self.calibrated(c[k], ctx) for k in ("x", "y")}


class FrameEx(Extractor):
    def columns(self, ctx):
        return {"frame": F.col("frame").cast("double")}


class IdEx(Extractor):
    def columns(self, ctx):
        return {"id_value": F.col("id").cast("double")}


class LabelEx(Extractor):
    """Numeric labels only; any other label fails the query."""

    def columns(self, ctx):
        return {"label": F.col("label").cast("double")}


class BoundaryClosenessEx(Extractor):
    dim, name = 1, "boundary_closeness"

    def columns(self, ctx):
        if ctx.height is None or ctx.width is None:
            raise ValueError("boundary closeness needs the image height and width")
        d = G.boundary_closeness(F.col("coords"), F.lit(float(ctx.width)), F.lit(float(ctx.height)), ctx.signed)
        return {"boundary_closeness": self.calibrated(d, ctx)}


class TimeEx(Extractor):
    """Time of the detection's frame, from an explicit interval or the sequence's time model."""

    def __init__(self, interval: float | None = None, interval_unit: str = "second", output_unit: str = "hour"):
        super().__init__(output_unit)
        self.interval, self.interval_unit = interval, interval_unit

    def apply(self, df, ctx):
        if self.interval is not None:
            value = U.convert(F.col("frame").cast("double") * F.lit(float(self.interval)), self.interval_unit, self.output_unit)
            return df.withColumn("time", value), {"time": self.output_unit}
        if ctx.timepoints is None:
            raise ValueError("no time calibration: give an interval or timepoints")
        own = U.unit_of(ctx.timepoints, "t") or ctx.time_unit or "second"
        keys = [*ctx.by, "frame"]
        side = ctx.timepoints.select(*ctx.by, F.col("frame").cast(df.schema["frame"].dataType), U.convert(F.col("t"), own, self.output_unit).alias("time"))
        return df.join(side, keys, "left").select(*df.columns, "time"), {"time": self.output_unit}


class DynamicTimeEx(Extractor):
    """Irregular timepoints; relative ones start at the first."""

    def __init__(self, timepoints: Sequence[float], relative: bool = True, input_unit: str = "second", output_unit: str = "hour"):
        super().__init__(output_unit)
        base = timepoints[0] if relative and len(timepoints) else 0.0
        self.values, self.unit_in = [float(t) - base for t in timepoints], input_unit

    def apply(self, df, ctx):
        rows = list(enumerate(self.values))
        points = df.sparkSession.createDataFrame(rows, "frame int, t double")
        keyed = points.select(F.col("frame").cast(df.schema["frame"].dataType), U.convert(F.col("t"), self.unit_in, self.output_unit).alias("time"))
        return df.join(F.broadcast(keyed), "frame", "left").select(*df.columns, "time"), {"time": self.output_unit}


class FluorescenceEx(Extractor):
    """Per detection and channel, a summary of the pixels inside it.

    The context's `pixels` hold the detection's id (pixel-centre rule) or are joined through
    `mask` rows (frame, y, x, label). Summaries: median, mean, min, max, sum, stddev or a function
    of a column.
    """

    SUMMARIES = {
        "median": lambda c: F.percentile(c, F.lit(0.5)),
        "mean": F.avg,
        "min": F.min,
        "max": F.max,
        "sum": F.sum,
        "std": F.stddev_pop,
    }

    def __init__(self, channels: Sequence[str], names: Sequence[str] | None = None, summary="median", output_unit: str = "dimensionless"):
        super().__init__(output_unit)
        self.channels, self.names = list(channels), list(names or channels)
        if len(self.channels) != len(self.names):
            raise ValueError("as many channel names as channels are needed")
        self.summary = self.SUMMARIES[summary] if isinstance(summary, str) else summary

    def apply(self, df, ctx):
        if ctx.pixels is None:
            raise ValueError("fluorescence needs the pixel table")
        keys = [*ctx.by, "id"]
        made = ctx.pixels.groupBy(*keys).agg(*[self.summary(F.col(c)).alias(n) for c, n in zip(self.channels, self.names)])
        return df.join(made, keys, "left").select(*df.columns, *self.names), {n: self.output_unit for n in self.names}


DEFAULT = (AreaEx, PerimeterEx, CircularityEx, FrameEx)


def extract(
    detections: DataFrame, extractors: Sequence[Extractor], ctx: Context | None = None, check_ids: bool = True, keep_coords: bool = False
) -> DataFrame:
    """The property table of the detections: id and every extracted column, units in the metadata.

    Duplicate ids are an error (the historical fan-out of joining on them). No detections give a
    typed empty table.
    """
    ctx = ctx or Context()
    if check_ids:
        model.require_unique(detections, [*ctx.by, "id"])
    df, found = detections, {}
    if "coords" in detections.columns:
        # a projection of its own: several extractors read it, so it isn't inlined
        df, ctx = df.withColumn("_signed", G.signed_area(F.col("coords"))), replace(ctx, signed=F.col("_signed"))
    for e in extractors:
        df, made = e.apply(df, ctx)
        found.update(made)
    keep = [c for c in df.columns if c in found or c == "id" or c in ctx.by or (keep_coords and c == "coords")]
    return U.attach_units(df.select(*keep), found)


def combine(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Left join of property tables on a unique id; a duplicate id in any is an error."""
    out = model.require_unique(tables[0], [key])
    for t in tables[1:]:
        out = out.join(model.require_unique(t, [key]), key, "left")
    return out


# ---------------------------------------------------------------- mask-backed detections


def detections_of_masks(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per label and frame of mask pixels: id in (frame, label) order, size, centre and box.

    Label 0 is background. The centre is the median of the occupied columns and rows.
    """
    grouped = pixels.filter("label > 0").groupBy(*by, "frame", "label").agg(
        F.count("*").cast("double").alias("area"),
        F.percentile("x", F.lit(0.5)).alias("center_x"),
        F.percentile("y", F.lit(0.5)).alias("center_y"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        F.max("x").alias("x1"),
        F.max("y").alias("y1"),
    )
    return grouped.withColumn("id", F.row_number().over(W.partitionBy(*by).orderBy("frame", "label")).cast("bigint"))


def label_pixels(pixels: DataFrame) -> DataFrame:
    """Overlapping labels of a pixel: the higher one wins."""
    return pixels.groupBy("frame", "y", "x").agg(F.max("label").alias("label"))


def stack_windows(boxes: DataFrame, margin: int, height: int, width: int) -> DataFrame:
    """Bounding boxes widened by a margin and clipped to the image."""
    return boxes.select(
        "*",
        F.greatest(F.col("x0") - margin, F.lit(0)).alias("left"),
        F.greatest(F.col("y0") - margin, F.lit(0)).alias("top"),
        F.least(F.col("x1") + 1 + margin, F.lit(width)).alias("right"),
        F.least(F.col("y1") + 1 + margin, F.lit(height)).alias("bottom"),
    )
