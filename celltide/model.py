"""Canonical relations and the operations on a detection set (overlay).

`source_id` may lead any relation; every operator takes the columns that name its partition as
`by`, so a batch of sequences is only a wider grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
DETECTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("label", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("coords", T.ArrayType(POINT)),
    ]
)
MASK_PIXELS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("frame", "y", "x", "label")])
TRANSFORM = T.StructType([T.StructField(n, T.DoubleType()) for n in ("dx", "dy", "theta", "confidence")])


def detections(spark: SparkSession, rows) -> DataFrame:
    """Detections from (id, frame, label, score, [(x, y), ...]) rows."""
    return spark.createDataFrame([(i, f, la, s, [tuple(map(float, p)) for p in c]) for i, f, la, s, c in rows], DETECTIONS)


def duplicate_ids(df: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """`df`, or ValueError naming a duplicate key: joining on it would fan out."""
    found = duplicate_ids(df, key).limit(1).collect()
    if found:
        raise ValueError(f"duplicate contour id {found[0][:-1]} ({found[0].n} rows)")
    return df


def unique_or_raise(df: DataFrame, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The same check inside the plan, for lazy pipelines: the query fails when it meets a duplicate."""
    n = F.count("*").over(W.partitionBy(*by, key))
    message = F.concat(F.lit("duplicate contour id "), F.col(key).cast("string"))
    return df.withColumn(key, F.when(n > 1, F.raise_error(message).cast(df.schema[key].dataType)).otherwise(F.col(key)))


# ---------------------------------------------------------------- overlay operations


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union of two detection sets."""
    return a.unionByName(b)


def frames(df: DataFrame, declared: Sequence[int] | None = None) -> DataFrame:
    """The frame list: the declared one if given (even if empty), else the distinct frames."""
    if declared is not None:
        return df.sparkSession.createDataFrame([(int(f),) for f in declared], "frame int")
    return df.select("frame").distinct()


def frame_extent(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest frame plus one, 0 if there is none."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(F.coalesce(F.max("frame") + 1, F.lit(0)).cast("int").alias("extent"))


def slice_frames(
    df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None, by: Sequence[str] = (), frame: str = "frame"
) -> DataFrame:
    """Python slice over *positions in the sorted frame list*; frames are renumbered from 0, the old one kept as source_frame.

    Negative positions count from the end, as in Python; a negative step is refused.
    """
    step = 1 if step is None else step
    if step < 1:
        raise ValueError("slice step must be positive")
    # the frame list, not the detections, is numbered: its size is that of the time axis
    listed = df.select(*by, frame).distinct()
    order = W.partitionBy(*by).orderBy(frame)
    whole = W.partitionBy(*by)
    listed = listed.withColumn("_p", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(whole))

    def bound(value: int) -> Column:
        return F.greatest(F.lit(0), F.col("_n") + value) if value < 0 else F.lit(value)

    keep = F.lit(True)
    first = F.lit(0)
    if start is not None:
        first = bound(start)
        keep = keep & (F.col("_p") >= first)
    if stop is not None:
        keep = keep & (F.col("_p") < bound(stop))
    keep = keep & ((F.col("_p") - first) % step == 0)
    chosen = listed.filter(keep).select(*by, frame, F.floor((F.col("_p") - first) / step).cast("int").alias("_new"))
    out = df.join(chosen, [*by, frame])
    return out.withColumnRenamed(frame, "source_frame").withColumnRenamed("_new", frame).select(*df.columns, "source_frame")


def pick_frames(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The listed positions of the sorted frame list, in that order, as frames 0..n-1."""
    listed = df.select("frame").distinct().withColumn("_p", F.row_number().over(W.orderBy("frame")) - 1)
    n = listed.count()
    wanted = []
    for new, p in enumerate(positions):
        if not -n <= p < n:
            raise IndexError(f"frame position {p} out of range for {n} frames")
        wanted.append((p % n, new))
    chosen = df.sparkSession.createDataFrame(wanted, "_p int, _new int").join(listed, "_p").select("frame", "_new")
    out = df.join(chosen, "frame")
    return out.withColumnRenamed("frame", "source_frame").withColumnRenamed("_new", "frame").select(*df.columns, "source_frame")


def scale_coords(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn(
        "coords", F.transform("coords", lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))
    )


def cropped(df: DataFrame, x0: float, y0: float, width: float, height: float) -> DataFrame:
    """Polygons fully inside the rectangle, moved to its origin."""
    inside = F.forall(
        "coords", lambda p: (p["x"] >= x0) & (p["x"] <= x0 + width) & (p["y"] >= y0) & (p["y"] <= y0 + height)
    )
    moved = F.transform("coords", lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    return df.filter(inside & (F.size("coords") > 0)).withColumn("coords", moved)


def per_frame(
    df: DataFrame, declared: DataFrame | None = None, start: int | None = None, end: int | None = None
) -> DataFrame:
    """One row per frame in order with its detections' ids; declared frames appear even if empty.

    With declared frames, start and end are ignored; else every frame from start (0) to end is given.
    """
    grouped = df.groupBy("frame").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    if declared is None:
        last = df.agg(F.max("frame")).first()[0]
        end = last if end is None else end
        start = df.agg(F.min("frame")).first()[0] if start is None else start
        if end is None:
            return grouped
        declared = df.sparkSession.range(int(start), int(end) + 1).select(F.col("id").cast("int").alias("frame"))
    out = declared.select("frame").join(grouped, "frame", "left")
    return out.withColumn("ids", F.coalesce("ids", F.array().cast(grouped.schema["ids"].dataType)))


# ---------------------------------------------------------------- time model


def resolve_timepoints(
    spark: SparkSession, n: int, timepoints: Sequence[float] | None = None, frame_interval: float | None = None, unit: str = "second"
) -> DataFrame | None:
    """frame, t: the explicit timepoints (as many as frames), else a regular grid, else None."""
    from celltide.functions import units as U

    if timepoints is not None:
        if len(timepoints) != n:
            raise ValueError(f"{len(timepoints)} timepoints for {n} frames")
        out = spark.createDataFrame([(i, float(t)) for i, t in enumerate(timepoints)], "frame int, t double")
    elif frame_interval is not None:
        out = spark.range(n).select(F.col("id").cast("int").alias("frame"), (F.col("id") * F.lit(float(frame_interval))).alias("t"))
    else:
        return None
    return U.attach_units(out, {"t": unit})


def frame_interval(timepoints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step from the first frame to the second; NULL with fewer than two."""
    order = W.partitionBy(*by).orderBy("frame")
    stepped = timepoints.withColumn("_n", F.row_number().over(order)).withColumn(
        "frame_interval", F.lead("t").over(order) - F.col("t")
    )
    return stepped.filter("_n = 1").select(*by, "frame_interval")


def with_time(df: DataFrame, timepoints: DataFrame, by: Sequence[str] = (), frame: str = "frame", out: str = "time") -> DataFrame:
    """Each row's timepoint; frames outside the time model get NULL."""
    side = timepoints.select(*by, F.col("frame").alias(frame), F.col("t").alias(out))
    return df.join(side, [*by, frame], "left")


def sliced_time(timepoints: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The time model re-sliced together with the frames."""
    return slice_frames(timepoints, start, stop, step, by).drop("source_frame")


def sliced_pixel_size(pixel_size, step_y: int = 1, step_x: int = 1):
    """Pixel size of a view with spatial steps: scaled, or (y, x) if the steps differ."""
    if pixel_size is None:
        return None
    if isinstance(pixel_size, (int, float)):
        return pixel_size * step_y if step_y == step_x else (pixel_size * step_y, pixel_size * step_x)
    return pixel_size[0] * step_y, pixel_size[1] * step_x
