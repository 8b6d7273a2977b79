"""Interchange formats of detections, tracks, selections and transforms."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltide.functions import units as U

SEGMENTATION = "array<struct<frame:int,detections:array<struct<label:string,contour:array<array<double>>,id:string>>>>"
TRACKING = (
    "struct<segmentation:array<struct<label:string,contour:array<array<double>>,id:string,frame:int>>,"
    "tracking:array<struct<sourceId:string,targetId:string>>>"
)


def _points(contour: Column) -> Column:
    return F.transform(contour, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _pairs(coords: Column) -> Column:
    return F.transform(coords, lambda p: F.array(p["x"], p["y"]))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, value: whole JSON files, gzip read by name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_segmentation(documents: DataFrame, value: str = "value") -> DataFrame:
    """id, frame, label, score (-1), coords of simple segmentation JSON; ids stay text unless all are numbers of one document."""
    keep = [c for c in documents.columns if c != value]
    frames = documents.select(*keep, F.explode(F.from_json(value, SEGMENTATION)).alias("f"))
    rows = frames.select(*keep, F.col("f.frame").alias("frame"), F.explode("f.detections").alias("d"))
    return rows.select(*keep, "d.id", "frame", "d.label", F.lit(-1.0).alias("score"), _points(F.col("d.contour")).alias("coords"))


def segmentation_json(detections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """value: one simple segmentation document per partition, frames in order, empty ones left out."""
    one = F.struct(F.col("label").cast("string").alias("label"), _pairs(F.col("coords")).alias("contour"), F.col("id").cast("string").alias("id"))
    frames = detections.groupBy(*by, "frame").agg(F.array_sort(F.collect_list(F.struct("id", one.alias("d")))).alias("ds"))
    frames = frames.select(*by, F.struct("frame", F.transform("ds", lambda x: x["d"]).alias("detections")).alias("f"), "frame")
    grouped = frames.groupBy(*by) if by else frames.groupBy()
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct("frame", "f"))).alias("fs"))
    return listed.select(*by, F.to_json(F.transform("fs", lambda x: x["f"])).alias("value"))


def parse_tracking(documents: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Detections and edges (src, dst) of simple tracking JSON; ids of both become BIGINT, links need both ends."""
    parsed = documents.select(F.from_json(value, TRACKING).alias("t"))
    rows = parsed.select(F.explode("t.segmentation").alias("d")).select(
        F.col("d.id").try_cast("bigint").alias("id"),
        "d.frame",
        "d.label",
        F.lit(-1.0).alias("score"),
        _points(F.col("d.contour")).alias("coords"),
    )
    links = parsed.select(F.explode("t.tracking").alias("l")).select(
        F.col("l.sourceId").try_cast("bigint").alias("src"), F.col("l.targetId").try_cast("bigint").alias("dst")
    )
    ids = rows.select("id")
    links = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows, links.select("src", "dst")


def tracking_json(detections: DataFrame, edges: DataFrame) -> DataFrame:
    """value: one simple tracking document."""
    d = F.struct(
        F.col("label").cast("string").alias("label"), _pairs(F.col("coords")).alias("contour"), F.col("id").cast("string").alias("id"), "frame"
    )
    nodes = detections.agg(F.array_sort(F.collect_list(F.struct("frame", "id", d.alias("d")))).alias("n"))
    links = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    both = nodes.crossJoin(links)  # one row each
    link = lambda x: F.struct(x["src"].cast("string").alias("sourceId"), x["dst"].cast("string").alias("targetId"))
    return both.select(
        F.to_json(F.struct(F.transform("n", lambda x: x["d"]).alias("segmentation"), F.transform("e", link).alias("tracking"))).alias("value")
    )


# ---------------------------------------------------------------- tracklet text

TRACKLET_TEXT = "label bigint, start_frame int, end_frame int, parent bigint"


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated `label start end parent` lines, parent 0 being none."""
    return spark.read.schema(TRACKLET_TEXT).option("sep", " ").csv(path)


def tracklet_lines(tracklets: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """value: lines of tracklet text in label order; of several parents the first is written."""
    parent = edges.groupBy(F.col("child").alias(label)).agg(F.min("parent").alias("parent"))
    rows = tracklets.join(parent, label, "left")
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in (label, "start_frame", "end_frame")], F.coalesce("parent", F.lit(0)).cast("string"))
    return rows.orderBy(label).select(line.alias("value"))


def require_frames(detections: DataFrame, size_t: int) -> DataFrame:
    """`detections`; a frame outside 0..size_t-1 is an error."""
    bad = detections.filter((F.col("frame") >= size_t) | (F.col("frame") < 0)).limit(1).collect()
    if bad:
        raise ValueError(f"frame {bad[0]['frame']} is outside the sequence of {size_t} frames")
    return detections


# ---------------------------------------------------------------- archives


def save_archive(detections: DataFrame, path: str) -> None:
    """Columnar archive; one id type by schema. Partition columns aren't needed: frames cluster by sorting."""
    detections.sortWithinPartitions("frame", "id").write.mode("overwrite").parquet(path)


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flat_archive(spark: SparkSession, path: str) -> DataFrame:
    """Detections of .npz archives: flat coordinates with offsets, ids, labels and frames."""

    def read(batches):
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                coords, offsets = z["coords"].astype(float), z["offsets"]
                rows = [
                    (str(i), int(f), str(la), [{"x": float(x), "y": float(y)} for x, y in coords[a:b]])
                    for i, f, la, a, b in zip(z["ids"], z["frames"], z["labels"], offsets[:-1], offsets[1:])
                ]
                yield pd.DataFrame(rows, columns=["id", "frame", "label", "coords"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, "id string, frame int, label string, coords array<struct<x:double,y:double>>")


def load_segmentation(spark: SparkSession, path: str, size_t: int | None = None, timepoints: DataFrame | None = None) -> DataFrame:
    """Detections of a columnar archive, an .npz archive or (gzipped) JSON, told by the name; a time model adds `time`."""
    from celltide import model

    tail = path.rstrip("/").lower()
    if tail.endswith(".npz"):
        out = flat_archive(spark, path)
    elif tail.endswith((".json", ".json.gz")):
        out = parse_segmentation(json_documents(spark, path)).drop("path")
    else:
        out = load_archive(spark, path)
    if size_t is not None:
        out = require_frames(out, size_t)
    return out if timepoints is None else model.with_time(out, timepoints)


CROP = "struct<center:array<double>,size:array<int>,angle:double,frame:int,channel:int,source:string>"


def load_crop_specs(documents: DataFrame, value: str = "value") -> DataFrame:
    """center, size, angle and origin of crop side files."""
    return documents.select(F.from_json(value, CROP).alias("c")).select("c.*")


def crop_spec_json(specs: DataFrame) -> DataFrame:
    return specs.select(F.to_json(F.struct(*specs.columns)).alias("value"))


# ---------------------------------------------------------------- selections and transforms

SELECTION = (
    "struct<schema:string,created:string,source:struct<path:string,fingerprint:struct<size:bigint,mtime:double>>,roi_mode:string,"
    "selections:array<struct<position:int,roi:struct<center:array<double>,size:array<int>,angle:double>,label:string,id:string,"
    "notes:string,preview:string,anchor_frame:int>>>"
)
REGISTRATION = (
    "struct<schema:string,created:string,source:struct<path:string,fingerprint:struct<size:bigint,mtime:double>>,method:string,"
    "records:array<struct<position:int,method:string,reference_frame:int,failed_frames:array<int>,notes:string,"
    "transforms:map<string,struct<dx:double,dy:double,theta:double,confidence:double>>>>>"
)


def load_selections(documents: DataFrame, value: str = "value") -> DataFrame:
    """position, center, size, angle, label, id, notes, anchor_frame of curated regions."""
    rows = documents.select(F.explode(F.from_json(value, SELECTION)["selections"]).alias("s"))
    return rows.select(
        "s.position", "s.roi.center", "s.roi.size", "s.roi.angle", "s.label", "s.id", "s.notes", F.coalesce("s.anchor_frame", F.lit(0)).alias("anchor_frame")
    )


def selections_json(selections: DataFrame, source: str, schema: str = "celltide.selection/v1") -> DataFrame:
    """value: one document; the anchor frame is written only where it isn't 0."""
    one = F.struct(
        "position",
        F.struct("center", "size", "angle").alias("roi"),
        "label",
        "id",
        "notes",
        F.when(F.col("anchor_frame") != 0, F.col("anchor_frame")).alias("anchor_frame"),
    )
    listed = selections.agg(F.array_sort(F.collect_list(F.struct("position", "id", one.alias("s")))).alias("x"))
    return listed.select(
        F.to_json(
            F.struct(F.lit(schema).alias("schema"), F.struct(F.lit(source).alias("path")).alias("source"), F.transform("x", lambda s: s["s"]).alias("selections"))
        ).alias("value")
    )


def load_transforms(documents: DataFrame, value: str = "value") -> DataFrame:
    """position, frame, transform; a missing theta is 0, a missing confidence NULL."""
    rows = documents.select(F.explode(F.from_json(value, REGISTRATION)["records"]).alias("r"))
    rows = rows.select("r.position", F.explode("r.transforms").alias("frame", "t"))
    return rows.select(
        "position",
        F.col("frame").cast("int").alias("frame"),
        F.struct("t.dx", "t.dy", F.coalesce("t.theta", F.lit(0.0)).alias("theta"), "t.confidence").alias("transform"),
    )


def transforms_json(transforms: DataFrame, method: str, source: str, schema: str = "celltide.registration/v1") -> DataFrame:
    """value: one document, its transforms keyed by frame."""
    item = F.struct(F.col("frame").cast("string").alias("frame"), "transform")
    records = transforms.groupBy("position").agg(F.map_from_entries(F.array_sort(F.collect_list(item))).alias("transforms"))
    one = F.struct("position", F.lit(method).alias("method"), F.col("transforms"))
    # maps have no order, so records are sorted as (position, row number) and joined back by index
    listed = records.agg(F.array_sort(F.collect_list("position")).alias("order"), F.map_from_entries(F.collect_list(F.struct("position", one.alias("r")))).alias("by"))
    return listed.select(
        F.to_json(
            F.struct(
                F.lit(schema).alias("schema"),
                F.lit(method).alias("method"),
                F.struct(F.lit(source).alias("path")).alias("source"),
                F.transform("order", lambda p: F.col("by")[p]).alias("records"),
            )
        ).alias("value")
    )


def changed_sources(documents: DataFrame, current: DataFrame, schema: str = SELECTION, value: str = "value") -> DataFrame:
    """Documents whose recorded source size or time isn't the current one."""
    s = documents.select(F.from_json(value, schema)["source"].alias("s")).select("s.path", F.col("s.fingerprint.size").alias("was"), F.col("s.fingerprint.mtime").alias("then"))
    return s.join(current, "path").filter((F.col("was") != F.col("size")) | (F.col("then") != F.col("mtime")))


# ---------------------------------------------------------------- tables with units


def write_units_csv(df: DataFrame, path: str) -> None:
    """CSV of a result table with its units in the second header row. Result tables are driver-sized by purpose."""
    found = U.units(df)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerow([found.get(c, "") for c in df.columns])
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def read_units_csv(spark: SparkSession, path: str) -> DataFrame:
    """The inverse: DOUBLE where a column has a unit or all values are numbers, else text."""
    with open(path, newline="", encoding="utf-8") as f:
        names, units = [next(csv.reader(f)) for _ in range(2)]
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    header = F.lit(True)
    unit_row = F.lit(True)
    for n, u in zip(names, [u or None for u in units]):
        header = header & F.col(n).eqNullSafe(n)
        unit_row = unit_row & F.col(n).eqNullSafe(u)
    body = raw.filter(~header & ~unit_row)
    numbers = body.agg(*[F.count_if(F.col(n).isNotNull() & F.col(n).try_cast("double").isNull()).alias(n) for n in names]).first()
    typed = body.select(*[F.col(n).try_cast("double").alias(n) if numbers[n] == 0 else F.col(n) for n in names])
    return U.attach_units(typed, {n: u for n, u in zip(names, units) if u})
