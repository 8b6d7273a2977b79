"""Image-server catalogues as tables, and calibration read from file headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Catalogue relations: projects (id, name), datasets (id, project_id, name), images (id, dataset_id, name).


def point_lookup(table: DataFrame, key, column: str = "id") -> DataFrame:
    return table.filter(F.col(column) == F.lit(key))


def children(table: DataFrame, parent: str, key) -> DataFrame:
    """Datasets of a project, or images of a dataset."""
    return table.filter(F.col(parent) == F.lit(key))


def images_in(images: DataFrame, datasets: DataFrame, kind: str, key) -> DataFrame:
    """id of the images below a project, a dataset or an image; the kind is case-insensitive."""
    kind = kind.lower()
    if kind == "image":
        return images.filter(F.col("id") == F.lit(key)).select("id")
    if kind == "dataset":
        return children(images, "dataset_id", key).select("id")
    if kind == "project":
        own = children(datasets, "project_id", key).select(F.col("id").alias("dataset_id"))
        return images.join(own, "dataset_id", "left_semi").select("id")
    raise ValueError(f"unknown kind of object {kind!r}")


def has_all_tags(tags: Column, required: Sequence[str]) -> Column:
    """Whether an array of tags holds all required ones; none required is always true."""
    return F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce(tags, F.array().cast("array<string>")))) == 0


# ---------------------------------------------------------------- headers

_LENGTHS = {"µm": 1.0, "um": 1.0, "micron": 1.0, "microns": 1.0, "\\u00B5m": 1.0, "nm": 1e-3, "mm": 1e3, "cm": 1e4, "m": 1e6, "inch": 25400.0}
_TIMES = {"s": 1.0, "sec": 1.0, "ms": 1e-3, "min": 60.0, "h": 3600.0}


def _factor(unit: Column, table: dict[str, float], default: str) -> Column:
    u = F.coalesce(F.nullif(unit, F.lit("")), F.lit(default))
    out = F.lit(None).cast("double")
    for name, f in table.items():
        out = F.when(u == name, F.lit(f)).otherwise(out)
    return out


def ome_calibration(xml: Column) -> Column:
    """(pixel_size in µm, frame_interval in s) of an OME header; sizes that aren't positive are NULL."""
    pixels = "//*[local-name()='Pixels']"
    size = F.xpath_string(xml, F.lit(f"{pixels}/@PhysicalSizeX")).try_cast("double")
    step = F.xpath_string(xml, F.lit(f"{pixels}/@TimeIncrement")).try_cast("double")
    um = size * _factor(F.xpath_string(xml, F.lit(f"{pixels}/@PhysicalSizeXUnit")), _LENGTHS, "µm")
    s = step * _factor(F.xpath_string(xml, F.lit(f"{pixels}/@TimeIncrementUnit")), _TIMES, "s")
    return F.struct(F.when(um > 0, um).alias("pixel_size"), F.when(s > 0, s).alias("frame_interval"))


def plane_timepoints(planes: DataFrame, n_frames: int, by: Sequence[str] = ()) -> DataFrame:
    """by, frame, t: the first DeltaT of each frame, only where all frames 0..n-1 have one.

    planes: by, position, the_t, delta_t.
    """
    first = planes.filter("delta_t is not null").groupBy(*by, F.col("the_t").alias("frame")).agg(F.min_by("delta_t", "position").alias("t"))
    inside = first.filter((F.col("frame") >= 0) & (F.col("frame") < n_frames))
    whole = inside.groupBy(*by).count() if by else inside.groupBy().count()
    whole = whole.filter(F.col("count") == n_frames).drop("count")
    return inside.join(whole, list(by), "left_semi") if by else inside.crossJoin(whole)  # one row or none


def imagej_calibration(description: Column, numerator: Column, denominator: Column) -> Column:
    """(pixel_size in µm, frame_interval in s) of an ImageJ description and a resolution fraction (pixels per unit)."""
    field = lambda k: F.regexp_extract(description, rf"(?m)^{k}=(.*)$", 1)
    per = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    size = F.when(per > 0, 1.0 / per) * _factor(field("unit"), _LENGTHS, "")
    step = field("finterval").try_cast("double")
    return F.struct(size.alias("pixel_size"), F.when(step > 0, step).alias("frame_interval"))


def calibration(xml: Column, description: Column, numerator: Column, denominator: Column) -> Column:
    """OME first, then ImageJ, else NULLs."""
    a, b = ome_calibration(xml), imagej_calibration(description, numerator, denominator)
    is_ome, is_imagej = xml.isNotNull() & (xml != ""), description.startswith("ImageJ")
    pick = lambda k: F.when(is_ome, a[k]).when(is_imagej, b[k])
    return F.struct(
        pick("pixel_size").alias("pixel_size"), pick("frame_interval").alias("frame_interval"), F.when(is_ome, "ome").when(is_imagej, "imagej").alias("source")
    )
