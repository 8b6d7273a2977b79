"""Scalar column expressions: strings, times, colours, angles and intensities."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def stem(path: Column) -> Column:
    """File name without directory, query string and last extension; a leading dot is no extension."""
    name = basename(F.split(path, "\\?", 2)[0])
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def natural_key(name: Column) -> Column:
    """Sort key by which t2 comes before t10: (text, number) pairs of the lower-cased basename, then the basename."""
    base = F.lower(basename(name))
    texts = F.split(base, r"\d+")
    numbers = F.transform(F.regexp_extract_all(base, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.cast("decimal(38,0)"))
    pairs = F.transform(
        F.arrays_zip(texts.alias("text"), numbers.alias("number")),
        lambda p: F.struct(F.coalesce(p["text"], F.lit("")).alias("text"), F.coalesce(p["number"], F.lit(-1).cast("decimal(38,0)")).alias("number")),
    )
    return F.struct(pairs.alias("pairs"), base.alias("basename"))


def is_frame_file(path: Column, pattern: str | None = None) -> Column:
    """TIFF, no dot-file, and matching the glob `pattern`; case-insensitive."""
    base = F.lower(basename(path))
    keep = ~base.startswith(".") & base.rlike(r"\.tiff?$")
    if pattern is not None:
        import fnmatch

        keep = keep & base.rlike(fnmatch.translate(pattern.lower()).replace("(?s:", "(?s:").replace(r"\Z", "$").replace(r"\z", "$"))
    return keep


def parsed_keys(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Columns of the named groups of `pattern`, matched at the start: NULL where it doesn't match.

    A group whose matches are all digits becomes BIGINT where the pattern says so (`\\d`), else stays text.
    """
    names = re.compile(pattern).groupindex
    if not names:
        raise ValueError(f"key pattern {pattern!r} has no named groups")
    java = "^(?:" + re.sub(r"\(\?P<", "(?<", pattern) + ")"
    for name, k in names.items():
        raw = F.when(F.col(column).rlike(java), F.regexp_extract(column, java, k))
        body = re.search(rf"\(\?P<{name}>([^()]*)\)", pattern)
        digits = body is not None and re.fullmatch(r"(\\d|\[0-9\])(\+|\*|\{\d+(,\d*)?\})?", body[1])
        df = df.withColumn(name, raw.try_cast("bigint") if digits else raw)
    return df


def execution_name(source: Column, kind: str) -> Column:
    """`execution_<id>` of an integer source, the file stem of a text source."""
    if kind in ("int", "bigint"):
        return F.concat(F.lit("execution_"), source.cast("string"))
    if kind == "string":
        return stem(source)
    raise ValueError(f"cannot name an execution after a {kind}")


_SECONDS = {"W": 604800, "D": 86400, "H": 3600, "M": 60, "S": 1}
_TO_SECONDS = {"timedelta": 1, "s": 1, "seconds": 1, "m": 60, "minutes": 60, "h": 3600, "hours": 3600, "d": 86400, "days": 86400, "w": 604800, "weeks": 604800}


def strfdelta(value: Column, fmt: str = "{D:02}d {H:02}h {M:02}m {S:02}s", inputtype: str = "seconds") -> Column:
    """A duration split over the fields that `fmt` names, larger fields first."""
    left = value.cast("bigint") * _TO_SECONDS[inputtype]
    fields = [f for _, f, _, _ in Formatter().parse(fmt) if f]
    shares = {}
    for name, size in _SECONDS.items():
        if name in fields:
            shares[name] = F.floor(left / size).cast("bigint")
            left = left - shares[name] * size
    parts: list[Column] = []
    for text, field, spec, _ in Formatter().parse(fmt):
        if text:
            parts.append(F.lit(text))
        if field:
            out = shares[field].cast("string")
            if spec:
                width = int(spec.lstrip("0") or 0)
                out = F.when(F.length(out) < width, F.lpad(out, width, "0" if spec.startswith("0") else " ")).otherwise(out)
            parts.append(out)
    return F.concat(*parts)


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    k, m, g = 1024.0, 1024.0**2, 1024.0**3

    def tenths(x: Column) -> Column:  # ties to even, as sizes over powers of two are exact
        return F.rint(x * 10) / 10

    return (
        F.when(size.isNull(), "")
        .when(size < k, F.format_string("%.0f B", size.cast("double")))
        .when(size < m, F.format_string("%.1f KB", tenths(size / k)))
        .when(size < g, F.format_string("%.1f MB", tenths(size / m)))
        .otherwise(F.format_string("%.1f GB", tenths(size / g)))
    )


def utc_text(epoch: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC text of second precision."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(epoch)).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def rgba_to_int(red: Column, green: Column, blue: Column, alpha: Column | None = None) -> Column:
    """Colour packed into a signed 32-bit integer."""
    a = F.lit(255) if alpha is None else alpha
    packed = red.cast("bigint") * (1 << 24) + green * (1 << 16) + blue * (1 << 8) + a
    return F.when(packed > (1 << 31) - 1, packed - (1 << 32)).otherwise(packed)


def polygon_text(coords: Column) -> Column:
    """'x,y x,y' of an array of (x, y)."""
    return F.array_join(F.transform(coords, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def polygon_from_text(text: Column) -> Column:
    pair = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), pair)


def wrap_angle(angle: Column) -> Column:
    """A line's angle moved by 180 degrees at most once, into (-90, 90]."""
    return F.when(angle <= -90, angle + 180).when(angle > 90, angle - 180).otherwise(angle)


def angle_diff(a: Column, b: Column) -> Column:
    """Difference of two line angles in [-90, 90)."""
    x = a - b + 90
    return x - F.floor(x / 180) * 180 - 90


def line_normal(angle: Column) -> Column:
    r = F.radians(angle)
    return F.struct((-F.sin(r)).alias("x"), F.cos(r).alias("y"))


def parabolic_refine(before: Column, at: Column, after: Column) -> Column:
    """Sub-sample vertex of three samples around a peak, within half a sample; 0 where flat or NaN."""
    curve = before - 2 * at + after
    return F.when((F.abs(curve) < 1e-12) | F.isnan(curve), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (before - after) / curve)))


def lut(value: Column, in_min, in_max, out_min, out_max) -> Column:
    """Clip to the input range, then rescale to the output range."""
    clipped = F.greatest(F.lit(float(in_min)), F.least(F.lit(float(in_max)), value))
    return (clipped - F.lit(float(in_min))) / (in_max - in_min) * (out_max - out_min) + out_min


def to_uint8(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..255, rounded down; a flat image gives 0."""
    return F.when(high > low, F.floor((value - low) / (high - low) * 255)).otherwise(0).cast("int")


def linear_index(frame: Column, size_t: int, size_z: int) -> Column:
    """(t, z) of a frame number that was linearised with `size_t` frames a plane."""
    if size_t > 1 and size_z > 1:
        return F.struct(F.floor(frame / size_t).cast("int").alias("t"), (frame % size_t).cast("int").alias("z"))
    zero = F.lit(0)
    return F.struct((frame if size_t > 1 else zero).cast("int").alias("t"), (frame if size_z > 1 else zero).cast("int").alias("z"))


NAMED_COLORS = {
    # fixed values: the names a channel colour may have
    "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
    "yellow": (255, 255, 0), "white": (255, 255, 255), "gray": (128, 128, 128), "grey": (128, 128, 128),
}


def channel_color(name: Column) -> Column:
    """(r, g, b) of a colour name, case-insensitive, or of '#rrggbb'; NULL otherwise."""
    key = F.lower(F.trim(name))
    out = F.when(
        key.rlike("^#[0-9a-f]{6}$"),
        F.array(*[F.conv(F.substring(key, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]),
    )
    for n, rgb in NAMED_COLORS.items():
        out = out.when(key == n, F.array(*map(F.lit, rgb)))
    return out


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corner points of a box."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def eta(elapsed: Column, done: Column, left: Column) -> Column:
    """Remaining seconds at the rate so far; NULL before the first frame."""
    return F.when(done > 0, elapsed / done * left)
