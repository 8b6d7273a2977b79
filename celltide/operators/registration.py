"""Rigid transforms per frame, and their estimation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class RegistrationError(RuntimeError):
    """No estimate is possible."""


class LowConfidenceWarning(UserWarning):
    """A weak fit was kept."""


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """Turned by an angle counter-clockwise as seen in an image, whose y axis points down: [[cos, sin], [-sin, cos]]."""
    r = F.radians(degrees)
    return F.cos(r) * x + F.sin(r) * y, F.cos(r) * y - F.sin(r) * x


def compose(first: Column, second: Column) -> Column:
    """`first`, then `second`: angles add, the first shift is turned by the second angle; confidence is the lesser, NULL if either is."""
    x, y = rotate(first["dx"], first["dy"], second["theta"])
    weak = F.when(first["confidence"].isNotNull() & second["confidence"].isNotNull(), F.least(first["confidence"], second["confidence"]))
    return F.struct(
        (second["dx"] + x).alias("dx"),
        (second["dy"] + y).alias("dy"),
        (first["theta"] + second["theta"]).alias("theta"),
        weak.alias("confidence"),
    )


def invert(t: Column) -> Column:
    x, y = rotate(-t["dx"], -t["dy"], -t["theta"])
    return F.struct(x.alias("dx"), y.alias("dy"), (-t["theta"]).alias("theta"), t["confidence"].alias("confidence"))


def correction_matrix(t: Column, height: float, width: float) -> Column:
    """2x3 matrix (row-major) of the inverse of: turn about the image centre, then shift."""
    cx, cy = width / 2.0, height / 2.0
    r = F.radians(t["theta"])
    c, s = F.cos(r), F.sin(r)
    px, py = F.lit(cx) + t["dx"], F.lit(cy) + t["dy"]
    return F.array(c, -s, F.lit(cx) - c * px + s * py, s, c, F.lit(cy) - s * px - c * py)


def correct_spec(center_x: Column, center_y: Column, angle: Column, t: Column, height: float, width: float) -> Column:
    """A rotated crop's centre and angle under the correction; a NULL transform changes nothing."""
    m = correction_matrix(t, height, width)
    x = m[0] * center_x + m[1] * center_y + m[2]
    y = m[3] * center_x + m[4] * center_y + m[5]
    return F.struct(
        F.when(t.isNull(), center_x).otherwise(x).alias("center_x"),
        F.when(t.isNull(), center_y).otherwise(y).alias("center_y"),
        F.when(t.isNull(), angle).otherwise(angle + t["theta"]).alias("angle"),
    )


def decompose(a: Column, b: Column, tx: Column, c: Column, d: Column, ty: Column, cx: float, cy: float) -> Column:
    """(dx, dy, theta) of a similarity matrix about a centre; values that aren't finite are an error."""
    theta = F.degrees(F.atan2(b - c, a + d))
    x, y = a * cx + b * cy + tx - cx, c * cx + d * cy + ty - cy
    whole = x + y + theta
    ok = whole.isNotNull() & ~F.isnan(whole) & (F.abs(whole) != float("inf"))
    fail = F.raise_error(F.lit("transform is not finite")).cast("double")
    return F.struct(F.when(ok, x).otherwise(fail).alias("dx"), y.alias("dy"), theta.alias("theta"))


PARTS = 64  # ranges of frames that are looked up apart
ANGLES = 100_000  # distinct reference angles that are broadcast


def _range(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending `cuts` are at most x, by halving."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(cuts[mid]), among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(cuts))


def nearest_transform(frames: DataFrame, transforms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each frame with the transform of the nearest stored frame, ties to the lower one; none for a NULL frame.

    A linear as-of join: the last stored frame at or before and the first one after, by windows that
    only grow. Frames are dealt by ranges, each of which also holds the nearest stored frames outside it.
    """
    side = transforms.filter(F.col("frame").isNotNull())
    side = side.select(*by, F.col("frame"), F.struct(F.col("frame").alias("at"), F.col("transform").alias("transform")).alias("_s"))
    asked = frames.select(*by, "frame", F.lit(None).cast(side.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_q"))
    both = asked.unionByName(side.withColumn("_q", F.lit(0)))
    cuts = sorted(set(both.approxQuantile("frame", [k / PARTS for k in range(1, PARTS)], 0.002)))
    both = both.withColumn("_part", _range(F.col("frame"), cuts))
    ends = both.filter("_q = 0").groupBy(*by, "_part").agg(F.min_by("_s", "frame").alias("lo"), F.max_by("_s", "frame").alias("hi"))
    kind = ends.schema["lo"].dataType
    every = ends.groupBy(*by).agg(F.count("*")).select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("_part"))
    every = every.select("*", F.lit(None).cast(kind).alias("lo"), F.lit(None).cast(kind).alias("hi"))
    spans = ends.unionByName(every).groupBy(*by, "_part").agg(F.first("lo", True).alias("lo"), F.first("hi", True).alias("hi"))
    grown = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    beyond = F.array(F.last("hi", True).over(grown.orderBy("_part")), F.last("lo", True).over(grown.orderBy(F.desc("_part"))))
    carried = spans.select(*by, "_part", beyond.alias("_c")).select(*by, "_part", F.explode("_c").alias("_s")).filter("_s is not null")
    carried = carried.select(*by, F.col("_s.at").alias("frame"), "_s", F.lit(0).alias("_q"), "_part")
    one = W.partitionBy(*by, "_part").rowsBetween(W.unboundedPreceding, 0)
    before = F.last("_s", True).over(one.orderBy("frame", "_q"))
    after = F.last("_s", True).over(one.orderBy(F.desc("frame"), "_q"))
    found = both.unionByName(carried).withColumn("_b", before).withColumn("_a", after).filter("_q = 1")
    nearer = (F.col("_b").isNull()) | (F.col("_a.at") - F.col("frame") < F.col("frame") - F.col("_b.at"))
    pick = F.when(F.col("frame").isNull(), None).when(F.col("_a").isNull(), F.col("_b")).when(nearer, F.col("_a")).otherwise(F.col("_b"))
    return found.select(*by, "frame", pick["at"].alias("source_frame"), pick["transform"].alias("transform"))


def registered(frames: DataFrame, transforms: DataFrame, on_missing: str = "warn", by: Sequence[str] = ()) -> DataFrame:
    """Frames with their stored transform: 'warn' leaves NULL, 'nearest' takes the nearest, 'error' fails."""
    if on_missing == "nearest":
        return nearest_transform(frames, transforms, by)
    out = frames.join(transforms.select(*by, "frame", "transform"), [*by, "frame"], "left")
    if on_missing == "error":
        missing = F.raise_error(F.concat(F.lit("no transform for frame "), F.col("frame").cast("string")))
        kind = transforms.schema["transform"].dataType
        return out.withColumn("transform", F.when(F.col("transform").isNull(), missing.cast(kind)).otherwise(F.col("transform")))
    if on_missing != "warn":
        raise ValueError(f"unknown policy {on_missing!r}")
    return out


def gate(score: Column, threshold: float, policy: str = "keep") -> Column:
    """'ok', 'low' (kept with a warning) or, under the policy 'reject', 'rejected'."""
    if policy not in ("keep", "reject"):
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(score >= threshold, "ok").otherwise("low" if policy == "keep" else "rejected")


def sample_frames(size: int, reference: int, n: int) -> list[int]:
    """Evenly spread frame indices, the reference left out unless it is the only one."""
    picked = list(dict.fromkeys(int(round(x)) for x in np.linspace(0, size - 1, min(n, size))))
    rest = [p for p in picked if p != reference]
    return rest or picked


def chain(transforms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Frame-to-frame transforms composed onto the first frame, by a running fold over the sorted steps of a sequence."""
    item = F.struct("frame", "transform")
    listed = transforms.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("steps")) if by else transforms.groupBy().agg(
        F.array_sort(F.collect_list(item)).alias("steps")
    )
    kind = "array<struct<frame:int,transform:struct<dx:double,dy:double,theta:double,confidence:double>>>"
    start = F.array().cast(kind)

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        now = F.when(F.size(acc) == 0, s["transform"]).otherwise(compose(last["transform"], s["transform"]))
        return F.concat(acc, F.array(F.struct(s["frame"].cast("int").alias("frame"), now.alias("transform"))).cast(kind))

    out = listed.select(*by, F.explode(F.aggregate("steps", start, add)).alias("s"))
    return out.select(*by, "s.frame", "s.transform")


def _covered(angle: Column, max_angle: float, top: int, k: int) -> tuple[Column, Column]:
    """Of the half circle cut into 2^k cells: the dyadic nodes (at least `top` halvings) of the cells wholly within
    `max_angle` of a line's angle, and the cells that may be so in part.
    """
    unit, slack = (1 << k) / 180.0, 1e-3
    if max_angle >= 90:
        return F.array(F.lit(0).cast("bigint")), F.array().cast("array<bigint>")
    at = F.pmod(angle, F.lit(180.0))
    low, high = (at - max_angle) * unit, (at + max_angle) * unit
    first, last = F.ceil(low + slack), F.floor(high - slack) - 1  # cells wholly within
    none = F.array().cast("array<bigint>")

    def some(ok: Column, j: Column, level: int) -> Column:
        return F.when(ok, F.array(_node(F.pmod(j, F.lit(1 << level)), level))).otherwise(none)

    begin = F.ceil(first / (1 << k - top))
    end = F.floor((last + 1) / (1 << k - top)) - 1
    made = [F.when(begin <= end, F.transform(F.sequence(begin, F.greatest(begin, end)), lambda j: _node(F.pmod(j, F.lit(1 << top)), top))).otherwise(none)]
    for level in range(top + 1, k + 1):
        begin = F.ceil(first / (1 << k - level))
        end = F.floor((last + 1) / (1 << k - level)) - 1
        made += [some((begin <= end) & (begin % 2 != 0), begin, level), some((begin <= end) & (end % 2 == 0), end, level)]
    under, over = F.floor(low - slack), F.floor(high + slack)
    edge = F.when(first > last, F.sequence(under, over)).otherwise(F.concat(F.sequence(under, first - 1), F.sequence(last + 1, over)))
    return F.array_distinct(F.concat(*made)), F.array_distinct(F.transform(edge, lambda j: F.pmod(j, F.lit(1 << k))))


def _node(j: Column, level: int) -> Column:
    return F.lit(level << 40) + j.cast("bigint")


def match_lines(lines: DataFrame, reference: DataFrame, max_angle: float = 5.0, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Each line (by, line, angle, rho) with its nearest reference line (ref, ref_angle, ref_rho) within an angle.

    Unmatched where the second best is no farther than 2.05 times the best (1 at least); a
    reference line that several lines match keeps the closest. Offsets that are NULL are the farthest.

    References are kept at the dyadic nodes of their angle and at the angle itself; a line asks the nodes that
    its angle covers, and the single angles of the cells that it covers in part. At a node, the two nearest
    offsets on either side come from windows that only grow, so no line meets all references of its angle.
    The lines of one node are sorted in one task. Offsets without a finite value are joined by angle, all with all.
    """
    from celltide.functions import scalars as S

    alike = F.abs(S.angle_diff(F.col("angle"), F.col("ref_angle"))) <= max_angle
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    angles, strange = reference.agg(F.count_distinct("ref_angle"), F.count_if(odd("ref_rho"))).first()
    top = 0 if max_angle >= 90 else min(20, math.ceil(math.log2(90 / max_angle)))
    k = min(24, max(top, math.ceil(math.log2(max(angles, 1)))))
    cell = F.pmod(F.floor(F.pmod(F.col("ref_angle"), F.lit(180.0)) * (1 << k) / 180), F.lit(1 << k))
    whole, part = _covered(F.col("angle"), max_angle, top, k)

    asked = lines.filter(~odd("rho") & (F.abs("angle") < float("inf"))).select(*by, "line", "angle", "rho")
    known = reference.filter(~odd("ref_rho") & (F.abs("ref_angle") < float("inf"))).select("ref", "ref_angle", "ref_rho", cell.alias("_cell"))
    kinds = known.select("_cell", "ref_angle").distinct()
    kinds = F.broadcast(kinds) if angles <= ANGLES else kinds
    met = asked.select("*", F.explode(part).alias("_cell")).join(kinds, "_cell").filter(alike)
    met = met.select(*by, "line", "rho", _node(F.col("_cell"), k + 1).alias("_node"), F.col("ref_angle").alias("_angle"))
    met = met.unionByName(asked.select(*by, "line", "rho", F.explode(whole).alias("_node"), F.lit(0.0).alias("_angle")))
    inner = [_node(F.floor(F.col("_cell") / (1 << k - level)), level) for level in range(top, k + 1)]
    held = F.array(*[F.struct(x.alias("_node"), F.lit(0.0).alias("_angle")) for x in inner], F.struct(_node(F.col("_cell"), k + 1).alias("_node"), F.col("ref_angle").cast("double").alias("_angle")))
    held = known.select("ref", F.col("ref_rho").alias("rho"), F.explode(held).alias("_at")).select("_at.*", "rho", "ref")
    held = held.groupBy("_node", "_angle", "rho").agg(F.min("ref").alias("ref"), F.count("*").alias("n"))

    both = held.select("*", F.lit(0).alias("_q")).unionByName(met.select("*", F.lit(1).alias("_q")), allowMissingColumns=True)
    node = W.partitionBy("_node", "_angle").rowsBetween(W.unboundedPreceding, -1)
    for side, order in (("_b", ("rho", "_q")), ("_a", (F.desc("rho"), F.desc("_q")))):
        last = lambda c, order=order: F.last(F.when(F.col("_q") == 0, F.struct(*c)), True).over(node.orderBy(*order))
        both = both.withColumn(side, last(["rho", "ref", "n"])).withColumn(f"{side}2", last([F.col(f"{side}.rho").alias("rho")]))
    far = lambda c: F.abs(F.col("rho") - F.col(c))
    below, above = far("_b.rho"), far("_a.rho")
    again = [F.when(F.col("_b.n") > 1, below), F.when(F.col("_a.n") > 1, above), far("_b2.rho"), far("_a2.rho")]
    again.append(F.when(below.isNotNull() & above.isNotNull(), F.greatest(below, above)))
    nearer = F.when(F.col("_b").isNull() | (above < below), F.col("_a.ref")).otherwise(F.col("_b.ref"))
    found = both.filter("_q = 1 and (_b is not null or _a is not null)")
    found = found.select(*by, "line", F.least(below, above).alias("distance"), nearer.alias("ref"), F.least(*again).alias("_second"))

    n = max(1, int(180 // max_angle))  # buckets of the half circle, at least max_angle wide
    bucket = lambda a: F.floor(F.pmod(a, F.lit(180.0)) * n / 180).cast("int")
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(bucket(F.col("angle")) + k, F.lit(n))))
    keyed = reference.withColumn("_b", bucket(F.col("ref_angle")))
    for some, refs in [(lines.filter(odd("rho")), keyed)] + [(lines.filter(~odd("rho")), keyed.filter(odd("ref_rho")))] * (strange > 0):
        rest = some.withColumn("_b", F.explode(beside)).join(refs, "_b").filter(alike)
        found = found.unionByName(rest.select(*by, "line", F.abs(F.col("rho") - F.col("ref_rho")).alias("distance"), "ref"), allowMissingColumns=True)

    near = F.struct(F.col("distance").isNull().alias("void"), "distance", "ref")
    best = found.groupBy(*by, "line").agg(F.min(near).alias("_m"), F.get(F.sort_array(F.collect_list("distance")), F.lit(1)).alias("_o"), F.min("_second").alias("_s"))
    best = best.select(*by, "line", "_m.ref", "_m.distance", F.least("_o", "_s").alias("_second"))
    best = best.filter(F.col("_second").isNull() | (F.col("_second") > 2.05 * F.greatest(F.col("distance"), F.lit(1.0))))
    own = W.partitionBy(*by, "ref").orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last("line"))
    return best.withColumn("_k", F.row_number().over(own)).filter("_k = 1").select(*by, "line", "ref", "distance")


def dedupe_lines(lines: DataFrame, max_angle: float = 5.0, max_rho: float = 6.0, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Keeps a line unless a longer kept one (ties: lower number) lies within the angle and the offset.

    Rounds over pairs that are close: a line without a longer neighbour left is kept, its shorter
    neighbours go; each round settles at least the longest undecided line of every frame.
    """
    from celltide.functions import scalars as S
    from celltide.operators.tracking import _cut

    keys = list(by)
    row = F.struct(*[c for c in lines.columns if c not in keys])
    pairs = lines.select(*keys, row.alias("a")).join(lines.select(*keys, row.alias("b")), keys)
    longer = (F.col("b.length") > F.col("a.length")) | ((F.col("b.length") == F.col("a.length")) & (F.col("b.line") < F.col("a.line")))
    close = (F.abs(S.angle_diff(F.col("a.angle"), F.col("b.angle"))) < max_angle) & (F.abs(F.col("a.rho") - F.col("b.rho")) < max_rho)
    over = _cut(pairs.filter(longer & close).select(*keys, F.col("a.line").alias("line"), F.col("b.line").alias("above")))
    gone = None
    while not over.isEmpty():
        waiting = over.select(*keys, "line").distinct()
        # neighbours of lines that nothing longer can remove any more
        first = over.join(waiting.withColumnRenamed("line", "above"), [*keys, "above"], "left_anti")
        out = _cut(first.select(*keys, "line").distinct())
        gone = out if gone is None else gone.unionByName(out)
        over = over.join(out, [*keys, "line"], "left_anti").join(out.withColumnRenamed("line", "above"), [*keys, "above"], "left_anti")
        over = _cut(over.select(*keys, "line", "above"))
    return lines if gone is None else lines.join(gone, [*keys, "line"], "left_anti")


# ---------------------------------------------------------------- estimation


class RegistrationMethod(Protocol):
    """Plug-in point: estimate(reference, frame) -> (dx, dy, theta, confidence)."""

    def estimate(self, reference: np.ndarray, frame: np.ndarray) -> tuple[float, float, float, float | None]: ...


def grayscale(image: np.ndarray) -> np.ndarray:
    """Luma of three channels, mean of any other number."""
    image = np.asarray(image, float)
    if image.ndim == 2:
        return image
    return image @ np.array([0.114, 0.587, 0.299]) if image.shape[-1] == 3 else image.mean(-1)


def gradient_magnitude(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy)


def vertex(before: float, at: float, after: float) -> float:
    curve = before - 2 * at + after
    return 0.0 if abs(curve) < 1e-12 else float(np.clip(0.5 * (before - after) / curve, -0.5, 0.5))


class PhaseCorrelation:
    """Translation by phase correlation of gradient images, with a parabolic sub-pixel peak."""

    def __init__(self, min_gradient_std: float = 1e-3):
        self.min_gradient_std = min_gradient_std

    def estimate(self, reference, frame):
        a, b = (gradient_magnitude(grayscale(x)) for x in (reference, frame))
        if min(a.std(), b.std()) < self.min_gradient_std:
            raise RegistrationError("no structure to register")
        h, w = a.shape
        taper = np.hanning(h)[:, None] * np.hanning(w)
        cross = np.fft.fft2((b - b.mean()) * taper) * np.conj(np.fft.fft2((a - a.mean()) * taper))
        peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        y, x = np.unravel_index(peak.argmax(), peak.shape)
        dy = y + vertex(peak[y - 1, x], peak[y, x], peak[(y + 1) % h, x])
        dx = x + vertex(peak[y, x - 1], peak[y, x], peak[y, (x + 1) % w])
        dy, dx = (dy - h if dy > h / 2 else dy), (dx - w if dx > w / 2 else dx)
        return float(dx), float(dy), 0.0, float(peak[y, x])


class TemplateCorrelation:
    """Translation by normalised correlation of a rectangle (x0, y0, x1, y1) of the reference within a margin."""

    def __init__(self, rect: tuple[int, int, int, int], margin: int = 30, min_score: float = 0.5, on_low_confidence: str = "keep"):
        self.rect, self.margin, self.min_score, self.policy = rect, margin, min_score, on_low_confidence

    def estimate(self, reference, frame):
        x0, y0, x1, y1 = self.rect
        a, b = grayscale(reference), grayscale(frame)
        t = a[y0:y1, x0:x1] - a[y0:y1, x0:x1].mean()
        norm = np.sqrt((t * t).sum())
        if norm == 0:
            raise RegistrationError("the template has no structure")
        m, scores = self.margin, {}
        for dy in range(max(-m, -y0), min(m, b.shape[0] - y1) + 1):
            for dx in range(max(-m, -x0), min(m, b.shape[1] - x1) + 1):
                p = b[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
                q = p - p.mean()
                d = norm * np.sqrt((q * q).sum())
                scores[dx, dy] = float((t * q).sum() / d) if d else 0.0
        (dx, dy), best = max(scores.items(), key=lambda kv: kv[1])
        if best < self.min_score and self.policy == "reject":
            raise RegistrationError(f"score {best:.3f} below {self.min_score}")
        fx = vertex(scores.get((dx - 1, dy), best), best, scores.get((dx + 1, dy), best))
        fy = vertex(scores.get((dx, dy - 1), best), best, scores.get((dx, dy + 1), best))
        return dx + fx, dy + fy, 0.0, best


def estimate_transforms(
    frames: DataFrame, method: RegistrationMethod, by: Sequence[str] = ("source_id",), reference: int = 0, decode: Callable | None = None
) -> DataFrame:
    """by, frame, transform: every frame against the reference frame of its sequence; frames without an estimate are left out.

    frames: by, frame, h, w, pixels (float32, row-major), unless `decode` reads a row's image.
    """
    read = decode or (lambda r: np.frombuffer(r.pixels, np.float32).reshape(r.h, r.w))
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{kinds}, frame int, transform struct<dx:double,dy:double,theta:double,confidence:double>"
    ref = frames.filter(F.col("frame") == reference).select(*by, F.struct(*[c for c in frames.columns if c not in by]).alias("_ref"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    base = read(type("Row", (), dict(getattr(row, "ref_"))))
                    t = method.estimate(base, read(row))
                except RegistrationError:
                    continue
                out.append((*(getattr(row, k) for k in by), int(row.frame), t))
            yield pd.DataFrame(out, columns=[*by, "frame", "transform"])

    return frames.join(ref.withColumnRenamed("_ref", "ref_"), list(by)).mapInPandas(run, schema)


def pyramid(gray: np.ndarray, levels: int, min_size: int = 16) -> list[np.ndarray]:
    """Halved and smoothed (binomial 5-tap) until `levels` images or the least size."""
    out = [gray]
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    while len(out) < levels and min(out[-1].shape) // 2 >= min_size:
        g = out[-1]
        for axis in (0, 1):
            p = np.pad(g, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
            n = g.shape[axis]
            g = sum(k * np.take(p, range(i, i + n), axis=axis) for i, k in enumerate(kernel))
        out.append(g[::2, ::2])
    return out


def rect_mask(shape: tuple[int, int], rects: Sequence[tuple[float, float, float, float]], shrink: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """True outside the rectangles (x0, y0, x1, y1), each shrunk on all sides, then scaled."""
    out = np.ones(shape, bool)
    for x0, y0, x1, y1 in rects:
        a, b, c, d = (int(round(v * scale)) for v in (x0 + shrink, y0 + shrink, x1 - shrink, y1 - shrink))
        out[max(0, b) : max(0, d), max(0, a) : max(0, c)] = False
    return out


def compose_values(first: tuple, second: tuple) -> tuple:
    """`first`, then `second`, as plain (dx, dy, theta, confidence)."""
    r = np.radians(second[2])
    weak = None if first[3] is None or second[3] is None else min(first[3], second[3])
    x, y = np.cos(r) * first[0] + np.sin(r) * first[1], np.cos(r) * first[1] - np.sin(r) * first[0]
    return float(second[0] + x), float(second[1] + y), float(first[2] + second[2]), weak


def register_sequence(frames: DataFrame, method: RegistrationMethod, mode: str = "reanchor", by: str = "source_id", reference: int = 0) -> DataFrame:
    """by, frame, transform, anchor: every frame of a sequence against the reference, in frame order.

    'fixed' compares with the reference only, 'chained' with the last good frame, 'reanchor' with the
    reference and, where that fails, once with the last good frame. Frames that fail have a NULL
    transform and change nothing. A sequence is one ordered scan, so sequences are the unit of work.
    """
    if mode not in ("fixed", "reanchor", "chained"):
        raise ValueError(f"unknown reference mode {mode!r}")
    kind = frames.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, frame int, transform struct<dx:double,dy:double,theta:double,confidence:double>, anchor int"

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame")
        images = {int(r.frame): np.frombuffer(r.pixels, np.float32).reshape(r.h, r.w) for r in group.itertuples()}
        identity = (0.0, 0.0, 0.0, None)
        last, absolute, out = reference, identity, []
        for f, image in images.items():
            if f == reference:
                out.append((group[by].iloc[0], f, identity, f))
                continue
            first = last if mode == "chained" else reference
            made = None
            for anchor in [first] + ([last] if mode == "reanchor" and last != reference else []):
                try:
                    step = method.estimate(images[anchor], image)
                except RegistrationError:
                    continue
                made = step if anchor == reference else compose_values(absolute, step)
                break
            out.append((group[by].iloc[0], f, made, anchor if made else None))
            if made:
                last, absolute = f, made
        return pd.DataFrame(out, columns=[by, "frame", "transform", "anchor"])

    return frames.groupBy(by).applyInPandas(scan, schema)


def compare(frames: DataFrame, methods: dict[str, RegistrationMethod], reference: int = 0, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """by, frame, method, transform: the grid of methods and frames, NULL where a method gives none."""
    keys = [*by, "frame"]
    out = None
    for name, method in methods.items():
        found = frames.select(*keys).join(estimate_transforms(frames, method, by, reference), keys, "left").withColumn("method", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
