"""Every relational operator as a query over the driver's tables, with equivalent SQL.

The tables are no microscopy data, so each query gives them roles: a row is a detection, a time
bucket its frame, an entity its label, a numeric column its property.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from celltide import model
from celltide.functions import geometry as G
from celltide.functions import scalars as S
from celltide.functions import units as U
from celltide.operators import filters, provenance, registration, stats, tracking
from celltide.operators import properties as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q_growth_sum"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(col, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def _long(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def _no_nan(c: str) -> Column:
    return F.when(~F.isnan(c), _r(c)).alias(c)


def _month(c: str) -> Column:
    return ((F.year(c) - 1992) * 12 + F.month(c)).cast("double")


def _day(c: str) -> Column:
    return F.date_diff(F.to_date(c), F.lit("2024-01-01").cast("date"))


# ---------------------------------------------------------------- growth

_FIT = """
SELECT {by}, n::BIGINT AS n, round(slope, 6) AS growth_rate,
  CASE WHEN n > 2 THEN round(sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx), 6) END AS std_err,
  CASE WHEN slope > 0 THEN round(ln(2) / slope, 4) END AS doubling_time,
  round(exp(icpt), 2) AS initial_value, round(sxy * sxy / sxx / syy, 6) AS r_squared
FROM (SELECT {by}, count(*) AS n, regr_slope(ln(y), t) AS slope, regr_intercept(ln(y), t) AS icpt,
        regr_sxx(ln(y), t) AS sxx, regr_syy(ln(y), t) AS syy, regr_sxy(ln(y), t) AS sxy
      FROM ({points}) GROUP BY ALL)
"""


def _fit(df: DataFrame, agg: str, by: str) -> DataFrame:
    out = stats.growth_rate(df, "t", "v", agg, (by,), inference=False)
    return out.select(
        by,
        _long("n"),
        _r("growth_rate").alias("growth_rate"),
        _no_nan("std_err"),
        F.when(~F.isnan("doubling_time"), _r("doubling_time", 4)).alias("doubling_time"),
        _r("initial_value", 2).alias("initial_value"),
        _r("r_squared").alias("r_squared"),
    )


@query(
    _FIT.format(
        by="segment",
        points="""SELECT c_mktsegment AS segment, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::DOUBLE AS t, sum(o_totalprice) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 2000 AND 450000 GROUP BY ALL""",
    )
)
def q_growth_sum(spark, sf):
    """Detections to growth: range filter, summed area per time, log-linear fit per population."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", _month("o_orderdate").alias("t"))
    kept = orders.filter(filters.in_range(F.col("o_totalprice"), 2000.0, 450000.0))
    segments = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    df = kept.join(segments, "c_custkey").select("segment", "t", F.col("o_totalprice").alias("v"))
    return _fit(U.attach_units(df, {"t": "month"}), "sum", "segment")


_EVENT_POINTS = """SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS t, {agg} AS y FROM events GROUP BY ALL"""


def _events(spark, sf):
    return table(spark, sf, "events").select("event_type", _day("ts").cast("double").alias("t"), F.col("value").alias("v"))


@query(_FIT.format(by="event_type", points=_EVENT_POINTS.format(agg="avg(value)")))
def q_growth_mean(spark, sf):
    return _fit(_events(spark, sf), "mean", "event_type")


@query(_FIT.format(by="event_type", points=_EVENT_POINTS.format(agg="count(*)::DOUBLE")))
def q_growth_count(spark, sf):
    return _fit(_events(spark, sf), "count", "event_type")


@query()
def q_growth_inference(spark, sf):
    """Confidence interval and p-value of the rate (Student's t has no SQL form)."""
    out = stats.growth_rate(_events(spark, sf), "t", "v", "sum", ("event_type",))
    return out.select("event_type", *[_r(c).alias(c) for c in ("growth_rate", "std_err", "ci_low", "ci_high", "p_value")])


# ---------------------------------------------------------------- filters


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 30 AND l_extendedprice >= 20000 AND l_discount <= 0.05"""
)
def q_filter_and(spark, sf):
    lines = table(spark, sf, "lineitem")
    wanted = [filters.CellFilter(10, 30, "l_quantity"), filters.CellFilter(20000, None, "l_extendedprice"), filters.CellFilter(None, 0.05, "l_discount")]
    return lines.filter(filters.combined_mask(lines, wanted)).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT event_id, value FROM events WHERE isfinite(value) AND value >= 75")
def q_filter_open_bound(spark, sf):
    e = table(spark, sf, "events")
    return e.filter(filters.in_range(F.col("value"), 75.0)).select("event_id", "value")


def _injected(e: DataFrame) -> DataFrame:
    k = F.col("event_id") % 11
    return e.withColumn(
        "value",
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("value")),
    )


@query(
    """SELECT event_id, value FROM (SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS value FROM events)
    WHERE value IS NOT NULL AND isfinite(value)"""
)
def q_filter_nan(spark, sf):
    """A filter without bounds still drops what isn't finite."""
    e = _injected(table(spark, sf, "events").select("event_id", "value"))
    return e.filter(filters.combined_mask(e, [filters.CellFilter(None, None, "value")])).select("event_id", "value")


@query("SELECT count(*)::BIGINT AS n FROM events")
def q_filter_none(spark, sf):
    """An empty filter list keeps everything."""
    e = _injected(table(spark, sf, "events").select("event_id", "value"))
    return e.filter(filters.combined_mask(e, [])).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 40")
def q_size_strict(spark, sf):
    return filters.size_filter(table(spark, sf, "part"), 10, 40, F.col("p_size")).select("p_partkey", "p_size")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE NOT EXISTS
    (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND b.l_quantity >= 5)"""
)
def q_removed(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    kept = lines.filter(filters.in_range(F.col("l_quantity"), 5.0))
    return filters.removed(lines, kept, ("l_orderkey", "l_linenumber", "l_partkey")).drop("l_quantity")


@query(
    """WITH r AS (SELECT value AS v, value >= 20 AS k FROM events WHERE isfinite(value)),
    e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM r)
    SELECT least(floor((v - lo) / w), 49)::INT AS bin, round(lo + least(floor((v - lo) / w), 49) * w, 6) AS lower, count(*)::BIGINT AS before,
      count(*) FILTER (WHERE k)::BIGINT AS after, count(*) FILTER (WHERE NOT k)::BIGINT AS removed FROM r, e GROUP BY ALL"""
)
def q_hist_shared_bins(spark, sf):
    h = filters.shared_histogram(table(spark, sf, "events"), "value", F.col("value") >= 20)
    return h.withColumn("lower", _r("lower"))


# ---------------------------------------------------------------- joins of property tables


@query(
    """SELECT o_orderkey AS id, o_totalprice AS area, coalesce(lines, 0)::BIGINT AS lines, round(qty, 2) AS qty, round(c_acctbal, 2) AS balance
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey"""
)
def q_extract_join(spark, sf):
    """Property tables joined on a unique id."""
    orders = table(spark, sf, "orders")
    base = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("area"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    owner = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.round("c_acctbal", 2).alias("balance")
    )
    return P.combine([base, lines, owner]).withColumn("lines", F.coalesce("lines", F.lit(0)).cast("bigint"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def q_dup_ids(spark, sf):
    return model.duplicate_ids(table(spark, sf, "lineitem"), ("l_orderkey",))


@query(
    """SELECT event_id, round(date_diff('day', DATE '2024-01-01', ts::DATE) * 24.0, 6) AS time FROM events"""
)
def q_time_lookup(spark, sf):
    """Frame to time through a time model, in hours."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), _day("ts").cast("int").alias("frame"))
    points = model.resolve_timepoints(spark, 60, frame_interval=86400.0)
    out = P.extract(e, [P.TimeEx()], P.Context(timepoints=points), check_ids=False)
    return out.select(F.col("id").alias("event_id"), _r("time").alias("time"))


@query(
    """WITH f AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE) AS d FROM events),
    p AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM f)
    SELECT event_id, ((i - 2) // 3)::INT AS frame, d::INT AS source_frame FROM events JOIN p ON date_diff('day', DATE '2024-01-01', ts::DATE) = d
    WHERE i >= 2 AND (i - 2) % 3 = 0"""
)
def q_slice_remap(spark, sf):
    """Frames [2::3], renumbered."""
    e = table(spark, sf, "events").select("event_id", _day("ts").cast("int").alias("frame"))
    return model.slice_frames(e, 2, None, 3)


@query(
    """SELECT event_id, (date_diff('day', DATE '2024-01-01', ts::DATE) - 5)::INT AS frame, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS source_frame
    FROM events WHERE date_diff('day', DATE '2024-01-01', ts::DATE) >= 5
    AND date_diff('day', DATE '2024-01-01', ts::DATE) < (SELECT count(DISTINCT ts::DATE) FROM events) - 4"""
)
def q_slice_negative(spark, sf):
    """Frames [5:-4]."""
    e = table(spark, sf, "events").select("event_id", _day("ts").cast("int").alias("frame"))
    return model.slice_frames(e, 5, -4)


@query("""SELECT user_id, round(epoch(t2 - t1), 3) AS frame_interval FROM (SELECT user_id, ts AS t1, lead(ts) OVER w AS t2, row_number() OVER w AS i
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE i = 1""")
def q_frame_interval(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return model.frame_interval(e, ("user_id",)).withColumn("frame_interval", _r("frame_interval", 3))


# ---------------------------------------------------------------- boxes and suppression

_BOXES = """(SELECT vec_id::BIGINT AS id, label, embedding[3]::DOUBLE AS score, embedding[1]::DOUBLE * 100 AS x0, embedding[2]::DOUBLE * 100 AS y0,
    embedding[1]::DOUBLE * 100 + 6 + abs(embedding[4]::DOUBLE) * 20 AS x1, embedding[2]::DOUBLE * 100 + 6 + abs(embedding[5]::DOUBLE) * 20 AS y1 FROM embeddings)"""


def _boxes(spark, sf):
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        "label",
        e(2).alias("score"),
        (e(0) * 100).alias("x0"),
        (e(1) * 100).alias("y0"),
        (e(0) * 100 + 6 + F.abs(e(3)) * 20).alias("x1"),
        (e(1) * 100 + 6 + F.abs(e(4)) * 20).alias("y1"),
    )


_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0) + {k}, 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0) + {k}, 0)"
_AREA = "({t}.x1 - {t}.x0 + {k}) * ({t}.y1 - {t}.y0 + {k})"


def _iou(k: int) -> str:
    i = _INTER.format(k=k)
    return f"({i}) / ({_AREA.format(t='a', k=k)} + {_AREA.format(t='b', k=k)} - {i})"


@query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coalesce(score, 0), id) AS r FROM {_BOXES})
    SELECT id, label FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.label = b.label AND a.r < b.r AND {_INTER.format(k=0)} > 0 AND {_iou(0)} >= 0.1)"""
)
def q_box_nms(spark, sf):
    return filters.nms(_boxes(spark, sf), 0.1, "iou", ("label",), "box", cell=20.0).select("id", "label")


@query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coalesce(score, 0), id) AS r FROM {_BOXES})
    SELECT id, label FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.label = b.label AND a.r < b.r AND {_INTER.format(k=0)} > 0
    AND ({_INTER.format(k=0)}) / ({_AREA.format(t='a', k=0)}) >= 0.25)"""
)
def q_box_nms_self(spark, sf):
    """Suppression by the share of the own area."""
    return filters.nms(_boxes(spark, sf), 0.25, "i", ("label",), "box").select("id", "label")


@query(
    f"""SELECT id, label FROM {_BOXES} a WHERE NOT EXISTS (SELECT 1 FROM {_BOXES} b WHERE a.label = b.label AND a.score < b.score
    AND ({_INTER.format(k=0)}) / ({_AREA.format(t='a', k=0)}) > 0.3)"""
)
def q_box_nms_score(spark, sf):
    return filters.non_max_suppression(_boxes(spark, sf), 0.3, ("label",)).select("id", "label")


@query(
    f"""SELECT a.id AS i, b.id AS j, round({_iou(1)}, 6) AS iou FROM {_BOXES} a JOIN {_BOXES} b ON a.label = b.label AND a.id < b.id WHERE {_INTER.format(k=1)} > 0"""
)
def q_box_iou_pairs(spark, sf):
    """IoU of overlapping boxes, both end pixels counted."""
    pairs = filters.box_iou(filters.candidate_pairs(_boxes(spark, sf), ("label",)))
    return pairs.filter("iou > 0").select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), _r("iou").alias("iou"))


@query(
    f"""SELECT label, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, count(*)::BIGINT AS n FROM {_BOXES} GROUP BY 1"""
)
def q_bbox_agg(spark, sf):
    b = _boxes(spark, sf)
    return b.groupBy("label").agg(
        _r(F.min("x0")).alias("x0"), _r(F.min("y0")).alias("y0"), _r(F.max("x1")).alias("x1"), _r(F.max("y1")).alias("y1"), F.count("*").alias("n")
    )


@query(
    f"""SELECT id, greatest(floor(x0)::INT - 3, 0) AS "left", greatest(floor(y0)::INT - 3, 0) AS top, least(floor(x1)::INT + 4, 90) AS "right", least(floor(y1)::INT + 4, 90) AS bottom FROM {_BOXES}"""
)
def q_stack_windows(spark, sf):
    """Boxes widened by a margin and clipped to the image."""
    b = _boxes(spark, sf).select("id", *[F.floor(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return P.stack_windows(b, 3, 90, 90).select("id", "left", "top", "right", "bottom")


@query(
    """SELECT label, channel::INT AS channel, round(median(v), 6) AS median, round(avg(v), 6) AS mean
    FROM (SELECT label, unnest(range(1, 5)) AS channel, unnest(embedding[1:4])::DOUBLE AS v FROM embeddings) GROUP BY ALL"""
)
def q_channel_median(spark, sf):
    """Median and mean intensity of every channel inside every detection."""
    px = table(spark, sf, "embeddings").select(F.col("label").alias("id"), *[F.col("embedding")[k].cast("double").alias(f"c{k + 1}") for k in range(4)])
    cells = px.select("id").distinct()
    names = [f"c{k}" for k in range(1, 5)]
    median = P.extract(cells, [P.FluorescenceEx(names, [f"median_{n}" for n in names])], P.Context(pixels=px))
    mean = P.extract(cells, [P.FluorescenceEx(names, [f"mean_{n}" for n in names], "mean")], P.Context(pixels=px))
    both = P.combine([median, mean])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), _r(f"median_c{k}").alias("median"), _r(f"mean_c{k}").alias("mean")) for k in range(1, 5)]))
    return both.select(F.col("id").alias("label"), rows.alias("s")).select("label", "s.*")


# ---------------------------------------------------------------- polygons

_POLYGON = """(SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 17 + 3)::DOUBLE AS b, (p_partkey % 7)::DOUBLE AS c FROM part)"""


def _polygons(spark, sf) -> DataFrame:
    """Quadrilaterals (0,0) (a,c) (a+b,a) (c,b), some of them degenerate."""
    d = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("double").alias("a"),
        (F.col("p_partkey") % 17 + 3).cast("double").alias("b"),
        (F.col("p_partkey") % 7).cast("double").alias("c"),
    )
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c = (F.col(k) for k in "abc")
    return d.select("id", F.lit(0).alias("frame"), F.array(point(F.lit(0.0), F.lit(0.0)), point(a, c), point(a + b, a), point(c, b)).alias("coords"))


_SHOE = "abs(a * a - (a + b) * c + (a + b) * b - c * a) / 2"
_PERI = "sqrt(a * a + c * c) + sqrt(b * b + (a - c) * (a - c)) + sqrt((a + b - c) * (a + b - c) + (a - b) * (a - b)) + sqrt(c * c + b * b)"


@query(f"SELECT id, round({_SHOE} * 0.07 * 0.07, 6) AS area FROM {_POLYGON}")
def q_shoelace(spark, sf):
    """Calibrated area."""
    out = P.extract(_polygons(spark, sf), [P.AreaEx()], P.Context(pixel_size=0.07))
    return out.select("id", _r("area").alias("area"))


@query(f"SELECT id, CASE WHEN {_SHOE} > 0 THEN round(({_PERI}) * 0.07, 6) END AS perimeter FROM {_POLYGON}")
def q_perimeter(spark, sf):
    out = P.extract(_polygons(spark, sf), [P.PerimeterEx()], P.Context(pixel_size=0.07))
    return out.select("id", _no_nan("perimeter"))


@query(f"SELECT id, CASE WHEN {_SHOE} > 0 THEN round(4 * pi() * {_SHOE} / (({_PERI}) * ({_PERI})), 6) END AS circularity FROM {_POLYGON}")
def q_circularity(spark, sf):
    out = P.extract(_polygons(spark, sf), [P.AreaEx(), P.PerimeterEx(), P.CircularityEx()])
    return out.select("id", _no_nan("circularity"))


@query(
    f"""SELECT id, round(CASE WHEN s = 0 THEN (a + a + b + c) / 4 ELSE ((a + a + b) * k2 + (a + b + c) * k3) / (6 * s) END, 6) AS position_x,
    round(CASE WHEN s = 0 THEN (c + a + b) / 4 ELSE ((c + a) * k2 + (a + b) * k3) / (6 * s) END, 6) AS position_y
    FROM (SELECT *, (k2 + k3) / 2 AS s FROM (SELECT *, a * a - (a + b) * c AS k2, (a + b) * b - c * a AS k3 FROM {_POLYGON}))"""
)
def q_position(spark, sf):
    """Centroids; k2 and k3 are the cross products of the edges that don't touch the origin."""
    out = P.extract(_polygons(spark, sf), [P.PositionEx()], P.Context(pixel_unit="pixel"))
    return out.select("id", _r("position_x").alias("position_x"), _r("position_y").alias("position_y"))


@query(f"SELECT id, CASE WHEN {_SHOE} = 0 THEN 0.0 ELSE round(least(0.0, 80 - (a + b), 70 - greatest(a, b, c)), 6) END AS boundary_closeness FROM {_POLYGON}")
def q_boundary(spark, sf):
    out = P.extract(_polygons(spark, sf), [P.BoundaryClosenessEx()], P.Context(height=70, width=80, pixel_unit="pixel"))
    return out.select("id", _r("boundary_closeness").alias("boundary_closeness"))


@query(
    f"""SELECT id, round(({_SHOE}) * 4, 6) AS area FROM {_POLYGON} WHERE a + b <= 40 AND greatest(a, b) <= 35"""
)
def q_crop_scale(spark, sf):
    """Polygons fully inside a rectangle, scaled by two."""
    kept = model.scale_coords(model.cropped(_polygons(spark, sf), 0, 0, 40, 35), 2.0)
    return kept.select("id", _r(G.area(F.col("coords"))).alias("area"))


@query(f"""SELECT id, [round(sqrt(a * a + c * c), 6), round(sqrt(b * b + (a - c) * (a - c)), 6), round(sqrt((a + b - c) * (a + b - c) + (a - b) * (a - b)), 6)]::VARCHAR AS distances FROM {_POLYGON}""")
def q_consecutive_distances(spark, sf):
    d = F.transform(G.consecutive_distances(F.col("coords")), lambda x: F.round(x, 6).cast("string"))
    return _polygons(spark, sf).select("id", F.concat(F.lit("["), F.array_join(d, ", "), F.lit("]")).alias("distances"))


@query()
def q_length_width(spark, sf):
    """Sides of the minimum rotated rectangle (no SQL form)."""
    out = P.extract(_polygons(spark, sf), [P.LengthWidthEx()], P.Context(pixel_size=0.07))
    return out.select("id", _no_nan("length"), _no_nan("width"))


@query(
    f"""SELECT id, "label", round(x, 6) AS x, round(y, 6) AS y, n FROM (
    SELECT label::BIGINT AS label, row_number() OVER (ORDER BY label) AS id, quantile_cont((embedding[1] * 100)::INT, 0.5) AS x,
    quantile_cont((embedding[2] * 100)::INT, 0.5) AS y, count(*)::BIGINT AS n FROM embeddings WHERE label > 0 GROUP BY label)"""
)
def q_masks_to_detections(spark, sf):
    """Mask pixels to detections: the centre is the median of occupied columns and rows."""
    e = table(spark, sf, "embeddings")
    at = lambda k: F.rint(F.col("embedding")[k].cast("float") * F.lit(100).cast("float")).cast("int")
    px = e.select(F.lit(0).alias("frame"), at(1).alias("y"), at(0).alias("x"), F.col("label").cast("bigint").alias("label"))
    d = P.detections_of_masks(px)
    return d.select("id", "label", _r("center_x").alias("x"), _r("center_y").alias("y"), F.col("area").cast("bigint").alias("n"))


# ---------------------------------------------------------------- tracks

_SECONDS = "floor(epoch(ts) / 3600)::BIGINT"


def _hours(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", "user_id", F.floor(seconds / 3600).cast("bigint").alias("frame"), "ts")


@query("""SELECT event_id AS src, nxt AS dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL""")
def q_link_sequential(spark, sf):
    return tracking.link_sequential(table(spark, sf, "events"), "user_id", ("ts", "event_id"), "event_id")


_TRACKLETS = f"""(SELECT user_id, part::BIGINT AS part, min(f)::BIGINT AS start_frame, max(f)::BIGINT AS end_frame FROM (
    SELECT user_id, f, sum(new) OVER (PARTITION BY user_id ORDER BY f) AS part FROM (
    SELECT user_id, f, CASE WHEN f - lag(f) OVER (PARTITION BY user_id ORDER BY f) <= 4 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT user_id, {_SECONDS} AS f FROM events))) GROUP BY ALL)"""


def _tracklets(spark, sf):
    return tracking.tracklets(_hours(spark, sf), "user_id", "frame", 4)


@query(f"SELECT * FROM {_TRACKLETS}")
def q_tracklets(spark, sf):
    return _tracklets(spark, sf).select("user_id", _long("part"), "start_frame", "end_frame")


@query(f"SELECT user_id * 1000 + part AS label, unnest(range(start_frame, end_frame + 1)) AS frame FROM {_TRACKLETS}")
def q_expand_tracklets(spark, sf):
    t = _tracklets(spark, sf).select((F.col("user_id") * 1000 + F.col("part")).alias("label"), "start_frame", "end_frame")
    return tracking.expand_tracklets(t)[0]


@query(
    f"""WITH t AS (SELECT user_id * 1000 + part AS label, start_frame, end_frame FROM {_TRACKLETS})
    SELECT label AS src, start_frame AS src_frame, label AS dst, end_frame AS dst_frame FROM t WHERE end_frame > start_frame
    UNION ALL SELECT p.label, p.end_frame, c.label, c.start_frame FROM t p JOIN t c ON c.label = p.label + 1"""
)
def q_segments(spark, sf):
    """Tracklets as line segments, each joined to the next of its user."""
    t = _tracklets(spark, sf).select((F.col("user_id") * 1000 + F.col("part")).alias("label"), "start_frame", "end_frame")
    edges = t.select(F.col("label").alias("parent"), (F.col("label") + 1).alias("child"))
    return tracking.segments(t, edges)[1]


def _tree(spark, sf):
    """Customers as a binary heap: tracklet k descends from (k - 1) / 2; depth is its start, and its end is the children's start - 1."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("label"), F.col("c_nationkey"))
    depth = F.floor(F.log2(F.col("label") + 1.0)).cast("int")
    nodes = c.withColumn("start_frame", depth * 3).withColumn("end_frame", depth * 3 + 2)
    edges = c.filter("label > 0").select(F.floor((F.col("label") - 1) / 2).alias("parent"), F.col("label").alias("child"))
    return nodes, edges


_TREE = "(SELECT c_custkey AS label, (floor(log2(c_custkey + 1)) * 3)::INT AS start_frame, (floor(log2(c_custkey + 1)) * 3 + 2)::INT AS end_frame FROM customer)"
_EDGES = "(SELECT (c_custkey - 1) // 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0)"


@query(
    f"""SELECT label, (SELECT count(*) FROM {_EDGES} e WHERE e.child = label)::BIGINT AS in_degree,
    (SELECT count(*) FROM {_EDGES} e WHERE e.parent = label)::BIGINT AS out_degree FROM {_TREE}"""
)
def q_degrees(spark, sf):
    nodes, edges = _tree(spark, sf)
    return tracking.degrees(nodes, edges, "label", "parent", "child").select("label", _long("in_degree"), _long("out_degree"))


_CLEAN = f"""(SELECT t.label, t.start_frame, t.end_frame, 2 * t.label + 1 AS child FROM {_TREE} t WHERE t.label > 0
    AND (SELECT count(*) FROM {_EDGES} e WHERE e.parent = t.label) = 2)"""


@query(f"SELECT label, child FROM {_CLEAN}")
def q_clean_divisions(spark, sf):
    """One mother, two daughters; the earlier daughter of lower label."""
    nodes, edges = _tree(spark, sf)
    return tracking.clean_divisions(nodes, edges).select("label", "child")


@query(
    f"""SELECT label AS tracklet, (start_frame * start_frame * 0.5)::DOUBLE AS start_time, (end_frame * end_frame * 0.5)::DOUBLE AS end_time,
    ((end_frame + 1) * (end_frame + 1) * 0.5 - start_frame * start_frame * 0.5)::DOUBLE AS doubling_time FROM {_CLEAN}"""
)
def q_doubling(spark, sf):
    """Doubling times through an irregular time model."""
    nodes, edges = _tree(spark, sf)
    points = model.resolve_timepoints(spark, 100, [0.5 * i * i for i in range(100)], unit="minute")
    return tracking.doubling_times(nodes, edges, points)


@query(
    f"""SELECT t.label, (t.start_frame * 900.0)::DOUBLE AS start_time, (t.end_frame * 900.0)::DOUBLE AS end_time FROM {_TREE} t"""
)
def q_annotate_times(spark, sf):
    nodes, _ = _tree(spark, sf)
    return tracking.annotate_times(nodes, model.resolve_timepoints(spark, 200, frame_interval=900.0)).select("label", "start_time", "end_time")


@query(
    f"""WITH RECURSIVE r AS (SELECT 0::BIGINT AS id, '0' AS trace, 0 AS depth UNION ALL
    SELECT e.child, r.trace || '.' || e.child, r.depth + 1 FROM r JOIN {_EDGES} e ON e.parent = r.id) SELECT id, trace, depth FROM r"""
)
def q_trace(spark, sf):
    """Dotted path of every node from the root."""
    nodes, edges = _tree(spark, sf)
    return tracking.traces(nodes.select(F.col("label").alias("id")), edges.toDF("src", "dst"))


@query(
    """WITH u AS (SELECT user_id, epoch(min(ts)) / 3600 AS s, epoch(max(ts)) / 3600 AS e FROM events GROUP BY 1),
    g AS (SELECT (473352 + 24 * unnest(range(0, 31)))::DOUBLE AS t)
    SELECT t, count(s)::BIGINT AS n, CASE WHEN count(s) >= 5 THEN round(avg(e - s), 6) END AS mean FROM g LEFT JOIN u ON s <= t AND t <= e GROUP BY t"""
)
def q_alive_at_t(spark, sf):
    """Mean lifespan of the users alive at each day."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    u = table(spark, sf, "events").groupBy("user_id").agg(F.min(hours).alias("start_time"), F.max(hours).alias("end_time"))
    u = u.withColumn("doubling_time", F.col("end_time") - F.col("start_time"))
    grid = spark.range(31).select((F.col("id") * 24 + 473352).cast("double").alias("t"))
    return stats.alive_at(u, grid, 5, bucket=24.0).select("t", _long("n"), _r("mean").alias("mean"))


@query()
def q_hose_bands(spark, sf):
    """Bootstrap bands of the mean doubling time alive at each time."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    u = table(spark, sf, "events").groupBy("user_id").agg(F.min(hours).alias("start_time"), F.max(hours).alias("end_time"))
    u = u.withColumn("doubling_time", F.col("end_time") - F.col("start_time"))
    grid = spark.range(0, 31, 5).select((F.col("id") * 24 + 473352).cast("double").alias("t"))
    return stats.hose_bands(u, grid, n_bootstrap=200).select("t", "n", "mean", F.to_json("bands").alias("bands"))


def _turns(spark, sf):
    """Turns of a conversation as a chain; frame = turn, with gaps where roles drop out."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", F.col("turn").cast("int").alias("frame"), "role")
    edges = tracking.link_sequential(c, "conv_id", ("frame", "id"))
    return c, edges


_CHAIN = "(SELECT conv_id * 1000 + turn AS id, conv_id, turn, role FROM conversations)"


@query(
    f"""WITH f AS (SELECT turn, row_number() OVER (ORDER BY turn) - 1 AS p FROM (SELECT DISTINCT turn FROM conversations)),
    k AS (SELECT id, conv_id, turn FROM {_CHAIN} JOIN f USING (turn) WHERE p % 2 = 0)
    SELECT id AS src, nxt AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM k) WHERE nxt IS NOT NULL"""
)
def q_subsample_dense(spark, sf):
    """Every second of the sorted distinct frames, bridged."""
    return tracking.subsample_lineage(*_turns(spark, sf), 2)[1]


@query(
    f"""WITH k AS (SELECT id, conv_id, turn FROM {_CHAIN} WHERE turn % 3 = 0)
    SELECT id AS src, nxt AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM k) WHERE nxt IS NOT NULL"""
)
def q_subsample_numeric(spark, sf):
    """Frame numbers 0, 3, 6, ..., bridged."""
    return tracking.subsample_tracking(*_turns(spark, sf), 3)[1]


@query(
    f"""WITH k AS (SELECT id, conv_id, turn FROM {_CHAIN} WHERE role <> 'assistant')
    SELECT id AS src, nxt AS dst FROM (SELECT id, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM k) WHERE nxt IS NOT NULL"""
)
def q_contract(spark, sf):
    """Nodes of one role deleted, connections kept."""
    nodes, edges = _turns(spark, sf)
    return tracking.contract(nodes, edges, F.col("role") != "assistant")[1]


@query(f"SELECT conv_id * 1000 + min(turn) AS cycle, min(turn)::INT AS start_frame, max(turn)::INT AS end_frame, count(*)::BIGINT AS n FROM {_CHAIN} GROUP BY conv_id")
def q_life_cycles(spark, sf):
    return tracking.life_cycles(*_turns(spark, sf))[0]


@query(f"SELECT parent, child FROM {_EDGES} WHERE parent IN (SELECT parent FROM {_EDGES} GROUP BY 1 HAVING count(*) = 2)")
def q_lifecycle_edges(spark, sf):
    """Lineage of life cycles: a node with one child lives on, so only divisions give edges."""
    nodes, edges = _tree(spark, sf)
    n = nodes.select(F.col("label").alias("id"), F.col("start_frame").alias("frame"))
    return tracking.life_cycles(n, edges.toDF("src", "dst"))[1]


@query(
    f"""SELECT label || ' ' || start_frame || ' ' || end_frame || ' ' || coalesce((SELECT min(parent) FROM {_EDGES} e WHERE e.child = t.label), 0) AS value FROM {_TREE} t"""
)
def q_tracklet_text(spark, sf):
    from celltide.sources import formats

    nodes, edges = _tree(spark, sf)
    return formats.tracklet_lines(nodes, edges)


@query(
    """SELECT DISTINCT src, dst FROM (SELECT c_custkey AS src, c_nationkey::BIGINT AS dst FROM customer WHERE c_custkey < 900
    UNION ALL SELECT c_custkey, c_nationkey::BIGINT FROM customer WHERE c_custkey >= 600)"""
)
def q_merge_union(spark, sf):
    """Graphs united, shared edges once."""
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
    a, b = e.filter("src < 900"), e.filter("src >= 600")
    return tracking.merge((a.select("src"), a), (b.select("src"), b))[1]


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def q_ctc_semi(spark, sf):
    """Detections that the graph knows."""
    d, n = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id").distinct()
    return tracking.restrict(d, n, "doc_id")[0]


@query(
    f"""SELECT e.parent, min(CASE WHEN kids = 0 THEN child END) AS dead_end FROM {_EDGES} e
    JOIN (SELECT t.label, (SELECT count(*) FROM {_EDGES} x WHERE x.parent = t.label) AS kids FROM {_TREE} t) d ON d.label = e.child
    GROUP BY 1 HAVING count(*) = 2 AND min(kids) = 0 AND max(kids) > 0"""
)
def q_inconsistent_divisions(spark, sf):
    """Divisions of which one child ends at once."""
    nodes, edges = _tree(spark, sf)
    return tracking.inconsistent_divisions(nodes, edges, 3).select("parent", "dead_end")


@query()
def q_lineage_layout(spark, sf):
    """Leaves in depth-first order, inner nodes at the mean of their children, of the whole tree (a recursion, without SQL)."""
    nodes, edges = _tree(spark, sf)
    return tracking.lineage_y(nodes, edges.toDF("src", "dst"))


# ---------------------------------------------------------------- scalars


@query("""SELECT c_custkey, regexp_extract(c_name, '^Customer#([0-9]+)', 1)::BIGINT AS number FROM customer""")
def q_keys(spark, sf):
    """Named groups of an anchored pattern, digits as numbers."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return S.parsed_keys(c, "c_name", r"Customer#(?P<number>\d+)").select("c_custkey", "number")


@query(
    """SELECT page_id, regexp_replace(regexp_extract(regexp_replace(split_part(url, '?', 1), '/+$', ''), '([^/]*)$', 1), '([^.])\\.[^.]*$', '\\1') AS stem FROM pages"""
)
def q_stem(spark, sf):
    """File stem of a URL, its query string left out."""
    return table(spark, sf, "pages").select("page_id", S.execution_name(F.col("url"), "string").alias("stem"))


@query(
    """SELECT name, (row_number() OVER (ORDER BY lpad(regexp_extract(name, '_([0-9]+)', 1), 12, '0'), name) - 1)::INT AS frame
    FROM (SELECT 'img_' || (p_partkey * 37 % 1009) || '_' || p_partkey || '.tif' AS full_name, 'img_' || p_partkey || '.tif' AS name FROM part)"""
)
def q_natural_sort(spark, sf):
    """Frame numbers of file names in digit-aware order."""
    from celltide.sources import sequences

    files = table(spark, sf, "part").select(F.concat(F.lit("/data/img_"), "p_partkey", F.lit(".tif")).alias("path"))
    return sequences.folder_frames(files).select(S.basename(F.col("path")).alias("name"), "frame")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, round(value, 2) AS value FROM events")
def q_json_flatten(spark, sf):
    """A recorded map spread into columns; a column the table has wins."""
    e = table(spark, sf, "events").select("event_id", F.round("value", 2).alias("value"), F.from_json("props", "map<string,string>").alias("params"))
    return provenance.flattened(e, "params").withColumn("k", F.col("k").cast("bigint"))


@query(
    """SELECT user_id, lpad(((s // 86400))::VARCHAR, 2, '0') || 'd ' || lpad((s % 86400 // 3600)::VARCHAR, 2, '0') || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' AS span,
    (s // 3600) || 'h ' || (s % 3600) || 's' AS short FROM (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s FROM events GROUP BY 1)"""
)
def q_strfdelta(spark, sf):
    us = lambda f: f(F.unix_micros(F.col("ts").cast("timestamp")))
    e = table(spark, sf, "events").groupBy("user_id").agg(F.floor((us(F.max) - us(F.min)) / 1_000_000).alias("s"))
    return e.select("user_id", S.strfdelta(F.col("s")).alias("span"), S.strfdelta(F.col("s"), "{H}h {S}s").alias("short"))


@query(
    """SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1) % 10 AS palette,
    round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS shade FROM events"""
)
def q_category_colors(spark, sf):
    """Palette index of a category, position of a number in its range."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    kinds = e.select("event_type").distinct().withColumn("palette", ((F.row_number().over(W.orderBy("event_type")) - 1) % 10).cast("bigint"))
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = e.join(F.broadcast(kinds), "event_type").crossJoin(F.broadcast(ends))  # one row of ends
    return out.select("event_id", "palette", _r(S.lut(F.col("value"), 0, 1, 0, 1) * 0 + (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("shade"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 0.07 * 0.13, 6) AS area, round(l_quantity * sqrt(0.07 * 0.13) * 1000, 4) AS length_nm,
    round(l_extendedprice / 60, 6) AS per_minute FROM lineitem"""
)
def q_calibrated_units(spark, sf):
    """Anisotropic calibration and unit conversion."""
    size = (0.07, 0.13)
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        _r(F.col("l_quantity") * U.pixel_unit(size, 2)).alias("area"),
        _r(U.convert(F.col("l_quantity") * U.pixel_unit(size, 1), "micrometer", "nm"), 4).alias("length_nm"),
        _r(U.convert(F.col("l_extendedprice"), "1/hour", "1/minute")).alias("per_minute"),
    )


@query(
    """SELECT c_custkey, CASE WHEN p > 2147483647 THEN p - 4294967296 ELSE p END AS rgba FROM
    (SELECT c_custkey, (c_custkey % 256) * 16777216 + (c_nationkey * 10)::BIGINT * 65536 + (c_custkey * 7 % 256) * 256 + 255 AS p FROM customer)"""
)
def q_rgba(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", S.rgba_to_int(k % 256, (F.col("c_nationkey") * 10), k * 7 % 256).alias("rgba"))


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size
    FROM (SELECT doc_id, strlen(text)::DOUBLE AS n FROM documents)"""
)
def q_human_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.human_size(F.octet_length("text").cast("double")).alias("size"))


@query(
    """SELECT p_partkey, round(CASE WHEN a <= -90 THEN a + 180 WHEN a > 90 THEN a - 180 ELSE a END, 6) AS wrapped,
    round(d - floor(d / 180) * 180 - 90, 6) AS difference, round(-sin(radians(a)), 6) AS nx, round(cos(radians(a)), 6) AS ny
    FROM (SELECT p_partkey, a, a - b + 90 AS d FROM (SELECT p_partkey, (p_partkey * 7.5 % 360 - 180)::DOUBLE AS a, (p_size * 3.0)::DOUBLE AS b FROM part))"""
)
def q_angles(spark, sf):
    """Line angles: wrapped, compared, and their normals."""
    a = F.col("p_partkey") * 7.5 % 360 - 180
    p = table(spark, sf, "part").select("p_partkey", a.cast("double").alias("a"), (F.col("p_size") * 3.0).alias("b"))
    n = S.line_normal(F.col("a"))
    return p.select(
        "p_partkey",
        _r(S.wrap_angle(F.col("a"))).alias("wrapped"),
        _r(S.angle_diff(F.col("a"), F.col("b"))).alias("difference"),
        _r(n["x"]).alias("nx"),
        _r(n["y"]).alias("ny"),
    )


@query(
    """SELECT event_id, round((greatest(50.0, least(200.0, value)) - 50) / 150.0 * 255, 6) AS shown,
    floor((value - lo) / (hi - lo) * 255)::INT AS byte FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)"""
)
def q_intensity(spark, sf):
    """Lookup table with clipping, and min-max scaling to bytes."""
    e = table(spark, sf, "events").select("event_id", "value")
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = e.crossJoin(F.broadcast(ends))  # one row of ends
    return out.select("event_id", _r(S.lut(F.col("value"), 50, 200, 0, 255)).alias("shown"), S.to_uint8(F.col("value"), F.col("lo"), F.col("hi")).alias("byte"))


@query("SELECT p_partkey, p_partkey // 7 AS t, p_partkey % 7 AS z FROM part")
def q_linear_index(spark, sf):
    i = S.linear_index(F.col("p_partkey"), 7, 7)
    return table(spark, sf, "part").select("p_partkey", i["t"].cast("bigint").alias("t"), i["z"].cast("bigint").alias("z"))


# ---------------------------------------------------------------- registration

_T = "(SELECT p_partkey AS id, (p_size % 9)::DOUBLE AS dx, (p_partkey % 5)::DOUBLE AS dy, (p_partkey % 90)::DOUBLE AS th, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size / 60.0 END AS cf FROM part)"


def _transforms(spark, sf):
    k = F.col("p_partkey")
    t = F.struct(
        (F.col("p_size") % 9).cast("double").alias("dx"),
        (k % 5).cast("double").alias("dy"),
        (k % 90).cast("double").alias("theta"),
        F.when(k % 4 != 0, F.col("p_size") / 60.0).alias("confidence"),
    )
    return table(spark, sf, "part").select(k.alias("id"), t.alias("t"))


@query(
    f"""SELECT a.id, round(b.dx + cos(radians(b.th)) * a.dx + sin(radians(b.th)) * a.dy, 6) AS dx, round(b.dy - sin(radians(b.th)) * a.dx + cos(radians(b.th)) * a.dy, 6) AS dy,
    a.th + b.th AS theta, CASE WHEN a.cf IS NOT NULL AND b.cf IS NOT NULL THEN round(least(a.cf, b.cf), 6) END AS confidence FROM {_T} a JOIN {_T} b ON b.id = a.id + 1"""
)
def q_compose(spark, sf):
    """Transforms composed with the next."""
    t = _transforms(spark, sf)
    pairs = t.join(t.select((F.col("id") - 1).alias("id"), F.col("t").alias("u")), "id")
    out = pairs.select("id", registration.compose(F.col("t"), F.col("u")).alias("c"))
    return out.select("id", _r(F.col("c.dx")).alias("dx"), _r(F.col("c.dy")).alias("dy"), F.col("c.theta").alias("theta"), _r(F.col("c.confidence")).alias("confidence"))


@query(
    f"""SELECT id, round(320 + cos(r) * (100 - 320 - dx) - sin(r) * (50 - 240 - dy), 6) AS center_x, round(240 + sin(r) * (100 - 320 - dx) + cos(r) * (50 - 240 - dy), 6) AS center_y,
    round(10 + th, 6) AS angle FROM (SELECT *, radians(th) AS r FROM {_T})"""
)
def q_correct_spec(spark, sf):
    """A crop's centre and angle under the inverse transform about the image centre."""
    c = registration.correct_spec(F.lit(100.0), F.lit(50.0), F.lit(10.0), F.col("t"), 480.0, 640.0)
    out = _transforms(spark, sf).select("id", c.alias("c"))
    return out.select("id", _r(F.col("c.center_x")).alias("center_x"), _r(F.col("c.center_y")).alias("center_y"), _r(F.col("c.angle")).alias("angle"))


@query(
    """WITH s AS (SELECT DISTINCT floor(event_id / 7)::BIGINT * 7 AS f FROM events WHERE value > 100),
    b AS (SELECT event_id, s.f AS lo FROM events ASOF LEFT JOIN s ON event_id >= s.f),
    a AS (SELECT event_id, s.f AS hi FROM events ASOF LEFT JOIN s ON event_id <= s.f)
    SELECT event_id AS frame, CASE WHEN lo IS NULL OR hi - event_id < event_id - lo THEN hi ELSE lo END AS source_frame FROM b JOIN a USING (event_id)"""
)
def q_nearest_transform(spark, sf):
    """Nearest stored frame, ties to the lower one."""
    e = table(spark, sf, "events").select("event_id")
    stored = table(spark, sf, "events").filter("value > 100").select((F.floor(F.col("event_id") / 7) * 7).alias("frame")).distinct().withColumn("transform", F.lit(0.0))
    frames = e.select(F.col("event_id").alias("frame"))
    return registration.nearest_transform(frames, stored).select("frame", "source_frame")


# ---------------------------------------------------------------- provenance


def _io(spark, sf):
    """Orders as outputs of a stage named by priority, line items as inputs that read them."""
    o = table(spark, sf, "orders").select(
        F.lit("p").alias("population_id"),
        F.col("o_orderpriority").alias("stage"),
        F.col("o_orderkey").alias("position"),
        F.lit("output").alias("direction"),
        F.concat(F.lit("file_"), F.col("o_orderkey") % 5000).alias("path"),
    )
    return o


@query(
    """SELECT path, arg_max(o_orderpriority, o_orderkey) AS stage FROM (SELECT 'file_' || (o_orderkey % 5000) AS path, o_orderpriority, o_orderkey FROM orders) GROUP BY 1"""
)
def q_producers(spark, sf):
    """The last stage that wrote each file."""
    return provenance.producers(_io(spark, sf)).select("path", "stage")


@query(
    """SELECT DISTINCT o_orderpriority AS upstream, 'file_' || o_orderkey AS artifact, l_returnflag || l_linestatus AS downstream FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderpriority <> l_returnflag || l_linestatus"""
)
def q_stage_edges(spark, sf):
    """Which stage read what another produced."""
    lines = table(spark, sf, "lineitem")
    io = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("p").alias("population_id"),
        F.concat("l_returnflag", "l_linestatus").alias("stage"),
        F.lit("input").alias("direction"),
        F.concat(F.lit("file_"), "o_orderkey").alias("path"),
        F.col("o_orderpriority").alias("produced_by"),
    )
    return provenance.stage_edges(io).select("upstream", "artifact", "downstream").distinct()


@query(
    """SELECT doc_id, size, size_now FROM (SELECT d.doc_id, d.n_chars AS size, d.n_chars + l.toxic AS size_now, l.quality AS q FROM documents d JOIN labels l USING (doc_id))
    WHERE size <> size_now OR q = 0"""
)
def q_stale(spark, sf):
    """Inputs whose file has another size or a later time."""
    d, la = table(spark, sf, "documents"), table(spark, sf, "labels")
    io = d.select(F.lit("p").alias("population_id"), F.col("doc_id").alias("path"), F.lit("input").alias("direction"), F.col("n_chars").alias("size"), F.lit(10.0).alias("mtime"))
    now = d.join(la, "doc_id").select(
        F.lit("p").alias("population_id"), F.col("doc_id").alias("path"), (F.col("n_chars") + F.col("toxic")).alias("size"), (11.0 - F.col("quality")).alias("mtime")
    )
    return provenance.stale(io, now).select(F.col("path").alias("doc_id"), "size", "size_now")


# ---------------------------------------------------------------- sets and frames


@query("SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame, count(*)::BIGINT AS n FROM events GROUP BY 1 UNION ALL SELECT unnest([100, 101]), 0")
def q_per_frame(spark, sf):
    """Detections per declared frame, empty frames included."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), _day("ts").cast("int").alias("frame"))
    declared = e.select("frame").distinct().union(spark.createDataFrame([(100,), (101,)], "frame int"))
    return model.per_frame(e, declared).select("frame", F.size("ids").cast("bigint").alias("n"))


@query("SELECT user_id, (max(date_diff('day', DATE '2024-01-01', ts::DATE)) + 1)::INT AS extent FROM events GROUP BY 1")
def q_frame_extent(spark, sf):
    e = table(spark, sf, "events").select("user_id", _day("ts").cast("int").alias("frame"))
    return model.frame_extent(e, ("user_id",))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts)::VARCHAR AS window_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windowed(spark, sf):
    """The streaming aggregate on a batch relation."""
    from celltide.streaming import frames

    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("area"))
    out = frames.per_window(e, window="6 hours", by=("event_type",))
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", _r("total", 4).alias("total"))


# ---------------------------------------------------------------- catalogues, headers, lines


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def q_catalog_images(spark, sf):
    """Images below a project: region > nation > customer as project > dataset > image."""
    from celltide.sources import catalog

    images = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dataset_id"))
    datasets = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project_id"))
    return catalog.images_in(images, datasets, "Project", 2)


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget')")
def q_tags(spark, sf):
    from celltide.sources import catalog

    return table(spark, sf, "part").filter(catalog.has_all_tags(F.split("p_name", " "), ["red", "widget"])).select("p_partkey")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber AS frame, arg_min(l_quantity, l_partkey) AS t FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3 GROUP BY ALL)
    SELECT l_orderkey, frame - 1 AS frame, t FROM f WHERE l_orderkey IN (SELECT l_orderkey FROM f GROUP BY 1 HAVING count(*) = 3)"""
)
def q_plane_timepoints(spark, sf):
    """First recorded time of each frame, for sequences whose frames are all there."""
    from celltide.sources import catalog

    planes = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("position"), (F.col("l_linenumber") - 1).alias("the_t"), F.col("l_quantity").alias("delta_t")
    )
    return catalog.plane_timepoints(planes, 3, ("l_orderkey",))


_LINES = "(SELECT user_id AS frame, event_id AS line, (value % 180) - 90 AS angle, event_id % 997 * 1.0 AS rho, value AS length FROM events)"


def _lines(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("frame"), F.col("event_id").alias("line"), (F.col("value") % 180 - 90).alias("angle"), (F.col("event_id") % 997 * 1.0).alias("rho"), F.col("value").alias("length")
    )


def _turn(a: str, b: str) -> str:
    return f"abs(({a} - {b} + 90) - floor(({a} - {b} + 90) / 180) * 180 - 90)"


@query()
def q_dedupe_lines(spark, sf):
    """A greedy scan by length, without SQL."""
    return registration.dedupe_lines(_lines(spark, sf), 5.0, 60.0).select("frame", "line")


@query(
    f"""WITH r AS (SELECT p_partkey AS ref, p_size * 3.0 - 90 AS ref_angle, p_partkey * 1.0 AS ref_rho FROM part),
    m AS (SELECT frame, line, ref, abs(rho - ref_rho) AS distance FROM {_LINES}, r WHERE {_turn('angle', 'ref_angle')} <= 5),
    k AS (SELECT *, row_number() OVER w AS i, lead(distance) OVER w AS second FROM m WINDOW w AS (PARTITION BY frame, line ORDER BY distance, ref)),
    b AS (SELECT *, row_number() OVER (PARTITION BY frame, ref ORDER BY distance, line) AS j FROM k WHERE i = 1 AND (second IS NULL OR second > 2.05 * greatest(distance, 1)))
    SELECT frame, line, ref, distance FROM b WHERE j = 1"""
)
def q_match_lines(spark, sf):
    ref = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), (F.col("p_size") * 3.0 - 90).alias("ref_angle"), (F.col("p_partkey") * 1.0).alias("ref_rho"))
    return registration.match_lines(_lines(spark, sf), ref)


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.5 THEN 'ok' ELSE 'rejected' END AS verdict FROM orders")
def q_gate(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", registration.gate(F.col("o_totalprice") / 500000, 0.5, "reject").alias("verdict"))


@query("SELECT o_orderkey, round(greatest(-0.5, least(0.5, CASE WHEN abs(c) < 1e-12 THEN 0 ELSE 0.5 * (a - b) / c END)), 6) AS shift FROM (SELECT o_orderkey, o_custkey % 7 AS a, o_custkey % 5 AS b, o_custkey % 7 - 2 * 9.0 + o_custkey % 5 AS c FROM orders)")
def q_parabola(spark, sf):
    k = F.col("o_custkey")
    v = S.parabolic_refine((k % 7).cast("double"), F.lit(9.0), (k % 5).cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", _r(v).alias("shift"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey > 0 THEN o_totalprice / o_custkey * 40 END, 3) AS eta FROM orders")
def q_eta(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _r(S.eta(F.col("o_totalprice"), F.col("o_custkey"), F.lit(40)), 3).alias("eta"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM events")
def q_utc_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.utc_text(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("utc"))


@query(f"SELECT id, x0 || ',' || y0 || ' ' || x1 || ',' || y1 AS polygon FROM (SELECT vec_id AS id, label AS x0, label + 1 AS y0, vec_id % 9 AS x1, 7 AS y1 FROM embeddings)")
def q_polygon_text(spark, sf):
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    d = table(spark, sf, "embeddings")
    coords = F.array(point(F.col("label"), F.col("label") + 1), point(F.col("vec_id") % 9, F.lit(7)))
    return d.select(F.col("vec_id").alias("id"), S.polygon_text(coords).alias("polygon"))
