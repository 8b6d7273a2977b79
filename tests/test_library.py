"""Operators of the library on small literal fixtures with known answers."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from celltide import model
from celltide.functions import geometry as G
from celltide.functions import scalars as S
from celltide.functions import units as U
from celltide.operators import filters, registration, stats, tracking
from celltide.operators import properties as P


def square(x, y, n=2.0):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


# ---------------------------------------------------------------- properties


def test_single_rectangle(spark):
    d = model.detections(spark, [(23, 0, 1, None, [(0, 0), (2, 0), (2, 3), (0, 3)])])
    points = model.resolve_timepoints(spark, 3, frame_interval=15.0, unit="minute")
    ctx = P.Context(pixel_size=0.07, height=10, width=10, timepoints=points)
    out = P.extract(
        d, [P.AreaEx(), P.PerimeterEx(), P.CircularityEx(), P.LengthWidthEx(), P.PositionEx(), P.BoundaryClosenessEx(), P.IdEx(), P.LabelEx(), P.TimeEx(), P.FrameEx()], ctx
    )
    r = out.first()
    assert r.area == pytest.approx(6 * 0.07**2) and r.perimeter == pytest.approx(10 * 0.07)
    assert (r.length, r.width) == (pytest.approx(3 * 0.07), pytest.approx(2 * 0.07))
    assert r.circularity == pytest.approx(0.7539822368615503)
    assert (r.position_x, r.position_y) == (pytest.approx(0.07), pytest.approx(1.5 * 0.07))
    assert (r.boundary_closeness, r.id_value, r.label, r.time, r.frame) == (0, 23, 1, 0, 0)
    assert U.units(out)["area"] == "micrometer ** 2" and U.units(out)["time"] == "hour" and "circularity" not in U.units(out)


def test_fluorescence_of_mask_and_polygon(spark):
    from celltide.sources import sequences

    image = np.array([[2, 5], [6, 10], [4, 4]], float)
    d = model.detections(spark, [(23, 0, 1, None, [(-0.5, -0.5), (1.5, -0.5), (1.5, 2.5), (-0.5, 2.5)])])
    px = sequences.channel_pixels(sequences.frames_of_arrays(spark, image[None])).drop("source_id")
    inside = sequences.mask_rows(d, 3, 2).join(px, ["frame", "y", "x"])
    for summary, want in (("median", 4.5), ("mean", 31 / 6), ("max", 10.0)):
        r = P.extract(d, [P.FluorescenceEx(["v"], ["gfp"], summary)], P.Context(pixels=inside)).first()
        assert r.gfp == pytest.approx(want)


def test_unmeasurable_rows(spark):
    rows = [(1, 0, 1, None, [(0, 0), (1, 1), (2, 2)]), (2, 0, 1, None, [(5, 5)] * 3), (3, 0, 1, None, [(0, 0), (4, 0), (0, 4)])]
    d = model.detections(spark, rows)
    p = P.extract(d, [P.LengthEx(), P.WidthEx(), P.PerimeterEx(), P.AreaEx(), P.BoundaryClosenessEx()], P.Context(height=9, width=9))
    got = {r.id: r for r in p.collect()}
    assert all(math.isnan(got[i].length) and math.isnan(got[i].width) and math.isnan(got[i].perimeter) for i in (1, 2))
    assert got[1].area == got[1].boundary_closeness == 0 and got[3].area == 8
    for f in (filters.LengthFilter(), filters.LengthFilter(0), filters.WidthFilter(None, 100)):
        assert [r.id for r in filters.apply_cell_filters(d, [f], p).collect()] == [3]
    assert filters.apply_cell_filters(d, [], p).count() == 3


def test_empty_detections_give_a_typed_table(spark):
    out = P.extract(model.detections(spark, []), [P.AreaEx(), P.LengthWidthEx()], P.Context(pixel_size=0.1))
    assert out.columns == ["id", "area", "length", "width"] and out.count() == 0
    assert out.schema["area"].metadata["unit"] == "micrometer ** 2"


def test_duplicate_ids_are_an_error(spark):
    d = model.detections(spark, [(1, 0, 1, None, square(0, 0)), (1, 1, 1, None, square(0, 0))])
    with pytest.raises(ValueError, match="duplicate contour id"):
        P.extract(d, [P.AreaEx()])
    with pytest.raises(PySparkException, match="duplicate contour id"):
        model.unique_or_raise(d).collect()
    with pytest.raises(KeyError):
        P.extract(d.limit(1), [P.CircularityEx()])


def test_area_filter_with_units(spark):
    rows = [(i, 0, 1, None, square(0, 0, math.sqrt(a))) for i, a in enumerate((16, 64, 144))]
    d = model.detections(spark, rows)
    p = P.extract(d, [P.AreaEx()], P.Context(pixel_size=0.5))

    def kept(f):
        return sorted(r.id for r in filters.apply_cell_filters(d, [f], p).collect())

    assert kept(filters.AreaFilter(2, 20)) == [0, 1] and kept(filters.AreaFilter(10)) == [1, 2]
    assert kept(filters.AreaFilter("1e-5 mm ** 2")) == [1, 2]
    with pytest.raises(U.DimensionError):
        filters.AreaFilter("3 hour").mask(p)
    with pytest.raises(ValueError, match="not in the property table"):
        filters.apply_cell_filters(d, [filters.AreaFilter(2)], p.limit(1))
    assert filters.size_filter(d, 16, 144).count() == 1


def test_combine_and_masks(spark):
    px = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 1, 2), (0, 1, 4, 2), (0, 1, 1, 5), (1, 3, 3, 2), (0, 9, 9, 0)], "frame int, y int, x int, label int")
    got = [(r.id, r.frame, r.label, r.area, r.center_x, r.center_y, r.x1) for r in P.detections_of_masks(px).orderBy("id").collect()]
    assert got == [(1, 0, 2, 3.0, 1.0, 0.0, 4), (2, 0, 5, 1.0, 1.0, 1.0, 1), (3, 1, 2, 1.0, 3.0, 3.0, 3)]
    both = px.union(spark.createDataFrame([(0, 0, 0, 7)], px.schema))
    assert P.label_pixels(both).filter("frame = 0 and y = 0 and x = 0").first().label == 7


# ---------------------------------------------------------------- geometry


def test_raster_and_trace_agree():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = np.sort(rng.random(9) * 2 * np.pi)
        p = np.stack([15 + 9 * np.cos(a), 15 + 9 * np.sin(a)], 1)
        mask = G.raster(p, 30, 30)
        y, x = np.mgrid[:30, :30]
        inside = np.ones_like(mask)
        for s, e in zip(p, np.roll(p, -1, axis=0)):
            inside &= (e[0] - s[0]) * (y - s[1]) - (e[1] - s[1]) * (x - s[0]) > 0
        assert (mask == inside).all()
        again = np.zeros_like(mask)
        again[G.pixels(p, 30, 30)] = True
        assert (again == mask).all()
        cut = np.zeros((18, 17), bool)
        cut[G.pixels(p, 18, 17)] = True
        assert (cut == mask[:18, :17]).all()
        if mask.any():
            assert sum(abs(G.shoelace(q)) for q in G.trace(mask)) == mask.sum()


def test_trace_of_touching_and_split_parts():
    mask = np.zeros((6, 7), bool)
    mask[0:2, 0:2] = mask[2:4, 2:5] = mask[5, 6] = True
    parts = G.trace(mask)
    assert [abs(G.shoelace(p)) for p in parts] == [6, 4, 1] and len(parts[0]) == 4
    assert G.label_components(mask).max() == 3
    hook = np.array([[1, 1, 1], [1, 0, 0], [1, 1, 1]], bool)
    assert abs(G.shoelace(G.trace(hook)[0])) == 7


def test_intersection_area():
    a, b = np.array(square(0, 0, 4.0)), np.array(square(2, 1, 4.0))
    assert G.intersection_area(a, b) == pytest.approx(6)
    hook = np.array([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)], float)
    assert G.intersection_area(hook, np.array(square(1, 3, 4.0))) == pytest.approx(2 * 3 - 0)
    assert G.intersection_area(a, np.array(square(9, 9))) == 0


def test_min_rectangle_is_no_larger_than_any_other():
    rng = np.random.default_rng(4)
    p = rng.normal(size=(12, 2)) * [5, 1]
    hull = G.convex_hull(p)
    length, width = G.length_width(hull)
    for t in np.linspace(0, np.pi, 721):
        u = np.array([np.cos(t), np.sin(t)])
        v = np.array([-u[1], u[0]])
        assert length * width <= np.ptp(hull @ u) * np.ptp(hull @ v) + 1e-9


def test_ellipse_fit():
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    t = 0.4
    p = np.stack([12 * np.cos(a), 5 * np.sin(a)], 1) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + [30, 7]
    assert filters.fit_ellipse(p) == (pytest.approx(10, rel=1e-6), pytest.approx(24, rel=1e-6))
    assert filters.fit_ellipse(p[:4]) is None


def test_ellipsoid_filter(spark):
    a = np.linspace(0, 2 * np.pi, 30, endpoint=False)
    d = model.detections(
        spark, [(1, 0, 1, None, np.stack([12 * np.cos(a), 5 * np.sin(a)], 1).tolist()), (2, 0, 1, None, square(0, 0, 9.0)), (3, 0, 1, None, [(0, 0), (9, 0), (9, 3), (4, 3), (0, 3)])]
    )
    assert [r.id for r in filters.ellipsoid_filter(d, 0.2, 0.6).collect()] == [1]
    assert filters.ellipsoid_filter(d, 0.6, 1.0).count() == 0


# ---------------------------------------------------------------- suppression


def test_nms_is_not_greedy(spark):
    # 1 is suppressed by 2, and 2 by 3; 1 doesn't meet 3
    rows = [(1, 0, 1, 0.1, square(0, 0, 4.0)), (2, 0, 1, 0.5, square(3, 0, 4.0)), (3, 0, 1, 0.9, square(6, 0, 4.0)), (4, 1, 1, None, square(0, 0, 4.0)), (5, 0, 1, 1.0, [(0, 0), (1, 1)])]
    d = model.detections(spark, rows)
    for cell in (None, 3.0):
        assert sorted(r.id for r in filters.nms(d, 0.1, cell=cell).collect()) == [3, 4]
    assert sorted(r.id for r in filters.nms(d, 0.3, "i").collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        filters.nms(d, mode="other")


def test_mask_nms(spark):
    boxes = spark.createDataFrame([(0, 1, 0.9, 0, 0, 3, 3), (0, 2, 0.5, 0, 0, 3, 2), (0, 3, 0.05, 0, 0, 3, 3), (0, 4, 0.9, 2, 2, 6, 6)], "frame int, id int, score double, x0 int, y0 int, x1 int, y1 int")
    cells = [(0, i, y, x) for i, _, _, x0, y0, x1, y1 in [r[1:] and (r[1], r[0], r[2], r[3], r[4], r[5], r[6]) for r in boxes.collect()] for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
    px = spark.createDataFrame(cells, "frame int, id int, y int, x int")
    assert sorted(r.id for r in filters.mask_nms(boxes, px).collect()) == [1, 4]


def test_histogram_of_one_value(spark):
    d = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),)], "v double")
    assert [tuple(r) for r in filters.shared_histogram(d, "v").collect()] == [(0, 1.0, 2, 2, 0)]


# ---------------------------------------------------------------- time


def test_time_model(spark):
    t = model.resolve_timepoints(spark, 6, frame_interval=15.0, unit="minute")
    assert [r.t for r in model.sliced_time(t, step=2).orderBy("frame").collect()] == [0, 30, 60]
    explicit = model.resolve_timepoints(spark, 6, timepoints=[0, 10, 20, 30, 40, 50])
    assert [(r.frame, r.t) for r in model.sliced_time(explicit, step=2).orderBy("frame").collect()] == [(0, 0), (1, 20), (2, 40)]
    assert model.resolve_timepoints(spark, 6) is None
    with pytest.raises(ValueError):
        model.resolve_timepoints(spark, 5, timepoints=[1, 2])
    assert model.frame_interval(t).first().frame_interval == 15
    assert model.sliced_pixel_size(0.1, 2, 2) == 0.2 and model.sliced_pixel_size(0.1, 2, 1) == (0.2, 0.1)


def test_irregular_times_and_slices(spark):
    d = model.detections(spark, [(i, f, 1, None, square(0, 0)) for i, f in enumerate((2, 5, 7, 11))])
    out = P.extract(d.filter("frame < 3"), [P.DynamicTimeEx([1710326747, 1710326988, 1710327228])])
    assert out.first().time == pytest.approx(481 / 3600)
    assert {(r.frame, r.source_frame) for r in model.slice_frames(d, 1, None, 2).collect()} == {(0, 5), (1, 11)}
    assert {(r.frame, r.source_frame) for r in model.slice_frames(d, -3, -1).collect()} == {(0, 5), (1, 7)}
    assert {(r.frame, r.source_frame) for r in model.pick_frames(d, [-1, 0]).collect()} == {(0, 11), (1, 2)}
    with pytest.raises(IndexError):
        model.pick_frames(d, [4])
    assert model.frame_extent(d).first().extent == 12 and model.frame_extent(d.limit(0)).first().extent == 0
    assert [len(r.ids) for r in model.per_frame(d, end=8).orderBy("frame").collect()] == [1, 0, 0, 1, 0, 1, 0]


# ---------------------------------------------------------------- growth


def curve(spark, q0, mu, ts, rows=1):
    return spark.createDataFrame([(float(t), q0 * math.exp(mu * t)) for t in ts for _ in range(rows)], "time double, area double")


def test_growth(spark):
    r = stats.growth_rate(curve(spark, 5, 0.3, range(11))).first()
    assert (r.growth_rate, r.initial_value, r.r_squared, r.doubling_time) == (pytest.approx(0.3), pytest.approx(5), pytest.approx(1), pytest.approx(math.log(2) / 0.3))
    m = stats.growth_rate(curve(spark, 3, 0.25, range(7), 3), agg="mean").first()
    assert (m.initial_value, m.growth_rate) == (pytest.approx(3), pytest.approx(0.25))
    two = stats.growth_rate(curve(spark, 3, 0.25, range(2))).first()
    assert all(math.isnan(two[c]) for c in ("std_err", "ci_low", "ci_high", "p_value")) and two.growth_rate == pytest.approx(0.25)
    assert math.isnan(stats.growth_rate(curve(spark, 3, -0.25, range(5))).first().doubling_time)
    for bad in ([(0.0, 1.0), (1.0, 0.0)], [(0.0, 1.0)], [(0.0, 1.0), (1.0, float("inf"))]):
        with pytest.raises(PySparkException, match="growth needs"):
            stats.growth_rate(spark.createDataFrame(bad, "time double, area double")).collect()
    with pytest.raises(ValueError):
        stats.aggregate(curve(spark, 1, 1, [1]), agg="max")


def test_growth_inference_against_the_formulas(spark):
    rng = random.Random(6)
    pts = [(float(t), math.exp(0.2 * t + rng.gauss(0, 0.1))) for t in range(12)]
    r = stats.growth_rate(spark.createDataFrame(pts, "time double, area double")).first()
    t, z = np.array([p[0] for p in pts]), np.log([p[1] for p in pts])
    slope, icpt = np.polyfit(t, z, 1)
    se = math.sqrt(((z - slope * t - icpt) ** 2).sum() / 10 / ((t - t.mean()) ** 2).sum())
    assert (r.growth_rate, r.std_err) == (pytest.approx(slope), pytest.approx(se))
    assert (r.ci_high - r.growth_rate) / r.std_err == pytest.approx(2.2281388519649385)
    assert r.p_value == pytest.approx(stats.t_two_sided(slope / se, 10)) and 0 < r.p_value < 1e-6


def test_student_t():
    # tabulated two-sided 95 % quantiles
    for df, want in ((1, 12.706204736), (2, 4.302652730), (5, 2.570581836), (30, 2.042272456), (1000, 1.962339081)):
        assert stats.t_quantile(0.975, df) == pytest.approx(want, rel=1e-8)
        assert stats.t_two_sided(want, df) == pytest.approx(0.05, rel=1e-7)


def test_nan_keys_and_values_take_no_part(spark):
    rows = [(0.0, 1.0), (0.0, float("nan")), (float("nan"), 5.0), (1.0, 2.0), (None, 3.0)]
    got = {r.t: r.y for r in stats.aggregate(spark.createDataFrame(rows, "time double, area double")).collect()}
    assert got == {0.0: 1.0, 1.0: 2.0}


# ---------------------------------------------------------------- lineages


@pytest.fixture(scope="module")
def lineage(spark):
    rows = [(1, 0, 2, 0), (2, 3, 10, 1), (3, 3, 5, 1), (30, 6, 12, 3), (31, 6, 12, 3), (40, 0, 2, 0), (41, 3, 5, 40), (42, 6, 10, 41), (43, 6, 10, 41), (44, 6, 10, 41)]
    return tracking.tracklets_of_text(spark.createDataFrame(rows, "label bigint, start_frame int, end_frame int, parent bigint"))


def test_doubling_times(spark, lineage):
    t = model.resolve_timepoints(spark, 13, frame_interval=15.0, unit="minute")
    assert [tuple(r) for r in tracking.doubling_times(*lineage, t).collect()] == [(3, 45.0, 75.0, 45.0)]
    with pytest.raises(ValueError):
        tracking.doubling_times(*lineage, None)
    with pytest.raises(PySparkException, match="out of bounds"):
        tracking.doubling_times(*lineage, model.resolve_timepoints(spark, 4, frame_interval=1.0)).collect()
    back = model.resolve_timepoints(spark, 13, timepoints=[float(-i) for i in range(13)])
    with pytest.raises(PySparkException, match="negative doubling time"):
        tracking.doubling_times(*lineage, back).collect()


def test_irregular_doubling(spark):
    rows = [(0, 0, 0, 9), (1, 1, 3, 0), (2, 5, 7, 1), (3, 5, 7, 1)]
    df = spark.createDataFrame(rows, "label bigint, start_frame int, end_frame int, parent bigint")
    nodes, edges = df.drop("parent"), df.filter("label > 0").select("parent", F.col("label").alias("child"))
    t = model.resolve_timepoints(spark, 8, timepoints=[0, 10, 20, 30, 100, 110, 120, 130])
    assert [r.doubling_time for r in tracking.doubling_times(nodes, edges, t).collect()] == [100.0]


def chain(spark, edges, frames):
    n = spark.createDataFrame(sorted(frames.items()), "id bigint, frame int")
    return n, spark.createDataFrame(edges, "src bigint, dst bigint")


def test_subsampling(spark):
    n, e = chain(spark, [(i, i + 1) for i in range(9)], {i: i for i in range(10)})
    sn, se = tracking.subsample_lineage(n, e, 2)
    assert {r.id for r in sn.collect()} == {0, 2, 4, 6, 8} and se.count() == 4
    frames = {8 + i: i for i in range(5)} | {i: 5 + i for i in range(3)} | {3 + i: 5 + i for i in range(5)}
    edges = [(8, 9), (9, 10), (10, 11), (11, 12), (12, 0), (12, 3), (0, 1), (1, 2), (3, 4), (4, 5), (5, 6), (6, 7)]
    n, e = chain(spark, edges, frames)
    sn, se = tracking.subsample_lineage(n, e, 3)
    assert {r.id for r in sn.collect()} == {8, 11, 1, 4, 7}
    assert {tuple(r) for r in se.collect()} == {(8, 11), (11, 1), (11, 4), (4, 7)}
    # gaps: distinct frames against frame numbers
    n, e = chain(spark, [(0, 1), (1, 2), (2, 3)], {0: 0, 1: 3, 2: 4, 3: 6})
    assert {r.id for r in tracking.subsample_lineage(n, e, 2)[0].collect()} == {0, 2}
    tn, te = tracking.subsample_tracking(n, e, 2)
    assert {(r.id, r.frame) for r in tn.collect()} == {(0, 0), (2, 2), (3, 3)} and {tuple(r) for r in te.collect()} == {(0, 2), (2, 3)}
    with pytest.raises(ValueError):
        tracking.subsample_tracking(n, e, 0)


def test_contraction_against_deleting_nodes_one_by_one(spark):
    rng = random.Random(9)
    edges = sorted({(a, b) for _ in range(60) for a, b in [sorted(rng.sample(range(25), 2))]})
    drop = {i for i in range(25) if rng.random() < 0.6}
    want = set(edges)
    for v in drop:
        into, out = {a for a, b in want if b == v}, {b for a, b in want if a == v}
        want = {(a, b) for a, b in want if v not in (a, b)} | {(a, b) for a in into for b in out}
    n, e = chain(spark, edges, {i: i for i in range(25)})
    kept, got = tracking.contract(n, e, ~F.col("id").isin(list(drop)))
    assert {tuple(r) for r in got.collect()} == want and {r.id for r in kept.collect()} == set(range(25)) - drop


def test_life_cycles_traces_and_lines(spark):
    frames = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 9: 2}
    n, e = chain(spark, [(0, 1), (1, 2), (2, 3), (2, 4), (3, 5)], frames)
    cycles, edges = tracking.life_cycles(n, e)
    assert {tuple(r) for r in cycles.collect()} == {(0, 0, 2, 3), (3, 3, 4, 2), (4, 3, 3, 1), (9, 2, 2, 1)}
    assert {tuple(r) for r in edges.collect()} == {(0, 3), (0, 4)}
    lines = [r.line for r in tracking.lifecycle_lines(cycles, edges).orderBy("number").collect()]
    assert lines == ["1 0 2 0", "2 2 2 0", "3 3 4 1", "4 3 3 1"]
    traces = {r.id: r.trace for r in tracking.traces(n, e).collect()}
    assert traces[5] == "0.1.2.3.5" and traces[9] == "9"
    with pytest.raises(ValueError):
        tracking.traces(n, e.union(spark.createDataFrame([(9, 5)], "src bigint, dst bigint")))


def test_segments_and_expansion(spark):
    t = spark.createDataFrame([(5, 0, 3), (6, 4, 7), (7, 4, 6)], "label bigint, start_frame int, end_frame int")
    e = spark.createDataFrame([(5, 6), (5, 7)], "parent bigint, child bigint")
    points, lines = tracking.segments(t, e)
    assert points.count() == 6 and lines.count() == 5
    assert (5, 3, 6, 4) in {tuple(r) for r in lines.collect()}
    nodes, edges = tracking.expand_tracklets(t, e)
    assert nodes.count() == 11 and edges.count() == 3 + 3 + 2 + 2


def test_track_edges(spark):
    d = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 3, 1), (4, 4, 2), (5, 4, 3), (6, 5, 3)], "id bigint, frame int, label bigint")
    e = spark.createDataFrame([(1, 2), (1, 3)], "parent bigint, child bigint")
    assert {tuple(r) for r in tracking.track_edges(d, e).collect()} == {(1, 2), (2, 3), (3, 4), (3, 5), (5, 6)}


def test_layout(spark):
    t = spark.createDataFrame([(0, 0, 2), (1, 3, 5), (2, 3, 4), (3, 6, 8), (4, 6, 7)], "label bigint, start_frame int, end_frame int")
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "src bigint, dst bigint")
    y = {r.label: r.y for r in tracking.lineage_y(t, e).collect()}
    assert y == {3: 0.0, 4: 1.0, 2: 2.0, 1: 0.5, 0: 1.25}
    points, lines = tracking.plot_data(t, e, tracking.lineage_y(t, e))
    assert {r.label for r in points.filter("birth").collect()} == {0} and {r.label for r in points.filter("end").collect()} == {2, 3, 4}
    assert lines.count() == 4


def test_sequences_are_independent(spark):
    rows = [("a", 0, 0, 2), ("a", 1, 3, 5), ("a", 2, 3, 4), ("b", 10, 0, 2), ("b", 11, 4, 5), ("b", 12, 4, 6)]
    t = spark.createDataFrame(rows, "source_id string, label long, start_frame int, end_frame int")
    e = spark.createDataFrame([(0, 1), (0, 2), (10, 11), (10, 12)], "src bigint, dst bigint")
    y = {r.label: r.y for r in tracking.lineage_y(t, e, by=("source_id",)).collect()}
    assert y == {1: 0.0, 2: 1.0, 0: 0.5, 11: 0.0, 12: 1.0, 10: 0.5}
    n = t.select("source_id", F.col("label").alias("id"), F.col("start_frame").alias("frame"))
    kept, _ = tracking.subsample_lineage(n, e, 2, by=("source_id",))
    assert {r.id for r in kept.collect()} == {0, 10}
    cycles = t.select("source_id", F.col("label").alias("cycle"), "start_frame", "end_frame")
    lines = tracking.lifecycle_lines(cycles, e.toDF("parent", "child"), ("source_id",)).collect()
    assert {r.line for r in lines if r.source_id == "b"} == {"1 0 2 0", "2 4 5 1", "3 4 6 1"}


def test_bands(spark):
    d = spark.createDataFrame([(0.0, 10.0, float(i)) for i in range(6)] + [(8.0, 20.0, 3.0)], "start_time double, end_time double, doubling_time double")
    grid = spark.createDataFrame([(5.0,), (15.0,), (30.0,)], "t double")
    alive = {r.t: (r.n, r["mean"]) for r in stats.alive_at(d, grid, 5).collect()}
    assert alive == {5.0: (6, 2.5), 15.0: (1, None), 30.0: (0, None)}
    assert {r.t: (r.n, r["mean"]) for r in stats.alive_at(d, grid, 5, bucket=4.0).collect()} == alive
    bands = {r.t: r for r in stats.hose_bands(d, grid, (0.5, 0.95), 5, 400).collect()}
    (l1, a, b), (l2, c, e) = bands[5.0].bands
    assert c <= a <= 2.5 <= b <= e and math.isnan(bands[15.0]["mean"])
    with pytest.raises(ValueError):
        stats.hose_bands(d, grid, (1.5,))


# ---------------------------------------------------------------- units and scalars


def test_units():
    assert U.affine("µm**2", "mm ** 2")[0] == pytest.approx(1e-6)
    assert U.affine("1/hour", "1/minute")[0] == pytest.approx(1 / 60)
    assert U.affine("degC", "kelvin") == (1.0, 273.15)
    assert U.to_quantity("15 minute") == (15.0, "minute") and U.magnitude("2 hour", "minute") == 120
    assert U.pixel_unit((0.1, 0.4), 1) == pytest.approx(0.2) and U.pixel_unit((0.1, 0.4), 2) == pytest.approx(0.04)
    with pytest.raises(U.DimensionError):
        U.affine("hour", "meter")
    with pytest.raises(ValueError):
        U.parse("parsec_of_nothing")


def test_unit_metadata_and_csv(spark, tmp_path):
    from celltide.sources import formats

    d = U.attach_units(spark.createDataFrame([(1, 2.0, "a"), (2, None, "b")], "id long, area double, name string"), {"area": "µm**2", "id": "1"})
    assert U.units(d) == {"area": "µm**2"}
    mm = U.converted(d, "area", "mm**2")
    assert mm.first().area == pytest.approx(2e-6) and U.unit_of(mm, "area") == "mm**2"
    path = str(tmp_path / "t.csv")
    formats.write_units_csv(d, path)
    back = formats.read_units_csv(spark, path)
    assert U.units(back) == {"area": "µm**2"} and [tuple(r) for r in back.collect()] == [(1.0, 2.0, "a"), (2.0, None, "b")]
    assert U.units(U.strip_units(d)) == {}


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.strfdelta(lit(460442.9), "{W}w {D}d {H}:{M:02}:{S:02}")) == "0w 5d 7:54:02"
    assert one(spark, S.strfdelta(lit(2), "{H:2}h {M:02}m", "hours")) == " 2h 00m"
    assert one(spark, S.human_size(lit(1536.0))) == "1.5 KB" and one(spark, S.human_size(lit(3.0 * 1024**4))) == "3072.0 GB"
    assert one(spark, S.rgba_to_int(lit(255), lit(0), lit(0))) == -16776961
    assert one(spark, S.stem(lit("smb://host/share/pos1.ome.tif?x=/a.b"))) == "pos1.ome" and one(spark, S.stem(lit("/a/.hidden"))) == ".hidden"
    text = one(spark, S.polygon_text(F.array(F.struct(lit(1.5).alias("x"), lit(2.0).alias("y")))))
    assert text == "1.5,2.0" and one(spark, S.polygon_from_text(lit("1.5,2.0 3,4")))[1].y == 4
    assert one(spark, S.angle_diff(lit(-85.0), lit(85.0))) == 10 and one(spark, S.wrap_angle(lit(170.0))) == -10
    assert one(spark, S.parabolic_refine(lit(0.0), lit(2.0), lit(1.0))) == pytest.approx(1 / 6)
    assert one(spark, S.parabolic_refine(lit(float("nan")), lit(2.0), lit(1.0))) == 0
    assert one(spark, S.utc_text(lit(1710326747.8))) == "2024-03-13T10:45:47+00:00"
    assert one(spark, S.channel_color(lit("Red"))) == [255, 0, 0] and one(spark, S.channel_color(lit("#0a0B0c"))) == [10, 11, 12]
    assert one(spark, S.execution_name(lit(5), "int")) == "execution_5"
    with pytest.raises(ValueError):
        S.execution_name(lit(True), "boolean")


def test_natural_order_and_keys(spark):
    names = ["/d/T10.tif", "/d/t2.tif", "/d/t02.TIF", "/d/a/t1.tiff", "/d/.t0.tif", "/d/t3.png"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kept = df.filter(S.is_frame_file(F.col("path"))).orderBy(S.natural_key(F.col("path")))
    assert [r.path for r in kept.collect()] == ["/d/a/t1.tiff", "/d/t02.TIF", "/d/t2.tif", "/d/T10.tif"]
    assert df.filter(S.is_frame_file(F.col("path"), "t?.tif")).count() == 1
    p = spark.createDataFrame([("pos001_roi002x",), ("other",)], "population_id string")
    got = S.parsed_keys(p, "population_id", r"pos(?P<position>\d+)_roi(?P<roi>\d+)").collect()
    assert [(r.position, r.roi) for r in got] == [(1, 2), (None, None)]
    with pytest.raises(ValueError):
        S.parsed_keys(p, "population_id", r"pos\d+")


# ---------------------------------------------------------------- registration


def t(dx, dy, theta, c=None):
    return F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(theta).alias("theta"), F.lit(c).cast("double").alias("confidence"))


def test_compose_and_invert(spark):
    r = one(spark, registration.compose(t(1.0, 0.0, 30.0, 0.5), t(2.0, 3.0, 90.0, 0.9)))
    assert (r.dx, r.dy, r.theta, r.confidence) == (pytest.approx(2), pytest.approx(2), 120, 0.5)
    assert one(spark, registration.compose(t(1.0, 0.0, 0.0), t(0.0, 0.0, 0.0, 1.0))).confidence is None
    # counter-clockwise where y points down: by hand from [[cos, sin], [-sin, cos]]
    r = one(spark, registration.compose(t(3.0, 0.0, 0.0), t(0.0, 0.0, 90.0)))
    assert (r.dx, r.dy) == (pytest.approx(0), pytest.approx(-3))
    assert registration.compose_values((3.0, 0.0, 0.0, None), (0.0, 0.0, 90.0, None))[:2] == (pytest.approx(0), pytest.approx(-3))
    s = one(spark, registration.correct_spec(F.lit(110.0), F.lit(100.0), F.lit(0.0), t(0.0, 0.0, 90.0), 200.0, 200.0))
    assert (s.center_x, s.center_y, s.angle) == (pytest.approx(100), pytest.approx(110), 90)
    c, w = math.cos(math.radians(30)), math.sin(math.radians(30))
    s = one(spark, registration.decompose(*(F.lit(x) for x in (c, w, 0.0, -w, c, 0.0)), 0.0, 0.0))
    assert s.theta == pytest.approx(30)
    back = one(spark, registration.compose(t(1.0, 2.0, 30.0), registration.invert(t(1.0, 2.0, 30.0))))
    assert (back.dx, back.dy, back.theta) == (pytest.approx(0), pytest.approx(0), 0)
    s = one(spark, registration.correct_spec(F.lit(10.0), F.lit(20.0), F.lit(5.0), t(3.0, -4.0, 0.0), 100.0, 100.0))
    assert (s.center_x, s.center_y, s.angle) == (7, 24, 5)
    same = one(spark, registration.correct_spec(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.when(F.lit(False), t(1.0, 1.0, 1.0)), 10.0, 10.0))
    assert (same.center_x, same.center_y, same.angle) == (1, 2, 3)


def greedy(lines, angle, rho):
    """(line, angle, rho, length) kept, the longest first, each compared with kept ones only."""
    kept = []
    for x in sorted(lines, key=lambda x: (-x[3], x[0])):
        if not any(abs((x[1] - k[1] + 90) % 180 - 90) < angle and abs(x[2] - k[2]) < rho for k in kept):
            kept.append(x)
    return {x[0] for x in kept}


def test_dedupe_lines(spark):
    import random

    rng = random.Random(2)
    frames = {0: [(0, 0.0, 0.0, 30.0), (1, 0.0, 5.0, 20.0), (2, 0.0, 10.0, 10.0)]}
    frames |= {f: [(i, rng.uniform(-90, 90), rng.uniform(0, 40), float(rng.randrange(9))) for i in range(40)] for f in range(1, 6)}
    rows = [(f, *x) for f, lines in frames.items() for x in lines]
    df = spark.createDataFrame(rows, "frame int, line int, angle double, rho double, length double")
    got = {(r.frame, r.line) for r in registration.dedupe_lines(df, 20.0, 6.0).collect()}
    assert got == {(f, i) for f, lines in frames.items() for i in greedy(lines, 20.0, 6.0)} and {(0, 0), (0, 2)} <= got
    # nearest of all reference lines, across the ends of the half circle too
    ref = spark.createDataFrame([(0, -89.0, 3.0), (1, 20.0, 7.0)], "ref int, ref_angle double, ref_rho double")
    one_line = spark.createDataFrame([(0, 5, 89.5, 3.5), (0, 6, 30.0, 7.0)], "frame int, line int, angle double, rho double")
    assert [(r.line, r.ref) for r in registration.match_lines(one_line, ref).collect()] == [(5, 0)]


def matched(lines, refs, most):
    """Of (frame, line, angle, rho) and (ref, angle, rho), by all pairs; a missing distance is the farthest."""
    far = lambda d: (d is None, d or 0.0)
    met, best = {}, {}
    for f, i, a, rho in lines:
        for r, b, at in refs:
            if abs((a - b + 90) - math.floor((a - b + 90) / 180) * 180 - 90) <= most:
                met.setdefault((f, i), []).append((far(None if None in (rho, at) else abs(rho - at)), r))
    for (f, i), some in met.items():
        some.sort()
        (void, d), r = some[0]
        if len(some) == 1 or some[1][0][0] or void or some[1][0][1] > 2.05 * max(d, 1):
            best.setdefault((f, r), []).append(((void, d), i))
    return {(f, min(some)[1], r, None if min(some)[0][0] else min(some)[0][1]) for (f, r), some in best.items()}


@pytest.mark.parametrize("most", [0.3, 5.0, 40.0, 89.0, 95.0])
@pytest.mark.parametrize("steps", [7, 10**6])
def test_match_lines(spark, most, steps):
    """Against all pairs, with few and many angles, angles of any turn, repeated offsets and missing ones."""
    rng = random.Random(steps)
    turn = lambda: rng.randrange(-steps, 2 * steps) * 180.0 / steps
    scale = 4000 / most**0.5
    refs = [(j, turn(), round(rng.uniform(0, scale))) for j in range(150)] + [(200 + j, turn(), 9.0 * scale) for j in range(20)]
    refs += [(300, 12.0, None), (301, 100.0, None)]
    lines = [(f, i, turn(), rng.uniform(0, scale) if i % 3 else float(round(rng.uniform(0, scale)))) for f in range(3) for i in range(120)]
    lines += [(0, 500, 12.1, None), (1, 501, 12.1, 5.0), (2, 502, None, 5.0), (2, 1, refs[3][1], refs[3][2] + 0.25)]
    df = spark.createDataFrame([(f, i, a, r) for f, i, a, r in lines], "frame int, line int, angle double, rho double")
    ref = spark.createDataFrame([(j, a, None if r is None else float(r)) for j, a, r in refs], "ref int, ref_angle double, ref_rho double")
    want = matched([x for x in lines if x[2] is not None], refs, most)
    got = {(r.frame, r.line, r.ref, r.distance) for r in registration.match_lines(df, ref, most).collect()}
    assert got == want and len(want) > 10


def test_match_lines_does_not_pair_all(spark):
    """Many lines and references of one angle: no step holds a row for each pair."""
    lines = spark.range(20000).selectExpr("0 as frame", "id as line", "0.0D as angle", "id * 10.0D as rho")
    ref = spark.range(20000).selectExpr("id as ref", "0.0D as ref_angle", "id * 10.0D + 1 as ref_rho")
    began = time.monotonic()
    assert registration.match_lines(lines, ref).filter("line = ref and distance = 1").count() == 20000
    assert time.monotonic() - began < 60


def test_lineage_layout_of_an_incomplete_tree(spark):
    """Against a walk of the tree, leaves numbered in depth-first order."""
    n = 40
    kids = {p: [c for c in (2 * p + 1, 2 * p + 2) if c < n] for p in range(n)}
    want, count = {}, 0

    def walk(p):
        nonlocal count
        if kids[p]:
            want[p] = sum(walk(c) for c in kids[p]) / len(kids[p])
        else:
            want[p], count = float(count), count + 1
        return want[p]

    walk(0)
    nodes = spark.createDataFrame([(p, (p + 1).bit_length()) for p in range(n)], "label bigint, start_frame int")
    edges = spark.createDataFrame([(p, c) for p in kids for c in kids[p]], "src bigint, dst bigint")
    got = {r.label: r.y for r in tracking.lineage_y(nodes, edges).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_nearest_and_missing(spark):
    stored = spark.createDataFrame([(2, 2.0), (6, 6.0)], "frame int, transform double")
    frames = spark.range(9).select(F.col("id").cast("int").alias("frame"))
    got = {r.frame: r.source_frame for r in registration.registered(frames, stored, "nearest").collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 6, 6: 6, 7: 6, 8: 6}
    assert registration.registered(frames, stored).filter("transform is null").count() == 7
    with pytest.raises(PySparkException, match="no transform for frame"):
        registration.registered(frames, stored, "error").collect()
    assert registration.sample_frames(10, 0, 4) == [3, 6, 9] and registration.sample_frames(1, 0, 4) == [0]


def test_nearest_of_many_ranges(spark):
    """Against brute force: ranges without a stored frame, groups without one, repeated and NULL frames."""
    rng = random.Random(3)
    frames = [(g, rng.randrange(3000)) for g in (0, 1, None) for _ in range(900)] + [(0, None), (2, 5)]
    stored = [(g, at) for g in (0, 1, None) for at in rng.sample([*range(200, 230), *range(2500, 2900, 7)], 40)] + [(0, None)]
    df = spark.createDataFrame(frames, "source int, frame int")
    side = spark.createDataFrame([(g, at, {"at": at}) for g, at in stored], "source int, frame int, transform map<string,int>")
    want = [(g, f, min((at for h, at in stored if h == g and None not in (at, f)), key=lambda at: (abs(at - f), at), default=None)) for g, f in frames]
    out = registration.nearest_transform(df, side, ("source",))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.source, r.frame, r.source_frame) for r in out.collect()) == order(want)
    assert all(r.transform == {"at": r.source_frame} for r in out.filter("source_frame is not null").collect())
    # each window frame only grows, and none holds all rows
    one = registration.nearest_transform(df.select("frame"), side.drop("source"))
    plan = one._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "[_part" in plan
    alone = [at for _, at in stored if at is not None]
    got = {r.frame: r.source_frame for r in one.collect()}
    assert got == {f: f if f is None else min(alone, key=lambda at: (abs(at - f), at)) for _, f in frames}
    assert registration.nearest_transform(df.select("frame"), side.drop("source").filter("false")).filter("source_frame is null").count() == len(frames)


def test_chain(spark):
    rows = [(1, (1.0, 0.0, 90.0, 0.9)), (2, (1.0, 0.0, 90.0, 0.5)), (3, (1.0, 0.0, 0.0, None))]
    df = spark.createDataFrame(rows, "frame int, transform struct<dx:double,dy:double,theta:double,confidence:double>")
    got = {r.frame: r.transform for r in registration.chain(df).collect()}
    assert (got[2].dx, got[2].dy, got[2].theta, got[2].confidence) == (pytest.approx(1), pytest.approx(-1), 180, 0.5)
    assert got[3].confidence is None


def test_estimates_recover_a_shift(spark):
    from celltide.sources import sequences

    rng = np.random.default_rng(3)
    big = rng.random((80, 80))
    for _ in range(3):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, (1, 1), (0, 1))) / 4
    stack = np.stack([big[10:74, 10:74], big[7:71, 12:76]])
    frames = sequences.frames_of_arrays(spark, stack)
    for method in (registration.PhaseCorrelation(), registration.TemplateCorrelation((20, 20, 44, 44), 6)):
        got = registration.estimate_transforms(frames, method).filter("frame = 1").first().transform
        assert (got.dx, got.dy) == (pytest.approx(-2, abs=0.3), pytest.approx(3, abs=0.3))
    with pytest.raises(registration.RegistrationError):
        registration.PhaseCorrelation().estimate(np.ones((8, 8)), np.ones((8, 8)))


def test_merge_inconsistent(spark):
    t = spark.createDataFrame([(1, 0, 2), (2, 3, 4), (3, 3, 8), (4, 9, 12), (5, 9, 12)], "label bigint, start_frame int, end_frame int")
    e = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (3, 5)], "parent bigint, child bigint")
    assert [tuple(r) for r in tracking.inconsistent_divisions(t, e).collect()] == [(1, 2, 3)]
    assert tracking.inconsistent_divisions(t, e, 0).isEmpty()
    rows = [(10, 3, 2, None, square(0.5, 0.5, 4.0)), (11, 3, 3, None, square(5.5, 0.5, 4.0)), (12, 4, 3, None, square(0, 0)), (13, 0, 1, None, square(9, 9))]
    d, kept, edges = tracking.merge_inconsistent(model.detections(spark, rows), t, e)
    got = {r.id: r for r in d.collect()}
    assert set(got) == {10, 12, 13} and got[10].label == 3
    assert abs(G.shoelace(G.points(got[10].coords))) == 4 * 9
    assert {r.label for r in kept.collect()} == {1, 3, 4, 5} and {tuple(r) for r in edges.collect()} == {(1, 3), (3, 4), (3, 5)}


def test_register_sequence_and_compare(spark):
    from celltide.sources import sequences

    rng = np.random.default_rng(3)
    big = rng.random((90, 90))
    for _ in range(3):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, (1, 1), (0, 1))) / 4
    stack = np.stack([big[10 - f : 74 - f, 10 + f : 74 + f] if f != 2 else np.ones((64, 64)) for f in range(5)])
    frames = sequences.frames_of_arrays(spark, stack)
    for mode in ("fixed", "reanchor", "chained"):
        got = {r.frame: r for r in registration.register_sequence(frames, registration.PhaseCorrelation(), mode).collect()}
        assert got[2].transform is None and got[0].transform.dx == 0
        assert (got[4].transform.dx, got[4].transform.dy) == (pytest.approx(-4, abs=0.5), pytest.approx(4, abs=0.5))
        assert got[4].anchor == (3 if mode == "chained" else 0)
    with pytest.raises(ValueError):
        registration.register_sequence(frames, registration.PhaseCorrelation(), "other")
    grid = registration.compare(frames, {"phase": registration.PhaseCorrelation(), "template": registration.TemplateCorrelation((20, 20, 44, 44), 6, 0.5, "reject")})
    assert grid.count() == 10 and grid.filter("frame = 2 and transform is null").count() == 2
    assert [p.shape for p in registration.pyramid(np.ones((64, 40)), 5)] == [(64, 40), (32, 20)]
    m = registration.rect_mask((6, 6), [(0, 0, 4, 4)], 1)
    assert m.sum() == 36 - 4


def test_growth_of_detections(spark):
    rows, k = [], 0
    for frame in range(4):
        for _ in range(2**frame):
            rows.append((k, frame, 1, None, square(0, 0, 10.0)))
            k += 1
    t0 = model.resolve_timepoints(spark, 4, frame_interval=30.0, unit="minute")
    r = stats.extract_growth(model.detections(spark, rows), P.Context(timepoints=t0)).first()
    assert r.doubling_time == pytest.approx(0.5) and r.initial_value == pytest.approx(100)
