"""Formats, sequences, provenance and streaming."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide import model
from celltide.operators import provenance, tracking
from celltide.sources import formats, sequences
from celltide.streaming import frames as streaming


def square(x, y, n=2.0):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


def documents(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "value string")


def test_segmentation_round_trip(spark):
    doc = [{"frame": 1, "detections": [{"label": "cell", "contour": [[0, 0], [2, 0], [2, 2]], "id": "7"}]}, {"frame": 3, "detections": []}]
    d = formats.parse_segmentation(documents(spark, doc))
    assert [(r.id, r.frame, r.label, r.score, len(r.coords)) for r in d.collect()] == [("7", 1, "cell", -1.0, 3)]
    back = formats.parse_segmentation(formats.segmentation_json(d))
    assert back.collect() == d.collect()


def test_tracking_round_trip(spark):
    doc = {
        "segmentation": [{"label": "a", "contour": [[0, 0], [1, 0], [1, 1]], "id": "1", "frame": 0}, {"label": "a", "contour": [[0, 0], [1, 0], [1, 1]], "id": 2, "frame": 1}],
        "tracking": [{"sourceId": "1", "targetId": 2}, {"sourceId": "2", "targetId": "99"}],
    }
    d, e = formats.parse_tracking(documents(spark, doc))
    assert sorted(r.id for r in d.collect()) == [1, 2] and [tuple(r) for r in e.collect()] == [(1, 2)]
    d2, e2 = formats.parse_tracking(formats.tracking_json(d, e))
    assert sorted(map(str, d2.collect())) == sorted(map(str, d.collect())) and e2.collect() == e.collect()


def test_tracklet_text(spark, tmp_path):
    path = str(tmp_path / "man_track.txt")
    with open(path, "w") as f:
        f.write("1 0 4 0\n2 5 9 1\n3 5 7 1\n")
    t, e = tracking.tracklets_of_text(formats.read_tracklets(spark, path))
    assert t.count() == 3 and {tuple(r) for r in e.collect()} == {(1, 2), (1, 3)}
    assert [r.value for r in formats.tracklet_lines(t, e).collect()] == ["1 0 4 0", "2 5 9 1", "3 5 7 1"]
    d = model.detections(spark, [(1, 7, 1, None, square(0, 0))])
    with pytest.raises(ValueError):
        formats.require_frames(d, 7)
    assert formats.require_frames(d, 8) is d


def test_archives(spark, tmp_path):
    d = model.detections(spark, [(i, i % 3, 1, None, square(i, 0)) for i in range(6)])
    formats.save_archive(d, str(tmp_path / "a"))
    assert sorted(map(str, formats.load_archive(spark, str(tmp_path / "a")).collect())) == sorted(map(str, d.collect()))
    np.savez(tmp_path / "s.npz", coords=np.arange(14, dtype=np.float32).reshape(7, 2), offsets=np.array([0, 3, 7]), ids=np.array([5, 6]), labels=np.array(["x", "y"]), frames=np.array([0, 2]))
    got = formats.flat_archive(spark, str(tmp_path / "s.npz")).orderBy("id").collect()
    assert [(r.id, r.frame, r.label, len(r.coords)) for r in got] == [("5", 0, "x", 3), ("6", 2, "y", 4)] and got[1].coords[0].x == 6


def test_selection_and_transform_documents(spark):
    s = spark.createDataFrame(
        [(0, [5.0, 6.0], [10, 20], 30.0, "a", "roi1", None, 0), (1, [1.0, 2.0], [3, 4], 0.0, "b", "roi2", "n", 7)],
        "position int, center array<double>, size array<int>, angle double, label string, id string, notes string, anchor_frame int",
    )
    text = formats.selections_json(s, "x.nd2")
    assert "anchor_frame" not in json.loads(text.first().value)["selections"][0]
    assert sorted(map(str, formats.load_selections(text).collect())) == sorted(map(str, s.collect()))
    t = spark.createDataFrame([(0, 1, (1.0, 2.0, 3.0, None)), (0, 2, (4.0, 5.0, 6.0, 0.5)), (3, 0, (0.0, 0.0, 0.0, 1.0))], "position int, frame int, transform struct<dx:double,dy:double,theta:double,confidence:double>")
    doc = formats.transforms_json(t, "phase", "x.nd2")
    assert [r["position"] for r in json.loads(doc.first().value)["records"]] == [0, 3]
    assert sorted(map(str, formats.load_transforms(doc).collect())) == sorted(map(str, t.collect()))
    bare = documents(spark, {"records": [{"position": 0, "transforms": {"4": {"dx": 1, "dy": 2}}}]})
    assert formats.load_transforms(bare).first().transform.theta == 0


def test_folder_sequences(spark, tmp_path):
    for n in ("t10.tif", "t2.tif", "notes.txt", ".t1.tif"):
        (tmp_path / n).write_bytes(b"x")
    got = sequences.open_sequence(spark, str(tmp_path)).orderBy("frame").collect()
    assert [os.path.basename(r.path) for r in got] == ["t2.tif", "t10.tif"] and got[0].frame == 0
    files = sequences.listing(spark, str(tmp_path))
    assert sequences.layout(files, str(tmp_path)) == "flat"
    with pytest.raises(ValueError):
        sequences.layout(files.filter("path like '%txt'"), str(tmp_path))
    with pytest.raises(ValueError):
        sequences.open_sequence(spark, "a.xyz")
    with pytest.raises(NotImplementedError):
        sequences.open_sequence(spark, "a.nd2")
    sequences.register_reader(".mem", lambda s, p: sequences.frames_of_arrays(s, np.zeros((2, 3, 4)), p))
    assert sequences.open_sequence(spark, "a.MEM").count() == 2
    with pytest.raises(ValueError):
        sequences.open_sequence(spark, "a.mem", pattern="*")
    assert provenance.next_index(spark.createDataFrame([("/a/0007.png",), ("/a/x.png",)], "path string")) == 8


def test_masks_to_polygons_and_back(spark):
    d = model.detections(spark, [(1, 0, 4, None, square(0.5, 0.5, 5.0)), (2, 0, 9, None, square(3.5, 3.5, 4.0))])
    rows = sequences.mask_rows(d, 12, 12)
    assert {(r["label"], r["count"]) for r in rows.groupBy("label").count().collect()} == {(4, 25), (9, 16)}
    from celltide.operators import properties as P

    merged = P.label_pixels(rows)
    got = {r.label: r for r in sequences.polygons_of_masks(merged).collect()}
    assert len(got[9].coords) == 4 and len(got[4].coords) == 6 and got[4].fragments == 1


def test_segment_and_track(spark):
    stack = np.zeros((3, 12, 12))
    for f in range(3):
        stack[f, 1:4, 1 + f : 4 + f] = 1
        stack[f, 8:10, 8:11] = 1
    frames = sequences.frames_of_arrays(spark, stack)
    masks = sequences.ThresholdSegmenter(0.5, 2)(frames)
    links = {(r.frame, r.label): (r.parent_label, r.overlap) for r in sequences.OverlapTracker()(masks).collect()}
    assert links == {(1, 1): (1, 6), (1, 2): (2, 6), (2, 1): (1, 6), (2, 2): (2, 6)}


def test_colonies(spark):
    rows, k = [], 0
    for frame, n in ((0, 1), (1, 2), (2, 3)):
        for j in range(n):
            rows.append((k, frame, 1, None, square(5.5 + 11 * j, 5.5, 10.0)))
            k += 1
    got = sequences.merge_colonies(model.detections(spark, rows), 30, 60, 3).collect()
    areas = {f: sum(r.area for r in got if r.frame == f) for f in range(3)}
    assert areas == {0: 100, 1: 210, 2: 320} and len({r.id for r in got}) == 3


def test_rotated_crop(spark):
    img = np.arange(100, dtype=float).reshape(10, 10)
    frames = sequences.frames_of_arrays(spark, img[None])
    r = sequences.rotated_crop(frames, (4.0, 5.0), (3, 3), 0.0).first()
    assert (np.frombuffer(r.pixels, np.float32).reshape(3, 3) == img[4:7, 3:6]).all()
    r = sequences.rotated_crop(frames, (4.0, 5.0), (3, 3), 90.0).first()
    turned = [[img[4 + x, 5 - y] for x in range(3)] for y in range(3)]
    assert np.allclose(np.frombuffer(r.pixels, np.float32).reshape(3, 3), turned, atol=1e-3)
    with pytest.raises(ValueError):
        sequences.rotated_crop(frames, (1, 1), (True, 3), 0)


def test_provenance(spark, tmp_path):
    for pop in ("pos001_roi001", "pos002_roi001"):
        out = str(tmp_path / pop / "output")
        seg = provenance.StageContext(out, "Segment", pop)
        os.makedirs(out, exist_ok=True)
        with open(seg.output_path("segmentation.npz"), "wb") as f:
            f.write(b"12345")
        seg.log_params(model="x", area=3)
        seg.log_metrics(cells=12)
        seg.finish()
        track = provenance.StageContext(out, "Track", pop)
        track.input_path("segmentation.npz")
        with open(track.output_path("tracks.txt"), "w") as f:
            f.write("1 0 0 0")
        track.finish("failed" if pop.startswith("pos002") else "ok")
    with open(tmp_path / "pos001_roi001" / "output" / "segmentation.npz", "wb") as f:
        f.write(b"123456789")
    stages = provenance.read_manifests(spark, str(tmp_path))
    assert stages.count() == 4
    io = provenance.run_io(stages)
    assert {tuple(r) for r in provenance.stage_edges(io).select("upstream", "artifact", "downstream").collect()} == {("Segment", "segmentation.npz", "Track")}
    assert provenance.producer_mismatches(io).isEmpty()
    files = provenance.fingerprints(spark, str(tmp_path)).withColumn("population_id", F.regexp_extract("path", "/(pos[^/]*)/", 1))
    now = files.withColumn("path", F.regexp_replace("path", "^.*/output/", "")).filter("path <> ''")
    old = provenance.stale(io, now)
    assert [(r.population_id, r.stage) for r in old.collect()] == [("pos001_roi001", "Track")]
    table = provenance.stage_table(stages, r"pos(?P<position>\d+)_roi(?P<roi>\d+)", old)
    rows = {(r.population_id, r.stage): r for r in table.collect()}
    assert len(rows) == 4 and rows["pos002_roi001", "Track"].position == 2 and rows["pos002_roi001", "Track"].status == "failed"
    assert rows["pos001_roi001", "Track"].stale and not rows["pos001_roi001", "Segment"].stale
    assert (rows["pos001_roi001", "Track"].n_inputs, rows["pos001_roi001", "Track"].n_outputs) == (1, 1)
    flat = provenance.flattened(table, "params", "metrics", "extra")
    assert flat.filter("stage = 'Segment'").first().model == "x" and flat.filter("stage = 'Segment'").first().cells == 12
    events = [json.loads(r.value) for r in provenance.openlineage(stages).collect()]
    assert sorted(e["eventType"] for e in events) == ["COMPLETE"] * 3 + ["FAIL"]
    provenance.StageContext(str(tmp_path / "pos001_roi001" / "output"), "x").clear("Track")
    assert not os.path.exists(tmp_path / "pos001_roi001" / "output" / "tracks.txt")


def test_scale(tmp_path):
    def run(source, folder):
        if source == 2:
            raise RuntimeError("broken")
        return source * 10

    done = provenance.scale([1, 2, 3], run, str(tmp_path))
    assert done["results"] == {"execution_1": 10, "execution_3": 30} and list(done["errors"]) == ["execution_2"]
    with pytest.raises(ValueError):
        provenance.scale([True], run, str(tmp_path))
    with pytest.raises(ValueError):
        provenance.scale(["/a/x.tif", "/b/x.tif"], run, str(tmp_path))


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", float(m), "a" if m % 2 else "b") for m in range(40)] + [("2024-01-01 00:10:00", float("nan"), "a")]
    df = spark.createDataFrame(rows, "ts string, area double, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streaming.per_window(stream, by=("kind",)).writeStream.outputMode("complete").format("memory").queryName("celltide_windows").start()
    try:
        query.processAllAvailable()
        got = spark.table("celltide_windows").collect()
    finally:
        query.stop()
    assert sorted(map(str, got)) == sorted(map(str, streaming.per_window(df, by=("kind",)).collect()))


def test_headers(spark):
    from celltide.sources import catalog

    xml = "<OME xmlns='x'><Image><Pixels PhysicalSizeX='70' PhysicalSizeXUnit='nm' TimeIncrement='2' TimeIncrementUnit='min'/></Image></OME>"
    rows = [(xml, "", 0, 1), (None, "ImageJ=1\nunit=micron\nfinterval=900.0\n", 20, 1), (None, "other", 1, 1), ("<OME/>", "", 0, 0)]
    df = spark.createDataFrame(rows, "x string, d string, n int, m int")
    got = [tuple(r.c) for r in df.select(catalog.calibration(F.col("x"), F.col("d"), F.col("n"), F.col("m")).alias("c")).collect()]
    assert got == [(pytest.approx(0.07), 120.0, "ome"), (pytest.approx(0.05), 900.0, "imagej"), (None, None, None), (None, None, "ome")]


def test_views(spark, tmp_path):
    from celltide.views import RotatedCropSpec, SequenceView

    frames = sequences.frames_of_arrays(spark, np.arange(5 * 6 * 6).reshape(5, 6, 6).astype(float))
    v = SequenceView(frames, 5, 0.1).with_frame_interval("15 minute")
    s = v[::2]
    assert len(s) == 3 and [r.t for r in s.time_model().orderBy("frame").collect()] == [0, 30, 60]
    assert sorted(r.frame for r in s.frames.collect()) == [0, 1, 2]
    assert len(v[-1]) == 1 and len(v[[4, 0]]) == 2 and [r.t for r in v[[4, 0]].time_model().orderBy("frame").collect()] == [60, 0]
    with pytest.raises(IndexError):
        v[5]
    t = v.with_timepoints([0, 1, 4, 9, 16])
    assert [r.t for r in t[1:3].time_model().orderBy("frame").collect()] == [1, 4] and SequenceView(frames, 5).time_model() is None
    assert v.crop(RotatedCropSpec((3.0, 3.0), (2, 2))).frames.first().h == 2
    assert v.materialize(str(tmp_path / "m")).frames.count() == 5
    with pytest.raises(ValueError):
        RotatedCropSpec((0, 0), (0, 1))
    px = SequenceView(sequences.channel_pixels(frames), 5, 0.1).strided(2, 3)
    assert px.pixel_size == (0.2, pytest.approx(0.3)) and px.frames.filter("frame = 0").count() == 6


def test_loading_by_name_and_crops(spark, tmp_path):
    import gzip

    doc = [{"frame": 1, "detections": [{"label": "cell", "contour": [[0, 0], [2, 0], [2, 2]], "id": "7"}]}]
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        json.dump(doc, f)
    times = model.resolve_timepoints(spark, 3, frame_interval=5.0)
    got = formats.load_segmentation(spark, str(tmp_path / "s.json.gz"), 3, times).first()
    assert (got.id, got.time) == ("7", 5.0)
    with pytest.raises(ValueError):
        formats.load_segmentation(spark, str(tmp_path / "s.json.gz"), 1)
    spec = documents(spark, {"center": [1, 2], "size": [3, 4], "angle": 5, "frame": 0})
    back = formats.load_crop_specs(formats.crop_spec_json(formats.load_crop_specs(spec))).first()
    assert (back.center, back.size, back.angle, back.channel) == ([1.0, 2.0], [3, 4], 5.0, None)


def test_pixels(spark):
    px = spark.createDataFrame([(0, 0, 0, 0.0, 5.0), (0, 0, 1, 10.0, 5.0), (0, 1, 0, 5.0, 9.0), (1, 0, 0, 3.0, 3.0)], "frame int, y int, x int, a double, b double")
    got = {(r.frame, r.y, r.x): (r.r, r.g, r.b) for r in sequences.rgb_composite(px, {"a": (255, 0, 0), "b": (255, 255, 0)}).collect()}
    assert got == {(0, 0, 0): (0, 0, 0), (0, 0, 1): (255, 0, 0), (0, 1, 0): (255, 255, 0), (1, 0, 0): (0, 0, 0)}
    assert sorted(r.byte for r in sequences.stretched(px, "a").collect()) == [0, 0, 128, 255]
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="finite"):
        sequences.stretched(px.withColumn("a", F.lit(float("nan"))), "a").collect()
    d = model.detections(spark, [(1, 0, 1, None, square(0, 0)), (2, 0, 1, None, square(0, 0))])
    colors = spark.createDataFrame([(1, 9, 8, 7)], "id bigint, r int, g int, b int")
    assert {r.id: tuple(r.color) for r in sequences.cell_colors(d, colors).collect()} == {1: (9, 8, 7), 2: (128, 128, 128)}
