"""Tracking and lineage graphs as node and edge relations.

Detection graph: nodes (id, frame, ...), edges (src, dst). Tracklet graph: nodes (label,
start_frame, end_frame), edges (parent, child). Iterative operators join edge relations until
nothing changes, writing each round where `rounds` grow long; no graph is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_ROUNDS = 64


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterated relation through a checkpoint that all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="celltide-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint()


# ---------------------------------------------------------------- building graphs


def link_sequential(df: DataFrame, key: str = "label", order: Sequence[str] = ("frame", "id"), node: str = "id") -> DataFrame:
    """src, dst: each detection of a tracklet to the next in time."""
    nxt = F.lead(node).over(W.partitionBy(key).orderBy(*order))
    return df.select(F.col(node).alias("src"), nxt.alias("dst")).filter("dst is not null")


def track_edges(detections: DataFrame, tracklet_edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Edges of the detection graph: along each tracklet, and from a parent's last to its child's first detection.

    With `only` (label), detections of other labels take no part.
    """
    d = detections if only is None else detections.join(only.select("label"), "label", "left_semi")
    order = W.partitionBy("label").orderBy("frame", "id")
    ends = d.groupBy("label").agg(
        F.min(F.struct("frame", "id")).getField("id").alias("first"), F.max(F.struct("frame", "id")).getField("id").alias("last")
    )
    along = d.select(F.col("id").alias("src"), F.lead("id").over(order).alias("dst")).filter("dst is not null")
    across = (
        tracklet_edges.join(ends.select(F.col("label").alias("parent"), "last"), "parent")
        .join(ends.select(F.col("label").alias("child"), "first"), "child")
        .select(F.col("last").alias("src"), F.col("first").alias("dst"))
    )
    return along.union(across).distinct()


def tracklets(df: DataFrame, key: str, frame: str, gap: int = 1) -> DataFrame:
    """key, part, start_frame, end_frame: runs of frames without a gap above `gap`."""
    order = W.partitionBy(key).orderBy(frame)
    new = F.when(F.col(frame) - F.lag(frame).over(order) <= gap, 0).otherwise(1)
    marked = df.select(key, frame).distinct().withColumn("_new", new)
    parts = marked.withColumn("part", F.sum("_new").over(order))
    return parts.groupBy(key, "part").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"))


def tracklets_of_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracklet nodes and edges of (label, start_frame, end_frame, parent) rows; parent 0 is none."""
    return lines.select("label", "start_frame", "end_frame"), lines.filter("parent <> 0").select("parent", F.col("label").alias("child"))


def expand_tracklets(t: DataFrame, edges: DataFrame | None = None, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Nodes (label, frame) of every frame a tracklet spans, and edges frame to frame and parent's last to child's first."""
    nodes = t.select(label, F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    along = t.filter("end_frame > start_frame").select(
        F.col(label).alias("src_label"),
        F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("src_frame"),
    )
    along = along.select("src_label", "src_frame", F.col("src_label").alias("dst_label"), (F.col("src_frame") + 1).alias("dst_frame"))
    if edges is None:
        return nodes, along
    across = edges.join(t.select(F.col(label).alias("parent"), F.col("end_frame").alias("src_frame")), "parent").join(
        t.select(F.col(label).alias("child"), F.col("start_frame").alias("dst_frame")), "child"
    )
    return nodes, along.union(across.select(F.col("parent"), "src_frame", F.col("child"), "dst_frame"))


def annotate_times(t: DataFrame, timepoints: DataFrame | None) -> DataFrame:
    """start_time and end_time of tracklets; without a time model nothing changes."""
    if timepoints is None:
        return t
    for end in ("start", "end"):
        side = timepoints.select(F.col("frame").alias(f"{end}_frame"), F.col("t").alias(f"{end}_time"))
        t = t.join(side, f"{end}_frame", "left")
    return t


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of two graphs, nodes and edges as sets."""
    return a[0].unionByName(b[0]).distinct(), a[1].unionByName(b[1]).distinct()


def restrict(detections: DataFrame, nodes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Detections and nodes that both sides know."""
    return detections.join(nodes.select(key), key, "left_semi"), nodes.join(detections.select(key), key, "left_semi")


# ---------------------------------------------------------------- degrees, divisions, life cycles


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """node, in_degree, out_degree of every node."""
    ends = edges.select(F.col(src).alias(node), F.lit(0).alias("i"), F.lit(1).alias("o")).union(
        edges.select(F.col(dst).alias(node), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    ends = ends.unionByName(nodes.select(node, F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy(node).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def clean_divisions(t: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """Tracklets with one mother and two daughters, with the daughter of least (start_frame, label)."""
    d = degrees(t, edges, label, "parent", "child").filter("in_degree = 1 and out_degree = 2")
    child = edges.join(t.select(F.col(label).alias("child"), F.col("start_frame").alias("child_start")), "child")
    first = child.groupBy("parent").agg(F.min(F.struct("child_start", "child")).alias("c"))
    return (
        t.join(d.select(label), label)
        .join(first, F.col(label) == F.col("parent"))
        .select(t["*"], F.col("c.child").alias("child"), F.col("c.child_start").alias("child_start"))
    )


def doubling_times(t: DataFrame, edges: DataFrame, timepoints: DataFrame | None, label: str = "label", strict: bool = True) -> DataFrame:
    """tracklet, start_time, end_time, doubling_time of clean divisions, through the time model.

    A frame outside the time model and a negative duration fail the query when `strict`.
    """
    if timepoints is None:
        raise ValueError("doubling times need a time-calibrated sequence")
    d = clean_divisions(t, edges, label)
    for column, name in (("start_frame", "start_time"), ("end_frame", "end_time"), ("child_start", "child_time")):
        side = timepoints.select(F.col("frame").alias(column), F.col("t").alias(name))
        d = d.join(side, column, "left")
    value = F.col("child_time") - F.col("start_time")
    if strict:
        who = F.concat(F.lit("tracklet "), F.col(label).cast("string"))
        absent = F.col("start_time").isNull() | F.col("end_time").isNull() | F.col("child_time").isNull()
        value = (
            F.when(absent, F.raise_error(F.concat(who, F.lit(": frame out of bounds of the timepoints"))).cast("double"))
            .when(value < 0, F.raise_error(F.concat(who, F.lit(": negative doubling time"))).cast("double"))
            .otherwise(value)
        )
    return d.select(F.col(label).alias("tracklet"), "start_time", "end_time", value.alias("doubling_time"))


def chain_heads(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """id, head, step: the first node of each node's life cycle and the distance to it.

    A life cycle starts at a node without a predecessor or after a division and extends while
    there is one successor. Pointer jumping: the number of rounds is the logarithm of the longest one.
    """
    d = degrees(nodes, edges, node)
    single = d.filter("out_degree = 1").select(F.col(node).alias("src"))
    inner = edges.join(single, "src", "left_semi")
    state = nodes.select(node).join(inner.select(F.col("dst").alias(node), F.col("src").alias("head")), node, "left")
    state = state.select(node, F.coalesce("head", node).alias("head"), F.col("head").isNotNull().cast("int").alias("step"))
    for _ in range(MAX_ROUNDS):
        state = _cut(state)
        up = state.select(F.col(node).alias("head"), F.col("head").alias("up"), F.col("step").alias("more"))
        jumped = state.join(up, "head").select(node, F.col("up").alias("head"), (F.col("step") + F.col("more")).alias("step"), (F.col("more") > 0).alias("moved"))
        if jumped.filter("moved").isEmpty():
            return state
        state = jumped.drop("moved")
    raise RuntimeError("the graph has a cycle")


def life_cycles(nodes: DataFrame, edges: DataFrame, node: str = "id", frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Life cycles (cycle, start_frame, end_frame, n), cycle being the head's id, and edges (parent, child) between them."""
    heads = chain_heads(nodes, edges, node)
    cycles = (
        heads.join(nodes.select(node, frame), node)
        .groupBy(F.col("head").alias("cycle"))
        .agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("n"))
    )
    own = heads.select(F.col(node).alias("src"), F.col("head").alias("parent"))
    across = edges.join(own, "src").join(heads.select(F.col(node).alias("dst"), F.col("head").alias("child"), "step"), "dst")
    return cycles, across.filter("step = 0").select("parent", "child").distinct()


def lifecycle_lines(cycles: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, number, line: `id start end parent` text, numbered from 1 by (start_frame, cycle) within `by`; parent 0 is none, two are an error."""
    parents = edges.groupBy(F.col("child").alias("cycle")).agg(F.min("parent").alias("p"), F.count("*").alias("k"))
    message = F.concat(F.lit("several parents of life cycle "), F.col("cycle").cast("string"))
    numbered = cycles.withColumn("number", F.row_number().over(W.partitionBy(*by).orderBy("start_frame", "cycle")))
    joined = numbered.join(parents, "cycle", "left").withColumn(
        "p", F.when(F.col("k") > 1, F.raise_error(message).cast(edges.schema["parent"].dataType)).otherwise(F.col("p"))
    )
    of = numbered.select(F.col("cycle").alias("p"), F.col("number").alias("of"))
    line = F.format_string("%d %d %d %d", "number", "start_frame", "end_frame", F.coalesce("of", F.lit(0)))
    return joined.join(of, "p", "left").select(*by, "number", line.alias("line"))


# ---------------------------------------------------------------- paths


def traces(nodes: DataFrame, edges: DataFrame, node: str = "id", sep: str = ".") -> DataFrame:
    """id, trace, depth: the path from the root, joined by dots; a node with two parents is an error.

    Paths double in length each round.
    """
    bad = edges.groupBy("dst").count().filter("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"node {bad[0]['dst']} has more than one parent")
    state = nodes.select(node).join(edges.select(F.col("dst").alias(node), F.col("src").alias("up")), node, "left")
    state = state.select(node, "up", F.col(node).cast("string").alias("trace"), F.lit(1).alias("depth"))
    for _ in range(MAX_ROUNDS):
        state = _cut(state)
        if state.filter("up is not null").isEmpty():
            return state.select(node, "trace", (F.col("depth") - 1).alias("depth"))
        above = state.select(F.col(node).alias("up"), F.col("up").alias("up2"), F.col("trace").alias("head"), F.col("depth").alias("more"))
        state = state.join(above, "up", "left").select(
            node,
            F.col("up2").alias("up"),
            F.when(F.col("up").isNull(), F.col("trace")).otherwise(F.concat("head", F.lit(sep), "trace")).alias("trace"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
    raise RuntimeError("the graph has a cycle")


def segments(t: DataFrame, edges: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Points (label, frame) of every tracklet's ends, and edges within tracklets and from a parent's end to a child's start."""
    ends = t.select(label, F.explode(F.array_distinct(F.array("start_frame", "end_frame"))).alias("frame"))
    within = t.filter("end_frame > start_frame").select(
        F.col(label).alias("src"), F.col("start_frame").alias("src_frame"), F.col(label).alias("dst"), F.col("end_frame").alias("dst_frame")
    )
    across = edges.join(t.select(F.col(label).alias("parent"), F.col("end_frame").alias("src_frame")), "parent").join(
        t.select(F.col(label).alias("child"), F.col("start_frame").alias("dst_frame")), "child"
    )
    return ends, within.union(across.select("parent", "src_frame", "child", "dst_frame"))


def contract(nodes: DataFrame, edges: DataFrame, keep: Column, node: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes where `keep` holds; kept a -> b if a path joins them through dropped nodes only.

    Frontier expansion over the dropped subgraph, doubling its shortcuts each round.
    """
    kept = nodes.filter(keep).select(node)
    ends = kept.withColumn("_k", F.lit(True))
    e = edges.select("src", "dst").distinct()
    e = e.join(ends.select(F.col(node).alias("src"), F.col("_k").alias("ks")), "src", "left")
    e = e.join(ends.select(F.col(node).alias("dst"), F.col("_k").alias("kd")), "dst", "left")
    e = _cut(e.select("src", "dst", F.coalesce("ks", F.lit(False)).alias("ks"), F.coalesce("kd", F.lit(False)).alias("kd")))
    hops = e.filter("not ks")  # leave a dropped node
    done = e.filter("ks and kd").select("src", "dst")
    front = e.filter("ks and not kd").select("src", "dst")
    for _ in range(MAX_ROUNDS):
        if front.isEmpty():
            break
        step = front.join(hops.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "kd"), "dst").select("src", F.col("to").alias("dst"), "kd").distinct()
        step = _cut(step)
        done = done.union(step.filter("kd").select("src", "dst")).distinct()
        front = step.filter("not kd").select("src", "dst")
        # shortcuts over two hops
        twice = hops.filter("not kd").select("src", F.col("dst").alias("mid")).join(
            hops.select(F.col("src").alias("mid"), "dst", "kd"), "mid"
        )
        hops = _cut(twice.select("src", "dst", F.lit(False).alias("ks"), "kd").unionByName(hops.filter("kd")).distinct())
    else:
        raise RuntimeError("the graph has a cycle")
    return nodes.filter(keep), done.distinct()


def subsample_lineage(
    nodes: DataFrame, edges: DataFrame, factor: int, frame: str = "frame", node: str = "id", by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Keeps every `factor`-th of the sorted distinct frames (of each sequence `by`) and joins what lies between."""
    order = W.partitionBy(*by).orderBy(frame)
    listed = nodes.select(*by, frame).distinct().withColumn("_p", F.row_number().over(order) - 1)
    marked = nodes.join(listed.filter(F.col("_p") % factor == 0), [*by, frame], "left")
    n, e = contract(marked, edges, F.col("_p").isNotNull(), node)
    return n.select(*nodes.columns), e


def subsample_tracking(nodes: DataFrame, edges: DataFrame, factor: int, n_frames: int | None = None, frame: str = "frame", node: str = "id") -> tuple[DataFrame, DataFrame]:
    """Keeps frame *numbers* 0, k, 2k, ... below the number of frames, renumbered from 0."""
    if factor < 1:
        raise ValueError("the subsampling factor must be at least 1")
    last = F.lit(True) if n_frames is None else F.col(frame) < n_frames
    n, e = contract(nodes, edges, (F.col(frame) % factor == 0) & last, node)
    return n.withColumn(frame, (F.col(frame) / factor).cast(nodes.schema[frame].dataType)), e


def lineage_y(nodes: DataFrame, edges: DataFrame, time: str = "start_frame", node: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """node, y: leaves in depth-first order of (time, node) along the paths, inner nodes at the mean of their children.

    With `by`, each sequence has an order of its own, and no task orders more than one sequence's leaves.
    """
    keyed = nodes.select(node, F.struct(F.col(time).alias("t"), F.col(node).alias("k")).alias("key"))
    up = edges.select(F.col("dst").alias(node), F.col("src").alias("up"))
    state = keyed.join(up, node, "left").select(node, "up", F.array("key").alias("path"))
    for _ in range(MAX_ROUNDS):
        state = _cut(state)
        if state.filter("up is not null").isEmpty():
            break
        above = state.select(F.col(node).alias("up"), F.col("up").alias("up2"), F.col("path").alias("head"))
        state = state.join(above, "up", "left").select(
            node, F.col("up2").alias("up"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path")
        )
    inner = edges.select(F.col("src").alias(node)).distinct()
    leaves = state.join(inner, node, "left_anti")
    if by:
        leaves = leaves.join(nodes.select(*by, node), node)
    leaves = leaves.withColumn("y", (F.row_number().over(W.partitionBy(*by).orderBy("path")) - 1).cast("double"))
    # a leaf counts for each ancestor with one share per child at every division between them
    above = leaves.select(F.col(node).alias("_leaf"), "y", F.posexplode("path").alias("_at", "_k")).select("_leaf", "y", "_at", F.col("_k.k").alias(node))
    children = edges.groupBy(F.col("src").alias(node)).agg((1.0 / F.count("*")).alias("_share"))
    upward = W.partitionBy("_leaf").orderBy(F.desc("_at"))
    shared = above.join(children, node, "left").withColumn("_w", F.product(F.coalesce("_share", F.lit(1.0))).over(upward))
    return shared.groupBy(node).agg(F.sum(F.col("y") * F.col("_w")).alias("y"))


def plot_data(nodes: DataFrame, edges: DataFrame, ys: DataFrame, time: str = "start_frame", node: str = "label") -> tuple[DataFrame, DataFrame]:
    """Node coordinates with birth and end marks, and edge coordinates."""
    d = degrees(nodes, edges, node)
    at = nodes.join(ys, node).join(d, node)
    points = at.select(node, F.col(time).alias("x"), "y", (F.col("in_degree") == 0).alias("birth"), (F.col("out_degree") == 0).alias("end"))
    lines = edges.join(points.select(F.col(node).alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), "src").join(
        points.select(F.col(node).alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1")), "dst"
    )
    return points, lines


def inconsistent_divisions(t: DataFrame, edges: DataFrame, steps: int = 3, label: str = "label") -> DataFrame:
    """parent, dead_end, survivor: divisions of which one child has no children and spans at most `steps` frames, the other has some."""
    d = degrees(t, edges, label, "parent", "child")
    span = t.join(d, label).select(
        F.col(label).alias("child"), F.col("out_degree").alias("own"), (F.col("end_frame") - F.col("start_frame")).alias("life")
    )
    pairs = edges.join(d.filter("out_degree = 2").select(F.col(label).alias("parent")), "parent").join(span, "child")
    both = pairs.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("own", "child", "life"))).alias("c"))
    dead, other = F.col("c")[0], F.col("c")[1]
    return both.filter((dead["own"] == 0) & (other["own"] >= 1) & (dead["life"] <= steps)).select(
        "parent", dead["child"].alias("dead_end"), other["child"].alias("survivor")
    )


def merge_inconsistent(
    detections: DataFrame, t: DataFrame, edges: DataFrame, steps: int = 3, close: int = 3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, tracklets and edges after joining dead ends into their surviving sibling.

    In frames that hold both, the two polygons become one: rasters united, closed by `close`
    pixels and traced (the largest part). Elsewhere the dead end's detections take the
    survivor's label. The survivor then starts at the earlier of the two starts.
    """
    import numpy as np
    import pandas as pd

    from celltide.functions import geometry as G

    found = inconsistent_divisions(t, edges, steps)
    moved = found.select(F.col("dead_end").alias("label"), F.col("survivor").alias("to"))
    named = detections.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to").select(*detections.columns)
    touched = found.select(F.col("survivor").alias("label")).distinct()
    rest, pool = named.join(touched, "label", "left_anti"), named.join(touched, "label", "left_semi")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) == 1:
            return group
        ps = [G.points(c) for c in group["coords"]]
        low = np.floor(np.min([p.min(0) for p in ps], axis=0)) - close - 1
        w, h = (np.ceil(np.max([p.max(0) for p in ps], axis=0)) - low).astype(int) + close + 2
        mask = np.zeros((h, w), bool)
        for p in ps:
            mask |= G.raster(p - low, h, w)
        parts = G.trace(G.closed(mask, close))
        out = group.sort_values("id").head(1).copy()
        out["coords"] = [[{"x": float(x), "y": float(y)} for x, y in parts[0] + low]]
        return out

    joined = pool.groupBy("frame", "label").applyInPandas(one, pool.schema)
    earlier = found.join(t.select(F.col("label").alias("dead_end"), F.col("start_frame").alias("_s")), "dead_end").select(F.col("survivor").alias("label"), "_s")
    kept = t.join(found.select(F.col("dead_end").alias("label")), "label", "left_anti").join(earlier, "label", "left")
    kept = kept.withColumn("start_frame", F.least("start_frame", F.coalesce("_s", "start_frame"))).select(*t.columns)
    left = edges.join(found.select(F.col("dead_end").alias("child")), "child", "left_anti").select(*edges.columns)
    return rest.unionByName(joined), kept, left
