"""Repeated substrings by suffix sorting: removes every byte covered by a string of `LENGTH`
bytes that also starts anywhere else.

Sorting every suffix of a large corpus isn't needed to find long repeats. Each string of
`LENGTH` bytes holds `LENGTH - ANCHOR + 1` anchors (strings of `ANCHOR` bytes), and the one of
least hash, the leftmost of equals, is the same wherever the string stands. So only the
suffixes at such least anchors matter (about one in seventy), and of these only the ones whose
anchor occurs twice. Their contexts, the strings that chose the anchor, are sorted from the
anchor to the right and, reversed, from the anchor to the left, by deep-shallow sorting: the
anchor is the bucket, multikey quicksort orders a bucket by eight-byte characters to a shallow
depth, and the groups that still tie, whose common prefixes are long, are ordered by blind
tries. Two strings that put the anchor at the same offset l are equal exactly if their suffixes
share a prefix of `LENGTH - l` bytes and their reversed left sides one of l, both of which are
runs in the two sorted orders.

Defined results: null texts are empty; texts shorter than `LENGTH` bytes lose nothing;
repeated rows are repeats of each other; matches never cross documents; an empty table gives
no rows; extra columns are ignored.

Scale: occurrences that repeat within a task are settled there, so a bucket sees an anchor at
most once per block of a task; equal contexts are merged in each batch before they are sent, so
thousands of copies of a text cost one context per batch. An anchor with more than `HOT`
contexts (a phrase that very many texts share, with different neighbours) isn't sorted in one
task: the strings of its contexts are counted by hash, summed before the shuffle, which gives
the same answer. What is sent follows the amount of repeated text. Texts meet their anchors in one join, and their removed spans in
a second one; ids of texts and spans are broadcast only while they are of `BROADCAST_ROWS` texts
and ten times as many numbers at most, and joined by shuffle beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltide.llm.common import released, written

LENGTH = 200
ANCHOR = 64
#: Depth in bytes, from the anchor on, to which multikey quicksort goes.
SHALLOW = 96
#: Anchors that a task holds before it sends its blocks.
HOLD = 1_500_000
#: Rows that a task holds before it sends them.
HELD = 20_000
HOT = 100_000
BROADCAST_ROWS = 200_000
MAX_BUCKETS = 1 << 14

_U = np.uint64
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_AT = 28  # bits of a position within a piece of text
_PIECE = 1 << 27
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, 2 * len(_powers[kind]), 1 << 14)
        step = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return _powers[kind][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first string, last string) of every run of strings that choose the same anchor."""
    n = len(b)
    if n < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n > _PIECE + LENGTH:
        parts = []
        for lo in range(0, n - LENGTH + 1, _PIECE):
            p, h, i, j = anchors(b[lo : lo + _PIECE + LENGTH - 1])
            parts.append((p + lo, h, i + lo, j + lo))
        return tuple(np.concatenate(x) for x in zip(*parts))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("up", n), dtype=np.uint64, out=sums[1:])
    h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * _power("down", n - ANCHOR + 1))
    least = (h >> _U(_AT) << _U(_AT)) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - ANCHOR + 1, 1
    while have < width:  # minima of windows of doubling width
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & _U((1 << _AT) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], h[at[first]], first, last


# ---------------------------------------------------------------- anchors that occur twice


def _sent(buckets: int):
    """bucket, kind, block: kind 0: distinct anchors of a block of texts; kind 1: occurrences known to repeat."""
    shift = _U(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x[1] for x in held])
            r = np.concatenate([np.full(len(x[1]), x[0], np.int64) for x in held])
            p = np.concatenate([x[2] for x in held]).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            h, r, p = h[order], r[order], p[order]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(h))) > 1
            repeated = np.repeat(many, np.diff(np.append(first, len(h))))
            rows = []
            if repeated.any():
                rows.append((int(r[first[0]]) % buckets, 1, r[repeated].tobytes() + p[repeated].tobytes()))
            h, r, p = h[first], r[first], p[first]
            cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64)) if buckets > 1 else [0, len(h)]
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                if j > i:
                    planes = np.ascontiguousarray(np.diff(h[i:j], prepend=_U(0)).view(np.uint8).reshape(-1, 8).T)
                    block = planes.tobytes() + r[i:j].tobytes() + p[i:j].tobytes() + many[i:j].tobytes()
                    rows.append((k, 0, block))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                names=["bucket", "kind", "block"],
            )

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = np.frombuffer(text.as_py().encode("utf-8", "replace"), np.uint8)
                p, h, _, _ = anchors(b)
                if len(p):
                    held.append((row, h, p))
                    size += len(p)
                    if size >= HOLD:
                        yield from give()
                        held, size = [], 0
        if held:
            yield from give()
        held.clear()
        released()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """row, positions: anchors of a bucket that occur in two places."""
    hs, rs, ps, ms, known_r, known_p = [], [], [], [], [], []
    for kind, block in zip(table["kind"].to_pylist(), table["block"]):
        raw = np.frombuffer(block.as_buffer(), np.uint8)
        if kind == 1:
            n = len(raw) // 12
            known_r.append(raw[: 8 * n].copy().view(np.int64))
            known_p.append(raw[8 * n :].copy().view(np.uint32))
            continue
        n = len(raw) // 21
        planes = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
        hs.append(np.cumsum(planes, dtype=np.uint64))
        rs.append(raw[8 * n : 16 * n].copy().view(np.int64))
        ps.append(raw[16 * n : 20 * n].copy().view(np.uint32))
        ms.append(raw[20 * n :].copy().view(bool))
    r, p = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if hs:
        h, r, p, m = (np.concatenate(x) for x in (hs, rs, ps, ms))
        order = np.argsort(h, kind="stable")
        h, r, p, m = h[order], r[order], p[order], m[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        times = np.diff(np.append(first, len(h)))
        # what repeats within its own block has been sent as known
        alive = np.repeat(times > 1, times) & ~m
        r, p = r[alive], p[alive]
    r, p = np.concatenate([r, *known_r]), np.concatenate([p, *known_p])
    order = np.argsort(r, kind="stable")
    r, p = r[order], p[order].astype(np.int32)
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), pa.array(p))
    return pa.table({"row": pa.array(r[first]), "positions": lists})


# ---------------------------------------------------------------- contexts of repeated anchors


CONTEXTS = "row bigint, start int, key bigint, anchor bigint, side int, context binary, many boolean"


def _key(anchor: int, side: int, context: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(context, digest_size=8, salt=(anchor % (1 << 64)).to_bytes(8, "little"), person=side.to_bytes(8, "little")).digest(), "little", signed=True)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (row, start, key), and once per task and key its context (anchor, side, context, many)."""
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]

    def given(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        met: dict[int, list] = {}
        places: list[tuple] = []
        for row, text, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_py().encode("utf-8", "replace")
            wanted = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]))
            p, h, first, last = anchors(np.frombuffer(raw, np.uint8))
            keep = np.isin(p, wanted)
            for at, anchor, i, j in zip(p[keep].tolist(), h[keep].view(np.int64).tolist(), first[keep].tolist(), last[keep].tolist()):
                context = raw[i : j + LENGTH]
                key = _key(anchor, at - i, context)
                places.append((row, i, key, None, None, None, None))
                if key in met:
                    met[key][3] = True
                else:
                    met[key] = [anchor, at - i, context, False]
            if len(places) >= HELD:  # only contexts wait for the end of the batch, where it is known which occurred twice
                yield given(places)
                places = []
        if places:
            yield given(places)
        while met:
            yield given([(None, None, k, *v) for k, v in (met.popitem() for _ in range(min(HELD, len(met))))])
    released()


# ---------------------------------------------------------------- deep-shallow sorting


def _quicksort(items: list, depth: int, shallow: int, out: list) -> None:
    """Multikey quicksort of (string, number) by eight-byte characters; appends groups that tie to `shallow`."""
    stack = [(items, depth)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2 or depth >= shallow:
            out.append((items, depth))
            continue
        chars = [s[depth : depth + 8] for s, _ in items]
        pivot = sorted((chars[0], chars[len(chars) // 2], chars[-1]))[1]
        less = [x for x, c in zip(items, chars) if c < pivot]
        same = [x for x, c in zip(items, chars) if c == pivot]
        more = [x for x, c in zip(items, chars) if c > pivot]
        if more:
            stack.append((more, depth))
        # strings that end within the character are equal: nothing is left to compare
        stack.append((same, depth + 8) if len(pivot) == 8 else (same, 1 << 30))
        if less:
            stack.append((less, depth))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _trie_order(items: list) -> list:
    """(string, number) in order, by a blind trie: inner nodes hold a depth and a branch per character there."""
    root: list | tuple = items[0]
    for item in items[1:]:
        s = item[0]
        node, path = root, []
        while isinstance(node, list):  # blind descent: only the branching characters are looked at
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        leaf = node[0] if isinstance(node, tuple) else b""
        depth = _shared(s, leaf)
        c = s[depth] if depth < len(s) else -1
        parent = None
        node = root
        while isinstance(node, list) and node[0] < depth:
            parent = node
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        if isinstance(node, list) and node[0] == depth:
            if c in node[1]:  # only for equal strings, which are merged before
                node[1][c] = _equal(node[1][c], item)
            else:
                node[1][c] = item
            continue
        if isinstance(node, tuple) and depth == len(s) == len(node[0]):
            new: list | tuple = _equal(node, item)
        else:
            new = [depth, {c: item, (leaf[depth] if depth < len(leaf) else -1): node}]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += [(node[0], k) for k in node[1]] if isinstance(node[1], tuple) else [node]
    return out


def _equal(a: tuple, b: tuple) -> tuple:
    first = a[1] if isinstance(a[1], tuple) else (a[1],)
    return (a[0], (*first, b[1]))


def sorted_suffixes(strings: list[bytes], buckets: np.ndarray, depth: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by bucket and then content, and the prefix each shares with the one before it.

    -1 marks the first of a bucket. `depth`: a prefix that the strings of a bucket are known to share
    (they are compared from there on).
    """
    order, shared = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
    by = np.argsort(buckets, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(buckets[by])) + 1, len(by)) if len(by) else np.zeros(0, np.int64)
    lo = 0
    for hi in ends.tolist():
        if hi - lo == 1:
            order[lo], shared[lo] = by[lo], -1
        else:
            groups: list = []
            _quicksort([(strings[i], i) for i in by[lo:hi].tolist()], depth, depth + shallow, groups)
            at, before = lo, None
            for items, reached in groups:
                if len(items) > 1 and reached < 1 << 30:
                    items = _trie_order(items)
                for s, i in items:
                    order[at] = i
                    shared[at] = -1 if before is None else _shared(before, s)
                    before, at = s, at + 1
        lo = hi
    return order, shared


def repeats(bucket: np.ndarray, sides: np.ndarray, contexts: list[bytes], many: np.ndarray) -> np.ndarray:
    """For each context, by number of its string: whether the string occurs in two places."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    strings = sizes - LENGTH + 1
    widest = LENGTH - ANCHOR + 1
    found = np.arange(widest) < (strings * many)[:, None]
    # a context alone in its bucket meets no other
    _, where, count = np.unique(bucket, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[where] > 1)
    if not len(some):
        return found
    ranks = []
    for part in (
        [contexts[i][sides[i] :] for i in some.tolist()],
        [contexts[i][: sides[i]][::-1] for i in some.tolist()],
    ):
        order, shared = sorted_suffixes(part, bucket[some])
        ranks.append((order, shared))
    side, total, weight = sides[some], strings[some], np.where(many[some], 2, 1)
    classes = []
    for order, _ in ranks:
        place = np.empty(len(some), np.int64)
        place[order] = np.arange(len(some))
        classes.append(place)
    for offset in range(int(side.max()) + 1):  # of the anchor in the string
        number = side - offset
        live = np.flatnonzero((number >= 0) & (number < total))
        if len(live) < 2:
            continue
        right = np.cumsum(ranks[0][1] < LENGTH - offset)[classes[0][live]]
        left = np.cumsum(ranks[1][1] < offset)[classes[1][live]]
        _, which = np.unique(right * np.int64(len(some) + 1) + left, return_inverse=True)
        twice = np.bincount(which, weights=weight[live])[which] > 1
        hit = live[twice]
        found[some[hit], number[hit]] = True
    return found


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ranges: flat half-open byte ranges of a context that are covered by repeats; whole anchors per task."""
    met: dict[int, list] = {}
    for batch in batches:
        for key, anchor, side, context, many in zip(*(c.to_pylist() for c in batch.columns)):
            if key in met:
                met[key][3] = True
            else:
                met[key] = [anchor, side, context, many]
    if not met:
        return
    keys = list(met)
    anchor, side, context, many = zip(*met.values())
    met.clear()
    found = repeats(np.array(anchor, np.int64), np.array(side, np.int64), list(context), np.array(many, bool))
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    begin, end = np.argwhere(edge == 1), np.argwhere(edge == -1)
    flat = np.stack([begin[:, 1], end[:, 1] + LENGTH - 1], axis=1).astype(np.int32).ravel()
    bounds = np.searchsorted(begin[:, 0], np.arange(len(keys) + 1)) * 2
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], names=["key", "ranges"])
    del keys, anchor, side, context, many, found, edge, begin, end, flat, bounds, lists, batch
    released()


def _counted(contexts: DataFrame) -> DataFrame:
    """key, ranges by counting every string of the contexts: for anchors with too many contexts to meet in one task."""
    last = F.length("context") - LENGTH
    strings = contexts.select("key", "many", "context", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    string = F.substring("context", F.col("at") + 1, F.lit(LENGTH))
    strings = strings.select("key", "many", "at", F.xxhash64(string).alias("g"), F.xxhash64(F.lit(1), string).alias("h"))
    times = strings.groupBy("g", "h").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).filter("n > 1")
    hits = strings.join(times, ["g", "h"]).groupBy("key").agg(F.collect_set("at").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [union([(a, a + LENGTH) for a in found]) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["key", "ranges"])

    return hits.mapInArrow(run, "key bigint, ranges array<int>")


# ---------------------------------------------------------------- on tables


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("kept", T.BinaryType()),
    ]
)


def union(ranges: list[tuple[int, int]]) -> list[int]:
    """The union of half-open ranges, flat and in order."""
    spans: list[int] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1]:
            spans[-1] = max(spans[-1], b)
        else:
            spans += [a, b]
    return spans


def cut(raw: bytes, spans: list[int]) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *spans, len(raw)]
    return b"".join([raw[i:j] for i, j in zip(edges[::2], edges[1::2])])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, spans of (row, lists of (start, flat ranges relative to it))."""
    for batch in batches:
        made = []
        for found in batch.column(1).to_pylist():
            made.append(union([(x["start"] + a, x["start"] + b) for x in found for a, b in zip(x["ranges"][::2], x["ranges"][1::2])]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["row", "spans"])


def removed_ranges(rows: DataFrame) -> DataFrame:
    """row, spans of the rows (row, text) that hold repeats."""
    spark = rows.sparkSession
    wanted = min(MAX_BUCKETS, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    buckets = 1 << (wanted - 1).bit_length()
    sent = rows.filter(F.octet_length("text") >= LENGTH).mapInArrow(_sent(buckets), "bucket int, kind int, block binary")
    alive = sent.groupBy("bucket").applyInArrow(_repeated, "row bigint, positions array<int>")
    alive = written(alive.groupBy("row").agg(F.collect_list("positions").alias("positions")), "anchors")
    if alive.count() <= BROADCAST_ROWS:  # then only texts with repeated anchors are shuffled
        rows = rows.join(F.broadcast(alive.select("row")), "row", "left_semi")
    joined = rows.join(alive, "row").select("row", "text", "positions")
    made = written(joined.mapInArrow(_contexts, CONTEXTS), "contexts")
    contexts = made.filter("context is not null").select("key", "anchor", "side", "context", "many")
    hot = written(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor"), "hot")
    crowded = None if hot.isEmpty() else contexts.join(hot, "anchor", "left_semi")
    if crowded is not None:
        contexts = contexts.join(hot, "anchor", "left_anti").select(*contexts.columns)
    found = contexts.repartition(wanted, "anchor").mapInArrow(_found, "key bigint, ranges array<int>")
    found = found.filter(F.size("ranges") > 0)
    if crowded is not None:
        # one context may be sent by several batches
        found = found.unionByName(_counted(crowded.groupBy("key").agg(F.first("context").alias("context"), ((F.count("*") > 1) | F.max("many")).alias("many"))))
    places = made.filter("row is not null").select("row", "start", "key").join(found, "key")
    # ranges are many to a row: they are united before they meet the texts
    listed = places.groupBy("row").agg(F.collect_set(F.struct("start", "ranges")).alias("found"))
    return listed.mapInArrow(_united, "row bigint, spans array<bigint>")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept bytes of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    spans = written(removed_ranges(rows.select("row", "text")), "spans")
    size = spans.agg(F.count("*").alias("rows"), F.sum(F.size("spans")).alias("ends")).first()
    small = size.rows <= BROADCAST_ROWS and (size.ends or 0) <= 10 * BROADCAST_ROWS
    side = F.broadcast(spans) if small else spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = []
                for t, found in zip(part.column(1), part.column(2).to_pylist()):
                    raw = t.as_py().encode("utf-8", "replace")
                    kept = cut(raw, found or [])
                    made.append((len(raw), len(raw) - len(kept), found or [], kept))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))],
                    names=["doc_id", *RESULT.fieldNames()],
                )
        released()

    joined = rows.join(side, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, T.StructType([rows.schema["doc_id"], *RESULT.fields]))
