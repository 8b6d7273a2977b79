"""Language-model scoring with a log-frequency Bloom filter.

Word and word-pair counts of the training texts are quantised to levels: a count has level q if
it reaches the q-th threshold (exact counts first, then steps of about 15 %). An n-gram of level
q is entered in the filter once for each level up to q, and a query probes levels 1, 2, 3, ...
until one is missing; the last found level gives a lower bound of the count. Probabilities are
smoothed: words by absolute discounting, the discounted mass going to the class of unseen
words; pairs by a Dirichlet prior on the word's probability. As in every such filter, a pair that
never occurred is found now and then, so the probabilities of V words after one that occurs c times
sum to 1 + 0.0094 V / (c + `PRIOR`) in the mean, not to 1.

The exact add-one baseline beside it uses exact counts: the most frequent words are broadcast
(at most `TOP` of them), the counts of all other words reach the texts by a join.

Defined results: null and empty texts have one token, the end; equal texts share their sums;
with nothing to learn from every token is the unseen class, with probability 1; repeated rows
each keep their row; an empty table gives no rows; extra columns are ignored. Words are told
apart by 64-bit hashes.

Scale: tasks send one packed block of sorted distinct n-grams and counts per hash bucket and
million tokens. The number of buckets follows the bytes of text (`BUCKET_BYTES` each), and each
bucket makes its own segment of the filter, as large as its n-grams need at `FILL`: every n-gram of
the training texts is in the filter, which grows with the corpus. A filter of up to `BROADCAST_BYTES`
is broadcast to the workers, which is what usual vocabularies need. A larger one stays in its segments:
the distinct n-grams of about `ASK_TOKENS` tokens of text are dealt to the segments' buckets, probed
there and the levels sent back to their texts. Both ways give the same scores. Very long texts are
scored whole, in memory that grows with their tokens.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from celltide.llm.common import slices, written

#: Bits of an n-gram for its first level, and for each further one.
FIRST, PROBES = 5, 4
#: Bits set per bit of a segment: with 39 % of them ones, an n-gram that is not there is found with a
#: probability of 0.0094, and one that is there at a level too high with 0.024.
FILL = 0.5
BUCKET_BYTES = 8 << 20
BROADCAST_BYTES = 128 << 20
TOP = 1 << 18
PRIOR = 300.0
#: Tokens that a counting task holds before it sends its blocks.
HOLD = 1_000_000
SLICE_TOKENS = 400_000
#: The same where n-grams are sent to the segments: more of them repeat in a larger slice.
ASK_TOKENS = 1_500_000
MAX_BUCKETS = 1 << 16

_U = np.uint64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACE = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) | _U(1)
_END = _U(0x5851F42D4C957F2D)


def _thresholds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(out[-1] * 1.15)))
    return np.array(out, np.int64)


LEVELS = _thresholds()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, then of the end."""
    b = np.frombuffer((text or "").encode("utf-8", "replace").translate(_FOLD), np.uint8)
    word = ~_SPACE[b]
    if not word.any():
        return np.array([_END])
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    letters = b[word]
    starts = np.flatnonzero(begins[word])
    place = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    sums = np.add.reduceat(_BYTE[letters] * _PLACE[place & 4095] + (place >> 12).astype(np.uint64), starts)
    return np.append(_mix(sums), _END)


def pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the end stands before the first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[:1] = _END
    return _mix(before * _U(0xD1342543DE82EF95) + words)


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of differences, which compress."""
    return np.ascontiguousarray(np.diff(h, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _hashes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes and their counts."""
    counts = np.ascontiguousarray(n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return _planes(h) + counts.tobytes()


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(block, np.uint8)
    n = len(raw) // 12
    return _hashes(raw[: 8 * n]), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _summed(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes and their total counts."""
    if n is None:
        h.sort()  # in place: the caller's array is done with
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.append(first, len(h)))
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _counted(buckets: int):
    """Blocks (bucket, kind, block) of the n-grams of training texts; kind 1: words, 2: pairs."""
    shift = _U(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            words = np.concatenate(held)
            two = np.empty_like(words)
            two[1:] = words[:-1]
            two[0] = _END  # every other text begins after the end of the one before it
            two = _mix(two * _U(0xD1342543DE82EF95) + words)
            held.clear()
            for kind, all_ in ((1, words), (2, two)):
                h, n = _summed(all_)
                cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64)) if buckets > 1 else [0, len(h)]
                for part in slices([(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i], 8):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b for b, _, _ in part], pa.int32()),
                            pa.array([kind] * len(part), pa.int32()),
                            pa.array([_pack(h[i:j], n[i:j]) for _, i, j in part], pa.binary()),
                        ],
                        names=["bucket", "kind", "block"],
                    )

        for batch in batches:
            for t in batch.column(0):
                w = tokens(t.as_py())
                held.append(w)
                size += len(w)
                if size >= HOLD:
                    yield from give()
                    size = 0
        if held:
            yield from give()

    return run


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, n, side="right")


def _positions(h: np.ndarray, level: int, probe: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Below `bits`, which are fewer than 2^32."""
    salt = _U((level * 0x9E3779B97F4A7C15 + probe * 0x632BE59BD9B4E019) & (1 << 64) - 1)
    return ((_mix(h + salt) >> _U(32)) * bits) >> _U(32)


def segment(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The filter segment of the n-grams of one bucket: every one, with all its levels."""
    q = level_of(n)
    size = max(64, -(-int((q.sum() * PROBES + len(q) * (FIRST - PROBES)) / FILL) // 64) * 64)
    if size >= 1 << 32:
        raise ValueError("a bucket holds too many n-grams: lower BUCKET_BYTES")
    out, bits, level = np.zeros(size // 8, np.uint8), _U(size), 1
    while len(h):
        for p in range(FIRST if level == 1 else PROBES):
            at = _positions(h, level, p, bits)
            np.bitwise_or.at(out, (at >> _U(3)).astype(np.int64), np.left_shift(1, at & _U(7)).astype(np.uint8))
        level += 1
        keep = q >= level
        h, q = h[keep], q[keep]
    return out


def probe(h: np.ndarray, bits: np.ndarray, base: np.ndarray | np.uint64, size: np.ndarray | np.uint64) -> np.ndarray:
    """Level of each n-gram hash in the segment of `size` bits from bit `base` on, 0 where it isn't found."""
    out = np.zeros(len(h), np.int64)
    live, level = np.arange(len(h)), 0
    base, size = np.broadcast_to(base, len(h)), np.broadcast_to(size, len(h))
    while len(live):
        level += 1
        for p in range(FIRST if level == 1 else PROBES):
            at = base[live] + _positions(h[live], level, p, size[live])
            set_ = bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1
            live = live[set_ == 1]
        out[live] = level
    return out


MERGED = "bucket int, segment binary, words binary, stats array<bigint>"


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    parts: dict[int, tuple] = {}
    for kind in (1, 2):
        got = [_unpack(x) for k, x in zip(table["kind"].to_pylist(), table["block"].to_pylist()) if k == kind]
        h = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint64)
        n = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
        parts[kind] = _summed(h, n)
    made = segment(*(np.concatenate(x) for x in zip(parts[1], parts[2])))
    h, n = parts[1]
    stats = [int(n.sum()), len(n), int((n == 1).sum()), int((n == 2).sum()), len(made), len(parts[2][0])]
    words = h.tobytes() + n.tobytes()
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()], pa.int32()),
            "segment": pa.array([made.tobytes()], pa.binary()),
            "words": pa.array([words], pa.binary()),
            "stats": pa.array([stats], pa.list_(pa.int64())),
        }
    )


def _word_table(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(block) // 16
    return np.frombuffer(block, np.uint64, n), np.frombuffer(block, np.int64, n, 8 * n)


class Model:
    """The totals, the exact counts of the most frequent words, and the filter where it is small enough (bits)."""

    def __init__(self, buckets: int, sizes: np.ndarray, total: int, distinct: int, ones: int, twos: int, prior: float):
        self.buckets, self.total, self.distinct, self.prior = buckets, total, distinct, prior
        self.sizes = sizes.astype(np.uint64) * _U(8)
        self.bases = np.cumsum(self.sizes, dtype=np.uint64) - self.sizes
        self.bits: np.ndarray | None = None
        self.discount = ones / (ones + 2 * twos) if ones else 0.5
        self.top_hash, self.top_count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._top_level: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_top_level": None}

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of the most frequent words, -1 for all others."""
        if not len(self.top_hash):
            return np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.top_hash, h).clip(max=len(self.top_hash) - 1)
        return np.where(self.top_hash[at] == h, self.top_count[at], -1)

    def bucket_of(self, h: np.ndarray) -> np.ndarray:
        log = self.buckets.bit_length() - 1
        return (h >> _U(64 - log)).astype(np.int64) if log else np.zeros(len(h), np.int64)

    def word_levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of words; a worker probes the most frequent ones once and remembers them."""
        if not len(self.top_hash):
            return self.levels(h)
        if self._top_level is None:
            self._top_level = self.levels(self.top_hash)
        at = np.searchsorted(self.top_hash, h).clip(max=len(self.top_hash) - 1)
        known = self.top_hash[at] == h
        out = np.where(known, self._top_level[at], 0)
        rest = np.flatnonzero(~known)
        out[rest] = self.levels(h[rest])
        return out

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram hash, 0 where it isn't found."""
        if not self.total:
            return np.zeros(len(h), np.int64)
        at = self.bucket_of(h)
        return probe(h, self.bits, self.bases[at], self.sizes[at])

    def log_probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each token of the texts, joined."""
        one, where = np.unique(np.concatenate(texts), return_inverse=True)
        two, at = np.unique(np.concatenate([pairs(t) for t in texts]), return_inverse=True)
        return self.logs(texts, where, self.word_levels(one), at, self.levels(two))

    def logs(self, texts: list[np.ndarray], where: np.ndarray, level: np.ndarray, at: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The same, given the levels of the distinct words and pairs, and where they stand."""
        if not self.total:
            return np.zeros(len(where))
        value = np.concatenate([[0], LEVELS]).astype(float)
        above = np.concatenate([[0], LEVELS[1:] - 1, LEVELS[-1:]]).astype(float)  # the largest count of a level
        p = np.where(level > 0, value[level] - self.discount, self.discount * self.distinct) / self.total
        most = above[level][where]
        p = p[where]
        seen = value[two][at]
        before = np.empty(len(where))
        before[1:] = most[:-1]
        ends = np.cumsum([len(t) for t in texts])
        before[[0, *ends[:-1]]] = most[-1]  # the end, last token of every text
        seen = np.minimum(seen, before)
        return np.log10((seen + self.prior * p) / (before + self.prior))


def learn(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    top: int = TOP,
    prior: float = PRIOR,
    bucket_bytes: int = BUCKET_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table (h, c) of exact word counts, and the table of the filter's segments (bucket, segment)."""
    learnt = docs.filter(train).select(text)
    size = learnt.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(MAX_BUCKETS, 1 << max(4, int(np.ceil(np.log2(size / bucket_bytes + 1e-9)))))
    blocks = learnt.mapInArrow(_counted(buckets), "bucket int, kind int, block binary")
    merged = written(blocks.groupBy("bucket").applyInArrow(_merged, MERGED), "ngrams")
    stats = {r.bucket: r.stats for r in merged.select("bucket", "stats").collect()}  # six numbers a bucket
    table = np.array([stats.get(k, [0] * 6) for k in range(buckets)], np.int64)
    sizes = np.maximum(table[:, 4], 8)
    total, distinct, ones, twos = (int(x) for x in table[:, :4].sum(0))
    model = Model(buckets, sizes, total, distinct, ones, twos, prior)
    if int(sizes.sum()) <= broadcast_bytes:
        model.bits = np.zeros(int(sizes.sum()), np.uint8)
        starts = (model.bases >> _U(3)).astype(np.int64)
        for r in merged.select("bucket", "segment").toLocalIterator():
            model.bits[starts[r.bucket] : starts[r.bucket] + len(r.segment)] = np.frombuffer(r.segment, np.uint8)

    def grades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(LEVELS) + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                found += np.bincount(level_of(_word_table(x.as_py())[1]), minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["grade", "n"])

    words = merged.select("words")
    room, lowest = top, None
    histogram = words.mapInArrow(grades, "grade bigint, n bigint").groupBy("grade").agg(F.sum("n").alias("n")).collect()
    for r in sorted(histogram, key=lambda r: -r.grade):
        room -= r.n
        if room < 0:
            break
        lowest = r.grade

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                h, c = _word_table(x.as_py())
                keep = level_of(c) >= lowest
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes() + c[keep].tobytes()], pa.binary())], names=["words"])

    if lowest is not None:
        got = [_word_table(r.words) for r in words.mapInArrow(frequent, "words binary").toLocalIterator()]
        h, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(h)
        model.top_hash, model.top_count = h[order], c[order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                h, c = _word_table(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return model, words.mapInArrow(rows, "h bigint, c bigint"), merged.select("bucket", "segment")


SCORED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("logs", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
    ]
)


def _parts(rows, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows (..., text) with their tokens, about `most` at a time: what repeats in a slice is probed once."""
    part, words, size = [], [], 0
    for r in rows:
        part.append(r)
        words.append(tokens(r[-1]))
        size += len(words[-1])
        if size >= most:
            yield part, words
            part, words, size = [], [], 0
    if part:
        yield part, words


def _scored(model: Model, part: list, words: list[np.ndarray], where: np.ndarray, one: np.ndarray, logs: np.ndarray, kinds: list) -> pa.RecordBatch:
    """Sums of each row (doc_id, held_out, d, text) over its tokens, and the words that the model has no exact count of."""
    bounds = np.cumsum([0, *map(len, words)])
    flat = np.concatenate(words)
    count = model.counts(one)
    usual = (count >= 0)[where]
    base = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)[where]
    sums = [np.add.reduceat(x, bounds[:-1]) for x in (usual.astype(np.int64), base, logs)]
    rare = [flat[i:j][~usual[i:j]].view(np.int64) for i, j in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array([r[k] for r in part], type=kinds[k]) for k in range(3)),
            pa.array(np.diff(bounds)),
            *(pa.array(x) for x in sums),
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.array(np.concatenate(rare))),
        ],
        names=["doc_id", "held_out", "d", *SCORED.fieldNames()],
    )


def _asked(buckets: int):
    """slice, bucket, held: for each slice of texts the rows themselves (bucket -1) and its distinct n-grams by bucket."""
    log = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for part, words in _parts(rows(), ASK_TOKENS):
            name = uuid.uuid4().hex
            out = [(name, -1, pickle.dumps(part))]
            h = _ngrams(words)
            cuts = np.searchsorted(h >> _U(64 - log), np.arange(buckets + 1, dtype=np.uint64)) if log else [0, len(h)]
            out += [(name, k, _planes(h[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))],
                names=["slice", "bucket", "held"],
            )

    return run


def _ngrams(words: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([*words, *(pairs(w) for w in words)]))


def _probed(key: tuple, asked: pa.Table, segments: pa.Table) -> pa.Table:
    """The levels that one segment has for the n-grams of each slice."""
    bits = np.frombuffer(segments["segment"][0].as_py(), np.uint8) if segments.num_rows else np.zeros(8, np.uint8)
    made = [probe(_hashes(np.frombuffer(x.as_py(), np.uint8)), bits, _U(0), _U(8 * len(bits))).astype(np.uint16).tobytes() for x in asked["held"]]
    return pa.table({"slice": asked["slice"], "bucket": asked["bucket"], "held": pa.array(made, pa.binary())})


def score(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    top: int = TOP,
    prior: float = PRIOR,
    bucket_bytes: int = BUCKET_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (~train).alias("held_out"), F.xxhash64(body).alias("d"), body.alias("text")
    )
    model, counts, segments = learn(docs, train, text, top, prior, bucket_bytes, broadcast_bytes)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [to_arrow_type(f.dataType) for f in rows.schema.fields[:3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value

        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for part, words in _parts(each(), SLICE_TOKENS):
            one, where = np.unique(np.concatenate(words), return_inverse=True)
            two, at = np.unique(np.concatenate([pairs(w) for w in words]), return_inverse=True)
            logs = model.logs(words, where, model.word_levels(one), at, model.levels(two))
            yield _scored(model, part, words, where, one, logs, kinds)

    def gathered(key: tuple, table: pa.Table) -> pa.Table:
        model = shipped.value
        held = dict(zip(table["bucket"].to_pylist(), table["held"].to_pylist()))
        part = pickle.loads(held.pop(-1))
        words = [tokens(r[-1]) for r in part]
        h = _ngrams(words)
        level = np.concatenate([np.frombuffer(held[k], np.uint16) for k in sorted(held)]).astype(np.int64)
        one, where = np.unique(np.concatenate(words), return_inverse=True)
        two, at = np.unique(np.concatenate([pairs(w) for w in words]), return_inverse=True)
        logs = model.logs(words, where, level[np.searchsorted(h, one)], at, level[np.searchsorted(h, two)])
        return pa.Table.from_batches([_scored(model, part, words, where, one, logs, kinds)])

    schema = T.StructType([*rows.drop("text").schema.fields, *SCORED.fields])
    if model.bits is not None or not model.total:
        scored = written(rows.mapInArrow(run, schema), "scored")
    else:
        parts = "slice string, bucket int, held binary"
        asked = written(rows.mapInArrow(_asked(model.buckets), parts), "asked")
        questions, texts = asked.filter("bucket >= 0"), asked.filter("bucket < 0")
        answers = questions.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(_probed, parts)
        scored = written(texts.unionByName(answers).groupBy("slice").applyInArrow(gathered, schema), "scored")
    shipped.unpersist()
    # equal texts ask for their rare words once
    asked = scored.select("d", "rare").groupBy("d").agg(F.first("rare").alias("rare")).select("d", F.explode("rare").alias("h"))
    answered = asked.join(counts, "h").groupBy("d").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs")
    )
    floor = float(np.log10(model.total + model.distinct + 1))
    return scored.join(answered, "d", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
