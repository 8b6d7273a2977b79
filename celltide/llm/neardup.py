"""Near-duplicate detection by order MinHash.

A text is its lower-cased words; its occurrence-labelled word 5-grams are hashed by `SKETCHES`
functions; of each, the `TOGETHER` smallest are kept in the order in which they stand in the
text. Texts that agree in one such ordered sketch are candidates, and a candidate pair is a
link if the banded alignment of its words finds an edit similarity of at least `SIMILARITY`
(1 - edits / words of the longer text). Classes are the connected components of links.

Defined results: equal texts are one class without further test (null counts as empty);
texts without a word are only classed with equal texts; texts of fewer than five words have
one shingle of all their words; a class is named by its smallest doc_id (null if all are
null); ties of sketches and ranks go to the smaller hash; very long texts are aligned whole,
in memory that grows with their words; an empty table gives no rows; extra columns are ignored.

Scale: equal texts are collapsed before anything else, by digest, so large groups of copies
cost one row each. A bucket never gives all its pairs. In the first round the members of the
buckets of the first `FIRST` functions are compared with their bucket's least member; these
links are merged, and in each further round every bucket of every function that still holds
several components compares them, in slices of about `SLICE_OF` dealt anew each round, with
the slice's leader and with the neighbour in sketch order; pairs once tested never again. What
holds several components after `ROUNDS` rounds, the first included, is compared whole, members of
different components with each other: all pairs of a bucket of at most `SMALL` texts; the texts of larger ones by their rarest word 3-grams, and by their rarest words,
of which two texts similar enough always share one each. An n-gram of at most `RARE` texts (`RARE_WORD`
for words) brings all of them together, one of more texts in at most half as many components two
members of each. An n-gram of more components (a passage that very many texts share) brings nobody
together. A text that looks at no n-gram of more texts than that has met all that are similar; the words are for the
texts that do. For those that look at a word of more texts too, there are last rounds over their buckets until one
brings no link, and then all pairs of a bucket in different components are compared in tiles of two times about `TILE`
texts or `TILE_WORDS` words: by sizes and counts of words, and by alignment what passes. A tile holds the words of its
texts, so no pair becomes a row; it gives the links that join components, and a pair of several buckets is aligned in one
of them. So every pair of one bucket is tested, excluded or in one class. The rows of that last step grow with such texts (with
their square beyond a tile, 1 / `TILE` of it), its comparisons with the square of such texts in a bucket. Texts of at most
`SHORT` words, whose shingles a single edit may all change, also share a bucket with every text that is within the edits
allowed, by the words left after deletions.
Pairs whose numbers of words exclude a link aren't tested. Texts are shuffled by id, and only those
that share a bucket. Components are found by
alternating large-star and small-star steps over written tables. Relations of ids (16 bytes a
row) are broadcast while they have at most `BROADCAST_ROWS` rows, 4 MB, and joined by shuffle beyond. The
driver holds at most `COMMON` hashes of n-grams (0.5 MB); more of that kind are joined like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from celltide.llm.common import SLICE, fresh, relieved, written

SHINGLE = 5
SKETCHES = 48
TOGETHER = 2
SIMILARITY = 0.8
FIRST = 12
ROUNDS = 2
SLICE_OF = 256
SMALL = 8
RARE = 128
RARE_WORD = 16
COMMON = 1 << 16
SHORT = 14
TILE = 2048
TILE_WORDS = 1 << 20
BINS = 1024
SIGNS = 256
BROADCAST_ROWS = 200_000
STAR_STEPS = 40

_U = np.uint64
_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACE = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | _U(1)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | _U(1)
_XOR = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def tokens(text: str | None) -> np.ndarray:
    """One 64-bit hash per word."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "replace").translate(_FOLD), np.uint8)
    word = b != 32
    if not word.any():
        return np.zeros(0, np.uint64)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    letters = b[word]
    starts = np.flatnonzero(begins[word])
    place = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    return _mix(np.add.reduceat(_BYTE[letters] * _PLACE[place & 1023], starts))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word n-grams, each labelled with its number among equal ones."""
    k = min(size, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * _STEP[j]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return h
    first = np.flatnonzero(new)
    occurrence = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    labelled = ranked + occurrence.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    out = np.empty(n, np.uint64)
    out[order] = np.where(occurrence > 0, _mix(labelled), ranked)
    return out


def sketch(words: np.ndarray, m: int = SKETCHES, together: int = TOGETHER) -> np.ndarray:
    """For each function, a hash of its smallest labelled shingles in text order."""
    h = shingles(words)
    if not len(h):
        return np.zeros(0, np.int64)
    kept = min(together, len(h))
    at = np.empty((m, kept), np.int64)
    for j in range(m):
        v = (h ^ _XOR[j]) * _MUL[j]
        at[j] = np.argpartition(v, kept)[:kept] if len(v) > kept else np.arange(kept)
    at.sort(axis=1)
    out = _mix(np.arange(1, m + 1, dtype=np.uint64))
    for i in range(kept):
        out = _mix(out + h[at[:, i]])
    return out.view(np.int64)


def remainders(words: np.ndarray, least: float = SIMILARITY, short: int = SHORT) -> np.ndarray:
    """Keys of a short text: what is left of it after any deletions that a similar text of at most `short` words allows.

    Two such texts within k insertions, deletions or substitutions have a rest in common after k deletions from each.
    """
    n = len(words)
    if not 0 < n <= short:
        return np.zeros(0, np.int64)
    most = int((1 - least) * min(short, int(n / least + 1e-9)) + 1e-9)
    rests = {tuple(np.delete(words, gone).tolist()) for k in range(min(most, n - 1) + 1) for gone in combinations(range(n), k)}
    keys = np.zeros(len(rests), np.uint64)
    for i, rest in enumerate(sorted(rests)):
        for w in rest:
            keys[i : i + 1] = _mix(keys[i : i + 1] * _STEP[0] + _U(w))
    return _mix(keys + _U(SKETCHES + 1)).view(np.int64)


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the words of a and b are at most `most` insertions, deletions or substitutions apart.

    Bit-parallel alignment: a column of the dynamic programme is two integers of vertical
    differences, of which only the band of diagonals within `most` is kept.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    same = int(differ[0]) if len(differ) else n
    a, b = a[same:], b[same:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    same = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a) <= most
    # words that one text lacks cannot be aligned
    both, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(counts[: len(a)], minlength=len(both)), np.bincount(counts[len(a) :], minlength=len(both))
    if len(a) - int(np.minimum(in_a, in_b).sum()) > most:
        return False
    rows, cols = counts[: len(a)].tolist(), counts[len(a) :].tolist()
    masks: dict[int, int] = {}
    for i, c in enumerate(rows):
        masks[c] = masks.get(c, 0) | 1 << i
    # row i of the pattern is bit i; at column j only rows j - most .. j + most are in the band
    width = 2 * most + 1
    full = (1 << len(rows)) - 1
    if width >= len(rows):
        vp, vn, score, top = full, 0, len(rows), 1 << (len(rows) - 1)
        for j, c in enumerate(cols):
            eq = masks.get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1 | 1) & full
            hn = (hn << 1) & full
            vp, vn = hn | (full & ~(d0 | hp)), hp & d0
            if score - (len(cols) - 1 - j) > most:
                return False
        return score <= most
    return _banded(masks, cols, len(rows), most)


def _banded(masks: dict[int, int], cols: list[int], n: int, most: int) -> bool:
    """Banded bit-vector alignment: bit k of a window at column j is row j - most + k.

    The score follows the band's lower edge down its diagonal, then the last row along the columns.
    """
    width = 2 * most + 1
    window = (1 << width) - 1
    vp = (window >> most) << most
    vn, score = 0, most
    cut = most + n - len(cols)
    diag = 1 << (width - 1)
    for j, c in enumerate(cols):
        low = j - most  # row of bit 0, rows counted from 0
        m = masks.get(c, 0)
        eq = (m >> low if low >= 0 else m << -low) & window
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & window
        hp = (vn | ~(d0 | vp)) & window
        hn = d0 & vp
        row_of_last = low + width - 1
        if row_of_last < n:
            if not d0 & diag:
                score += 1
        else:
            at = 1 << (n - 1 - low)
            if hp & at:
                score += 1
            elif hn & at:
                score -= 1
        if score > cut + most + len(cols):
            return False
        d0 >>= 1
        vp = (hn | ~(d0 | hp)) & window
        vn = d0 & hp
    return score <= most


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and edits_within(a, b, int((1 - least) * longer + 1e-9))


def gram_size(least: float) -> int:
    """The longest word n-gram, 3 at most, of which texts of that similarity always share one."""
    return 3 if least > 0.67 else 2 if least > 0.51 else 1


def signature(words: np.ndarray, signs: int = SIGNS) -> np.ndarray:
    """`signs` bits, as 64-bit integers: of which hash values the text has an odd number of words. An edit changes at most two."""
    odd = np.bincount((_mix(words.astype(np.uint64)) % _U(signs)).astype(np.int64), minlength=signs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def counts(words: np.ndarray, bins: int = BINS) -> np.ndarray:
    """How many words have each hash value, 255 at most.

    Two texts k edits apart differ by at most k words more and k fewer: the sum of all differences and the difference
    of the numbers of words are together at most 2 k, in the texts, in bins and with bounded bins.
    """
    n = np.bincount((_mix(words.astype(np.uint64)) % _U(bins)).astype(np.int64), minlength=bins)
    return np.minimum(n, 255).astype(np.uint8)


def prefix(n: int, least: float, size: int) -> int:
    """How many n-grams of a text of n words, first in any order common to all, hold one of each similar text.

    A text has one n-gram per word (`size` - 1 void words stand before it), an edit changes `size`
    of them, so m - size * edits of the longer text's m are shared.
    """
    m = np.arange(n, int(n / max(least, 0.01)) + 2)
    edits = ((1 - least) * m + 1e-9).astype(np.int64)
    shared = int((m - size * edits)[m - edits <= n].min())
    return n - max(shared, 1) + 1


# ---------------------------------------------------------------- on tables


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, sizes = [], []
        for t in batch.column(2):
            words = tokens(t.as_py())
            sizes.append(len(words))
            made.append(sketch(words).tolist() + remainders(words).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(made, pa.list_(pa.int64()))],
            names=["doc_id", "d", "w", "sketches"],
        )


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [tokens(t.as_py()).astype(np.uint32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["d", "words"])


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [
                similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), least)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words)], names=["a", "b", "ok"])

    return run


def _links(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """a, b, ok of distinct pairs a < b; the words of a go with each pair to those of b, and only the words of their members are shuffled."""
    pairs = written(pairs, "pairs")
    ends = written(pairs.select(F.col("b").alias("d")).distinct(), "ends")
    left = words.select(F.col("d").alias("a"), F.col("words").alias("left_words")).join(_side(pairs), "a")
    right = words.join(_side(ends), "d", "left_semi").select(F.col("d").alias("b"), F.col("words").alias("right_words"))
    both = left.join(right, "b").select("a", "b", "left_words", "right_words")
    return both.mapInArrow(_verified(least), "a bigint, b bigint, ok boolean")


def _among(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which n-grams are in the sorted array `common`."""
    if not len(common):
        return np.zeros(len(grams), bool)
    return common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams


def _grams(size: int, common: np.ndarray):
    """d, label, gram of each word n-gram that is not in `common`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        void = np.zeros(size - 1, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                words = [np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in part.column(1)]
                grams = [shingles(np.concatenate([void, w]), size) for w in words]
                n = np.array([len(g) for g in grams])
                ids, labels = (np.repeat(part.column(k).to_numpy(), n) for k in (0, 2))
                all_ = np.concatenate(grams).view(np.int64)
                kept = ~_among(all_, common)
                made = [ids[kept], labels[kept], all_[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["d", "label", "gram"])

    return run


def _prefixes(least: float, size: int, common: np.ndarray):
    """d, n (words), first (n-grams to be looked at), common (n-grams that are in `common`), signs (the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        void = np.zeros(size - 1, np.uint64)
        for batch in batches:
            words = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(1)]
            n = [len(w) for w in words]
            grams = (shingles(np.concatenate([void, w.astype(np.uint64)]), size).view(np.int64) for w in words)
            made = [batch.column(0), pa.array(n, pa.int64()), pa.array([prefix(k, least, size) for k in n], pa.int64())]
            made.append(pa.array([int(_among(g, common).sum()) for g in grams], pa.int64()))
            made.append(pa.array([signature(w) for w in words], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(made, names=["d", "n", "first", "common", "signs"])

    return run


def _tiled(least: float):
    """a, b of links between a tile's texts of two slots (or of one), no more than join what all its links join.

    A pair that shares several buckets is left to one of them, chosen by its hashes.
    """

    def run(table: pa.Table) -> pa.Table:
        d, slot = table.column("d").to_pylist(), table.column("slot").to_numpy()
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        words = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("words")]
        keys = [frozenset(x) for x in table.column("keys").to_pylist()]
        n, counted = np.array([len(x) for x in words]), np.stack([counts(x) for x in words])
        group = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        one, two = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
        found: list[tuple[int, int]] = []
        for lo in range(0, len(one), SLICE // 4):
            x = one[lo : lo + SLICE // 4, None]
            most = np.floor((1 - least) * np.maximum(n[x], n[two]) + 1e-9)
            ok = (group[x] != group[two]) & (np.abs(n[x] - n[two]) <= most)
            if i == j:
                ok &= x < two
            r, c = np.nonzero(ok)
            for at in range(0, len(r), 4096):
                p, q = x[r[at : at + 4096], 0], two[c[at : at + 4096]]
                differ = (np.maximum(counted[p], counted[q]) - np.minimum(counted[p], counted[q])).sum(axis=1, dtype=np.int64)
                kept = differ + np.abs(n[p] - n[q]) <= 2 * most[r[at : at + 4096], c[at : at + 4096]]
                for a, b in zip(p[kept].tolist(), q[kept].tolist()):
                    if group[a] == group[b]:
                        continue
                    both = sorted(keys[a] & keys[b])
                    if both[(d[a] ^ d[b]) % len(both)] == key and similar(words[a], words[b], least):
                        group[group == group[b]] = group[a]
                        found.append((min(d[a], d[b]), max(d[a], d[b])))
        return pa.table({name: pa.array([pair[k] for pair in found], pa.int64()) for k, name in enumerate("ab")})

    return run


def _tiles(left: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """a, b, ok of links that join all components of which members of one bucket are similar.

    A bucket's members are dealt to slots of about `TILE` texts or `TILE_WORDS` words, and each two slots are compared in one group.
    """
    texts = words.join(_side(left.select("d").distinct()), "d", "left_semi")
    texts = texts.join(left.groupBy("d").agg(F.collect_list("key").alias("keys")), "d")
    slots = F.ceil(F.greatest(F.col("n") / TILE, F.col("total") / TILE_WORDS))
    dealt = left.select("key", "d", "label", F.pmod(F.xxhash64("key", "d"), slots).alias("slot"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("other"))
    dealt = dealt.join(texts, "d").withColumns({"i": F.least("slot", "other"), "j": F.greatest("slot", "other")})
    return dealt.groupBy("key", "i", "j").applyInArrow(_tiled(least), "a bigint, b bigint").distinct().withColumn("ok", F.lit(True))


def _side(df: DataFrame) -> DataFrame:
    """A written relation of ids as a join side: broadcast below a bound on its rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, steps: int = STAR_STEPS) -> DataFrame:
    """d, label of every end of an edge (a, b): the least end of its component.

    Alternates large-star (neighbours above a node go to its least neighbour) and small-star
    (neighbours below it do) until no edge changes.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(edges.select("a", "b").distinct(), "edges")
    before = state(edges)
    for _ in range(steps):
        small_enough = before[0] <= BROADCAST_ROWS // 2

        def with_least(rows: DataFrame, small_enough: bool = small_enough) -> DataFrame:
            least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            return rows.join(F.broadcast(least) if small_enough else least, "a")

        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.select(F.inline(F.array(F.struct("a", "b"), turned)))
        large = with_least(both).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(F.broadcast(lowest) if small_enough else lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        made = small.filter("a <> b").union(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = written(made, "edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("d"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("d"), F.col("b").alias("label")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {steps} steps")


def _near(w: Column, v: Column, least: float) -> Column:
    """Whether texts of w and v words may be similar."""
    return F.abs(w - v) <= F.floor((1 - least) * F.greatest(w, v) + 1e-9)


def _alike(x: str, y: str, w: Column, v: Column, least: float) -> Column:
    """Whether texts of w and v words with the signatures x and y may be similar."""
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SIGNS // 64)), F.lit(0))
    return differ <= 2 * F.floor((1 - least) * F.greatest(w, v) + 1e-9)


def _pairs(others: DataFrame, least: float) -> DataFrame:
    """Distinct a < b of (d, w, other) rows, other being (d, w) too, that may be similar."""
    kept = others.filter("other.d <> d").filter(_near(F.col("w"), F.col("other.w"), least))
    return kept.select(F.least("d", "other.d").alias("a"), F.greatest("d", "other.d").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (d, label) after joining the components that verified links connect."""
    ok = links.filter("ok")
    if ok.isEmpty():
        return labels
    side = _side(labels)
    ends = ok.join(side.select(F.col("d").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(side.select(F.col("d").alias("b"), F.col("label").alias("lb")), "b").filter("la <> lb")
    joined = components(ends.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")))
    joined = written(joined.select(F.col("d").alias("label"), F.col("label").alias("to")), "merged")
    out = labels.join(_side(joined), "label", "left").select("d", F.coalesce("to", "label").alias("label"))
    out = written(out, "labels")
    relieved(labels.sparkSession)  # each merge follows tens of queries
    return out


def _crowded(texts: DataFrame, labels: DataFrame, least: float, size: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """By n-grams of `size` words: a, b of the pairs of the texts (d, words) that may be similar and are in different components,
    and d of the texts of which a pair may be missing.

    Prefix filtering: n-grams in the order of those in one component only, then the others by the
    number of components that have them. Two similar texts share one of the first `prefix` of both,
    so a pair is only missing if both look at an n-gram of more than `rare` texts. Of those that bring
    nobody together the `COMMON` most frequent stand last: a text's number of them tells whether it looks
    at one, so their occurrences are neither shuffled nor joined.
    """
    none, text, grams = np.zeros(0, np.int64), W.partitionBy("d"), "d bigint, label bigint, gram bigint"
    texts = texts.join(_side(labels), "d").select("d", "words", "label")
    met = texts.mapInArrow(_grams(size, none), grams).groupBy("gram", "label").agg(F.count("*").alias("times"))
    met = met.groupBy("gram").agg(F.sum("times").alias("times"), F.count("*").alias("labels")).filter("labels > 1")
    met = written(met, "grams")
    most = met.filter((F.col("times") > rare) & (2 * F.col("labels") > rare)).orderBy(F.desc("times"), "gram").limit(COMMON).select("gram")
    common = np.sort(np.array([r.gram for r in most.collect()], np.int64))
    sizes = texts.mapInArrow(_prefixes(least, size, common), "d bigint, n bigint, first bigint, common bigint, signs array<bigint>")
    sizes = written(sizes, "sizes")
    rows = texts.mapInArrow(_grams(size, common), grams).join(_side(met), "gram").join(_side(sizes), "d")
    rows = rows.withColumn("own", F.col("n") - F.col("common") - F.count("*").over(text))
    rows = rows.withColumn("rank", F.row_number().over(text.orderBy("labels", "gram"))).filter("own + rank <= first")
    rows = written(rows.select("gram", "times", "labels", "d", "label", "n", "signs"), "prefixes")
    few = rows.filter(F.col("times") <= rare).select("gram", "d", "label", "n", "signs")
    chance, one = F.xxhash64("gram", "d"), F.struct("d", "n", "signs")
    two = rows.filter((F.col("times") > rare) & (2 * F.col("labels") <= rare)).groupBy("gram", "label").agg(F.min_by(one, chance).alias("x"), F.max_by(one, chance).alias("y"))
    two = two.select("gram", "label", F.explode(F.array_distinct(F.array("x", "y"))).alias("m")).select("gram", "m.d", "label", "m.n", "m.signs")
    met = few.unionByName(two)
    other = met.select("gram", F.col("d").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("signs").alias("other"))
    both = met.join(other, "gram").filter((F.col("d") < F.col("b")) & (F.col("label") != F.col("lb")) & _near(F.col("n"), F.col("nb"), least))
    both = both.filter(_alike("signs", "other", F.col("n"), F.col("nb"), least))
    unsure = rows.filter(F.col("times") > rare).select("d").union(sizes.filter("n - common < first").select("d"))
    return both.select(F.col("d").alias("a"), "b").distinct(), unsure.distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, with their labels and the buckets' sizes (n, and total words)."""
    members = shared.drop("n", "total").join(_side(labels), "d")
    open_ = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = written(open_.filter("low <> high").select("key", "n", "total"), "open")
    return written(members.join(_side(open_), "key"), "left")


def _rest(left: DataFrame, labels: DataFrame, words: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """a, b of the pairs left to test, members of different components of a bucket that holds several, and d of the texts of
    which a pair may be missing.
    """
    few = left.filter(F.col("n") <= SMALL).select("key", "d", "w", "label")
    other = few.select("key", F.col("d").alias("b"), F.col("w").alias("wb"), F.col("label").alias("lb"))
    pairs = few.join(other, "key").filter("d < b and label <> lb").filter(_near(F.col("w"), F.col("wb"), least))
    pairs = pairs.select(F.col("d").alias("a"), "b").distinct()
    open_ = written(left.filter(F.col("n") > SMALL).select("d").distinct(), "crowded")
    for size, rare in ((gram_size(least), RARE), (1, RARE_WORD)):
        if open_.isEmpty():
            break
        texts = written(words.join(_side(open_), "d", "left_semi"), "crowded-words")
        found, missing = _crowded(texts, labels, least, size, rare)
        pairs, open_ = pairs.union(found), written(missing, "crowded")
    return pairs.distinct(), open_


def _met(shared: DataFrame, labels: DataFrame, r: int, least: float) -> DataFrame:
    """a, b of round r: one member of each component in a slice of a bucket, with the slice's leader and the neighbour before it."""
    part = F.pmod(F.xxhash64(F.lit(r), "label"), F.ceil(F.col("n") / SLICE_OF)).alias("slice")
    members = shared.join(_side(labels), "d").select("key", part, "label", "d", "w", "side")
    one = members.groupBy("key", "slice", "label").agg(F.min_by(F.struct("d", "w", "side"), F.xxhash64(F.lit(r), "key", "d")).alias("m"))
    mixed = one.select("key", "slice", "m.*", F.xxhash64(F.lit(r), "key", "label").alias("rank"))
    slice_, member = W.partitionBy("key", "slice"), F.struct("d", "w")
    leader = F.first(member).over(slice_.orderBy("rank", "d"))
    beside = F.lag(member).over(slice_.orderBy("side", "d"))
    others = mixed.select("d", "w", leader.alias("leader"), beside.alias("beside"))
    return _pairs(others.select("d", "w", F.explode(F.array("leader", "beside")).alias("other")), least)


def _labels(docs: DataFrame, text: str, doc_id: str, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, d, label) of every row, d being its text's hash, and the tested pairs (a, b, ok), of those tested in tiles only links."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.xxhash64("text"))
    sketched = written(
        rows.select("doc_id", "d", "text").mapInArrow(
            _sketched,
            T.StructType(
                [
                    *rows.select("doc_id", "d").schema.fields,
                    T.StructField("w", T.LongType()),
                    T.StructField("sketches", T.ArrayType(T.LongType())),
                ]
            ),
        ),
        "sketches",
    )
    one = sketched.groupBy("d").agg(F.first("w").alias("w"), F.first("sketches").alias("sketches"))  # equal texts, equal sketches
    each = one.select("d", "w", "sketches", F.posexplode("sketches").alias("j", "key"))
    each = each.select("key", "d", "w", "j", F.get("sketches", (F.col("j") + 1) % SKETCHES).alias("side"))
    # a bucket's size and least member by partial sums, met in a join: a crowded bucket is no single task's work
    crowd = each.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("d", "w")).alias("least")).filter("n > 1")
    shared = written(each.join(crowd, "key").select("key", "d", "w", "side", "j", "n", "least"), "buckets")
    nodes = written(shared.select("d").distinct(), "nodes")
    near = _side(nodes)
    kept = rows.select("d", "text").join(near, "d", "left_semi").groupBy("d").agg(F.first("text").alias("text"))
    words = written(kept.mapInArrow(_tokenised, "d bigint, words binary"), "words")

    first = shared.filter(F.col("j") < FIRST).select("d", "w", F.col("least").alias("other"))
    tested = written(_links(_pairs(first, least), words, least), "links")
    labels = _merged(nodes.select("d", F.col("d").alias("label")), tested)

    def test(pairs: DataFrame) -> bool:
        """Tests the pairs not tested before; whether one is a link."""
        nonlocal tested, labels
        new = pairs.join(_side(tested.select("a", "b")), ["a", "b"], "left_anti")
        found = written(_links(new, words, least), "links")
        tested, before = tested.unionByName(found), labels
        labels = _merged(labels, found)
        return labels is not before

    for r in range(1, ROUNDS):
        test(_met(shared, labels, r, least))
    left = _open(shared, labels)
    pairs, unsure = _rest(left, labels, words, least)
    test(pairs)
    if not unsure.isEmpty():  # every pair that may still be missing
        # each round and the tiles read these rows: written once, so that they are not joined anew each time
        crowded, r = written(left.filter(F.col("n") > SMALL).drop("label").join(_side(unsure), "d", "left_semi"), "unsure"), ROUNDS
        while test(_met(crowded, labels, r, least)):
            r += 1
        found = written(_tiles(_open(crowded, labels), words, least), "links")
        tested, labels = tested.unionByName(found), _merged(labels, found)
    slim = sketched.select("doc_id", "d").join(_side(labels), "d", "left").select(
        "doc_id", "d", F.coalesce("label", "d").alias("label")
    )
    return slim, tested


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size of every row."""
    slim, _ = _labels(docs, text, doc_id, least)
    sizes = slim.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return slim.join(sizes, "label").select("doc_id", "class_id", "class_size")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row of each class: that of the smallest id (null ids last), with all columns of `docs`."""
    d, n = fresh(docs, "text_hash"), fresh(docs, "place")
    marked = docs.withColumn(d, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    labels, _ = _labels(docs, text, doc_id, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "d")).alias("first")
    kept = labels.groupBy("label").agg(first).select(F.col("first.doc_id").alias("keep_id"), F.col("first.d").alias("keep_d"))
    times = labels.groupBy("doc_id", "d").agg(F.count("*").alias("times")).filter("times > 1")
    chosen = marked.join(kept, (F.col(d) == F.col("keep_d")) & F.col(doc_id).eqNullSafe(F.col("keep_id")), "left_semi")
    if times.isEmpty():
        return chosen.select(*docs.columns)
    # rows that share id and text: any one of them
    order = W.partitionBy(doc_id, d).orderBy(F.lit(1))
    return chosen.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).select(*docs.columns)
