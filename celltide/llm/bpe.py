"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The words of the whole corpus are counted; the most frequent ones are compiled into a
shared-suffix automaton whose arcs carry partial word numbers (their sum numbers the word),
and the number selects the word's token ids. The automaton is a few flat arrays that workers
map from a file. Words outside the lexicon are merged exactly, many at a time: each round
joins, in every unfinished word, the leftmost pair of lowest rank.

Defined results: a null text is an empty text and gives no tokens; special-token strings in a
text become those tokens, as the tokenizers library does with add_special_tokens=False;
repeated rows each keep their row; an empty table gives an empty lexicon; extra columns pass
through.

Scale: counting pre-aggregates per batch before its only shuffle; the lexicon is bounded by
`lexicon_size` words of at most `MAX_WORD` bytes, so what is broadcast does not grow with the
data; the encoding itself is a map without shuffle.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltide.llm.common import map_text, written

LEXICON_SIZE = 1 << 16
MAX_WORD = 64
#: Words a worker remembers; beyond it the memory is emptied (results do not depend on it).
MEMO = 300_000

CODES = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_text", T.StringType()),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)

#: Texts of these characters only need no NFC, and lower-case and split alike everywhere.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")


def _class(category: str) -> str:
    """The body of a character class: Basic Latin to Latin Extended-B of a general category."""
    return "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == category)


_L, _N = _class("L"), _class("N")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class Vocabulary:
    """Merge ranks and token strings of a word-end BPE tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + self.suffix] for c in letters], np.int32)
        keys, made = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(ids[a] << 32 | ids[b])
            made.append(ids[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array(made, np.int32)
        self._library = None
        self._definition = definition
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def pieces(self, text: str) -> list:
        """Words of a text in order, as normalised strings; special tokens as ids."""
        if "<" in text and self.special:
            out: list = []
            for k, part in enumerate(self._split.split(text)):
                if k % 2:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return _PIECES.findall(text.lower())
        if self._library is None:  # other scripts: the library's own Unicode tables
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import Split
            from tokenizers import Regex

            tokenizer = Tokenizer.from_str(self._definition)
            pattern = next(
                p for p in json.loads(self._definition)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
            )["pattern"]["Regex"]
            self._library = tokenizer.normalizer, Split(Regex(pattern), "removed", invert=True)
        normalizer, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact ids of words: in rounds, the leftmost pair of lowest rank of every word is joined."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(order), 4096):
            rows = order[lo : lo + 4096]
            self._merge_block([words[i] for i in rows], rows, out)
        return out

    def _merge_block(self, words: list[bytes], rows: np.ndarray, out: list) -> None:
        if len(words) > 1 and len(words) * len(words[-1]) > 1 << 20:  # very long words: smaller blocks
            half = len(words) // 2
            self._merge_block(words[:half], rows[:half], out)
            self._merge_block(words[half:], rows[half:], out)
            return
        n = np.array([len(w) for w in words])
        width = int(n.max())
        if width > 4096:
            for w, r in zip(words, rows):
                out[r] = self._merge_long(w)
            return
        sym = np.full((len(words), width), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        mask = np.arange(width) < n[:, None]
        sym[mask] = self.inner[flat]
        ends = np.cumsum(n) - 1
        sym[np.arange(len(words)), n - 1] = self.last[flat[ends]]
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        live = np.arange(len(words))
        while width > 1 and len(live):
            best = rank[live].argmin(1)
            value = rank[live, best]
            go = value < len(self.made)
            live, best, value = live[go], best[go], value[go]
            if not len(live):
                break
            sym[live, best] = self.made[value]
            cols = np.arange(width - 1)
            moved = cols > best[:, None]
            tail = np.where(moved, np.concatenate([sym[live, 1:]], axis=1), sym[live, :-1])
            sym[live, :-1] = tail
            sym[live, -1] = -1
            rank[live] = np.where(
                cols > best[:, None],
                np.concatenate([rank[live, 1:], np.full((len(live), 1), len(self.made))], axis=1),
                rank[live],
            )
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width - 1)
                r, c = live[ok], at[ok]
                rank[r, c] = self._rank(sym[r, c], sym[r, c + 1])
        for r, s in zip(rows, sym):
            out[r] = s[s >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], len(self.made))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one very long word, by a queue of pairs."""
        import heapq

        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        lookup = getattr(self, "_lookup", None)
        if lookup is None:
            lookup = self._lookup = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        nxt, prv = list(range(1, len(sym))) + [-1], list(range(-1, len(sym) - 1))
        queue = []

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j >= 0 and (r := lookup.get(sym[i] << 32 | sym[j])) is not None:
                heapq.heappush(queue, (r, i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            nxt[j] = -1
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return np.array([s for s in sym if s >= 0], np.int64)


# ---------------------------------------------------------------- the transducer


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic automaton of sorted distinct words, as one block of flat arrays.

    Arcs out of a state lie together, sorted by byte. An arc's output is the number of words
    that sort before its branch within the state, so outputs along a path sum to the word's
    number; `ids[starts[number]:starts[number + 1]]` are its tokens.
    """
    register: dict[tuple, int] = {}
    kept: list[tuple] = []  # state -> (final, ((byte, target), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(kept)
            kept.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # unfinished states along the last word
    before = b""
    for word, _ in entries:
        same = 0
        while same < len(before) and same < len(word) and before[same] == word[same]:
            same += 1
        while len(path) - 1 > same:
            done = freeze(path.pop())
            path[-1][1].append((before[len(path) - 1], done))
        for _b in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((before[len(path) - 1], done))
    root = freeze(path[0])

    size = [0] * len(kept)  # words below each state; targets are frozen before their sources
    first = [0] * (len(kept) + 1)
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(kept):
        total = int(final)
        for b, t in arcs:
            keys.append(s << 8 | b)
            targets.append(t)
            outputs.append(total)
            total += size[t]
        size[s], first[s + 1] = total, len(keys)
    final = np.array([k[0] for k in kept], np.uint8)
    starts = np.cumsum([0, *[len(i) for _, i in entries]])
    ids = np.array([x for _, i in entries for x in i], np.int32)
    arrays = [
        np.array([root], np.int64),
        np.array(keys, np.int64),
        np.array(targets, np.int32),
        np.array(outputs, np.int32),
        final,
        starts.astype(np.int64),
        ids,
    ]
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)
    return len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8) + body


class Lexicon:
    """A compiled lexicon mapped from a file."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # the mapping outlives the file's name
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self._map[:8], "little")
        at, arrays = 8 + n + (-n % 8), []
        for kind, length in json.loads(self._map[8 : 8 + n]):
            a = np.frombuffer(self._map, kind, length, at)
            arrays.append(a)
            at += a.nbytes + (-a.nbytes % 8)
        root, self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = arrays
        self.root = int(root[0])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it isn't in the lexicon."""
        n = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(n) - n
        live = np.flatnonzero((n > 0) & (n <= MAX_WORD))
        state = np.full(len(live), self.root, np.int64)
        number = np.zeros(len(live), np.int64)
        for j in range(MAX_WORD + 1):
            ended = n[live] == j
            if ended.any():
                good = ended & (self.final[state] == 1)
                out[live[good]] = number[good]
                live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            key = state << 8 | flat[begin[live] + j]
            at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at, number = live[hit], at[hit], number[hit]
            state = self.targets[at].astype(np.int64)
            number = number + self.outputs[at]
        return out

    def tokens(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


class Encoder:
    """Lexicon first, exact merges for the rest; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.names = [str(i) for i in range(len(vocabulary.tokens))]
        self.memo: dict = {}
        self._specials()

    def _specials(self) -> None:
        for token, i in self.vocabulary.special.items():
            self.memo[i] = (self.names[i], token)

    def learn(self, words: set) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self._specials()
            new = [w for w in words if w not in self.memo]
        raw = [w.encode() for w in new]
        numbers = self.lexicon.numbers(raw)
        unseen = np.flatnonzero(numbers < 0)
        merged = dict(zip(unseen.tolist(), self.vocabulary.merge([raw[i] for i in unseen])))
        names, tokens = self.names, self.vocabulary.tokens
        for i, (w, k) in enumerate(zip(new, numbers.tolist())):
            ids = merged[i].tolist() if k < 0 else self.lexicon.tokens(k).tolist()
            self.memo[w] = (
                (names[ids[0]], tokens[ids[0]])
                if len(ids) == 1
                else (" ".join([names[x] for x in ids]), " ".join([tokens[x] for x in ids]))
            )

    def encode(self, texts: list) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text."""
        split, known = self.vocabulary.pieces, self.memo.__getitem__
        for lo in range(0, len(texts), 128):
            parts = [split(t) if t else [] for t in texts[lo : lo + 128]]
            self.learn(set().union(*parts))
            for p in parts:
                if p:
                    ids, tokens = map(" ".join, zip(*map(known, p)))
                    yield ids.count(" ") + 1, ids, tokens
                else:
                    yield 0, "", ""


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[str, Encoder] = {}


def _vocabulary(definition: str) -> Vocabulary:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(definition)
    return _vocabularies[key]


def word_counts(docs: DataFrame, definition, text: str = "text") -> DataFrame:
    """word, n over the whole table: summed per batch before the shuffle. `definition`: broadcast file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _vocabulary(definition.value).pieces
        counts: Counter = Counter()

        def give(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t:
                    counts.update(split(t))
                    if len(counts) > 4 * MEMO:
                        yield give(_words_only(counts))
                        counts = Counter()
        if counts:
            yield give(_words_only(counts))

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _words_only(counts: Counter) -> Counter:
    for k in [k for k in counts if not isinstance(k, str)]:
        del counts[k]
    return counts


def build_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_SIZE) -> bytes:
    """The compiled lexicon of the most frequent words of the whole table, `size` at most."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    counts = word_counts(docs, shipped, text).filter((F.col("n") > 1) & (F.octet_length("word") <= MAX_WORD))
    counts = written(counts.withColumn("grade", F.floor(F.log2("n") * 64).cast("int")), "words")
    # the lowest grade of frequency from which on at most `size` words remain; there are few grades
    room, lowest = size, None
    for r in sorted(counts.groupBy("grade").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.grade):
        room -= r.n
        if room < 0:
            break
        lowest = r.grade
    top = counts.filter(F.col("grade") >= lowest).select("word").collect() if lowest is not None else []
    vocabulary = Vocabulary(definition)
    words = sorted(r.word.encode() for r in top)
    return compile_lexicon(list(zip(words, [i.tolist() for i in vocabulary.merge(words)] if words else [])))


def encode(
    docs: DataFrame,
    path: str | None = None,
    text: str = "text",
    lexicon: bytes | None = None,
    digests: bool = False,
) -> tuple[DataFrame, str]:
    """`docs` with a struct column of codes (or their digests); returns it and the column's name."""
    path = path or tokenizer_file()
    block = build_lexicon(docs, path, text) if lexicon is None else lexicon
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((definition, block, hashlib.sha256(block).hexdigest()))

    def factory():
        definition, block, key = shipped.value
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(_vocabulary(definition), Lexicon(block))
        encoder = _encoders[key]

        def work(texts: list) -> list:
            if not digests:
                return list(encoder.encode(texts))
            sha = hashlib.sha256
            return [(n, sha(i.encode()).hexdigest(), sha(d.encode()).hexdigest()) for n, i, d in encoder.encode(texts)]

        return work

    return map_text(docs, factory, DIGESTS if digests else CODES, text, "codes")


def decode(ids_text: str, vocabulary: Vocabulary) -> str:
    """Text of space-joined ids: token strings joined by a space, specials kept."""
    return " ".join(vocabulary.tokens[int(i)] for i in ids_text.split())
