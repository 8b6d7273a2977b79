"""Operators that map over texts: language, quality, decontamination, BPE."""

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide.llm import bpe, decontaminate, langid, quality
from celltide.llm.common import crc_fold, map_text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def bench(spark, texts):
    rows = [
        (1, texts[10]),
        (2, " ".join(texts[11].split()[:12]).upper()),
        (2, texts[12]),
        (3, "the"),
        (4, ""),
        (5, None),
        (None, texts[13]),
        (6, "!!"),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def brute_hits(text, items):
    found = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            found.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    w = words(text)
    hit, ids = set(), set()
    for n in {len(x) for x in found}:
        for k in range(len(w) - n + 1):
            if (x := found.get(tuple(w[k : k + n]))) is not None:
                hit.update(range(k, k + n))
                ids |= x
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_decontaminate(docs, bench, part_bytes):
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    out, c = decontaminate.decontaminate(docs, bench, part_bytes=part_bytes)
    rows = out.select("doc_id", "text", f"{c}.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items)
        spans = list(zip(r.spans[::2], r.spans[1::2]))
        assert r.n_hit == sum(len(words(r.text[a:b])) for a, b in spans)
    assert any(r.n_hit for r in rows) and any(not r.n_hit for r in rows)


def test_decontaminate_longer_window_reaches_back():
    items = [("a", "x y z"), ("b", "q w x y z e"), ("c", "y")]
    text = "y. Q w X y z e t y"
    n, ids, runs = decontaminate.scan(text, *decontaminate.automaton(items, 10))
    assert (n, ids, runs) == (9, {"a", "b", "c"}, [0, 7, 8, 9])
    assert brute_hits(text, items) == (9, 8, ["a", "b", "c"])


def test_decontaminate_empty(docs, empty, bench):
    out, c = decontaminate.decontaminate(empty, bench)
    assert out.collect() == []
    out, c = decontaminate.decontaminate(docs, bench.limit(0))
    assert out.filter(F.col(f"{c}.n_hit") > 0).isEmpty()


def test_language(docs, empty, clashing):
    train = crc_fold(F.col("doc_id"), 4) != 2
    model = langid.fit(docs, train, sample=40)
    assert set(model.langs) == {"en", "fr"}
    rows = langid.identify(clashing, model)[0]
    name = rows.columns[-1]
    got = rows.select("doc_id", "text", "lang", f"{name}.*").collect()
    for r in got:
        assert 0 <= r.score <= 1
        if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.lang and r.doc_id is not None and r.doc_id < 60 and len(r.text) > 150:
            assert (r.lang_pred, r.rejected) == (r.lang, False)
    foreign = [model.predict(t) for t in ("Съешь же ещё этих мягких французских булок, да выпей чаю " * 6, "鳥の歌声が森に響いていた" * 20)]
    assert all(f[2] for f in foreign)
    none = langid.fit(empty, train)
    assert none.predict("some text") == ("und", 0.0, True)
    # numbers that are letters to a word pattern only
    assert model.predict("½ ² ① Ⅷ 12")[0] == "und" and model.predict("ª")[0] in model.langs


def test_language_clusters():
    rng = np.random.default_rng(1)
    v = np.repeat(np.eye(4, 30), 5, axis=0) + rng.random((20, 30)) * 0.05
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    c = langid.clusters(v, 4)
    assert sorted(np.argmax(c, axis=1).tolist()) == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def labelled(spark, texts):
    bad = [t.upper().replace(" ", "!! ") for t in texts[:60]] + [" ".join([t.split()[0]] * 30) for t in texts[:60]]
    rows = [(i, t) for i, t in enumerate([*texts, *bad])]
    labels = [(i, int(i < len(texts)), 0) for i, t in rows if t and i != 2] + [(10_000, 1, 0), (4, None, 0), (None, 1, 0), (5, 0, 0)]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        len(texts),
    )


def test_quality_held_out(labelled):
    docs, labels, n = labelled
    held = crc_fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels, ~held, per_class=60)
    out, c = quality.score(docs, model)
    got = out.select("doc_id", "text", held.alias("held"), f"{c}.*").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [r for r in got if r.held and len(r.text or "") > 120]
    assert sum(r.predicted == int(r.doc_id < n) for r in test) >= 0.95 * len(test)


def test_quality_without_labels(labelled, empty):
    docs, labels, _ = labelled
    one = quality.fit(docs, labels.filter("quality = 1"), F.lit(True))
    assert one.score("anything") == one.score(None) > 0.9
    none = quality.fit(empty, labels, F.lit(True))
    assert none.score("anything") == 0.5
    assert quality.score(empty.select("doc_id", "text"), none)[0].collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = (rng.random((80, 30)) < 0.3) | (np.arange(30) < 1)
    y = np.where(x[:, 3] ^ (rng.random(80) < 0.1), 1.0, -1.0)
    ratio = rng.normal(size=30)
    rows = [np.flatnonzero(r) for r in x]
    w = quality.descend(rows, y, ratio, np.ones(80), epochs=300)
    full = x * ratio
    full = np.hstack([full / np.linalg.norm(full, axis=1, keepdims=True), np.ones((80, 1))])

    def primal(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (full @ v)).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(size=31) * 0.02) >= best - 1e-3


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["Σίσυφος ΑΣ Σ", "İx ﬁ ½²", "a<|endoftext|>B <|startoftext|>", "'LL we'll 's", "中文字 한글 😀!?", "\x1c\x85​﻿", "é" * 5000, "é ẛ̣"]


def test_bpe_matches_the_library(spark, docs, tokenizer):
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string"))
    out, c = bpe.encode(both)
    vocabulary = None
    for r in out.select("text", f"{c}.*").collect():
        e = tokenizer.encode(r.text or "", add_special_tokens=False)
        assert r.ids_text == " ".join(map(str, e.ids)) and r.n_tokens == len(e.ids)
        assert r.decoded == tokenizer.decode(e.ids, skip_special_tokens=False)
        if vocabulary is None:
            with open(bpe.tokenizer_file(), encoding="utf-8") as f:
                vocabulary = bpe.Vocabulary(f.read())
        assert bpe.decode(r.ids_text, vocabulary) == r.decoded


def test_bpe_digests_and_empty_table(docs, empty):
    plain, p = bpe.encode(docs)
    digest, d = bpe.encode(docs, digests=True)
    want = {(r.doc_id, r.text): r for r in plain.select("doc_id", "text", f"{p}.*").collect()}
    for r in digest.select("doc_id", "text", f"{d}.*").collect():
        w = want[r.doc_id, r.text]
        assert r.ids_sha256 == hashlib.sha256(w.ids_text.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(w.decoded.encode()).hexdigest()
    assert bpe.encode(empty)[0].collect() == []


def test_lexicon_is_minimal_and_exact():
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))).encode() for _ in range(90)})
    entries = [(w, [i, len(w)]) for i, w in enumerate(words)]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    asked = words + [b"", b"c", b"ab" * 40, b"zzz"] + [w + b"c" for w in words]
    for w, k in zip(asked, lexicon.numbers(asked).tolist()):
        assert k == (words.index(w) if w in words else -1)
        if k >= 0:
            assert lexicon.tokens(k).tolist() == [k, len(w)]
    # as many states as distinct right languages
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(lexicon.final) == len(rights)


def test_extra_columns_pass_through(clashing):
    from pyspark.sql import types as T

    out, name = map_text(clashing, lambda: lambda texts: [(zlib.crc32((t or "").encode()),) for t in texts], T.StructType([T.StructField("crc", T.LongType())]))
    assert out.columns == [*clashing.columns, name] and name not in clashing.columns
    assert out.filter(F.col(f"{name}.crc") != F.crc32(F.coalesce("text", F.lit("")))).isEmpty()
