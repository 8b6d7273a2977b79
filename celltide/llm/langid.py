"""Language identification by nearest centroid.

Texts are lower-cased; ASCII characters but letters become one space (other scripts' characters and
punctuation stay); hashed byte bigrams and
trigrams are weighted by TF-IDF (document frequencies over all training rows) and normalised.
A bounded sample of each language is clustered into several centroids by spherical k-means,
and a text takes the language of the centroid of highest cosine. A text whose cosine lies
below a floor set from its language's own sample is marked as rejected.

Defined results: null texts and texts without a letter (general category L) are `und`, score 0, rejected; rows
with a null language aren't learned from; ties go to the language that sorts first; with
nothing to learn from every text is `und`; repeated rows each keep their row; very long
texts are counted whole, in memory that grows with them; an empty table gives no rows; extra columns
pass through.

Scale: one pass counts document frequencies (a fixed number of dimensions per task, summed
before and after the shuffle), one draws the sample, one scores; no text is shuffled but the
sample's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltide.llm.common import map_text

DIMS = 1 << 13
#: Documents per language that the centroids are fitted on.
SAMPLE = 300
CENTROIDS = 3
ROUNDS = 8
#: A text is rejected below this share of the lowest cosine of its language's sample; a text of
#: fewer n-grams than `FULL` is far from every centroid by its shortness, so its floor is lower in proportion.
FLOOR = 0.4
FULL = 200

RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)

_SPACES = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed byte bigrams and trigrams; None where there is no letter."""
    if not text or not any(map(str.isalpha, text)):  # general category L
        return None
    flat = b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split())
    b = np.frombuffer(b" " + flat + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    shift = np.uint32(32 - (DIMS.bit_length() - 1))
    codes = np.concatenate([two * np.uint32(0x9E3779B1), (three | 1 << 24) * np.uint32(0x85EBCA6B)]) >> shift
    return np.bincount(codes, minlength=DIMS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / max(float(np.sqrt(v @ v)), 1e-12)).astype(np.float32)


def clusters(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, started from the mean and then the vectors farthest from all starts."""
    centres = [vectors.mean(0)]
    centres[0] /= np.linalg.norm(centres[0])
    for _ in range(min(k, len(vectors)) - 1):
        centres.append(vectors[np.argmin((vectors @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = vectors[own == j].sum(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


class Centroids:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centres, self.floors = idf, langs, centres, floors

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = grams(text) if len(self.langs) else None
        if counts is None:
            return "und", 0.0, True
        cos = self.centres @ vector(counts, self.idf)
        best = int(cos.argmax())
        score = min(1.0, max(0.0, float(cos[best])))
        short = min(1.0, int(counts.sum()) / FULL)
        return self.langs[best], score, bool(score < self.floors[best] * short)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS + 1, np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            counts = grams(t.as_py())
            if counts is not None:
                df[:DIMS] += counts > 0
                df[DIMS] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["dim", "n"])


def fit(
    docs: DataFrame,
    train: Column,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample: int = SAMPLE,
    k: int = CENTROIDS,
) -> Centroids:
    """Learn from the rows where `train` holds and the language is known."""
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h")
    )
    counted = rows.select("t").mapInArrow(_document_frequencies, "dim bigint, n bigint")
    df = np.zeros(DIMS + 1, np.int64)
    for r in counted.groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r.dim] = r.n
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Centroids(idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0))
    odds = F.create_map(*[F.lit(x) for p in ((a, min(1.0, 4 * sample / n)) for a, n in sorted(sizes.items())) for x in p])
    unit = (F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))).cast("double")

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "t"]).head(sample)  # a few times `sample` rows at most
        vs = [vector(c, idf) for c in map(grams, group["t"]) if c is not None]
        if not vs:
            return pd.DataFrame({"l": [], "centre": [], "low": []})
        v = np.array(vs)
        c = clusters(v, k)
        low = float((v @ c.T).max(1).min())
        return pd.DataFrame({"l": [key[0]] * len(c), "centre": [x.tobytes() for x in c.astype(np.float32)], "low": low})

    fitted = (
        rows.filter(unit < odds[F.col("l")])
        .groupBy("l")
        .applyInPandas(cluster, "l string, centre binary, low double")
        .collect()
    )
    fitted.sort(key=lambda r: (r.l, bytes(r.centre)))
    centres = np.array([np.frombuffer(r.centre, np.float32) for r in fitted]).reshape(-1, DIMS)
    return Centroids(idf, [r.l for r in fitted], centres, np.array([FLOOR * r.low for r in fitted]))


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> tuple[DataFrame, str]:
    """`docs` with a struct column (lang_pred, score, rejected); returns it and the column's name."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shipped.value
        return lambda texts: [model.predict(t) for t in texts]

    return map_text(docs, factory, RESULT, text, "language")
