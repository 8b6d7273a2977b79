import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def prose(rng, n, lang="en"):
    words = {
        "en": "the of and river stone walked under green light morning house table paper window carried slowly".split(),
        "fr": "le la les été forêt maison où très être garçon fenêtre lumière après déjà château père".split(),
    }[lang]
    made = [rng.choice(words) + rng.choice(["", "", "s", "ing", "ly"]) * (lang == "en") for _ in range(n)]
    out = []
    for i, w in enumerate(made):
        out.append(w.capitalize() if i % 9 == 0 else w)
        out.append(".\n" if i % 27 == 26 else ". " if i % 9 == 8 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, shared passages, empty, null, very long and odd texts."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 160), "fr" if i % 4 == 0 else "en") for i in range(60)]
    passage = prose(rng, 70)
    out = list(base)
    out += [base[5]] * 6 + [base[6]] * 2
    for k in (7, 8, 9, 9, 9):
        w = base[k].split(" ")
        for j in range(0, len(w), 25):
            w[j] = "changed"
        out.append(" ".join(w))
    out += [base[i] + "\n" + passage + " " + base[i + 1] for i in range(10, 16)]
    out += ["", None, " ", "12 34", "...", "a", prose(rng, 6000), "é" * 300, "é" * 300 + "x", "ab" * 400]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "fr" if i % 4 == 0 and i < 60 else "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append((3, texts[3], None, "s0", 1))  # a repeated id and text
    rows.append((None, "text without an id", "en", "s1", 3))
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "hits result codes row d key label range entities digest score size next words at n value language".split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
