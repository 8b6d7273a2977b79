"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's `docs`. All but the last return the columns of `documents`.

Defined results: null, empty and letterless texts go in the first stage, so the others see none when
run in order; given alone they keep them (a null text stays null and has no tokens). Rows with a null
id are kept like others. Of repeated rows and of ties near_duplicates keeps any one. Very long texts
are handled whole by every stage. An empty table gives an empty table with the same columns. Extra
columns pass through, whatever their names; `tokens` puts its own n_tokens, ids and decoded_sha256
in place of columns of these names. Tables that the stages write to the shared folder go with
`celltide.llm.common.sweep(spark)` once the result is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltide.llm import bpe, decontaminate, langid, neardup, pii
from celltide.llm.common import crc_fold, load, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those far from every language learned from, go."""
    model = langid.fit(docs, crc_fold(F.col("doc_id"), 4) != 2)
    out, c = langid.identify(docs, model)
    return out.filter(~F.col(f"{c}.rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest doc_id."""
    return neardup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    out, c = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))
    return out.filter(F.col(f"{c}.n_hit") == 0).select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the new text."""
    out, _ = pii.replace(docs, pii.key_of(spark))
    lengths = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*docs.columns).withColumns(lengths)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, space-joined, with their number and the digest of the decoded text."""
    out, c = bpe.encode(docs)
    added = {
        "n_tokens": F.col(f"{c}.n_tokens"),
        "ids": F.col(f"{c}.ids_text"),
        "decoded_sha256": F.sha2(f"{c}.decoded", 256),
    }
    return out.select(*[x for x in docs.columns if x not in added], *[v.alias(k) for k, v in added.items()])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("surrogates", surrogates),
    ("tokens", tokens),
]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
