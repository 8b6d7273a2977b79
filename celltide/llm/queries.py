"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltide.llm import bpe, decontaminate, fingerprint, langid, langmodel, neardup, pii, quality, sharding, suffixdedup
from celltide.llm.common import crc_fold, load


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, load(spark, sf_dir, "labels"), ~held)
    out, c = quality.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), f"{c}.score", f"{c}.predicted")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.expr("size(spans) div 2").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out, c = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        f"{c}.n_words",
        f"{c}.n_hit",
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"),
        (F.col(f"{c}.n_hit") > 0).alias("contaminated"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out, c = bpe.encode(docs, digests=True)
    return out.select("doc_id", f"{c}.n_tokens", f"{c}.ids_sha256", f"{c}.decoded_sha256")


def op5_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langmodel.score(docs, crc_fold(F.col("doc_id"), 7) != 2)


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = pii.replace(load(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))
    kinds = F.array_join(F.transform(f"{c}.kinds", lambda k: F.concat(k["kind"], F.lit("="), k["n"])), ",")
    return out.select("doc_id", "text", f"{c}.n_entities", kinds.alias("kinds"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(load(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.fingerprint(load(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next.text")))
    rows = rows.withColumn("edited_words", fingerprint.words(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("words")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_words")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
        fingerprint.likeness(F.col("words"), F.col("next.words")).alias("near_next"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = crc_fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held)
    out, c = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), f"{c}.lang_pred", f"{c}.score", f"{c}.rejected")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_repeats": op2_repeats,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_score": op5_score,
    "op6_shard": op6_shard,
    "op7_pii": op7_pii,
    "op8_neardup": op8_neardup,
    "op9_fingerprint": op9_fingerprint,
    "op10_language": op10_language,
}

ORACLES: dict[str, str] = {
    "op2_repeats": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
s AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s)),
g AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM g)
SELECT d.doc_id, n AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a)::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a), '') || substr(h, 2 * coalesce(max(b), 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id, h, n
""",
    "op3_decontaminate": """
WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM f, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT doc_id, o.n, i, item_id FROM o JOIN v ON o.n = v.n AND o.t = v.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT f.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN h ON f.doc_id = h.doc_id LEFT JOIN c ON f.doc_id = c.doc_id
""",
}
