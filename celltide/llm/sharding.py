"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source, rows are put in a seeded random order; row r of a source of n rows gets
the fractional rank (r - 1/2) / n; all rows are sorted by fractional rank and cut into shards
of sizes at most one apart. So every shard holds every source in the corpus's proportion, to
within a row at either end.

Defined results: null sources are a source of their own; a null text has no bytes (size 1,
crc32 of the empty text); equal rows are told apart arbitrarily, and their results are
interchangeable; an empty table gives no rows; other columns are ignored.

Scale: texts are read once and only ids, sizes and checksums are kept. Neither order is found
by sorting a source or the table in one task: rows fall into ranges of their random key (or
of their fractional rank), both uniform by construction, so a source of any size spreads over
all ranges; ranges are counted, and a row's position is its range's offset plus its number
within the range. The number of ranges follows the number of rows, up to `MAX_RANGES`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from celltide.llm.common import written

ROWS_PER_RANGE = 2048
MAX_RANGES = 1 << 16


def _range_bits(rows: int) -> int:
    ranges = min(MAX_RANGES, max(1, rows // ROWS_PER_RANGE))
    return (ranges - 1).bit_length()


def interleave(
    docs: DataFrame, shards: int = 16, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).select(
        "*",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("stratum"),
        F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size").alias("key"),
    )
    slim = written(slim, "shard-rows")
    total = slim.count()
    bits = _range_bits(total)
    ranges = 1 << bits

    key_range = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    slim = slim.withColumn("range", key_range)
    sizes = slim.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    along = W.partitionBy("stratum").orderBy("range")
    offsets = sizes.select(
        "stratum",
        "range",
        (F.sum("n").over(along) - F.col("n")).alias("before"),
        F.sum("n").over(W.partitionBy("stratum")).alias("of"),
    )
    within = W.partitionBy("stratum", "range").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = slim.withColumn("number", F.row_number().over(within)).join(offsets, ["stratum", "range"])
    fraction = (F.col("before") + F.col("number") - F.lit(0.5)) / F.col("of")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "key", fraction.alias("fraction"))
    ranked = ranked.withColumn("cut", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)).cast("long"))
    ranked = written(ranked, "shard-ranks")

    cuts = ranked.groupBy("cut").agg(F.count("*").alias("n"))
    starts = cuts.select("cut", (F.sum("n").over(W.orderBy("cut")) - F.col("n")).alias("start"))
    order = W.partitionBy("cut").orderBy("fraction", F.xxhash64(F.lit(seed), "stratum"), "stratum", "key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("number", F.row_number().over(order)).join(starts, "cut")
    position = F.col("start") + F.col("number") - 1
    placed = placed.withColumn("position", position.cast("long")).withColumn(
        "shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    )
    slot = F.expr(f"position - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
