"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import ranked, stage

SHARDS = 24
SEED = 20_241
#: Rows that a cell of the distributed ranking holds on average, at most.
CELL = 1024


def start_of(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "stratum"), 11) / F.lit(float(1 << 53))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """Deal documents into shards so that each shard has the mixture of the whole.

    Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank is
    (rank + start) / rows of the source, with a seeded start in [0, 1) for each source, so
    that many sources of a few rows don't meet at one place.  All rows sorted by it are cut into runs whose
    lengths differ by one at most (law ``rows``), so any run holds each source in
    proportion, within one row.  Ranks come from cells of about CELL rows and prefix sums:
    a source of any size is never in one task.

    Null sources form a source of their own; a null text has size 8 and the checksum of
    the empty text; a null doc_id is ranked like any other value.  Repeated rows are
    dealt one by one.  An empty table gives no rows.  Other columns are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("-")).alias("stratum"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = stage(rows, "shard-rows")
    total = rows.count()
    cells = max(1, -(-total // CELL))
    rows = rows.withColumn("cell", F.pmod("h", F.lit(cells)).cast("long"))
    tie = [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = ranked(rows, "stratum", "cell", tie, "rank")
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_stratum"))
    placed = placed.join(counts, "stratum")
    placed = placed.withColumn("frac", (F.col("rank") + start_of(seed)) / F.col("n_stratum"))
    placed = placed.withColumn("slice", F.floor(F.col("frac") * cells).cast("long")).withColumn("whole", F.lit(0))
    placed = stage(placed.drop("cell", "rank", "n_stratum"), "shard-ranks")
    placed = ranked(placed, "whole", "slice", [F.col("frac"), F.col("stratum"), *tie], "rank")
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
