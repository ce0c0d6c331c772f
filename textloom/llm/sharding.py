"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the smallest -ln(u) / weight, u being a uniform hash of its key and the
shard's name. A shard that is added can only win records for itself, and a removed one loses only its own.

Slots number the rows of a shard from 0 without gaps in the order of the ids. They come from counts by
blocks of the id order, summed up twice, and a row number inside each block, so no task sees a whole shard.

Defined cases: a null text has size 1 and the CRC of nothing; a null key is a key like any other, and its
rows come last; equal keys share a shard, repeated rows get slots of their own; ties in a score go to the
first shard; only native functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.ranks import block_columns


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a string key."""

    def cost(shard: int) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
        return -F.ln(u) / F.lit(float(weights[shard]))

    costs = F.array(*(cost(s) for s in range(len(weights))))
    return F.transform(F.array(costs), lambda c: F.array_position(c, F.array_min(c)) - 1)[0].cast("int")


def assign(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); grown_shard: with one more shard of the mean weight."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, sum(weights) / len(weights)]).alias("grown_shard"))
    wide, block = block_columns(docs.select(F.col(id_col).alias("doc_id")), "doc_id", F.col("text_crc32"))
    rows = rows.withColumns({"wide": wide, "block": block})
    counts = rows.groupBy("shard", "wide", "block").agg(F.count("*").alias("n"))
    inner = Window.partitionBy("shard", "wide").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("shard").orderBy("wide").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy("shard", "wide").agg(F.sum("n").alias("n")).select("shard", "wide", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("wide_before"))
    starts = counts.withColumn("block_before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(before, ["shard", "wide"])
    starts = starts.select("shard", "wide", "block", (F.col("block_before") + F.col("wide_before")).alias("start"))
    within = Window.partitionBy("shard", "wide", "block").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    placed = rows.withColumn("row", F.row_number().over(within)).join(starts, ["shard", "wide", "block"])
    slot = (F.col("start") + F.col("row") - 1).cast("long").alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id") -> None:
    """docs as Parquet under path, one folder for each shard."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs.withColumn("shard", rendezvous(key, weights)).write.partitionBy("shard").parquet(path)
