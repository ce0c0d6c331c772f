"""Sketches: a relational Count-Min sketch that merges by addition, Murmur3, top-k, distinct."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textloom.session import ship_package


def shape(epsilon: float = 0.01, delta: float = 0.01) -> tuple[int, int]:
    """(width, depth): ceil(e / epsilon) and ceil(ln(1 / delta))."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def cells(key: Column, width: int, depth: int) -> Column:
    """Array of (line, place) of a key: double hashing by the halves of one 64-bit hash."""
    low = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.xxhash64(key), 32)
    return F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.struct(i.alias("line"), F.pmod(low + i * high, F.lit(width)).cast("int").alias("place")))


def build(df: DataFrame, key: Column, width: int, depth: int) -> DataFrame:
    """(line, place, n); the cells are combined before the shuffle, which has at most width x depth rows a task."""
    return df.select(F.explode(cells(key, width, depth)).alias("c")).groupBy("c.line", "c.place").agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("line", "place").agg(F.sum("n").alias("n"))


def estimate(keys: DataFrame, name: str, sketch: DataFrame, width: int, depth: int) -> DataFrame:
    """keys with an estimate each: the smallest of its cells, never less than the true count. The sketch has a fixed size."""
    at = keys.select(name, F.explode(cells(F.col(name), width, depth)).alias("c")).select(name, "c.line", "c.place")
    found = at.join(F.broadcast(sketch), ["line", "place"], "left")
    return found.groupBy(name).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def mined(df: DataFrame, key: str, epsilon: float = 1e-5, delta: float = 1e-5) -> DataFrame:
    """(key, n) of the keys that occur more than once, n exact however full the sketch is.

    The sketch names the candidates and misses none, as its estimates are never too small. Those too large are put right
    by the keys' own counts: equal keys are combined before they reach the sketch, which is joined by a shuffle.
    """
    width, depth = shape(epsilon, delta)
    counted = df.groupBy(key).agg(F.count("*").alias("k"))
    at = counted.select(key, "k", F.explode(cells(F.col(key), width, depth)).alias("c")).select(key, "k", "c.line", "c.place")
    held = at.groupBy("line", "place").agg(F.sum("k").alias("n"))
    found = at.join(held, ["line", "place"]).groupBy(key).agg(F.min("n").alias("estimate"), F.max("k").alias("n")).where("estimate > 1")
    return found.where("n > 1").select(key, "n")


#: Expected insertions and share of false positives of a Bloom filter; its bits and hashes follow.
INSERTIONS, FALSE_SHARE = 1_000_000, 0.03


class Bloom:
    """Whether a 64-bit hash was seen before; some that were not are taken for seen."""

    def __init__(self, insertions: int = INSERTIONS, share: float = FALSE_SHARE):
        self.bits = math.ceil(-insertions * math.log(share) / math.log(2) ** 2)
        self.hashes = max(1, round(self.bits / insertions * math.log(2)))
        self.words = bytearray(-(-self.bits // 8))

    def seen(self, value: int) -> bool:
        """Also notes the value."""
        low, high, before = value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF, True
        for i in range(1, self.hashes + 1):
            at = (low + i * high) % self.bits
            if not self.words[at >> 3] >> (at & 7) & 1:
                before = False
                self.words[at >> 3] |= 1 << (at & 7)
        return before


def bloom_distinct(df: DataFrame, streams: int = 16) -> DataFrame:
    """The rows of df that one Bloom filter for each of some streams has not seen; equal rows are in one stream.

    A stream's memory is its filter, of one megabyte; what it takes for seen by mistake is left out.
    """
    names = df.columns
    dealt = df.withColumn("_hash", F.xxhash64(*names)).repartition(streams, "_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom()
        for batch in batches:
            fresh = [not bloom.seen(h) for h in batch.column(len(names)).to_pylist()]
            yield batch.select(list(range(len(names)))).filter(pa.array(fresh, pa.bool_()))

    ship_package(df.sparkSession)
    return dealt.mapInArrow(run, df.schema)


def builtin(df: DataFrame, key: str, epsilon: float = 0.01, confidence: float = 0.99, seed: int = 42) -> DataFrame:
    """The same sketch in Spark's own binary form."""
    return df.agg(F.count_min_sketch(key, F.lit(epsilon), F.lit(confidence), F.lit(seed)).alias("sketch"))


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The published 32-bit Murmur3, signed."""
    mask, h = 0xFFFFFFFF, seed & 0xFFFFFFFF
    c1, c2 = 0xCC9E2D51, 0x1B873593
    tail = len(data) & ~3
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * c1 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * c2 & mask
        if at < tail:
            h = (h << 13 | h >> 19) & mask
            h = h * 5 + 0xE6546B64 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        h ^= h >> shift
        h = h * factor & mask if factor else h
    return h - (1 << 32) if h >> 31 else h


def murmur3(text: Column, seed: int = 0) -> Column:
    @pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else murmur3_32(t.encode(), seed)).astype("Int32")

    return run(text)


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Exact top k with a total order; the counts are combined first and only k rows of each task are compared."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def approximate_top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Top k from one bounded summary of each task, for key spaces that do not fit a shuffle."""
    return df.agg(F.expr(f"approx_top_k({key}, {k})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias(key), F.col("t.count").alias("n"))


def pattern_aliases(df: DataFrame, text: Column, most: int = 100) -> DataFrame:
    """(pattern, alias, n, benefit): short forms for common skeleton patterns with one word, none of which the corpus holds.

    Only patterns of the first 80 % of all occurrences are asked for; the best gets the first free form.
    """
    from textloom.operators.analysis import symbol_patterns

    mined = symbol_patterns(df, text).select("pattern", "n").persist()
    try:
        one = F.length(F.regexp_replace("pattern", "[^wz]", "")) == 1
        wanted = common_part(mined.where("n > 1"), "pattern").where(one)
        # fixed values: the symbols of the short forms
        marks, pairs = "!?#_-|", ("()", "{}", "[]", "__", "--", "||")
        forms = [f"{p[0]}{m}{k}{p[1]}" for k in "wz" for p in pairs for m in marks]
        held = {r["pattern"] for r in mined.where(F.col("pattern").isin(forms)).select("pattern").collect()}
        free = df.sparkSession.createDataFrame([(f,) for f in forms if f not in held], "alias string")
        free = free.withColumn("letter", F.regexp_replace("alias", "[^wz]", "")).withColumn("k", F.row_number().over(Window.partitionBy("letter").orderBy("alias")))
        paying = wanted.withColumn("letter", F.regexp_replace("pattern", "[^wz]", "")).withColumn("benefit", F.col("n") * (F.length("pattern") - 4)).where("benefit > 0")
        best = paying.orderBy(F.desc("benefit"), "pattern").limit(most)
        best = best.withColumn("k", F.row_number().over(Window.partitionBy("letter").orderBy(F.desc("benefit"), "pattern")))
        rows = best.join(free, ["letter", "k"]).select("pattern", "alias", "n", "benefit").collect()  # at most `most`
        return df.sparkSession.createDataFrame(rows, "pattern string, alias string, n long, benefit long")
    finally:
        mined.unpersist()


def common_part(counted: DataFrame, key: str, percent: int = 80) -> DataFrame:
    """Keys in the order (n desc, key) up to the cumulative share; counted is asked several times, so that it should be persisted.

    Nothing is sorted in one place: the sums of keys by n, one row for each distinct n, tell which n is cut; of the keys
    that have it, counts by ever longer starts tell the last that is kept.
    """
    sums = sorted(((r["n"], r["s"]) for r in counted.groupBy("n").agg(F.sum("n").alias("s")).collect()), reverse=True)
    total, before = sum(s for _, s in sums), 0
    for cut, of_cut in sums:
        if 100 * (before + of_cut) >= percent * total:
            break
        before += of_cut
    else:
        return counted.select(key, "n")
    kept = -(-(percent * total - 100 * before) // (100 * cut))  # of the keys that occur so often; at least one
    alike, start, size = counted.where(F.col("n") == cut), "", 0
    while True:
        size += 1
        for row in alike.where(F.startswith(F.col(key), F.lit(start))).groupBy(F.left(key, F.lit(size)).alias("start")).count().orderBy("start").collect():
            if row["count"] >= kept:
                break
            kept -= row["count"]
        start = row["start"]
        if row["count"] == kept:
            return counted.where((F.col("n") > cut) | ((F.col("n") == cut) & (F.left(key, F.lit(size)) <= start))).select(key, "n")
