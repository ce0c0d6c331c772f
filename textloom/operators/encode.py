"""Physical encoders: packed characters, dictionary codes by first appearance, sizes of integer columns."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def pack(text: str) -> bytes:
    """Length and alphabet, then the index of each character in as many bits as the alphabet needs."""
    alphabet = list(dict.fromkeys(text))
    number = {c: i for i, c in enumerate(alphabet)}
    bits = max(1, (len(alphabet) - 1).bit_length())
    indexes = np.fromiter((number[c] for c in text), np.uint32, len(text))
    packed = np.packbits((indexes[:, None] >> np.arange(bits, dtype=np.uint32)[::-1]) & 1) if len(text) else np.zeros(0, np.uint8)
    names = "".join(alphabet).encode("utf-32-be", "surrogatepass")
    return len(text).to_bytes(4, "big") + len(alphabet).to_bytes(4, "big") + names + packed.astype(np.uint8).tobytes()


def unpack(data: bytes) -> str:
    size, card = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
    alphabet = data[8 : 8 + 4 * card].decode("utf-32-be", "surrogatepass")
    bits = max(1, (card - 1).bit_length())
    flat = np.unpackbits(np.frombuffer(data[8 + 4 * card :], np.uint8))[: size * bits].reshape(size, bits)
    at = flat.astype(np.int64) @ (1 << np.arange(bits)[::-1]) if size else []
    return "".join(alphabet[i] for i in at)


def pack_chars(text: Column) -> Column:
    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pack(t))

    return run(text)


def unpack_chars(data: Column) -> Column:
    @pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda d: None if d is None else unpack(d))

    return run(data)


def deflated_size(text: Column, level: int = 9) -> Column:
    """Bytes after a general-purpose compressor, per row."""

    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(zlib.compress(t.encode(), level))).astype("Int64")

    return run(text)


def dict_encode(df: DataFrame, order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(facts with a code, dimension (code, value)): codes count values in the order of their first appearance.

    The window that numbers the values sees one row for each distinct value, not the facts.
    """
    firsts = df.groupBy(value).agg(F.min(order).alias("first"))
    dimension = firsts.select((F.row_number().over(Window.orderBy("first", value)) - 1).cast("int").alias("code"), value)
    return df.join(dimension, df[value].eqNullSafe(dimension[value])).select(*(df[c] for c in df.columns if c != value), "code"), dimension


def int_column_bits(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, rows, plain_bytes, packed_bits): 4 bytes a value against the bits that the range of a column needs."""
    aggs = [F.struct(F.lit(c).alias("name"), F.count(c).alias("rows"), (F.max(c) - F.min(c)).cast("long").alias("span")).alias(c) for c in columns]
    one = df.agg(*aggs).select(F.explode(F.array(*columns)).alias("x")).select("x.*")
    bits = F.ceil(F.log2(F.greatest(F.col("span") + 1, F.lit(2)).cast("double"))).cast("long")
    return one.select("name", "rows", (4 * F.col("rows")).alias("plain_bytes"), (bits * F.col("rows")).alias("packed_bits"))
