"""Codec: an invertible column transformation by name; a pipeline of them is one too."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import codecs as C
from textloom.functions.primitives import first_difference
from textloom.operators import backref, bwt
from textloom.session import ship_package

REGISTRY: dict[str, Codec] = {}


@dataclass(frozen=True)
class Codec:
    """forward and inverse map a text column to a text column; python marks those that need Arrow batches."""

    name: str
    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    python: bool = False

    def apply(self, df: DataFrame, column: str = "text") -> DataFrame:
        if self.python:
            ship_package(df.sparkSession)
        return df.withColumn(column, self.forward(F.col(column)))

    def invert(self, df: DataFrame, column: str = "text") -> DataFrame:
        if self.python:
            ship_package(df.sparkSession)
        return df.withColumn(column, self.inverse(F.col(column)))


def register(codec: Codec) -> Codec:
    REGISTRY[codec.name] = codec
    return codec


for _codec in (
    Codec("html_unescape", C.html_unescape, C.html_escape),
    Codec("sentence_case", C.sentence_lc, C.sentence_uc),
    Codec("auto_close", C.auto_close, C.auto_close_inverse),
    Codec("skip_brackets", C.skip_brackets, C.skip_brackets_inverse),
    Codec("char_escape", C.char_escape, C.char_unescape),
    Codec("word_backref", lambda c: backref.per_row(backref.encode_words)(c), lambda c: backref.per_row(backref.decode_words)(c), True),
    Codec("stem_backref", lambda c: backref.per_row(backref.encode_stems)(c), lambda c: backref.per_row(backref.decode_stems)(c), True),
    Codec("bwt", lambda c: backref.per_batch(bwt.encode_all)(c), lambda c: backref.per_batch(bwt.decode_all)(c), True),
):
    register(_codec)


@dataclass
class Pipeline:
    """Codecs one after the other; the inverse runs backwards. One projection chain, no shuffle."""

    stages: Sequence[Codec]
    column: str = "text"
    sizes: list[str] = field(default_factory=list)

    def forward(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.apply(df, self.column)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for stage in reversed(self.stages):
            df = stage.invert(df, self.column)
        return df

    def stage_sizes(self, df: DataFrame) -> DataFrame:
        """(stage, rows, bytes) before the first stage and after each, in one scan."""
        now, columns = df.select(F.col(self.column).alias("s0")), ["s0"]
        for at, stage in enumerate(self.stages, 1):
            if stage.python:
                ship_package(df.sparkSession)
            now = now.withColumn(f"s{at}", stage.forward(F.col(f"s{at - 1}")))
            columns.append(f"s{at}")
        sums = now.agg(F.count("*").alias("rows"), *(F.sum(F.octet_length(c)).alias(c) for c in columns))
        names = ["input", *(s.name for s in self.stages)]
        return sums.select("rows", F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(c).alias("bytes")) for n, c in zip(names, columns, strict=True)))).alias("x")).select("x.stage", "rows", "x.bytes")


def roundtrip_check(df: DataFrame, codec: Codec, id_col: str, column: str = "text") -> DataFrame:
    """(id, same, first_difference) of what comes back from the inverse; 0 where nothing differs."""
    if codec.python:
        ship_package(df.sparkSession)
    back = df.select(id_col, F.col(column).alias("a"), codec.inverse(codec.forward(F.col(column))).alias("b"))
    return back.select(id_col, F.col("a").eqNullSafe(F.col("b")).alias("same"), F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(first_difference(F.col("a"), F.col("b"))).cast("int").alias("first_difference"))
