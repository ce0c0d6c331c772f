"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.session import ship_package

#: Rows and bytes of a part of an Arrow batch that is worked on at a time; one long text may be larger.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under sf_dir, which may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one set here (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='textloom-checkpoint-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: lineage ends there, and lost executors cost nothing.

    On the way to Python, Arrow batches are no larger than what is worked on at a time: ten thousand rows with
    the sets of both documents of a pair would be a hundred megabytes in the JVM and again in the worker.
    """
    shared_dir(df.sparkSession)
    with arrow_batches(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of about that many rows and bytes for what runs inside; the session's own settings are put back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, most in wanted.items():
            spark.conf.set(name, most)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, halved until they are small enough."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: "str | StructType", memo: Callable[[], dict] | None = None) -> DataFrame:
    """function over bounded slices of Arrow batches; the dictionary that memo gives is emptied after each partition.

    Python workers serve one stage after the other, so what a stage has remembered must not stay with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch):
                    made = function(part)
                    yield from made.to_batches() if isinstance(made, pa.Table) else (made,)
        finally:
            if memo is not None:
                memo().clear()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with no null text; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels no model may learn: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
