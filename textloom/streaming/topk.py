"""A randomised bounded top-k summary of a stream, kept in Spark's state store.

Below capacity every key counts. Then a known key is incremented; an unknown one either goes to the trash
counter, in proportion to what is there, or takes one from a kept key, whose place it gets at zero.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.session import ship_package


class TopK:
    def __init__(self, capacity: int, seed: int = 42, counts: dict[str, int] | None = None, trash: int = 0):
        self.capacity, self.counts, self.trash = capacity, counts or {}, trash
        self.rng = random.Random(seed + trash + sum(self.counts.values()))

    def add(self, key: str) -> None:
        counts = self.counts
        if key in counts or len(counts) < self.capacity:
            counts[key] = counts.get(key, 0) + 1
            return
        if self.rng.randrange(sum(counts.values()) + self.trash) < self.trash:
            self.trash += 1
            return
        out = sorted(counts)[self.rng.randrange(len(counts))]
        counts[out] -= 1
        if counts[out] == 0:
            del counts[out]
            counts[key] = 1
            self.trash += 1


def stream_top_k(stream: DataFrame, group: str, key: str, capacity: int, seed: int = 42) -> DataFrame:
    """(group, key, n) after each micro-batch; state holds at most `capacity` keys a group."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, counts, trash = state.get if state.exists else ([], [], 0)
        top = TopK(capacity, seed, dict(zip(keys, counts, strict=True)), trash)
        for batch in batches:
            for value in batch[key].dropna():
                top.add(str(value))
        state.update((list(top.counts), list(top.counts.values()), top.trash))
        yield pd.DataFrame({group: [str(name[0])] * len(top.counts), key: list(top.counts), "n": list(top.counts.values())})

    return stream.groupBy(group).applyInPandasWithState(update, f"{group} string, {key} string, n long", "keys array<string>, counts array<long>, trash long", "update", GroupStateTimeout.NoTimeout)


def summaries(df: DataFrame, key: str, order: str, capacity: int, streams: int = 16, seed: int = 42) -> DataFrame:
    """(stream, key, n): the summary of each of some streams of a table, dealt by the key and read in an order; memory follows the capacity."""
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(streams)).cast("int").alias("stream"), F.col(key).cast("string").alias(key), order)
    rows = rows.where(F.col(key).isNotNull()).repartition(streams, "stream").sortWithinPartitions("stream", order, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, top = None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"stream": [at] * len(top.counts), key: list(top.counts), "n": list(top.counts.values())})

        for batch in batches:
            for stream, value in zip(batch["stream"].tolist(), batch[key].tolist(), strict=True):
                if stream != at:
                    if top is not None:
                        yield out()
                    at, top = stream, TopK(capacity, seed)
                top.add(value)
        if top is not None:
            yield out()

    ship_package(df.sparkSession)
    return rows.mapInPandas(run, f"stream int, {key} string, n long")
