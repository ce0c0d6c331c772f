"""A Count-Min sketch of a stream in Spark's state store: add, then estimate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.sketch import murmur3_32, shape


class CountMin:
    """Cells of a sketch; two of the same shape add up."""

    def __init__(self, width: int, depth: int, cells: list[int] | None = None):
        self.width, self.depth = width, depth
        self.cells = np.zeros((depth, width), np.int64) if cells is None else np.array(cells, np.int64).reshape(depth, width)

    def _places(self, key: str) -> np.ndarray:
        data = key.encode()
        first, second = murmur3_32(data, 0), murmur3_32(data, 0x9747B28C)
        return (first + np.arange(1, self.depth + 1) * second) % self.width

    def add(self, key: str, count: int = 1) -> int:
        """The estimate of a key after it was counted."""
        at = np.arange(self.depth), self._places(key)
        self.cells[at] += count
        return int(self.cells[at].min())

    def estimate(self, key: str) -> int:
        return int(self.cells[np.arange(self.depth), self._places(key)].min())

    def merge(self, other: CountMin) -> CountMin:
        if (self.width, self.depth) != (other.width, other.depth):
            raise ValueError("sketches of different shapes do not add up")
        return CountMin(self.width, self.depth, (self.cells + other.cells).ravel().tolist())

    def to_bytes(self) -> bytes:
        """Width, depth and cells as big-endian integers."""
        return np.concatenate(([self.width, self.depth], self.cells.ravel())).astype(">i4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountMin:
        width, depth, *cells = np.frombuffer(data, ">i4").tolist()
        return cls(width, depth, cells)


def stream_estimates(stream: DataFrame, group: str, key: str, epsilon: float = 0.01, delta: float = 0.01) -> DataFrame:
    """(group, key, estimate) of the keys of each micro-batch; the state of a group has a fixed size."""
    width, depth = shape(epsilon, delta)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sketch = CountMin.from_bytes(state.get[0]) if state.exists else CountMin(width, depth)
        seen: dict[str, int] = {}
        for batch in batches:
            for value, count in batch[key].dropna().astype(str).value_counts(sort=False).items():
                seen[value] = sketch.add(value, int(count))
        state.update((sketch.to_bytes(),))
        yield pd.DataFrame({group: [str(name[0])] * len(seen), key: list(seen), "estimate": list(seen.values())})

    return stream.groupBy(group).applyInPandasWithState(update, f"{group} string, {key} string, estimate long", "sketch binary", "update", GroupStateTimeout.NoTimeout)
