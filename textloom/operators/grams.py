"""Counts of substrings, in Arrow batches: a part of the corpus is sorted as numbers, and Spark adds up the parts.

A part is some rows' characters, each row followed by a mark; a substring is one number, its characters' codes as digits.
Where a number would not fit 63 bits, the numbers so far are replaced by their ranks among the part's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import ship_package

#: Bytes of text in a part; a longer text is a part by itself.
PART_BYTES = 4 << 20
_TOP = 1 << 63


def parts(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, whatever their sizes, in parts of about so many bytes of a text column."""
    held, size = [], 0
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(int(np.searchsorted(ends, before + most - size, "right")), at if held else at + 1)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - before)
            if upto < batch.num_rows:
                yield _one(held)
                held, size = [], 0
            at = upto
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


class Part:
    """The characters of some texts as numbers 1 to base - 1, each text followed by 0."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = offsets[1:].astype(np.int64) - (offsets[0] if len(texts) else 0)
        if len(points) != len(data):
            ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[ends]
        present = np.zeros(0x110000, np.bool_)
        present[points] = True
        self.alphabet = np.concatenate(([0], np.flatnonzero(present))).astype(np.uint32)
        self.base = len(self.alphabet)
        number = np.zeros(0x110000, np.int64)
        number[self.alphabet[1:]] = np.arange(1, self.base)
        self.codes = np.zeros(len(points) + len(ends), np.int64)
        #: Where each text begins and where its mark is.
        self.marks = ends + np.arange(len(ends))
        self.starts = np.concatenate(([0], self.marks[:-1] + 1)) if len(ends) else self.marks
        letters = np.ones(len(self.codes), np.bool_)
        letters[self.marks] = False
        self.codes[letters] = number[points]

    def keys(self, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, list]]:
        """(size, number of the substring at each place, the ranks behind the numbers) for each size, ascending."""
        keys, top, ranks = self.codes, self.base, []
        for size in range(1, max(sizes) + 1):
            if size > 1:
                if top * self.base >= _TOP:
                    seen, keys = np.unique(keys, return_inverse=True)
                    ranks, top = [*ranks, (size - 1, seen)], len(seen)
                keys = keys[:-1] * self.base + self.codes[size - 1 :]
                top *= self.base
            if size in sizes:
                yield size, keys, ranks

    def points(self, keys: np.ndarray, size: int, ranks: list) -> np.ndarray:
        """The codes of each number's characters, a row each."""
        out, behind = np.empty((len(keys), size), np.int64), dict(ranks)
        for at in range(size - 1, -1, -1):
            if at + 1 in behind and at + 1 < size:
                keys = behind[at + 1][keys]
            out[:, at] = keys % self.base
            keys = keys // self.base
        return out

    def strings(self, codes: np.ndarray) -> pa.Array:
        points = self.alphabet[codes]
        sizes = (1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)).sum(1)
        data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def overlapping(keys: np.ndarray, size: int) -> dict[int, int]:
    """How many of a number's places are lost if, from the left, none may overlap the one before; only those that lose any."""
    touched = np.zeros(len(keys), np.bool_)
    for d in range(1, min(size, len(keys))):
        same = keys[d:] == keys[:-d]
        touched[d:] |= same
        touched[: len(keys) - d] |= same
    places = np.flatnonzero(touched)
    lost: dict[int, int] = {}
    free: dict[int, int] = {}
    for place, key in zip(places.tolist(), keys[places].tolist()):  # noqa: B905
        if place < free.get(key, 0):
            lost[key] = lost.get(key, 0) + 1
        else:
            free[key] = place + size
    return lost


def tallied(part: Part, sizes: Sequence[int], apart: bool = False) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(substrings, counts) of each size; apart counts occurrences in a text that do not overlap, from the left."""
    for size, keys, ranks in part.keys(sizes):
        found, n = tally(keys)
        if apart and size > 1:
            lost = overlapping(keys, size)
            n[np.searchsorted(found, list(lost))] -= np.fromiter(lost.values(), np.int64, len(lost))
        codes = part.points(found, size, ranks)
        whole = (codes > 0).all(1)
        yield part.strings(codes[whole]), n[whole]


def counted(df: DataFrame, text: Column, sizes: Sequence[int], name: str = "gram", apart: bool = False) -> DataFrame:
    """(name, n): the substrings of those lengths and how often each occurs, or how often without overlap in a row."""
    sizes = tuple(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for strings, n in tallied(Part(batch.column(0)), sizes, apart):
                yield pa.RecordBatch.from_arrays([strings, pa.array(n, pa.int64())], [name, "n"])

    ship_package(df.sparkSession)
    return df.select(text.alias("t")).where("t <> ''").mapInArrow(run, f"{name} string, n long").groupBy(name).agg(F.sum("n").alias("n"))


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A number for the substring of that size at each place; equal ones have equal numbers."""
    out = np.zeros(max(0, len(points) - size + 1), np.uint64)
    for at in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[at : at + len(out)]
    return out


def places_of(points: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows of wanted) where a row of wanted, of points too, begins; found by a hash, then compared."""
    size = wanted.shape[1]
    known = np.array([_hashes(row, size)[0] for row in wanted])
    order = np.argsort(known)
    known = known[order]
    hashes = _hashes(points, size)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    places = np.flatnonzero(known[at] == hashes)
    which = order[at[places]]
    same = np.ones(len(places), np.bool_)
    for k in range(size):
        same &= points[places + k] == wanted[which, k]
    return places[same], which[same]


def tallied_after(part: Part, begun: Sequence[str], sizes: Sequence[int]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """As tallied(), for those substrings alone, longer than each of begun by at least one, that begin with one of these, all of one length."""
    points = np.where(part.codes > 0, part.alphabet[part.codes].astype(np.uint64) + 1, 0).astype(np.uint64)
    wanted = np.array([[ord(c) + 1 for c in b] for b in begun], np.uint64)
    places, keys = places_of(points, wanted)
    top = len(begun)
    for size in range(len(begun[0]) + 1, max(sizes) + 1):
        after = part.codes[places + size - 1]  # a mark follows each text, and what has met one is gone
        places, keys = places[after > 0], keys[after > 0]
        if top * part.base >= _TOP:
            seen, keys = np.unique(keys, return_inverse=True)
            top = len(seen)
        keys, top = keys * part.base + after[after > 0], top * part.base
        if size in sizes and len(keys):
            _, first, n = np.unique(keys, return_index=True, return_counts=True)
            yield part.strings(part.codes[places[first][:, None] + np.arange(size)]), n


def counted_after(df: DataFrame, text: Column, begun: Sequence[str], sizes: Sequence[int], name: str = "gram") -> DataFrame:
    """As counted(), for those substrings alone that begin with one of begun."""
    sizes, begun = tuple(sizes), list(begun)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for strings, n in tallied_after(Part(batch.column(0)), begun, sizes):
                yield pa.RecordBatch.from_arrays([strings, pa.array(n, pa.int64())], [name, "n"])

    ship_package(df.sparkSession)
    return df.select(text.alias("t")).where("t <> ''").mapInArrow(run, f"{name} string, n long").groupBy(name).agg(F.sum("n").alias("n"))


def apart(places: np.ndarray, size: int) -> np.ndarray:
    """Of ascending places of a substring of that size, those that do not overlap one taken before, from the left."""
    close = np.diff(places) < size
    if not close.any():
        return places
    taken = np.ones(len(places), np.bool_)
    free = 0
    for k in np.flatnonzero(np.concatenate((close, [False])) | np.concatenate(([False], close))).tolist():
        if places[k] < free:
            taken[k] = False
        else:
            free = places[k] + size
    return places[taken]
