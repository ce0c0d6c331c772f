"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A document's features are its word unigrams and bigrams and those of its words' shapes (runs of letters,
capitals and digits; other characters stay), hashed into 2**BITS bins. A feature's value is its share of
the document's n-grams, so the score is one sparse dot product, taken over the whole text.

The model is fitted on a bounded sample: at most TRAIN_DOCS labelled documents of at most TRAIN_BYTES
bytes each, in the order of a hash of the id, none of them held out. Scoring covers every document.

Defined cases: null or empty text scores the bias alone; repeated rows score alike; a document with
several labels counts with the largest; without usable labels every score is 0.5 and accept() rejects
nothing; other columns of the input, even with clashing names, are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import held_out, map_arrow, text_rows

BITS = 18
TRAIN_DOCS = 3000
TRAIN_BYTES = 1 << 15
EPOCHS = 4
#: An n-gram's share of a document is small; this keeps the dot products of a useful size.
SCALE = 40.0
MEMO = 1 << 17
_REPEAT = 0x9E3779B1


class WordHashes(dict):
    """Word -> hash of the word in the upper half, of its shape in the lower; emptied before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        shape, last = [], ""
        for c in word:
            kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
            if kind != last:
                shape.append(kind)
                last = kind
        found = self[word] = zlib.crc32(word.encode()) << 32 | zlib.crc32("".join(shape).encode())
        return found


_hashes = WordHashes()


def memo() -> dict:
    return _hashes


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature bins of all texts in one array of shape (4, words), and the number of words of each text."""
    words = [text.split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    both = np.fromiter((_hashes[w] for of in words for w in of), np.uint64, total)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    first = np.zeros(total, bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    before_word = np.where(first, np.uint64(1), np.roll(word, 1))
    before_shape = np.where(first, np.uint64(1), np.roll(shape, 1))
    before_shape = np.where(before_word == word, np.uint64(_REPEAT), before_shape)  # a repeated word is a class of its own
    out = np.empty((4, total), np.int32)
    for k, (a, b) in enumerate(((word, 0), (word, before_word), (shape, 0), (shape, before_shape))):
        mixed = (a + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        out[k] = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int32)
    return out, counts


def margins(texts: list[str], weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """The dot product of each text's features with the weights, plus the bias."""
    bins, counts = features(texts, bits)
    sums = np.concatenate(([0.0], np.cumsum(weights[bins].sum(axis=0, dtype=np.float64))))
    ends = np.cumsum(counts)
    return bias + SCALE * (sums[ends] - sums[ends - counts]) / np.maximum(4 * counts, 1)


class Ftrl:
    """FTRL-Proximal for logistic loss; weights are a function of z and n."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, limit_bytes: int, value: Column | None = None) -> DataFrame:
    """At most `most` labelled documents (doc_id, text, label) that are not held out, by a hash of the id.

    Only ids and labels are sorted and broadcast, at most `most` of them, so the broadcast has a fixed
    bound; an id that many rows share gives one text, so the sample has one too.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    if value is not None:
        known = known.where(value)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = text_rows(docs).where(F.octet_length("text") <= limit_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float] | None:
    """(weights, bias) fitted on the driver over sparse features that the executors make; None without labelled documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        bins, counts = features(texts)
        ends = np.cumsum(counts)
        at, share = [], []
        for end, count in zip(ends, counts, strict=True):
            own, times = np.unique(bins[:, end - count : end], return_counts=True)
            at.append(own.astype(np.int32))
            share.append((times * (SCALE / max(4 * count, 1))).astype(np.float32))
        columns = [batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "at", "share"])

    chosen = sample(docs, labels, label, TRAIN_DOCS, TRAIN_BYTES).select("doc_id", "text", "label")
    rows = map_arrow(chosen, run, f"doc_id {chosen.dtypes[0][1]}, label int, at array<int>, share array<float>", memo).toArrow()
    if not rows.num_rows:
        return None
    model = Ftrl()
    order = sorted(range(rows.num_rows), key=lambda i: (zlib.crc32(str(rows.column(0)[i].as_py()).encode()), i))
    each = [(rows.column(2)[i].values.to_numpy(), rows.column(3)[i].values.to_numpy().astype(float), float(rows.column(1)[i].as_py())) for i in order]
    for _ in range(EPOCHS):
        for at, share, y in each:
            model.update(at, share, y)
    found = model.weights()
    return found[:-1].astype(np.float32), float(found[-1])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    fitted = train(docs, labels, label) or (np.zeros(1 << BITS, np.float32), 0.0)
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # 2**BITS floats: 1 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = 1 / (1 + np.exp(-np.clip(margins(batch.column(1).to_pylist(), *model.value), -35, 35)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = text_rows(docs)
    scored = map_arrow(rows, run, f"doc_id {rows.dtypes[0][1]}, score double", memo)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    fitted = train(docs, labels, label)
    if fitted is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column(at).to_pylist()]
        p = 1 / (1 + np.exp(-np.clip(margins(texts, *model.value), -35, 35)))
        return batch.filter(pa.array(p >= threshold))

    return map_arrow(docs, run, docs.schema, memo)
