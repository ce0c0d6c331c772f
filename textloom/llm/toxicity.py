"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give scores and offsets.

Labels exist for documents only, so the training tokens are labelled from them: in a toxic training
document, a token is toxic if its word or a prefix of it occurs in far more toxic training documents than
chance allows (in how large a share of them at least, cross-validation inside the training rows decides);
all other tokens are not. The field learns from these tokens (own word, prefixes, suffix,
shape; both neighbours; transitions), its forward-backward marginals are summed up by document, and a
small logistic regression over those sums, weighted back to the true class shares, gives the score.

The model is fitted on a bounded sample: at most TRAIN_DOCS documents of each class, of at most TRAIN_BYTES
bytes each, none of them held out. Scoring covers every document and its whole text.

Defined cases: null or empty text has no tokens and gets the score of the intercept; repeated rows score
alike; a document with several labels counts with the largest; without labels of both classes every score
is 0; other columns of the input are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import crf
from textloom.llm.common import held_out, map_arrow, text_rows
from textloom.llm.quality import sample

TRAIN_DOCS = 1200
TRAIN_BYTES = 1 << 13
MEMO = 1 << 17
PREFIXES = (3, 4, 5, 6)
#: Shares of the toxic training documents in one of which a seed word must occur; which, cross-validation decides.
SHARES = (0.0025, 0.005, 0.01, 0.02, 0.04)
#: Code points of texts that are scored together.
CHUNK = 2 << 20
SIDES = "lr"
_EDGE = ".,;:!?\"'()[]{}|*%$&#-_/<>=+~`^@"


def normal(word: str) -> str:
    return word.strip(_EDGE).lower()


def own_features(word: str) -> list[tuple[str | int, str]]:
    """A token's features: (kind, value) for its word, prefixes, suffix and shape."""
    w = normal(word)
    return [("w", w), *((k, w[:k]) for k in PREFIXES if len(w) > k), ("s", w[-3:]), ("h", shape(word)), ("b", "")]


def shape(word: str) -> str:
    return ("X" if word[:1].isupper() else "x") + ("U" if len(word) > 2 and word.isupper() else "") + ("9" if any(map(str.isdigit, word)) else "")


def side_features(word: str, side: str) -> list[tuple[str | int, str]]:
    """What a token lends the next one (side l: it is the left neighbour) or the one before it (side r)."""
    w = normal(word)
    return [(side + "w", w), (side + "p", w[:4])]


class Emissions(dict):
    """Word -> its number in the lists of scores (own, as left and as right neighbour) of the toxic state over the other."""

    def __init__(self, gaps: dict[str | int, dict[str, float]]):
        self.gaps = gaps
        self.prefixes = [(k, gaps.get(k, {})) for k in PREFIXES]
        self.sides = [(gaps.get(side + "w", {}), gaps.get(side + "p", {})) for side in SIDES]
        self.bias = gaps.get("b", {}).get("", 0.0)
        self.own, self.beside = array("d"), [array("d") for _ in SIDES]

    def __missing__(self, word: str) -> int:
        w, gaps = normal(word), self.gaps
        score = self.bias + gaps["w"].get(w, 0.0) + gaps["s"].get(w[-3:], 0.0) + gaps["h"].get(shape(word), 0.0)
        size = len(w)
        for k, of in self.prefixes:
            if size > k:
                score += of.get(w[:k], 0.0)
        self.own.append(score)
        for (whole, start), scores in zip(self.sides, self.beside, strict=True):
            scores.append(whole.get(w, 0.0) + start.get(w[:4], 0.0))
        at = self[word] = len(self.own) - 1
        return at

    def clear(self) -> None:
        super().clear()
        for scores in (self.own, *self.beside):
            del scores[:]

    def scores(self, words: list[list[str]], first: np.ndarray) -> np.ndarray:
        """The score of every token of all texts; numbers hold until the next call, which may empty the lists."""
        if len(self) >= MEMO:
            self.clear()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, len(first))
        out, (left, right) = np.array(self.own)[at], (np.array(scores) for scores in self.beside)
        inside = ~first[1:]
        out[1:] += np.where(inside, left[at[:-1]], 0.0)
        out[:-1] += np.where(inside, right[at[1:]], 0.0)
        return out


def token_marginals(texts: list[str], emissions: Emissions, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The toxic probability of every token of all texts, and the number of tokens of each text."""
    words = [text.split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    first = np.zeros(total, bool)
    ends = np.cumsum(counts)
    first[(ends - counts)[counts > 0]] = True
    toxic = emissions.scores(words, first)
    p, _ = crf.marginals(np.column_stack((np.zeros(total), toxic)), first, trans, moves=False)
    return p[:, 1], counts


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of marginals by document: expected toxic tokens, their share, the surest, and the length."""
    ends = np.cumsum(counts)
    sums = np.concatenate(([0.0], np.cumsum(p)))
    mass = sums[ends] - sums[ends - counts]
    most = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, (ends - counts)[some])
    sure = np.concatenate(([0.0], np.cumsum(p > 0.5)))
    hits = sure[ends] - sure[ends - counts]
    n = np.maximum(counts, 1)
    return np.column_stack((np.log1p(mass), mass / np.sqrt(n), 10 * mass / n, most, np.log1p(hits), np.log1p(counts) / 5))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, l2: float = 1e-2) -> np.ndarray:
    """Weights of a weighted ridge logistic regression, the intercept last, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - l2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def chosen_share(docs: list[list[str]], labels: list[int], shares: tuple[float, ...] = SHARES, folds: int = 4) -> float:
    """The share for seeds() under which words learned from the other folds of the training rows find most toxic rows of each fold, less the others found; the largest of equal ones."""
    hits = dict.fromkeys(shares, 0)
    for fold in range(folds):
        inside = [i for i in range(len(docs)) if i % folds != fold]
        counts = seed_counts([docs[i] for i in inside], [labels[i] for i in inside])
        known = {share: seeds(*counts, share=share) for share in shares}
        del counts
        for i in range(fold, len(docs), folds):
            own = {w for w in map(normal, docs[i]) if w}
            own = {(0, w) for w in own} | {(k, w[:k]) for w in own for k in PREFIXES if len(w) > k}
            for share in shares:
                if not own.isdisjoint(known[share]):
                    hits[share] += 1 if labels[i] else -1
    return max(shares, key=lambda share: (hits[share], share))


def seed_counts(docs: list[list[str]], labels: list[int]) -> tuple[dict[int, Counter], tuple[int, int]]:
    """(number of documents with each word or prefix by label, numbers of toxic and of other documents)."""
    counts = {0: Counter(), 1: Counter()}
    for words, label in zip(docs, labels, strict=True):
        found = {(0, w) for w in map(normal, words) if w}
        found |= {(k, w[:k]) for _, w in list(found) for k in PREFIXES if k > 3 and len(w) > k}
        counts[label].update(found)
    return counts, (max(1, sum(labels)), max(1, len(labels) - sum(labels)))


def seeds(counts: dict[int, Counter], n: tuple[int, int], share: float, least: int = 4, sigmas: float = 4.5) -> set[tuple[int, str]]:
    """(prefix length or 0, text) of words and prefixes far more common in toxic documents than elsewhere.

    One must be in a share of the toxic documents, as rare words of a few copies of one text are no evidence.
    """
    least = max(least, math.ceil(share * n[0]))
    out = set()
    for key, a in counts[1].items():
        expected = (counts[0][key] + 0.5) / n[1] * n[0]
        if a >= least and a > 4 * expected and (a - expected) / np.sqrt(expected) >= sigmas:
            out.add(key)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict | None:
    """The model, fitted on the driver over the bounded sample; None without labels of both classes."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    shares = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    both = sample(docs, labels, label, TRAIN_DOCS, TRAIN_BYTES, F.col("label") == 1).unionAll(sample(docs, labels, label, TRAIN_DOCS, TRAIN_BYTES, F.col("label") == 0))
    rows = sorted(both.select("doc_id", "text", "label").toArrow().to_pylist(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    y = [int(r["label"] > 0) for r in rows]
    if len({*y}) < 2:
        return None
    words = [r["text"].split() for r in rows]
    toxic = seeds(*seed_counts(words, y), share=chosen_share(words, y))
    numbers: dict[tuple[str | int, str], int] = {}
    known: dict[str, int] = {}
    places = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(words)), np.int32)
    width = len(PREFIXES) + 4
    table, seeded = np.zeros((len(known), width + 4), np.int32), np.zeros(len(known), bool)
    for w, at in known.items():
        n = normal(w)
        own, left, right = ([numbers.setdefault(f, len(numbers) + 1) for f in of] for of in (own_features(w), *(side_features(w, side) for side in SIDES)))
        table[at, : len(own)], table[at, width:] = own, left + right
        seeded[at] = (0, n) in toxic or any((k, n[:k]) in toxic for k in PREFIXES if len(n) > k)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    first = np.zeros(len(places), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    tags = (seeded[places] & (np.repeat(y, counts) > 0)).astype(np.int8)
    feats = table[places]
    feats[:, width:] = 0
    feats[1:, width : width + 2] = np.where(first[1:, None], 0, table[places[:-1], width : width + 2])
    feats[:-1, width + 2 :] = np.where(first[1:, None], 0, table[places[1:], width + 2 :])
    del words, known, table
    weights, trans = crf.fit(feats, tags, first, 2, len(numbers) + 1)
    del feats, tags, first
    gap = weights[:, 1] - weights[:, 0]
    gaps: dict[str | int, dict[str, float]] = {kind: {} for kind in ("w", "s", "h", "b", *PREFIXES, *(side + of for side in SIDES for of in "wp"))}
    for (kind, value), at in numbers.items():
        gaps[kind][value] = float(gap[at])
    emissions = Emissions(gaps)
    x = document_features(*token_marginals([r["text"] for r in rows], emissions, trans))
    y = np.array(y, float)
    weight = np.where(y > 0, shares.get(1, 1) / y.sum(), shares.get(0, 1) / (1 - y).sum())
    return {"gaps": gaps, "trans": trans, "document": logistic(x, y, weight / weight.mean())}


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, spans: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; with spans also the offending offsets.

    spans: array of (start, end, p) in code points, end exclusive, one for each run of tokens with p > 0.5.
    """
    model = train(docs, labels, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample only
    held: list[Emissions] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = batch.column(1).to_pylist(), shared.value
        scores, found = [], []
        for part in _chunks(texts):
            if model is None:
                scores += [0.0] * len(part)
                found += [[]] * len(part)
                continue
            if not held:
                held.append(Emissions(model["gaps"]))
            p, counts = token_marginals(part, held[0], model["trans"])
            x = document_features(p, counts)
            scores += (1 / (1 + np.exp(-np.clip(x @ model["document"][:-1] + model["document"][-1], -30, 30)))).tolist()
            if spans:
                at = 0
                for text, n in zip(part, counts, strict=True):
                    found.append(toxic_spans(text, p[at : at + n]))
                    at += n
        columns = [batch.column(0), pa.array(scores, pa.float64())]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            return pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], ["doc_id", "score", "spans"])
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "score"])

    rows = text_rows(docs)
    more = ", spans array<struct<start:int,end:int,p:double>>" if spans else ""
    scored = map_arrow(rows, run, f"doc_id {rows.dtypes[0][1]}, score double{more}", lambda: held[0] if held else {})
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["spans"] if spans else []))


def toxic_spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal over 0.5."""
    out: list[dict] = []
    hits = np.flatnonzero(p > 0.5)
    if not len(hits):
        return out
    before = False
    for m, x in zip(re.finditer(r"\S+", text), p[: hits[-1] + 1].tolist()):  # noqa: B905  no token after the last hit matters
        if x > 0.5 and before:
            out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], x)}
        elif x > 0.5:
            out.append({"start": m.start(), "end": m.end(), "p": x})
        before = x > 0.5
    return out
