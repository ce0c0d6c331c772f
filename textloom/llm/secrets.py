"""Secret scans: base patterns, and a linear-chain conditional random field that adds what they miss.

The field tags white-space tokens as secret begin, inside or outside from their shape, the neighbouring
words and features of the whole file, decoded by Viterbi over each whole text. It learns from the whole base
matches, keyword to value, of a bounded sample: TRAIN_DOCS documents of at most TRAIN_BYTES bytes, in the
order of a hash of the id, of which all with base spans and the first TRAIN_PLAIN others are fitted. Each of
them is seen twice: as it is, and either without its neighbours or without the details of its own shape, so
that the field does not lean on the keywords of the base patterns but knows shapes and contexts by
themselves. It never removes a base span. hidden_kind() measures what it finds of a kind that it has not seen.

Defined cases: null or empty text has no spans; spans are in code points, end exclusive; base spans of
different kinds may overlap, an added span overlaps no base span; repeated rows give repeated rows; if the
sample holds no base span the field adds nothing; other columns of the input stay out (redact() keeps all
columns as they are, except text and n_chars).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import crf
from textloom.llm.common import map_arrow, text_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is what is left of [0-9a-f]+ when short matches are dropped
KINDS = ("assign", "access", "hex", "crf")
OUT, BEGIN, INSIDE = range(3)
#: Bounds of the sample that the field is fitted on: documents, those without base spans, bytes of a document.
TRAIN_DOCS = 3000
TRAIN_PLAIN = 300
TRAIN_BYTES = 1 << 13
BITS = 15
#: Shortest core of an added span.
LEAST = 8
MEMO, MEMO_CHARS = 1 << 17, 64
CHUNK = 2 << 20
_CORE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: What names the secret at the head of a tagged run; a secret must follow.
_LEAD = re.compile(r"""["']?[A-Za-z_][\w-]*["']?\s*[:=]\s*(?=["']?[A-Za-z0-9+/_.=-]{8})""")
_CONTEXT = frozenset("password passwd secret token api_key apikey key auth bearer credential credentials passphrase private access pwd login user".split())
#: A named value that no base pattern may know: a text with one, and without base spans, is no example of plain text.
_NAMED = re.compile(rf"""\b(?:{"|".join(sorted(_CONTEXT))})["']?\s*[:=]\s*["']?[A-Za-z0-9+/_.=-]{{8}}""", re.I)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself), by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def _bin(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) % ((1 << BITS) - 1) + 1


def signature(word: str) -> str:
    """A token's class: ordinary words by length and case, all others by shape, alphabet, length and entropy."""
    core = word.strip(".,;:!?\"'()[]{}|")
    low = core.lower()
    if low in _CONTEXT:
        return "k" + low
    if core.isalpha():
        return f"a{min(len(core), 24) // 6}{core[:1].isupper():d}{len(core) > 1 and core.isupper():d}{core.isascii():d}"
    if not core:
        return "p" + word[:4]
    inner = max(_CORE.findall(core), key=len, default="")
    kinds = "".join(k for k, p in (("l", r"[a-z]"), ("u", r"[A-Z]"), ("d", r"\d"), ("s", r"[+/_.=-]")) if re.search(p, inner))
    hexed = re.fullmatch(r"[0-9a-fA-F]+", inner) is not None
    times = Counter(inner)
    bits = -sum(n / len(inner) * math.log2(n / len(inner)) for n in times.values()) if inner else 0
    return f"s{kinds}{hexed:d}{min(len(inner), 64) // 4}e{int(bits)}{'q' if word[:1] in '\"' + chr(39) else ''}{'=' if re.search('[=:].', core) else ''}{inner[:4] if inner[:4].isupper() else ''}"


class Signatures(dict):
    """Word -> number of its signature. Words are forgotten when many, long ones at once; signatures are few and stay."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        name = signature(word)
        at = self.numbers.get(name)
        if at is None:
            at = self.numbers[name] = len(self.names)
            self.names.append(name)
        if len(word) <= MEMO_CHARS:
            self[word] = at
        return at


def bins(name: str) -> list[int]:
    """Feature bins of a signature: for the token itself, for the token after it, the one after that, and the one before."""
    if name[0] == "k":
        name = "k"  # words of credentials are one class, so that a name without base spans may head a secret
    short = name if name[0] in "kp" else name[:6]
    return [_bin("o", name), _bin("c", name.split("e")[0]), _bin("1", short), _bin("2", short), _bin("r", short)]


FILE_BINS = 8


def file_class(numbers: np.ndarray, odd: np.ndarray) -> int:
    """Which of FILE_BINS kinds of file this is: by length and by the share of tokens that are no ordinary words."""
    share = odd[numbers].mean() if len(numbers) else 0.0
    return int(len(numbers) > 200) * 4 + min(3, int(share * 20))


def _matrix(texts: list[str], known: Signatures) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature numbers, counts, sequence starts and file class of every token."""
    words = [text.split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    numbers = np.fromiter((known[w] for of in words for w in of), np.int64, total)
    first = np.zeros(total, bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    odd = np.array([n[0] == "s" for n in known.names] or [False])
    files = np.repeat([file_class(numbers[s : s + n], odd) for s, n in zip(starts, counts, strict=True)], counts).astype(np.int64)
    return numbers, counts, first, files


def _scores(weights: np.ndarray, table: np.ndarray, numbers: np.ndarray, first: np.ndarray, files: np.ndarray) -> np.ndarray:
    """(tokens, 3) emission scores; table: bins of each signature."""
    own = weights[table[:, 0]] + weights[table[:, 1]]
    out = own[numbers] + weights[1 + files]
    if len(numbers):
        one, two, right = (weights[table[:, k]][numbers] for k in (2, 3, 4))
        inside = ~first[1:]
        out[1:][inside] += one[:-1][inside]
        out[:-1][inside] += right[1:][inside]
        both = inside[1:] & inside[:-1]
        out[2:][both] += two[:-2][both]
    return out


def train(docs: DataFrame, hidden_kind: str | None = None) -> dict | None:
    """The field, fitted on the driver over the bounded sample; None if the sample has no base span.

    Spans of hidden_kind teach nothing: documents with one that no other kind covers stay out.
    """
    small = text_rows(docs).where(F.octet_length("text") <= TRAIN_BYTES)
    order = F.xxhash64("doc_id")
    chosen = small.select("doc_id", order.alias("order")).orderBy("order", "doc_id").limit(TRAIN_DOCS).distinct()  # only ids are sorted and broadcast
    found = small.join(F.broadcast(chosen), "doc_id").groupBy("order", "doc_id").agg(F.min("text").alias("text"))  # one text for an id that many rows share
    rows = found.select("order", "doc_id", "text").collect()
    texts = [r["text"] for r in sorted(rows, key=lambda r: (r["order"], r["doc_id"], r["text"]))[:TRAIN_DOCS]]
    spans = [base_spans(t) for t in texts]
    if hidden_kind is not None:
        seen = [[s for s in own if s[2] != hidden_kind] for own in spans]
        whole = [i for i, own in enumerate(spans) if all(any(s[0] < h[1] and s[1] > h[0] for s in seen[i]) for h in own)]
        texts, spans = [texts[i] for i in whole], [seen[i] for i in whole]
    plain = [i for i, s in enumerate(spans) if not s and not _NAMED.search(texts[i])][:TRAIN_PLAIN]
    chosen = sorted([i for i, s in enumerate(spans) if s] + plain)
    if len(chosen) == len(plain):
        return None
    texts, spans = [texts[i] for i in chosen], [spans[i] for i in chosen]
    known = Signatures()
    numbers, counts, first, files = _matrix(texts, known)
    tags = []
    for text, own in zip(texts, spans, strict=True):
        last = None
        for m in re.finditer(r"\S+", text):
            hit = next((s for s in own if s[0] < m.end() and s[1] > m.start()), None)
            tags.append(OUT if hit is None else INSIDE if last is not None and last[0] <= hit[0] < last[1] else BEGIN)
            last = hit
    table = np.array([bins(n) for n in known.names], np.int64)
    pad = np.zeros(len(numbers), np.int64)
    one, two, right = pad.copy(), pad.copy(), pad.copy()
    inside = ~first[1:]
    one[1:] = np.where(inside, table[numbers[:-1], 2], 0)
    right[:-1] = np.where(inside, table[numbers[1:], 4], 0)
    two[2:] = np.where(inside[1:] & inside[:-1], table[numbers[:-2], 3], 0)
    feats = np.column_stack((table[numbers, 0], table[numbers, 1], one, two, right, 1 + files))
    masked = feats.copy()
    alone = np.repeat(np.arange(len(counts)) % 2 == 0, counts)
    masked[alone, 2:5] = 0  # no neighbours
    masked[~alone, 0] = 0  # no details of the own shape
    feats, tags, first = np.concatenate((feats, masked)), tags * 2, np.concatenate((first, first))
    forbidden = np.zeros((3, 3), bool)
    forbidden[OUT, INSIDE] = True
    weights, trans = crf.fit(feats, np.array(tags), first, 3, 1 << BITS, rounds=50, forbidden=forbidden)
    return {"weights": weights.astype(np.float32), "trans": trans}


class Tagger:
    """Viterbi tags of whole texts; built once in each worker."""

    def __init__(self, model: dict):
        self.weights, self.trans = model["weights"].astype(float), model["trans"]
        self.known = Signatures()
        self.table = np.zeros((0, 5), np.int64)

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        numbers, counts, first, files = _matrix(texts, self.known)
        fresh = [bins(n) for n in self.known.names[len(self.table) :]]
        if fresh:
            self.table = np.concatenate((self.table, np.array(fresh, np.int64)))
        scores = _scores(self.weights, self.table, numbers, first, files)
        scores[first, INSIDE] = -1e4
        path = crf.viterbi(scores, first, self.trans)
        return np.split(path, np.cumsum(counts)[:-1]) if len(counts) else []


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Every core of the tagged runs that overlaps no base span; words that name a secret are none."""
    out: list[tuple[int, int, str, int]] = []
    if not tags.any():
        return out
    runs: list[list[int]] = []
    for m, tag in zip(re.finditer(r"\S+", text), tags.tolist(), strict=True):
        if tag == INSIDE and runs:
            runs[-1][1] = m.end()
        elif tag:
            runs.append([m.start(), m.end()])
    for start, end in runs:
        lead = _LEAD.match(text, start, end)
        for core in _CORE.finditer(text, lead.end() if lead else start, end):
            named = core[0].strip("=").lower() in _CONTEXT
            if core.end() - core.start() >= LEAST and not named and not any(s[0] < core.end() and s[1] > core.start() for s in base):
                out.append((core.start(), core.end(), "crf", core.start()))
    return out


def _listed(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def _found(texts: list[str], model: dict | None, held: list[Tagger]) -> list[tuple[list, list]]:
    """(base, all) spans of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    if not held:
        held.append(Tagger(model))
    out, part, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or i + 1 == len(texts):
            for k, tags in zip(range(part, i + 1), held[0].tags(texts[part : i + 1]), strict=True):
                more = added_spans(texts[k], tags, base[k])
                out.append((base[k], sorted(base[k] + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base[k]))
            part, size = i + 1, 0
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # 2**BITS times 3 floats: under 1 MB
    held: list[Tagger] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _found(batch.column(1).to_pylist(), shared.value, held)
        counts = [[sum(s[2] == kind for s in base) for base, _ in found] for kind in KINDS[:3]]
        digests = [hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found]
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([_listed(every) for _, every in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = text_rows(docs)
    return map_arrow(rows, run, f"doc_id {rows.dtypes[0][1]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", lambda: held[0].known if held else {})


def hidden_kind(docs: DataFrame, kind: str) -> tuple[int, int, int]:
    """(found, spans, others): of the spans of a base kind that no other kind covers, how many a field finds that has not learned from that kind, and how many further spans it adds."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, kind))
    held: list[Tagger] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, base in ((t, base_spans(t)) for t in batch.column(1).to_pylist()):
            seen = [s for s in base if s[2] != kind]
            wanted = [h for h in base if h[2] == kind and not any(s[0] < h[1] and s[1] > h[0] for s in seen)]
            if shared.value is None:
                rows.append((0, len(wanted), 0))
                continue
            if not held:
                held.append(Tagger(shared.value))
            added = added_spans(text, held[0].tags([text])[0], seen)
            meets = lambda a, of: any(b[0] < a[1] and b[1] > a[0] for b in of)
            rows.append((sum(meets(h, added) for h in wanted), len(wanted), sum(not meets(a, wanted) for a in added)))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["found", "spans", "others"])

    sums = map_arrow(text_rows(docs), run, "found long, spans long, others long").agg(*(F.sum(c) for c in ("found", "spans", "others"))).first()
    return tuple(x or 0 for x in sums)


def hidden(text: str, spans: list[tuple[int, int, str, int]], mark: str = "[SECRET]") -> str:
    """text with every secret, overlapping ones together, replaced by mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted((s[3], s[1]) for s in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the secrets in text hidden and n_chars, if there, brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    held: list[Tagger] = []
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.column(at).to_pylist()
        found = _found([t or "" for t in before], shared.value, held)
        after = [hidden(t, every) if every else t for t, (_, every) in zip(before, found, strict=True)]
        columns = batch.columns
        columns[at] = pa.array(after, batch.schema.field(at).type)
        if count is not None:
            sizes = [len(a) if a != b else n for a, b, n in zip(after, before, batch.column(count).to_pylist(), strict=True)]
            columns[count] = pa.array(sizes, batch.schema.field(count).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, run, docs.schema, lambda: held[0].known if held else {})
