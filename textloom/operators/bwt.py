"""Bijective Burrows-Wheeler transform of each row, in Arrow batches.

A text splits into Lyndon words that do not increase; the last characters of all rotations of all words,
in the order of their infinite repetitions, are the transform, which needs no end mark and no index.
Characters beyond ASCII first take the values of unused ASCII characters, in order; a text with too many
of them is kept behind the mark `BWT`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

MARK = "BWT"
ASCII_TOP = 127
#: Texts, and characters of more than one text, that are sorted at once.
ROWS = 127
CHARS = 1 << 18


def _lyndon_sizes(text: str) -> list[int]:
    """Duval's factorisation, by lengths."""
    points = text.encode("latin-1") if text.isascii() else [*map(ord, text)]
    out, at, n = [], 0, len(points)
    while at < n:
        j, k = at + 1, at
        while j < n:
            a, b = points[k], points[j]
            if a == b:
                k += 1
            elif a < b:
                k = at
            else:
                break
            j += 1
        size = j - k
        while at <= k:
            out.append(size)
            at += size
    return out


def lyndon_words(text: str) -> list[str]:
    out, at = [], 0
    for size in _lyndon_sizes(text):
        out.append(text[at : at + size])
        at += size
    return out


def transform(text: str) -> str:
    """The bijective transform."""
    return _transforms([text])[0]


def _joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each begins, with the end of the last."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _cut(points: np.ndarray, bounds: np.ndarray) -> list[str]:
    out = points.astype("<u4").tobytes().decode("utf-32-le")
    return [out[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]  # noqa: B905


def _transforms(texts: Sequence[str]) -> list[str]:
    """The transforms of up to ROWS texts: ranks of places, doubled over the cycles of the Lyndon words where places are still alike.

    A text's number leads the first key, so that texts stay apart and are sorted all at once.
    """
    points, bounds = _joined(texts)
    n, longest = len(points), 1
    step, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = []
    for text, start in zip(texts, bounds.tolist()):  # noqa: B905
        for size in _lyndon_sizes(text):
            ends.append(start := start + size)
            longest = max(longest, size)
    ends = np.array(ends, np.int64)
    begins = np.concatenate(([0], ends[:-1])) if n else ends
    step[ends - 1], prev[begins] = begins, ends - 1
    alphabet, key = np.unique(points, return_inverse=True)
    key, bits, width, jump = key.astype(np.int64), max(1, int(len(alphabet) - 1).bit_length()), 1, step
    while width * bits * 2 <= 63 - ROWS.bit_length():
        key = key << (width * bits) | key[jump]
        jump, width = jump[jump], width * 2
    key |= np.repeat(np.arange(len(texts)), np.diff(bounds)) << (width * bits)
    rank, places = np.empty(n, np.int64), np.arange(n)
    heads = np.zeros(n, np.int64)  # of a place's group of like ones in the order so far
    while True:
        order = np.argsort(key)
        places, key, heads = places[order], key[order], heads[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, np.bool_)
        first = np.flatnonzero(fresh)
        sizes = np.diff(first, append=len(key))
        at = np.repeat(first, sizes)
        group = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1]))) if len(key) else first
        rank[places] = heads + at - np.repeat(group, np.diff(group, append=len(key)))
        alike = np.repeat(sizes > 1, sizes)
        places = places[alike]
        if not len(places) or width >= 2 * longest:
            break
        heads = rank[places]
        key = heads * n + rank[jump[places]]
        jump, width = jump[jump], width * 2
    return _cut(points[prev[np.argsort(rank, kind="stable")]], bounds)


def inverse(text: str) -> str:
    return _inverses([text])[0]


def _inverses(texts: Sequence[str]) -> list[str]:
    """Follow the cycles of the standard permutation of each of up to ROWS texts; each is a Lyndon word, the largest last."""
    points, bounds = _joined(texts)
    _, key = np.unique(points, return_inverse=True)
    key = key + np.repeat(np.arange(len(texts)), np.diff(bounds)) * (int(key.max(initial=0)) + 1)
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable").tolist()
    out: list[int] = []
    for start, end in zip(bounds.tolist(), bounds[1:].tolist()):  # noqa: B905
        words = []
        for at in range(start, end):
            if order[at] >= 0:
                word = []
                while (after := order[at]) >= 0:
                    order[at] = -1
                    word.append(after)
                    at = after  # noqa: PLW2901
                words.append(word)
        for word in reversed(words):
            out += word
    return _cut(points[np.array(out, np.int64)], bounds)


def _ascii_names(text: str) -> dict[str, str] | None:
    used = set(text)
    beyond = sorted(c for c in used if ord(c) > ASCII_TOP)
    free = [chr(i) for i in range(ASCII_TOP + 1) if chr(i) not in used]
    return dict(zip(beyond, free)) if len(beyond) <= len(free) else None  # noqa: B905


def _through(texts: Sequence[str], change: Callable[[Sequence[str]], list[str]]) -> list[str | None]:
    """change(texts), each under its own names in ASCII, in groups of texts of bounded size; None where names do not suffice."""
    out: list[str | None] = [None] * len(texts)
    group: list[tuple[int, str, dict[str, str]]] = []
    size = 0

    def work() -> None:
        for (at, _, names), done in zip(group, change([t for _, t, _ in group]), strict=True):
            out[at] = done.translate(str.maketrans({v: k for k, v in names.items()})) if names else done
        group.clear()

    for at, text in enumerate(texts):
        names = {} if text.isascii() else _ascii_names(text)
        if names is None:
            continue
        if group and (len(group) == ROWS or size + len(text) > CHARS):
            work()
            size = 0
        group.append((at, text.translate(str.maketrans(names)) if names else text, names))
        size += len(text)
    if group:
        work()
    return out


def encode_all(texts: Sequence[str]) -> list[str]:
    out = []
    for text, coded in zip(texts, _through(texts, _transforms), strict=True):
        if coded is not None and coded.startswith(MARK):
            raise ValueError("the transform begins with the mark")
        out.append(MARK + text if coded is None else coded)
    return out


def decode_all(texts: Sequence[str]) -> list[str]:
    plain = _through(["" if t.startswith(MARK) else t for t in texts], _inverses)
    return [t[len(MARK) :] if t.startswith(MARK) else back for t, back in zip(texts, plain, strict=True)]


def encode(text: str) -> str:
    return encode_all([text])[0]


def decode(text: str) -> str:
    return decode_all([text])[0]
