"""Word shingles as sets of 64-bit hashes, whole texts of a batch at a time.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def memo() -> dict:
    return _words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of width words; of the whole sequence if it is shorter."""
    words = [text.encode("utf-8", "surrogatepass").lower().split() if text else [] for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    h = np.fromiter((_words[w] for of in words for w in of), np.uint64, total)
    out, at = [], 0
    rolled = np.zeros(max(total - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * _P + h[k : total - width + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled)
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for k in range(at, at + n):
                whole = whole * _P + h[k : k + 1]
            out.append(mix(whole))
        else:
            out.append(h[:0])
        at += n
    return out
