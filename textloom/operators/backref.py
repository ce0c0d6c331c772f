"""Back-reference codecs: per-row state over the words already seen, in Arrow batches.

The state is a bounded move-to-end list for one row, so rows are independent and memory is bounded by the
window; decisions depend on all words before, which no set operation expresses. The distance that the stem
codec emits also has a relational form.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textloom.functions.primitives import matches
from textloom.operators import lancaster
from textloom.session import ship_package

WINDOW = 1024
_L = r"\p{Script=Latin}"
_ENCODE_WORD = regex.compile(rf"(?<![<{_L}]{{2}}){_L}{{3,}}(?![>{_L}]{{2}})")
_DECODE_WORD = regex.compile(rf"(?<!<)<{_L}+|{_L}+>(?!>)|(?<![{_L}<]){_L}{{3,}}(?![{_L}>])")
_STEM_WORD = regex.compile(r"(?<![>A-Za-z])[A-Za-z]{3,}")
_STEM_CODE = regex.compile(r"(?<!>)>([0-9]+)[A-Za-z]+|(?<![A-Za-z>])[A-Za-z]{3,}")


class Recent:
    """The last distinct words, most recent last; at most `most` of them."""

    def __init__(self, most: int):
        self.most, self.words = most, {}

    def add(self, word: str) -> None:
        if self.words.pop(word, None) is None and len(self.words) >= self.most:
            del self.words[next(iter(self.words))]
        self.words[word] = True

    def newest_first(self) -> Iterator[str]:
        return reversed(self.words)


class Affixes:
    """The last distinct words, at most `most` of them, by their last use, and the last use of each start and end that will be asked for.

    Uses are numbered from 1; words[use] is the word that was used. What was used since a word that is still held is held too.
    """

    def __init__(self, most: int):
        self.most, self.last = most, OrderedDict()
        self.words, self.starts, self.ends = [""], {}, {}

    def want_start(self, affix: str) -> None:
        """Starts of a wanted start are wanted too, so that add() may end at the first that is not."""
        for at in range(len(affix), 0, -1):
            if affix[:at] in self.starts:
                break
            self.starts[affix[:at]] = 0

    def want_end(self, affix: str) -> None:
        for at in range(len(affix)):
            if affix[at:] in self.ends:
                break
            self.ends[affix[at:]] = 0

    def add(self, word: str) -> None:
        last, starts, ends, use = self.last, self.starts, self.ends, len(self.words)
        if word in last:
            last.move_to_end(word)
        elif len(last) >= self.most:
            last.popitem(last=False)
        last[word] = use
        self.words.append(word)
        for at in range(1, len(word) + 1):
            affix = word[:at]
            if affix not in starts:
                break
            starts[affix] = use
        for at in range(len(word) - 1, -1, -1):
            affix = word[at:]
            if affix not in ends:
                break
            ends[affix] = use

    def newest(self, affixes: dict[str, int], affix: str) -> str | None:
        """The last word with that start or end, if it is among the last."""
        use = affixes[affix]
        return self.words[use] if use and self.last.get(self.words[use]) == use else None


def encode_words(text: str, window: int = WINDOW) -> str:
    """Repeat a word as its start and `>`, or `<` and its end, as long as that names the last such word."""
    text = regex.sub(rf"<(?={_L})", "<<", text)
    text = regex.sub(rf"(?<={_L})>", ">>", text)
    recent, seen, repeated = Affixes(window), set(), set()
    for m in _ENCODE_WORD.finditer(text):
        (repeated if m[0] in seen else seen).add(m[0])
    for word in repeated:
        recent.want_start(word[:-1])
        recent.want_end(word[1:])
    last, starts, ends, add = recent.last, recent.starts, recent.ends, recent.add

    def change(m: regex.Match) -> str:
        word = out = m[0]
        before = last.get(word)
        if before is not None:
            most, head, tail = len(word) - 2, 0, 0  # what is shared beyond that leaves nothing to save
            while head <= most and starts[word[: head + 1]] > before:
                head += 1
            while tail <= most and ends[word[-tail - 1 :]] > before:
                tail += 1
            kept = min(head, tail) + 1
            if kept <= most:
                out = "<" + word[-kept:] if head > tail else word[:kept] + ">"
        add(word)
        return out

    return _ENCODE_WORD.sub(change, text)


def decode_words(text: str, window: int = WINDOW) -> str:
    recent = Affixes(window)
    for m in _DECODE_WORD.finditer(text):
        if m[0].endswith(">"):
            recent.want_start(m[0][:-1])
        elif m[0].startswith("<"):
            recent.want_end(m[0][1:])

    def change(m: regex.Match) -> str:
        word = m[0]
        full = word
        if word.endswith(">"):
            full = recent.newest(recent.starts, word[:-1])
        elif word.startswith("<"):
            full = recent.newest(recent.ends, word[1:])
        if full is None:
            raise ValueError(f"no word before fits {word!r}")
        recent.add(full)
        return full

    text = _DECODE_WORD.sub(change, text)
    text = regex.sub(rf"<<(?={_L})", "<", text)
    return regex.sub(rf"(?<={_L})>>", ">", text)


@lru_cache(maxsize=1 << 16)
def usable_stem(word: str) -> str | None:
    """The stem that a word starts with, if it is shorter than the word and longer than two letters."""
    found = lancaster.stem(word)
    if len(found) >= 2 and found.endswith("y"):
        found = found[:-1]
    if word[0].isupper() and word.lower().startswith(found):
        found = word[0] + found[1:]
    return found if found != word and word.startswith(found) and len(found) > 2 else None


class Ranked:
    """Words by how recently they were used; both ways between word and rank take logarithmic time."""

    def __init__(self, uses: int, most: int):
        self.most, self.last, self.words = most, {}, []
        self.tree = [0] * (uses + 1)
        self.top = 1 << uses.bit_length()

    def _mark(self, at: int, by: int) -> None:
        while at < len(self.tree):
            self.tree[at] += by
            at += at & -at

    def add(self, word: str) -> None:
        before = self.last.pop(word, None)
        if before is None and len(self.last) >= self.most:
            before = self.last.pop(next(iter(self.last)))
        if before is not None:
            self._mark(before, -1)
        self.words.append(word)
        self.last[word] = len(self.words)
        self._mark(len(self.words), 1)

    def rank(self, word: str) -> int | None:
        """The number of distinct words used since; None if the word is not among the last."""
        at = self.last.get(word)
        if at is None:
            return None
        older = 0
        while at:
            older += self.tree[at]
            at -= at & -at
        return len(self.last) - older

    def word(self, rank: int) -> str:
        left, at, step = len(self.last) - rank, 0, self.top  # the left-th oldest
        if not 0 < left <= len(self.last):
            raise ValueError(f"no word before has rank {rank}")
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < left:
                at += step
                left -= self.tree[at]
            step >>= 1
        return self.words[at]


def encode_stems(text: str, window: int = 1 << 31) -> str:
    """Repeat a stem as `>`, the number of distinct stems since, and the rest of the word."""
    text = regex.sub(r"(?a)>(?=\w)", ">>", text)
    recent = Ranked(sum(1 for _ in _STEM_WORD.finditer(text)), window)

    def change(m: regex.Match) -> str:
        word = m[0]
        root = usable_stem(word)
        if root is None:
            return word
        far = recent.rank(root)
        recent.add(root)
        return word if far is None else f">{far}{word[len(root) :]}"

    return _STEM_WORD.sub(change, text)


def decode_stems(text: str, window: int = 1 << 31) -> str:
    recent = Ranked(sum(1 for _ in _STEM_CODE.finditer(text)), window)

    def change(m: regex.Match) -> str:
        word = m[0]
        if word.startswith(">"):
            root = recent.word(int(m[1]))
            word = root + word[1 + len(m[1]) :]
            if usable := root if word != root and len(root) > 2 else None:
                recent.add(usable)
            return word
        if root := usable_stem(word):
            recent.add(root)
        return word

    text = _STEM_CODE.sub(change, text)
    return regex.sub(r"(?a)>>(?=\w)", ">", text)


#: Rows of a batch that are Python strings at a time.
ROWS = 500


def per_batch(function) -> Column:  # noqa: ANN001
    """A function from texts to texts, over some rows of an Arrow batch at a time; NULL stays NULL.

    Ten thousand rows as objects, and as many results, would be many times the size of the batch.
    """

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        done = []
        for at in range(0, len(texts), ROWS):
            rows = texts.slice(at, ROWS).to_pylist()
            made = iter(function([t for t in rows if t is not None]))
            done.append(pa.array([None if t is None else next(made) for t in rows], pa.string()))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return run


def per_row(function, *args) -> Column:  # noqa: ANN001
    """A string function over Arrow batches; NULL stays NULL."""
    return per_batch(lambda texts: [function(t, *args) for t in texts])


def _greater_before(values: np.ndarray) -> np.ndarray:
    """For each of some distinct numbers, how many before it are greater: places are dealt by the bits of their ranks, highest first."""
    size = len(values)
    rank, out = np.empty(size, np.int64), np.zeros(size, np.int64)
    rank[np.argsort(values)] = np.arange(size)
    at = np.arange(size)  # ordered by the higher bits, which take up as many places as there are ranks, else as before
    for bit in range(max(size - 1, 0).bit_length() - 1, -1, -1):
        own = rank[at]
        start = own >> (bit + 1) << (bit + 1)
        high = own >> bit & 1
        ones = np.concatenate(([0], np.cumsum(high)))
        ones = ones[:-1] - ones[start]  # of the same higher bits, before
        low = high == 0
        out[at[low]] += ones[low]
        to = np.where(low, np.arange(size) - ones, start + (1 << bit) + ones)
        at[to] = at.copy()
    return out


def distances(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distinct tokens since the token's previous use in its row) of each repeated token; rows ascend.

    Between two uses, what was used before in between is no other token; it is repeated, after a use later than the first of the two.
    """
    key = rows * (int(tokens.max(initial=0)) + 1) + tokens
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before = np.full(len(tokens), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero(before >= 0)
    return places, places - before[places] - 1 - _greater_before(before[places])


def reuse_distance(df: DataFrame, id_col: str, text: Column, pattern: str = r"\w+") -> DataFrame:
    """(id, pos, token, distance): distinct tokens since the token's previous use in its row, whole rows, in Arrow batches."""
    rows = df.select(id_col, matches(F.lower(text), pattern).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                sizes = pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = pc.list_flatten(part.column(1)).dictionary_encode()
                row = np.repeat(np.arange(len(sizes)), sizes)
                places, far = distances(words.indices.to_numpy().astype(np.int64), row)
                if len(places):
                    own = row[places]
                    pos = places - (np.cumsum(sizes) - sizes)[own]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(pos, pa.int32()), words.dictionary.take(words.indices.take(pa.array(places))), pa.array(far, pa.int64())], [id_col, "pos", "token", "distance"])

    ship_package(df.sparkSession)
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, pos int, token string, distance long")


def reuse_distance_relational(df: DataFrame, id_col: str, text: Column, pattern: str = r"\w+") -> DataFrame:
    """As reuse_distance, by joins alone; for short rows, as its work grows with the square of a row.

    A token at p with last use q has seen, in between, as many distinct tokens as there are places after q
    whose own next use is not before p; an equi-join on the row with a range filter, rows apart.
    """
    tokens = df.select(id_col, F.posexplode(matches(F.lower(text), pattern)).alias("pos", "token"))
    per_token = Window.partitionBy(id_col, "token").orderBy("pos")
    seen = tokens.select(id_col, "pos", "token", F.lag("pos").over(per_token).alias("before"), F.lead("pos").over(per_token).alias("after"))
    uses = seen.where("before IS NOT NULL").select(F.col(id_col).alias("row"), F.col("pos").alias("p"), F.col("token").alias("used"), F.col("before").alias("q"))
    others = seen.select(id_col, F.col("pos").alias("o"), "after")
    between = uses.join(others, (F.col("row") == F.col(id_col)) & (F.col("o") > F.col("q")) & (F.col("o") < F.col("p")) & (F.col("after").isNull() | (F.col("after") >= F.col("p"))), "left")
    found = between.groupBy("row", "p", "used").agg(F.count("o").alias("distance"))
    return found.select(F.col("row").alias(id_col), F.col("p").alias("pos"), F.col("used").alias("token"), "distance")
