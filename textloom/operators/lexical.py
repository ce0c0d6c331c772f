"""Per-row dictionaries of fragments: short pieces that repeat grow while that pays, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

BEST = 100
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_ ")
_SEED = re.compile(r"[A-Za-z0-9_ ]{3}")


def _places(text: str, fragment: str) -> list[int]:
    """All places where a fragment begins."""
    out, at = [], text.find(fragment)
    while at >= 0:
        out.append(at)
        at = text.find(fragment, at + 1)
    return out


def _apart(places: list[int], size: int) -> list[int]:
    """The places that do not overlap, from the left; the list itself if none does."""
    before = places[0]
    for at in places[1:]:
        if at - before < size:
            break
        before = at
    else:
        return places
    out, free = [], 0
    for at in places:
        if at >= free:
            out.append(at)
            free = at + size
    return out


def grow(text: str, best: int = BEST) -> list[tuple[str, int]]:
    """(fragment, count) of four or more characters, best saving first; counts are of occurrences that do not overlap.

    A fragment one longer begins where the shorter one does, so its places are read off those of the shorter one.
    """
    seeds = [f for f, n in Counter(_SEED.findall(text)).items() if n > 1]
    every = Counter([text[at : at + 3] for at in range(len(text) - 2)]) if seeds else {}
    first = sorted((-(text.count(f) if f[0] == f[2] else every[f]), f) for f in seeds)[:best]
    alive = {f: _places(text, f) for _, f in first}
    found: list[tuple[int, str, int]] = []
    size, end, letters = 3, len(text), _LETTERS
    while alive:
        longer: dict[str, list[int]] = {}
        for places in alive.values():
            own: dict[str, list[int]] = {}
            apart = _apart(places, size)
            for at in places:
                if at and text[at - 1] in letters:
                    f = text[at - 1 : at + size]
                    if f not in own:
                        own[f] = [at - 1]
                    elif own[f][-1] != at - 1:  # what is of one letter only is met from both sides
                        own[f].append(at - 1)
                if at + size < end and text[at + size] in letters:
                    f = text[at : at + size + 1]
                    if f not in own:
                        own[f] = [at]
                    elif own[f][-1] != at:
                        own[f].append(at)
            if apart is not places:  # only these were looked beyond
                grown = {text[at - 1 : at + size] for at in apart if at} | {text[at : at + size + 1] for at in apart}
                own = {f: where for f, where in own.items() if f in grown}
            longer |= own
        size += 1
        fresh = []
        for f, where in longer.items():
            if len(where) > 1 and (n := len(_apart(where, size))) > 1:
                fresh.append((-(size - 3) * (n - 1), f, n))
        fresh.sort()
        found = sorted(found + fresh[:best])[:best]
        kept = {f for _, f, _ in found}
        alive = {f: longer[f] for _, f, _ in fresh[:best] if f in kept}
    return [(f, n) for _, f, n in found]


def apply(text: str, fields: list[str]) -> str:
    """Fragments become `w<n>_`, with numbers that the text does not use."""
    taken = {int(d) for d in re.findall(r"w([0-9]{1,9})_", text)}
    free = (i for i in range(len(fields) + len(taken) + 1) if i not in taken)
    for fragment, number in zip(fields, free):  # noqa: B905
        text = text.replace(fragment, f"w{number}_")
    return text


def fields(text: Column) -> Column:
    """The dictionary of each row, joined by `|`."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "|".join(f for f, _ in grow(t)))

    return run(text)
