"""Column helpers: replacing regex matches through a function, code points, first differences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a group; an unmatched optional group is ''."""
    return F.regexp_extract_all(text, F.lit(pattern), group)


def weave(gaps: Column, parts: Column) -> Column:
    """gaps[0] parts[0] gaps[1] ... gaps[n]."""
    return F.array_join(F.zip_with(gaps, F.concat(parts, F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_matches(text: Column, pattern: str, change: Callable[..., Column], groups: Sequence[int] = (0,)) -> Column:
    """Rewrite each non-empty match, left to right, through change(group, ...); all else stays as it is."""

    def rewrite(t: Column) -> Column:
        if len(groups) == 1:
            parts = F.transform(matches(t, pattern, groups[0]), lambda m: change(m))
        else:
            zipped = F.arrays_zip(*(matches(t, pattern, g).alias(f"g{g}") for g in groups))
            parts = F.transform(zipped, lambda m: change(*(m.getField(f"g{g}") for g in groups)))
        return weave(F.split(t, pattern, -1), parts)

    return let(text, rewrite)


def code_points(text: Column) -> Column:
    """The characters of a text, one code point each."""
    return matches(text, r"(?s).")


def replace_in_order(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def first_difference(a: Column, b: Column) -> Column:
    """1-based place of the first code point in which two texts differ, 0 if they are equal; a shorter text differs at its end."""
    differ = F.zip_with(code_points(a), code_points(b), lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.array_position(differ, True), F.lit(0))
