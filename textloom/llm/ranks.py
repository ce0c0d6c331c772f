"""Blocks of rows in the order of a numeric id, for order-dependent work without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges between quantiles; inside a range ids are cut evenly.
RANGES = 64
ROWS = 2000


#: The range of rows without an id, after all others.
NULLS = 1 << 20


def block_columns(df: DataFrame, id_col: str, spread: Column, rows: int = ROWS) -> tuple[Column, Column]:
    """(range, block): both rise with the id, nulls come last; a block holds about `rows` rows.

    One pass over the ids alone finds 63 approximate quantiles; a block is an even part of a range. An id that
    is two quantiles or more is a range of its own, in which, as in that of the nulls, spread deals the
    rows to blocks; spread is a hash of what tells rows with one id apart.
    """
    points = [i / RANGES for i in range(1, RANGES)]
    found = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.percentile_approx(id_col, points, 1000).alias("at")
    ).first()
    parts = max(1, -(-found["n"] // (RANGES * rows)))
    null_range = F.lit(NULLS).cast("long")
    dealt = F.pmod(spread, F.lit(RANGES * parts)).cast("long")
    key = F.col(id_col)
    if found["low"] is None:
        return null_range, dealt
    first, last, at = int(found["low"]), int(found["high"]), list(map(int, found["at"]))
    frequent = sorted({x for x, y in zip(at, at[1:]) if x == y})  # noqa: B905
    bounds = [x for x in sorted({*at, *(x + 1 for x in frequent)}) if first < x <= last]
    edges = F.array(*(F.lit(float(x)) for x in (first, *bounds, last + 1)))  # doubles, as differences of longs may not fit a long
    place = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in bounds)), lambda x: x <= key)) if bounds else F.lit(0)
    low, high = F.get(edges, place), F.get(edges, place + 1)
    inside = F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * parts).cast("long")
    by_hash = key.isNull() | key.isin(frequent) if frequent else key.isNull()
    block = F.when(by_hash, dealt).otherwise(F.greatest(F.lit(0).cast("long"), F.least(inside, F.lit(parts - 1).cast("long"))))
    return F.when(key.isNull(), null_range).otherwise(place.cast("long")), block
