"""Corpus analyses. Each report is a DataFrame in a total order; counts are combined before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.codecs import can_spare, compact_words, html_unescape
from textloom.functions.primitives import code_points, let, matches
from textloom.operators.grams import Part, apart, counted, counted_after, parts
from textloom.session import ship_package

TOP = 100
MAX_SEPARATORS = 1000


def top(df: DataFrame, score: str, key: str, most: int = TOP) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(most)


def word_tokens(text: Column) -> Column:
    return matches(F.lower(text), r"\w+")


def counts(df: DataFrame, tokens: Column, name: str) -> DataFrame:
    """(name, n, pages): occurrences, and rows that hold the token, from one grouping of per-row counts."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.explode(tokens).alias(name))
    per_row = rows.groupBy("row", name).agg(F.count("*").alias("k"))
    return per_row.groupBy(name).agg(F.sum("k").alias("n"), F.count("*").alias("pages"))


def frequency(df: DataFrame, tokens: Column, name: str) -> DataFrame:
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def page_frequency(df: DataFrame, tokens: Column, name: str) -> DataFrame:
    return df.select(F.explode(F.array_distinct(tokens)).alias(name)).groupBy(name).agg(F.count("*").alias("pages"))


def burstiness(df: DataFrame, tokens: Column, name: str) -> DataFrame:
    """(name, n, pages, score): score is n div (1 + pages); both counts come from separate, combinable groupings."""
    both = frequency(df, tokens, name).join(page_frequency(df, tokens, name), name)
    return both.withColumn("score", F.expr("n div (1 + pages)"))


def not_ascii(name: str) -> Column:
    return F.ascii(name) >= 0x7F


#: Repeated groups are possessive, as Java runs those in a loop and others by recursion.
TOKEN_CLASSES = (
    ("singleQuotes", "'{2}"),
    ("reference", r"[\]\[]{2,}"),
    ("title_mark", "={2,}"),
    ("curly", r"[{}]{2,}"),
    ("proper", r"(?:de )?[A-Z][a-z]+(?![A-Za-z])(?:[ -][A-Z][a-z]+(?![A-Za-z]))*+"),
    ("weirdCase", "[A-Za-z]*[A-Z][A-Za-z]*"),
    ("xml", r"<(?:/)?\w+>"),
    ("date", r"(?<!\d[. ])\d+(?![. ]\d)"),
    ("words", r"\w+(?:-\w+)*+"),
    ("html_encoded", r"'(?:&#\d+;)++"),
    ("whitespaces", " +"),
    ("ellipsis", r"\.{3}"),
    ("sentences_markers", "[,.]"),
    ("eol", r"\v+"),
    ("XXX", "."),
)


def token_class_transitions(df: DataFrame, text: Column, classes: tuple[tuple[str, str], ...] = TOKEN_CLASSES) -> DataFrame:
    """(from_class, to_class, n, percent): how often one token class follows another in a row."""
    joined = "|".join(p for _, p in classes)
    kind = F.lit(None).cast("string")

    def name(token: Column) -> Column:
        found = kind
        for title, pattern in reversed(classes):
            found = F.when(token.rlike(f"(?s)^(?:{pattern})$"), title).otherwise(found)
        return found

    kinds = df.select(F.transform(matches(text, joined), name).alias("k"))
    size = F.greatest(F.size("k") - 1, F.lit(0))
    pairs = kinds.select(F.explode(F.zip_with(F.slice("k", F.lit(1), size), F.slice("k", F.lit(2), size), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    moves = pairs.groupBy(F.col("p.a").alias("from_class"), F.col("p.b").alias("to_class")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("from_class"))
    return moves.withColumn("percent", F.expr("100 * n").cast("long") / total).withColumn("percent", F.floor("percent").cast("long"))


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """All substrings of those lengths, put together from an array of characters."""

    def of_size(chars: Column, k: int) -> Column:
        starts = F.when(F.size(chars) >= k, F.sequence(F.lit(0), F.size(chars) - k)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.concat(*(F.get(chars, i + j) for j in range(k))))

    return let(code_points(text), lambda chars: F.concat(*(of_size(chars, k) for k in sizes)))


def gram_counts(df: DataFrame, text: Column, sizes: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """(gram, n): occurrences of each n-gram that do not overlap in a row."""
    return counted(df, text, sizes, apart=True)


def substrings(least: int, most: int) -> Column:
    """All substrings of column s of those lengths."""
    return grams(F.col("s"), range(least, most + 1))


def symbol_patterns(df: DataFrame, text: Column, least: int = 2, longest: int = 10) -> DataFrame:
    """(pattern, n, saved) of skeleton substrings that can be spared, best total first."""
    rows = df.select(compact_words(html_unescape(text)).alias("s"))
    mined = counted(rows, F.col("s"), range(least, longest + 1), "pattern")  # what can be spared is asked once for each pattern
    return mined.where(can_spare(F.col("pattern"), F.lit(1)) > 0).withColumn("saved", can_spare(F.col("pattern"), F.col("n")))


def separators(df: DataFrame, text: Column, longest: int = 63) -> DataFrame:
    """(sep, n): repeated substrings that no string one longer holds as often (closed patterns)."""
    rows = df.select(text.alias("s"))
    return closed(rows.select(F.explode(substrings(1, longest)).alias("sep")).groupBy("sep").agg(F.count("*").alias("n")).where("n > 1"))


def closed(found: DataFrame) -> DataFrame:
    """Those (sep, n) that no string one longer equals in n; it covers exactly its prefix and its suffix, so containment is an equi-join."""
    longer = found.where("length(sep) > 1").select(F.explode(F.array(F.expr("left(sep, length(sep) - 1)"), F.expr("substring(sep, 2)"))).alias("sep"), "n").distinct()
    return found.join(longer, ["sep", "n"], "left_anti")


#: Lengths that are counted in one pass over the corpus end here.
STEPS = (4, 8, 16, 32)


def top_separators(df: DataFrame, text: Column, most: int = TOP, longest: int = 63) -> DataFrame:
    """(sep, n): the `most` commonest of separators(), ties by sep; exact, without listing what cannot be among them.

    A string is no commoner than its start, so longer ones are counted only where a start is common
    enough. Enough is the `most`th largest count so far: each count is that of a closed string too, maybe of a
    longer one, so that as many closed strings are as common. It ends where no start is left.
    """
    levels, sizes, least, done = [], set(), 2, 0
    try:
        for upto in [*(s for s in STEPS if s < longest), longest]:
            span = range(done + 1, upto + 1)
            if levels:
                begun = [r["sep"] for r in levels[-1].where((F.length("sep") == done) & (F.col("n") >= least)).select("sep").collect()]
                if not begun:
                    break
                found = counted_after(df, text, begun, span, "sep")
            else:
                found = counted(df, text, span, "sep")
            levels.append(found.where(F.col("n") >= least).persist())
            commonest = levels[-1].select("n").distinct().orderBy(F.desc("n")).limit(most).collect()
            sizes = set(sorted(sizes | {r["n"] for r in commonest}, reverse=True)[:most])
            least, done = max(least, min(sizes) if len(sizes) == most else 2), upto
        found = reduce(DataFrame.unionAll, levels).where(F.col("n") >= least)
        return df.sparkSession.createDataFrame(top(closed(found), "n", "sep", most).collect(), "sep string, n long")  # at most that many rows
    finally:
        for level in levels:
            level.unpersist()


def separator_stats(df: DataFrame, text: Column, seps: DataFrame) -> DataFrame:
    """(sep, n, lo, hi, mean, sd, score) of the places of each separator's occurrences that do not overlap, within a row.

    The places are added up in Arrow batches, a row for each separator of a part. seps is a report of at most MAX_SEPARATORS rows.
    """
    wanted = [r["sep"] for r in seps.select("sep").limit(MAX_SEPARATORS + 1).collect()]
    if len(wanted) > MAX_SEPARATORS:
        raise ValueError(f"more than {MAX_SEPARATORS} separators")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            part, rows = Part(batch.column(0)), []
            number = {c: i for i, c in enumerate(part.alphabet.tolist()) if i}
            begin = np.repeat(part.starts, part.marks + 1 - part.starts)
            firsts: dict[int, np.ndarray] = {}
            for sep in wanted:
                codes = [number.get(ord(c), 0) for c in sep]
                if not all(codes):
                    continue
                if codes[0] not in firsts:
                    firsts[codes[0]] = np.flatnonzero(part.codes == codes[0])
                places = firsts[codes[0]]
                for at, code in enumerate(codes[1:], 1):
                    places = places[part.codes[places + at] == code]  # a mark follows each text
                if len(places):
                    places = apart(places, len(sep))
                    places = places - begin[places]
                    wide = places.astype(np.float64)
                    rows.append((sep, len(places), int(places.min()), int(places.max()), float(wide.sum()), float(wide @ wide)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["sep", "n", "lo", "hi", "sum", "squares"])  # noqa: B905

    ship_package(df.sparkSession)
    own = df.select(text.alias("t")).where("t <> ''").mapInArrow(run, "sep string, n long, lo int, hi int, sum double, squares double")
    stats = own.groupBy("sep").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    stats = stats.withColumn("mean", F.col("sum") / F.col("n"))
    stats = stats.withColumn("sd", F.sqrt(F.greatest(F.col("squares") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    score = F.when(F.col("sd") > 0, (F.col("hi") - F.col("lo")) / F.col("sd") * F.length("sep") * F.ln("n")).otherwise(0.0)
    return stats.select("sep", "n", "lo", "hi", "mean", "sd", score.alias("score"))


def unused_code_points(df: DataFrame, text: Column, below: int = 512) -> DataFrame:
    """(code_point) from 0 to below - 1 that no row uses."""
    used = df.select(F.explode(F.array_distinct(code_points(text))).alias("c")).distinct().select(F.ascii("c").alias("code_point"))
    return df.sparkSession.range(below).select(F.col("id").cast("int").alias("code_point")).join(used, "code_point", "left_anti")
