"""Greedy block substitution, like byte pairs: the best (from, to) replacement of each round, over the corpus.

A round is one aggregation over the corpus; only the n-gram counts that can still matter, those of the few
best candidates, reach the driver. `to` is a pair of characters that the corpus does not hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.primitives import replace_in_order
from textloom.operators.analysis import gram_counts

CANDIDATES = 128


def score(size: Column, n: Column) -> Column:
    """Characters saved by replacing n blocks of that size by two characters, less the rule's own size."""
    return size * n - 2 * n - (size + 2) - 2


def best_blocks(df: DataFrame, text: Column, sizes: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """(gram, n, score) of blocks of three or more characters that pay, best first."""
    grams = gram_counts(df, text, tuple(sizes))
    worth = grams.where("length(gram) >= 3 AND n > 1").withColumn("score", score(F.length("gram"), F.col("n")))
    return worth.where("score > 0").orderBy(F.desc("score"), "gram")


def next_rule(df: DataFrame, text: Column, sizes: Sequence[int] = (2, 3, 4, 5)) -> tuple[str, str] | None:
    """The best replacement in the order (score, bonus, from, to), or None."""
    grams = gram_counts(df, text, tuple(sizes)).persist()
    try:
        triples = grams.where("length(gram) = 3")
        ends = [r["c"] for r in triples.groupBy(F.expr("right(gram, 1)").alias("c")).agg(F.max("n").alias("n")).orderBy(F.desc("n"), "c").limit(CANDIDATES).collect()]
        starts = [r["c"] for r in triples.groupBy(F.expr("left(gram, 1)").alias("c")).agg(F.max("n").alias("n")).orderBy(F.desc("n"), "c").limit(CANDIDATES).collect()]
        pairs = [a + b for a in ends for b in starts]
        held = {r["gram"] for r in grams.where(F.col("gram").isin(pairs)).select("gram").collect()} if pairs else set()
        free = [p for p in pairs if p not in held]
        best = grams.where("length(gram) >= 3 AND n > 1").withColumn("score", score(F.length("gram"), F.col("n"))).where("score > 0")
        tops = best.orderBy(F.desc("score"), "gram").limit(CANDIDATES).collect()
        if not free or not tops:
            return None
        counts = {r["gram"]: r["n"] for r in triples.orderBy(F.desc("n"), "gram").limit(50 * CANDIDATES).collect()}

        def bonus(old: str, new: str) -> int:
            left = max((counts.get(g[:2] + new[0], 0) - n for g, n in counts.items() if g[2] == old[0]), default=0) if old[0] != new[0] else 0
            right = max((counts.get(new[1] + g[1:], 0) - n for g, n in counts.items() if g[0] == old[-1]), default=0) if old[-1] != new[1] else 0
            return left + right

        most = tops[0]["score"]
        ranked = sorted((-bonus(r["gram"], new), r["gram"], new) for r in tops if r["score"] == most for new in free[:CANDIDATES])
        for _, old, new in ranked:
            doubled = new[0] == new[1]
            if not doubled or not df.where(F.contains(text, F.lit(new[0] + old[:-1]))).limit(1).count():
                return old, new
        return None
    finally:
        grams.unpersist()


def learn(df: DataFrame, column: str = "text", rounds: int = 16) -> list[tuple[str, str]]:
    """The ordered replacements; the corpus itself is rewritten by one expression, so lineage does not grow."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        rule = next_rule(df, replace_in_order(F.col(column), rules))
        if rule is None:
            break
        rules.append(rule)
    return rules


def substitute(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return replace_in_order(text, rules)


def substitute_inverse(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return replace_in_order(text, [(new, old) for old, new in reversed(rules)])
