"""Benchmark decontamination by template windows.

Canonicalisation replaces numbers, names (capitalised words inside a sentence) and units after a number by
typed placeholders; the rest is lower-cased words. Windows of five template tokens of documents and items
are joined by hash; an item leaks into a document if at least 80 % of its windows occur there. If the
item has slots, the values on one alignment must be consistent: equal item values have equal document
values. So a question with other names and numbers is caught, and text of the same pattern that fills the
slots at random is not. All alignments with at least 80 % of the best one's windows are looked at, so a
look-alike elsewhere in the document hides nothing.

Windows with fewer than three literal tokens are no evidence and count on neither side. The first word of
an item may be a name or not, as it depends on what precedes it; both forms are looked up.

The items' windows are broadcast only if they number at most MAX_BROADCAST, and so are the documents found;
else the joins shuffle, that of the windows in SALTS parts, as one window may be in very many documents.
Texts move only if more documents than that are found.

Defined cases: null or empty texts have no windows; an item without a usable window (under five tokens)
never leaks; a null id of a document or an item is left out (clean() keeps such documents); different texts
of one id are documents of their own, of which clean() drops only those with a leak; repeated rows are one
here and all kept or dropped by clean(); of consistent alignments the one with the fewest changed slots is
reported; other columns of the input stay out; only native functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpointed

WINDOW = 5
LITERALS = 3
PERCENT = 80
MAX_BROADCAST = 200_000
SALTS = 32
#: What tells texts of one id apart; a column name that no table has.
KEY = "__text_hash"
NAME, UNIT, NUMBER = "\x01", "\x02", "\x03"
UNITS = "km|cm|mm|m|kg|mg|g|lb|oz|ml|l|mph|kmh|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|years|year|dollars|euros|cents|percent|meters|miles|feet|inches"


def marked(text: Column) -> Column:
    """text with a mark before each name and unit."""
    plain = F.translate(F.coalesce(text, F.lit("")), NAME + UNIT + NUMBER, "")
    names = F.regexp_replace(plain, r"([\p{Ll},;] +)(\p{Lu}\p{Ll}+)", f"$1{NAME}$2")
    names = F.regexp_replace(names, r"(" + NAME + r"\p{Lu}\p{Ll}+)( +)(\p{Lu}\p{Ll}+)", "$1$2" + NAME + "$3")
    return F.regexp_replace(names, rf"(\d *)({UNITS})([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}$2$3")


def raw_tokens(mark: Column) -> Column:
    return F.regexp_extract_all(mark, F.lit(rf"[{NAME}{UNIT}]?[\p{{L}}\p{{M}}]+|\d+(?:[.,]\d+)*+"), 0)


def template_tokens(mark: Column) -> Column:
    """As raw_tokens, placeholders by their type and words in lower case."""
    short = F.regexp_replace(F.regexp_replace(mark, rf"([{NAME}{UNIT}])[\p{{L}}\p{{M}}]+", "$1"), r"\d+(?:[.,]\d+)*+", NUMBER)
    return F.regexp_extract_all(F.lower(short), F.lit(rf"[{NAME}{UNIT}{NUMBER}]|[\p{{L}}\p{{M}}]+"), 0)


def windows(tokens: str) -> Column:
    """The hash of each window of an array of tokens, in order."""
    places = f"CASE WHEN size({tokens}) >= {WINDOW} THEN sequence(1, size({tokens}) - {WINDOW - 1}) ELSE array() END"
    return F.expr(f"transform({places}, i -> xxhash64(slice({tokens}, i, {WINDOW})))")


def evidence(tokens: str) -> Column:
    """Whether each window has enough literal tokens; windows that match are alike, so only items are asked."""
    places = f"CASE WHEN size({tokens}) > 0 THEN sequence(1, size({tokens})) ELSE array() END"
    return F.expr(f"transform({places}, i -> size(filter(slice({tokens}, i, {WINDOW}), t -> t > '{NUMBER}')) >= {LITERALS})")


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, at, hash) of each item, both forms of its first word; and (item_id, raw, template, n_windows)."""
    known = items.where(F.col("item_id").isNotNull()).select("item_id", marked(F.col("text")).alias("mark")).distinct()
    parsed = known.select("item_id", raw_tokens(F.col("mark")).alias("raw"), template_tokens(F.col("mark")).alias("tokens"))
    named = F.concat(F.array(F.lit(NAME)), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))))
    forms = parsed.select("item_id", "tokens", F.lit(0).alias("form")).unionAll(parsed.where(F.size("tokens") >= WINDOW).select("item_id", named, F.lit(1)))
    rows = forms.withColumn("usable", evidence("tokens")).select("item_id", "form", "usable", F.posexplode(windows("tokens")).alias("at", "hash")).where(F.get("usable", F.col("at")))
    counts = rows.where("form = 0").groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"))
    return rows.select("item_id", "at", "hash").distinct(), parsed.join(counts, "item_id")


def is_few(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most MAX_BROADCAST rows."""
    return F.broadcast(df) if is_few(df) else df


def occurrences(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, KEY, item_id, at, shift) of every item window in a document."""
    places = tokens.select("doc_id", KEY, F.posexplode(windows("tokens")).alias("place", "hash"))
    if is_few(keys):
        hits = places.join(F.broadcast(keys), "hash")
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    return hits.select("doc_id", KEY, "item_id", "at", (F.col("place") - F.col("at")).alias("shift"))


def found_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, KEY, item_id, n_windows, matched, n_slots, changed_slots) of every leak; KEY is the hash of the text."""
    keys, parsed = item_windows(items)
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias(KEY), "text")
    tokens = docs.select("doc_id", KEY, template_tokens(marked(F.col("text"))).alias("tokens"))
    one = ["doc_id", KEY, "item_id"]
    lines = occurrences(tokens, keys).groupBy(*one, "shift").agg(F.collect_set("at").alias("ats"))  # at most an item's own windows
    pairs = lines.groupBy(*one).agg(F.collect_set("ats").alias("all"), F.collect_list(F.struct(F.size("ats").alias("n"), "shift")).alias("shifts"), F.max(F.size("ats")).alias("most"))
    pairs = pairs.select(*one, F.expr(f"transform(filter(shifts, s -> 100 * s.n >= {PERCENT} * most), s -> s.shift)").alias("shifts"), F.size(F.array_distinct(F.flatten("all"))).cast("long").alias("matched"))
    found = pairs.join(few(parsed.select("item_id", "n_windows")), "item_id")
    found = checkpointed(found.where(100 * F.col("matched") >= PERCENT * F.col("n_windows")))
    slots = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get(F.col("tokens"), i) <= NUMBER)
    found = found.join(parsed.select("item_id", "raw", F.col("tokens").alias("pattern"), slots.alias("slots")), "item_id")
    zero = F.lit(0).cast("long")
    plain = found.where(F.size("slots") == 0).select(*one, "n_windows", "matched", zero.alias("n_slots"), zero.alias("changed_slots"))
    wanted = found.where(F.size("slots") > 0)
    texts = docs.join(few(wanted.select("doc_id", KEY).distinct()), ["doc_id", KEY], "left_semi").dropDuplicates(["doc_id", KEY])
    filled = wanted.join(texts.select("doc_id", KEY, marked(F.col("text")).alias("mark")), ["doc_id", KEY])
    filled = filled.select("*", raw_tokens(F.col("mark")).alias("doc_raw"), template_tokens(F.col("mark")).alias("doc_tokens"))
    at = lambda array, i: F.get(F.col(array), i)

    def changed(shift: Column) -> Column:
        """How many slots of an alignment have another value; null if the values are not consistent."""
        aligned = F.filter("slots", lambda i: at("doc_tokens", i + shift) == at("pattern", i))
        values = F.transform(aligned, lambda i: F.struct(at("raw", i).alias("a"), at("doc_raw", i + shift).alias("b")))
        sound = lambda v: F.size(F.array_distinct(v)) == F.size(F.array_distinct(F.transform(v, lambda p: p["a"])))
        return F.get(F.transform(F.array(values), lambda v: F.when(sound(v), F.size(F.filter(v, lambda p: p["a"] != p["b"])))), F.lit(0))

    filled = filled.withColumn("changed", F.array_min(F.transform("shifts", changed))).where("changed IS NOT NULL")
    filled = filled.select(*one, "n_windows", "matched", F.size("slots").cast("long").alias("n_slots"), F.col("changed").cast("long").alias("changed_slots"))
    return plain.unionAll(filled)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, matched, n_slots, changed_slots) for every item that leaks into a document."""
    return found_items(docs, items).drop(KEY).distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns, without those that an item leaks into."""
    leaked = checkpointed(found_items(docs, items).select("doc_id", KEY).distinct())
    return docs.withColumn(KEY, F.xxhash64("text")).join(few(leaked), ["doc_id", KEY], "left_anti").select(*docs.columns)
