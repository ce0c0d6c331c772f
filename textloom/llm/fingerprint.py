"""Document fingerprints: a canonical exact digest.

The canonical text is NFKC, case-folded, NFKC again, with runs of white space as one space and none at the
ends (the JVM's own Unicode library, called as an SQL function; a text of ASCII alone, whose bytes are as many
as its characters, is only lower-cased). The fingerprint is a wide xxhash of it: two 64-bit hashes of
different seeds and the length. Equal fingerprints are a bucket; inside a bucket the canonical bytes are
compared, so neither a group nor a likeness of 1 is ever a collision. Exact digests know only 0 and 1.

Defined cases: a null text is the empty text; texts that differ in case, white space or normal form only
are equal; documents with equal ids follow each other, by text or, where an
id is frequent, by a hash; a null id comes last in the descending order, in
blocks by a hash, and names no group unless all of the group have none; a single document is its own
neighbour; only native functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import checkpointed
from textloom.llm.ranks import block_columns

#: Buckets of several documents are broadcast up to this number, else joined by a shuffle.
MAX_BROADCAST = 200_000
_NORMALIZER, _CASES = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """The canonical form of a text that is not null; plain ASCII needs no Unicode tables."""
    composed = F.java_method(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(True))
    folded = F.java_method(F.lit(_CASES), F.lit("foldCase"), composed, F.lit(True))
    wide = F.java_method(F.lit(_NORMALIZER), F.lit("compose"), folded, F.lit(True))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(wide)
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """128 bits of xxhash and the length, in hex."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(form)), part(F.xxhash64(F.lit(1), form)), F.lower(F.hex(F.octet_length(form).cast("long"))))


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the fingerprint of a text column; the canonical form is a column of its own first, so that it is made once."""
    formed = rows.select("*", canonical(F.col(text)).alias("_form"))
    return formed.select("*", digest(F.col("_form")).alias(name)).drop("_form")


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most MAX_BROADCAST rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def alike(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """1.0 if the fingerprints are equal and so are the canonical bytes."""
    same = F.when(a == b, F.when(text_a == text_b, 1.0).otherwise(F.when(canonical(text_a) == canonical(text_b), 1.0).otherwise(0.0)))
    return same.otherwise(0.0)


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, next, next_fingerprint): each document and the next one in descending order of the ids; after the last, the first.

    Neighbours meet in blocks of the id order. Which block follows which is found from the blocks' places
    alone; the first row of each block is the only one that goes to another, the block before it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wide, block = block_columns(docs.select("doc_id"), "doc_id", F.xxhash64("text"))
    # ids descend and rows without one come last
    order = F.when(F.col("doc_id").isNull(), F.lit(1 << 40)).otherwise(-wide)
    part = F.when(F.col("doc_id").isNull(), block).otherwise(-block)
    places = rows.select(order.alias("wide"), part.alias("block")).distinct()
    inside = places.select("wide", "block", F.lead("block").over(Window.partitionBy("wide").orderBy("block")).alias("inner"))
    ranges = places.groupBy("wide").agg(F.min("block").alias("first"))  # one row for each of at most 65 ranges
    everyone = Window.orderBy("wide")
    whole = everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outer = lambda c: F.coalesce(F.lead(c).over(everyone), F.first(c).over(whole))
    ranges = ranges.select("wide", outer("wide").alias("next_wide"), outer("first").alias("next_first"))
    ends = F.col("inner").isNull()
    follows = inside.join(F.broadcast(ranges), "wide").select(
        F.when(ends, F.col("next_wide")).otherwise(F.col("wide")).alias("from_wide"), F.when(ends, F.col("next_first")).otherwise(F.col("inner")).alias("from_block"), "wide", "block"
    )
    rows = with_fingerprint(rows.select("doc_id", "text", order.alias("wide"), part.alias("block")), "text", "fingerprint")
    within = Window.partitionBy("wide", "block").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    near = rows.select("*", F.row_number().over(within).alias("row"), F.lead(F.struct("text", "fingerprint")).over(within).alias("next"))
    heads = near.where("row = 1").select(F.col("wide").alias("from_wide"), F.col("block").alias("from_block"), F.struct("text", "fingerprint").alias("head"))
    after = heads.join(follows, ["from_wide", "from_block"]).select("wide", "block", "head")
    near = near.join(after, ["wide", "block"]).withColumn("next", F.coalesce("next", "head"))
    return near.select("doc_id", "text", "fingerprint", F.col("next.text").alias("next"), F.col("next.fingerprint").alias("next_fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id).

    The edited text has its last third replaced by the start of the next document in descending order of
    the ids. group_id is the smallest id of the documents with the same canonical bytes.
    """
    edited = F.expr("concat(left(text, length(text) - cast(floor(length(text) / 3) as int)), left(next, cast(floor(length(text) / 3) as int)))")
    near = neighbours(docs).select("*", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    near = with_fingerprint(near, "edited", "edited_fingerprint")
    near = near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        alike(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("text"), F.col("edited")).alias("near_edited"),
        alike(F.col("fingerprint"), F.col("next_fingerprint"), F.col("text"), F.col("next")).alias("near_next"),
        F.xxhash64("text").alias("t"),
    )
    return with_groups(near, docs).drop("t")


def buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprint, least) of the buckets of several documents, and (doc_id, t, least) of the documents of buckets that are collisions.

    Only ids and fingerprints are grouped first, without texts. The canonical bytes of the documents in buckets of several
    are then compared: a bucket's smallest and largest form, combined before the shuffle, are equal unless
    different forms collide, and then the bucket is split by its forms. t tells rows of one id apart.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = with_fingerprint(rows, "text", "fingerprint").select("doc_id", "fingerprint")
    several = checkpointed(slim.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("fingerprint", "least"))
    forms = rows.select("doc_id", F.xxhash64("text").alias("t"), canonical(F.col("text")).alias("form")).select("*", digest(F.col("form")).alias("fingerprint"))
    members = forms.join(few(several.select("fingerprint")), "fingerprint", "left_semi")
    mixed = checkpointed(members.groupBy("fingerprint").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("fingerprint"))
    if mixed.isEmpty():
        return several, members.select("doc_id", "t", F.col("doc_id").alias("least")).limit(0)
    collided = members.join(few(mixed), "fingerprint", "left_semi")
    least = collided.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("least"))
    return several, checkpointed(collided.join(least, ["fingerprint", "form"]).select("doc_id", "t", "least").distinct())


def with_groups(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, t, fingerprint, ...) of docs with group_id; no texts are in these joins."""
    several, split = buckets(docs)
    split = split.select(F.col("doc_id").alias("own_id"), F.col("t").alias("own_t"), F.col("least").alias("of_form"))
    found = rows.join(few(several), "fingerprint", "left").join(split, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("t") == F.col("own_t")), "left")
    return found.select(*rows.columns, F.coalesce(F.when(F.col("own_t").isNotNull(), F.col("of_form")).otherwise(F.col("least")), F.col("doc_id")).alias("group_id"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id): the smallest id of the documents with the same canonical bytes."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "fingerprint").select("doc_id", F.xxhash64("text").alias("t"), "fingerprint")
    return with_groups(rows, docs).drop("t")
