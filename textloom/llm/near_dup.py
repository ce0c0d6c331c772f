"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct word shingles. Every element is the start of a Poisson process that
throws exponentially spaced points at REGISTERS registers; a register keeps the smallest point of all
elements, truncated on an exponential scale (base BASE). Registers are mergeable by maximum and two sets
agree in one with a probability of about their similarity. Bands of register values deal sets into buckets;
pairs from a bucket are estimated jointly by likelihood and then verified on the full sets.

No pairs are listed within a group. Equal sets form a class, of which one stands for all. In each bucket
every member meets the smallest one (a star). What is left apart after that meets the bucket's other
members only if an exact bound leaves room: each set has a bitmap of PARITY bits, one flipped by every
element, and two bitmaps differ in no more bits than the sets do in elements. So no link is lost beyond
the misses of the bands, (1 - 0.8^6)^42 < 3e-6 at similarity 0.8.

A graph node is a class of equal sets. Its number is its smallest id; where texts of different sets share an
id, all but one of their classes have a hash of the set for a number, so that texts are linked and not ids.

Defined cases: null or empty text, or text without words, has the empty set and is linked with nothing; a
null id takes part in nothing and gets a null component, not kept; repeated rows are equal texts and share
a component; different texts of one id are linked only if they are alike; equal similarity needs no
tie-break, a component is named by its smallest id; other columns of the input are left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpointed, map_arrow
from textloom.llm.shingles import memo, mix, shingle_sets

REGISTERS = 256
BANDS, ROWS = 42, 6
#: Scale of the truncated registers: floor(1 - log_b(A * x)), cut to 0..TOP.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Pairs whose estimate is below this are not verified: over five standard errors under 0.8.
LEAST_ESTIMATE = 0.62
#: Bits of the parity bitmaps.
PARITY = 2048
#: Rows of a block of a query set or of what it meets.
BLOCK = 1024
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """(sets, m) register values; the empty set has zeros."""
    docs, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    smallest = np.full(docs * m, np.inf)
    if sizes.sum():
        elements = np.concatenate(sets).astype(np.uint64)
        owner = np.repeat(np.arange(docs), sizes)
        horizon = np.where(sizes > 0, (math.log(m) + 7) / np.maximum(sizes, 1), 0.0)
        todo = np.ones(len(elements), bool)
        while todo.any():
            state, own = elements[todo].copy(), owner[todo]
            time = np.zeros(len(state))
            while len(state):
                state += _GAMMA
                draw = mix(state)
                time += -np.log1p(-(draw >> np.uint64(12)).astype(np.float64) * 2.0**-52) / m
                live = time <= horizon[own]
                state, own, time, draw = state[live], own[live], time[live], draw[live]
                np.minimum.at(smallest, own * m + (draw & np.uint64(m - 1)).astype(np.int64), time)
            open_docs = (sizes > 0) & np.isinf(smallest.reshape(docs, m)).any(axis=1)  # rare: look further
            horizon = np.where(open_docs, horizon * 2, 0.0)
            todo = open_docs[owner]
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(RATE * smallest) / math.log(BASE))
    values = np.where(np.isinf(smallest), 0, np.clip(values, 0, TOP))
    return values.reshape(docs, m).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) keys of the bands' register values."""
    parts = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _GAMMA + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of each pair given how many registers are larger in a, larger in b, or equal."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    most = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 201)[None, :] * most

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = chance(u - v * j), chance(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sum(np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0.0) for k, p in ((above, up), (below, down), (equal, 1 - up - down)))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def profile(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, n, s1, s2, bands): hash of the text, set size, a 128-bit digest of the set (null if empty) and its band keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2).to_pylist(), width)
        keys = band_keys(registers(sets))
        digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
        low = [None if d is None else (d & (1 << 64) - 1) - (1 << 63) for d in digests]
        high = [None if d is None else (d >> 64) - (1 << 63) for d in digests]
        bands = pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))
        columns = [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), bands]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "s1", "s2", "bands"])

    rows = docs.select("doc_id", text_hash().alias("t"), "text")
    return map_arrow(rows, run, f"doc_id {rows.dtypes[0][1]}, t long, n long, s1 long, s2 long, bands array<long>", memo)


def text_hash() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64("text")


def parity(elements: np.ndarray) -> np.ndarray:
    """The set's bitmap, as PARITY / 64 longs."""
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, bits, registers, hashes) of the documents that nodes (node, doc_id, t) names."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        kept = registers(sets)
        columns = [batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(parity, sets)), pa.list_(pa.int64()))]
        columns += [pa.array([r.tobytes() for r in kept], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "bits", "registers", "hashes"])

    rows = docs.select("doc_id", text_hash().alias("t"), "text").join(nodes, ["doc_id", "t"]).dropDuplicates(["doc_id", "t", "node"]).select("node", "text")
    return map_arrow(rows, run, f"node {rows.dtypes[0][1]}, n long, bits array<long>, registers binary, hashes array<long>", memo)


def room(bits_a: Column, bits_b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """False only if the bitmaps prove that the similarity is too low."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i)))) for i in range(PARITY // 64)))
    return (100 + percent) * differ <= (100 - percent) * (n_a + n_b)


def room_table(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """room() of every row of a with every row of b: bitmaps as (rows, PARITY / 64) of 64-bit words."""
    differ = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        differ += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return (100 + percent) * differ <= (100 - percent) * (n_a[:, None] + n_b[None, :])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; pairs without room or of low estimate are not looked into."""
    slim = sets.select("node", "n", "bits")
    pairs = pairs.join(slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    pairs = pairs.join(slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    pairs = pairs.where(room(F.col("ba"), F.col("bb"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()
    each = pairs.join(sets.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("hashes").alias("ha")), "a")
    each = each.join(sets.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("hashes").alias("hb")), "b")
    each = each.select("a", "b", "ra", "rb", "ha", "hb")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
        ha, hb = batch.column(4), batch.column(5)
        na, nb = (np.diff(h.offsets.to_numpy()).astype(float) for h in (ha, hb))
        likely = (estimate(ra, rb, na, nb) >= LEAST_ESTIMATE) if batch.num_rows else np.zeros(0, bool)
        keep = np.zeros(batch.num_rows, bool)
        for i in np.flatnonzero(likely):
            x, y = ha[i].values.to_numpy(), hb[i].values.to_numpy()
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (len(both) - shared)
        return batch.select([0, 1]).filter(pa.array(keep))

    kind = dict(pairs.dtypes)["a"]
    return map_arrow(each, run, f"a {kind}, b {kind}")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable, by alternating stars."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.distinct())


def numbered(usable: DataFrame) -> DataFrame:
    """(s1, s2, doc_id, t, node): the document that stands for each class of equal sets, and the class' number."""
    classes = usable.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("first")).select("s1", "s2", "first.doc_id", "first.t")
    own = classes.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("own"), F.count("*").alias("sets")).where("sets > 1").select("doc_id", "own")
    node = F.when(F.coalesce(F.col("own") == F.struct("s1", "s2"), F.lit(True)), F.col("doc_id")).otherwise(F.xxhash64("s1", "s2").cast(dict(usable.dtypes)["doc_id"]))
    return classes.join(own, "doc_id", "left").select("s1", "s2", "doc_id", "t", node.alias("node"))


def placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, t, n, component): one row for each row of docs; t is text_hash()."""
    seen = checkpointed(profile(docs, width))
    usable = seen.where("doc_id IS NOT NULL AND n > 0")
    classes = checkpointed(numbered(usable))
    chosen = usable.join(classes, ["s1", "s2", "doc_id", "t"]).dropDuplicates(["s1", "s2", "doc_id", "t"])
    buckets = chosen.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = checkpointed(buckets.join(shared, "key"))
    wanted = classes.select("node", "doc_id", "t").join(members.select("node").distinct(), "node", "left_semi")
    sets = checkpointed(full_sets(docs, wanted, width))
    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = checkpointed(verify(stars, sets, percent))
    found = checkpointed(components(links))
    more = checkpointed(verify(apart(members, found, sets, percent), sets, percent))
    found = checkpointed(components(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)))
    named = classes.join(found, "node", "left").select("s1", "s2", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = named.join(least, "component").select("s1", "s2", F.col("name").alias("component"))
    out = seen.join(named, ["s1", "s2"], "left")
    return out.select("doc_id", "t", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def link(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs (doc_id, text)."""
    kept = F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False))
    return placed(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def apart(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of buckets of three or more that the stars left in different components and that may be similar.

    In a bucket, members outside its commonest component must meet all others. All buckets with the same
    commonest component are one group, so a pair is looked at once for a group and not in each bucket; in a
    group, the members outside are a query set against all of it, block by block of at most about BLOCK
    rows, and only pairs that the bitmaps leave room for come out.
    """
    placed = members.where("members > 2").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = per.groupBy("key").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    placed = placed.join(main, "key").select("main", "node", "component").distinct()
    placed = placed.join(sets.select("node", "n", "bits"), "node")
    sizes = placed.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = checkpointed(placed.join(sizes, "main").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    row = F.struct("node", "component", "n", "bits")
    outside = placed.where("component <> main").groupBy("main", "block", "blocks").agg(F.collect_list(row).alias("x"))
    outside = outside.select("main", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    every = placed.groupBy("main", "block").agg(F.collect_list(row).alias("y"))
    kind = dict(members.dtypes)["node"]

    def run(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for i in range(batch.num_rows):
            (a, ca, na, wa), (b, cb, nb, wb) = (_unpacked(batch.column(k)[i].values) for k in (0, 1))
            may = room_table(wa, wb, na, nb, percent) & (ca[:, None] != cb[None, :])
            at, bt = np.nonzero(may)
            parts.append((np.minimum(a[at], b[bt]), np.maximum(a[at], b[bt])))
        both = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.table({"a": both[0], "b": both[1]})

    return map_arrow(outside.join(every, ["main", "block"]).select("x", "y"), run, f"a {kind}, b {kind}").distinct()


def _unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, component, n, words) of a block."""
    words = rows.field("bits").flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
    return rows.field("node").to_numpy(), rows.field("component").to_numpy(), rows.field("n").to_numpy(), words


def keep_one(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """docs with one document of each component, of its texts under the smallest id the one of the smallest hash.

    Texts without words are linked with nothing and stay, as do rows without an id; a row that is repeated stays once.
    """
    found = placed(docs, width, percent).where("component = doc_id")
    group = F.when(F.col("n") == 0, F.col("t"))
    kept = checkpointed(found.groupBy("doc_id", group.alias("wordless")).agg(F.min("t").alias("t")).select("doc_id", "t"))
    named = docs.withColumn(_KEY, text_hash()).join(kept.withColumnRenamed("t", _KEY), ["doc_id", _KEY], "left_semi")
    # partitioned by the same columns already: no second shuffle
    named = named.dropDuplicates(["doc_id", _KEY])
    return named.select(*docs.columns).unionAll(docs.where(F.col("doc_id").isNull()))


#: A column name that no table has.
_KEY = "__text_hash"
