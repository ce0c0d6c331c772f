"""Near copies, fingerprints, shards, leaks, licenses and archives against plain versions."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, fingerprint, licenses, near_dup, sharding, shingles, warc

WORDS = [f"w{i}" for i in range(3000)]


def _sets(texts, width=4):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def _components(ids, sets, percent=80):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_different_texts_of_one_id(spark):
    text = lambda p, n=30: " ".join(f"{p}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("b")), (3, text("b") + " x"), (7, ""), (7, " "), (7, ""), (None, "q"), (9, text("a")), (9, text("c", 9)), (9, text("c", 9)), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dup.link(docs).collect())
    assert linked == [("3", 28, "3", True), *[("5", 27, "3", False), ("5", 27, "5", True)], *[("7", 0, "7", True)] * 3, ("9", 0, "9", True), *[("9", 6, "9", True)] * 2, ("9", 27, "5", False), ("None", 1, "None", False)]
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in near_dup.keep_one(docs).collect())
    assert kept == sorted([("3", text("b") + " x"), ("5", text("a")), ("7", ""), ("7", " "), ("9", text("c", 9)), ("9", "None"), ("None", "q")])


def near_texts():
    rng = random.Random(5)
    texts = []
    for size in (3, 30, 120, 400):
        base = [rng.choice(WORDS) for _ in range(size)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 20))):
                copy[rng.randrange(size)] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    texts += ["", None, "one", "ONE", "one two", "one  two"]
    rng.shuffle(texts)
    return texts


def test_near_copies_against_all_pairs(spark):
    texts = near_texts()
    ids = list(range(10, 10 + len(texts)))
    out = {r["doc_id"]: r for r in near_dup.link(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    sets = _sets(texts)
    want = _components(ids, sets)
    assert {i: out[i]["component_id"] for i in ids} == want
    assert [out[i]["n_shingles"] for i in ids] == [len(s) for s in sets]
    assert all(out[i]["kept"] == (want[i] == i) for i in ids)
    assert len({*want.values()}) < len(ids)


def test_keep_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (1, "A b c d e f", "y"), (None, "a b c d e f", "z"), (9, "other words are here now too", "w")], "doc_id long, text string, extra string")
    assert sorted(((r["doc_id"] or 0), r["extra"]) for r in near_dup.keep_one(docs, 5, 80).collect()) == [(0, "z"), (1, "y"), (9, "w")]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for shared in (0.3, 0.6, 0.9):
        n = 1000
        both = int(round(2 * n * shared / (1 + shared)))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[n - both : n], pool[n : 2 * n - both])))
        r = near_dup.registers([a, b, np.unique(np.concatenate((a, b)))])
        assert (near_dup.merge(r[0], r[1]) == r[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess = near_dup.estimate(r[:1], r[1:2], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(guess - true) < 0.12


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        a, b = pool[rng.random(len(pool)) < 0.93], pool[rng.random(len(pool)) < 0.93]
        wa, wb = (near_dup.parity(x).view(np.uint64)[None, :] for x in (a, b))
        fits = near_dup.room_table(wa, wb, np.array([len(a)]), np.array([len(b)]), 80)[0, 0]
        shared = len(np.intersect1d(a, b))
        assert fits or 100 * shared < 80 * (len(a) + len(b) - shared)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 60)], "a long, b long")
    out = {r["node"]: r["component"] for r in near_dup.components(links).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_shingles_of_short_texts():
    sets = shingles.shingle_sets(["a b", "a B", "b a", "", None, "a b c d", "x y z a b c d"], 4)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 1, 4]
    assert sets[0] == sets[1] != sets[2]


def test_fingerprints(spark):
    texts = {1: "Straße  Café", 2: "STRASSE café\n", 5: "x y z" * 20, 6: "same", 7: " Same "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        follow, text = texts[order[(at + 1) % len(order)]], texts[i]
        k = len(text) // 3
        edited = text[: len(text) - k] + follow[:k]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i]["n_chars"] == len(text)
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != out[5]["fingerprint"]
    assert out[2]["near_next"] == 1.0
    assert out[7]["near_next"] == 1.0
    assert out[6]["near_next"] == 0.0
    groups = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(docs).collect()}
    assert groups == {1: 1, 2: 1, 5: 5, 6: 6, 7: 6} == {i: r["group_id"] for i, r in out.items()}


def test_fingerprint_groups_against_plain_forms(spark, monkeypatch):
    def form(text):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())

    texts = ["A b", "a  B", "ＡＢ", "ab", "ß", "SS", "ﬁ", "FI", None, "", " \n", "x" * 5000, "X" * 5000, "É", "e\u0301", "ab"]
    rows = [(i // 2 if i % 3 else i, t) for i, t in enumerate(texts)] + [(None, "ab"), (None, "only"), (None, "only"), (3, "ab")]
    least = {}
    for i, t in rows:
        least[form(t)] = min([x for x in (i, least.get(form(t))) if x is not None], default=None)
    expected = sorted((str(i), str(least[form(t)])) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (fingerprint.digest, lambda f: F.lit("one bucket for all")):  # the second: every form collides
        monkeypatch.setattr(fingerprint, "digest", digest)
        assert sorted((str(r["doc_id"]), str(r["group_id"])) for r in fingerprint.fingerprints(docs).collect()) == expected


def test_fingerprints_over_many_blocks(spark, monkeypatch):
    from textloom.llm import ranks

    monkeypatch.setattr(ranks.block_columns, "__defaults__", (5,))
    rng = random.Random(2)
    texts = {i: "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 30))) for i in rng.sample(range(10_000), 700)}
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        follow, text = texts[order[(at + 1) % len(order)]], texts[i]
        edited = text[: len(text) - len(text) // 3] + follow[: len(text) // 3]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_one_id_with_many_rows(spark, monkeypatch):
    from textloom.llm import ranks

    monkeypatch.setattr(ranks.block_columns, "__defaults__", (2,))
    rng = random.Random(4)
    for frequent in (0, 25, 99):
        ids = [frequent] * 50 + rng.sample([i for i in range(100) if i != frequent], 50) + [None] * 6
        texts = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in ids]
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        wide, block = ranks.block_columns(docs, "doc_id", F.xxhash64("text"))
        assert docs.groupBy(wide, block).count().agg(F.max("count")).first()[0] < 20
        follow = {hashlib.sha256((a[:20] + b[:10]).encode()).hexdigest(): (i, j) for i, a in enumerate(texts) for j, b in enumerate(texts)}
        after = dict(follow[r["edited_sha256"]] for r in fingerprint.fingerprints(docs).collect())
        assert sorted(after) == sorted(after.values()) == list(range(len(ids)))
        seen = []
        start = next(i for i in after if (ids[i] or 0) == max(x or 0 for x in ids) and ids[next(k for k, v in after.items() if v == i)] is None)
        at = start
        for _ in ids:
            seen.append(ids[at])
            at = after[at]
        assert at == start
        assert seen == sorted((i for i in ids if i is not None), reverse=True) + [None] * 6
        rows = sharding.assign(docs, [1.0] * 3).collect()
        for shard in {r["shard"] for r in rows}:
            own = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])
            assert [r["slot"] for r in own] == list(range(len(own)))
            assert [r["doc_id"] for r in own] == sorted((r["doc_id"] for r in own), key=lambda i: (i is None, i))


def test_shards(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 9)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.assign(docs, [1.0] * 8).collect()
    for shard, own in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        own = list(own)
        assert 0 <= shard < 8
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(len(own) - 375) < 100
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {8}
    assert 0.06 < sum(r["grown_shard"] == 8 for r in rows) / len(rows) < 0.17
    assert all(r["text_crc32"] == zlib.crc32((f"text {r['doc_id']}" * (r["doc_id"] % 9)).encode()) for r in rows)
    heavy = sharding.assign(docs, [3.0, 1.0]).groupBy("shard").count().collect()
    assert 0.7 < next(r["count"] for r in heavy if r["shard"] == 0) / 3000 < 0.8


def test_leaks_with_other_names_and_numbers(spark):
    item = "when Alice Baker walks to town she buys 12 apples for 5 dollars and gives 12 to Alice Baker again today"
    items = spark.createDataFrame([(1, item), (2, "too short")], "item_id long, text string")
    fill = "some words before it all, "
    texts = {
        1: fill + item,
        2: fill + item.replace("Alice", "Zelda").replace("Baker", "Quill").replace("12", "77").replace("5", "9") + " and more",
        3: fill + item.replace("gives 12", "gives 13").replace("12 apples", "99 apples").replace("gives 13", "gives 14"),
        4: fill.upper() + item.upper(),
        5: fill + "nothing of the kind",
        6: item.replace(" ", "  ").replace("town", "town,"),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.leaks(docs, items).collect()}
    assert {1, 2, 6} <= out.keys() <= {1, 2, 4, 6}
    assert out[1]["changed_slots"] == 0 < out[2]["changed_slots"]
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} >= {3, 5}


def test_leaks_beside_a_look_alike_and_under_one_id(spark, monkeypatch):
    item = "when Alice Baker walks to town she buys 12 apples for 5 dollars and gives 12 to Alice Baker again today"
    other = item.replace("gives 12", "gives 13")  # its slots disagree
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = len(item.split()) // 2
    first, second = " ".join(item.split()[:half]), " ".join(item.split()[half:])
    rows = [(1, f"x {other} . then {item} ."), (2, f"x {other} . then {other} ."), (3, first), (3, second), (4, "x y z v w"), (4, f"so {item}"), (None, item), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (decontaminate.MAX_BROADCAST, 0):  # 0: every join is shuffled
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", most)
        assert sorted(r["doc_id"] for r in decontaminate.leaks(docs, items).collect()) == [1, 4]
        kept = sorted((str(r["doc_id"]), str(r["text"])) for r in decontaminate.clean(docs, items).collect())
        assert kept == sorted((str(i), str(t)) for i, t in rows if (i, t) not in [rows[0], rows[5]])


def test_licenses_and_inheritance(spark):
    mit = "Released under the MIT License."
    files = [("a/LICENSE", mit), ("a/b/c/x.py", "code only"), ("a/b/y.py", "Licensed under the Apache License, Version 2.0.\n" + "code " * 50), ("a/b/z.py", None), ("q/w.py", "we license nothing here to anyone at all"), ("top.py", "x" * 50)]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, place string, text string")
    out = {r["path"]: (r["license"], r["origin"], r["directory"]) for r in licenses.scan(docs, F.col("place")).collect()}
    assert out == {
        "a/LICENSE": ("MIT", "own", None),
        "a/b/c/x.py": ("Apache-2.0", "inherited", "a/b"),
        "a/b/y.py": ("Apache-2.0", "own", None),
        "a/b/z.py": ("Apache-2.0", "inherited", "a/b"),
        "q/w.py": (None, "none", None),
        "top.py": (None, "none", None),
    }


def _plain_license(text):
    """(whole, cosine, license) of a text by dense comparison of every segment with every template."""
    lists = [licenses.terms(t) for _, t in licenses.templates()]
    spread = collections.Counter(t for c in lists for t in c)

    def vector(counts):
        return {t: (1 + math.log(n)) * licenses.idf(spread[t]) for t, n in counts.items()}

    vectors = [vector(c) for c in lists]
    paragraphs = re.split(r"[\r\n][ \t\r]*[\r\n]\s*", text)
    best = (False, 0.0, "")
    for segment in {text, *paragraphs, *re.split(r"[\r\n]+", text), *(s for p in paragraphs for s in re.split(r"(?<=[.;!?])\s+", p))}:
        x = vector(licenses.terms(segment))
        for (name, _), y in zip(licenses.templates(), vectors, strict=True):
            shared = x.keys() & y.keys()
            if len(shared) >= licenses.LEAST:
                cosine = round(sum(x[t] * y[t] for t in shared) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), 12)
                if cosine >= licenses.THRESHOLD:
                    a = (segment == text, cosine, name)
                    best = max(best, a, key=lambda b: (b[0], b[1], [-ord(c) for c in b[2]]))
    return best if best[2] else None


def test_license_scan_against_plain_version(spark):
    text_of = lambda name: (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text()
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", "of", "code", "mit", "und", "use", "work", "xyzzy", "under", "free"]) for _ in range(n))
    wrapped = "# This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General Public License,\n# version 3.\n\nx = 1\n"
    short = [t for _, t in licenses.SHORT_FORMS]
    deep = "/".join("abcdefghijklmnopq")
    files = [("LICENSE", text_of("MIT")), (f"{deep}/z.c", "int main;"), ("b/LICENSE", text_of("BSD-3-Clause").replace("<copyright holders>", "Ann")), ("b/c/d/e/f/g/h/i/j/k/l/x", "x"), ("c/COPYING", text_of("Apache-2.0"))]
    files += [("c/y.py", wrapped), ("c/z.py", None), ("d/one", short[0] + " " + "word " * 300), ("d/two", "a\n" + short[2] + "\nb"), ("d/three", ""), ("e/mit", "mit."), ("e/f", prose(400)), ("e/g", prose(5) + ". " + short[14]), ("e/g", prose(5))]
    files += [(f"m/{i}", "\n".join(rng.choice([prose(9), rng.choice(short), text_of("ISC")[:300]]) for _ in range(rng.randrange(4)))) for i in range(12)]
    docs = spark.createDataFrame([(None if i == 9 else i // 2, p, t, 1) for i, (p, t) in enumerate(files)], "doc_id long, place string, text string, license int")
    own = [_plain_license(t or "") for _, t in files]
    assert [o[0] and o[2] for o in own[:5] if o] == ["MIT", "BSD-3-Clause", "Apache-2.0"]
    votes = collections.defaultdict(collections.Counter)
    for (p, _), o in zip(files, own, strict=True):
        if o:
            votes[p.rpartition("/")[0]][o[0], o[2]] += 1
    given = {}
    for d, of in votes.items():
        whole = [(-n, name) for (w, name), n in of.items() if w]
        if whole or len({name for _, name in of}) == 1:
            given[d] = min(whole)[1] if whole else next(iter(of))[1]
    expected = []
    for (p, _), o in zip(files, own, strict=True):
        d = p.rpartition("/")[0]
        while o is None and d not in given and d:
            d = d.rpartition("/")[0]
        expected.append((p, o[2], "own", None) if o else (p, given[d], "inherited", d) if d in given else (p, None, "none", None))
    for hot in (licenses.HOT, 1):
        licenses.HOT, before = hot, licenses.HOT
        got = [(r["path"], r["license"], r["origin"], r["directory"]) for r in licenses.scan(docs, F.col("place")).collect()]
        licenses.HOT = before
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(e[2] == "inherited" and e[3] == "" for e in expected)


def _records(n=6):
    out = []
    for i in range(n):
        payload = f"<p>page {i} {'WARC/1.1 ' * (i == 2)}</p>".encode()
        http = b"HTTP/1.1 200 OK\r\n\r\n"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(http + payload)}\r\n\r\n"
        out.append(head.encode() + http + payload + b"\r\n\r\n")
    return out


def _ids(data):
    found = list(warc.parse_archive(data))
    return [x["page_id"] for x in found if x["kind"] == "record"], [(x["start"], x["stop"]) for x in found if x["kind"] == "gap"]


def test_salvage_of_plain_archives():
    parts = _records()
    whole = b"".join(parts)
    assert _ids(whole) == ([0, 1, 2, 3, 4, 5], [])
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    broken = whole.replace(b"page 1 ", b"page X ")  # a digest fails: this record alone is lost
    assert _ids(broken) == ([0, 2, 3, 4, 5], [(starts[1], starts[2])])
    cut = whole[: starts[3] + 40] + whole[starts[4] :]  # a head is cut: the next version line is found
    assert _ids(cut) == ([0, 1, 2, 4, 5], [(starts[3], starts[3] + 40)])
    assert _ids(whole[:-5]) == ([0, 1, 2, 3, 4], [(starts[5], len(whole) - 5)])
    assert _ids(b"junk\r\n" + whole) == ([0, 1, 2, 3, 4, 5], [(0, 6)])
    assert _ids(b"") == ([], [])


def test_salvage_of_gzip_members():
    members = [gzip.compress(p) for p in _records()]
    whole = b"".join(members)
    assert _ids(whole) == ([0, 1, 2, 3, 4, 5], [])
    starts = [sum(map(len, members[:i])) for i in range(7)]
    bad = bytearray(whole)
    bad[starts[2] + 30 : starts[2] + 60] = b"\0" * 30
    ids, gaps = _ids(bytes(bad))
    assert ids == [0, 1, 3, 4, 5]
    assert gaps == [(starts[2], starts[3])]
    assert _ids(whole[: starts[5] + 20])[0][:5] == [0, 1, 2, 3, 4]
    assert _ids(whole[: starts[1]] + b"garbage" + whole[starts[1] :]) == ([0, 1, 2, 3, 4, 5], [(starts[1], starts[1] + 7)])


def test_salvage_of_one_member_with_many_records():
    assert _ids(gzip.compress(b"".join(_records(50)))) == (list(range(50)), [])
    rng = random.Random(1)
    noise = [rng.randbytes(300) for _ in range(50)]
    records = []
    for i, body in enumerate(noise):
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        records.append(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: 300\r\n\r\n".encode() + body + b"\r\n\r\n")
    data = bytearray(gzip.compress(b"".join(records)))
    at = len(data) // 4
    data[at : at + 40] = b"\0" * 40
    ids, gaps = _ids(bytes(data))
    assert ids[:10] == list(range(10))  # all before the damage
    assert gaps == [(0, len(data))]


def test_salvage_looks_at_each_position():
    parts = _records()
    packed = gzip.compress(b"x" * 50)
    body = b"HTTP/1.1 200 OK\r\n\r\n" + packed
    odd = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    plain = b"".join([*parts[:3], odd, *parts[3:]])
    assert _ids(b"XX" + plain[2:]) == ([1, 2, 77, 3, 4, 5], [(0, len(parts[0]))])
    mixed = parts[0] + gzip.compress(parts[1]) + b"junk" + gzip.compress(parts[2] + parts[3]) + parts[4]
    assert _ids(mixed)[0] == [0, 1, 2, 3, 4]
    assert [b - a for a, b in _ids(mixed)[1]] == [4]


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 16])
def test_pieces_of_plain_bytes_are_parsed_alike(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    parts = _records(9)
    damaged = b"".join([*parts[:3], b"??", parts[3][5:], *parts[4:6], parts[6].replace(b"page 6", b"page X"), *parts[7:]])
    for data in (b"".join(parts), damaged, damaged[:-20], b"", b"WARC/1.1\r\nContent-Length: 99999\r\n\r\n" + b"".join(parts)):
        key = lambda x: (x["kind"], x["start"], x["stop"], x.get("page_id"))
        assert list(map(key, warc.parse_pieces(data[i : i + piece] for i in range(0, len(data), piece)))) == list(map(key, warc.parse_plain(data)))


def test_damage_to_a_written_archive_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w", block_bytes=3000)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 1  # bounded files
    assert all(f.stat().st_size <= warc.FILE_BLOCKS * 3000 for f in files)
    data = bytearray(files[0].read_bytes())
    heads = [m.start() for m in re.finditer(re.escape(b"\x1f\x8b\x08"), bytes(data))]
    at = heads[len(heads) // 2]
    data[at + 60 : at + 90] = b"\0" * 30
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    files[0].write_bytes(bytes(data))
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sum(r["kind"] == "record" for r in rows) == 199
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert [(g["start"], g["stop"]) for g in gaps] == [(at, heads[len(heads) // 2 + 1])]


def test_long_and_clashing_pages(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh \u00e9") for _ in range(1 << 20)) * 17  # beyond 16 MB: an empty member follows
    pages = spark.createDataFrame([(1, "u", long, 5), (2, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 6)], "page_id long, url string, html string, payload_bytes int")
    out = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {i: r["payload_bytes"] for i, r in out.items()} == {1: len(long.encode()), 2: 38}


def test_archives_of_pages(spark):
    pages = [(5, "http://a/", "same"), (2, "http://b/ x", "same"), (9, None, "same"), (3, "http://c/", ""), (4, "http://d/", None), (7, "u", "é WARC/1.1\r\n\r\n"), (None, "v", "same"), (2, "http://b/ x", "same")]
    out = warc.round_trip(spark.createDataFrame([(*p, "?") for p in pages], "page_id long, url string, html string, digest string")).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out if r["record_type"] == "response")
    assert got == [(0, 4, "response", None), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "response", None), (7, len("é WARC/1.1\r\n\r\n".encode()), "response", None)]
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in out if r["record_type"] == "revisit") == [(4, 0, 3), (5, 4, 2), (9, 4, 2)]
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode() for r in out if r["payload_bytes"] == 4)


def test_pipeline_against_its_parts(spark):
    sf = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in corpus_pipeline.keep_quality(spark, docs, sf).collect()}
    ids = sorted(rows)
    linked = _components(ids, _sets([rows[i] for i in ids], 5))
    ids = [i for i in ids if linked[i] == i]
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert sorted(out) == [i for i in ids if i not in leaked]
    assert all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in out.values())
