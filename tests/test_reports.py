"""Analyses, sketches, sources and sequence models on small inputs with known results."""

from __future__ import annotations

import math
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import analysis as A
from textloom.operators import encode, grams, sequence, sketch
from textloom.plans import catalog
from textloom.sources import files, wiki_dump
from textloom.streaming.count_min import CountMin, stream_estimates
from textloom.streaming.topk import TopK, stream_top_k

PAGES = [
    "\n  <page>\n    <title>One</title>\n    <id>1</id>\n    <revision>\n      <id>11</id>\n      <timestamp>2001-01-01T00:00:00Z</timestamp>\n      <contributor>\n        <username>Ann</username>\n        <id>5</id>\n      </contributor>\n      <minor />\n      <comment>c &amp; d</comment>\n      <text xml:space=\"preserve\">body</text>\n    </revision>\n  </page>",
    "\n  <page>\n    <title>Two</title>\n    <id>2</id>\n    <revision>\n      <id>0012</id>\n      <timestamp>t</timestamp>\n      <contributor>\n        <ip>1.2.3.4</ip>\n      </contributor>\n      <text xml:space=\"preserve\">#REDIRECT [[One]]</text>\n    </revision>\n  </page>",
    "\n  <page>\n    <title>Three</title>\n    <id>3</id>\n    <restrictions>move</restrictions>\n    <revision>\n      <id>13</id>\n      <timestamp>t</timestamp>\n      <contributor>\n        <username></username>\n        <id>7</id>\n      </contributor>\n      <text xml:space=\"preserve\"></text>\n    </revision>\n  </page>",
    "\n  <page>\n    <title>Cut</title>\n    <id>4</id>\n    <revision>\n      <id>14</id>\n      <timestamp>t</timestamp>\n      <contributor>\n        <username>Bob</usern",
    "\n</mediawiki>",
    "no page at all",
]


def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_idx long, page string")


def test_columns_of_pages(spark):
    rows = wiki_dump.columnize(pages(spark)).orderBy("page_idx").collect()
    assert [(r["title"], r["id"], r["revision_id"], r["revision_contributor_id"], r["ip"], r["comment"], r["text"]) for r in rows[:3]] == [
        ("One", 1, 11, 5, None, "c &amp; d", "body"),
        ("Two", 2, 12, 0, "1.2.3.4", None, "#REDIRECT [[One]]"),
        ("Three", 3, 0, 7, None, None, ""),
    ]
    assert rows[2]["revision_restriction"] == "move"
    assert [r["leftovers"] is None for r in rows] == [True, True, True, False, False, False]


def test_pages_come_back(spark):
    back = wiki_dump.rebuild(wiki_dump.columnize(pages(spark)))
    assert [r["page"] for r in back.orderBy("page_idx").collect()] == PAGES
    assert wiki_dump.rebuild_body(wiki_dump.columnize(pages(spark))).first()["body"] == "".join(PAGES)


def test_read_a_dump_in_parallel(spark, tmp_path):
    dump = "<mediawiki><siteinfo>s</siteinfo>" + "".join(PAGES[:3]) + PAGES[4]
    (tmp_path / "dump.xml").write_text(dump)
    read = wiki_dump.read_pages(spark, str(tmp_path / "dump.xml"))
    assert read.count() == 4
    table = wiki_dump.columnize(read)
    assert sorted(r["title"] for r in table.where("title is not null").collect()) == ["One", "Three", "Two"]
    parts = [r["page"] for r in wiki_dump.rebuild(table).orderBy("page_idx").collect()]
    assert "".join(parts).removesuffix("  </page>") == dump


def test_envelope(spark):
    df = spark.createDataFrame([("a</siteinfo>b",), ("no mark",)], "t string").select(wiki_dump.split_envelope(F.col("t")).alias("e"))
    assert [tuple(r["e"]) for r in df.collect()] == [("a</siteinfo>", "b", ""), ("", "no mark", "")]
    assert [r[0] for r in df.select(wiki_dump.join_envelope(F.col("e"))).collect()] == ["a</siteinfo>b", "no mark"]


def test_zip_and_separators(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(files.zip_bytes(b"hello"))
    row = files.read_zip(spark, str(tmp_path / "*.zip")).first()
    assert (bytes(row["content"]), row["entries"]) == (b"hello", 1)
    df = spark.createDataFrame([("a b",), ("c\nd",)], "t string")
    assert files.separator_choice(df, "t").first()[0] == "\n\n"
    assert files.separator_choice(df, "t", (" ", "\n")).first()[0] is None
    files.write_columns(spark.createDataFrame([(1, "x", 2)], "k int, a string, b int"), str(tmp_path / "out"), "k")
    assert spark.read.parquet(str(tmp_path / "out" / "a")).first()["a"] == "x"


def test_stories(spark):
    lines = ["1 Mary moved to the bathroom.", "2 Where is Mary?\tbathroom\t1", "1 John left.", "2 Is John here?\tno\t1 2"]
    rows = files.story_lines(spark.createDataFrame(list(enumerate(lines)), "i int, value string"), "i").orderBy("story_id", "line_num").collect()
    assert [(r["story_id"], r["is_fact"], r["answer"]) for r in rows] == [(0, True, None), (0, False, "bathroom"), (1, True, None), (1, False, "no")]
    assert rows[0]["words"] == ["mary", "moved", "to", "the", "bathroom", "."]
    assert rows[3]["supporting"] == [1, 2]


@pytest.mark.parametrize(("text", "n"), [("aaa", 1), ("aaaa", 2), ("aaaaa", 2), ("aaaaaa", 3)])
def test_grams_that_overlap(spark, text, n):
    rows = A.gram_counts(spark.createDataFrame([(text,)], "t string"), F.col("t"), (2,)).collect()
    assert [tuple(r) for r in rows] == [("aa", n)]


def test_separators_are_closed(spark):
    text = "".join(f"<a>{i}</a>" for i in range(100, 140))
    found = {r["sep"]: r["n"] for r in A.separators(spark.createDataFrame([(text,)], "t string"), F.col("t"), 6).collect()}
    counts = {}
    for k in range(1, 7):
        for i in range(len(text) - k + 1):
            counts[text[i : i + k]] = counts.get(text[i : i + k], 0) + 1
    want = {s: n for s, n in counts.items() if n > 1 and not any(len(t) == len(s) + 1 and m == n and s in t for t, m in counts.items())}
    assert found == want


def test_grams_of_any_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé😀 ") for _ in range(rng.randrange(60))) for _ in range(40)] + ["", None, "a", "aaaaaaaaa", "ababababab"]
    want = {}
    for text in texts:
        for gram in {text[i : i + k] for k in range(2, 6) for i in range(len(text) - k + 1)} if text else ():
            want[gram] = want.get(gram, 0) + text.count(gram)
    rows = A.gram_counts(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")).collect()
    assert {r["gram"]: r["n"] for r in rows} == want and len(rows) == len(want)


def test_grams_in_parts_of_any_size():
    rng = random.Random(7)
    for alphabet in ("ab", "abé😀 ", "\0a", "".join(map(chr, range(0x4E00, 0x5E00)))):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "aaaaaaa"]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
        cut = list(grams.parts(iter([batch.slice(0, 5), batch.slice(5)]), most=100))
        assert [t for part in cut for t in part.column(0).to_pylist()] == texts and len(cut) > 9
        for apart in (False, True):
            found, want = {}, {}
            for part in cut:
                for strings, n in grams.tallied(grams.Part(part.column(0)), (1, 4, 12), apart):
                    for gram, k in zip(strings.to_pylist(), n.tolist(), strict=True):
                        found[gram] = found.get(gram, 0) + k
            for text in filter(None, texts):
                places = [text[i : i + k] for k in (1, 4, 12) for i in range(len(text) - k + 1)]
                for gram in set(places):
                    want[gram] = want.get(gram, 0) + (text.count(gram) if apart else places.count(gram))
            assert found == want


def test_grams_of_much_text_in_bounded_time(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices("etaoin shrdlu\n", k=50_000)),) for _ in range(40)]
    began = time.perf_counter()
    assert A.gram_counts(spark.createDataFrame(rows, "t string"), F.col("t")).groupBy(F.length("gram")).agg(F.sum("n")).count() == 4
    assert time.perf_counter() - began < 15


def test_best_blocks_of_odd_texts(spark):
    from textloom.operators import blocks

    texts = ["aaaaaaaaaaaaaaaa", "the cat\0 the cat\0 the cat\0", "😀é😀é😀é😀é😀é😀é", "", None, "xyz"] + ["abcab" * 40] * 3
    want = {}
    for text in filter(None, texts):
        for gram in {text[i : i + k] for k in range(3, 6) for i in range(len(text) - k + 1)}:
            want[gram] = want.get(gram, 0) + text.count(gram)
    score = {g: len(g) * n - 2 * n - (len(g) + 2) - 2 for g, n in want.items() if n > 1}
    rows = blocks.best_blocks(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")).collect()
    assert [tuple(r) for r in rows] == sorted(((g, want[g], s) for g, s in score.items() if s > 0), key=lambda r: (-r[2], r[0].encode()))


@pytest.mark.parametrize("most", [1, 7, 400])
def test_commonest_separators(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice(("the ", "cat ", "é", "\n", "😀x")) for _ in range(rng.randrange(30))) for _ in range(20)] + ["", None, "z", "zz top" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = sorted(((r["sep"], r["n"]) for r in A.separators(df, F.col("t"), 9).collect()), key=lambda r: (-r[1], r[0].encode()))[:most]
    assert [tuple(r) for r in A.top_separators(df, F.col("t"), most, 9).collect()] == want


def test_separator_stats_of_places(spark):
    df = spark.createDataFrame([("a--b----c",), ("--",), (None,), ("none",)], "t string")
    row = A.separator_stats(df, F.col("t"), spark.createDataFrame([("--",), ("absent",)], "sep string")).collect()
    places = [1, 4, 6, 0]
    assert [tuple(r)[:4] for r in row] == [("--", 4, 0, 6)]
    assert row[0]["mean"] == pytest.approx(np.mean(places)) and row[0]["sd"] == pytest.approx(np.std(places))
    assert row[0]["score"] == pytest.approx(6 / np.std(places) * 2 * math.log(4))


def test_transitions(spark):
    df = spark.createDataFrame([("[[Some Word]] is a b.",)], "t string")
    rows = {(r["from_class"], r["to_class"]): (r["n"], r["percent"]) for r in A.token_class_transitions(df, F.col("t")).collect()}
    assert rows["reference", "proper"] == (1, 50)
    assert rows["words", "whitespaces"] == (2, 66)
    assert rows["words", "sentences_markers"] == (1, 33)


def test_count_min_never_underestimates(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("string").alias("k"))
    width, depth = sketch.shape(0.05, 0.05)
    assert sketch.shape() == (272, 5)
    built = sketch.build(df, F.col("k"), width, depth)
    assert {r["s"] for r in built.groupBy("line").agg(F.sum("n").alias("s")).collect()} == {2000}
    true = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    found = {r["k"]: r["estimate"] for r in sketch.estimate(df.distinct(), "k", built, width, depth).collect()}
    assert all(found[k] >= n for k, n in true.items())


@pytest.mark.parametrize("error", [0.5, 1e-5])
def test_mined_counts_are_exact_however_full_the_sketch(spark, error):
    df = spark.createDataFrame([(f"k{i}",) for i in range(60) for _ in range(max(1, i - 40))], "word string")
    true = {f"k{i}": i - 40 for i in range(42, 60)}
    mined = sketch.mined(df, "word", error, error)
    assert mined.columns == ["word", "n"]
    assert {r["word"]: r["n"] for r in mined.collect()} == true
    total = sum(true.values())
    common = {k: n for k, n in true.items() if 100 * sum(m for m in true.values() if m > n) < 80 * total}
    assert {r["word"]: r["n"] for r in sketch.common_part(mined, "word").collect()} == common


def test_pattern_mining_against_sql_with_a_full_sketch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sketch, "shape", lambda *errors: (40, 2))
    rows = [(1, "<a>one</a> [[two three]]"), (2, "<b>four</b>; <a>ç</a> &lt;i&gt;"), (3, ""), (4, None), (5, "<a>one</a> é, z")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = catalog.queries()["cms_pattern_mining"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(catalog.oracle_sql()["cms_pattern_mining"]).fetchall())
    assert found


@pytest.mark.parametrize("percent", [1, 50, 80, 100])
def test_common_part_cuts_anywhere_and_sorts_nothing_in_one_place(spark, percent):
    rng = random.Random(percent)
    counts = {"".join(rng.choice("ab\0é😀") for _ in range(rng.randrange(6))): rng.choice((2, 2, 2, 3, 3, 9)) for _ in range(300)}
    want, before = [], 0
    for key, n in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())):
        if 100 * before < percent * sum(counts.values()):
            want.append((key, n))
        before += n
    found = sketch.common_part(spark.createDataFrame(list(counts.items()), "k string, n long"), "k", percent)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Window" not in found._jdf.queryExecution().toString()


def test_murmur3():
    assert [sketch.murmur3_32(x) for x in (b"", b"a", b"hello", b"hello, world")] == [0, 1009084850, 613153351, 345750399]


def test_top_k_of_a_stream(spark, tmp_path):
    top = TopK(3)
    for key in ["a"] * 50 + ["b"] * 30 + list("cdefghijkl") * 2:
        top.add(key)
    assert len(top.counts) <= 3
    assert top.counts["a"] >= 30
    rng = random.Random(0)
    rows = [("g", rng.choice("aaaabbc")) for _ in range(200)]
    spark.createDataFrame(rows, "g string, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, k string").parquet(str(tmp_path / "in"))
    query = stream_top_k(stream, "g", "k", 5).writeStream.format("memory").queryName("top").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["k"]: r["n"] for r in spark.table("top").collect()}
    assert found == {c: sum(k == c for _, k in rows) for c in "abc"}


def test_dictionary_codes(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, None)], "i int, v string")
    facts, dimension = encode.dict_encode(df, "i", "v")
    assert {r["i"]: r["code"] for r in facts.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r["code"]: r["v"] for r in dimension.collect()} == {0: "c", 1: "b", 2: None}


def test_perplexity(spark):
    df = spark.createDataFrame([(1, "abab"), (2, "ac")], "i int, t string")
    found = {r["i"]: r["perplexity"] for r in sequence.perplexity(df, "i", F.col("t")).collect()}
    p_ab, p_ac = 2 / 3, 1 / 3
    assert found[1] == pytest.approx(2 ** (-(2 * math.log2(p_ab) + 0) / 3))
    assert found[2] == pytest.approx(1 / p_ac)


ODD = ["", None, "a", "\0a", "aé😀 é😀\n", "１a2٣b", "x" * 50, "ab" * 30]


def test_perplexity_of_odd_texts_and_of_many(spark):
    pairs = {}
    for text in filter(None, ODD):
        for pair in zip(text, text[1:]):  # noqa: B905
            pairs[pair] = pairs.get(pair, 0) + 1
    rest = {a: sum(n for (b, _), n in pairs.items() if a == b) for a, _ in pairs}
    bits = lambda p: -math.log2(pairs[p] / rest[p[0]])
    want = {i: 2 ** (sum(map(bits, zip(t, t[1:]))) / (len(t) - 1)) for i, t in enumerate(ODD) if t and len(t) > 1}  # noqa: B905
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    assert {r["i"]: r["perplexity"] for r in sequence.perplexity(df, "i", F.col("t")).collect()} == {i: pytest.approx(p) for i, p in want.items()}
    rng = random.Random(9)
    many = spark.createDataFrame([(i, "".join(rng.choices("etaoin shrdlu\n", k=200_000))) for i in range(40)], "i int, t string")
    began = time.perf_counter()
    assert sequence.perplexity(many, "i", F.col("t")).count() == 40
    assert time.perf_counter() - began < 10


def test_states_of_odd_texts(spark):
    state = lambda c: "letter" if c.isalpha() else "digit" if c.isdecimal() else c
    want = {}
    for text in filter(None, ODD):
        states = list(map(state, text))
        for key in [("initial", "", states[0]), *(("emission", *x) for x in zip(states, text)), *(("transition", *x) for x in zip(states, states[1:]))]:  # noqa: B905
            want[key] = want.get(key, 0) + 1
    rows = sequence.hmm_fit(spark.createDataFrame([(t,) for t in ODD], "t string"), F.col("t")).collect()
    assert {(r["kind"], r["from_state"], r["to"]): r["n"] for r in rows} == want and len(rows) == len(want)
    assert all(r["p"] == pytest.approx(r["n"] / sum(n for k, n in want.items() if k[:2] == (r["kind"], r["from_state"]))) for r in rows)
    rng = random.Random(10)
    many = spark.createDataFrame([("".join(rng.choices("etaoin shrdlu 12", k=400_000)),) for _ in range(40)], "t string")
    began = time.perf_counter()
    assert sequence.hmm_fit(many, F.col("t")).count() > 9
    assert sequence.likely_substrings(many, F.col("t"), 3).count() == 30
    assert time.perf_counter() - began < 20


def test_gradients():
    rng = np.random.default_rng(0)
    for kind in ("lstm", "gru", "rnn", "feed_forward"):
        model = sequence.network(kind, 3, 4, 1, 2, rng, bottleneck=2)
        xs = rng.normal(size=(3, 3))

        def value(model=model, xs=xs):
            model.reset()
            return sum(float(model(x).value @ np.array([1.0, -2.0])) for x in xs)

        model.reset()
        outs = [model(x) * sequence.Node(np.array([1.0, -2.0])) for x in xs]
        whole = outs[0]
        for o in outs[1:]:
            whole = sequence.concat(whole, o)
        whole.backward(np.ones_like(whole.value))
        for p in model.parameters():
            at = tuple(0 for _ in p.value.shape)
            before = p.value[at]
            p.value[at] = before + 1e-5
            up = value()
            p.value[at] = before - 1e-5
            down = value()
            p.value[at] = before
            assert p.grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_training_learns():
    rng = np.random.default_rng(1)
    words = [sequence.embedded_reber(rng) for _ in range(40)]
    letters = sorted({c for w in words for c in w})
    hot = np.eye(len(letters))
    data = [[(hot[letters.index(a)], hot[letters.index(b)]) for a, b in zip(w, w[1:])] for w in words]  # noqa: B905
    trainer = sequence.Trainer(sequence.network("lstm", len(letters), 8, 1, len(letters), rng), rate=0.02)
    first = trainer.run(data)
    for _ in range(8):
        last = trainer.run(data)
    assert last < 0.7 * first


def test_losses():
    loss, grad = sequence.softmax_loss(np.array([2.0, 1.0]), np.array([1.0, 0.0]))
    assert loss == pytest.approx(math.log(1 + math.exp(-1)))
    assert grad.sum() == pytest.approx(0)
    assert sequence.argmax_error(np.array([0, 1.0]), np.array([1.0, 0])) == 1
    assert sequence.binary_error(np.array([0.9, 0.1]), np.array([1.0, 0])) == 0
    assert sequence.median_perplexity([[math.log(2)] * 3, [math.log(2)] * 3]) == pytest.approx(2**1.5)


def test_parity(spark):
    rows = sequence.parity(spark, 3, 5).orderBy("seq_id", "step").collect()
    for s in range(3):
        own = [r for r in rows if r["seq_id"] == s]
        assert [r["target"] for r in own] == [sum(x["bit"] for x in own[: i + 1]) % 2 for i in range(5)]


def test_likely_substrings(spark):
    text = "ab1 ba2"
    df = spark.createDataFrame([(text,)], "t string")
    state = lambda c: "letter" if c.isalpha() else "digit" if c.isdigit() else c
    states = [state(c) for c in text]
    moves = list(zip(states, states[1:]))  # noqa: B905

    def chance(sub):
        p = float(state(sub[0]) == states[0])
        for i, c in enumerate(sub):
            p *= text.count(c) / states.count(state(c))
            if i:
                pair = (state(sub[i - 1]), state(c))
                p *= moves.count(pair) / sum(m[0] == pair[0] for m in moves)
        return p

    subs = {text[i : i + k] for k in range(1, 4) for i in range(len(text) - k + 1)}
    want = {s: math.log(chance(s)) for s in subs if chance(s) > 0}
    found = {r["sub"]: r["log_likelihood"] for r in sequence.likely_substrings(df, F.col("t"), 3, 100).collect()}
    assert found == {s: pytest.approx(p) for s, p in want.items()}


def test_generation():
    rng = np.random.default_rng(3)
    alphabet, data = sequence.text_steps(["ab", "ab", "ab"])
    trainer = sequence.Trainer(sequence.network("gru", 3, 6, 1, 3, rng), rate=0.05)
    for _ in range(60):
        trainer.run(data)
    assert sequence.generate(trainer.model, alphabet, rng, temperature=0) == "ab"
    assert set(sequence.generate(trainer.model, alphabet, rng, 1.0, words={"ab", "a"}).split()) <= {"ab", "a"}


def test_pattern_aliases(spark):
    df = spark.createDataFrame([("<<<word>>> and more <<<other>>> text; " * 20,)], "t string")
    rows = sketch.pattern_aliases(df, F.col("t")).collect()
    assert rows
    assert all(r["benefit"] == r["n"] * (len(r["pattern"]) - 4) > 0 for r in rows)
    assert len({r["alias"] for r in rows}) == len(rows)


def test_count_min_of_a_stream(spark, tmp_path):
    a, b = CountMin(30, 4), CountMin(30, 4)
    for i in range(500):
        (a if i % 2 else b).add(str(i % 41))
    both = CountMin.from_bytes(a.merge(b).to_bytes())
    assert all(both.estimate(str(k)) >= sum(i % 41 == k for i in range(500)) for k in range(41))
    with pytest.raises(ValueError, match="shapes"):
        a.merge(CountMin(31, 4))
    spark.createDataFrame([("g", k) for k in "aabbbc"], "g string, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, k string").parquet(str(tmp_path / "in"))
    query = stream_estimates(stream, "g", "k").writeStream.format("memory").queryName("cms").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["k"]: r["estimate"] for r in spark.table("cms").collect()} == {"a": 2, "b": 3, "c": 1}
