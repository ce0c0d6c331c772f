"""Golden pairs, sizes and properties of the codecs with per-row state."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import backref, blocks, bwt, encode, lexical
from textloom.operators.codec import REGISTRY, Pipeline, roundtrip_check

WORDS = {
    "the the": "the t>",
    "the that the": "the that <e",
    "the that large the": "the that large the",
    "prénom prénom": "prénom p>",
    "Google google.com Googol Google": "Google google.com Googol Google",
    "the compa> comp": "the compa>> comp",
    "the <compa ompa": "the <<compa ompa",
}
STEMS = {
    "Anarchy oui anarchism non anarchist benoit anarchists": "Anarchy oui anarchism non >0ist benoit >0ists",
    "originated anarchy Revolution. anarched...": "originated anarchy Revolution. >0ed...",
    "[[sans-culotte|sans-culottes]]": "[[sans-culotte|>1s->1tes]]",
    "123<ref>456": "123<ref>>456",
    "123<<ref>>456": "123<<ref>>>456",
    "Henry, <<br>>Henrique": "Henry, <<br>>>Henrique",
    "uses used": "uses used",
    "Station >>Polar Stater sealer": "Station >>>Polar >0er sealer",
    "both abridged and unabridged": "both abridged and unabridged",
}


@pytest.mark.parametrize(("text", "coded"), WORDS.items())
def test_words(text, coded):
    assert backref.encode_words(text) == coded
    assert backref.decode_words(coded) == text


@pytest.mark.parametrize(("text", "coded"), STEMS.items())
def test_stems(text, coded):
    assert backref.encode_stems(text) == coded
    assert backref.decode_stems(coded) == text


@pytest.mark.parametrize("window", range(1, 12))
def test_words_with_any_window(window):
    text = "the company and the compass compare the company with comparison the end company"
    assert backref.decode_words(backref.encode_words(text, window), window) == text


def test_two_codecs_in_a_row():
    for text in ("ab<ref>cd", "ab<>cd"):
        coded = backref.encode_stems(backref.encode_words(text))
        assert backref.decode_words(backref.decode_stems(coded)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "that", "than", "thats", "other", "mother", "été", "a", "<", ">", ".", "12"]), max_size=40))
def test_words_restore(parts):
    text = " ".join(parts)
    assert backref.decode_words(backref.encode_words(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abnés\n", max_size=24))
@example("banana")
@example("")
def test_bwt(text):
    coded = bwt.encode(text)
    assert sorted(coded) == sorted(text)
    assert bwt.decode(coded) == text


def test_bwt_golden_and_definition():
    assert bwt.encode("Je m'appele Benoit") == "tem e'lJpBoe enpai"
    for text in map("".join, itertools.product("ab", repeat=6)):
        turns = [(w[i:] + w[:i], w[i - 1]) for w in bwt.lyndon_words(text) for i in range(len(w))]
        assert bwt.transform(text) == "".join(last for turn, last in sorted(turns, key=lambda t: t[0] * 12))
    many = "".join(chr(0x4E00 + i) for i in range(200))
    assert bwt.encode(many) == "BWT" + many
    assert bwt.decode("BWT" + many) == many


def test_bwt_of_many_texts_at_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for letters in ("ab", "abn é\U0001f600", "a") for _ in range(150)]
    texts += ["the same line\n" * 50, "x" * 300, "".join(chr(0x4E00 + i) for i in range(200))]
    coded = bwt.encode_all(texts)
    assert coded == [bwt.encode(t) for t in texts]
    assert bwt.decode_all(coded) == texts
    for text in texts[::9]:
        turns = [(w[i:] + w[:i], w[i - 1]) for w in bwt.lyndon_words(text) for i in range(len(w))]
        if text.isascii():
            assert bwt.transform(text) == "".join(last for turn, last in sorted(turns, key=lambda t: t[0] * 300))
    words = rng.choices(["tree ", "house\n", "river "], k=60_000)
    began = time.perf_counter()
    assert bwt.decode("".join(bwt.encode("".join(words)))) == "".join(words)
    assert time.perf_counter() - began < 3  # it took 29 seconds


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_packed_characters(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert encode.unpack(encode.pack(text)) == text


def test_lexical_fields():
    text = "some long phrase here, some long phrase there, some long phrase w3_ everywhere"
    fields = [f for f, _ in lexical.grow(text)]
    assert any("some long phrase" in f for f in fields)
    assert len(lexical.apply(text, fields[:1])) < len(text)


def test_lexical_fields_count_what_can_overlap():
    assert lexical.grow("aaaaaaaa.abab.abab.aaaa") == [("aaaa", 3), ("abab", 2)]
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aab. ") for _ in range(80))
        assert all(text.count(f) == n > 1 for f, n in lexical.grow(text))


def test_words_with_what_they_share_since():
    def plain(text, window):
        held, out = [], []
        for word in text.split():
            coded = word
            if word in held:
                since = held[held.index(word) + 1 :]
                shared = lambda a: max((next((i for i, (x, y) in enumerate(zip(a(word), a(o))) if x != y), min(len(word), len(o))) for o in since), default=0)  # noqa: E731, B905
                starts, ends = shared(lambda w: w), shared(lambda w: w[::-1])
                kept = min(starts, ends) + 1
                if kept + 1 < len(word):
                    coded = "<" + word[-kept:] if starts > ends else word[:kept] + ">"
                held.remove(word)
            held = [*held, word][-window:]
            out.append(coded)
        return " ".join(out)

    rng = random.Random(6)
    for window in (1, 2, 5, 1024) * 60:
        text = " ".join("".join(rng.choices("abé", k=rng.randrange(3, 7))) for _ in range(rng.randrange(80)))
        coded = backref.encode_words(text, window)
        assert coded == plain(text, window)
        assert backref.decode_words(coded, window) == text


def test_rows_of_a_batch_are_strings_a_few_at_a_time(spark):
    most = spark.sparkContext.accumulator(0)

    def note(texts):
        most.add(len(texts) > backref.ROWS)
        return [t.upper() for t in texts]

    rows = spark.range(5000).repartition(1).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id"))).alias("t"))
    out = rows.select("t", backref.per_batch(note)(F.col("t")).alias("u"))
    assert out.where(~F.col("u").eqNullSafe(F.upper("t"))).count() == 0
    assert most.value == 0


def test_distances_of_many_rows_at_once():
    rng = random.Random(7)
    rows = [[rng.randrange(k) for _ in range(rng.randrange(60))] for k in (1, 3, 20) for _ in range(60)]
    places, far = backref.distances(np.array([t for r in rows for t in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
    want, start = [], 0
    for row in rows:
        for at, token in enumerate(row):
            if token in row[:at]:
                before = at - 1 - row[:at][::-1].index(token)
                want.append((start + at, len(set(row[before + 1 : at]))))
        start += len(row)
    assert list(zip(places.tolist(), far.tolist(), strict=True)) == want
    much = np.array([rng.randrange(5000) for _ in range(400_000)])
    began = time.perf_counter()
    backref.distances(much, np.zeros(len(much), np.int64))
    assert time.perf_counter() - began < 1.5


@pytest.mark.parametrize("name", ["word_backref", "stem_backref", "bwt", "char_escape"])
def test_round_trips_over_documents(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bad = roundtrip_check(docs, REGISTRY[name], "doc_id").where("NOT same")
    assert bad.count() == 0


def test_pipeline_of_codecs(spark):
    df = spark.createDataFrame([(1, "See wonderful [[this]], see wonderful [[this]]."), (2, None), (3, "")], "id int, text string")
    stages = Pipeline([REGISTRY["auto_close"], REGISTRY["word_backref"]])
    coded = stages.forward(df)
    assert [r["text"] for r in stages.inverse(coded).orderBy("id").collect()] == [r["text"] for r in df.orderBy("id").collect()]
    sizes = {r["stage"]: r["bytes"] for r in stages.stage_sizes(df).collect()}
    assert sizes["input"] >= sizes["auto_close"] > sizes["word_backref"] > 0


def test_blocks(spark):
    golden = {"a10" + " 000" * 12: 15, "abcdefg_abx_yfg_abx_yfg_yfg" * 10: 60}
    for text, most in golden.items():
        df = spark.createDataFrame([(text,)], "text string")
        rules = blocks.learn(df, rounds=5)
        coded = df.select(blocks.substitute(F.col("text"), rules).alias("x"), blocks.substitute_inverse(blocks.substitute(F.col("text"), rules), rules).alias("y")).first()
        assert coded["y"] == text
        assert len(coded["x"]) < len(text)
        assert len(coded["x"]) <= 4 * most
        assert all(len(new) == 2 < len(old) for old, new in rules)


def test_reuse_distance(spark):
    text = "a b c a a b d c the a b c the"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x y")], "i int, text string")
    tokens = text.split()
    want = []
    for p, t in enumerate(tokens):
        before = [q for q in range(p) if tokens[q] == t]
        if before:
            want.append((1, p, t, len(set(tokens[before[-1] + 1 : p]))))
    for f in (backref.reuse_distance, backref.reuse_distance_relational):
        assert sorted(tuple(r) for r in f(df, "i", F.col("text")).collect()) == want


@pytest.mark.parametrize("most", [1, 3, 1 << 31])
def test_ranks_of_recent_words(most):
    rng = random.Random(most)
    ranked, recent = backref.Ranked(300, most), backref.Recent(most)
    for _ in range(300):
        word = rng.choice("abcdefgh")
        newest = list(recent.newest_first())
        assert ranked.rank(word) == (newest.index(word) if word in newest else None)
        assert [ranked.word(k) for k in range(len(newest))] == newest
        ranked.add(word)
        recent.add(word)
    with pytest.raises(ValueError):
        ranked.word(len(list(recent.newest_first())))
