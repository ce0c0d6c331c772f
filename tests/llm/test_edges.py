"""Every operator over nulls, empty and very long texts, repeats, empty tables and clashing column names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bpe, common, decontaminate, fingerprint, licenses, near_dup, quality, secrets, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word another third " * 12_000
ROWS = [
    (1, "a plain text of some words", "en", "s", 26),
    (1, "a plain text of some words", "en", "s", 26),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \t\n ", "en", "s", 4),
    (5, LONG, "en", "s", len(LONG)),
    (6, "x" * 150_000, "en", "s", 150_000),
    (7, "é\U0001f600 ß ﬁ", "de", "s", 6),
    (None, "nobody knows my name and number", "en", "s", 31),
    (None, None, "en", "s", None),
]
CLASH = ("score", "shard", "node", "key", "a", "b", "n", "bands", "size", "block", "row", "next", "fingerprint", "shift", "page", "mark", "path", "own", "label", "token_ids", "spans")
PATH = ("source", "doc_id")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (None, "a b c d e f g")], "item_id long, text string")


def operators(labels, items):
    return {
        "bpe": lambda d: bpe.encode_digests(d, RANKS, public_tokenizers.PATTERN),
        "licenses": lambda d: licenses.scan(d, licenses.tree_path(*map(F.col, PATH))),
        "toxicity": lambda d: toxicity.score(d, labels),
        "secrets": secrets.scan,
        "sharding": lambda d: sharding.assign(d, [1.0] * 8),
        "fingerprint": fingerprint.fingerprints,
        "quality": lambda d: quality.score(d, labels),
        "near_dup": near_dup.link,
    }


NAMES = ["bpe", "licenses", "toxicity", "secrets", "sharding", "fingerprint", "quality", "near_dup"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(spark, labels, items, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    run = operators(labels, items)[name]
    plain = run(docs)
    assert plain.count() == len(ROWS)
    clashing = docs.withColumns({c: F.lit("?") for c in CLASH})
    again = run(clashing)
    assert again.columns == plain.columns
    assert sorted(map(repr, again.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table(spark, labels, items, name):
    assert operators(labels, items)[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_leaks_and_warc_at_the_edges(spark, items):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert decontaminate.leaks(docs, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc_rows = warc.round_trip(pages)
    assert warc_rows.count() == 0


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_at_the_edges(spark, labels, items, tmp_path, at):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("?") for c in CLASH if c != "token_ids"})
    out = stage(spark, docs, str(tmp_path))
    if at < 4:
        assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) <= len(ROWS)
    if at == 1:
        assert sum(r["doc_id"] == 1 for r in rows) == 1
    elif at:
        assert len(rows) == len(ROWS)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_checkpoints_put_the_batch_size_back(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    with pytest.raises(ZeroDivisionError), common.arrow_batches(spark, 7, 4000):
        assert [spark.conf.get(name) for name in names] == ["7", "4000"]
        raise ZeroDivisionError
    assert [spark.conf.get(name) for name in names] == before
