"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver and broadcast: it is refused above MAX_RANK_BYTES, so the
broadcast has a fixed bound that does not follow the data. Long texts are cut by a regex at safe
boundaries, places where no match of the splitting pattern can cross, so pieces encode to the same ids
as the whole text while the work and memory of one call stay small.

Defined cases: null or empty text has no tokens; text that looks like a special token is ordinary text;
repeated rows give repeated rows; other columns of the input, even with clashing names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_arrow, text_rows

MAX_RANK_BYTES = 16 << 20
#: Code points of a piece, as far as safe boundaries allow.
PIECE = 1 << 16
#: Between a character that is no white space and one that is: every alternative of the pattern has white
#: space only at its start, so no match spans this place, and look-ahead reads to the right only.
SAFE = re.compile(r"(?<=\S)(?=[ \n\r\t])")


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; ValueError above MAX_RANK_BYTES."""
    if (size := Path(path).stat().st_size) > MAX_RANK_BYTES:
        raise ValueError(f"rank file of {size} bytes; at most {MAX_RANK_BYTES} are broadcast")
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file, built once in each worker."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, ranks.split(b"\n")))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of about size code points that encode independently of each other."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(enc: tiktoken.Encoding, text: str, size: int = PIECE) -> list[int]:
    """The ids of a whole text, without special tokens."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, token_ids array<int>) for every document, then the columns of docs that keep names."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks.value, pattern)
        each = [np.array(encode(enc, text), np.int32) for text in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, each)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(offsets, np.concatenate(each) if each else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, *batch.columns[2:]], ["doc_id", "token_ids", *keep])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in keep))
    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join([f"doc_id {kinds['doc_id']}", "token_ids array<int>", *(f"`{c}` {kinds[c]}" for c in keep)]))


def decode_documents(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, token_ids): the raw bytes, which need not be valid UTF-8."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks.value, pattern)
        raw = pa.array((enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), raw], ["doc_id", "decoded"])

    return map_arrow(tokens.select("doc_id", "token_ids"), run, f"doc_id {dict(tokens.dtypes)['doc_id']}, decoded binary")


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    names: list[str] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks.value, pattern)
        if not names:
            names.extend(map(str, range(enc.max_token_value + 1)))
        counts, id_digests, byte_digests = [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(enc, text)
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            byte_digests.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(byte_digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = text_rows(docs, id_col, text_col)
    return map_arrow(rows, run, f"doc_id {rows.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
