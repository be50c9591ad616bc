"""Encoding of a corpus with a public tokenizer, and back.

A null and an empty text both have the empty list. No special tokens are added, and their strings in a text are ordinary
text. Repeated rows come out as often as they come in; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopy.llm.arrow import map_rows

TOKENIZER = os.environ.get("CANOPY_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


@cache
def load(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def byte_table() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; tokens that are added strings of their own stand as UTF-8."""
    table, vocab = byte_table(), load(path).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def _lists(values: list, flat: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for v in values for x in v], flat))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, offsets: bool = False) -> DataFrame:
    """(`key`, `ids` array<int>) of each row; with `offsets` also `starts` and `ends`, the character span of each token.

    A token that holds part of a character spans that whole character, so spans of split characters overlap.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = load(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        coded = (tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast)(texts, add_special_tokens=False)
        columns, names = [batch.column(0), _lists([e.ids for e in coded], pa.int32())], [key, "ids"]
        if offsets:
            columns += [_lists([[o[k] for o in e.offsets] for e in coded], pa.int32()) for k in (0, 1)]
            names += ["starts", "ends"]
        return pa.RecordBatch.from_arrays(columns, names)

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, text), run, f"`{key}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets, 128)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """(`key`, `text`): the bytes of all ids joined, then read as UTF-8, so characters split over tokens come back whole.

    A null list gives a null text; ids outside the vocabulary stand for nothing; broken sequences give U+FFFD.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = token_bytes(path)
        texts = [None if v is None else b"".join(table[i] for i in v if i is not None and 0 <= i < len(table)).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return map_rows(df.select(key, ids), run, f"`{key}` {dict(df.dtypes)[key]}, text string", 128)
