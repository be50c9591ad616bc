"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

_ASCII_WORDS = re.compile(r"[A-Za-z0-9]+").findall
_WORDS = regex.compile(r"[\p{L}\p{Nd}]+").findall


def words(text: str) -> list[str]:
    """Longest runs of Unicode letters and digits, in lower case."""
    return _ASCII_WORDS(text.lower()) if text.isascii() else [w.lower() for w in _WORDS(text)]


class Hashes(dict):
    """64-bit hash of each word, remembered for as many words as `most`."""

    most = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    """`fn` over slices of at most `rows` rows, so that long texts don't pile up in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
