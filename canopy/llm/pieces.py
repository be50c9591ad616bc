"""Splitting oversized items at natural boundaries, with overlap.

Texts of at most `limit` characters (code points), empty and null texts give no pieces. Repeated rows are split each for
itself; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.arrow import map_rows

LIMIT, OVERLAP = 6_000, 300
_TOKENS = re.compile(r"\r\n?|\n|[^\S\r\n]+|\w+|[^\w\s]")
_AFTER = set(";,{}()[]")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets at which a piece may end, best kind first.

    The kinds: before an unindented line after a blank one, after a blank line, after a line, after a token that closes
    or separates, after any token. Offsets are prefix sums of the tokens' lengths.
    """
    tokens = _TOKENS.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    if not len(ends) or ends[-1] != len(text):  # characters outside all kinds, such as lone surrogates
        ends = np.array([m.end() for m in _TOKENS.finditer(text)], np.int64)
    breaks = np.fromiter((t[0] in "\r\n" for t in tokens), bool, len(tokens))
    space = np.fromiter((t.isspace() for t in tokens), bool, len(tokens))
    closing = np.fromiter((t in _AFTER for t in tokens), bool, len(tokens))
    lines = ends[breaks]
    starts = np.concatenate(([0], lines[:-1])) if len(lines) else lines
    filled = ends[~space]
    blank = np.searchsorted(filled, lines) == np.searchsorted(filled, starts) if len(lines) else np.empty(0, bool)
    gaps = lines[blank]
    flush = np.array([g for g in gaps.tolist() if g < len(text) and not text[g].isspace()], np.int64)
    return [flush, gaps, lines, ends[closing | space], ends]


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece, none longer than `limit`; together they cover the text.

    An end is the last boundary of the best kind that leaves a piece of at least half the limit, else of any kind beyond
    the overlap, else the limit itself. The next start is the last line break at least `overlap` back, if the piece still
    moves on by it, else exactly `overlap` back.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    kinds, out, start = boundaries(text), [], 0

    def last(kind: np.ndarray, low: int, high: int) -> int | None:
        i = int(np.searchsorted(kind, high, "right")) - 1
        return int(kind[i]) if i >= 0 and kind[i] > low else None

    while n - start > limit:
        high = start + limit
        end = next((e for least in (start + limit // 2, start + overlap) for k in kinds if (e := last(k, least, high)) is not None), high)
        out.append((start, end))
        back = last(kinds[2], start, end - overlap)
        start = back if back is not None and end - back <= max(2 * overlap, limit // 4) else end - overlap
    return [*out, (start, n)]


def pieces(df: DataFrame, key: str = "snippet_id", text: str = "source_code", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(`key`, `piece`, `start`, `stop`[, `text`]) of every row whose text is longer than `limit`; `piece` counts from 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, number, starts, stops, texts = [], [], [], [], []
        for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
            for i, (a, b) in enumerate(spans(t, limit, overlap)):
                keys.append(k)
                number.append(i)
                starts.append(a)
                stops.append(b)
                if with_text:
                    texts.append(t[a:b])
        columns = [pa.array([k.as_py() for k in keys], batch.schema.field(0).type), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, [key, "piece", "start", "stop"] + ["text"] * with_text)

    long = df.select(key, text).where(F.length(text) > limit)
    return map_rows(long, run, f"`{key}` {dict(df.dtypes)[key]}, piece int, start bigint, stop bigint" + ", text string" * with_text, 64)
