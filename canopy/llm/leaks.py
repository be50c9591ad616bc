"""Evaluation texts leaking into a corpus: MinHash containment search and exact check of word shingles.

A document and an item match if they share at least `RUN` consecutive words; a word is a longest run of Unicode letters
and digits, in lower case. Null, empty and shorter texts match nothing; repeated rows count once; extra columns are
dropped; an empty table on either side gives an empty result.

Items and documents differ much in size, and a MinHash of a whole text says little on one shared passage. Both are
therefore partitioned into sets of one size: all `RUN`-word windows, each the set of its 8 five-word shingles, with the
smallest of their hashes as MinHash. A window that is contained in the other text has the same MinHash there, so no shared
passage is lost. A Bloom filter of the items' MinHashes, whose size has a fixed bound, is tested against all windows of the
documents; the hits of both sides are joined and verified by their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.arrow import Hashes, map_rows, words
from canopy.session import cut_counted

RUN, SHINGLE = 12, 5
#: Windows of items, of about 100 bytes, that are broadcast at most.
BROADCAST = 100_000
_FACTORS = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def window_minhashes(hashes: np.ndarray) -> np.ndarray:
    """MinHash of each window of RUN words, by its first word."""
    n = len(hashes) - SHINGLE + 1
    if n < RUN - SHINGLE + 1:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for k, f in enumerate(_FACTORS):
        g = (g ^ (hashes[k : k + n] * f)) * _FACTORS[0]
        g ^= g >> np.uint64(29)
    for step in (1, 2, 4):
        g = np.minimum(g[:-step], g[step:])
    return g


def _windows(text: str | None, memo: Hashes) -> tuple[list[str], np.ndarray]:
    found = words(text or "")
    return found, window_minhashes(np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)))


def windows(df: DataFrame, key: str, text: str, bloom: np.ndarray | None = None) -> DataFrame:
    """(`key`, `low`, `gram`): the distinct windows of each text, with MinHash and words; with `bloom` those it lets pass."""
    shared = None if bloom is None else df.sparkSession.sparkContext.broadcast(bloom)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        memo = run.__dict__.setdefault("memo", Hashes())
        keys, lows, grams = [], [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, mins = _windows(t, memo)
            at = range(len(mins)) if shared is None else np.flatnonzero(passes(shared.value, mins)).tolist()
            own = {" ".join(found[i : i + RUN]): i for i in at}
            keys += [k] * len(own)
            lows += mins[list(own.values())].astype(np.int64).tolist() if own else []
            grams += own
        return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(lows, pa.int64()), pa.array(grams, pa.string())], [key, "low", "gram"]) if keys else None

    return map_rows(df.select(key, text).where(f"`{key}` is not null and length(`{text}`) > 0"), run, f"`{key}` {dict(df.dtypes)[key]}, low bigint, gram string", 64)


def _places(low: np.ndarray, bits: int) -> list[np.ndarray]:
    return [low & np.uint64(bits - 1), (low >> np.uint64(32)) & np.uint64(bits - 1)]


def bloom_of(low: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of the column `low` (`n` rows): 64-bit words, made by the executors and or-ed together.

    It has 32 bits for each row but no more than 2^26 (8 MB, and a million rows for the driver); with more rows it only
    lets more pass.
    """
    bits = 1 << min(26, max(16, (32 * max(n, 1) - 1).bit_length()))
    place = F.explode(F.array(F.col("low"), F.shiftrightunsigned("low", 32))).alias("p")
    place = low.select(place).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words_ = place.select(F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    for r in words_.collect():
        out[r.word] = r.mask
    return out.view(np.uint64)


def passes(bloom: np.ndarray, low: np.ndarray) -> np.ndarray:
    good = np.ones(len(low), bool)
    for p in _places(low, 64 * len(bloom)):
        good &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return good


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (`key`, `item`) of documents and items that share a passage of RUN words.

    The documents are read once; only their hits are shuffled. The items' windows are broadcast if their count allows it.
    A window of very many documents is one row of each, so Spark can split it as a skewed key.
    """
    index, n = cut_counted(windows(items, item, text))
    hits = windows(documents, key, text, bloom_of(index, n))
    held = index.select(item, F.xxhash64("low", "gram").alias("h"), F.col("gram").alias("words"))
    found = hits.withColumn("h", F.xxhash64("low", "gram")).join(F.broadcast(held) if n <= BROADCAST else held, "h").where("gram = words")
    return found.select(key, item).distinct()
