"""Words of whole texts in blocks of bounded size, and a sieve of bounded size.

A text is lower-cased (A-Z only) and cut into words on its UTF-8 bytes; bytes above 127 always belong to words, so no code point is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard_join import _Words, mix

_M = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once within an Arrow batch.
BLOCK = 1 << 22


def byte_table(breaks: bytes = b"") -> bytes:
    """A translation of bytes: A-Z to a-z; without `breaks` all ASCII but letters and digits to blanks, else the breaks to full stops."""
    out = bytearray(range(256))
    for b in range(128):
        if 65 <= b <= 90:
            out[b] = b + 32
        elif breaks:
            out[b] = 46 if b in breaks else b
        elif not (48 <= b <= 57 or 97 <= b <= 122):
            out[b] = 32
    return bytes(out)


ALNUM = byte_table()


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased."""
    return raw.translate(ALNUM).split() if raw else []


def text_blocks(batch: pa.RecordBatch, at: int, limit: int = BLOCK):
    """(first row, list of texts as UTF-8 or None) of slices of a batch with about `limit` bytes, or one text, at most."""
    col = batch.column(at).cast(pa.binary())
    lo, held, size = 0, [], 0
    for i, x in enumerate(col):
        raw = x.as_py()
        if held and size + len(raw or b"") > limit:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(raw)
        size += len(raw or b"")
    if held:
        yield lo, held


def hashes(words: list[bytes], known: _Words) -> np.ndarray:
    return np.array([known[w] for w in words], np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes, one for each place that has k words from it on."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n] + np.uint64(k)
    for i in range(1, k):
        acc = acc * _M + h[i : n + i]
    return mix(acc)


def grams_at(h: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """`gram_hashes` at some places."""
    acc = h[at] + np.uint64(k)
    for i in range(1, k):
        acc = acc * _M + h[at + i]
    return mix(acc)


def room(sizes: np.ndarray) -> np.ndarray:
    """For each word of concatenated texts, how many words of its text there are from it on."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))


class Sieve:
    """A Bloom filter of `bits` bits (a power of two), whatever the number of keys: it lets all of them through, and some others."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(bits // 64, np.uint64)

    def places(self, keys: np.ndarray):
        for k in (keys, mix(keys + _M)):
            at = k & np.uint64(self.bits - 1)
            yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at, bit in self.places(keys):
            found &= (self.table[at] & bit) != 0
        return found


def sieve_of(keys: DataFrame, bits: int) -> Sieve:
    """The sieve of a column of 64-bit keys; its words are combined on the cluster, and at most bits / 64 of them come to the driver."""
    out = Sieve(bits)

    def run(batches):
        for b in batches:
            at, bit = (np.concatenate(x) for x in zip(*out.places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], ["at", "bit"])

    words = keys.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out.table[words.column("at").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return out


def first_of(rows: DataFrame, by: list[str], order: list, k: int, spread: str, rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first k rows of each group in `order`, numbered from 1: first of each of `salts` parts of a group (by a hash of `spread`), then of all."""
    part = F.pmod(F.xxhash64(spread), F.lit(salts))
    some = rows.withColumn("_part", part).withColumn(rank, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).filter(F.col(rank) <= k)
    return some.drop("_part").withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
