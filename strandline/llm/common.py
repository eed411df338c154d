"""What several operators of this package share: chunking, byte helpers, and the store's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import shared_dir, written  # noqa: F401 (for the modules beside this one)

#: ASCII white space of the token and line rules: space and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunk_count(docs: DataFrame, text: str, target: int) -> int:
    """How many chunks of about ``target`` bytes of text there are; one aggregate over the text column."""
    total = docs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    return max(1, math.ceil(total / target))


def chunked(docs: DataFrame, id_col: str, text_col: str, chunks: int, **more: Column) -> DataFrame:
    """(chunk, doc_id, text, ...): rows dealt evenly by a hash of id and text; a null text counts as empty."""
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("int").alias("chunk"), key.alias("doc_id"), text.alias("text"), *[c.alias(n) for n, c in more.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, other letters as they are. ``lower`` is taken where it means the same: texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def trim() -> None:
    """Gives memory that a chunk's work has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class HashTable:
    """Open addressing over distinct unsigned 64-bit keys; find() gives each query's index among them, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, math.ceil(math.log2(3 * len(keys) + 4)))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            wait = self.slots[at] != left
            left, at = left[wait], (at[wait] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.keys[out[left]] != keys[left])]
        return out
