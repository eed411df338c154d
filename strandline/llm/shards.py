"""Token-id shards with a minimal perfect hash index.

A shard holds the raw ids of a range of keys in ascending order (2 or 4 bytes each, by the size of
the vocabulary), then where each record starts, then a footer. The index maps a key to its shard and
record in constant time: keys are dealt into buckets, each bucket's file has a cascade of bitmaps
(a key sits in the first level where its bit is its own; its rank among the bits, of which every
64th is stored, is its slot) and a slot's fingerprint, shard, first record and number of records. A
key that isn't stored is told by its fingerprint, wrongly in one case of 2^32.

Files go through ``pyarrow.fs`` to the shared folder, under a name of the attempt until complete. A
file that is missing or cut short is an error, never a shorter answer.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunk_count, mix64, shared_dir, written
from .tokens import encoder, groups

END, VOCABULARY = 1, "word_bpe_49k.json"
#: Bytes of text of a shard, keys of an index bucket, and bits a key has at each level of the cascade.
SHARD, BUCKET, GAMMA = 24 << 20, 1 << 18, 2
MAGIC = b"SLIDS1\0\0"


def key_hash(key) -> tuple[int, int]:
    """128 bits of a key's text; null is a key of its own."""
    x = xxhash.xxh3_128_intdigest(b"\xffnull" if key is None else str(key).encode())
    return x >> 64, x & (1 << 64) - 1


def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


Level = tuple[np.ndarray, np.ndarray]  # a bitmap as 64-bit words, and the rank of each word's first bit over all levels


def build_mph(h: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels, and each key's slot. ``h``: distinct unsigned 64-bit hashes."""
    levels, slots, left, base = [], np.zeros(len(h), np.int64), np.arange(len(h)), 0
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        at = _slot(h[left], len(levels), size)
        own = np.bincount(at, minlength=size) == 1
        words = np.packbits(own, bitorder="little").view("<u8")
        held = np.bitwise_count(words).astype(np.int64)
        levels.append((words, (base + np.cumsum(held) - held).astype("<u4")))
        base += int(held.sum())
        hit, rank = _rank(*levels[-1], at)
        slots[left[hit]] = rank[hit]
        left = left[~hit]
    return levels, slots


def _rank(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether bits are set, and how many are before them: a word and a stored rank each."""
    word, bit = words[at >> 6], (at & 63).astype(np.uint64)
    return (word >> bit & np.uint64(1)).astype(bool), ranks[at >> 6].astype(np.int64) + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))


def find_mph(levels: list[Level], h: np.ndarray) -> np.ndarray:
    """Slots of hashes; -1 for what sits at no level."""
    out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
    for level, (words, ranks) in enumerate(levels):
        hit, rank = _rank(words, ranks, _slot(h[left], level, 64 * len(words)))
        out[left[hit]] = rank[hit]
        left = left[~hit]
    return out


def _put(folder: str, name: str, write) -> None:
    """The file appears whole or not at all; attempts that run twice write the same."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, f"{root}/{name}")


def _open(folder: str, name: str):
    store, root = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{root}/{name}")


class Shard:
    """An open shard: ids() gives one record as unsigned 32-bit integers, reading no other's bytes."""

    def __init__(self, folder: str, number: int):
        self.file = _open(folder, f"shard-{number:06d}.ids")
        size = self.file.size()
        foot = self.file.read_at(24, size - 24)
        if foot[16:] != MAGIC:
            raise ValueError("not a shard of token ids")
        records, self.width = np.frombuffer(foot[:16], "<i8")
        self.starts = np.frombuffer(self.file.read_at(8 * (records + 1), size - 24 - 8 * (records + 1)), "<i8")
        if size != self.starts[-1] * self.width + 8 * (records + 1) + 24:
            raise ValueError("a shard of another length than its footer says")

    def ids(self, record: int, count: int = 1) -> np.ndarray:
        a, b = self.starts[record], self.starts[record + count]
        return np.frombuffer(self.file.read_at(int(b - a) * self.width, int(a) * self.width), f"<u{self.width}").astype("<u4")


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, vocabulary: str = VOCABULARY, path: str | None = None, width: int | None = None) -> DataFrame:
    """Writes shards and index below ``folder``; returns its records: doc_id, shard, record, start, n_tokens.

    Records are in ascending id order (nulls first, equal ids by text), ``start`` counts the ids of
    all records before. A null text counts as empty and is the end id alone; repeated ids follow one
    another and share a key; an empty table leaves no shard. ``width``: bytes of an id, 2 or 4; if
    not given, as many as the vocabulary and the end id need. An id that doesn't fit is an error.
    """
    shards = chunk_count(docs, text_col, SHARD)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, number = encoder(vocabulary, path), np.asarray([end], "<u4").tobytes(), TaskContext.get().partitionId()
        size_of_id = width or (2 if max(encode.size, end + 1) <= 1 << 16 else 4)
        found: list[pa.RecordBatch] = []

        def stream(f) -> None:
            starts, record = [0], 0
            for batch in batches:
                n = np.zeros(batch.num_rows, np.int64)
                for i, size in groups(batch["text"]):
                    payload = [x + tail for x in encode.many(batch["text"].slice(i, size).to_pylist())]
                    n[i : i + len(payload)] = [len(x) // 4 for x in payload]
                    ids = np.frombuffer(b"".join(payload), "<u4")
                    if int(ids.max()) >> 8 * size_of_id:
                        raise ValueError(f"id {ids.max()} doesn't fit into {size_of_id} bytes")
                    f.write(ids.astype(f"<u{size_of_id}").tobytes())
                at = starts[-1] + np.cumsum(n) - n
                starts.extend((at + n).tolist())
                found.append(pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([number] * len(n), pa.int32()), pa.array(np.arange(record, record + len(n))), pa.array(at), pa.array(n)], ["doc_id", "shard", "record", "at", "n_tokens"]))
                record += len(n)
            f.write(np.asarray(starts, "<i8").tobytes() + np.asarray([record, size_of_id], "<i8").tobytes() + MAGIC)

        first = next(batches, None)
        if first is not None:
            batches = _with(first, batches)
            _put(folder, f"shard-{number:06d}.ids", stream)
        yield from found

    # Sampled ranges differ from run to run, so the records are written once and read from then on.
    records = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(save, f"doc_id {kind}, shard int, record long, at long, n_tokens long")
    records = written(records, "records")
    # A row per shard, of bounded size each: the one place where all meet.
    begin = records.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("begin"))
    _index(records, folder)
    return records.join(begin, "shard").select("doc_id", "shard", "record", (F.col("begin") + F.col("at")).alias("start"), "n_tokens")


def _with(first, rest):
    yield first
    yield from rest


def _buckets(keys: int) -> int:
    return max(1, math.ceil(keys / BUCKET))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))), F.lit(buckets)).cast("int")


CELL = np.dtype([("mark", "<u4"), ("shard", "<i4"), ("record", "<i8"), ("n", "<i8")])


def _index(records: DataFrame, folder: str) -> None:
    keys = records.groupBy("doc_id").agg(F.min(F.struct("shard", "record")).alias("first"), F.count("*").alias("n"))
    buckets = _buckets(records.count())

    def build(table: pa.Table) -> pa.Table:
        number, keys = table["bucket"][0].as_py(), table["doc_id"].to_pylist()
        h = np.array([key_hash(k) for k in keys], np.uint64).reshape(-1, 2)
        levels, slot = build_mph(h[:, 0])
        cells = np.zeros(len(keys), CELL)
        cells["mark"][slot] = h[:, 1] & np.uint64(0xFFFFFFFF)
        for name, col in (("shard", "shard"), ("record", "record"), ("n", "n")):
            cells[name][slot] = table[col].to_numpy()
        head = json.dumps({"keys": len(keys), "levels": [len(words) for words, _ in levels]}).encode()
        _put(folder, f"index-{number:06d}.mph", lambda f: f.write(np.asarray([len(head)], "<i8").tobytes() + head + b"".join(x.tobytes() for level in levels for x in level) + cells.tobytes()))
        return pa.table({"bucket": pa.array([number], pa.int32())})

    done = keys.select(_bucket(buckets).alias("bucket"), "doc_id", "first.shard", "first.record", "n").groupBy("bucket").applyInArrow(build, "bucket int")
    # Which buckets have no key: next to none, as keys are many to a bucket.
    empty = records.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(done, "bucket", "left_anti")
    without = sorted(r["bucket"] for r in empty.collect())
    _put(folder, "index.json", lambda f: f.write(json.dumps({"buckets": buckets, "empty": without}).encode()))


class Bucket:
    """One bucket of the index: find() reads a word and a rank for each level, then one cell, whatever the bucket's size."""

    def __init__(self, folder: str, number: int):
        self.file = _open(folder, f"index-{number:06d}.mph")
        size = int(np.frombuffer(self.file.read_at(8, 0), "<i8")[0])
        head = json.loads(self.file.read_at(size, 8))
        self.keys, self.words, self.at = head["keys"], head["levels"], 8 + size
        if self.file.size() != self.at + 12 * sum(self.words) + CELL.itemsize * self.keys:
            raise ValueError("an index of another length than its head says")

    def find(self, key) -> tuple[int, int, int] | None:
        """(shard, first record, records) of a key, or none."""
        h, mark = key_hash(key)
        low = self.at
        for level, words in enumerate(self.words):
            at = int(_slot(np.array([h], np.uint64), level, 64 * words)[0])
            word = int.from_bytes(self.file.read_at(8, low + 8 * (at >> 6)), "little")
            if word >> (at & 63) & 1:
                rank = int.from_bytes(self.file.read_at(4, low + 8 * words + 4 * (at >> 6)), "little")
                slot = rank + (word & (1 << (at & 63)) - 1).bit_count()
                cell = np.frombuffer(self.file.read_at(CELL.itemsize, self.at + 12 * sum(self.words) + CELL.itemsize * slot), CELL)[0]
                return (int(cell["shard"]), int(cell["record"]), int(cell["n"])) if cell["mark"] == mark & 0xFFFFFFFF else None
            low += 12 * words
        return None

    def whole(self) -> tuple[list[Level], np.ndarray]:
        """All levels and cells, for many keys at once."""
        data, at, levels = self.file.read_at(self.file.size() - self.at, self.at), 0, []
        for n in self.words:
            levels.append((np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)))
            at += 12 * n
        return levels, np.frombuffer(data, CELL, offset=at)


def _buckets_of(folder: str) -> tuple[int, set[int]]:
    with _open(folder, "index.json") as f:
        head = json.loads(f.read())
    return head["buckets"], set(head["empty"])


def lookup(folder: str, key: int | str | None) -> list[np.ndarray]:
    """The ids of each record stored under one key, without Spark; an unknown key has none."""
    buckets, empty = _buckets_of(folder)
    h = xxhash.xxh64_intdigest(b"\x00" if key is None else str(key).encode(), seed=42)
    number = (h - (1 << 64) if h >> 63 else h) % buckets
    place = None if number in empty else Bucket(folder, number).find(key)
    return [Shard(folder, place[0]).ids(place[1] + i) for i in range(place[2])] if place else []


def read_ids(keys: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard, record, at, ids, shard_ids) of every record stored under the distinct keys asked for.

    ``at`` counts the ids before it in its shard, ``shard_ids`` all of the shard, as the files say.
    Unknown keys give no row; a file that should be there and isn't is an error.
    """
    buckets, empty = _buckets_of(folder)
    asked = keys.select(F.col(id_col).alias("doc_id")).distinct().withColumn("bucket", _bucket(buckets))
    kind = asked.schema["doc_id"].dataType.simpleString()

    def look(table: pa.Table) -> pa.Table:
        number = table["bucket"][0].as_py()
        levels, cells = ([], np.zeros(0, CELL)) if number in empty else Bucket(folder, number).whole()
        h = np.array([key_hash(k) for k in table["doc_id"].to_pylist()], np.uint64).reshape(-1, 2)
        slot = find_mph(levels, h[:, 0])
        known = np.flatnonzero(slot >= 0)
        known = known[cells["mark"][slot[known]] == (h[known, 1] & np.uint64(0xFFFFFFFF)).astype("<u4")]
        got = cells[slot[known]]
        return pa.table({"doc_id": table["doc_id"].take(pa.array(known)), "shard": pa.array(got["shard"], pa.int32()), "first": pa.array(got["record"], pa.int64()), "n": pa.array(got["n"], pa.int64())})

    places = asked.groupBy("bucket").applyInArrow(look, f"doc_id {kind}, shard int, first long, n long")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(6)]
                for doc, no, first, n in zip(*[part[c].to_pylist() for c in ("doc_id", "shard", "first", "n")], strict=True):
                    if no != number:
                        number, shard = no, Shard(folder, no)
                    for r in range(first, first + n):
                        for c, x in zip(cols, (doc, no, r, int(shard.starts[r]), shard.ids(r).tobytes(), int(shard.starts[-1])), strict=True):
                            c.append(x)
                types = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "shard", "record", "at", "ids", "shard_ids"])

    # Places of a shard come together and in order, so each task opens few files and reads forward.
    return places.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(fetch, f"doc_id {kind}, shard int, record long, at long, ids binary, shard_ids long")


def op3_mph_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all texts, asks the index for every id of the table, and tells what the files hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_dir(spark, "ids")
    write_ids(docs, folder)
    back = read_ids(docs, folder).select("doc_id", "shard", "at", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard_ids")
    back = written(back, "read")
    if (there := back.count()) != (due := docs.count()):
        raise RuntimeError(f"the files hold {there} records of {due}")
    # Every record is there, so every shard is: a row each, whose sizes add up.
    sizes = back.groupBy("shard").agg(F.max("shard_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("begin"))
    return back.join(sizes, "shard").select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
