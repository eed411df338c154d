"""Benchmark decontamination by spaced seeds.

Texts become normalised words. Fixed masks pick some of the words in a span and ignore the others,
so a substituted word spoils few of the seeds around it. Items too short for that are cut into one
part more than words may differ, so that one part is whole, and the parts are seeds. Test seeds are
put into a Bloom filter of a fixed size; each document keeps the seeds that pass it, with the words
around them. These meet the test seeds in a join, and around each hit the item is laid against the
document word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, raw, written

#: Masks over a span of words: 1 is compared, 0 ignored; together they pass over a substitution at any inner place.
MASKS = ("101111", "110111", "111011", "111101")
#: Least share of an item's words found in line, and least words in line where an item is longer.
SIMILARITY, RUN = 0.8, 13
#: Bits of the Bloom filter (4 MB, whatever the size of the test set) and probes.
BLOOM_BITS, PROBES = 25, 3  # 19 * (PROBES - 1) + BLOOM_BITS <= 64
#: Documents handled at once, and words remembered.
ROWS, WORDS = 256, 600_000
_mark = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class WordHashes(dict):
    """64-bit hashes of words, lower-cased, ASCII marks taken out; 0 for what then is empty."""

    def __missing__(self, word: bytes) -> int:
        text = _mark.sub(b"", word.decode().lower().encode())
        out = xxhash.xxh3_64_intdigest(text) | 1 if text else 0
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def _words(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, and where each text's begin (one more at the end)."""
    parts = []
    for t in texts:
        own = t.split()
        ids = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        parts.append(ids[ids != 0])
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


def _seeds(ids: np.ndarray, begin: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) of a mask wherever it fits into one text."""
    span, n = len(mask), len(ids)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n - span + 1, number + 1, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ ids[i : n - span + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    ok = np.ones(n, bool)
    for i in range(1, span):  # no seed runs over a text's end
        ok[np.maximum(begin[1:] - i, 0)[begin[1:] - i >= begin[:-1]]] = False
    ok = ok[: n - span + 1]
    return np.flatnonzero(ok), h[ok]


def _probe(mixed: np.ndarray, i: int) -> np.ndarray:
    return ((mixed >> np.uint64(19 * i)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which seeds the filter lets through; each probe is made for those alone that passed the one before."""
    mixed, left = mix64(h), np.arange(len(h))
    for i in range(PROBES):
        p = _probe(mixed[left], i)
        left = left[(bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)]
    return left


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, begin = _words(raw(batch["text"]), known)
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array([ids[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())], ["item_id", "item"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, item binary")


def _parts(n: int, similarity: float) -> list[tuple[int, int]]:
    """(begin, end) of an item's parts: one more than words that may differ."""
    count = n - max(1, math.ceil(similarity * n - 1e-9)) + 1
    cuts = [n * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _test_seeds(items: DataFrame, masks: tuple[str, ...], parts: dict[int, list[tuple[int, int]]], least: int) -> DataFrame:
    """(item_id, at, seed) by the masks of items of at least ``least`` words, and by their parts of shorter ones whose length has any."""
    number = {m: k for k, m in enumerate(masks)}
    kind = items.schema["item_id"].dataType.simpleString()

    def seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        if len(ids) >= least:
            found += [_seeds(ids, np.array([0, len(ids)]), m, k) for k, m in enumerate(masks)]
        for a, b in parts.get(len(ids), ()):
            found.append((np.array([a]), _seeds(ids[a:b], np.array([0, b - a]), "1" * (b - a), number["1" * (b - a)])[1]))
        at, seed = zip(*found, strict=True)
        return np.concatenate(at), np.concatenate(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, item in enumerate(batch["item"].to_pylist()):
                at, seed = seeds(np.frombuffer(item, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(batch["item_id"].slice(i, 1).to_pylist() * len(at), batch["item_id"].type), pa.array(at, pa.int32()), pa.array(seed.view(np.int64))], ["item_id", "at", "seed"])

    return items.mapInArrow(run, f"item_id {kind}, at int, seed long")


def _bloom(seeds: DataFrame) -> np.ndarray:
    """Bits of the test seeds. Each task sends its filter in 64 slices; a fixed size reaches the driver."""
    size, slices = 1 << BLOOM_BITS, 64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            mixed = mix64(batch["seed"].to_numpy().view(np.uint64))
            for i in range(PROBES):
                bits[_probe(mixed, i)] = True
        packed = np.packbits(bits).reshape(slices, -1)
        some = [i for i in range(slices) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["slice", "bits"])

    def union(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"slice": table["slice"].slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros((slices, size // 8 // slices), np.uint8)
    for r in seeds.select("seed").mapInArrow(part, "slice int, bits binary").groupBy("slice").applyInArrow(union, "slice int, bits binary").collect():
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.reshape(-1)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, run: int = RUN, masks: tuple[str, ...] = MASKS, shortest: int = 6) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal, item_words): the best place of each item in each document that holds it.

    At a hit, item and document are laid side by side. A place counts if, in line, at least
    ``similarity`` of the item's words are equal, or of a run of at least ``run`` words that starts
    and ends with equal ones (items shorter than that: of the whole item). Words are lower-cased without ASCII marks.
    Items of fewer than ``shortest`` words aren't looked for; null texts, ids of items that are
    null and empty tables find nothing. Repeated documents are each found; rows with a null id too.
    """
    table = written(_items(items.where(F.col(item_id_col).isNotNull()), item_id_col, item_text_col), "items")
    n = (F.length("item") / 8).cast("int")
    longest, short = table.agg(F.max(n), F.collect_set(F.when(n.between(max(shortest, 1), run - 1), n))).first()
    longest, parts = longest or 0, {x: _parts(x, similarity) for x in sorted(short)}
    # Lengths of parts are masks after the others: tables without short items have none.
    masks = (*masks, *("1" * x for x in sorted({b - a for p in parts.values() for a, b in p})))
    seeds = _test_seeds(table, masks, parts, run).distinct()
    sc = docs.sparkSession.sparkContext
    bloom = sc.broadcast(_bloom(seeds))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), table.schema["item_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per cluster of seeds that pass: their places and the words that an item there could touch."""
        bits, known, key = bloom.value, WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                ids, begin = _words(raw(part["text"]), known)
                at, seed = [], []
                for k, m in enumerate(masks):
                    a, h = _seeds(ids, begin, m, k)
                    ok = _passing(bits, h)
                    at.append(a[ok])
                    seed.append(h[ok])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = np.searchsorted(begin, at, "right") - 1
                cut = np.r_[0, np.flatnonzero((np.diff(at) > longest) | (np.diff(doc) > 0)) + 1, len(at)]
                cols: list[list] = [[] for _ in range(6)]
                docs_ids = part["doc_id"].to_pylist()
                for a, b in zip(cut, cut[1:], strict=False):
                    d = doc[a]
                    lo, hi = max(begin[d], at[a] - longest), min(begin[d + 1], at[b - 1] + longest)
                    for c, x in zip(cols, (key, docs_ids[d], int(lo - begin[d]), ids[lo:hi].tobytes(), (at[a:b] - lo).tolist(), seed[a:b].view(np.int64).tolist()), strict=True):
                        c.append(x)
                    key += 1
                types = (pa.int64(), part["doc_id"].type, pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "doc_id", "first", "words", "at", "seed"])

    hits = written(rows.mapInArrow(scan, f"key long, doc_id {kind}, first long, words binary, at array<int>, seed array<long>"), "hits")
    places = hits.select("key", F.explode(F.arrays_zip("at", "seed")).alias("x")).select("key", F.col("x.at").alias("here"), F.col("x.seed").alias("seed"))
    places = places.join(seeds, "seed").select("key", "item_id", (F.col("here") - F.col("at")).alias("shift")).distinct()
    pairs = places.join(hits.select("key", "doc_id", "first", "words"), "key").join(table, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (first, words, shift, item) in enumerate(zip(*[batch[c].to_pylist() for c in ("first", "words", "shift", "item")], strict=True)):
                if place := judge(np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64), shift, similarity, run):
                    keep.append(i)
                    out.append((first + place[0], place[1], place[2], len(item) // 8))
            got = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in ("key", "doc_id", "item_id")] + [pa.array(got[:, j]) for j in range(4)], ["key", "doc_id", "item_id", "first_word", "n_words", "n_equal", "item_words"])

    found = pairs.select("key", "doc_id", "item_id", "first", "words", "shift", "item").mapInArrow(verify, f"key long, doc_id {kind}, item_id {item_kind}, first_word long, n_words long, n_equal long, item_words long")
    best = F.max(F.struct("n_equal", (-F.col("first_word")).alias("low"), (-F.col("n_words")).alias("short"), "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.low")).alias("first_word"), (-F.col("b.short")).alias("n_words"), "b.n_equal", "b.item_words")


def judge(words: np.ndarray, item: np.ndarray, shift: int, similarity: float, run: int) -> tuple[int, int, int] | None:
    """(first word, words, equal words) of the longest run in line that counts, or none."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    equal = words[low + shift : high + shift] == item[low:high]
    at = np.flatnonzero(equal)
    if not len(at):
        return None
    if len(at) >= similarity * len(item):
        return int(low + shift + at[0]), int(at[-1] - at[0] + 1), len(at)
    # Longest run between equal words whose share is large enough: rank differences against lengths.
    ranks, best = np.arange(len(at)), None
    worth = ranks + 1 - similarity * (at + 1)
    before = ranks - similarity * at
    low_before = np.minimum.accumulate(before)
    for j in range(len(at)):
        i = int(np.searchsorted(-low_before[: j + 1], -(worth[j] + 1e-9), "left"))
        if i <= j and (size := int(at[j] - at[i] + 1)) >= run and (best is None or size > best[1]):
            best = (int(low + shift + at[i]), size, j - i + 1)
    return best


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(docs, items, shortest=1)
