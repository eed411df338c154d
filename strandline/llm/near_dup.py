"""MinHash near-dedup by tensored banding.

Documents are sets of word shingles; equal sets are one class. From two small collections of minhash
tuples the key of table (i, j) joins tuple i of one and tuple j of the other, so the tables are the
product of two numbers of tuples, of which each costs its minhashes once. Chunks first send their
keys alone, to find those of several classes; classes with such keys meet with their minhashes, and
pairs whose minhashes agree enough are joined into families, by spanning pairs. Each of these pairs is
then confirmed on full sets, which is work in proportion to the members. Where the confirmed links
leave a family in several parts, its members are compared with those outside the largest part, in
blocks of bounded size, so that no link is missed for having been left out of the spanning pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import numbered
from .common import HashTable, chunk_count, mix64, raw, trim, written

#: Minhashes of a tuple and tuples of a collection: a pair at similarity 0.8 misses all tables of 169 with chance 2e-4.
WIDTH, TUPLES = 3, 13
SIMILARITY = 80
#: Standard deviations by which agreement of minhashes may fall below the similarity.
SLACK = 4.0
#: Bytes of text of a chunk; members and shingles of a block of a family.
CHUNK, MEMBERS, SHINGLES = 16 << 20, 1024, 1_500_000
#: Classes under one key that are compared in one task. A key of more is hot: its classes are held against its first one.
GROUP = 1 << 13
#: Words remembered, and columns of a product of sets at once.
WORDS, COLUMNS = 600_000, 4096


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def shingle_set(text: bytes, words: int, known: _Words) -> np.ndarray:
    """Distinct hashes, ascending, of the text's shingles of ``words`` words; with fewer words the whole sequence is one."""
    own = text.lower().split()
    ids = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    if not len(ids):
        return ids
    k = min(words, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def minhashes(shingles: np.ndarray, number: int) -> np.ndarray:
    """``number`` 32-bit minhashes of a set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    seeds = mix64(np.arange(1, number + 1, dtype=np.uint64))
    add, times = seeds.astype(np.uint32)[:, None], (seeds >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    out = np.full(number, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        h = (low[None, at : at + 1024] ^ add) * times
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(out, h.min(1), out=out)
    return out


def keys_of(sketch: np.ndarray, width: int, tuples: int) -> np.ndarray:
    """Keys of all tables (rows: documents, columns: i * tuples + j) from 2 * width * tuples minhashes."""
    parts = sketch.reshape(len(sketch), 2, tuples, width).astype(np.uint64)
    h = np.zeros(parts.shape[:3], np.uint64)
    for w in range(width):
        h = (h ^ parts[..., w]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    table = np.arange(tuples * tuples, dtype=np.uint64).reshape(1, tuples, tuples)
    return mix64(h[:, 0, :, None] * np.uint64(0xC2B2AE3D27D4EB4F) + h[:, 1, None, :] + table * np.uint64(0x165667B19E3779F9)).reshape(len(sketch), -1)


def linked(sets: list[np.ndarray], similarity: int) -> np.ndarray:
    """For each set the number of the first one that it can reach by exact links of that similarity in per cent."""
    n = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    keep = held[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, int(column[b - 1]) + 1 - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    link = 100 * both >= similarity * (n[:, None] + n[None] - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(link, label[None], len(sets)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Tree:
    """Disjoint sets of numbers, each named by its smallest."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.above.setdefault(x, x) != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from links (a, b) of integers: the smallest number that each can reach.

    Alternates larger and smaller neighbours' links to the smallest neighbour until nothing changes;
    each round is a written table, so neither lineage nor a driver's memory grows.
    """
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    size = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    mark = size(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Rows (a, b) with a > b: a's smallest neighbour gets its others, and a itself.
        large = large.where("a > b").distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(first.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        links = written(small, "links")
        new = size(links)
        if tuple(new) == tuple(mark):
            break
        mark = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: int = SIMILARITY, width: int = WIDTH, tuples: int = TUPLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Ids are integers. Two documents are linked if their sets' intersection has at least
    ``similarity`` per cent of their union; links are confirmed on full sets, and found by minhash
    with the chance given above (equal sets always). A null text, or one without words, has an empty
    set and is linked with nothing; a null id stays null and is linked with nothing. Rows that repeat
    an id are judged one by one, whether their texts are equal or not. An empty table gives no rows;
    other columns are ignored.
    """
    number, group = 2 * width * tuples, GROUP
    chunks = chunk_count(docs, text_col, CHUNK)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches):
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                marks, sizes, bodies = [], [], []
                for text in raw(part["text"]):
                    own = shingle_set(text, words, known) if text else np.zeros(0, np.uint64)
                    marks.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    bodies.append(minhashes(own, number).tobytes())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "mark", "n", "sketch"])

    # A few hundred bytes per document; each text is read once here, and again for families alone.
    signs = written(rows.mapInArrow(sketch, "doc_id long, mark binary, n long, sketch binary"), "signs")
    # Written, as are their names below, so that joins by class have shuffles alone for sides, of which Spark can split a
    # large group of copies.
    classes = written(signs.where("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = signs.where("n > 0").join(classes, "mark").where("doc_id = rep").groupBy("doc_id", "mark").agg(F.min(F.struct("n", "sketch")).alias("x"))
    firsts = written(firsts.select("doc_id", "mark", "x.n", "x.sketch"), "firsts")
    # A class goes by the number of its first document; where that is first of several, the others get numbers below all.
    several = firsts.groupBy("doc_id").agg(F.min("mark").alias("least"), F.count("*").alias("c")).where("c > 1")
    plain = several.isEmpty()
    if plain:
        firsts = firsts.withColumn("node", F.col("doc_id"))
    else:
        others = firsts.join(several, "doc_id").where("mark <> least").select("doc_id", "mark")
        low = firsts.agg(F.min("doc_id")).first()[0]
        firsts = firsts.join(numbered(others, ["doc_id", "mark"], "place"), ["doc_id", "mark"], "left")
        firsts = written(firsts.withColumn("node", F.coalesce(F.lit(low) - F.col("place"), "doc_id")).drop("place"), "firsts")
    firsts = firsts.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int"))

    def matrix(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, number)

    def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        bucket = bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(order) else np.zeros(1, np.int64)
        return order, [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def send_keys(table: pa.Table) -> pa.Table:
        """A chunk's distinct keys by bucket, with the number of its classes that have each."""
        key, held = np.unique(keys_of(matrix(table), width, tuples), return_counts=True)
        order, cuts = by_bucket(key, chunks)
        key, held = key[order], held[order].astype(np.uint32)
        blobs = lambda x: pa.array([x[a:b].tobytes() for _, a, b in cuts], pa.binary())
        out = pa.table({"bucket": pa.array([b for b, _, _ in cuts], pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(cuts), pa.int32()), "data": blobs(key), "held": blobs(held)})
        trim()
        return out

    def shared(table: pa.Table) -> pa.Table:
        """Keys of several classes, back to their chunks, those of too many for one task apart."""
        parts = [np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()]
        values, which = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(which, np.concatenate([np.frombuffer(x, np.uint32) for x in table["held"].to_pylist()])).astype(np.int64)
        cut = np.split(which, np.cumsum([len(p) for p in parts])[:-1])
        some = [i for i, w in enumerate(cut) if (total[w] > 1).any()]
        blobs = lambda low, high: pa.array([values[cut[i][(total[cut[i]] > low) & (total[cut[i]] <= high)]].tobytes() for i in some], pa.binary())
        return pa.table({"chunk": table["chunk"].take(pa.array(some, pa.int64())), "data": blobs(1, group), "hot": blobs(group, np.iinfo(np.int64).max)})

    cell = [("key", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("sketch", "u1", (number,))]

    def cells_of(table: pa.Table, side: pa.Table, column: str) -> np.ndarray:
        """Classes of a chunk under each of its shared keys, with one byte of each minhash."""
        known = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in side[column].to_pylist()]])
        if not table.num_rows or not len(known):
            return np.zeros(0, cell)
        own, look = matrix(table), HashTable(known)
        ids, n = table["node"].to_numpy(), table["n"].to_numpy()
        found = []
        for at in range(0, len(own), 4096):
            key = keys_of(own[at : at + 4096], width, tuples)
            row, col = np.nonzero(look.find(key.reshape(-1)).reshape(key.shape) >= 0)
            part = np.zeros(len(row), cell)
            part["key"], part["doc"], part["n"] = key[row, col], ids[at + row], n[at + row]
            part["sketch"] = (own[at + row] & np.uint32(255)).astype(np.uint8)
            found.append(part)
        return np.concatenate(found)

    def send_members(table: pa.Table, side: pa.Table) -> pa.Table:
        cells = cells_of(table, side, "data")
        order, cuts = by_bucket(cells["key"], 4 * chunks)
        cells = cells[order]
        out = pa.table({"bucket": pa.array([b for b, _, _ in cuts], pa.int32()), "cells": pa.array([cells[a:b].tobytes() for _, a, b in cuts], pa.binary())})
        trim()
        return out

    def send_hot(table: pa.Table, side: pa.Table) -> pa.Table:
        cells = cells_of(table, side, "hot")
        return pa.table({"key": cells["key"].view(np.int64) if len(cells) else pa.array([], pa.int64()), "doc": pa.array(cells["doc"]), "n": pa.array(cells["n"].astype(np.int64)), "sketch": pa.array([x.tobytes() for x in cells["sketch"]], pa.binary())})

    least = math.floor(number * similarity / 100 - SLACK * math.sqrt(number * similarity / 100 * (1 - similarity / 100)))

    def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = (a["sketch"] == b["sketch"]).sum(1) >= least
        return near & (100 * np.minimum(a["n"], b["n"]).astype(np.int64) >= similarity * np.maximum(a["n"], b["n"]))

    def unpacked(doc: list[int], n: list[int], bodies: list[bytes]) -> np.ndarray:
        out = np.zeros(len(doc), cell)
        out["doc"], out["n"], out["sketch"] = doc, n, np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, number)
        return out

    def join_up(table: pa.Table) -> pa.Table:
        """Spanning links of the families under a bucket's keys. No more than one row per class comes out of a key."""
        cells = np.concatenate([np.frombuffer(x, cell) for x in table["cells"].to_pylist()])
        cells = cells[np.lexsort((cells["doc"], cells["key"]))]
        begin = np.flatnonzero(np.r_[True, cells["key"][1:] != cells["key"][:-1]])
        size = np.diff(np.append(begin, len(cells)))
        hub = np.repeat(begin, size)
        near = np.zeros(len(cells), bool)
        for at in range(0, len(cells), 1 << 16):
            near[at : at + (1 << 16)] = agree(cells[at : at + (1 << 16)], cells[hub[at : at + (1 << 16)]])
        links = [np.stack([cells["doc"][near], cells["doc"][hub[near]]])]
        # Members that aren't near their key's first one are held against all others there, in one step each.
        tree = Tree()
        for a, b in zip(*[x.tolist() for x in links[0]], strict=True):
            tree.join(a, b)
        far = np.add.reduceat((~near).astype(np.int64), begin) if len(begin) else begin
        more = []
        for g in np.flatnonzero((far > 0) & (size > 2)).tolist():
            own = cells[begin[g] : begin[g] + size[g]]
            names = own["doc"].tolist()
            if len({tree.root(x) for x in names}) == 1:
                continue
            for i in np.flatnonzero(~near[begin[g] : begin[g] + size[g]]).tolist():
                for j in np.flatnonzero(agree(own, own[i : i + 1])).tolist():
                    if tree.join(names[i], names[j]):
                        more.append((names[i], names[j]))
        links.append(np.array(more, np.int64).reshape(-1, 2).T)
        pair = np.unique(np.concatenate(links, axis=1), axis=1)
        pair = pair[:, pair[0] != pair[1]]
        trim()
        return pa.table({"a": pair[0], "b": pair[1]})

    def hot_pairs(hot: DataFrame) -> DataFrame:
        """Pairs (a, b) under hot keys: each class with its key's first one, and those not near it with all others of the key, in blocks."""
        cells = written(firsts.groupBy("chunk").cogroup(hot.groupBy("chunk")).applyInArrow(send_hot, "key long, doc long, n long, sketch binary"), "hot")
        first = cells.groupBy("key").agg(F.min(F.struct("doc", "n", "sketch")).alias("hub"), F.count("*").alias("size"))

        def beside(batches):
            for batch in batches:
                doc, n, body, hub, hub_n, hub_body = (batch[c].to_pylist() for c in ("doc", "n", "sketch", "hub", "hub_n", "hub_sketch"))
                near = agree(unpacked(doc, n, body), unpacked(hub, hub_n, hub_body))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("key", "doc", "n", "sketch", "hub", "size")], pa.array(near)], ["key", "doc", "n", "sketch", "hub", "size", "near"])

        told = cells.join(first, "key").select("key", "doc", "n", "sketch", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.sketch").alias("hub_sketch"), "size")
        told = written(told.mapInArrow(beside, "key long, doc long, n long, sketch binary, hub long, size long, near boolean"), "beside")
        far = told.where("not near")
        parts = far.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("rows"), F.ceil(F.max("size") / group).cast("int").alias("cols"))
        parts = written(parts, "far")
        place = lambda c, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        member = ["key", "doc", "n", "sketch"]
        both = told.join(parts, "key").select(*member, F.lit(False).alias("far"), every("rows").alias("i"), place("cols", 1).alias("j"))
        both = both.unionByName(far.join(parts, "key").select(*member, F.lit(True).alias("far"), place("rows", 2).alias("i"), every("cols").alias("j")))

        def span(table: pa.Table) -> pa.Table:
            """Spanning pairs among those of some far classes and some of all."""
            cells, is_far = unpacked(*[table[c].to_pylist() for c in ("doc", "n", "sketch")]), table["far"].to_numpy()
            tree, out = Tree(), [[], []]
            own, names = cells[~is_far], cells["doc"][~is_far].tolist()
            for x in cells[is_far]:
                for j in np.flatnonzero(agree(own, x[None])).tolist():
                    if tree.join(int(x["doc"]), names[j]):
                        out[0].append(int(x["doc"]))
                        out[1].append(names[j])
            trim()
            return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

        found = both.groupBy("key", "i", "j").applyInArrow(span, "a long, b long")
        return told.where("near").select(F.col("doc").alias("a"), F.col("hub").alias("b")).unionByName(found)

    keys = firsts.groupBy("chunk").applyInArrow(send_keys, "bucket int, chunk int, data binary, held binary")
    wanted = written(keys.groupBy("bucket").applyInArrow(shared, "chunk int, data binary, hot binary"), "wanted")
    members = firsts.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(send_members, "bucket int, cells binary")
    near = members.groupBy("bucket").applyInArrow(join_up, "a long, b long")
    hot = wanted.where(F.length("hot") > 0)
    near = near if hot.isEmpty() else near.unionByName(hot_pairs(hot))
    near = written(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "near")
    own = firsts.select("node", "doc_id", "mark", "n")

    def full(batches):
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bodies = [shingle_set(t or b"", words, known).tobytes() for t in raw(part["text"])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([xxhash.xxh3_128_digest(x) for x in bodies], pa.binary()), pa.array(bodies, pa.binary())], ["doc_id", "mark", "shingles"])

    # Full sets of the members of near pairs, worked out once: of an id with several texts, that of the class's mark. The
    # join is one by shuffle at every size, as its sides grow with the input.
    nodes = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "node")
    nodes = nodes.withColumnRenamed("node", "doc_id") if plain else nodes.join(own, "node").select("doc_id").distinct()
    held = rows.join(nodes.hint("merge"), "doc_id").mapInArrow(full, "doc_id long, mark binary, shingles binary")
    sets = written(held.join(own.select("node", "doc_id", "mark"), ["doc_id", "mark"]).select("node", "shingles"), "sets")

    def blocks_of(count, shingles):
        return F.greatest(F.ceil(F.greatest(count / MEMBERS, shingles / SHINGLES)).cast("int"), F.lit(1))

    # Each near pair on full sets: a class with its partners, a bounded number of which make a star, and stars by bucket.
    parts = near.join(own.select(F.col("node").alias("a"), "n"), "a").groupBy("b").agg(blocks_of(F.count("*"), F.sum("n")).alias("parts"))
    spokes = near.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"))
    spokes = written(spokes, "spokes")
    load = spokes.join(own, "node").agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).first()
    buckets = max(1, math.ceil(load["n"] / (2 * MEMBERS)), math.ceil((load["shingles"] or 0) / SHINGLES))
    stars = spokes.unionByName(spokes.select("b", "part", F.col("b").alias("node")).distinct()).withColumn("bucket", F.pmod(F.xxhash64("b", "part"), F.lit(buckets)).cast("int"))

    def confirm_stars(table: pa.Table) -> pa.Table:
        """The links among a bucket's pairs of a class and a partner."""
        hub, part, node = (table[c].to_numpy() for c in ("b", "part", "node"))
        bodies, out = table["shingles"].to_pylist(), [[], []]
        order = np.lexsort((node != hub, part, hub))  # the hub itself comes first in its star
        cut = np.flatnonzero(np.r_[True, (np.diff(hub[order]) != 0) | (np.diff(part[order]) != 0), True])
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = order[low:high]
            if node[at[0]] != hub[at[0]]:
                raise ValueError("a star without its hub")
            centre, others = np.frombuffer(bodies[at[0]], np.uint64), [np.frombuffer(bodies[i], np.uint64) for i in at[1:]]
            if others:
                n, values = np.array(list(map(len, others))), np.concatenate(others)
                hit = centre[np.minimum(np.searchsorted(centre, values), len(centre) - 1)] == values
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                link = 100 * both >= similarity * (n + len(centre) - both)
                out[0].extend(node[at[1:]][link].tolist())
                out[1].extend([int(hub[at[0]])] * int(link.sum()))
        trim()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    linked_pairs = written(stars.join(sets, "node").select("bucket", "b", "part", "node", "shingles").groupBy("bucket").applyInArrow(confirm_stars, "a long, b long"), "linked")
    found = written(components(linked_pairs), "linked")

    # A family that these links don't join as a whole is compared further: all members with those outside its largest part.
    family = components(near).withColumnRenamed("component", "family")
    placed = family.join(found, "node", "left").withColumn("sub", F.coalesce("component", "node")).join(own, "node")
    subs = placed.groupBy("family", "sub").agg(F.count("*").alias("size"))
    main = subs.groupBy("family").agg(F.max_by("sub", F.struct("size", -F.col("sub"))).alias("main"), F.count("*").alias("subs")).where("subs > 1")
    split = written(placed.join(main, "family").select("node", "family", "n", (F.col("sub") != F.col("main")).alias("rest")), "split")
    rest_n, rest_shingles = F.count(F.when(F.col("rest"), 1)), F.sum(F.when(F.col("rest"), F.col("n")))
    sizes = split.groupBy("family").agg(blocks_of(rest_n, rest_shingles).alias("rows"), blocks_of(F.count("*"), F.sum("n")).alias("cols"))
    dealt = split.join(sizes, "family")
    place = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    tasks = dealt.select("node", "family", every("rows").alias("i"), place("cols").alias("j")).unionByName(dealt.where("rest").select("node", "family", place("rows").alias("i"), every("cols").alias("j"))).distinct()

    def confirm(table: pa.Table) -> pa.Table:
        names, which = np.unique(table["node"].to_numpy(), return_index=True)
        if len(names) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        bodies = table["shingles"].to_pylist()
        label = linked([np.frombuffer(bodies[i], np.uint64) for i in which], similarity)
        trim()
        return pa.table({"a": names, "b": names[label]})

    more = tasks.join(sets, "node").select("family", "i", "j", "node", "shingles").groupBy("family", "i", "j").applyInArrow(confirm, "a long, b long").where("a <> b").distinct()
    # Links between parts, each named by its smallest member, so what is joined here is named so too.
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_sub"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_sub", "a").alias("a"), F.coalesce("b_sub", "b").alias("b"))
    joined = written(components(between).select(F.col("node").alias("component"), F.col("component").alias("whole")), "joined")
    single = joined.select(F.col("component").alias("node"), "whole").join(found, "node", "left_anti").select("node", F.col("whole").alias("component"))
    found = found.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(single)
    if not plain:  # the smallest document of a component, not the smallest number
        least_doc = found.join(own, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
        found = found.join(least_doc, "component").select("node", F.col("least").alias("component"))
    found = found.join(own, "node").select("mark", "component")
    named = classes.join(found, "mark", "left").select("mark", F.coalesce("component", "rep").alias("component_id"))
    out = signs.join(written(named, "named"), "mark", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def op7_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_near_duplicates(docs, words=2).withColumn("kept", F.col("doc_id") == F.col("component_id"))
