"""Exact substring dedup: bytes under a string of ``size`` bytes that also starts in an earlier document go.

Equal strings share their smallest q-gram hash, so runs of positions with one such hash are dealt by
it and each string's copies meet in one task, though a position costs a fraction of a row. First the
hashes alone travel, to find those of more than one document; then the bytes of their runs do, each
distinct one once from a chunk, however many of its documents hold it. There the suffixes are put
into q-gram buckets, and buckets are refined by sorting on the bucket identifiers of later offsets
(8, 16, 32 and all bytes), each refinement reused by the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashTable, chunk_count, raw, trim

#: Bytes of a string that counts, and of the q-grams whose smallest hash deals the runs.
SIZE, Q = 50, 20
#: Bytes of text in a chunk, and positions hashed at once.
CHUNK, BLOCK = 16 << 20, 1 << 16
#: Buckets of strings for each chunk: what one task refines is a part of a chunk's size.
FINE = 8
CELL = [("first", "<i8"), ("last", "<i8"), ("index", "<i4"), ("number", "<i4")]
STRETCH = [("best", "<i8"), ("index", "<i4"), ("start", "<i4"), ("number", "<i4")]

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _hashes(part: np.ndarray) -> np.ndarray:
    """A hash of the Q = 20 bytes at each place."""
    a = part.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a4 = a[:-2] | a[2:] << np.uint64(16)
    a8 = a4[:-4] | a4[4:] << np.uint64(32)
    n = len(part) - Q + 1
    h = a8[:n] * _C1
    h ^= h >> np.uint64(32)
    h += a8[8 : 8 + n] * _C2
    h ^= h >> np.uint64(29)
    h += a4[16 : 16 + n] * _C3
    h *= _C1
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[: len(h) - width + reach], h[width - reach :]) if reach < width else h


def runs(flat: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, hash) of runs of strings with one smallest hash. ``begin``: where texts begin, and the end."""
    starts, numbers, marks = [], [], []
    inside = np.ones(len(flat) + 1, bool)
    inside[-1] = False
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        inside[max(a, b - size + 1) : b] = False
    for at in range(0, len(flat) - size + 1, BLOCK):
        part = flat[at : at + BLOCK + size - 1]
        m = _least(_hashes(part), size - Q + 1)
        ok = inside[at : at + len(m)]
        edge = np.ones(len(m), bool)
        edge[1:] = (m[1:] != m[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(edge)
        number = np.diff(np.append(first, len(m)))
        keep = ok[first]
        starts.append(first[keep] + at)
        numbers.append(number[keep])
        marks.append(m[first[keep]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *numbers]), np.concatenate([empty.view(np.uint64), *marks])


def refine(body: bytes, first: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, class) of the strings that start at ``number`` places from ``first`` on: equal strings have one class.

    Each run's bytes lie together, ``size - 1`` more than it has strings.
    """
    flat = np.frombuffer(body, np.uint8)
    a = flat.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    a = a[:-4] | a[4:] << np.uint64(32)
    left = np.zeros(len(flat), np.int32)  # bytes from here to the run's end
    for f, n in zip(first.tolist(), number.tolist(), strict=True):
        left[f : f + n + size - 1] = np.arange(n + size - 1, 0, -1, dtype=np.int32)
    _, bucket, held = np.unique(a, return_inverse=True, return_counts=True)
    del a
    places = np.repeat(first - np.cumsum(number) + number, number) + np.arange(int(number.sum()))
    reach = 8
    while reach < size:
        step = min(reach, size - reach)
        # A suffix alone in its bucket is told apart already; the others are sorted by the bucket ``step`` bytes on.
        last = reach + step == size
        todo = places if last else np.flatnonzero(left >= reach + step)
        todo = todo[held[bucket[todo]] > 1]
        key = bucket[todo] * np.int64(len(held)) + bucket[todo + step]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        fresh = bucket.copy()
        fresh[todo] = len(held) + inverse
        bucket, held = fresh, np.concatenate([held, counts])
        reach += step
    return places, bucket[places]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (starts and ends of maximal removed runs), kept (binary).

    Ids are integers. A byte goes if some ``size`` bytes over it also start in a document of smaller
    id; all is judged on the input. A null text counts as empty; rows with a null id are kept whole and
    take no part; rows that repeat an id, with one text or several, never remove each other's bytes,
    and each gets a row. An empty table gives no rows; other columns are ignored. Documents equal to
    an earlier one are told by 128 bits of hash and their length, and go whole, without their strings
    being looked at.
    """
    if size < 33:
        raise ValueError("size must be 33 at least")
    chunks = chunk_count(docs, text_col, chunk_bytes)
    buckets = FINE * chunks
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    chunk = lambda mark: F.pmod(F.xxhash64("doc_id", mark), F.lit(chunks)).cast("int").alias("chunk")
    texts = docs.select(doc.alias("doc_id"), text.alias("text")).select(chunk(F.xxhash64("text")), "doc_id", "text")
    whole = docs.where(doc.isNotNull()).groupBy(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.octet_length(text).alias("n")).agg(F.min(doc).alias("doc_id"))
    # Those first of their text, by chunk: bounded as the chunks are.
    firsts = whole.select(chunk(F.col("h1")), "doc_id").groupBy("chunk").agg(F.collect_list("doc_id").alias("firsts")).select("chunk", "firsts", F.lit(None).cast("binary").alias("data"))

    def own(table: pa.Table, side: pa.Table) -> tuple[list, list[bytes], np.ndarray, list[int]]:
        """Ids, texts, and of those first of their text: their bytes one after the other, and their rows.

        Rows of a group come in any order, and in another one to each pass, so these are put in order here.
        """
        known = {i for x in side["firsts"].to_pylist() if x is not None for i in x}
        ids, bodies = table["doc_id"].to_pylist(), raw(table["text"])
        at = sorted((i for i, d in enumerate(ids) if d in known and len(bodies[i]) >= size), key=lambda i: (ids[i], bodies[i]))
        return ids, bodies, np.frombuffer(b"".join(bodies[i] for i in at), np.uint8), at

    def begins(bodies: list[bytes], at: list[int]) -> np.ndarray:
        return np.cumsum([0, *[len(bodies[i]) for i in at]])

    def marks(table: pa.Table, side: pa.Table) -> pa.Table:
        """Sorted hashes of a chunk's runs, by bucket; the lowest bit says that two documents here have it."""
        ids, bodies, flat, at = own(table, side)
        begin = begins(bodies, at)
        start, _, mark = runs(flat, begin, size)
        doc = np.searchsorted(begin, start, "right") - 1
        mark = mark & ~np.uint64(1)
        order = np.lexsort((mark, mark % np.uint64(chunks))) if chunks > 1 else np.argsort(mark)
        mark, doc = mark[order], doc[order]
        out: dict = {"bucket": [], "chunk": [], "data": []}
        if len(mark):
            first = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            mark = mark[first]
            bucket = (mark % np.uint64(chunks)).astype(np.int64)
            mark = mark | several.astype(np.uint64)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            number = table["chunk"][0].as_py()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out["bucket"].append(int(bucket[a]))
                out["chunk"].append(number)
                out["data"].append(mark[a:b].tobytes())
        trim()
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "data": pa.array(out["data"], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        """Of a bucket's hashes those of several documents, back to each chunk that has them."""
        parts = [np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()]
        mark = np.concatenate(parts)
        values, counts = np.unique(mark & ~np.uint64(1), return_counts=True)
        several = mark[(mark & np.uint64(1)) == 1] & ~np.uint64(1)
        wanted = np.union1d(values[counts > 1], several)
        kept = [p[np.isin(p & ~np.uint64(1), wanted, assume_unique=True)] & ~np.uint64(1) for p in parts]
        some = [i for i, k in enumerate(kept) if len(k)]
        return pa.table({"chunk": table["chunk"].take(pa.array(some, pa.int64())), "data": pa.array([kept[i].tobytes() for i in some], pa.binary())})

    def found(table: pa.Table, side: pa.Table):
        """Runs with shared hashes and their rows, and the distinct byte strings among them with their buckets, in an order that the rows alone decide."""
        ids, bodies, flat, at = own(table, side)
        begin = begins(bodies, at)
        known = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in side["data"].to_pylist() if x is not None]])
        start, number, mark = runs(flat, begin, size)
        mark = mark & ~np.uint64(1)
        keep = HashTable(known).find(mark) >= 0
        start, number, mark = start[keep], number[keep], mark[keep]
        data, seen, which = flat.tobytes(), {}, np.empty(len(start), np.int64)
        for i, (a, b) in enumerate(zip(start.tolist(), (start + number + size - 1).tolist(), strict=True)):
            which[i] = seen.setdefault(data[a:b], len(seen))
        del data
        bucket = np.zeros(len(seen), np.int64)
        bucket[which] = mark % np.uint64(buckets)
        doc = np.searchsorted(begin, start, "right") - 1
        rows = np.array(at, np.int64)[doc]
        names = np.array([ids[i] for i in at], np.int64)[doc]
        return ids, bodies, rows, names, start - begin[doc], which, list(seen), bucket

    def send(table: pa.Table, side: pa.Table) -> pa.Table:
        """A chunk's distinct strings by bucket, with the first and the last of its documents that hold them."""
        _, _, _, names, _, which, bodies, bucket = found(table, side)
        cell = np.zeros(len(bodies), CELL)
        cell["index"], cell["number"] = np.arange(len(bodies)), np.fromiter(map(len, bodies), np.int64, len(bodies)) - (size - 1)
        cell["first"] = np.iinfo(np.int64).max
        cell["last"] = np.iinfo(np.int64).min
        np.minimum.at(cell["first"], which, names)
        np.maximum.at(cell["last"], which, names)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True]) if len(order) else np.zeros(1, np.int64)
        rows = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        number = table["chunk"][0].as_py() if table.num_rows else 0
        out = pa.table({
            "bucket": pa.array([int(bucket[r[0]]) for r in rows], pa.int32()), "chunk": pa.array([number] * len(rows), pa.int32()),
            "cells": pa.array([cell[r].tobytes() for r in rows], pa.binary()), "body": pa.array([b"".join([bodies[i] for i in r]) for r in rows], pa.binary()),
        })
        del bodies
        trim()
        return out

    def judge(table: pa.Table) -> pa.Table:
        """Back to each chunk: stretches of its strings that a document before its last one holds, and the earliest such."""
        cells = [np.frombuffer(x, CELL) for x in table["cells"].to_pylist()]
        seen: dict[bytes, int] = {}
        which = []
        for body, own_cells in zip(table["body"].to_pylist(), cells, strict=True):
            low, part = 0, []
            for high in np.cumsum(own_cells["number"] + (size - 1)).tolist():
                part.append(seen.setdefault(body[low:high], len(seen)))
                low = high
            which.append(np.array(part, np.int64))
        # Runs that are equal as a whole are looked at once, for their earliest document.
        earliest = np.full(len(seen), np.iinfo(np.int64).max)
        for w, own_cells in zip(which, cells, strict=True):
            np.minimum.at(earliest, w, own_cells["first"])
        length = np.fromiter(map(len, seen), np.int64, len(seen))
        number, body = length - (size - 1), b"".join(seen)
        del seen
        _, group = refine(body, np.cumsum(length) - length, number, size)
        _, group = np.unique(group, return_inverse=True)
        best = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, group, np.repeat(earliest, number))
        best = best[group]
        begin = np.cumsum(number) - number
        # Stretches of equal answers, of each distinct string.
        new = np.r_[True, best[1:] != best[:-1]]
        new[begin] = True
        edge = np.flatnonzero(new)
        stretch_of = np.searchsorted(begin, edge, "right") - 1
        stretch = np.zeros(len(edge), STRETCH)
        stretch["start"], stretch["number"], stretch["best"] = edge - begin[stretch_of], np.diff(np.append(edge, len(best))), best[edge]
        per = np.bincount(stretch_of, minlength=len(number))
        at = np.cumsum(per) - per
        out_chunk, out = [], []
        for chunk_no, w, own_cells in zip(table["chunk"].to_pylist(), which, cells, strict=True):
            n = per[w]
            row = np.repeat(np.arange(len(w)), n)
            got = stretch[np.repeat(at[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            got["index"] = own_cells["index"][row]
            got = got[got["best"] < own_cells["last"][row]]
            if len(got):
                out_chunk.append(chunk_no)
                out.append(got.tobytes())
        trim()
        return pa.table({"chunk": pa.array(out_chunk, pa.int32()), "gone": pa.array(out, pa.binary())})

    def cut(table: pa.Table, side: pa.Table) -> pa.Table:
        ids, bodies, rows, names, start, which, strings, _ = found(table, side)
        strings = len(strings)
        known = {i for x in side["firsts"].to_pylist() if x is not None for i in x}
        got = np.concatenate([np.zeros(0, STRETCH), *[np.frombuffer(x, STRETCH) for x in side["gone"].to_pylist() if x is not None]])
        got = got[np.argsort(got["index"], kind="stable")]
        per = np.bincount(got["index"], minlength=strings)
        at, n = np.cumsum(per) - per, per[which]
        row = np.repeat(np.arange(len(which)), n)
        part = got[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        keep = part["best"] < names[row]
        row, part = row[keep], part[keep]
        owner, low, high = rows[row], start[row] + part["start"], start[row] + part["start"] + part["number"] + size - 1
        order = np.lexsort((low, owner))
        owner, low, high = owner[order], low[order], high[order]
        owners, first = np.unique(owner, return_index=True)
        ends = dict(zip(owners.tolist(), zip(first.tolist(), np.append(first, len(owner))[1:].tolist(), strict=True), strict=True))
        spans, kept = [], []
        for k, (i, body) in enumerate(zip(ids, bodies, strict=True)):
            own_spans: list[dict] = []
            if i is not None and i not in known:
                own_spans = [{"start": 0, "end": len(body)}] if len(body) >= size else []
            elif k in ends:
                a, b = ends[k]
                end = np.maximum.accumulate(high[a:b])
                new = np.flatnonzero(np.r_[True, low[a + 1 : b] > end[:-1]])
                own_spans = [{"start": s, "end": e} for s, e in zip(low[a:b][new].tolist(), end[np.r_[new[1:] - 1, b - a - 1]].tolist(), strict=True)]
            spans.append(own_spans)
            edges = [0, *[x for s in own_spans for x in (s["start"], s["end"])], len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(list(map(len, bodies)), pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})
        del bodies, kept, spans
        trim()
        return out

    # The exchange of the texts by chunk is one, which all three passes read.
    by_chunk, no_ids, no_data = texts.groupBy("chunk"), F.lit(None).cast("array<bigint>").alias("firsts"), F.lit(None).cast("binary")
    keys = by_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(marks, "bucket int, chunk int, data binary")
    wanted = firsts.unionByName(keys.groupBy("bucket").applyInArrow(shared, "chunk int, data binary").select("chunk", no_ids, "data"))
    sent = by_chunk.cogroup(wanted.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, cells binary, body binary")
    gone = sent.groupBy("bucket").applyInArrow(judge, "chunk int, gone binary").select("chunk", no_ids, no_data.alias("data"), "gone")
    side = wanted.withColumn("gone", no_data).unionByName(gone)
    return by_chunk.cogroup(side.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op8_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
