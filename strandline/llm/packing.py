"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each task packs its own documents as they come and holds an array with the number of open windows
at each fill level; a piece goes to the level that makes the sum of the squared numbers least. A
document longer than a window fills whole windows first. What is open at the tasks' ends comes
together in few tasks, where its pieces are placed once more by the same rule, and only what is open
after that is closed by cutting: pieces fill windows one after the other, and the last ones have
lengths that are powers of two, which need no padding. Only open windows are shuffled; memory is a
batch and the open windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .tokens import encoder, groups

WINDOW, END, VOCABULARY = 1024, 0, "byte_bpe_50k.json"
#: Tokens of open windows that are placed again in one task.
AGAIN = 4 << 20
#: Bits of sequence ids: placed in the second pass, closed by cutting; below them the task's number, from bit 40.
SECOND, CUT = 1 << 62, 1 << 61


class Packer:
    """Levels of one task. A piece is (doc, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.count = window, np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.closed: list[list] = []

    def level(self, size: int) -> int:
        """Where a piece makes the sum of squares least; ties go to the fullest."""
        top = self.window - size
        low = self.count[: top + 1]
        change = 2 * self.count[size : self.window + 1] + 1 - 2 * low + 1
        change[top] -= 2 * self.count[self.window] + 1  # a full window isn't counted
        change[0] += 2 * low[0] - 1  # neither is an empty one
        change[1:][low[1:] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        at = self.level(size)
        window = self.open[at].pop() if at else []
        window.append(piece)
        if at:
            self.count[at] -= 1
        if at + size == self.window:
            self.closed.append(window)
        else:
            self.open[at + size].append(window)
            self.count[at + size] += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        step = 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.closed.append([(doc, start + at // 4, ids[at : at + step], total)])
        if whole < len(ids):
            self.place((doc, start + whole // 4, ids[whole:], total))

    def rest(self) -> list[tuple]:
        """The pieces of all open windows, which are open no more."""
        out = [p for level in reversed(self.open) for window in level for p in window]
        self.open, self.count = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, np.int64)
        return out

    def cut(self) -> list[list]:
        """Windows of the open ones' pieces, one after the other: whole ones, and lengths that are powers of two."""
        rest, out = self.rest(), []
        left = sum(len(p[2]) for p in rest) // 4
        sizes = [self.window] * (left // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if left % self.window >> b & 1]
        window, room = [], 0
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    if window:
                        out.append(window)
                    window, room = [], sizes.pop(0)
                part = ids[: 4 * room]
                window.append((doc, start, part, total))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
        return [*out, window] if window else out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, vocabulary: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each row of docs is a document and ends with the id ``end``. A null text counts as empty and is
    the end alone; a null id and repeated rows are packed like others; an empty table gives no rows;
    other columns are ignored. Sequence ids are unique, not consecutive: see ``SECOND`` and ``CUT``.
    What the first pass gives is written, so a lost executor repeats its own tasks alone.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def rows(windows: list[list], first: int | None, id_type: pa.DataType) -> pa.RecordBatch:
        """Pieces of windows numbered from ``first``; without a number they are open, each by itself."""
        cols: list[list] = [[] for _ in range(7)]
        for n, pieces in enumerate(windows):
            offset = 0
            for doc, start, ids, total in pieces:
                for c, x in zip(cols, (doc, start, len(ids) // 4, ids, total, None if first is None else first + n, offset), strict=True):
                    c.append(x)
                offset += len(ids) // 4
        types = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode, tail = encoder(vocabulary, path), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for at, size in groups(batch["text"]):
                part = batch.slice(at, size)
                yield from ((doc, 0, ids + tail, len(ids) // 4 + 1) for doc, ids in zip(part["doc_id"].to_pylist(), encode.many(part["text"].to_pylist()), strict=True))

    def open_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True)

    def packer(pieces, again: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, number = Packer(window), (SECOND if again else 0) | TaskContext.get().partitionId() << 40
            for piece in pieces(batches):
                own.add(*piece)
                if len(own.closed) >= 1024:
                    yield rows(own.closed, number, id_type)
                    number, own.closed = number + len(own.closed), []
            yield rows(own.closed, number, id_type)
            if again:
                yield rows(own.cut(), number + len(own.closed) | CUT, id_type)
            else:
                yield rows([own.rest()], None, id_type)

        return pack

    id_type = to_arrow_type(texts.schema["doc_id"].dataType)
    first = written(texts.mapInArrow(packer(encoded, False), schema), "packed")
    left = first.where("sequence_id is null")
    tasks = max(1, math.ceil((left.agg(F.sum("length")).first()[0] or 0) / AGAIN))
    # In an order of its own, so that a task that is run again gives the same windows.
    deal = F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(tasks))
    left = left.select("doc_id", "start", "ids", "doc_tokens", F.xxhash64("start", F.crc32("ids"), "doc_id").alias("place"), deal.alias("deal"))
    left = left.repartition(tasks, "deal").sortWithinPartitions("place", "doc_id", "start", "ids")
    return first.where("sequence_id is not null").unionByName(left.drop("place", "deal").mapInArrow(packer(open_pieces, True), schema))


def op6_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
