import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm.packing import CUT, Packer, op6_sum_of_squares, pack_documents
from strandline.llm.tokens import encoder


def check(pieces, documents, window):
    """Each document's ids lie in its pieces in order; sequences are gapless, whole, or a power of two long."""
    held, sequences = {}, {}
    for doc, start, length, ids, total, sequence, offset in pieces:
        assert length == len(ids) // 4 > 0
        held.setdefault(doc, []).append((start, ids, total))
        sequences.setdefault(sequence, []).append((offset, length))
    assert set(held) == set(documents)
    for doc, parts in held.items():
        parts.sort()
        assert b"".join(x for _, x, _ in parts) == documents[doc] and {t for _, _, t in parts} == {len(documents[doc]) // 4}
        assert [s for s, _, _ in parts] == [sum(len(x) for _, x, _ in parts[:i]) // 4 for i in range(len(parts))]
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        size = sum(n for _, n in parts)
        assert size == window or size < window and size & (size - 1) == 0


def best_level(count, size, window):
    """Where the sum of squares of open windows by level is least, tried out; the fullest of several."""
    options = []
    for at in range(window - size + 1):
        if at and not count[at]:
            continue
        new = list(count)
        if at:
            new[at] -= 1
        if at + size < window:
            new[at + size] += 1
        options.append((sum(c * c for c in new), -at))
    return -min(options)[1]


@pytest.mark.parametrize("window", [8, 32])
def test_levels_and_order(window):
    r, p = random.Random(4), Packer(window)
    documents = {}
    for doc in range(400):
        ids = np.arange(r.randint(1, 3 * window), dtype="<u4").tobytes()
        documents[doc] = ids
        rest = len(ids) // 4 % window
        if rest:
            assert p.level(rest) == best_level(p.count.tolist(), rest, window)
        p.add(doc, 0, ids, len(ids) // 4)
        assert p.count.tolist() == [len(x) for x in p.open]
    pieces = []
    for n, parts in enumerate(p.closed + p.cut()):
        at = 0
        for doc, start, ids, total in parts:
            pieces.append((doc, start, len(ids) // 4, ids, total, n, at))
            at += len(ids) // 4
    check(pieces, documents, window)


def test_documents(spark, docs, odd_rows):
    rows = [(n if i is not None else None, t) for n, (i, t) in enumerate(odd_rows) if i is not None or t is None]
    got = pack_documents(docs(rows).repartition(3))
    want = {i: x + b"\0\0\0\0" for (i, _), x in zip(rows, encoder("byte_bpe_50k.json").many([t or "" for _, t in rows]), strict=True)}
    check([tuple(r) for r in got.collect()], want, 1024)
    assert got.where(F.col("doc_id").isNull()).select("length", "doc_tokens").first() == (1, 1)
    assert pack_documents(docs([])).count() == 0


def test_repeated_rows_are_each_packed(spark, docs):
    got = pack_documents(docs([(1, "a b")] * 4)).collect()
    assert sum(r["length"] for r in got) == 4 * 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_what_tasks_leave_open_meets_before_the_cut(spark, docs):
    """Over many small tasks the rule, not the cut, still fills most windows."""
    from invented_prose import prose

    r = random.Random(8)
    rows = [(i, prose(i % 50, r.choice([5, 20, 40, 90, 200, 350]))) for i in range(1500)]
    got = pack_documents(docs(rows).repartition(16)).collect()
    check([tuple(x) for x in got], {i: x + b"\0\0\0\0" for (i, _), x in zip(rows, encoder("byte_bpe_50k.json").many([t for _, t in rows]), strict=True)}, 1024)
    windows = {x["sequence_id"] for x in got}
    assert len([w for w in windows if w & CUT]) < len(windows) / 4


def test_the_query_itself(spark, docs, odd_rows, tmp_path):
    path = str(tmp_path)
    rows = [(n, t) for n, (_, t) in enumerate(odd_rows)]
    docs(rows).write.parquet(f"{path}/documents.parquet")
    ids = {i: x + b"\0\0\0\0" for (i, _), x in zip(rows, encoder("byte_bpe_50k.json").many([t or "" for _, t in rows]), strict=True)}
    pieces = []
    for x in op6_sum_of_squares(spark, path).collect():
        own = ids[x["doc_id"]][4 * x["start"] : 4 * (x["start"] + x["length"])]
        assert zlib.crc32(own) == x["ids_crc32"]
        pieces.append((x["doc_id"], x["start"], x["length"], own, x["doc_tokens"], x["sequence_id"], x["offset"]))
    check(pieces, ids, 1024)
