import hashlib
import random

import pytest
from invented_prose import prose

from strandline.llm import repeats


def plain(rows, size):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - size + 1):
                first[b[k : k + size]] = min(i, first.get(b[k : k + size], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if i is not None and first[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        edges = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((i, len(b), list(zip(edges[::2], edges[1::2], strict=True)), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(map(repr, out))


def result(df, size=50, chunk=1 << 20):
    rows = repeats.remove_repeats(df, size=size, chunk_bytes=chunk).collect()
    return sorted(repr((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]))) for r in rows)


@pytest.mark.parametrize(("size", "chunk"), [(50, 1 << 20), (50, 3000), (33, 5000)])
def test_against_all_strings(spark, docs, odd_rows, size, chunk):
    r = random.Random(3)
    passages = [prose(700 + i, 25) for i in range(6)]
    rows = [(i, t if t is None else t[:6000]) for i, t in odd_rows]
    rows += [(1000 - i, prose(800 + i, r.randint(0, 60)) + r.choice([" ", "\n", ""]) + r.choice(passages)[r.randint(0, 40) :] + prose(900 + i, r.randint(0, 40))) for i in range(60)]
    assert result(docs(rows), size, chunk) == plain(rows, size)


def test_exactly_the_length(spark, docs):
    a = "".join(chr(97 + i % 26) + str(i) for i in range(40))[:50]
    assert result(docs([(1, a), (2, "x" + a[:49]), (3, a + "y"), (4, a), (5, a[1:])])) == plain([(1, a), (2, "x" + a[:49]), (3, a + "y"), (4, a), (5, a[1:])], 50)


def test_nothing(spark, docs):
    assert result(docs([])) == []
    with pytest.raises(ValueError, match="33"):
        repeats.remove_repeats(docs([]), size=20)


def test_rows_that_repeat_an_id_with_other_texts(spark, docs):
    rows = [(7, prose(40, 30)), (7, prose(41, 30)), (7, prose(41, 30) + " " + prose(40, 30)), (9, prose(41, 30)), (3, prose(42, 9) + prose(41, 12)), (9, "x " + prose(40, 30) + prose(42, 20))]
    for chunk in (1 << 20, 100):
        assert result(docs(rows), 50, chunk) == plain(rows, 50)


def test_the_query_itself(spark, docs, odd_rows, tmp_path):
    rows = [(n, t if t is None else t[:6000]) for n, (_, t) in enumerate(odd_rows)]
    docs(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, n, spans, kept in map(eval, plain(rows, 50)):
        want.append((i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    got = repeats.op8_bucket_pointer(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
