import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ppm
from strandline.llm.common import HashTable, mix64


class Plain:
    """The model with dictionaries: counts of each context, walked down with exclusion."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            s = b"\xff" * order + t + b"\xff"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.counts[s[i - k : i]][s[i]] += 1

    def probability(self, context, symbol):
        p, out = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in out}
            if not left:
                continue
            total = 2 * sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / total
            p *= len(left) / total
            out |= set(seen)
        return p / (256 - len(out))

    def score(self, text):
        s = b"\xff" * self.order + text + b"\xff"
        return sum(math.log10(self.probability(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def base(words, rows, train):
    c = Counter(w for (_, t), f in zip(rows, train, strict=True) if f for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    return sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), sum(c[w] > 0 for w in words), n


@pytest.mark.parametrize(("order", "chunk"), [(2, 1 << 20), (3, 3000), (5, 1 << 20), (5, 2000)])
def test_against_dictionaries(spark, docs, odd_rows, order, chunk):
    rows = [(i, t if t is None or len(t) < 4000 else t[:3000]) for i, t in odd_rows]
    in_train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 != 0
    train = [in_train(i) for i, _ in rows]
    model = Plain([(t or "").encode() for (_, t), f in zip(rows, train, strict=True) if f], order)
    got = ppm.score_documents(docs(rows), ~ppm.held_out("doc_id", 3, 0), order=order, chunk_bytes=chunk).collect()
    want = []
    for (i, t), f in zip(rows, train, strict=True):
        words = [*(t or "").encode().lower().split(), b"\n"]
        b, known, n = base(words, rows, train)
        want.append((str(i), f, len(words), known, n, b, model.score((t or "").encode())))
    found = sorted((str(r["doc_id"]), r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert len(found) == len(want)
    for x, y in zip(found, sorted(want), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-12)


def test_probabilities_add_up(spark):
    model = Plain([b"abracadabra", b"abba"], 3)
    for context in (b"abr", b"xab", b"\xff\xff\xff", b"zzz"):
        assert sum(model.probability(context, s) for s in range(256)) == pytest.approx(1.0)


def test_without_training_rows_and_empty(spark, docs):
    r = ppm.score_documents(docs([(1, "ab")]), F.lit(False)).first()
    assert (r["train_tokens"], r["n_known"]) == (0, 0) and r["score"] == pytest.approx(-3 * math.log10(256), rel=1e-12)
    assert ppm.score_documents(docs([]), F.lit(True)).count() == 0


def test_hash_table():
    keys = mix64(np.arange(5000, dtype=np.uint64))
    table = HashTable(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(mix64(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()
    assert (HashTable(keys[:0]).find(keys) == -1).all()


def test_blocks_come_back_bit_for_bit():
    r = np.random.default_rng(3)
    for n in (0, 1, 5000):
        keys, values = np.sort(r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)), r.normal(size=n)
        assert (ppm.unpack_keys(ppm.pack_keys(keys)) == keys).all() and (ppm.unpack(ppm.pack(values), float) == values).all()


def test_a_group_is_split_but_a_longer_context_is_not():
    keys = np.random.default_rng(4).integers(0, 1 << 48, 20_000, np.uint64)
    share = ppm.share_of(keys, 16, 8)
    assert len(set(share.tolist())) == 128
    by_context: dict = {}
    for k, s in zip((keys >> np.uint64(8) & np.uint64(0xFFFFFF)).tolist(), share.tolist(), strict=True):
        assert by_context.setdefault(k, s) == s


def test_the_query_itself(spark, docs, odd_rows, tmp_path):
    rows = [(n, t if t is None else t[:2000]) for n, (_, t) in enumerate(odd_rows)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    model = Plain([(t or "").encode() for (_, t), f in zip(rows, train, strict=True) if f], 5)
    got = {r["doc_id"]: r for r in ppm.op1_ppm_score(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, t), f in zip(rows, train, strict=True):
        words = [*(t or "").encode().lower().split(), b"\n"]
        b, known, n = base(words, rows, train)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not f, len(words), known, n)
        assert r["base_score"] == pytest.approx(b, rel=1e-12) and r["score"] == pytest.approx(model.score((t or "").encode()), rel=1e-12)
