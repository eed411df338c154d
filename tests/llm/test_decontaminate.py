import random
from itertools import combinations

import numpy as np
import pytest
from invented_prose import prose
from pyspark.sql import functions as F

from strandline.llm.decontaminate import WordHashes, find_leaks, judge, op10_spaced_seeds


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    return [(i, " ".join(words(i, 14 + i))) for i in range(20)]


def frame(spark, items):
    return spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, seed string")


def spoil(text, every, start=2):
    w = text.split()
    for k in range(start, len(w), every):
        w[k] = f"other{k}"
    return " ".join(w)


def test_leaks_and_clean_texts(spark, docs, items):
    rows = [(i, prose(i, 200)) for i in range(30)]
    rows += [(100 + i, prose(i, 50) + " " + t.upper().replace(" ", ", ") + ". " + prose(i + 1, 50)) for i, t in items]
    rows += [(200 + i, prose(i, 10) + "\n" + spoil(t, 6) + "\n" + prose(i, 9)) for i, t in items]
    rows += [(300, items[9][1]), (300, items[9][1]), (None, items[3][1]), (301, None), (302, ""), (303, " ".join(items[5][1].split()[:5])), (304, prose(1, 30_000) + " " + items[2][1])]
    rows += [(305, " ".join(words(19, 33)[:16]) + " " + prose(7, 30)), (306, spoil(items[4][1], 2, 1))]
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs(rows), frame(spark, items)).collect()}
    assert set(got) == {(100 + i, i) for i, _ in items} | {(200 + i, i) for i, _ in items} | {(300, 9), (None, 3), (304, 2), (305, 19)}
    whole = got[104, 4]
    assert (whole["first_word"], whole["n_words"], whole["n_equal"], whole["item_words"]) == (50, 18, 18, 18)
    assert got[304, 2]["first_word"] == 30_000 and got[305, 19]["n_equal"] == 16


def test_nothing(spark, docs, items):
    assert find_leaks(docs([]), frame(spark, items)).count() == 0
    assert find_leaks(docs([(1, items[0][1])]), frame(spark, [])).count() == 0
    odd = frame(spark, [(None, items[0][1]), (1, None), (2, "one two three"), (3, ""), (4, items[0][1]), (4, items[0][1])])
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(docs([(1, items[0][1] + " one two three")]), odd).collect()] == [(1, 4)]


def test_judge_against_all_runs():
    rng = np.random.default_rng(6)
    for _ in range(200):
        item = rng.integers(0, 1000, 30).astype(np.uint64)
        doc = np.concatenate([rng.integers(2000, 3000, 5), np.where(rng.random(30) < rng.choice([0.3, 0.6, 0.85]), item, 7), rng.integers(2000, 3000, 5)]).astype(np.uint64)
        equal = doc[5:35] == item
        got = judge(doc, item, 5, 0.8, 13)
        at = np.flatnonzero(equal)
        if equal.sum() >= 24:
            assert got == (5 + at[0], at[-1] - at[0] + 1, len(at))
            continue
        runs = [(b - a + 1, -a) for a in at for b in at if b - a + 1 >= 13 and equal[a : b + 1].sum() >= 0.8 * (b - a + 1)]
        assert (got is None) == (not runs)
        if runs:
            size, a = max(runs)
            assert got[1] == size and equal[got[0] - 5 : got[0] - 5 + size].sum() == got[2] >= 0.8 * size


def test_against_every_place(spark, docs):
    """Items of 13 to 40 words, with words changed anywhere: found where some place counts, by hand, and nowhere else."""
    r = random.Random(11)
    items = [(i, " ".join(words(900 + i, 13 + i % 28))) for i in range(40)]
    rows = []
    for k in range(240):
        w = items[r.randrange(40)][1].split()
        a = r.randrange(max(1, len(w) - 12))
        part = w[a : r.randint(a + 8, len(w))] if r.random() < 0.4 and a + 8 <= len(w) else w
        part = [f"new{r.randrange(999)}" if r.random() < r.choice([0, 0.1, 0.2, 0.3]) else x for x in part]
        rows.append((k, " ".join([*words(5000 + k, r.randint(0, 9)), *part, *words(7000 + k, r.randint(0, 9))])))
    known = WordHashes()
    hashed = lambda t: np.array([known[x] for x in t.encode().split()], np.uint64)
    marked, want = [(i, hashed(t)) for i, t in items], set()
    for k, t in rows:
        own = hashed(t)
        for i, item in marked:
            if any(judge(own, item, s, 0.8, 13) for s in range(1 - len(item), len(own))):
                want.add((k, i))
    assert {(x["doc_id"], x["item_id"]) for x in find_leaks(docs(rows), frame(spark, items), shortest=1).collect()} == want and 100 < len(want) < 240


def test_hot_item(spark, docs, items):
    rows = [(i, f"{prose(i, 5)} {items[0][1]}") for i in range(300)]
    assert find_leaks(docs(rows), frame(spark, items)).where(F.col("item_id") == 0).count() == 300


def test_short_items_with_all_changes(spark, docs, tmp_path):
    """Items of one to twelve words are found with every choice of changed words that leaves 0.8 of them, and no more."""
    items = [(n, " ".join(words(50 + n, n))) for n in range(1, 13)]
    rows, want = [], set()
    for n, text in items:
        for k in range(n // 5 + 2):
            for gone in combinations(range(n), min(k, n)):
                w = [f"other{i}" if i in gone else x for i, x in enumerate(text.split())]
                if n - len(gone) >= 0.8 * n:
                    want.add((len(rows), n))
                rows.append((len(rows), f"{prose(n, 8)} {' '.join(w)} {prose(n + 1, 8)}"))
    docs(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op10_spaced_seeds(spark, str(tmp_path))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
