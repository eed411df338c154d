import random

import pytest
from invented_prose import prose

from strandline.llm import near_dup


def exact(rows, words, similarity=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    label = [i if i is not None else -1 for i, _ in rows]
    usable = [n for n, (i, _) in enumerate(rows) if i is not None and sets[n]]
    changed = True
    while changed:
        changed = False
        for a in usable:
            for b in usable:
                both = len(sets[a] & sets[b])
                if label[a] > label[b] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                    label[a], changed = label[b], True
    return [(i, len(s), None if i is None else c) for (i, _), s, c in zip(rows, sets, label, strict=True)]


def family(start, seed, n, edits):
    """Copies with words changed; some copy a copy."""
    r, out = random.Random(seed), [prose(seed, 60).split()]
    for _ in range(n - 1):
        t = list(r.choice(out[-3:]))
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = f"w{r.randrange(10**6)}"
        out.append(t)
    return [(start + i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("words", "group", "members"), [(2, 4096, 1024), (5, 3, 4)])
def test_components(spark, docs, odd_rows, monkeypatch, words, group, members):
    monkeypatch.setattr(near_dup, "GROUP", group)
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    monkeypatch.setattr(near_dup, "CHUNK", 20_000)
    rows = [*odd_rows, *family(100, 7, 25, 4), *family(200, 8, 10, 8), *[(300 + i, prose(500 + i, 50)) for i in range(40)], (400, "two words"), (401, "TWO  words"), (402, "two")]
    got = near_dup.find_near_duplicates(docs(rows), words=words)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, exact(rows, words)))


def test_links_beside_the_spanning_pairs(spark, docs, monkeypatch):
    """The first of each family is near the others but linked with none of them: their own links are found all the same."""
    monkeypatch.setattr(near_dup, "MEMBERS", 2)
    rows = []
    for f in range(12):
        first = prose(600 + f, 60).split()
        second = [f"x{f}_{i}" if i % 12 == 5 else w for i, w in enumerate(first)]
        rows += [(100 * f, " ".join(first)), (100 * f + 1, " ".join(second)), (100 * f + 2, " ".join(second[:-1])), (100 * f + 3, " ".join([*second[:-1], "end"]))]
    want = exact(rows, 2)
    assert len([1 for i, _, c in want if c != i]) == 24 and all(c == i for i, _, c in want if i % 100 < 2)
    # With few and short keys nearly all of a family share one, and are spanned from its first alone.
    got = near_dup.find_near_duplicates(docs(rows), words=2, width=1, tuples=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_rows_that_repeat_an_id_with_other_texts(spark, docs):
    """Each row is judged by its own text, though several are the first of theirs under one id."""
    one, two, three = (family(0, 31 + k, 3, 2) for k in range(3))
    rows = [(5, one[0][1]), (5, two[0][1]), (5, three[0][1]), (9, one[1][1]), (2, two[1][1]), (9, three[1][1]), (-7, "of its own " * 9), (11, one[0][1]), (5, two[0][1]), (12, three[2][1])]
    got = near_dup.find_near_duplicates(docs(rows), words=2)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, exact(rows, 2)))


def test_nothing(spark, docs):
    assert near_dup.find_near_duplicates(docs([])).count() == 0
    assert [tuple(r) for r in near_dup.find_near_duplicates(docs([(5, None)])).collect()] == [(5, 0, 5)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_keys_are_pairs_of_tuples():
    import numpy as np

    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 1 << 32, (2, 2 * 3 * 4), dtype=np.uint32)
    sketch[1, 3:6] = sketch[0, 3:6]  # tuple 1 of the first collection
    sketch[1, 12:15] = sketch[0, 12:15]  # tuple 0 of the second
    a, b = near_dup.keys_of(sketch, 3, 4)
    assert [int(i) for i in np.flatnonzero(a == b)] == [1 * 4 + 0] and len(set(a.tolist())) == 16


def test_the_query_itself(spark, docs, odd_rows, tmp_path):
    rows = [(n, t) for n, (_, t) in enumerate(odd_rows)] + [*family(100, 17, 12, 3), (400, "two words"), (401, "TWO  words")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.op7_tensor_minhash(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((i, n, c, i == c) for i, n, c in exact(rows, 2))
