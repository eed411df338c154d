import random

import pytest
import zstandard
from pyspark.sql import functions as F

from strandline.llm import language

SOUNDS = {"aa": "the of and to in that was with from this which have".split(), "bb": "der die und das nicht mit ein auf für sich auch wird".split(), "cc": "que los las por con una para como más pero sus este".split()}


def text(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    return [(i, text(lang, i, 60), lang) for i, lang in enumerate(lang for lang in SOUNDS for _ in range(40))]


def plain(model, text, block=2048, margin=0.005):
    """One dictionary after the other over the text's words, each block's bytes added up."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    kept = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    flat = " ".join(["", *kept.split(" "), ""])
    while "  " in flat:
        flat = flat.replace("  ", " ")
    flat, sizes = flat.encode(), {}
    for lang, content in model.dictionaries:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(6)
        coder = zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False, write_dict_id=False)
        sizes[lang] = sum(len(coder.compress(flat[k : k + block])) for k in range(0, len(flat), block))
    best = min(sizes, key=lambda x: (sizes[x], [y for y, _ in model.dictionaries].index(x)))
    score = 1.0 - sizes[best] / min(v for x, v in sizes.items() if x != best)
    return best, score, score >= margin


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy(spark, rows):
    df = frame(spark, rows)
    model = language.fit(df, F.col("doc_id") % 4 != 0)
    assert {x for x, _ in model.dictionaries} == set(SOUNDS) and all(len(d) <= language.SAMPLE * (2 * language.SNIPPET + 2) for _, d in model.dictionaries)
    out = language.predict(df.where("doc_id % 4 = 0"), model).collect()
    assert len(out) == 30 and all(r["lang"] == r["lang_pred"] and r["accepted"] and 0 <= r["score"] <= 1 for r in out)


def test_case_and_marks_tell_nothing(spark, rows):
    model = language.fit(frame(spark, rows), F.lit(True))
    loud = [(i, "!! ".join(t.upper().split()), lang) for i, t, lang in rows[::7]]
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(frame(spark, loud), model).collect())


ODD = [(1, None, None), (2, "", None), (3, "12 34 !!", None), (4, "ß", None), (None, text("bb", 1, 30_000), None), (6, "the", "aa"), (6, "the", "aa"), (7, "漢字" * 40, None), (8, "½ ½ 12", None), (9, "① ②", None), (10, "² Ⅷ _", None), (11, "x", None), (12, "nicht", None), (13, "que DER the", None), (14, "½ª", None)]


def test_odd_texts(spark, rows):
    model = language.fit(frame(spark, rows), F.lit(True))
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"], r["accepted"]) for r in language.predict(frame(spark, ODD), model).collect()}
    assert {i for (i, _), x in got.items() if x == ("und", 0.0, False)} == {1, 2, 3, 8, 9, 10}
    assert got[4, "ß"][0] in SOUNDS and got[14, "½ª"][0] in SOUNDS
    assert got[None, ODD[4][1]][0] == "bb"
    assert not got[7, "漢字" * 40][2] and not got[11, "x"][2]


def test_every_text_against_a_plain_loop(spark, rows):
    """Long, short and odd texts alike: no length escapes the margin."""
    df = frame(spark, rows)
    model = language.fit(df, F.col("doc_id") % 4 != 0)
    texts = rows + ODD + [(1000 + i, " ".join(t.split()[: i % 9]) + (" " + rows[-i - 1][1][: i % 40]), lang) for i, (_, t, lang) in enumerate(rows)]
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"], r["accepted"]) for r in language.predict(frame(spark, texts), model).collect()}
    assert got == {(i, t): plain(model, t) for i, t, _ in texts}
    assert len({x[2] for x in got.values()}) == 2


def test_the_query_itself(spark, rows, tmp_path):
    path = str(tmp_path)
    texts = rows + ODD + [(1000 + i, t.upper(), None) for i, t, _ in rows[:20]]
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    import zlib

    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    model = language.fit(frame(spark, [r for r in texts if not out(r[0])]), F.lit(True))
    want = sorted(repr((i, out(i), *plain(model, t))) for i, t, _ in texts)
    assert sorted(repr((r["doc_id"], r["held_out"], r["lang_pred"], r["score"], r["accepted"])) for r in language.op5_zstd_language(spark, path).collect()) == want


def test_little_to_learn_from(spark, rows):
    none = language.fit(frame(spark, []), F.lit(True))
    assert none.dictionaries == () and language.predict(frame(spark, rows[:1]), none).first()["lang_pred"] == "und"
    odd = [(None, "a b", "aa"), (1, None, "aa"), (2, "x y z", None), (3, "the of and", "aa")]
    single = language.fit(frame(spark, odd), F.lit(True))
    r = language.predict(frame(spark, rows[:1]), single).first()
    assert (r["lang_pred"], r["score"]) == ("aa", 1.0)
    assert language.predict(frame(spark, []), single).count() == 0


def test_sample_is_bounded(spark, rows):
    model = language.fit(frame(spark, rows * 3), F.lit(True), sample=5, snippet=100)
    assert all(450 < len(d) <= 5 * 202 for _, d in model.dictionaries)  # all of the sample is used
    assert [x for x, _ in language.fit(frame(spark, rows[:-1]), F.lit(True), languages=2).dictionaries] == ["aa", "bb"]


def test_all_languages_are_learned(spark, monkeypatch):
    """More than the 256 of most rows, whether a task holds all dictionaries at once or group by group."""
    r = random.Random(5)
    sounds = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for i in range(300)}
    said = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(2)) for _ in range(n))
    few = frame(spark, [(i * 2 + k, said(lang, 40), lang) for i, lang in enumerate(sounds) for k in range(1 + (i < 270))])
    model = language.fit(few, F.lit(True))
    assert {x for x, _ in model.dictionaries} == set(sounds)
    asked = frame(spark, [(i, said(lang, 30), lang) for i, lang in enumerate(sounds) if i % 15 == 14])
    told = language.predict(asked, model).collect()
    assert len(told) == 20 and all(x["lang"] == x["lang_pred"] and x["accepted"] for x in told)
    monkeypatch.setattr(language, "GROUP", 1000)
    assert sorted(map(tuple, language.predict(asked, model).collect())) == sorted(map(tuple, told))
