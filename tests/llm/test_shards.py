import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import shards
from strandline.llm.common import mix64, shared_dir
from strandline.llm.tokens import Encoder, encoder, vocabulary_path

ODD = ["", " ", "\n", "a  b", "a \n b\n", "  lead", "trail  ", "x\ty z \u0085 q", "don't we'll 'S  's\n's", "á b ́c", " x 　y", "tab\t\ttab \x1c\x1d a", "<|endoftext|> <|startoftext|>", "1234 5 6  78", "\r\n x\r\ny", "İSTANBUL ΣΑΣ ß", "汉字 漢字。 a", "\x00 \x01 \x01x", "\n\na", "a\n\n"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, odd_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(name))
    plain.encode_special_tokens = True
    texts = ODD + [t for _, t in odd_rows if t is not None]
    for group in (texts, texts[::-1], [" ".join(ODD)]):
        want = [plain.encode(t, add_special_tokens=False).ids for t in group]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(name).many(group)] == want
        small = Encoder(vocabulary_path(name), not name.startswith("word_"))
        assert [np.frombuffer(small.many([t])[0], "<u4").tolist() for t in group] == want


def test_words_at_any_sign_and_white_space_equal_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    atoms = [*"abzAZ  \n\n'.,$|09\t\r\x0b\x1c\x1f\x01\u0085\u00a0\u1680\u2000\u2019\u2028\u202f\u205f\u3000éßÉ×÷öÿſжа\u0301ªµ²½漢😀\u200b", "'s", "'ll", "s'", " the", "é.", "é'", "×.", "... ", "a.b", "\n\n", "<|endoftext|>", "Ċ", "Ġ"]
    r = random.Random(3)
    for n in range(40):
        weights = [r.random() ** 3 for _ in atoms]
        texts = ["".join(r.choices(atoms, weights, k=r.choice([0, 1, 2, 3, 8, 40, 200]))) for _ in range(60)]
        got = Encoder(vocabulary_path("byte_bpe_50k.json"), True).many(texts) if n % 20 == 0 else encoder("byte_bpe_50k.json").many(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_work_of_the_byte_level_encoder():
    """A sign makes no new word of the one before it, and words of letters don't pass the slow pre-tokenizer."""
    own, seen = Encoder(vocabulary_path("byte_bpe_50k.json"), True), []

    class Watched:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

        def encode(self, text, **more):
            seen.append(text)
            return tokenizer.encode(text, **more)

    tokenizer, own.tokenizer = own.tokenizer, Watched()
    own.many(["un été, cet été. Été|$$ слово; l'été $$$", " été"])
    assert set(own.known) == {"un", " été", " cet", " Été", " слово", " l", "'été", ",", ".", "|$$", ";", " $$$"}
    assert sorted("".join(seen).replace("\n", "")) == sorted("'été,.|$$; $$$")


def test_minimal_perfect_hash():
    h = mix64(np.arange(10_000, dtype=np.uint64))
    levels, slots = shards.build_mph(h)
    assert sorted(slots.tolist()) == list(range(10_000)) and (shards.find_mph(levels, h) == slots).all()
    assert shards.build_mph(h[:0]) == ([], pytest.approx(np.zeros(0)))
    assert (shards.find_mph([], h[:5]) == -1).all()


def test_round_trip(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 20_000)
    folder = shared_dir(spark, "ids")
    records = shards.write_ids(docs(odd_rows), folder)
    rows = sorted(records.collect(), key=lambda r: r["start"])
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = [np.frombuffer(x, "<u4").tolist() + [1] for x in encoder("word_bpe_49k.json").many([t or "" for _, t in order])]
    assert [r["doc_id"] for r in rows] == [i for i, _ in order] and [r["n_tokens"] for r in rows] == list(map(len, want))
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    back = {(r["shard"], r["record"]): np.frombuffer(r["ids"], "<u4").tolist() for r in shards.read_ids(records, folder).collect()}
    assert [back[r["shard"], r["record"]] for r in rows] == want and len(back) == len(want)
    asked = spark.createDataFrame([(10,), (777,), (None,), (10,)], "doc_id long")
    assert sorted((r["doc_id"] is None, r["record"]) for r in shards.read_ids(asked, folder).collect()) == sorted((r["doc_id"] is None, r["record"]) for r in rows if r["doc_id"] in (10, None))
    one = rows[3]
    assert shards.Shard(folder, one["shard"]).ids(one["record"]).tolist() == want[3]
    for key in (10, None, 9, 777):
        assert [x.tolist() for x in shards.lookup(folder, key)] == [w for r, w in zip(rows, want, strict=True) if r["doc_id"] == key]


def test_keyed_access_over_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET", 40)
    folder = shared_dir(spark, "ids")
    shards.write_ids(docs([(i * 3, f"t {i}") for i in range(400)]), folder)
    plain = {i * 3: x for i, x in enumerate(encoder("word_bpe_49k.json").many([f"t {i}" for i in range(400)]))}
    for key in range(0, 1200, 17):
        assert [x.astype("<u4").tobytes() for x in shards.lookup(folder, key)] == ([plain[key] + b"\1\0\0\0"] if key in plain else [])


def test_width_of_ids(spark, docs):
    folder = shared_dir(spark, "ids")
    shards.write_ids(docs([(1, "some words")]), folder)
    assert shards.Shard(folder, 0).width == 2
    wide = shared_dir(spark, "ids")
    shards.write_ids(docs([(1, "some words")]), wide, end=70_000)
    assert shards.Shard(wide, 0).width == 4 and shards.Shard(wide, 0).ids(0)[-1] == 70_000
    with pytest.raises(Exception, match="70000 doesn't fit"):
        shards.write_ids(docs([(1, "some words")]), shared_dir(spark, "ids"), end=70_000, width=2)


def digest(rows):
    """What the query should return, from the rows alone."""
    order, out, start = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())), [], 0
    for (i, _), x in zip(order, encoder("word_bpe_49k.json").many([t or "" for _, t in order]), strict=True):
        x += b"\1\0\0\0"
        out.append((i, start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    return sorted(map(repr, out))


def test_the_query_itself_and_missing_files(spark, docs, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 20_000)
    path, write = str(tmp_path), shards.write_ids
    docs(odd_rows).write.parquet(f"{path}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in shards.op3_mph_shards(spark, path).collect()) == digest(odd_rows)

    def spoiled(spoil):
        def run(docs, folder):
            write(docs, folder)
            spoil(folder.removeprefix("file://"))

        monkeypatch.setattr(shards, "write_ids", run)
        return lambda: shards.op3_mph_shards(spark, path).collect()

    def cut(at):
        os.truncate(f"{at}/shard-000001.ids", os.path.getsize(f"{at}/shard-000001.ids") - 8)

    for spoil in (lambda at: os.remove(f"{at}/shard-000001.ids"), lambda at: os.remove(f"{at}/index-000000.mph"), lambda at: os.remove(f"{at}/index.json"), cut):
        with pytest.raises(Exception):  # noqa: B017
            spoiled(spoil)()

    def lost(docs, folder):  # a row that no file holds
        write(docs.where("doc_id <> 9"), folder)

    monkeypatch.setattr(shards, "write_ids", lost)
    with pytest.raises(RuntimeError, match="records of"):
        shards.op3_mph_shards(spark, path)


def test_wide_ids_and_empty(spark, docs):
    folder = shared_dir(spark, "ids")
    records = shards.write_ids(docs([(1, "some words")]), folder, width=4)
    assert shards.read_ids(records, folder).select(F.length("ids")).first()[0] == 4 * records.first()["n_tokens"]
    none = shards.write_ids(docs([]), shared_dir(spark, "ids"))
    assert none.count() == 0
