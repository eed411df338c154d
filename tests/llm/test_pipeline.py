import os

import duckdb
import pytest
from invented_prose import prose
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import language, queries
from strandline.llm.tokens import encoder
from test_language import plain as plain_language
from test_lines import plain as plain_lines
from test_near_dup import exact

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    english = [(i, prose(i, 120) + "\nthe end of it all\n" + prose(i + 1, 5), "en") for i in range(60)]
    german = [(100 + i, " ".join("der die und nicht das ist ein auch sich werden".split()[(i * 7 + k * k) % 10] + "ung" * (k % 3) for k in range(90)), "de") for i in range(30)]
    leaked = " ".join(f"quiz{i}" for i in range(20))
    rows = english + german + [
        (200, "changed " + english[3][1], "en"), (201, english[4][1].replace("\n", " more\n", 1), "en"), (202, f"{prose(300, 60)} {leaked} {prose(301, 50)}", "en"),
        (203, None, None), (204, "", None), (205, "1234 5678 !!! ### 99", "en"), (206, "漢字" * 60, None), (None, prose(400, 70), "en"), (207, "the end of it all\nthe end of it all", "en"),
        (208, "x", "en"), (209, "der die und", "de"), (210, "½ ①", None), (211, prose(1, 6), "en"),
    ]
    df = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    took, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        took[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert docs.columns == columns
    start = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet"), F.lit(True))
    first = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    # Short texts are judged as long ones are.
    assert sorted(map(repr, took["language_id"])) == sorted(repr((i, t)) for i, t in first if plain_language(model, t)[2])
    gone = start - {i for i, _ in took["language_id"]}
    assert {203, 204, 205, 206, 208, 210} <= gone <= {203, 204, 205, 206, 208, 209, 210, 211}
    assert sorted(repr((i, t)) for i, t in took["line_dedup"]) == sorted(repr(tuple(x[:2])) for x in map(eval, plain_lines(took["language_id"])))
    stay = [i for i, _, c in exact(took["line_dedup"], 5) if i is None or c == i]
    assert sorted(map(repr, (i for i, _ in took["near_dedup"]))) == sorted(map(repr, stay)) and not {200, 201} & set(stay)
    assert {i for i, _ in took["near_dedup"]} - {i for i, _ in took["decontamination"]} == {202}
    pieces: dict = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    want = {i: x + b"\0" * 4 for (i, _), x in zip(took["decontamination"], encoder("byte_bpe_50k.json").many([t or "" for _, t in took["decontamination"]]), strict=True)}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == want


def test_run_equals_its_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
    ids = lambda df: sorted(map(repr, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    ran = corpus_pipeline.written(corpus_pipeline.run(spark, folder), "ran")
    assert ran.columns == docs.columns and ids(ran) == ids(docs) and ran.count() > 80


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
