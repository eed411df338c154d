import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.functions import keys
from strandline.plans import driver, graph, jobs
from strandline.profile import Profile
from strandline.sources import readers, writers
from strandline.store import TABLES, Busy, Store, shared_dir
from strandline.streaming import events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    want = sql.execute(driver.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()) == plain(want.fetchall())


def test_every_query_has_sql(spark, sql):
    assert set(driver.QUERIES) == set(driver.ORACLE_SQL)
    rows = driver.greedy_match(spark, SF).collect()
    assert rows and len({(r["page"], r["proposal"]) for r in rows}) == len({(r["page"], r["region"]) for r in rows}) == len(rows)


def test_edit_scores_of_every_item(spark, tmp_path):
    texts = ["plain letters only", "añadió él la leña más allá", "größer als die Straße", "漢字と仮名", "", "é" * 70 + "trailing words"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["edits"] for r in entry.queries()["edit_scores"](spark, str(tmp_path)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    other = [t[2:62].translate(str.maketrans("aeiouäéñ", "AEIOUÄÉÑ")) + t[62:] for t in texts]
    assert got == {i: distance(t, o) for i, (t, o) in enumerate(zip(texts, other, strict=True))}


def test_every_row_counts(spark, tmp_path):
    """Keys that only some remainder of the ids holds are in the results."""
    events = [(i, i, "click", float(i)) for i in range(1, 13)] + [(20, 1, "click", 0.0)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([("a", k) for k in (1, 3, 4, 6)], "o_orderpriority string, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r["user_id"], r["event_id"], r["value"]) for r in run("upsert_latest")} == {(1, 1, 0.0)} | {(i, i, float(i)) for i in range(2, 13)}
    assert {(r["user_id"], r["event_id"]) for r in run("insert_absent")} == {(1, 20)} | {(i, i) for i in range(2, 13)}
    assert sorted(tuple(r) for r in run("core_run_gaps")) == [("a", 2), ("a", 5)]


def test_medians_of_all_rows(spark, tmp_path):
    rows = [("A", float(i), 2.0 * i, 0.0, 1.0) for i in range(1, 12)]
    spark.createDataFrame(rows, "l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in entry.queries()["median_arrays"](spark, str(tmp_path)).collect()] == [("A", 6.0, 12.0, 0.0, 1.0)]


def test_missing_pages_beyond_two_thousand(spark, tmp_path):
    spark.range(1, 3001).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 3002).where("id not in (5, 2500)").selectExpr("id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r["page"] for r in entry.queries()["missing_pages"](spark, str(tmp_path)).collect()) == [5, 2500]


def test_entry(spark, sql):
    assert entry.entry(spark).count() > 0


def fill(spark, store, table, rows):
    names = [c.split()[0] for c in spark.createDataFrame([], TABLES[table]).columns]
    store.replace(table, spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table]))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    fill(spark, s, "pages", [{"document_id": "d", "page_index": 1, "ignored": False}, {"document_id": "d", "page_index": 3, "ignored": True}])
    region = lambda i, page, band, place, **more: {"region_uid": f"u{i}", "id": i, "document_id": "d", "page_index": page, "band_ordinal": band, "band_label": ["庶", "富", "教"][band], "entry_index": place, "reading_order": place, "role": "entry", "state": "proposed", "geometry_hash": f"g{i}"} | more
    fill(spark, s, "regions", [region(1, 1, 0, 0), region(2, 1, 1, 0), region(3, 1, 1, 1), region(4, 3, 1, 2), region(5, 1, 1, 3, state="rejected"), region(6, 2, 1, 4), region(7, 1, 1, -1, role="header", reading_order=9)])
    fill(spark, s, "ocr_runs", [{"id": "r", "tag": ""}, {"id": "t", "tag": "x"}])
    said = [(1, "r", "庶一\n允三\n子", "k1"), (2, "r", "富二 庶一 長子", "k2"), (2, "t", "FUYANG", "k2"), (2, "t", None, "k2"), (3, "r", "富三\n庶九\n次子", "old"), (4, "r", "富九", None), (6, "r", "富五 庶一 長子", "k6"), (7, "r", "富 字第", None)]
    fill(spark, s, "ocr_candidates", [{"id": i, "region_id": r, "ocr_run_id": run, "transcription": t, "crop_key": k} for i, (r, run, t, k) in enumerate(said)])
    fill(spark, s, "region_crops", [{"id": 1, "crop_key": "k2", "geometry_hash": "g2"}, {"id": 2, "crop_key": "old", "geometry_hash": "was"}])
    fill(spark, s, "human_corrections", [{"document_id": "d", "page_index": 1, "band_label": "富", "entry_index": 1, "role": "entry", "transcription": None, "unreadable": False}])
    fill(spark, s, "validation_findings", [{"id": 1, "document_id": "d", "band_label": "富", "page_index": 1, "entry_index": 0, "kind": "gap", "expected": "七"}])
    return s


def test_best_text_by_entry(spark, store):
    got = {r["region_uid"]: (r["text"], r["source"]) for r in graph.entry_texts(store, Profile(), "d").collect()}
    # A stamp alone and a null never displace a reading; an empty correction does; ignored and rejected entries are out.
    assert got == {"u1": ("庶一\n允三\n子", "machine"), "u2": ("富二 庶一 長子", "machine"), "u3": ("", "human"), "u6": ("富五 庶一 長子", "machine")}
    assert {r["region_uid"] for r in graph.entry_texts(store, Profile(), "d", "x").collect()} == {"u2"}


def test_graph_end_to_end(spark, store, tmp_path):
    texts = graph.entry_texts(store, Profile(), "d")
    g = graph.build(texts, Profile())
    assert {r["person_key"]: r["link_status"] for r in g.linked.collect()} == {"庶:1": "outside_volume", "富:2": "resolved", "富:5": "resolved"}
    assert [(r["kind"], r["entry"]) for r in g.findings.collect()] == [("order_conflict", 4)]
    people, (individuals, families) = graph.export(g, Profile(), f"file://{tmp_path}", "d")
    assert (people, individuals, families) == (3, 3, 1)
    tsv = [r["value"] for r in spark.read.text(f"file://{tmp_path}/people").collect()]
    assert tsv[0] == "# d — reconstructed people" and [x.split("\t")[0] for x in tsv[1:]] == ["person_key", "庶:1", "富:2", "富:5"]
    assert "1 HUSB @I1@" in [r["value"] for r in spark.read.text(f"file://{tmp_path}/people.ged").collect()]
    report, findings = graph.validate(texts, Profile())
    assert {r["band"]: r["observed"] for r in report.collect()} == {"庶": 1, "富": 3}
    assert sorted(r["kind"] for r in findings.collect()) == ["gap", "unparsed"]


def test_recoveries(spark):
    """Labels from the band, fathers' labels from the chain and numerals repaired are counted; mismatches are listed in order."""
    profile = Profile(label_confusions={"尤": "庶"})
    said = [("富二百\n尤五十\n長子", "富二百\n庶五十\n長子"), ("十二\n庶一\n長子", "富十二\n庶一\n長子"), ("富一干 庶一 次子", "富一千 庶一 次子"), ("富九 庶一 長子", "富三 庶一 長子"), (None, "富四 庶一 長子"), ("富五", "富五"), ("富六 庶一 長子", None)]
    rows = [("d", 1, "富", i, i, m, h) for i, (m, h) in enumerate(said)] + [("e", 2, "富", i, i, "富七 庶一 長子", "富八 庶一 長子") for i in range(100)]
    entries = spark.createDataFrame(rows, "document_id string, page int, geometric string, entry int, ordinal int, machine string, human string")
    cards = {r["document_id"]: r for r in graph.learning(entries, profile, ["document_id"]).collect()}
    d = cards["d"]
    assert (d["reviewed"], d["eligible"], d["machine_present"], d["exact_core"]) == (6, 5, 4, 3)
    assert (d["own_label_from_geometry"], d["parent_label_from_structure"], d["numeral_repairs"]) == (1, 1, {"干->千": 1})
    assert [(m["place"]["entry"], m["machine"]["own_id"], m["human"]["own_id"]) for m in d["mismatches"]] == [(3, "富九", "富三"), (4, None, "富四")]
    assert [m["place"]["entry"] for m in cards["e"]["mismatches"]] == list(range(80)) and cards["e"]["eligible"] == 100 and cards["e"]["numeral_repairs"] == {}
    found = graph.recovered(entries.where("document_id = 'd'").withColumn("text", F.col("machine")), profile).collect()
    assert [tuple(r) for r in found] == [(1, "富", 1, None, "富十二")]


def test_review_page(spark, store):
    rows = graph.review_entries(store, "d", 1, Profile(), tag="").collect()
    assert [r["region_uid"] for r in rows] == ["u1", "u7", "u2", "u3"]
    by = {r["region_uid"]: r for r in rows}
    assert (by["u2"]["expected"], by["u2"]["own_id"], by["u2"]["parent"], by["u2"]["stale"]) == ("富七", "富二", "庶一", False)
    assert (by["u3"]["source"], by["u3"]["human"], by["u3"]["stale"], by["u7"]["header_kind"]) == ("human", "", True, "section_title")
    # Of all tags the last reading wins, though it is empty; without a reading nothing is stale.
    last = {r["region_uid"]: r for r in graph.review_entries(store, "d", 1, Profile()).collect()}["u2"]
    assert (last["machine"], last["source"], last["stale"]) == (None, "none", False)


def test_store_versions(spark, store, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.read("models").count() == 0
    fill(spark, s, "pages", [{"document_id": "a", "page_index": 1}, {"document_id": "b", "page_index": 1}])
    before = s.read("pages")
    s.replace_document("pages", before.where("document_id = 'a'").withColumn("page_index", F.lit(7)), "a")
    assert sorted((r["document_id"], r["page_index"]) for r in s.read("pages").collect()) == [("a", 7), ("b", 1)]
    assert len(TABLES) == 21


def test_replacement_that_stops_half_way(spark, store, tmp_path, monkeypatch):
    """Wherever a writer stops, the rows of before are read; the next writer goes on from there."""
    s = Store(spark, f"file://{tmp_path}")
    fill(spark, s, "pages", [{"document_id": "a", "page_index": 1}])
    held = s.read("pages")
    rows = held.withColumn("page_index", F.lit(2))
    look = lambda: [(r["document_id"], r["page_index"]) for r in s.read("pages").collect()]

    def stop(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the version is written, not named
        m.setattr(Store, "_name", stop)
        with pytest.raises(KeyboardInterrupt):
            s.replace("pages", rows)
    assert look() == [("a", 1)]
    with monkeypatch.context() as m:  # another writer was first
        m.setattr(Store, "_pointers", lambda *a: [])
        with pytest.raises(RuntimeError, match="another writer"):
            s.replace("pages", rows)
    assert look() == [("a", 1)]
    for n in range(2, 6):
        s.replace("pages", held.withColumn("page_index", F.lit(n)))
        assert look() == [("a", n)]
    assert [r["page_index"] for r in held.collect()] == [1]  # a reader keeps the version it opened


def test_store_is_marked_and_held(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store.discover(spark, f"file://{tmp_path}/a/b")
    s = Store.create(spark, f"file://{tmp_path}/a")
    assert Store.discover(spark, f"file://{tmp_path}/a/b/c").path.rstrip("/").endswith("/a") and Store.create(spark, s.path).path == s.path
    with s.job("d"), s.job("other"):
        with pytest.raises(Busy), s.job("d"):
            pass
    with pytest.raises(ZeroDivisionError), s.job("d"):
        raise ZeroDivisionError
    with s.job("d"):
        pass
    (tmp_path / "a" / "STORE").write_text("99")
    (tmp_path / "a" / ".STORE.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="99"):
        Store.discover(spark, s.path)


def test_job_of_all_stages(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}")
    told = list(jobs.prepare(s, "d", {"layout": lambda: "3 bands"}, "r"))
    assert [(e["stage"], e["status"]) for e in told] == [(x, y) for x in jobs.STAGES for y in ("started", "completed")]
    assert [e["detail"] for e in told if e["detail"]] == ["3 bands"] and {e["total"] for e in told} == {7}
    assert s.read("processing_runs").first()["status"] == "completed"
    stopped = jobs.prepare(s, "d", {}, "r2")
    next(stopped)
    stopped.close()  # whoever listens goes away: the run has failed, the document is free
    assert {r["id"]: r["status"] for r in s.read("processing_runs").collect()} == {"r": "completed", "r2": "failed"}
    with pytest.raises(KeyError, match="paint"):
        next(jobs.prepare(s, "d", {"paint": lambda: None}, "r3"))


def test_document_ids():
    good = ["a", "丙辰庶富教1", "é", "a.b c", "x" * 200]
    bad = [None, "", " a", "a ", ".a", "a.", "e\u0301", "x" * 201, "漢" * 67, "a/b", "a\\b", "a:b", "a\tb", "nul", "COM1.txt", "Lpt9"]
    assert [keys.id_problem(x) for x in good] == [None] * len(good) and all(keys.id_problem(x) for x in bad)


def test_folder_is_shared(spark):
    from types import SimpleNamespace

    def session(master, folder):
        conf = SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_dir(session("spark://host:7077", "hdfs://x/y/"), "t").startswith("hdfs://x/y/t-")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master, None), "t")
    assert shared_dir(session("local[4]", None), "t").startswith("file:///")


def test_readers(spark, tmp_path):
    (tmp_path / "gold.tsv").write_text("# note\n\n1\t富\t0\t 富一 \n1\t富\t0\t富二\n1\t?\t0\tx\n1\t富\n2\t教\t3\t教五\textra\n")
    rows = readers.read_gold(spark, f"file://{tmp_path}/gold.tsv", {"富": 1, "教": 2})
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 1, 0, "富二"), (2, 2, 3, "教五")]
    assert readers.read_observations(spark, f"file://{tmp_path}/gold.tsv").count() == 4
    assert readers.parse_pages("2,3, 10-12,3") == [2, 3, 10, 11, 12] and readers.parse_pages("") == []
    crops = tmp_path / "crops"
    crops.mkdir()
    for name in ("d_p0002_b1_e03_tight.png", "d_p0001_b0_e00_tight.png", "odd_tight.png", "d_p0001_b0_e00_full.png"):
        (crops / name).write_bytes(b"x")
    assert [(r["page"], r["band"], r["entry"]) for r in readers.discover_crops(spark, f"file://{crops}", "tight").collect()] == [(1, 0, 0), (2, 1, 3)]
    path = f"file://{tmp_path}/profile.json"
    assert readers.load_profile(spark, path, "丙辰庶富教1").bands == readers.load_profile(spark, path, "other").bands == ("庶", "富", "教")


def test_writers(spark, tmp_path):
    cols = ", ".join(f"{c} string" for c in writers.TRANSCRIPTION)
    df = spark.createDataFrame([("1", "富", "0", "human", "a\tb\nc", None, None, None, None), ("1", "富", "1", "machine", "x", None, None, None, None)], cols).withColumn("place", F.col("entry").cast("long")).withColumn("ignored", F.lit(None).cast("boolean"))
    lines, counts = writers.transcription(df)
    assert {r["place"]: r["line"] for r in lines.collect()}[0].split("\t")[4] == "a b c"
    assert {r["source"]: r["entries"] for r in counts.collect()} == {"human": 1, "machine": 1} and writers.verified(df).count() == 1
    with open(tmp_path / "all.zip", "wb") as f:
        writers.bundle({"a.tsv": lines}, {"n": 2}, f)
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert z.read("a.tsv").decode().splitlines() == [r["line"] for r in lines.orderBy("place").collect()] and b'"n": 2' in z.read("summary.json")
    many = spark.range(30_000).select(F.col("id").alias("place"), F.concat(F.lit("row "), F.col("id").cast("string"), F.repeat(F.lit("x"), 90)).alias("line")).repartition(5)
    writers.write_lines(many, f"file://{tmp_path}/many", ["place"])
    files = sorted((tmp_path / "many").glob("part-*"))
    assert [int(x.split("x")[0][4:]) for f in files for x in f.read_text().splitlines()] == list(range(30_000))
    with pytest.raises(ValueError, match="rows at most"):
        writers.markdown(spark.range(writers.ROWS + 1), "t")
    assert writers.ndjson([{"type": "progress"}, {"type": "result"}]).count("\n") == 2
    for bad in ([], [{"type": "progress"}], [{"type": "result"}, {"type": "error"}]):
        with pytest.raises(ValueError, match="one result"):
            writers.ndjson(bad)
    assert "| a |" in writers.markdown(spark.sql("select 1 as a"), "t")


def test_streams(spark, tmp_path):
    text = '{"a": "富"}\n\n{"b": 2}'.encode()
    for cut in range(len(text)):
        assert list(events.decode_ndjson([text[:cut], text[cut:]])) == ['{"a": "富"}', '{"b": 2}']
    rows = [("富", v, i) for i, v in enumerate([1, 2, 4, 4, 5])]
    spark.createDataFrame(rows, "band string, value long, ordinal long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("band string, value long, ordinal long").parquet(f"{tmp_path}/in")
    out = events._drain(events.sequence_stream(stream), "append", "sequence")
    assert sorted((r["value"], r["before"], r["kind"]) for r in out.collect()) == [(4, 2, "gap"), (4, 4, "non_monotonic")]
    share = lambda s, c, t: spark.range(1).select(events.progress_percent(F.lit(s), F.lit(c), F.lit(t)).alias("x")).first()["x"]
    assert [share("queued", 0, 0), share("preparing", 1, 2), share("recognizing", 1, 2), share("recognizing", 9, 9), share("result", 1, 1)] == [0.0, 5.0, 55.0, 99.9, 100.0]


def over(spark, tmp_path, name, **tables):
    """A query and its SQL over tables of this test's own: {name: (rows, schema)}."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(driver.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    return plain(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*names).collect()), plain(want.fetchall())


def test_ids_beyond_one_numeral(spark, tmp_path):
    keys = [0, 1, 9_999, 10_000, 10_001, 10_002, 10_003, 10_004, 17_999, 18_000, 18_001, 26_999, 27_000, 60_005, 60_010, 1_234_567]
    got, want = over(spark, tmp_path, "entry_ids", supplier=([(k,) for k in keys], "s_suppkey long"))
    assert got == want


def test_ids_recovered_beyond_one_numeral(spark, tmp_path):
    got, want = over(spark, tmp_path, "validated_ids", supplier=([(k,) for k in range(9_950, 10_050)], "s_suppkey long"))
    assert got == want


def test_orders_beyond_one_numeral(spark, tmp_path):
    bands = ("1-URGENT", "2-HIGH", "5-LOW")
    orders = [(k, 9_990 + k // 10 % 20, bands[k % 3]) for k in range(1, 400)] + [(k * 89 * 97, 20_000 + k, "2-HIGH") for k in range(1, 4)]
    for name in ("sequence_findings", "sequence_report"):
        got, want = over(spark, tmp_path / name, name, orders=(orders, "o_orderkey long, o_custkey long, o_orderpriority string"))
        assert got == want, name
