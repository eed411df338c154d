import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import imaging, layout
from strandline.plans import recognise, stored
from strandline.store import Store
from test_plans import fill


def test_structured_page(spark):
    schema = "page int, width double, bounds array<double>, bands array<struct<index:int,top:double,bottom:double>>, band_headers array<struct<x0:double,x1:double>>, page_headers array<struct<band:int,x0:double,y0:double,x1:double,y1:double>>"
    rows = [(1, 500.0, [400.0, 300.0, 150.0], [(0, 0.0, 90.0), (1, 90.0, 200.0)], [(410.0, 450.0)], [(None, 460.0, None, 495.0, 200.0)]), (2, 500.0, [1.0, 2.0], [(0, 0.0, 1.0)], [], []), (3, 500.0, [1.0], [(0, 0.0, 1.0)], [], [])]
    got = layout.structured_regions(spark.createDataFrame(rows, schema)).collect()
    assert {r["page"] for r in got} == {1} and len(got) == 3 * (4 + 2 + 1)
    at = {(r["band"], r["entry"], r["context"]): (r["role"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got}
    assert at[1, 1, "tight"] == ("entry", 150.0, 90.0, 300.0, 200.0) and at[0, 0, "full"] == ("entry", 225.0, 0.0, 475.0, 90.0)
    assert at[1, -1, "full"] == ("header", 410.0, 90.0, 450.0, 200.0) and at[0, -101, "full"] == ("header", 460.0, 0.0, 495.0, 200.0)


def test_band_repair(spark):
    wanted, height = [300.0, 600.0], 1000.0
    cases = [([310.0, 590.0], []), ([310.0], []), ([310.0, 450.0, 605.0], []), ([100.0], []), ([], []), ([], [290.0, 480.0, 655.0]), (None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e array<double>, w array<double>")
    got = [(r["r"]["edges"], r["r"]["repaired"]) for r in df.orderBy("i").select("i", layout.repair_bands(F.col("e"), F.col("w"), wanted, height).alias("r")).orderBy("i").collect()]
    assert got == [([310.0, 590.0], False), ([310.0, 600.0], True), ([310.0, 605.0], True), ([100.0], False), ([], False), ([290.0, 655.0], True), ([], False)]


def test_frames(spark):
    rules = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(c).alias("coverage")) for p, c in ((10.0, 0.9), (500.0, 1.0), (990.0, 0.5), (1000.0, 0.9))])
    pair = lambda target, tol: spark.range(1).select(layout.frame_pair(rules, F.lit(target), F.lit(tol)).alias("p")).first()["p"]
    assert [x["position"] for x in pair(985.0, 20.0)] == [10.0, 990.0] or [x["position"] for x in pair(985.0, 20.0)] == [10.0, 1000.0]
    assert pair(100.0, 5.0) is None and [x["position"] for x in pair(490.0, 1.0)] == [10.0, 500.0]
    lone = spark.range(1).select(layout.inferred_pair(F.slice(rules, 1, 1), F.lit(980.0), F.lit(1000.0)).alias("p")).first()["p"]
    assert (lone["near"], lone["far"], lone["inferred"]) == (10.0, 990.0, "far")
    frames = [(True, [], [float(i), 0.0, 100.0, 0.0, 100.0, 50.0, 0.0, 50.0]) for i in range(21)] + [(True, ["top"], [99.0] * 8), (False, [], [1.0] * 8)]
    df = spark.createDataFrame(frames, "ok boolean, inferred array<string>, corners array<double>")
    assert layout.median_frame(df).first()["corners"] == [10.0, 0.0, 100.0, 0.0, 100.0, 50.0, 0.0, 50.0]
    assert layout.median_frame(df.limit(5)).count() == 0


def test_side_borders(spark):
    rule = lambda p, c=1.0, a=0.0, b=0.0: F.struct(F.lit(p).alias("position"), F.lit(c).alias("coverage"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    level = [rule(0.0, 0.9, 10.0, 910.0), rule(400.0, 0.95, 14.0, 914.0), rule(700.0, 0.5, 300.0, 600.0)]
    got = lambda up, flat: tuple(spark.range(1).select(layout.side_borders(F.array(*up), F.array(*flat), F.lit(900.0), F.lit(1000.0), F.lit(800.0)).alias("b")).first()["b"])
    # Two upright rules; else the ends of the level ones at half the height; else a guess, also where the ends are too far apart.
    assert got([rule(20.0), rule(921.0)], level) == (20.0, 921.0, None)
    assert got([rule(40.0)], level) == (pytest.approx(14.0), pytest.approx(914.0), None)
    assert got([rule(40.0)], level[:1] + level[2:]) == (40.0, 940.0, "far")
    assert got([rule(40.0)], [rule(0.0, 0.9, 10.0, 500.0), rule(400.0, 0.9, 10.0, 500.0)]) == (40.0, 940.0, "far")


def test_edited_comb(spark):
    pages = spark.createDataFrame([(i, 1000.0, 300.0, 0.0, 900.0, [], 0.0, None) for i in range(1, 6)], "page int, width double, pitch double, left double, right double, gutters array<double>, fraction double, anchor double")
    moves = spark.createDataFrame([(2, 1, 610.0), (3, 9, 5.0), (4, 0, 2000.0), (5, 1, 950.0)], "page int, index int, x double")
    combs = layout.edited_comb(pages, moves)
    got = {r["page"]: (r["problem"], r["bounds"]) for r in combs.collect()}
    assert got[1] == (None, [900.0, 600.0, 300.0, 0.0]) and got[2] == (None, [900.0, 610.0, 300.0, 0.0])
    assert [got[i][0].split()[-1] for i in (3, 4, 5)] == ["lattice", "page", "order"]
    bands = spark.createDataFrame([(2, 1000.0, [[1.0, 0.0, 5.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [(0, "富", 10.0, 90.0)])], "page int, width double, inverse array<array<double>>, bands array<struct<index:int,label:string,top:double,bottom:double>>")
    first = {r["proposal"]: r for r in layout.proposals(combs, bands).collect()}[0]
    assert (first["x0"], first["x1"], first["label"], tuple(first["quad"][0])) == (610.0, 900.0, "富", (615.0, 10.0))


def test_problems_and_headers(spark):
    told = spark.range(1).select(layout.problems(F.lit(2), F.lit(1.75), F.lit(0)).alias("p")).first()["p"]
    assert told == ["2 crops contain almost no ink", "failures concentrate at page edges (bias 1.75)"]
    regions = spark.createDataFrame([(1, 1, "entry"), (1, 2, "entry")], "page int, entry int, role string")
    marked = layout.mark_headers(regions, spark.createDataFrame([(1, 2), (1, 2)], "page int, entry int"), ["page", "entry"])
    assert sorted((r["entry"], r["role"]) for r in marked.collect()) == [(1, "entry"), (2, "header")]


def test_pixels(spark):
    page = np.full((40, 40, 3), 240, np.uint8)
    page[5:12] = 10
    page[:, 30:] = (60, 160, 220)
    df = spark.createDataFrame([(1, imaging.pack(page), imaging.pack(imaging.variant(page, "neutral")))], f"page int, image {imaging.IMAGE}, shown {imaging.IMAGE}")
    r = df.select(layout.pixel_scores(F.col("image"), F.col("shown")).alias("s")).first()["s"]
    assert (r["paper"], r["watermark_residual"], r["contrast_clean"]) == (240.0, -15.0, 230.0) and r["retention"] is None
    boxes = spark.createDataFrame([(1, 0, 29.9, 0.0, 35.2, 4.0), (1, 1, 90.0, 0.0, 99.0, 4.0)], "page int, entry int, x0 double, y0 double, x1 double, y1 double")
    cut = {x["entry"]: x["crop"] for x in layout.crops(df, boxes).collect()}
    assert (cut[0]["height"], cut[0]["width"]) == (4, 6) and (imaging.unpack(cut[0].asDict()) == page[:4, 29:35]).all()
    assert cut[1]["pixels"] is None


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('stored')}")
    fill(spark, s, "documents", [{"id": "d", "title": "t", "page_count": 2}, {"id": "e", "title": "u", "page_count": 0}])
    fill(spark, s, "pages", [{"document_id": "d", "page_index": p, "ignored": p == 2} for p in (1, 2)])
    fill(spark, s, "bands", [{"id": "b1", "band_index": 1}])
    fill(spark, s, "physical_entries", [{"id": "e1", "band_id": "b1", "entry_index": 0}, {"id": "e2", "band_id": "b1", "entry_index": 1}])
    fill(spark, s, "source_regions", [{"id": f"s{i}", "entry_id": f"e{i}", "document_id": "d", "page_index": 1, "role": "entry", "context": "tight", "crop_id": f"c{i}", "crop_path": f"p{i}"} for i in (1, 2)])
    fill(spark, s, "models", [{"id": "m1", "backend": "a", "version": "1"}, {"id": "m2", "backend": "a", "version": "2"}])
    fill(spark, s, "ocr_runs", [{"id": "r1", "model_id": "m1", "input_variant": "gray", "tag": "x"}, {"id": "r2", "model_id": "m2", "input_variant": "gray", "tag": "x"}, {"id": "r3", "model_id": "m1", "input_variant": "red", "tag": None}])
    said = [(1, "s1", "r1", "old", None), (2, "s1", "r2", "new", None), (3, "s2", "r1", None, '{"error": "bad"}'), (4, "s1", "r3", "other", None)]
    fill(spark, s, "ocr_candidates", [{"id": i, "source_region_id": p, "ocr_run_id": r, "transcription": t, "raw": raw, "region_id": 1} for i, p, r, t, raw in said])
    fill(spark, s, "regions", [{"id": 1, "region_uid": "u1", "document_id": "d", "page_index": 1, "role": "entry", "state": "proposed", "geometry_hash": "g", "reading_order": 3, "reading_order_locked": True}, {"id": 2, "region_uid": "u2", "document_id": "d", "page_index": 2, "role": "entry", "state": "proposed", "geometry_hash": "h"}])
    fill(spark, s, "region_crops", [{"id": 1, "region_id": 1, "geometry_hash": "g", "crop_key": "k1"}, {"id": 2, "region_id": 1, "geometry_hash": "h", "crop_key": "k2"}, {"id": 3, "region_id": 9, "geometry_hash": "z", "crop_key": "k3"}])
    return s


def test_stored_reads(spark, store):
    got = {(r["variant"], r["crop_id"]): (r["text"], r["error"], r["model_version"]) for r in stored.outcomes(store, "d").collect()}
    assert got == {("gray", "c1"): ("new", None, "1"), ("gray", "c2"): (None, "bad", "1"), ("red", "c1"): ("other", None, "1")}
    assert [r["id"] for r in stored.superseded_runs(store).collect()] == ["r1"]
    assert sorted((r["entry"], r["text"]) for r in stored.layout_scan(store, "d").where("text is not null").collect()) == [(0, "new"), (0, "old"), (0, "other")]
    assert [r["region_uid"] for r in stored.targets(store, "d").collect()] == ["u1"]
    rows = {r["document_id"]: (r["reviewable"], r["entries"], r["reviewed"], r["tag"]) for r in stored.manifest(store).collect()}
    assert rows == {"d": (2, 1, 0, None), "e": (0, 0, 0, None)}
    assert [(r["backend"], r["version"]) for r in stored.last_versions(store).collect()] == [("a", "1")]
    stray = stored.stray_crops(store)
    assert sorted(r["id"] for r in stray.collect()) == [2, 3]
    adopted = stored.adopt(store.read("region_crops"), stray, store.read("regions"))
    assert sorted((r["id"], r["region_id"]) for r in adopted.collect()) == [(1, 1), (2, 2), (3, 9)]


def test_stored_writes(spark, store):
    pages = store.read("pages")
    assert stored.set_ignored(pages, "d", 1, True).where("ignored").count() == 2
    with pytest.raises(KeyError, match="page 7"):
        stored.set_ignored(pages, "d", 7, True)
    new = spark.createDataFrame([("u1", 0, "富"), ("u2", 5, None)], "region_uid string, reading_order int, band_label string")
    assert sorted((r["region_uid"], r["reading_order"], r["band_label"]) for r in stored.move_region(store.read("regions"), new).collect()) == [("u1", 3, "富"), ("u2", 5, None)]
    stored.start_run(store, {"id": "run", "document_id": "d", "stage": "layout"})
    assert store.read("processing_runs").first()["status"] == "running" and stored.latest_layout(store, "d").count() == 0
    stored.finish_run(store, "run")
    assert [(r["id"], r["status"]) for r in stored.run_history(store).collect()] == [("run", "completed")]


def test_recognition(spark):
    def engine():
        def read(rows):
            if any(r["path"] == "broken" for r in rows):
                raise OSError("gone")
            return [{"crop_id": r["crop_id"], "text": f"富{r['path']} FUYANG", "confidence": 0.5} for r in rows if r["path"] != "lost"]

        return read

    recognise.register("plain", engine)
    with pytest.raises(KeyError, match="plain"):
        recognise.factory("none")
    rows = [(0, "k0", "c0", "一", b""), (1, "k1", "c1", "lost", b""), (2, "k0", "c2", "一", b""), (3, "k3", "c3", "三", b"")]
    requests = spark.createDataFrame(rows, "position int, crop_key string, crop_id string, path string, content binary")
    held = spark.createDataFrame([], "cache_key string, text string, error string")
    answers, new = recognise.on_demand(requests, held, "plain", "1", {})
    assert [(r["crop_id"], r["text"], r["error"]) for r in answers.collect()] == [("c0", "富一", None), ("c1", None, "no result"), ("c2", "富一", None), ("c3", "富三", None)]
    assert new.count() == 3
    again, more = recognise.on_demand(requests, new, "plain", "1", {})
    assert more.count() == 0 and [r["text"] for r in again.collect()] == ["富一", None, "富一", "富三"]
    assert recognise.on_demand(requests, new, "plain", "1", {}, force=True)[1].count() == 3 and recognise.on_demand(requests, new, "plain", "2", {})[1].count() == 3
    broken = recognise.answer([{"crop_id": "x", "path": "broken"}], engine())
    assert broken == [{"crop_id": "x", "error": "OSError: gone"}]
