import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import fields, keys, numerals, text
from strandline.functions.fields import drop_watermark
from strandline.functions.watermarks import GLYPHS, MARKS, filter_watermark
from strandline.profile import Profile


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("shown", "value"),
    [
        ("千百九十三", 1193), ("廿五", 25), ("三廿", None), ("卌", 40), ("〇", 0), ("", None), ("不", None), ("五", 5), ("六百十", 610), ("五百八十七", 587),
        ("一二", 2), ("貳佰", 200), ("十九", 19), ("二百零五", 205), (None, None),
    ],
)
def test_parse_numeral(spark, shown, value):
    assert one(spark, numerals.parse_numeral(F.col("t")), t=shown) == value


def test_numeral_roundtrip(spark):
    df = spark.range(0, 10000).select("id", numerals.format_numeral(F.col("id")).alias("n"))
    assert df.where(~numerals.parse_numeral(F.col("n")).eqNullSafe(F.col("id"))).count() == 0
    got = {r["id"]: r["n"] for r in df.where("id in (0, 1, 10, 19, 110, 1193, 2000, 5005)").collect()}
    assert got == {0: "〇", 1: "一", 10: "十", 19: "十九", 110: "百十", 1193: "千百九十三", 2000: "二千", 5005: "五千五"}
    assert spark.range(10000, 10001).select(numerals.format_numeral(F.col("id"))).first()[0] is None


def test_entry_ids(spark):
    got = lambda t: tuple(one(spark, numerals.parse_entry_id(F.col("t")), t=t))
    assert got(" 庶五百八十七\n") == ("庶五百八十七", "庶", 587, True, "")
    assert got("五") == ("五", None, 5, True, "")
    assert got("") == ("", None, None, False, "unrecognised id format")
    assert got("庶 x") == ("庶 x", "庶", None, False, "numeral not parseable")
    assert got(None)[3] is False
    assert one(spark, numerals.own_id_from_digits(F.lit("庶"), F.col("t")), t=" 343 ") == "庶三百四十三"
    assert one(spark, numerals.own_id_from_digits(F.lit("庶"), F.col("t")), t="三") is None


@pytest.mark.parametrize(
    ("shown", "left", "gone"),
    [
        (None, None, []), ("  ", None, []), ("富陽", "富陽", []), ("富阳图书馆", None, ["富阳图书馆"]), ("庶五 FUYANG", "庶五", ["FUYANG"]),
        ("F 阳 FUYANG", None, ["FUYANG", "F", "阳"]), ("G LIBRARY\n富三", "富三", ["LIBRARY", "G"]), ("Library", "Library", []), ("ABC 子", "ABC 子", []),
        ("图书馆图书馆", None, ["图书馆", "图书馆"]), ("教一 , EIBRAR ,", "教一", ["EIBRAR"]), ("庶二\n  \n長子 IBRARY.", "庶二\n長子", ["IBRARY"]),
    ],
)
def test_watermark(spark, shown, left, gone):
    got = one(spark, filter_watermark(F.col("t")), t=shown)
    assert (got["text"], got["removed"]) == (left, gone)
    clean, removed = fields.drop_watermark(shown or "")
    assert (clean or None, removed) == (left, gone)


RULES = fields.Rules(Profile())


def parsed(shown, own=None, trust=False, rules=RULES):
    p = fields.parse(rules, shown, own, trust)
    return p["own_id"], p["parent_id"], p["parent_name"], p["order"], p["leftover"]


@pytest.mark.parametrize(
    ("shown", "own", "trust", "result"),
    [
        ("富二百九十五\n庶六十\n長子", "富", False, ("富二百九十五", "庶六十", None, "長子", "")),
        ("富二百九十五四子", "富", False, ("富二百九十五", None, None, "四子", "")),
        ("富三 庶一 子時生", "富", False, ("富三", "庶一", None, None, "子時生")),
        ("庶\n千二百", "庶", False, ("庶千二百", None, None, None, "")),
        ("庚二百十\n允五\n長子", "庶", True, ("庶二百十", "允五", None, "長子", "")),
        ("庚二百十\n允五\n長子", "庶", False, (None, "允五", None, "長子", "庚二百十")),
        ("庶\n允六\n二\n長子", "庶", False, ("庶二", "允六", None, "長子", "")),
        ("富二十 純一 三子", "富", False, ("富二十", None, None, "三子", "純一")),
        ("富二十 純武 三子", "富", False, ("富二十", None, "純武", "三子", "")),
        ("敎五\n富三\n女", "教", False, ("教五", "富三", None, "女", "")),
        ("富干二百\n庶三", "富", False, ("富千二百", "庶三", None, None, "")),
        ("富十\n庶\n三\n十\n次子", "富", True, ("富十", "庶三十", None, "次子", "")),
        ("庶五 允三 繼子", None, False, ("庶五", "允三", None, "繼子", "")),
        ("允三 庶五", None, False, ("庶五", "允三", None, None, "")),
        ("", "富", True, (None, None, None, None, "")),
        (None, None, False, (None, None, None, None, "")),
    ],
)
def test_parse_entry(shown, own, trust, result):
    assert parsed(shown, own, trust) == result


def test_parse_entry_records_what_it_did(spark):
    p = fields.parse(RULES, "庚二百十\n允五", "庶", True)
    assert p["label_from_geometry"] and p["observed_label"] == "庚"
    p = fields.parse(RULES, "敎干三 FUYANG", "教", False)
    assert (p["label_variant"], p["numeral_repairs"], p["watermark_noise"], p["text"]) == ({"敎": "教"}, {"干": "千"}, ["FUYANG"], "敎干三 FUYANG")
    rules = fields.Rules(Profile(label_confusions={"尤": "允"}))
    p = fields.parse(rules, "庶二百\n尤五十\n長子", "庶", True)
    assert (p["parent_id"], p["parent_label_from_structure"], p["observed_parent_label"]) == ("允五十", True, "尤")
    df = spark.createDataFrame([("富十 庶二 長子", "富"), (None, None)], "t string, o string")
    got = df.select(fields.parse_entry(F.col("t"), F.col("o"), Profile()).alias("p")).select("p.*").collect()
    assert (got[0]["own_id"], got[0]["parent_id"], got[0]["order"], got[1]["own_id"], got[1]["leftover"]) == ("富十", "庶二", "長子", None, "")
    fields.register(spark, Profile())
    assert spark.sql("select parse_entry('富十 庶二', '富').own_id as x").first()["x"] == "富十"


def test_resolve_entry(spark):
    df = spark.createDataFrame([("教五\n富三\n長子", "富"), ("庚二百十\n允五", "庶"), ("x", "教")], "t string, g string")
    got = [(r["r"]["label"], r["r"]["parsed"]["own_id"]) for r in df.select(fields.resolve_entry(F.col("t"), F.col("g"), Profile(), ("庶", "富", "教")).alias("r")).collect()]
    assert got == [("教", "教五"), ("庶", "庶二百十"), ("教", None)]


def test_small_functions(spark):
    assert one(spark, text.compose_entry(F.lit("富一"), F.lit(None), F.lit("長子"), F.col("t")), t=" 生 ") == "富一長子\n生"
    assert one(spark, text.compose_entry(F.lit(None), F.lit(None), F.lit(None), F.col("t")), t="x") == "x"
    ranks = {"子": 1, "女": 1, "長子": 1, "元子": 1, "次女": 2, "幼子": -1, "繼子": None, "三子": 3, "〇子": None, "": None, None: None}
    assert {k: one(spark, text.order_rank(F.col("t")), t=k) for k in ranks} == ranks
    assert one(spark, text.one_line(F.col("t")), t="　a \n b\t") == "a b" and one(spark, text.one_line(F.col("t")), t=None) == ""
    assert one(spark, text.flat(F.col("t")), t="a\tb  c\n") == "a b  c"
    shown = F.array(F.struct(F.lit("duplicate").alias("kind"), F.lit("x").alias("expected")), F.struct(F.lit("gap").alias("kind"), F.lit("三").alias("expected")))
    assert one(spark, text.expected_id(shown, F.col("t")), t="富") == "富三"
    source = lambda u, c, h, m: one(spark, text.source_of(F.lit(u), F.lit(c), F.lit(h), F.col("t")), t=m)
    assert [source(True, True, "", "m"), source(False, True, "", "m"), source(None, False, None, "m"), source(None, False, None, "")] == ["unreadable", "human", "machine", "none"]
    assert one(spark, text.human_text(F.lit(True), F.lit(False), F.col("t")), t=None) == ""


def test_keys(spark):
    cents = {1.0: "1.00", 2.5: "2.50", 0.125: "0.12", 12.345678: "12.35", -1.5: "-1.50", 0.0: "0.00"}
    assert {k: one(spark, keys.centi(F.col("x")), x=k) for k in cents} == cents
    assert keys.model_key("b", "1", {"a": 1, "c": 2}) == keys.model_key("b", "1", {"c": 2, "a": 1})
    assert one(spark, keys.crop_position(F.col("t")), t="doc_p0012_b1_e03_tight") == (12, 1, 3)
    assert one(spark, keys.crop_position(F.col("t")), t="doc_p12_b1") is None
    assert one(spark, keys.person_key(F.lit("富"), F.col("n")), n=3) == "富:3" and one(spark, keys.named_key(F.lit("富"), F.col("t")), t="某") == "富#某"


def test_profile():
    p = Profile.from_title("丙辰庶富教1")
    assert (p.bands, p.chain, p.bands_per_page, p.parent("富"), p.parent("允"), p.parent("x")) == (("庶", "富", "教"), ("允", "庶", "富", "教"), 3, "庶", None, None)
    assert Profile.from_title("丙辰清廉麗熙2").chain == ("清", "廉", "麗", "熙")
    assert Profile.from_dict({"document_id": "x", "band_labels": ["富"], "generation_chain": ["庶", "富"], "unknown": 1}).chain == ("庶", "富")
    assert Profile(numeral_confusions={"大": "六", "ab": "三", "x": "y"}).repairs == {"干": "千", "大": "六"}


def test_both_forms_of_the_watermark_rules(spark):
    """The parser's and the columns' rules say the same of any mixture of stamp, capitals, marks, spaces and text."""
    r = random.Random(17)
    parts = [*MARKS, *GLYPHS, "FUYANG", "XFUYANGA", "FUYAB", "LIBRARY", "LIBRAR", "LIBR", "BRARY", "RARY", "EIBRAR", "A", "AB", "ABC", "ABCD", "a", "一", "子", " ", "  ", "\t", "\n", "\r\n", "　", ",", "。", "·", "|", "-", "名"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", filter_watermark(F.col("t")).alias("w"))
    for row in df.select("i", "w.*").collect():
        clean, gone = drop_watermark(texts[row["i"]])
        assert (row["text"] or "", row["removed"]) == (clean, gone), texts[row["i"]]
