import duckdb
import pandas as pd
import pytest

from strandline.llm.url_rules import OP2_SQL, OWN, SITES, Rule, judge_urls, site_rule

URLS = [
    None, "", "no scheme", "http://", "http://example.net", "http://EXAMPLE.net/", "https://a.b.example.net/en/x?q=/de/", "http://example.net/EN/", "http://notexample.com/de/x",
    "http://www.example.com/de/x", "http://example.com/de", "http://w.org/fr/1#t", "http://w.org/en/1", "http://org/fr/", "http://net/", "http://a.network/", "ftp://x.net/a://b.org/fr/",
    "http://m.ads-track.example.com/es/1", "http://x.io/ads-/banner/1", "http://x.io/a/popup/?u", "http://x.io/p?/banner/", "HTTP://Ünï.NET/ä\nb", "http://x.net?y/z", "http://x.net#/z", "http://user@x.net/a b", "http://x.net/",
]


def test_against_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[5:8])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = judge_urls(pages, SITES + OWN).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    assert sorted(tuple(r) for r in got) == sorted(con.execute(OP2_SQL).fetchall())


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, host string, rule int, _token string")
    assert judge_urls(empty, SITES).count() == 0
    one = spark.createDataFrame([(1, "http://a.example.net/en/x", "kept", 5, "clash", "clash", "clash"), (1, None, None, None, None, None, None)], "page_id long, url string, other string, rule int, _token string, _best string, _url string")
    got = {r["url"]: r for r in judge_urls(one, SITES).collect()}
    assert (got["http://a.example.net/en/x"]["rule"], got["http://a.example.net/en/x"]["other"], got["http://a.example.net/en/x"]["_token"]) == ("example.net/en/", "kept", "clash")
    assert (got[None]["host"], got[None]["path"], got[None]["rule"], got[None]["verdict"]) == ("", "", None, "allow")
    bare = judge_urls(one, (Rule("any", "", "x$", (), "block"),)).where("url is not null").first()
    assert (bare["verdict"], bare["rule"]) == ("block", None)


def test_rarest_token_decides_what_is_tried():
    assert site_rule("example.net/en/", "allow").tokens == ("example", "net", "en")
    assert site_rule("example.net/en", "allow").tokens == ("example", "net")


def test_ties_go_by_name(spark):
    rules = (Rule("a", "x", "", ("x",), "block", 1), Rule("b", "x", "", ("x",), "allow", 1))
    df = spark.createDataFrame([("http://x/",)], "url string")
    assert judge_urls(df, rules).first()["verdict"] == "allow"
    with pytest.raises(TypeError):
        Rule("a")
