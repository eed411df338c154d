"""URL filtering by pattern rules that are indexed by their rarest literal token.

Each rule is a regular expression with the literal tokens (runs of a-z and 0-9) that any URL it fits
must hold. The tokens' numbers of URLs are counted over the whole table; a rule is filed under its
rarest one, a URL's tokens fetch the rules filed under them, and only those expressions are run.
DataFrame functions alone are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, written

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """Fits where both expressions are found; of the rules that fit, the one of highest weight decides, ties by name."""

    name: str
    host: str
    path: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int = -1
    listed: bool = False


def site_rule(name: str, verdict: str) -> Rule:
    """A host and path such as ``example.net/en/``: fits the host and its subdomains where the path starts alike.

    The path's last token counts as literal only if the rule itself ends it; the URL could go on otherwise.
    """
    host, slash, path = name.partition("/")
    tokens = re.findall(TOKEN, host.lower()) + re.findall(TOKEN + "(?=[^a-z0-9])", path.lower())
    escape = lambda x: re.sub(r"([^A-Za-z0-9/])", r"\\\1", x)
    return Rule(name, rf"(?s)^(?:.*\.)?{escape(host.lower())}\z", f"^{escape(slash + path)}", tuple(dict.fromkeys(tokens)), verdict, len(name), True)


#: The rules of the contract, then the method's own for other URLs: places of advertising.
SITES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"), site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))
OWN = (
    Rule("ads host", r"(?:^|\.)ads-", "", ("ads",), "block"),
    Rule("track host", r"-track\.", "", ("track",), "block"),
    Rule("banner path", "", "/banner/", ("banner",), "block"),
    Rule("popup path", "", "/popup/", ("popup",), "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``. Both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://(.*)\z", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with host, path, rule (the listed rule that decided, else null) and verdict appended.

    Distinct URLs are judged once and joined back, so a repeated URL costs one judgement, and rows of
    one URL, however many, are split by Spark's skew join. A rule without a literal token is tried on
    every URL. A null URL, or one without ``://``, has an empty host and path; repeated rows are all
    kept; an empty table gives no rows, no rules the default verdict. Columns of pages that are named
    as the new ones are replaced. Rules are broadcast where Spark finds them small, never by force.
    """
    spark, url = pages.sparkSession, F.col("_url")
    urls = pages.select(F.col(url_col).alias("_url")).where(url.isNotNull()).distinct()
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(url), F.lit(TOKEN), 0))
    if any(not r.tokens for r in rules):
        words = F.array_append(words, "")
    tokens = urls.select("_url", F.explode(words).alias("_token"))

    rows = [F.struct(*[F.lit(x).alias(n) for n, x in (("_name", r.name), ("_host", r.host), ("_path", r.path), ("_verdict", r.verdict), ("_weight", r.weight), ("_listed", r.listed))], F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("_tokens")) for r in rules]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    filed = table.select("_name", F.explode("_tokens").alias("_token"))
    counts = tokens.join(filed.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_urls"))
    rarest = filed.join(counts, "_token", "left").groupBy("_name").agg(F.min_by("_token", F.struct(F.coalesce("_urls", F.lit(0)), "_token")).alias("_token"))
    index = table.drop("_tokens").join(rarest, "_name")

    host, path = host_and_path(url)
    found = tokens.join(index, "_token").where(F.regexp(host, F.col("_host")) & F.regexp(path, F.col("_path")))
    best = found.groupBy("_url").agg(F.max(F.struct("_weight", "_name", "_verdict", "_listed")).alias("_best"))
    # Written, so that the join's sides are shuffles alone, of which Spark can split a common URL's.
    best = written(best, "judged")
    joined = pages.join(best, pages[url_col] == best["_url"], "left")
    host, path = host_and_path(pages[url_col])
    told = best["_best"]
    new = {"host": host, "path": path, "rule": F.when(told["_listed"], told["_name"]), "verdict": F.coalesce(told["_verdict"], F.lit(default))}
    return joined.select(*[pages[c] for c in pages.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, SITES + OWN).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM named
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN starts_with(host, 'ads-') OR contains(host, '.ads-') OR contains(host, '-track.') THEN 'block'
  WHEN contains(path, '/banner/') OR contains(path, '/popup/') THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""
