"""Numbered entries in reading order: what is unread, out of band, repeated, missing or backwards.

Findings are recorded, never repaired. Runs are as long as a book, so a row's predecessor is found
within its page, else among the last values of the stretch of pages it is in, else among those of
stretches: no task holds a whole band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerals import ascii_numeral, entry_id_parts, format_numeral, id_reason, value_of_ascii
from ..profile import FALLBACK_LABELS

KINDS = ("unparsed", "band_mismatch", "duplicate", "non_monotonic", "gap")
#: The kinds that a rerun replaces.
CLEARED = KINDS
#: Pages, or numbers, that a window holds at most; of a band longer than that, one row for each so many.
STRETCH = 4096
COLUMNS = ("band", "kind", "page", "entry", "ordinal", "observed", "expected", "detail")


def observations(df: DataFrame, band: Column, page: Column, entry: Column, text: Column, ordinal: Column) -> DataFrame:
    return df.select(band.alias("band"), page.alias("page"), entry.alias("entry"), text.alias("text"), ordinal.alias("ordinal"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once a row: unlike a projection, a generator isn't written into each place that uses it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_ids(obs: DataFrame, labels: tuple[str, ...] = FALLBACK_LABELS) -> DataFrame:
    """Observations with the label read (shown), the value, and the reason where there is none."""
    _, band, numeral = entry_id_parts(F.col("text"), labels)
    rows = once(obs, shown=band, _numeral=numeral)
    rows = once(rows, _ascii=ascii_numeral(F.col("_numeral")))
    rows = once(rows, value=value_of_ascii(F.col("_numeral"), F.col("_ascii")))
    return rows.withColumn("reason", id_reason(F.col("_numeral"), F.col("value"))).drop("_numeral", "_ascii")


def carried(ends: DataFrame) -> DataFrame:
    """(band, page, carried): the ``end`` of the page before in the band, by stretches of pages."""
    cut = ends.withColumn("_s", F.floor(F.col("page") / STRETCH))
    last = cut.groupBy("band", "_s").agg(F.max_by("end", "page").alias("_last"))
    over = last.select("band", "_s", F.lag("_last").over(Window.partitionBy("band").orderBy("_s")).alias("_over"))
    within = cut.withColumn("_in", F.lag(F.struct("end")).over(Window.partitionBy("band", "_s").orderBy("page")))
    return within.join(over, ["band", "_s"]).select("band", "page", F.when(F.col("_in").isNull(), F.col("_over")).otherwise(F.col("_in.end")).alias("carried"))


def steps(read: DataFrame) -> DataFrame:
    """Read rows with ``value`` and that of the row before in the band (``before``), rows ordered by page, entry, ordinal. Pages are numbers."""
    place = F.struct("entry", "ordinal")
    in_page = Window.partitionBy("band", "page").orderBy("entry", "ordinal")
    pages = carried(read.groupBy("band", "page").agg(F.max_by("value", place).alias("end")))
    inner = read.withColumn("_inner", F.lag("value").over(in_page)).withColumn("_at", F.row_number().over(in_page))
    joined = inner.join(pages, ["band", "page"])
    return joined.withColumn("before", F.when(F.col("_at") == 1, F.col("carried")).otherwise(F.col("_inner"))).drop("_inner", "_at", "carried")


def findings(obs: DataFrame, labels: tuple[str, ...] = FALLBACK_LABELS) -> DataFrame:
    """One row per finding: ``COLUMNS``. A row may give several; its first in a band has no step.

    ``duplicate`` names the latest earlier row of the value. An unread row is left out of the run, one
    of another band's label stays in it.
    """
    rows = with_ids(obs, labels)
    read = rows.where("value is not null")
    again = Window.partitionBy("band", "value").orderBy("page", "entry", "ordinal")
    seen = steps(read.withColumn("seen", F.lag(F.struct("page", "entry")).over(again)))
    step = F.col("value") - F.col("before")
    say = lambda kind, expected, detail: F.struct(F.lit(kind).alias("kind"), expected.cast("string").alias("expected"), detail.alias("detail"))
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    none, due = F.lit(None), format_numeral(F.col("before") + 1)
    told = F.array_compact(F.array(
        F.when(F.col("shown") != F.col("band"), say("band_mismatch", F.col("band"), text("id carries band ", F.col("shown")))),
        F.when(F.col("seen").isNotNull(), say("duplicate", none, text("also read on page ", F.col("seen.page"), " entry ", F.col("seen.entry")))),
        F.when(step <= 0, say("non_monotonic", due, text(F.col("before"), " -> ", F.col("value")))),
        F.when(step > 1, say("gap", due, text(step - 1, " value(s) missing between ", F.col("before"), " and ", F.col("value")))),
    ))
    of_read = seen.select("band", "page", "entry", "ordinal", F.col("text").alias("observed"), F.explode(told).alias("f"))
    unread = rows.where("value is null").select("band", "page", "entry", "ordinal", F.col("text").alias("observed"), say("unparsed", none, F.col("reason")).alias("f"))
    return of_read.unionByName(unread).select("band", "f.kind", "page", "entry", "ordinal", "observed", "f.expected", "f.detail")


def rate(part: Column, whole: Column) -> Column:
    """A share; 0 of nothing is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def report(obs: DataFrame, labels: tuple[str, ...] = FALLBACK_LABELS) -> DataFrame:
    """Per band: observed, parsed, first_value, last_value, gaps, breaks, parse_rate, clean_run_rate."""
    rows = with_ids(obs, labels)
    seen = rows.groupBy("band").agg(F.count("*").alias("observed"))
    read = steps(rows.where("value is not null").select("band", "page", "entry", "ordinal", "value"))
    step, place = F.col("value") - F.col("before"), F.struct("page", "entry", "ordinal")
    runs = read.groupBy("band").agg(
        F.count("*").alias("parsed"), F.min_by("value", place).alias("first_value"), F.max_by("value", place).alias("last_value"),
        F.count_if(step > 1).alias("gaps"), F.count_if(step <= 0).alias("backwards"),
    )
    out = seen.join(runs, "band", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    turns = F.greatest(zero("parsed") - 1, F.lit(0))
    return out.select(
        "band", "observed", zero("parsed").alias("parsed"), "first_value", "last_value", zero("gaps").alias("gaps"), zero("backwards").alias("backwards"),
        rate(zero("parsed"), F.col("observed")).alias("parse_rate"), rate(turns - zero("gaps") - zero("backwards"), turns).alias("clean_run_rate"),
    )


def totals(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Rates over all bands, weighted by entries and by transitions; nothing to weigh counts as one."""
    parsed, turns = F.sum("parsed"), F.sum(F.greatest(F.col("parsed") - 1, F.lit(0)))
    one = lambda x: F.greatest(x, F.lit(1))
    return bands.groupBy(*keys).agg(
        F.sum("observed").alias("observed"), parsed.alias("parsed"),
        (F.sum(F.col("parse_rate") * F.col("observed")) / one(F.sum("observed"))).alias("parse_rate"),
        (F.sum(F.col("clean_run_rate") * F.greatest(F.col("parsed") - 1, F.lit(0))) / one(turns)).alias("clean_run_rate"),
    )


def core_run(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the run of whole numbers without strays.

    Fewer than eight distinct values are all kept; else those between the 1st (a rank lower) and the
    99th per cent by rank, widened on both sides by half their distance, at least 1. Ranks are cut,
    not rounded. Values are counted by stretches of numbers, and ranked within the stretch that holds
    the rank alone. Null values are left out; null keys are a run.
    """
    distinct = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("_"))
    distinct = distinct.withColumn("_s", F.floor(F.col(value) / STRETCH))
    of_key = Window.partitionBy(*keys)
    per = distinct.groupBy(*keys, "_s").agg(F.count("*").alias("_c"))
    per = per.withColumn("_upto", F.sum("_c").over(of_key.orderBy("_s"))).withColumn("_n", F.sum("_c").over(of_key))
    low = F.greatest(F.floor(F.col("_n") * 0.01) - 1, F.lit(0))
    high = F.least(F.floor(F.col("_n") * 0.99), F.col("_n") - 1)
    per = per.select(*keys, "_s", "_n", *[(r - F.col("_upto") + F.col("_c")).alias(c) for c, r in (("_rl", low), ("_rh", high))], "_c")
    held = per.where(((F.col("_rl") >= 0) & (F.col("_rl") < F.col("_c"))) | ((F.col("_rh") >= 0) & (F.col("_rh") < F.col("_c"))))
    ranked = _beside(distinct, held, [*keys, "_s"]).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(value)) - 1)
    bounds = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == F.col("_rl"), F.col(value))).alias("_lo"), F.max(F.when(F.col("_r") == F.col("_rh"), F.col(value))).alias("_hi"), F.max("_n").alias("_n"))
    pad = F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo")) / 2))
    kept = _beside(distinct, bounds, keys).where((F.col("_n") < 8) | F.col(value).between(F.col("_lo") - pad, F.col("_hi") + pad))
    return kept.select(*keys, value)


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` with the columns of ``other`` that share their keys, null keys alike."""
    right, same = other.select(*[F.col(c).alias(f"_{c}_of") if c in keys else F.col(c) for c in other.columns]), F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_of"))
    return df.join(right, same).drop(*[f"_{k}_of" for k in keys])


def missing_in_run(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): numbers within the core run that nobody carries. A span is dealt by stretches before it is written out."""
    core = core_run(values, keys, value)
    span = core.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    cut = span.select("*", F.explode(F.sequence(F.floor(F.col("_a") / STRETCH), F.floor(F.col("_b") / STRETCH))).alias("_s")).repartition(*keys, "_s")
    first, last = F.greatest(F.col("_a"), F.col("_s") * STRETCH), F.least(F.col("_b"), F.col("_s") * STRETCH + STRETCH - 1)
    every = cut.select(*keys, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_v"))
    every = every.select(*keys, F.col("_v").cast(core.schema[value].dataType).alias(value))
    gone = every.withColumn("_mark", F.lit(0)).unionByName(core.withColumn("_mark", F.lit(1))).groupBy(*keys, value).agg(F.max("_mark").alias("_mark"))
    return gone.where("_mark = 0").drop("_mark")


def missing_pages(pages: DataFrame, page: str, expected: int) -> DataFrame:
    """Pages 2 to expected + 1 that hold nothing."""
    return pages.sparkSession.range(2, expected + 2).select(F.col("id").cast("int").alias(page)).join(pages.select(page), page, "left_anti")
