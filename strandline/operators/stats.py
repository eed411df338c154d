"""Robust statistics of a corpus, exact, and numbering without one task for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place, from 1, in a total order.

    Rows are dealt into ranges, as many as their size asks for, and written; the ranges' sizes, a row
    each, are summed up, and rows are numbered within their range. Equal ordering keys come to one
    range; the order should tell all apart.
    """
    # Bounds are sampled anew whenever ranges are dealt, so what was dealt is written down once.
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    dealt = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return dealt.join(before, "_range").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_at", "_before")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, q): exact linearly interpolated quantiles, as an array; nulls are left out, keys without values too.

    A sketch of bounded size brackets each quantile; then values below a bracket are counted and those
    within are ranked, some thousandths of the rows. Small groups need no bracket. Neither a task nor a
    buffer holds all values of a group.
    """
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(key))]
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    off = 4 / accuracy
    probes = [x for p in at for x in (max(p - off, 0.0), min(p + off, 1.0))]
    sketch = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.percentile_approx("_v", probes, accuracy).alias("_p"))
    small = F.col("_n") <= 4 * accuracy
    bound = lambda i: F.when(~small, F.get("_p", i))
    brackets = F.array(*[F.struct(F.lit(p).alias("p"), bound(2 * i).alias("low"), bound(2 * i + 1).alias("high")) for i, p in enumerate(at)])
    sketch = sketch.select(*[F.col(n).alias(f"{n}s") for n in names], "_n", brackets.alias("_b"))
    same = F.lit(True)
    for n in names:
        same = same & rows[n].eqNullSafe(sketch[f"{n}s"])
    each = rows.join(sketch, same).select(*names, "_n", "_v", F.posexplode("_b").alias("_i", "_x")).where(F.col("_x.high").isNull() | (F.col("_v") <= F.col("_x.high")))
    held = each.withColumn("_v", F.when(F.col("_x.low").isNull() | (F.col("_v") >= F.col("_x.low")), F.col("_v")))
    counts = held.groupBy(*names, "_i", "_v").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_x.p").alias("_p"))
    w = Window.partitionBy(*names, "_i").orderBy(F.asc_nulls_first("_v"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(w))
    place = F.col("_p") * (F.col("_n") - 1)
    pick = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    found = ranked.groupBy(*names, "_i").agg(pick(F.floor(place)).alias("_lo"), pick(F.ceil(place)).alias("_hi"), F.first(place).alias("_at"))
    mixed = F.when(F.floor("_at") == F.ceil("_at"), F.col("_lo")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi"))
    out = found.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", mixed.alias("q")))), lambda x: x["q"]).alias("q"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "q")


def mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median, mad): the median and the median distance from it; nulls are left out, a key of nulls alone has none."""
    centre = quantiles(df, keys, value, [0.5]).select(*keys, F.get("q", 0).alias("median"))
    # The centres are a row per key: they are written, so that the values are read once more, not the sketches made anew.
    centre = written(centre, "centres")
    off = df.join(centre, list(keys)).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_off"))
    return centre.join(quantiles(off, keys, "_off", [0.5]).select(*keys, F.get("q", 0).alias("mad")), list(keys))


def percentiles(value: Column, *at: float) -> Column:
    """Linearly interpolated percentiles, as an array, of groups whose values fit into a buffer; see ``quantiles`` for others."""
    return F.percentile(value, F.array(*[F.lit(x) for x in at]))


def index_percentile(df: DataFrame, keys: Sequence[str], value: str, at: float, clamp: bool = True) -> DataFrame:
    """(keys, value): the value at rank floor(n * at), from 0, of the sorted values; clamped to the last, or null beyond it.

    Equal values are counted before they are ranked, so a window holds distinct values alone.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    rank = F.floor(F.col("_n") * at)
    rank = F.least(rank, F.col("_n") - 1) if clamp else rank
    return ranked.where(F.col("_upto") > rank).groupBy(*keys).agg(F.min(value).alias(value))


def smallest_mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): the most frequent value, the smallest of several."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(value, "_c"), F.struct(-F.col("_c"), F.col(value))).alias("r"))
    return best.select(*keys, F.col(f"r.{value}").alias(value), F.col("r._c").alias("n" if value != "n" else "count"))


def histogram(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, n, first): how often each occurs and where it did first; most frequent first, ties as first seen."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def median_array(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Element by element the medians of aligned arrays."""
    each = df.select(*keys, F.posexplode(values).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.median("_v").alias("_m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias(values))


def finite_mean(value: Column) -> Column:
    """The mean of finite values; null without any."""
    return F.avg(F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean by weight; weights that add up to nothing count as one."""
    total = F.sum(weight)
    return F.sum(value * weight) / F.when(total == 0, 1).otherwise(total)


def edge_bias(failures: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """(keys, bias): how much oftener outer positions fail than inner ones.

    ``failures`` has a row per failure; positions without one aren't known. Fewer than three positions
    give 1; failures at the edges alone infinity.
    """
    counts = failures.groupBy(*keys, position).agg(F.count("*").alias("_n"))
    out = counts.groupBy(*keys).agg(
        F.count("*").alias("_p"), F.min_by("_n", position).alias("_a"), F.max_by("_n", position).alias("_b"), F.sum("_n").alias("_all"),
    )
    edge = F.col("_a") + F.col("_b")
    inner = F.col("_all") - edge
    bias = F.when(F.col("_p") < 3, 1.0).when(inner == 0, F.lit(float("inf"))).otherwise((edge / 2) / (inner / F.greatest(F.col("_p") - 2, F.lit(1))))
    return out.select(*keys, bias.alias("bias"))


def odd_ones(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value isn't the commonest."""
    mode = smallest_mode(df, [], value).select(F.col(value).alias("_mode"))
    return df.join(F.broadcast(mode), df[value] != F.col("_mode")).drop("_mode")


def template(pages: DataFrame) -> DataFrame:
    """One row of a corpus: modal number of bands, median edges and extents of pages that have it, pitch and its spread.

    ``pages``: page, bands (array of struct(top, bottom)), column_pitch, pitch_confidence, text_left,
    text_right. Pitches of low confidence don't count.
    """
    sized = pages.withColumn("n", F.size("bands"))
    mode = smallest_mode(sized, [], "n").select(F.col("n").alias("bands_per_page"))
    usual = sized.join(F.broadcast(mode), sized["n"] == F.col("bands_per_page"))
    edges = median_array(usual.withColumn("tops", F.transform("bands", lambda b: b["top"])), ["bands_per_page"], "tops")
    ends = median_array(usual.withColumn("bottoms", F.transform("bands", lambda b: b["bottom"])), ["bands_per_page"], "bottoms")
    sure = usual.withColumn("pitch", F.when(F.col("pitch_confidence") > 0.15, F.col("column_pitch")))
    extents = sure.groupBy("bands_per_page").agg(F.median("text_left").alias("text_left"), F.median("text_right").alias("text_right"), F.count("*").alias("pages"))
    return edges.join(ends, "bands_per_page").join(extents, "bands_per_page").join(mad(sure, ["bands_per_page"], "pitch").withColumnsRenamed({"median": "pitch", "mad": "pitch_mad"}), "bands_per_page")
