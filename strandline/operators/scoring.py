"""How well recognisers read: edit rates, fields, rare characters, agreement, and what reviewers found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import rate

FIELDS = ("own_id", "parent_id", "parent_name", "order")


def edit_mix(reference: str, hypothesis: str) -> tuple[int, int, int, int]:
    """(substitutions, insertions, deletions, matches) of an alignment of least cost; of equal steps the diagonal goes first, then insertion."""
    ref, hyp = list(reference), list(hypothesis)
    n = len(hyp)
    width = np.arange(n + 1)
    cost = np.zeros((len(ref) + 1, n + 1), np.int32)
    cost[0], cost[:, 0] = width, np.arange(len(ref) + 1)
    codes = np.array([ord(c) for c in hyp], np.int64)
    for i, c in enumerate(ref, 1):
        near = np.minimum(cost[i - 1, :-1] + (codes != ord(c)), cost[i - 1, 1:] + 1)
        # An insertion chain is a running minimum once positions are subtracted.
        cost[i, 1:] = np.minimum.accumulate(np.concatenate([[i], near - width[1:]]))[1:] + width[1:]
    subs = ins = dels = same = 0
    i, j = len(ref), n
    while i or j:
        equal = i and j and ref[i - 1] == hyp[j - 1]
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (not equal):
            same, subs = same + bool(equal), subs + (not equal)
            i, j = i - 1, j - 1
        elif j and cost[i, j] == cost[i, j - 1] + 1:
            ins, j = ins + 1, j - 1
        else:
            dels, i = dels + 1, i - 1
    return subs, ins, dels, same


def edits(reference: Column, hypothesis: Column) -> Column:
    """struct(substitutions, insertions, deletions, matches); a null hypothesis deletes all, a null reference is empty.

    Their total is ``levenshtein``, which is native; the mix needs the alignment itself.
    """

    @F.pandas_udf("substitutions int, insertions int, deletions int, matches int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for refs, hyps in batches:
            yield pd.DataFrame([edit_mix(r or "", h or "") for r, h in zip(refs, hyps, strict=True)], columns=["substitutions", "insertions", "deletions", "matches"])

    return run(reference, hypothesis)


def rare_characters(texts: DataFrame, text: str, at_most: int = 2) -> DataFrame:
    """(ch, n): characters that occur at most so often in all texts."""
    each = texts.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''")
    return each.groupBy("ch").agg(F.count("*").alias("n")).where(F.col("n") <= at_most)


def rare_recall(pairs: DataFrame, rare: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, rare_total, rare_hits): rare characters of a reference, and those found in its hypothesis, each once."""
    counted = lambda c, n: pairs.select(key, F.explode(F.split(F.coalesce(c, F.lit("")), "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias(n))
    own = counted(reference, "_r").join(rare.select("ch"), "ch")
    both = own.join(counted(hypothesis, "_h"), [key, "ch"], "left")
    return both.groupBy(key).agg(F.sum("_r").alias("rare_total"), F.sum(F.least("_r", F.coalesce("_h", F.lit(0)))).alias("rare_hits"))


def scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: samples, produced, cer and its parts, exact and unknown rates, field accuracies, median latency.

    ``pairs`` has reference, hypothesis, error, latency_ms, ``e`` (see ``edits``), and for each field
    gold_ and read_ columns. An unread crop deletes its whole reference; a field counts where gold has it.
    """
    read = F.col("hypothesis").isNotNull() & F.col("error").isNull()
    length = F.length(F.coalesce("reference", F.lit("")))
    part = lambda name, other: F.sum(F.when(read, F.col(f"e.{name}")).otherwise(other))
    subs, ins, dels, same = part("substitutions", 0), part("insertions", 0), part("deletions", length), part("matches", 0)
    whole = F.greatest(subs + dels + same, F.lit(1))
    fields = []
    for f in FIELDS:
        held = F.count_if(F.col(f"gold_{f}").isNotNull())
        right = F.count_if(F.col(f"gold_{f}") == F.col(f"read_{f}"))
        fields.append(F.when(held > 0, right / held).otherwise(F.lit(float("nan"))).alias(f"{f}_exact"))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if(read).alias("produced"), ((subs + ins + dels) / whole).alias("cer"),
        (subs / whole).alias("substitution_rate"), (dels / whole).alias("deletion_rate"), (ins / whole).alias("insertion_rate"),
        rate(F.count_if(read & (F.col("reference") == F.col("hypothesis"))), F.count("*")).alias("exact_entry"),
        rate(F.count_if(~read), F.count("*")).alias("unknown_rate"), F.median("latency_ms").alias("latency_ms_median"), *fields,
    )


def run_pairs(runs: DataFrame) -> DataFrame:
    """(a, b, variant, context): runs of two backends in one configuration, once each, whatever their tag."""
    a = runs.select(F.col("backend").alias("a"), "variant", "context", "tag").distinct()
    b = runs.select(F.col("backend").alias("b"), "variant", "context", "tag").distinct()
    same = a["tag"].eqNullSafe(b["tag"])
    joined = a.join(b, [a["variant"] == b["variant"], a["context"] == b["context"], same, a["a"] < b["b"]])
    return joined.select("a", "b", a["variant"], a["context"]).distinct()


def agreement(a: DataFrame, b: DataFrame, keys: list[str], cap: int = 60) -> DataFrame:
    """Per group: compared, identical_text, identical_own_id, own_id_agreement_rate, and the first disagreements by crop.

    ``a`` and ``b`` have keys, crop, text and own_id. Crops that one didn't read aren't compared; two
    null ids disagree. The list is a report's, capped; the counts are whole.
    """
    both = a.select(*keys, "crop", F.col("text").alias("ta"), F.col("own_id").alias("ia")).join(b.select(*keys, "crop", F.col("text").alias("tb"), F.col("own_id").alias("ib")), [*keys, "crop"])
    both = both.where(F.col("ta").isNotNull() & F.col("tb").isNotNull()).withColumn("same", F.coalesce(F.col("ia") == F.col("ib"), F.lit(False)))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy("crop"))
    first = both.where("not same").withColumn("_at", place).where(F.col("_at") <= cap).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("crop", "ia", "ib"))).alias("disagreements"))
    out = both.groupBy(*keys).agg(F.count("*").alias("compared"), F.count_if(F.col("ta") == F.col("tb")).alias("identical_text"), F.count_if("same").alias("identical_own_id"))
    out = out.withColumn("own_id_agreement_rate", rate(F.col("identical_own_id"), F.col("compared")))
    return out.join(first, keys, "left").withColumn("disagreements", F.coalesce("disagreements", F.array().cast("array<struct<crop:string,ia:string,ib:string>>")))


def scorecard(rows: DataFrame, keys: list[str], cap: int = 80) -> DataFrame:
    """What reviewers say of the machine. ``rows``: human and machine structs of own_id, parent, order; machine_read.

    A review counts if all three of its fields are there. With a column ``flags`` (the parser's, of
    the machine's text) there are also own_label_from_geometry, parent_label_from_structure and
    numeral_repairs, a count by misread and right glyph; with ``place`` the first ``cap`` mismatches in
    its order. That list is a report's, capped; the counts are whole.
    """
    whole = lambda c: F.col(f"{c}.own_id").isNotNull() & F.col(f"{c}.parent").isNotNull() & F.col(f"{c}.order").isNotNull()
    same = lambda f: F.coalesce(F.col(f"human.{f}") == F.col(f"machine.{f}"), F.lit(False))
    fit, alike = whole("human"), same("own_id") & same("parent") & same("order")
    flags = ("label_from_geometry", "parent_label_from_structure") if "flags" in rows.columns else ()
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("reviewed"), F.count_if(fit).alias("eligible"), F.count_if(fit & F.col("machine_read")).alias("machine_present"),
        *[F.count_if(fit & same(f)).alias(f"{f}_exact") for f in ("own_id", "parent", "order")],
        F.count_if(fit & alike).alias("exact_core"),
        *[F.count_if(fit & F.col(f"flags.{f}")).alias(f.replace("label_from_geometry", "own_label_from_geometry")) for f in flags],
    )
    if flags:
        each = rows.where(fit).select(*keys, F.explode("flags.numeral_repairs").alias("_a", "_b")).groupBy(*keys, F.concat("_a", F.lit("->"), "_b").alias("_r")).agg(F.count("*").alias("_n"))
        repairs = each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_r", "_n")))).alias("numeral_repairs"))
        out = out.join(repairs, keys, "left").withColumn("numeral_repairs", F.coalesce("numeral_repairs", F.create_map().cast("map<string,bigint>")))
    if "place" in rows.columns:
        from pyspark.sql import Window

        at = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        first = rows.where(fit & ~alike).withColumn("_at", at).where(F.col("_at") <= cap)
        listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "place", "human", "machine"))).alias("_m"))
        listed = listed.select(*keys, F.transform("_m", lambda x: F.struct(x["place"].alias("place"), x["human"].alias("human"), x["machine"].alias("machine"))).alias("mismatches"))
        out = out.join(listed, keys, "left").withColumn("mismatches", F.coalesce("mismatches", F.filter(F.array(F.lit(None).cast(listed.schema["mismatches"].dataType.elementType)), lambda x: x.isNotNull())))
    return out


def review_queue(suspects: list[DataFrame], keys: list[str], limit: int = 60) -> DataFrame:
    """The first reason to doubt each entry, sources in order of weight; a report of ``limit`` rows in reading order.

    Each of ``suspects`` has keys, reason and ordinal.
    """
    both = None
    for i, df in enumerate(suspects):
        df = df.select(*keys, "reason", F.struct(F.lit(i).alias("i"), F.col("ordinal")).alias("_w"))
        both = df if both is None else both.unionByName(df)
    return both.groupBy(*keys).agg(F.min_by("reason", "_w").alias("reason")).orderBy(*keys).limit(limit)


def learning_delta(reviewed: Column, at_report: Column) -> tuple[Column, Column]:
    """(pending, direction): reviews since a report, and whether it still holds."""
    pending = F.greatest(F.lit(0), reviewed - F.coalesce(at_report, F.lit(0)))
    way = F.when(at_report.isNull(), "first").when(reviewed > at_report, "higher").when(reviewed < at_report, "lower").otherwise("same")
    return pending, way
