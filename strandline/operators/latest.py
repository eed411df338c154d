"""Which of several rows speaks for a key. Every rule names its order; nothing relies on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _values(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def last_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The row of highest order of each key, by partial aggregation rather than a sort. NULL orders count as lowest."""
    out = df.groupBy(*keys).agg(F.max_by(_values(df, keys), F.struct(*order)).alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    out = df.groupBy(*keys).agg(F.min_by(_values(df, keys), F.struct(*order)).alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def best_reading(df: DataFrame, keys: Sequence[str], current: Column, order: str) -> DataFrame:
    """The latest reading, but a stale one never replaces a current one."""
    return last_per_key(df, keys, F.coalesce(current, F.lit(False)), F.col(order))


def best_crop(df: DataFrame, keys: Sequence[str], current: Column, order: str) -> DataFrame:
    """The last current crop; without one the first of all."""
    row = _values(df, keys)
    held = F.when(current, F.struct(F.col(order)))
    out = df.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(current, row), held), F.min_by(row, F.struct(order))).alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def best_text(df: DataFrame, keys: Sequence[str], machine: Column, corrected: Column, human: Column, order: str) -> DataFrame:
    """(keys, text, source): a person's word where there is one, even empty; else the last machine text that isn't null."""
    out = df.groupBy(*keys).agg(
        F.max(F.coalesce(corrected, F.lit(False))).alias("_human"),
        F.max_by(F.when(corrected, F.coalesce(human, F.lit(""))), F.when(corrected, F.struct(order))).alias("_text"),
        F.max_by(machine, F.when(machine.isNotNull(), F.struct(order))).alias("_machine"),
    )
    source = F.when(F.col("_human"), "human").when(F.col("_machine").isNotNull(), "machine").otherwise("none")
    return out.select(*keys, F.when(F.col("_human"), F.col("_text")).otherwise(F.col("_machine")).alias("text"), source.alias("source"))


def latest_tag(runs: DataFrame, skip: str = "interactive") -> DataFrame:
    """(document_id, tag) of each document's last candidate whose tag isn't ``skip``; a null tag isn't either."""
    return runs.where(~F.col("tag").eqNullSafe(skip)).groupBy("document_id").agg(F.max_by("tag", "candidate_id").alias("tag"))


def last_run_per_crop(df: DataFrame, run_keys: Sequence[str], crop: str, order: str, version: str) -> DataFrame:
    """The last candidate of each run and crop; a run's model version is that of its first row."""
    first = df.groupBy(*run_keys).agg(F.min_by(version, order).alias(version)).withColumnsRenamed({k: f"_{k}" for k in run_keys})
    last = last_per_key(df.drop(version), [*run_keys, crop], order)
    same = F.lit(True)
    for k in run_keys:  # a run without a tag is a run
        same = same & last[k].eqNullSafe(first[f"_{k}"])
    return last.join(first, same).drop(*[f"_{k}" for k in run_keys])


def largest_group(df: DataFrame, key: str) -> DataFrame:
    """The key with most rows, ties to the smallest, as one row (key, n)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(1)


def renumber(df: DataFrame, keys: Sequence[str], right: str, tie: str, locked: Column, order: str) -> DataFrame:
    """``order`` anew, from 0 at the right edge, in bands none of whose rows is locked; others keep theirs."""
    w = Window.partitionBy(*keys)
    fresh = (F.row_number().over(w.orderBy(F.desc(right), tie)) - 1).cast("int")
    held = F.max(F.coalesce(locked, F.lit(False))).over(w)
    return df.withColumn(order, F.when(held, F.col(order)).otherwise(fresh))


def systematic_sample(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """An even spread of ``k`` rows: every n // k-th in order, the first k of them. A top-k of a number known beforehand."""
    from .stats import numbered

    n = df.count()
    step = max(1, n // max(k, 1))
    ranked = numbered(df, order, "_at")
    return ranked.where((F.col("_at") - 1) % step == 0).orderBy("_at").limit(k).drop("_at")
