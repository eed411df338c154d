"""Store reads and writes as joins and aggregates: summaries, progress, pending work, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import last_per_key


def live(deleted_at: Column, state: Column) -> Column:
    """Neither deleted nor rejected."""
    return deleted_at.isNull() & (state != "rejected")


def pinned(state: Column) -> Column:
    return state.isin("adjusted", "verified")


def not_ignored(ignored: Column) -> Column:
    """A page without a row is active."""
    return ~F.coalesce(ignored, F.lit(False))


def reviewable_pages(pages: DataFrame, regions: DataFrame, with_ignored: bool = True) -> DataFrame:
    """Distinct (document_id, page_index, ignored) of pages that are stored or hold a live region."""
    keys = ["document_id", "page_index"]
    found = pages.select(*keys).union(regions.where(live(F.col("deleted_at"), F.col("state"))).select(*keys)).distinct()
    out = found.join(pages.select(*keys, "ignored"), keys, "left").select(*keys, F.coalesce("ignored", F.lit(False)).alias("ignored"))
    return out if with_ignored else out.where(~F.col("ignored"))


def page_summary(pages: DataFrame, keys: Sequence[str], counts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Pages with a count from each table, 0 where it has no rows. Each table is aggregated before it is joined."""
    out = pages
    for name, (table, value) in counts.items():
        out = out.join(table.groupBy(*keys).agg(value.alias(name)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def flagged_entries(kinds: Sequence[str]) -> Column:
    """Distinct (band, entry) with a finding of some kinds; those whose band or entry is null don't count."""
    return F.countDistinct(F.when(F.col("kind").isin(*kinds), F.concat(F.col("band"), F.lit(":"), F.col("entry").cast("string"))))


def progress(entries: DataFrame, corrections: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(document, entries, reviewed) over pages that aren't ignored."""
    active = lambda df: df.join(pages.select(*keys, "ignored"), list(keys), "left").where(not_ignored(F.col("ignored")))
    total = active(entries).groupBy(keys[0]).agg(F.count("*").alias("entries"))
    done = active(corrections).groupBy(keys[0]).agg(F.count("*").alias("reviewed"))
    out = total.join(done, keys[0], "full")
    return out.select(keys[0], F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("reviewed", F.lit(0)).alias("reviewed"))


def pending(work: DataFrame, answered: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Work without an answer; null keys of answers don't hide any."""
    return work if force else work.join(answered.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str] = ()) -> DataFrame:
    """Old rows with new ones in the place of those of equal key; of equal new keys the last wins.

    Columns in ``keep`` stay as first stored. A new row with a null key is always added.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    keyed, loose = both.where(whole), both.where(~whole)
    out = last_per_key(keyed, keys, "_new", order)
    for c in keep:
        first = keyed.groupBy(*keys).agg(F.min_by(c, F.struct("_new", order)).alias("_kept"))
        out = out.join(first, list(keys)).withColumn(c, F.col("_kept")).drop("_kept")
    return out.unionByName(loose).drop("_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Old rows and the new ones whose key is new, the first of each."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), order).alias("_row"))
    first = first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])
    return old.unionByName(first.join(old.select(*keys), list(keys), "left_anti"))


def delete(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys), list(keys), "left_anti")


def replace_findings(old: DataFrame, new: DataFrame, kinds: Sequence[str], scope: str = "document_id") -> DataFrame:
    """Findings of these kinds are those of the new run, in the documents that it covers."""
    covered = new.select(scope).distinct().withColumn("_covered", F.lit(True))
    kept = old.join(covered, scope, "left").where(F.col("_covered").isNull() | ~F.col("kind").isin(*kinds)).drop("_covered")
    return kept.unionByName(new)


def supersede(runs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last run of each configuration."""
    latest = runs.groupBy(*keys).agg(F.max(order).alias(order))
    return runs.join(latest, [*keys, order], "left_semi")


def in_order(ids: DataFrame, table: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of the ids asked for, with their place; unknown ids give none."""
    return ids.join(table, key).orderBy(position)


def exactly_one(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The row that alone starts with a prefix; none if none or several do."""
    two = df.where(F.col(column).startswith(prefix)).limit(2)
    row = F.struct(*two.columns)
    return two.agg(F.first(row).alias("r"), F.count("*").alias("n")).where("n = 1").select("r.*")


def readdress(rows: DataFrame, crops: DataFrame, keys: Sequence[str], width: str, target: str, order: str) -> DataFrame:
    """Rows pointed at the crop of their region and width, else at the region's first crop."""
    exact = crops.groupBy(*keys, width).agg(F.min_by(target, order).alias("_exact"))
    first = crops.groupBy(*keys).agg(F.min_by(target, order).alias("_first"))
    out = rows.join(exact, [*keys, width], "left").join(first, list(keys), "left")
    return out.withColumn(target, F.coalesce("_exact", "_first")).drop("_exact", "_first")


def rekey(rows: DataFrame, moves: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Corrections under their regions' new places, and those whose region is gone."""
    both = rows.join(moves.select(old, new), old, "left")
    return both.where(F.col(new).isNotNull()), both.where(F.col(new).isNull()).drop(new)
