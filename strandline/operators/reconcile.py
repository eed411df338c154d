"""Matching new page geometry with what is stored, and what follows for each region."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import MATCH, interval_iou, overlapping

MATCHES = "document_id string, page int, band int, proposal long, region long, score double"


def exact_pairs(proposals: DataFrame, regions: DataFrame) -> DataFrame:
    """Proposals and regions of one geometry, one to one: live before deleted, kept before rejected, pinned first, then the older.

    ``proposals``: document_id, page, band, proposal, geometry_hash; ``regions`` also deleted, rejected,
    pinned, region. The n-th proposal of a geometry takes its n-th region.
    """
    from pyspark.sql import Window

    keys = ["document_id", "page", "band", "geometry_hash"]
    w = Window.partitionBy(*keys)
    p = proposals.withColumn("_n", F.row_number().over(w.orderBy("proposal")))
    r = regions.withColumn("_n", F.row_number().over(w.orderBy("deleted", "rejected", ~F.col("pinned"), "region")))
    return p.select(*keys, "_n", "proposal").join(r.select(*keys, "_n", "region"), [*keys, "_n"]).select("document_id", "page", "band", "proposal", "region", F.lit(1.0).alias("score"))


def greedy(pairs: DataFrame, keys: list[str], a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs, best score first, ties by ``a`` then ``b``; ``pairs`` are those that count.

    Groups come to tasks whole and sorted, and are gone through as they stream by: a task remembers
    what one group has used.
    """
    rows = pairs.select(*keys, a, b, score)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used_a, used_b = None, set(), set()
        for frame in frames:
            keep = []
            for i, (*key, x, y) in enumerate(frame[[*keys, a, b]].itertuples(index=False, name=None)):
                if key != group:
                    group, used_a, used_b = key, set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    keep.append(i)
            yield frame.iloc[keep]

    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc(score), a, b).mapInPandas(pick, rows.schema)


def match(proposals: DataFrame, regions: DataFrame, least: float = MATCH, bucket: float = 512.0) -> DataFrame:
    """``MATCHES``: exact geometry first, then the greatest overlap of at least ``least`` among what is left. x0 and x1 are needed too."""
    place = ["document_id", "page", "band"]
    exact = exact_pairs(proposals, regions)
    p = proposals.join(exact.select(*place, "proposal"), [*place, "proposal"], "left_anti").select(*place, "proposal", "x0", "x1")
    r = regions.join(exact.select(*place, "region"), [*place, "region"], "left_anti").select(*place, "region", "x0", "x1")
    near = overlapping(p, r, place, "x0", "x1", bucket).withColumn("score", interval_iou(F.col("x0"), F.col("x1"), F.col("other_x0"), F.col("other_x1")))
    near = near.where(F.col("score") >= least).select(*place, "proposal", F.col("other_region").alias("region"), "score")
    return exact.unionByName(greedy(near, place, "proposal", "region", "score"))


def action(proposal: Column, region: Column, state: Column, deleted: Column, pinned: Column, same: Column) -> Column:
    """What a match means: created, refused, divergent, unchanged, revived, moved; an unmatched region is retired, or orphaned if pinned."""
    return (
        F.when(region.isNull(), "created")
        .when(proposal.isNull(), F.when(deleted | (state == "rejected"), "kept").when(pinned, "orphan").otherwise("retired"))
        .when(state == "rejected", "refused").when(pinned, "divergent").when(same & ~deleted, "unchanged").when(deleted, "revived").otherwise("moved")
    )


def reconcile(proposals: DataFrame, regions: DataFrame) -> DataFrame:
    """Every proposal and region with its action; nothing is written, so this is also the dry run.

    ``same`` of a match: geometry, role and entry_index agree.
    """
    place = ["document_id", "page", "band"]
    found = match(proposals, regions)
    p = proposals.join(found, [*place, "proposal"], "left").select(*place, "proposal", "region", "score", F.col("geometry_hash").alias("new_hash"), F.col("role").alias("new_role"), F.col("entry_index").alias("new_entry"))
    both = p.join(regions.drop("x0", "x1"), [*place, "region"], "full")
    same = (F.col("geometry_hash") == F.col("new_hash")) & (F.col("role") == F.col("new_role")) & F.col("entry_index").eqNullSafe(F.col("new_entry"))
    out = both.withColumn("action", action(F.col("proposal"), F.when(F.col("state").isNotNull(), F.col("region")), F.col("state"), F.coalesce("deleted", F.lit(False)), F.coalesce("pinned", F.lit(False)), F.coalesce(same, F.lit(False))))
    return out.withColumn("diverges", (F.col("action") == "divergent") & (F.col("geometry_hash") != F.col("new_hash")))


def apply_actions(plan: DataFrame) -> DataFrame:
    """Regions after a plan: (region, proposal, geometry_hash, state, deleted, before_hash, before_state). before_: what undo restores."""
    a = F.col("action")
    return plan.where(~a.isin("refused", "kept")).select(
        *["document_id", "page", "band"], "region", "proposal", "action",
        F.when(a.isin("created", "moved", "revived"), F.col("new_hash")).otherwise(F.col("geometry_hash")).alias("geometry_hash"),
        F.when(a == "created", "proposed").otherwise(F.col("state")).alias("state"), (a == "retired").alias("deleted"),
        F.col("geometry_hash").alias("before_hash"), F.col("state").alias("before_state"),
    )


def set_geometry(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with a person's geometry, marked adjusted, and what they were before for undo."""
    new = changes.select(key, F.col("geometry_hash").alias("_hash"))
    out = rows.join(new, key, "left")
    moved = F.col("_hash").isNotNull()
    return out.withColumn("before_hash", F.when(moved, F.col("geometry_hash"))).withColumn("before_state", F.when(moved, F.col("state"))).withColumn("state", F.when(moved, "adjusted").otherwise(F.col("state"))).withColumn("geometry_hash", F.coalesce("_hash", "geometry_hash")).drop("_hash")


def plan_problems(bounds: Column) -> Column:
    """What is wrong with edited boundaries from right to left: fewer than two, or not strictly falling."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(1))), lambda i: F.get(bounds, i) < F.get(bounds, i - 1))
    return F.when(F.size(bounds) < 2, "needs two boundaries").when(F.exists(steps, lambda s: ~F.coalesce(s, F.lit(False))), "boundaries must fall from right to left")
