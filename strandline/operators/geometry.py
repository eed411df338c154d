"""Columns of a page as a comb of entries: native expressions over arrays, no loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerals import let

# Padding of crops and tolerances, as shares of the pitch.
CONTEXTS = {"tight": 0.0, "medium": 0.35, "full": 0.75}
TOLERANCE = 0.12
MATCH = 0.5


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two stretches over the hull of both; 0 for an empty hull."""
    overlap = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, overlap / hull).otherwise(F.lit(0.0))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, bucket: float) -> DataFrame:
    """Pairs of equal keys whose stretches overlap; columns of ``right`` get the prefix ``other_``.

    Both sides are cut into buckets of a length and joined on them, so the join is by equality; a pair
    that shares several buckets is kept at the one where the later of the two begins.
    """
    cut = lambda c: F.floor(F.col(c) / bucket).cast("long")
    each = lambda df: df.withColumn("_bucket", F.explode(F.sequence(cut(low), cut(high))))
    other = each(right).select(*[F.col(c) if c in (*keys, "_bucket") else F.col(c).alias(f"other_{c}") for c in [*right.columns, "_bucket"]])
    both = each(left).join(other, [*keys, "_bucket"])
    both = both.where((F.col(low) < F.col(f"other_{high}")) & (F.col(f"other_{low}") < F.col(high)))
    return both.where(F.col("_bucket") == F.floor(F.greatest(F.col(low), F.col(f"other_{low}")) / bucket).cast("long")).drop("_bucket")


def snap(value: Column, edges: Column, tolerance: Column) -> Column:
    """struct(x, snapped): the nearest edge if it is near enough, the first of equally near ones."""
    near = F.array_min(F.transform(edges, lambda e, i: F.struct(F.abs(e - value).alias("gap"), i.alias("i"), e.alias("e"))))
    hit = F.coalesce(near["gap"] <= tolerance, F.lit(False))
    return F.struct(F.when(hit, near["e"]).otherwise(value).alias("x"), hit.alias("snapped"))


def fit_comb(right: Column, pitch: Column, gutters: Column, share: float = TOLERANCE) -> Column:
    """struct(phase, hits): the phase, going down from the right edge over one pitch, that most gutters agree with; the first of several."""
    steps = F.greatest((pitch * 2).cast("int"), F.lit(1))
    phases = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: right - i * (pitch / steps))

    def hits(phase: Column) -> Column:
        off = lambda g: F.pmod(g - phase, pitch)
        return F.size(F.filter(gutters, lambda g: F.least(off(g), pitch - off(g)) <= pitch * share))

    scored = F.transform(phases, lambda p, i: F.struct(hits(p).alias("hits"), (-i).alias("i"), p.alias("phase")))
    best = let(F.array_max(scored), lambda b: F.struct(b["phase"].alias("phase"), b["hits"].alias("hits")))
    return F.when(pitch > 0, best).otherwise(F.struct(right.alias("phase"), F.lit(0).alias("hits")))


def entry_boundaries(left: Column, right: Column, pitch: Column, gutters: Column, offset: Column | None = None, snapping: bool = True, share: float = TOLERANCE) -> Column:
    """array of struct(x, snapped) from right to left; empty without a pitch.

    The comb starts at its first tooth not short of the right edge and ends before the left one, with
    a tolerance at both. Teeth are whole pitches apart; each is snapped by itself.
    """
    tolerance = pitch * share
    place = lambda x: snap(x, gutters, tolerance) if snapping else F.struct(x.alias("x"), F.lit(False).alias("snapped"))
    nothing = F.array().cast("array<struct<x:double,snapped:boolean>>")

    def teeth(start: Column) -> Column:
        count = F.greatest(F.ceil((start - (left - tolerance)) / pitch), F.lit(0)).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: place(start - i * pitch))).otherwise(nothing)

    def lifted(phase: Column) -> Column:
        return phase + F.greatest(F.ceil((right - tolerance - phase) / pitch), F.lit(0)) * pitch

    # The scan over phases is worked out once a row, and the first tooth from it once.
    phase = fit_comb(right, pitch, gutters, share)["phase"] + (F.lit(0.0) if offset is None else offset)
    return F.when(pitch > 0, let(let(phase, lifted), teeth)).otherwise(nothing)


def anchored_offset(left: Column, right: Column, pitch: Column, gutters: Column, offset: Column, anchor: Column) -> Column:
    """The offset, or the one half a pitch on if that puts the second tooth nearer to the corpus's."""

    def distance(o: Column) -> Column:
        second = F.get(entry_boundaries(left, right, pitch, gutters, o), 1)["x"]
        return F.coalesce(F.abs(second - anchor), F.lit(float("inf")))

    other = offset + pitch / 2
    return F.when(anchor.isNull() | (pitch <= 0), offset).when(distance(other) < distance(offset), other).otherwise(offset)


def resolve_comb(pitch: Column, confidence: Column, left: Column, right: Column, corpus_pitch: Column, corpus_left: Column, corpus_right: Column) -> Column:
    """struct(pitch, left, right, by_corpus): the corpus's pitch where the page's is weak or off, and the wider extent."""
    weak = (F.coalesce(confidence, F.lit(0.0)) < 0.3) | (F.abs(pitch - corpus_pitch) > 0.1 * corpus_pitch)
    return F.struct(F.when(weak, corpus_pitch).otherwise(pitch).alias("pitch"), F.least(left, corpus_left).alias("left"), F.greatest(right, corpus_right).alias("right"), weak.alias("by_corpus"))


def phase_anchor(pages: DataFrame, fraction: float) -> DataFrame:
    """One row (anchor): the median second tooth of the corpus's pages. ``pages``: comb (see ``resolve_comb``) and gutters."""
    c = F.col("comb")
    teeth = entry_boundaries(c["left"], c["right"], c["pitch"], F.col("gutters"), c["pitch"] * fraction)
    return pages.select(F.get(teeth, 1)["x"].alias("x")).agg(F.median("x").alias("anchor"))


def segment(pages: DataFrame, contexts: dict[str, float] = CONTEXTS) -> DataFrame:
    """(page, band, entry, context, x0, y0, x1, y1, snapped): every column of every band, padded per context and kept on the page.

    ``pages``: page, width, height, pitch, bands (array of struct(index, top, bottom)), teeth (see ``entry_boundaries``).
    """
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("pad")) for k, v in contexts.items()])
    wide = pages.withColumn("_n", F.size("teeth")).where("_n > 1")
    wide = wide.select("*", F.explode("bands").alias("band")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 2)).alias("entry")).select("*", F.explode(named).alias("context"))
    pad = F.col("context.pad") * F.col("pitch")
    a, b = F.get("teeth", F.col("entry") + 1), F.get("teeth", F.col("entry"))
    return wide.select(
        "page", F.col("band.index").alias("band"), "entry", F.col("context.name").alias("context"),
        F.greatest(a["x"] - pad, F.lit(0.0)).alias("x0"), F.greatest(F.col("band.top") - pad, F.lit(0.0)).alias("y0"),
        F.least(b["x"] + pad, F.col("width")).alias("x1"), F.least(F.col("band.bottom") + pad, F.col("height")).alias("y1"),
        (a["snapped"] & b["snapped"]).alias("snapped"),
    )


def apply_homography(matrix: Column, x: Column, y: Column) -> Column:
    """struct(x, y): a point through a 3 by 3 matrix."""
    row = lambda i: matrix[i][0] * x + matrix[i][1] * y + matrix[i][2]
    return F.struct((row(0) / row(2)).alias("x"), (row(1) / row(2)).alias("y"))


def original_quad(matrix: Column, box: Column) -> Column:
    """A box's corners through a matrix, clockwise from the upper left."""
    corners = [(box["x0"], box["y0"]), (box["x1"], box["y0"]), (box["x1"], box["y1"]), (box["x0"], box["y1"])]
    return F.array(*[apply_homography(matrix, x, y) for x, y in corners])


def roundtrip_error(forward: Column, inverse: Column, points: Column) -> Column:
    """The farthest that a point moves there and back."""

    def gap(p: Column) -> Column:
        there = apply_homography(forward, p["x"], p["y"])
        back = apply_homography(inverse, there["x"], there["y"])
        return F.hypot(back["x"] - p["x"], back["y"] - p["y"])

    return F.array_max(F.transform(points, gap))


def merge_close(lines: Column, tolerance: float = 8.0) -> Column:
    """Rules of struct(position, coverage): those within a tolerance of the last one kept are one, the better covered."""
    empty = F.slice(lines, 1, 0)

    def step(kept: Column, line: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        near = (F.size(kept) > 0) & (F.abs(line["position"] - last["position"]) <= tolerance)
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(line))
        return F.when(~near, F.concat(kept, F.array(line))).when(line["coverage"] > last["coverage"], swapped).otherwise(kept)

    return F.aggregate(F.array_sort(lines), empty, step)


def bands_between(edges: Column, height: Column, least: float = 0.1) -> Column:
    """array of struct(index, top, bottom) between sorted rules, slivers left out."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(edges) - 2, F.lit(0))), lambda i: F.struct(F.get(edges, i).alias("top"), F.get(edges, i + 1).alias("bottom")))
    fit = F.filter(pairs, lambda p: F.coalesce((p["bottom"] - p["top"]) >= height * least, F.lit(False)))
    return F.transform(fit, lambda p, i: F.struct(i.alias("index"), p["top"].alias("top"), p["bottom"].alias("bottom")))


def canonical_space(frames: DataFrame) -> DataFrame:
    """One row (width, height, width_mad, height_mad, frames): medians of usable frames, fully detected ones if there are twenty.

    ``frames``: ok, inferred (array of edges), width, height.
    """
    from .stats import mad

    usable = frames.where("ok").withColumn("_full", F.size("inferred") == 0)
    enough = usable.agg((F.count_if("_full") >= 20).alias("_enough"))
    fit = usable.join(F.broadcast(enough)).where(~F.col("_enough") | F.col("_full")).withColumn("_k", F.lit(0))
    w = mad(fit, ["_k"], "width").withColumnsRenamed({"median": "width", "mad": "width_mad"})
    h = mad(fit, ["_k"], "height").withColumnsRenamed({"median": "height", "mad": "height_mad"})
    return w.join(h, "_k").join(fit.groupBy("_k").agg(F.count("*").alias("frames")), "_k").drop("_k")


def grade(ok: Column, inferred: Column, width: Column, height: Column, skew: Column, rect: Column, space_width: Column, space_height: Column) -> Column:
    """struct(status, reason): failed, inferred or clean; reasons in order."""
    off, of = width - space_width, height - space_height
    signed = lambda x: F.concat(F.when(x < 0, "-").otherwise("+"), F.bround(F.abs(x), 0).cast("long").cast("string"), F.lit("px"))
    hard = F.array_compact(F.array(
        F.when(F.abs(off) > 0.03 * space_width, F.concat(F.lit("width off median by "), signed(off))),
        F.when(F.abs(of) > 0.03 * space_height, F.concat(F.lit("height off median by "), signed(of))),
        F.when(F.abs(skew) > 2.0, F.concat(F.lit("skew "), F.format_string("%.2f", skew), F.lit("deg"))),
        F.when(rect > 0.02 * space_width, F.concat(F.lit("non-rectangular by "), F.bround(rect, 0).cast("long").cast("string"), F.lit("px"))),
    ))
    soft = F.when(F.size(inferred) > 0, F.array(F.concat(F.lit("edge inferred from prior: "), F.array_join(inferred, ", ")))).otherwise(F.array().cast("array<string>"))
    status = F.when(~ok | (F.size(hard) > 0), "failed").when(F.size(inferred) > 0, "inferred").otherwise("clean")
    return F.struct(status.alias("status"), F.when(ok, F.array_join(F.concat(soft, hard), "; ")).otherwise("frame fit failed").alias("reason"))


def gutters(profile: Column, pitch: Column, ink: float = 0.25) -> Column:
    """struct(edges, left, right): centres of runs of little ink that are wide enough, and the text's extent.

    Runs are folded over the profile, so a page's row holds all it takes.
    """
    wide = F.greatest((pitch * 0.12).cast("int"), F.lit(4))
    start = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("runs"))
    marked = F.transform(profile, lambda v, i: F.struct(i.alias("i"), (v < ink).alias("low")))
    # One step past the end closes a run that reaches it.
    closed = F.concat(marked, F.array(F.struct(F.size(profile).alias("i"), F.lit(False).alias("low"))))

    def step(s: Column, p: Column) -> Column:
        ends = ~p["low"] & (s["open"] >= 0)
        fits = ends & (p["i"] - s["open"] >= wide)
        runs = F.when(fits, F.concat(s["runs"], F.array(F.struct(s["open"].alias("a"), p["i"].alias("b"))))).otherwise(s["runs"])
        return F.struct(F.when(p["low"], F.when(s["open"] < 0, p["i"]).otherwise(s["open"])).otherwise(-1).alias("open"), runs.alias("runs"))

    runs = F.aggregate(closed, start, step)["runs"]
    inked = F.filter(marked, lambda p: ~p["low"])
    none = F.size(runs) == 0
    edges = F.transform(runs, lambda r: (r["a"] + r["b"]) / 2.0)
    left = F.when(none | (F.size(inked) == 0), 0.0).otherwise(F.get(inked, 0)["i"].cast("double"))
    right = F.when(none | (F.size(inked) == 0), F.size(profile).cast("double")).otherwise(F.get(inked, F.size(inked) - 1)["i"].cast("double"))
    return F.struct(edges.alias("edges"), left.alias("left"), right.alias("right"))


def neighbour_fragment(boxes: DataFrame, widths: DataFrame) -> DataFrame:
    """(document_id, page, band, x0, x1, stitched): each band's leftmost box on the page before, where it reaches the page's edge.

    ``boxes``: document_id, page, band, x0, x1; bands match null-safe. The gap to the edge may be half
    the box's width, or one pixel. ``widths``: document_id and the width that a stitched entry has.
    """
    edge = boxes.groupBy("document_id", "page", "band").agg(F.min_by(F.struct("x0", "x1"), "x0").alias("b"))
    near = edge.where(F.col("b.x0") <= F.greatest(F.lit(1.0), (F.col("b.x1") - F.col("b.x0")) / 2))
    return near.join(widths, "document_id").select("document_id", (F.col("page") + 1).alias("page"), "band", "b.x0", "b.x1", F.col("width").alias("stitched"))
