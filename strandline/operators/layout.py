"""Page structures: frames out of rules, bands against a corpus template, ruled title pages, edited combs, and what is wrong with a volume."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import CONTEXTS, anchored_offset, entry_boundaries, original_quad
from .imaging import BRIGHT, CHROMA, DARK, IMAGE, gray, unpack
from .stats import median_array

RULE = "struct<position:double,coverage:double>"


def structured_regions(pages: DataFrame, contexts: dict[str, float] = CONTEXTS) -> DataFrame:
    """(page, band, entry, context, role, x0, y0, x1, y1) of ruled pages whose columns share no pitch.

    ``pages``: page, width, bounds (from right to left, all between people), bands (index, top, bottom),
    band_headers (x0, x1) and page_headers (band, x0, y0, x1, y1). Headers count down from -1 in each
    band, a page's own from -101; they are never padded. Pages of fewer than two bounds, or whose
    bounds don't fall, have none.
    """
    falls = F.forall(F.sequence(F.lit(1), F.greatest(F.size("bounds") - 1, F.lit(1))), lambda i: F.get("bounds", i) < F.get("bounds", i - 1))
    fit = pages.where((F.size("bounds") >= 2) & falls)
    pad = F.get("bounds", 0) - F.get("bounds", 1)
    box = lambda *v: F.struct(*[x.cast("double").alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    row = lambda band, entry, role, b: F.struct(band.cast("int").alias("band"), entry.cast("int").alias("entry"), F.lit(role).alias("role"), b.alias("box"))
    people = F.flatten(F.transform("bands", lambda b: F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda i: row(b["index"], i, "entry", box(F.get("bounds", i + 1), b["top"], F.get("bounds", i), b["bottom"])))))
    heads = F.flatten(F.transform("bands", lambda b: F.transform("band_headers", lambda h, i: row(b["index"], -1 - i, "header", box(h["x0"], b["top"], h["x1"], b["bottom"])))))
    tops = F.transform("page_headers", lambda h, i: row(F.coalesce(h["band"], F.get("bands", 0)["index"], F.lit(0)), -101 - i, "header", box(h["x0"], F.coalesce(h["y0"], F.lit(0.0)), h["x1"], h["y1"])))
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("pad")) for k, v in contexts.items()])
    out = fit.select("page", "width", pad.alias("pitch"), F.explode(F.concat(people, heads, tops)).alias("r")).select("*", F.explode(named).alias("c"))
    by = F.when(F.col("r.role") == "entry", F.col("c.pad") * F.col("pitch")).otherwise(0.0)
    return out.select("page", "r.band", "r.entry", F.col("c.name").alias("context"), "r.role", F.greatest(F.col("r.box.x0") - by, F.lit(0.0)).alias("x0"), "r.box.y0", F.least(F.col("r.box.x1") + by, F.col("width").cast("double")).alias("x1"), "r.box.y1")


def fitted_edges(found: list[float], wanted: list[float], tolerance: float) -> list[float] | None:
    """One edge for each wanted one, in order: with one missing the wanted place stands in, with too many the best are taken.

    The choice has the least greatest error, then the least sum of errors, then comes first.
    """
    gap = len(wanted) - len(found)
    if gap > 1:
        return None
    few, many = (found, wanted) if gap == 1 else (wanted, found)

    def errors(picked: tuple[int, ...]) -> list[float]:
        return [abs(few[i] - many[j]) for i, j in enumerate(picked)]

    picked = min(combinations(range(len(many)), len(few)), key=lambda c: (max(errors(c), default=0.0), sum(errors(c)), c))
    if max(errors(picked), default=0.0) > tolerance:
        return None
    if gap == 1:
        at = dict(zip(picked, found, strict=True))
        return [at.get(i, x) for i, x in enumerate(wanted)]
    return [found[j] for j in picked]


def repair_bands(edges: Column, weak: Column, wanted: list[float], height: float, tolerance: float = 0.05) -> Column:
    """struct(edges, repaired): a page's inner edges against the template's, or as they are.

    ``weak`` are the rules seen at a lower coverage; they serve if too few others were seen. Pages that
    already have as many bands as the template are left alone, and so are covers.
    """

    def repaired(found, faint) -> tuple[list[float], bool]:
        own = sorted({float(x) for x in found if 0 < x < height}) if found is not None else []
        if len(wanted) == 0 or len(own) == len(wanted):
            return own, False
        use, reach = own, tolerance * height
        faint = [float(x) for x in faint] if faint is not None else []
        if len(own) < len(wanted) - 1 and len(faint) >= len(wanted):
            use, reach = faint, max(reach, 0.06 * height)
        new = fitted_edges(use, wanted, reach) if len(use) >= len(wanted) - 1 else None
        return (own, False) if new is None else (new, True)

    @F.pandas_udf("edges array<double>, repaired boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([repaired(x, y) for x, y in zip(a, b, strict=True)], columns=["edges", "repaired"])

    return run(edges, weak)


def frame_pair(rules: Column, target: Column, tolerance: Column) -> Column:
    """struct(near, far): the two rules whose distance comes nearest to a target, well inked ones before; null if none is within tolerance."""
    pairs = F.flatten(F.transform(rules, lambda a, i: F.transform(F.slice(rules, i + 2, F.greatest(F.size(rules), F.lit(1))), lambda b: F.struct(a.alias("near"), b.alias("far")))))
    scored = F.transform(pairs, lambda p, i: F.struct((F.abs(F.abs(p["far"]["position"] - p["near"]["position"]) - target) - 2.0 * (p["near"]["coverage"] + p["far"]["coverage"])).alias("score"), i.alias("i"), p.alias("pair")))
    off = lambda s: F.abs(F.abs(s["pair"]["far"]["position"] - s["pair"]["near"]["position"]) - target)
    best = F.array_min(F.filter(scored, lambda s: off(s) <= tolerance))
    return best["pair"]


def inferred_pair(rules: Column, target: Column, span: Column) -> Column:
    """struct(near, far, inferred): the better inked of the outermost rules with its partner a target away, where both stay on the page."""
    ordered = F.array_sort(rules)
    first, last = F.get(ordered, 0)["position"], F.get(ordered, F.size(ordered) - 1)["position"]
    margin = 0.03 * span
    option = lambda anchor, a, b, side: F.when((a >= -margin) & (b <= span + margin), F.struct((-anchor["coverage"]).alias("ink"), F.lit(0 if side == "far" else 1).alias("i"), a.alias("near"), b.alias("far"), F.lit(side).alias("inferred")))
    choices = F.array_compact(F.array(option(F.get(ordered, 0), first, first + target, "far"), option(F.get(ordered, F.size(ordered) - 1), last - target, last, "near")))
    best = F.array_min(choices)
    return F.when(F.size(choices) > 0, F.struct(best["near"].alias("near"), best["far"].alias("far"), best["inferred"].alias("inferred")))


def extent_pair(rules: Column, size: Column, least: float = 0.85) -> Column:
    """struct(near, far): the left and right border at half of ``size``, the height, along lines through where well covered horizontal rules start and end.

    ``rules`` have position, coverage, start and end. Null with fewer than two full rules at different heights.
    """

    @F.pandas_udf("near double, far double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, sizes in batches:
            out = []
            for found, height in zip(pages, sizes, strict=True):
                full = [r for r in found if r["coverage"] >= least] if found is not None else []
                at = np.array([r["position"] for r in full], float)
                if len(set(at.tolist())) < 2:
                    out.append((None, None))
                    continue
                out.append(tuple(float(np.polyval(np.polyfit(at, [r[c] for r in full], 1), height / 2)) for c in ("start", "end")))
            yield pd.DataFrame(out, columns=["near", "far"])

    return run(rules, size)


def side_borders(upright: Column, level: Column, target: Column, width: Column, height: Column, tolerance: float = 0.02) -> Column:
    """struct(near, far, inferred): the left and right border of a page whose frame is ``target`` wide.

    Two upright rules that far apart come first; then the ends of the level rules, which are
    measured on the page; a border guessed from its opposite comes last.
    """
    pair, ends, guess = frame_pair(upright, target, tolerance * target), extent_pair(level, height), inferred_pair(upright, target, width)
    near, far = pair["near"]["position"], pair["far"]["position"]
    none = F.lit(None).cast("string")
    fit = ends["near"].isNotNull() & (F.abs(F.abs(ends["far"] - ends["near"]) - target) <= 2.5 * tolerance * target)
    return F.when(pair.isNotNull(), F.struct(F.least(near, far).alias("near"), F.greatest(near, far).alias("far"), none.alias("inferred"))).when(fit, F.struct(F.least(ends["near"], ends["far"]).alias("near"), F.greatest(ends["near"], ends["far"]).alias("far"), none.alias("inferred"))).otherwise(guess)


def median_frame(frames: DataFrame, least: int = 20) -> DataFrame:
    """One row (corners, frames): the median corner of each place over fully detected frames; none with fewer than ``least``.

    ``frames``: ok, inferred, corners (eight numbers).
    """
    full = frames.where(F.col("ok") & (F.size("inferred") == 0) & (F.size("corners") == 8)).withColumn("_k", F.lit(0))
    count = full.groupBy("_k").agg(F.count("*").alias("frames"))
    return median_array(full, ["_k"], "corners").join(count, "_k").where(F.col("frames") >= least).select("corners", "frames")


def edited_comb(pages: DataFrame, overrides: DataFrame, phase: float = 0.0, pitch: float | None = None, snapping: bool = True) -> DataFrame:
    """(page, problem, bounds, pitch, phase): the comb that an edit would give, and why it can't be.

    ``pages``: page, width, pitch, left, right, gutters, fraction and anchor; ``overrides``: page, index,
    x. A boundary moved by hand stays where it was put; all must fall from right to left on the page.
    """
    use = F.lit(float(pitch)) if pitch else F.col("pitch")
    base = anchored_offset(F.col("left"), F.col("right"), use, F.col("gutters"), use * F.col("fraction"), F.col("anchor"))
    cut = pages.withColumn("_pitch", use).withColumn("_phase", base + F.lit(float(phase)))
    cut = cut.withColumn("_teeth", entry_boundaries(F.col("left"), F.col("right"), F.col("_pitch"), F.col("gutters"), F.col("_phase"), snapping))
    moved = overrides.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("index", "x"))).alias("_moved"))
    both = cut.join(moved, "page", "left").withColumn("_moved", F.coalesce("_moved", F.create_map().cast("map<int,double>")))
    bounds = F.transform("_teeth", lambda t, i: F.coalesce(F.try_element_at("_moved", i), t["x"]))
    both = both.withColumn("_bounds", bounds)
    strange = F.exists(F.map_keys("_moved"), lambda i: (i < 0) | (i >= F.size("_teeth")))
    outside = F.exists(F.map_values("_moved"), lambda x: F.isnan(x) | (x < 0) | (x > F.col("width")))
    falls = F.forall(F.sequence(F.lit(1), F.greatest(F.size("_bounds") - 1, F.lit(1))), lambda i: F.coalesce(F.get("_bounds", i) < F.get("_bounds", i - 1), F.lit(True)))
    problem = F.when(strange, "a manual boundary does not exist in this lattice").when(outside, "a manual boundary must stay on the page").when(~falls, "boundaries must remain in right-to-left order")
    return both.select("page", problem.alias("problem"), F.col("_bounds").alias("bounds"), F.col("_pitch").alias("pitch"), F.col("_phase").alias("phase"))


def proposals(combs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, band, label, proposal, x0, y0, x1, y1, quad) between an edited comb's bounds. ``pages``: page, width, inverse, bands (index, label, top, bottom)."""
    rows = combs.where(F.col("problem").isNull() & (F.size("bounds") >= 2)).join(pages, "page")
    rows = rows.select("*", F.explode("bands").alias("b")).select("*", F.explode(F.sequence(F.lit(0), F.size("bounds") - 2)).alias("proposal"))
    box = F.struct(F.greatest(F.get("bounds", F.col("proposal") + 1), F.lit(0.0)).alias("x0"), F.col("b.top").alias("y0"), F.least(F.get("bounds", "proposal"), F.col("width")).alias("x1"), F.col("b.bottom").alias("y1"))
    rows = rows.withColumn("box", box)
    return rows.select("page", F.col("b.index").alias("band"), F.col("b.label").alias("label"), "proposal", "box.*", F.when(F.col("inverse").isNotNull(), original_quad(F.col("inverse"), F.col("box"))).alias("quad"))


def problems(phantoms: Column, bias: Column, headers: Column) -> Column:
    """What speaks against a volume's layout, in words."""
    return F.array_compact(F.array(
        F.when(phantoms > 0, F.concat(phantoms.cast("string"), F.lit(" crops contain almost no ink"))),
        F.when(bias > 1.6, F.concat(F.lit("failures concentrate at page edges (bias "), F.format_string("%.2f", bias), F.lit(")"))),
        F.when(headers > 0, F.concat(headers.cast("string"), F.lit(" entries contain header text"))),
    ))


def mark_headers(regions: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Regions with the role header where a header's text was found."""
    seen = found.select(*keys).distinct().withColumn("_header", F.lit(True))
    return regions.join(seen, keys, "left").withColumn("role", F.when(F.col("_header"), "header").otherwise(F.col("role"))).drop("_header")


def pixel_scores(original: Column, rendered: Column) -> Column:
    """struct(paper, watermark_residual, contrast_under, contrast_clean, retention): how a rendering treats stamp and ink.

    Pixels are stamp alone, ink under the stamp, clean ink, or background, by the original's colour and
    by its own dark and bright percentiles; a set without pixels makes what needs it null.
    """

    def score(page: dict, other: dict) -> tuple:
        image, shown = unpack(page), unpack(other)
        if image is None or shown is None:
            return (None,) * 5
        image = np.repeat(image[..., None], 3, 2) if image.ndim == 2 else image
        colour, ink = image.max(2).astype(int) - image.min(2) > CHROMA, image.max(2)
        dark, bright = ink <= np.percentile(ink, DARK), ink >= np.percentile(ink, BRIGHT)
        tone = gray(shown).astype(float)
        mean = lambda m: float(tone[m].mean()) if m.any() else float("nan")
        paper, stamp, under, clean = mean(~colour & bright), mean(colour & ~dark), mean(colour & dark), mean(~colour & dark)
        return paper, paper - stamp, paper - under, paper - clean, (paper - under) / (paper - clean) if paper != clean else float("nan")

    @F.pandas_udf("paper double, watermark_residual double, contrast_under double, contrast_clean double, retention double")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = [score(x, y) for x, y in zip(a.to_dict("records"), b.to_dict("records"), strict=True)]
            yield pd.DataFrame(rows, columns=["paper", "watermark_residual", "contrast_under", "contrast_clean", "retention"])

    return run(original, rendered)


def crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes (page, x0, y0, x1, y1 and others) with the pixels they cut out of their page, edges cut to whole pixels."""

    @F.pandas_udf(IMAGE)
    def cut(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for images, places in batches:
            out = []
            for row, b in zip(images.to_dict("records"), places.to_dict("records"), strict=True):
                image = unpack(row)
                part = None if image is None else image[max(int(b["y0"]), 0) : int(b["y1"]), max(int(b["x0"]), 0) : int(b["x1"])]
                out.append((None,) * 4 if part is None or not part.size else (part.shape[0], part.shape[1], 1 if part.ndim == 2 else part.shape[2], part.tobytes()))
            yield pd.DataFrame(out, columns=["height", "width", "channels", "pixels"])

    rows = boxes.join(pages.select("page", F.col("image").alias("_image")), "page")
    return rows.withColumn("crop", cut(F.col("_image"), F.struct("x0", "y0", "x1", "y1"))).drop("_image")
