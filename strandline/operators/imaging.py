"""Pixels: variants, ink profiles, pitch, rules, homographies, families. NumPy in Arrow batches, a page at a time.

An image is height, width, channels and raw bytes, so no codec is needed where the operators run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,channels:int,pixels:binary>"
VARIANTS = ("original", "gray", "red", "maxrgb", "watermark", "lab_l", "neutral", "contrast", "binary")
# Chroma that is no ink, ink itself, and the percentiles of dark and bright pixels.
CHROMA, INK, DARK, BRIGHT = 18, 150, 12, 75
# Coverage of a rule that splits bands, and of one that may where too few are found.
STRICT, WEAK = 0.55, 0.45


def pack(image: np.ndarray) -> dict:
    return {"height": image.shape[0], "width": image.shape[1], "channels": 1 if image.ndim == 2 else image.shape[2], "pixels": image.astype(np.uint8).tobytes()}


def unpack(row: dict | None) -> np.ndarray | None:
    """The image, or none if its bytes don't make one."""
    if row is None or row["pixels"] is None or len(row["pixels"]) != row["height"] * row["width"] * row["channels"]:
        return None
    flat = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"])
    return flat[..., 0] if row["channels"] == 1 else flat


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def lab(image: np.ndarray) -> np.ndarray:
    """CIELAB of sRGB pixels under D65, each in 8 bits: lightness over 0 to 255, a and b from 128."""
    c = image.astype(float) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    # sRGB's primaries and the white of D65.
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T
    xyz /= np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def chroma_mask(image: np.ndarray, threshold: int = CHROMA, grow: int = 1) -> np.ndarray:
    """Pixels far from neutral in CIELAB, and those within ``grow`` steps to the sides of one."""
    if image.ndim == 2:
        return np.zeros(image.shape, bool)
    ab = lab(image)[..., 1:].astype(int) - 128
    mask = np.hypot(ab[..., 0], ab[..., 1]) > threshold
    for _ in range(grow):
        wide = mask.copy()
        wide[1:] |= mask[:-1]
        wide[:-1] |= mask[1:]
        wide[:, 1:] |= mask[:, :-1]
        wide[:, :-1] |= mask[:, 1:]
        mask = wide
    return mask


def blurred(tone: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur of three standard deviations to each side, mirrored at the edges."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = tone.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > reach else "symmetric")
        out = np.apply_along_axis(np.convolve, axis, wide, kernel, "valid")
    return out


def flatten_background(tone: np.ndarray, sigma: float = 81) -> np.ndarray:
    """Slow changes of paper and light divided out; paper comes to 200."""
    return np.clip(tone / np.maximum(blurred(tone, sigma), 1) * 200, 0, 255).astype(np.uint8)


def variant(image: np.ndarray, name: str) -> np.ndarray:
    """A rendering that keeps ink and loses the stamp, more or less; channels are red, green, blue."""
    if name == "original" or image.ndim == 2 and name in ("gray", "red", "maxrgb"):
        return image
    tone = gray(image)
    if name == "gray":
        return tone
    if name == "red":
        return image[..., 0]
    if name == "maxrgb":
        return image.max(2)
    if name == "watermark":  # ink alone: coloured and gray stamps are brighter in their brightest channel
        return np.where((image if image.ndim == 2 else image.max(2)) > INK, 255, 0).astype(np.uint8)
    if name == "lab_l":
        return lab(image if image.ndim == 3 else np.repeat(image[..., None], 3, 2))[..., 0]
    if name == "neutral":  # coloured pixels become paper
        span = image.max(2).astype(int) - image.min(2) if image.ndim == 3 else np.zeros(tone.shape, int)
        return np.where(span > CHROMA, 255, tone).astype(np.uint8)
    if name == "contrast":
        low, high = np.percentile(tone, (2, 98))
        return np.clip((tone - low) * 255 / max(high - low, 1), 0, 255).astype(np.uint8)
    if name == "binary":
        return np.where(tone < INK, 0, 255).astype(np.uint8)
    raise KeyError(f"no variant {name}; there are {', '.join(VARIANTS)}")


def build_variants(image: Column, names: tuple[str, ...] = VARIANTS) -> Column:
    """array of struct(name, image) of the variants asked for; null where the image can't be read."""

    @F.pandas_udf(f"array<struct<name:string,image:{IMAGE}>>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                pixels = unpack(row)
                out.append(None if pixels is None else [{"name": n, "image": pack(variant(pixels, n))} for n in names])
            yield pd.Series(out)

    return run(image)


def ink_profile(tone: np.ndarray, smooth: int = 9) -> np.ndarray:
    """Share of ink by column, smoothed by a box and stretched to 0..1."""
    ink = (tone < INK).mean(0)
    soft = np.convolve(ink, np.ones(smooth) / smooth, "same")
    span = np.ptp(soft)
    return (soft - soft.min()) / span if span else np.zeros_like(soft)


def dominant_pitch(profile: np.ndarray, low: int = 60, high: int = 400) -> tuple[float, float]:
    """(pitch, confidence): the shift within [low, high) at which a profile is most like itself; 0 for a flat or short one."""
    wave = np.asarray(profile, float) - np.mean(profile)
    energy = float(wave @ wave)
    top = min(high, len(wave) - 1)
    if not energy or top <= low:
        return 0.0, 0.0
    size = 1 << (2 * len(wave)).bit_length()
    likeness = np.fft.irfft(np.abs(np.fft.rfft(wave, size)) ** 2, size)[low:top] / energy
    return float(low + int(likeness.argmax())), float(likeness.max())


def rule_extents(tone: np.ndarray, least: float = 0.5) -> list[tuple[float, float, float, float]]:
    """(position, coverage, start, end) of horizontal rules: rows whose ink covers enough of the width, thick ones once."""
    ink = tone < INK
    cover = ink.mean(1)
    rows = np.flatnonzero(cover >= least)
    groups = np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1) if len(rows) else []
    out = []
    for g in groups:
        at = np.flatnonzero(ink[g[cover[g].argmax()]])
        out.append((float(g.mean()), float(cover[g].max()), float(at[0]), float(at[-1])))
    return out


def rules(tone: np.ndarray, least: float = 0.5) -> list[tuple[float, float]]:
    """(position, coverage) of horizontal rules."""
    return [(p, c) for p, c, _, _ in rule_extents(tone, least)]


def fitted_rules(ink: np.ndarray, least: float = 0.35, thin: float = 0.006) -> list[dict]:
    """Long thin rules across a mask of ink, broken or skewed, by their middle: a line fitted to each.

    Works on runs: those of a row with a gap of less than a 25th of the width between them are one,
    and of these the ones of a quarter of the least length stay; runs that touch in neighbouring rows
    are one rule. It counts if it is ``least`` of the width long, and on average no thicker than
    ``thin`` of the height. For upright rules pass the mask turned.
    """
    height, width = ink.shape
    bridge, short = max(int(width * 0.04), 5), max(int(width * least * 0.25), 15)
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, a), b = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    first = np.r_[True, (row[1:] != row[:-1]) | (a[1:] - b[:-1] >= bridge)] if len(a) else np.zeros(0, bool)
    row, a, b = row[first], a[first], b[np.r_[first[1:], True]] if len(a) else b
    keep = b - a >= short
    row, a, b = row[keep], a[keep], b[keep]
    owner = np.arange(len(row))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    begin = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        for i in range(begin[y], begin[y + 1]):
            for j in range(begin[y - 1], begin[y]):
                if a[i] <= b[j] and a[j] <= b[i]:
                    p, q = root(i), root(j)
                    owner[max(p, q)] = min(p, q)
    out = []
    names = np.array([root(i) for i in range(len(row))], int)
    for name in np.unique(names):
        own = names == name
        y, low, n = row[own].astype(float), a[own].astype(float), (b - a)[own].astype(float)
        start, end, area = low.min(), (low + n).max() - 1, n.sum()
        if end - start < max(width * least, 2) or area / (end - start) > height * thin:
            continue
        # Sums over a run's pixels: x goes from low to low + n - 1, y stays.
        sx, sy = (n * low + n * (n - 1) / 2).sum(), (n * y).sum()
        sxx = (n * low * low + low * n * (n - 1) + (n - 1) * n * (2 * n - 1) / 6).sum()
        sxy = (y * (n * low + n * (n - 1) / 2)).sum()
        slope = (area * sxy - sx * sy) / (area * sxx - sx * sx)
        level = (sy - slope * sx) / area
        out.append({"position": level + slope * width / 2, "slope": slope, "coverage": (end - start) / width, "start": start, "end": end, "thickness": area / (end - start)})
    return sorted(out, key=lambda r: r["position"])


def detect_rules(image: Column, upright: bool = False, least: float = 0.35, thin: float = 0.006) -> Column:
    """array of struct(position, slope, coverage, start, end, thickness) of a page's rules; null where the image can't be read."""

    @F.pandas_udf("array<struct<position:double,slope:double,coverage:double,start:double,end:double,thickness:double>>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                pixels = unpack(row)
                ink = None if pixels is None else gray(pixels) < INK
                out.append(None if ink is None else fitted_rules(ink.T if upright else ink, least, thin))
            yield pd.Series(out)

    return run(image)


def contact_sheet(images: list[np.ndarray], height: int = 64, gap: int = 2) -> np.ndarray:
    """Images side by side at one height, with white between them; gray ones stay gray if all are."""
    colour = any(x.ndim == 3 for x in images)
    tiles = []
    for x in images:
        wide = max(1, round(x.shape[1] * height / x.shape[0]))
        x = x[np.arange(height) * x.shape[0] // height][:, np.arange(wide) * x.shape[1] // wide]
        tiles.append(np.pad(np.repeat(x[..., None], 3, 2) if colour and x.ndim == 2 else x, [(0, 0), (0, gap)] + [(0, 0)] * colour, constant_values=255))
    return np.concatenate(tiles, axis=1)


def contact_sheets(crops: DataFrame, keys: list[str], order: str, image: str = "crop", height: int = 64) -> DataFrame:
    """(keys, sheet): each group's crops that can be read, in order, as one image; a group is a page's or a column's crops."""

    def sheet(frame: pd.DataFrame) -> pd.DataFrame:
        found = [x for x in map(unpack, frame.sort_values(order)[image]) if x is not None]
        return pd.DataFrame([(*frame[keys].iloc[0], pack(contact_sheet(found, height)) if found else None)], columns=[*keys, "sheet"])

    kinds = ", ".join(f"{k} {crops.schema[k].dataType.simpleString()}" for k in keys)
    return crops.select(*keys, order, image).groupBy(*keys).applyInPandas(sheet, f"{kinds}, sheet {IMAGE}")


def page_bands(tone: np.ndarray, least: float = STRICT) -> list[tuple[float, float]]:
    """(top, bottom) of the bands between a normalised page's rules. Rules within 24 pixels are one, those at the margin the frame; slivers are left out."""
    height, merged = len(tone), []
    for p, c in rules(tone, least):
        if merged and p - merged[-1][0] <= 24:
            merged[-1] = max(merged[-1], (p, c), key=lambda x: x[1])
        else:
            merged.append((p, c))
    edges = [0.0, *[p for p, _ in merged if 0.02 * height < p < 0.98 * height], float(height)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 0.1 * height]


def analyse_pages(image: Column, expected: int = 3) -> Column:
    """struct(pitch, confidence, profile, rules, bands, weak) of a page.

    Pitch and profile are those of the tallest band. Where two or more of the ``expected`` bands are
    missing, ``weak`` has the inner edges seen at a lower coverage, for ``layout.repair_bands``.
    """

    @F.pandas_udf("pitch double, confidence double, profile array<double>, rules array<struct<position:double,coverage:double,start:double,end:double>>, bands array<struct<top:double,bottom:double>>, weak array<double>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                pixels = unpack(row)
                if pixels is None:
                    out.append((None,) * 6)
                    continue
                tone = gray(pixels)
                bands = page_bands(tone)
                weak = {e for b in page_bands(tone, WEAK) for e in b if 0 < e < len(tone)} if len(bands) < expected - 1 else ()
                top, bottom = max(bands, key=lambda b: b[1] - b[0]) if bands else (0, len(tone))
                profile = ink_profile(tone[int(top) : int(bottom)])
                ruled = [dict(zip(("position", "coverage", "start", "end"), r, strict=True)) for r in rule_extents(tone)]
                out.append((*dominant_pitch(profile), profile.tolist(), ruled, [{"top": a, "bottom": b} for a, b in bands], sorted(weak)))
            yield pd.DataFrame(out, columns=["pitch", "confidence", "profile", "rules", "bands", "weak"])

    return run(image)


def ink_fraction(image: Column) -> Column:
    """The share of pixels darker by 25 than the image's median: under 2 per cent is a crop of nothing."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            tones = [unpack(r) for r in frame.to_dict("records")]
            yield pd.Series([None if t is None else float((gray(t) < np.percentile(gray(t), 50) - 25).mean()) for t in tones])

    return run(image)


def homography(corners: np.ndarray, width: float, height: float) -> np.ndarray:
    """The 3 by 3 matrix that takes four corners, clockwise from the upper left, to a rectangle."""
    target = np.array([(0, 0), (width, 0), (width, height), (0, height)], float)
    rows, values = [], []
    for (x, y), (u, v) in zip(corners, target, strict=True):
        rows += [(x, y, 1, 0, 0, 0, -u * x, -u * y), (0, 0, 0, x, y, 1, -v * x, -v * y)]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def transforms(corners: Column, width: float, height: float) -> Column:
    """struct(forward, inverse) of frames given as four points; null for corners that make no frame."""

    @F.pandas_udf("forward array<array<double>>, inverse array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for frames in batches:
            out = []
            for f in frames:
                try:
                    h = homography(np.stack([np.asarray(p, float) for p in f]), width, height)
                    out.append((h.tolist(), np.linalg.inv(h).tolist()))
                except (TypeError, ValueError, np.linalg.LinAlgError):
                    out.append((None, None))
            yield pd.DataFrame(out, columns=["forward", "inverse"])

    return run(corners)


def blob_box(image: np.ndarray, pad: int = 8) -> tuple[int, int, int, int] | None:
    """The box of the largest patch of colour, padded and kept on the page; none without colour."""
    if image.ndim != 3:
        return None
    mask = image.max(2).astype(int) - image.min(2) > CHROMA
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # each pixel takes the greatest label around it
        new = label.copy()
        for axis in (0, 1):
            for shift in (1, -1):
                moved = np.roll(label, shift, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if shift == 1 else -1
                moved[tuple(edge)] = 0
                new = np.maximum(new, moved)
        new = np.where(mask, new, 0)
        if (new == label).all():
            break
        label = new
    if not mask.any():
        return None
    names, counts = np.unique(label[mask], return_counts=True)
    ys, xs = np.nonzero(label == names[counts.argmax()])
    return max(int(xs.min()) - pad, 0), max(int(ys.min()) - pad, 0), min(int(xs.max()) + 1 + pad, image.shape[1]), min(int(ys.max()) + 1 + pad, image.shape[0])


def layout_families(pages: DataFrame, eps: float = 1.6, least: int = 5, bins: int = 64) -> DataFrame:
    """(page, family): pages by density of (4 times their bands, a profile of 64 bins); outliers are -1.

    A volume has a few hundred pages; one document is one task. Density reaches from core points,
    those with ``least`` neighbours within ``eps``, themselves included.
    """

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page")
        shapes = []
        for profile in frame["profile"]:
            p = np.asarray(profile, float)
            shapes.append(np.interp(np.linspace(0, max(len(p) - 1, 0), bins), np.arange(len(p)), p) if len(p) else np.zeros(bins))
        x = np.column_stack([4.0 * frame["bands"].to_numpy(float), np.array(shapes)])
        near = np.empty((len(x), len(x)), bool)
        for at in range(0, len(x), 64):  # a stripe of distances at a time
            near[at : at + 64] = ((x[at : at + 64, None] - x[None]) ** 2).sum(2) <= eps * eps
        core = near.sum(1) >= least
        label = np.where(core, np.arange(len(x)), len(x))
        while True:
            new = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
            if (new == label).all():
                break
            label = new
        reached = np.where(core, label, np.where(near & core[None], label[None], len(x)).min(1))
        names = {v: i for i, v in enumerate(dict.fromkeys(reached[reached < len(x)].tolist()))}
        return pd.DataFrame({"document_id": frame["document_id"], "page": frame["page"], "family": [names.get(v, -1) for v in reached.tolist()]})

    return pages.select("document_id", "page", "bands", "profile").groupBy("document_id").applyInPandas(cluster, "document_id string, page int, family int")
