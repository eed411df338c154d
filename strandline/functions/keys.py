"""Content addresses and readable keys."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that no file name may hold everywhere, and names that are devices somewhere.
UNFIT = '<>:"/\\|?*'
DEVICES = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
ID_BYTES = 200


def id_problem(value: str | None) -> str | None:
    """Why a document id can't be part of a file's name on every system, or none; the first reason counts."""
    checks = (
        (not value, "empty"),
        (value and (value != value.strip() or value[0] == "." or value[-1] == "."), "white space or a full stop at an end"),
        (value and not unicodedata.is_normalized("NFC", value), "not composed (NFC)"),
        (value and len(value.encode()) > ID_BYTES, f"over {ID_BYTES} bytes"),
        (value and any(c in UNFIT or c < " " for c in value), "a character that file names can't hold"),
        (value and value.partition(".")[0].upper() in DEVICES, "a device's name"),
    )
    return next((said for wrong, said in checks if wrong), None)


def document_id_problem(value: Column) -> Column:
    """``id_problem`` of a column of ids: normal forms need Unicode's tables, which SQL functions don't offer."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield ids.map(id_problem).astype(object)

    return run(value)


def _digest(parts: list[Column], size: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, size)


def centi(value: Column) -> Column:
    """A coordinate with two decimals, exact halves to the even hundredth, as text. Exact for what doubles hold below 2^46."""
    cents = F.bround(value * 100, 0).cast("long")
    whole = F.floor(F.abs(cents) / 100).cast("long")
    return F.concat(F.when(cents < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def geometry_hash(document: Column, page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """16 hex digits of a box on a page, its coordinates with two decimals."""
    return _digest([document, page, *[centi(x) for x in (x0, y0, x1, y1)]], 16)


def crop_key(document: Column, page: Column, box: list[Column], variant: Column, variant_version: Column, checksum: Column, cutter: Column) -> Column:
    """16 hex digits of the pixels that a crop holds; box edges are cut to whole pixels."""
    return _digest([document, page, *[x.cast("int") for x in box], variant, variant_version, checksum, cutter], 16)


def model_key(backend: str, version: str, options: dict) -> str:
    """Names a model and its options, whatever their order."""
    return f"{backend}:{version}:{hashlib.sha256(json.dumps(options, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]}"


def cache_key(crop: Column, model: Column, tag: Column) -> Column:
    return _digest([crop, model, tag], 24)


def person_key(label: Column, value: Column) -> Column:
    """A numbered person; a family known by name has another separator, so the two never meet."""
    return F.concat(label, F.lit(":"), value.cast("string"))


def named_key(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit("#"), name)


def crop_id(document: Column, page: Column, band: Column, entry: Column, context: Column) -> Column:
    """The positional name of a crop's file."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(document, F.lit("_p"), pad(page, 4), F.lit("_b"), band.cast("string"), F.lit("_e"), pad(entry, 2), F.lit("_"), context)


def crop_position(name: Column) -> Column:
    """struct(page, band, entry) out of a crop's name; null if it isn't one."""
    pattern = r"_p(\d{4})_b(\d+)_e(\d{2,})_[a-z]+$"
    at = lambda i: F.regexp_extract(name, pattern, i).try_cast("int")
    return F.when(name.rlike(pattern), F.struct(at(1).alias("page"), at(2).alias("band"), at(3).alias("entry")))
