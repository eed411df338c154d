"""Recognition as a plan: what has no answer yet goes to a named recogniser in batches, and every request gets an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import cache_key, model_key
from ..functions.watermarks import filter_watermark
from ..operators import relational

#: Requests of one call.
BATCH = 64
Recogniser = Callable[[list[dict]], list[dict]]
_known: dict[str, Callable[[], Recogniser]] = {}


def register(name: str, factory: Callable[[], Recogniser]) -> None:
    """A recogniser by name. Its factory runs where it is used, so what it loads is loaded there."""
    _known[name] = factory


def factory(name: str) -> Callable[[], Recogniser]:
    if name not in _known:
        raise KeyError(f"no recogniser {name}; there are {', '.join(sorted(_known)) or 'none'}")
    return _known[name]


def answer(rows: list[dict], recognise: Recogniser) -> list[dict]:
    """A row for each request at least: what a recogniser leaves out, or fails at, is an error; what it repeats is repeated."""
    try:
        found = recognise(rows)
    except Exception as e:  # a broken engine fails its batch, not the job
        found = [{"crop_id": r["crop_id"], "error": f"{type(e).__name__}: {e}"} for r in rows]
    seen = {f["crop_id"] for f in found}
    return [*found, *({"crop_id": r["crop_id"], "error": "no result"} for r in rows if r["crop_id"] not in seen)]


def recognise(requests: DataFrame, name: str, batch: int = BATCH) -> DataFrame:
    """(crop_id, text, confidence, error, unfiltered, removed) of requests (crop_id, path, content)."""
    make = factory(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for frame in frames:
            rows = frame.to_dict("records")
            for at in range(0, len(rows), batch):
                got = answer(rows[at : at + batch], engine)
                yield pd.DataFrame([(g["crop_id"], g.get("text"), g.get("confidence"), g.get("error")) for g in got], columns=["crop_id", "raw", "confidence", "error"])

    out = requests.mapInPandas(run, "crop_id string, raw string, confidence double, error string").withColumn("w", filter_watermark(F.col("raw")))
    return out.select("crop_id", "w.text", "confidence", "error", F.col("raw").alias("unfiltered"), F.col("w.removed").alias("removed"))


def on_demand(requests: DataFrame, answered: DataFrame, name: str, version: str, options: dict, tag: str = "", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answers in request order, answers that are new). ``requests``: position, crop_key, crop_id, path, content; ``answered``: cache_key, text, error.

    An answer holds for pixels, model, options and tag; ``force`` asks again. Nothing but misses is recognised.
    """
    keyed = requests.withColumn("cache_key", cache_key(F.col("crop_key"), F.lit(model_key(name, version, options)), F.lit(tag)))
    misses = relational.pending(keyed, answered, "cache_key", force)
    one = misses.groupBy("cache_key").agg(F.min_by(F.struct("crop_id", "path", "content"), "position").alias("r"))
    new = recognise(one.select("cache_key", "r.*").drop("cache_key"), name).join(one.select("cache_key", "r.crop_id"), "crop_id").select("cache_key", "text", "error")
    held = answered.select("cache_key", "text", "error")
    known = new if force else held.unionByName(new)
    return keyed.join(known, "cache_key", "left").select("position", "crop_id", "cache_key", "text", "error").orderBy("position"), new


def progress(total: Column, done: Column) -> Column:
    """An event of a recognition job as struct(type, stage, completed, total)."""
    stage = F.when(done >= total, "result").when(done > 0, "recognizing").otherwise("queued")
    return F.struct(F.when(done >= total, "result").otherwise("progress").alias("type"), stage.alias("stage"), done.alias("completed"), total.alias("total"))
