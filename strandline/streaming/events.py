"""Streams over files: counts by event time, the latest row of a key, and a run's sequence checked as it comes.

Each query reads what is there and stops (``availableNow``), so its result equals the batch one. The
state lies in the stream's checkpoint, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import shared_dir


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is a file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet."""
    spark = stream.sparkSession
    out = shared_dir(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _batches(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """As ``_drain``, for modes that a file can't take: each batch replaces the rows of its keys."""
    spark = stream.sparkSession
    out = shared_dir(spark, name)
    stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i:06d}")).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, event_type, n). Late rows of up to a day count; the day is that of the event."""
    events = file_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    days = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = _batches(days, "complete", "daily")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, n): each update carries a key's whole state, so the last one of a key speaks for it."""
    events = file_stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    state = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.count("*").alias("n"))
    out = _batches(state, "update", "latest")
    return out.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "n"), "batch").alias("r")).select("user_id", "r.*")


def pending_stream(work: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """A stream of work without what is already answered (a table)."""
    return work.join(answered.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sequence_stream(stream: DataFrame) -> DataFrame:
    """Steps of each band as its rows come in order: (band, value, before, kind). State: the last value.

    ``stream`` has band (string) and value (long); rows of one batch are taken by ``ordinal`` (long).
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ordinal")
        out = []
        for value in rows["value"].tolist():
            if last is not None and value != last + 1:
                out.append((key[0], value, last, "gap" if value > last + 1 else "non_monotonic"))
            last = value
        state.update((last,))
        yield pd.DataFrame(out, columns=["band", "value", "before", "kind"])

    return stream.groupBy("band").applyInPandasWithState(check, "band string, value long, before long, kind string", "last long", "append", GroupStateTimeout.NoTimeout)


def progress_percent(stage: Column, completed: Column, total: Column) -> Column:
    """A tenth for preparing, the rest for recognising, 99.9 at most until the end."""
    share = F.when(total > 0, completed / total).otherwise(F.lit(0.0))
    return F.when(stage == "queued", 0.0).when(stage == "preparing", F.least(share * 10, F.lit(99.9))).when(stage == "recognizing", F.least(10 + share * 90, F.lit(99.9))).when(stage.isin("done", "result"), 100.0)


def decode_ndjson(chunks: Iterator[bytes]) -> Iterator[str]:
    """Lines out of chunks cut anywhere, even within a character; the last may lack its end."""
    held = b""
    for chunk in chunks:
        *lines, held = (held + chunk).split(b"\n")
        yield from (x.decode() for x in lines if x.strip())
    if held.strip():
        yield held.decode()
