"""Streams over the event table's shape: event_id, ts, user_id, event_type, value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder; the checkpoint keeps what was read."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of tumbling windows, or sliding ones."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", tasks: int | None = None) -> DataFrame:
    """The last event of each burst of a user. With `tasks`, users are dealt to so many before their events are sorted, not after; if it is also the
    session's number of shuffle partitions, that is the only shuffle."""
    dealt = events.select("user_id", "ts", "event_id").withWatermark("ts", late)
    dealt = dealt if tasks is None else dealt.repartition(tasks, "user_id")
    return dealt.groupBy(F.session_window("ts", gap), "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_values(batch: DataFrame) -> DataFrame:
    """Per user and type the newest value; for foreachBatch into a keyed table."""
    return batch.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of a micro-batch, by time."""
    return pd.concat(list(parts)).sort_values(["ts", "event_id"])


def changes(events: DataFrame) -> DataFrame:
    """Events whose content (event_type) differs from the one before of their user; the last content is the state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(parts)
        before = state.get[0] if state.exists else None
        was = rows["event_type"].shift()
        was.iloc[0] = before
        state.update((rows["event_type"].iloc[-1],))
        yield rows[rows["event_type"] != was][["user_id", "event_id"]]

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last string", "append", GroupStateTimeout.NoTimeout)


def recent_names(events: DataFrame, most: int = 1000) -> DataFrame:
    """(user_id, at, n, oldest): after each batch, how many names a user's window of the last `most` holds, and the oldest of them."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(parts)
        held = (list(state.get[0]) if state.exists else []) + rows["event_type"].tolist()
        held = held[-most:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "at": [rows["event_id"].iloc[-1]], "n": [len(held)], "oldest": [held[0]]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, at long, n int, oldest string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def batches(events: DataFrame, most: int = 50, idle: str = "30 seconds") -> DataFrame:
    """(user_id, part, n, last): work that is triggered by `most` waiting events, or by a pause. The state is what waits; the clock is the
    events' own, so a run over old events triggers as it did then."""
    pause = pd.Timedelta(idle).total_seconds()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last, part, at = state.get if state.exists else (0, -1, 0, None)
        out = []
        for ts, event in zip(*(lambda r: (r["ts"].map(pd.Timestamp.timestamp), r["event_id"]))(_in_order(parts)), strict=True):
            if waiting and ts - at > pause:
                out.append((key[0], part, waiting, last))
                waiting, part = 0, part + 1
            waiting, last, at = waiting + 1, int(event), ts
            if waiting == most:
                out.append((key[0], part, waiting, last))
                waiting, part = 0, part + 1
        state.update((waiting, last, part, at))
        yield pd.DataFrame(out, columns=["user_id", "part", "n", "last"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, part int, n int, last long", "waiting int, last long, part int, at double", "append", GroupStateTimeout.NoTimeout)


def run(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Processes what there is, in append mode, and stops."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, write, checkpoint: str, mode: str = "append", tasks: int | None = None) -> None:
    """Calls write(batch, number) for each micro-batch, one after the other, and stops. State is dealt to `tasks`, or as the session says; its own setting
    is put back."""
    spark, name = df.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, tasks or before)
    try:
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
