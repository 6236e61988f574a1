"""Quotas and progress over event time: batch twins of the streaming operators (N)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accept(times: Iterator[float], most: int, window: float, held: deque | None = None) -> Iterator[tuple[bool, float]]:
    """For each time in order whether a hit is accepted, and the seconds until the next would be."""
    held = deque() if held is None else held
    for t in times:
        while held and held[0] <= t - window:
            held.popleft()
        if len(held) < most:
            held.append(t)
            yield True, 0.0
        else:
            yield False, held[0] + window - t


def sliding_quota(events: DataFrame, most: int, window_s: int) -> DataFrame:
    """Accept an event if fewer than ``most`` of its key were accepted in the last ``window_s`` seconds.

    ``events`` has key, at and event_id. Keys stream through sorted partitions; the
    state of a key is at most ``most`` times, however many events it has. Null keys
    are one key; null times come first and count as time 0.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = object(), deque()
        for pdf in batches:
            ok, wait = [], []
            for k, t in zip(pdf["key"].where(pdf["key"].notna(), None), pdf["t"], strict=True):
                if k != key:
                    key, held = k, deque()
                a, w = next(accept(iter((t,)), most, window_s, held))
                ok.append(a)
                wait.append(w)
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "accepted": ok, "retry_after": wait})

    rows = events.select("key", F.coalesce(F.col("at").cast("timestamp").cast("double"), F.lit(0.0)).alias("t"), "event_id")
    kind = dict(rows.dtypes)
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(judge, f"key {kind['key']}, event_id {kind['event_id']}, accepted boolean, retry_after double")


def progress(events: DataFrame) -> DataFrame:
    """Errors and other events of each run; works on a stream in update mode too."""
    return events.groupBy("scan_id").agg(F.count_if(F.col("kind") == "error").alias("errored"), F.count_if(F.col("kind") != "error").alias("crawled"))
