"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.functions.urls import normalize_url
from quillmark.operators.quota import accept, progress
from quillmark.operators.scoring import page_scores


def live_quota(events: DataFrame, most: int, window_s: int) -> DataFrame:
    """N1 on a stream (key string, at timestamp, event_id long): the state is at most ``most`` times a key.

    Within a micro-batch events go by time; an event older than what a key's state
    has seen is judged against that state, as in the order of arrival.
    """

    def judge(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])  # one micro-batch of one key
        got = list(accept(iter(rows["t"]), most, window_s, held))
        state.update((list(held),))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "accepted": [a for a, _ in got], "retry_after": [w for _, w in got]})

    rows = events.select("key", F.col("at").cast("double").alias("t"), "event_id")
    return rows.groupBy("key").applyInPandasWithState(judge, "key string, event_id long, accepted boolean, retry_after double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


#: States of a run that end it.
ENDED = ("done", "failed", "cancelled")


def live_stalled(beats: DataFrame, grace_s: int = 35 * 60, forget_s: int = 7 * 86_400) -> DataFrame:
    """Runs (scan_id, at, status) without a sign of life for the grace period, in event time: scan_id, beats, failed_at.

    The state of a run is its last sign of life, how many there were, and whether it has
    ended. A timer at the end of the grace period reports it, unless the run has ended by
    then; a sign of life after that arms it anew, an end is never reported. What has ended
    or was reported is forgotten after ``forget_s`` more.
    """

    def watch(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, many, over = state.get if state.exists else (0, 0, False)
        if state.hasTimedOut:
            if over:
                state.remove()
                return
            state.update((last, many, True))
            state.setTimeoutTimestamp(max(last + 1000 * (grace_s + forget_s), state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"scan_id": [key[0]], "beats": [many], "t": [last + 1000 * grace_s]})
            return
        newest, at = over, last
        for p in parts:
            many += len(p)
            # of signs at the same time the end counts
            for t, ended in sorted(zip(p["t"].tolist(), p["ended"].tolist(), strict=True)):
                if t > at or (t == at and ended):
                    at, newest = t, ended
        state.update((at, many, newest))
        due = at + 1000 * (grace_s + (forget_s if newest else 0))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = beats.withWatermark("at", "0 seconds").select("scan_id", "at", F.unix_millis("at").alias("t"), F.col("status").isin(*ENDED).alias("ended"))
    found = rows.groupBy("scan_id").applyInPandasWithState(watch, "scan_id long, beats long, t long", "last long, many long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("scan_id", "beats", F.timestamp_millis("t").alias("failed_at"))


def live_dedupe_links(links: DataFrame, keep: str | None = None) -> DataFrame:
    """Each normalised URL (url, at) once. The state is the URLs seen; ``keep`` forgets those of which the watermark is so much older."""
    rows = links.withColumn("url", normalize_url(F.col("url")))
    return rows.dropDuplicates(["url"]) if keep is None else rows.withWatermark("at", keep).dropDuplicatesWithinWatermark(["url"])


def live_page_scores(findings: DataFrame, pages: DataFrame, write: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Pages are scored when their findings arrive: each micro-batch (the whole findings of its pages) joins the stored pages, and ``write`` upserts the scores."""

    def score(batch: DataFrame, batch_id: int) -> None:
        seen = pages.join(batch.select("scan_id", "page_id").distinct(), ["scan_id", "page_id"], "left_semi")
        write(page_scores(seen, batch))

    return findings.writeStream.outputMode("append").foreachBatch(score)


def live_scores_table(findings: DataFrame, pages: DataFrame, folder: str) -> DataStreamWriter:
    """N5, exactly once: a page's scores follow all its findings, however they are spread over micro-batches.

    Findings and scores are partitioned by run and micro-batch, and a batch replaces only
    its own partitions: one that is replayed after a failure writes what it wrote before.
    ``current_scores`` gives each page's scores of the last batch that it was in.
    """

    def keep(df: DataFrame, name: str, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id", "batch").parquet(f"{folder}/{name}")

    def score(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        keep(batch, "findings", batch_id)
        told = batch.select("scan_id", "page_id").distinct()
        # by the partitions of the batch's runs alone; later batches are no part of a replay
        stored = batch.sparkSession.read.parquet(f"{folder}/findings").where(F.col("batch") <= batch_id).drop("batch").select(*batch.columns).join(told, ["scan_id", "page_id"], "left_semi")
        keep(page_scores(pages.join(told, ["scan_id", "page_id"], "left_semi"), stored), "scores", batch_id)

    return findings.writeStream.outputMode("append").foreachBatch(score)


def current_scores(scores: DataFrame) -> DataFrame:
    """Of the table that ``live_scores_table`` keeps: the newest row of each page."""
    rest = [c for c in scores.columns if c not in ("scan_id", "page_id", "batch")]
    newest = scores.groupBy("scan_id", "page_id").agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return newest.select("scan_id", "page_id", "s.*")


def live_progress(events: DataFrame) -> DataFrame:
    """Running counts of each run (scan_id, kind), for update mode."""
    return progress(events)
