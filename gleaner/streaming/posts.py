"""Structured Streaming forms: repeats, merges by micro-batch, sliding activity, rate limits in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drop_repeats(posts: DataFrame, keys: list[str], time: str = "published_at", late: str = "1 day") -> DataFrame:
    """The first of each key within the watermark."""
    return posts.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def activity(posts: DataFrame, time: str = "published_at", length: str = "7 days", slide: str = "1 day", late: str = "8 days") -> DataFrame:
    """Posts for each source in sliding windows."""
    return posts.withWatermark(time, late).groupBy(F.window(time, length, slide), "source_id").agg(F.count("*").alias("posts"))


def merge_batches(posts: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run merge on each micro-batch; merges are idempotent, so a batch may come twice.  Small tables are read anew inside merge."""
    return posts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(sent: DataFrame, minutes: int, most: int) -> DataFrame:
    """(user_id, event_id, ts, allowed): a send passes if fewer than `most` of the user's passed in the trailing minutes.

    sent: user_id, event_id, ts, in event time.  State holds the times of passed sends, at most `most` for a user.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            passed = [p for p in passed if p >= t - minutes * 60_000_000]
            allowed.append(len(passed) < most)
            if allowed[-1]:
                passed.append(int(t))
        state.update((passed,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "ts": rows["ts"], "allowed": allowed})

    return sent.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, ts timestamp, allowed boolean", "passed array<long>", "append", GroupStateTimeout.NoTimeout)
