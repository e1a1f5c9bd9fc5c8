"""Jobs of one key as a stream: while one is pending, another request for it only asks for one more run after it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A key is idle, pending, or pending with one more run asked for.
IDLE, PENDING, AGAIN = 0, 1, 2
#: Events of a bucket that one call of Python orders, as a call costs milliseconds.
BUCKET_EVENTS = 10_000


def step(state: int, submitted: bool) -> tuple[int, str]:
    """The next state, and what an event does."""
    if submitted:
        return min(state + 1, AGAIN), ("enqueued", "coalesced", "coalesced")[state]
    return max(state - 1, IDLE), ("ignored", "finished", "rerun")[state]


def buckets_for(expected: int) -> int:
    """Buckets for a stream that brings so many events at a time: a power of two, 64 at least."""
    return max(64, 1 << max(-(-expected // BUCKET_EVENTS) - 1, 0).bit_length())


def coalesced(events: DataFrame, buckets: int = 64) -> DataFrame:
    """(key, seq, action) of a stream of (key long, seq long, submitted boolean).

    The state of a key outlasts its micro-batch; within one its events go by ``seq``, and a batch's events are later than those before it.
    Keys are dealt to ``buckets``, whose number stays with a checkpoint: Python is called once for a bucket, whose state lists the keys that aren't idle.
    A bucket's events of one batch come in Arrow pieces, of which those of one batch are ordered together. Null keys are one key, a null ``submitted`` is none.
    """

    def run(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(bool(n), k): s for n, k, s in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["no_seq", "seq", "rank"], kind="stable")
        actions = []
        for key, rank in zip(zip(rows["no_key"].tolist(), rows["key"].tolist()), rows["rank"].tolist()):
            held[key], action = step(held.get(key, IDLE), rank == 1)
            actions.append(action)
        left = [(int(n), k, s) for (n, k), s in held.items() if s != IDLE]
        if left:
            state.update(tuple(map(list, zip(*left))))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": rows["key"], "no_key": rows["no_key"], "seq": rows["seq"], "no_seq": rows["no_seq"], "action": actions})

    # pandas has no null among whole numbers, and floats would round large ones
    told = events.select(
        F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().alias("no_key"), F.coalesce("seq", F.lit(0)).alias("seq"), F.col("seq").isNull().alias("no_seq"),
        F.coalesce(F.col("submitted").cast("int"), F.lit(2)).alias("rank"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"),
    )
    made = told.groupBy("bucket").applyInPandasWithState(run, "key long, no_key boolean, seq long, no_seq boolean, action string", "no_keys array<int>, keys array<long>, states array<int>", "append", GroupStateTimeout.NoTimeout)
    return made.select(F.when(~F.col("no_key"), F.col("key")).alias("key"), F.when(~F.col("no_seq"), F.col("seq")).alias("seq"), "action")
