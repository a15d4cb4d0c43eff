"""Admission by a sliding window per client (OP-ST01), over a table and over a stream.

A hit at time t is admitted if fewer than `limit` admitted hits lie after t - window; denied hits
don't count. Either form keeps at most `limit` times for a client, so a hot client's hits pass
through a task in order but are never held there.

A hit without a client or a time is denied. In the stream, hits of one client are put in order
within a micro-batch only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000


def verdicts(times: list[int], recent: deque, window: int, limit: int) -> list[bool]:
    """For each time, in order, whether it is admitted; recent holds the admitted times that still count."""
    out = []
    for t in times:
        while recent and recent[0] <= t - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def hits(rows: DataFrame, client: str, ts: str, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col(client).cast("string").alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))


def admitted(rows: DataFrame, client: str, ts: str, key: str, window_s: int, limit: int) -> DataFrame:
    """id, client, allowed: one row for each of rows; ties in time go by id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, deque()
        for batch in batches:
            allowed = [False] * len(batch)
            for i, (who, at) in enumerate(zip(batch["client"], batch["at"])):
                if who is None or pd.isna(at):
                    continue
                if who != last:
                    last, recent = who, deque()
                allowed[i] = verdicts([int(at)], recent, window_s * MICRO, limit)[0]
            yield pd.DataFrame({"id": batch["id"], "client": batch["client"], "allowed": allowed})

    dealt = hits(rows, client, ts, key).repartition("client").sortWithinPartitions("client", "at", "id")
    return dealt.mapInPandas(run, "id long, client string, allowed boolean")


def admitted_stream(rows: DataFrame, client: str, ts: str, key: str, window_s: int, limit: int) -> DataFrame:
    """admitted() of a stream, in append mode."""

    def run(group, batches, state) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0]) if state.exists else deque()
        batch = pd.concat(list(batches)).sort_values(["at", "id"])
        allowed = verdicts(batch["at"].tolist(), recent, window_s * MICRO, limit)
        state.update((list(recent),))
        yield pd.DataFrame({"id": batch["id"], "client": group[0], "allowed": allowed})

    known = hits(rows, client, ts, key).where("client is not null and at is not null")
    return known.groupBy("client").applyInPandasWithState(run, "id long, client string, allowed boolean", "recent array<long>", "append", "NoTimeout")
