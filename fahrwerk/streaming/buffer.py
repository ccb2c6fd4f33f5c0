"""Streaming: per-device buffers that flush by count, and windows in event time."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK = "dev long, chunk long, n long, first long, last long, total double"


def chunks(records: DataFrame, size: int) -> DataFrame:
    """Batch form: records (dev, t, value) of a device in order, in chunks of ``size``; the last may be short (a forced flush)."""
    w = Window.partitionBy("dev").orderBy("t", "value")
    c = records.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    return c.groupBy("dev", "chunk").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("value").alias("total"))


def flush_by_count(records: DataFrame, size: int, idle: int | None = None) -> DataFrame:
    """Streaming form: a chunk as soon as a device has ``size`` records; what is left waits in its state.

    A record without a time is an order to flush what waits, however little.
    With ``idle`` (milliseconds) what has waited that long without a new record
    is flushed, too.  A device's state holds fewer than ``size`` records, the
    rest of a batch passes through; records of one batch are taken in order
    of time, before its order to flush.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, times, values = state.get if state.exists else (0, [], [])
        rows, force = list(zip(times, values, strict=True)), state.hasTimedOut
        new = []
        for b in batches:
            known = b["t"].notna()
            force = force or not known.all()
            new += zip(b.loc[known, "t"].astype("int64").tolist(), b.loc[known, "value"].tolist(), strict=True)
        rows = sorted(rows) + sorted(new)
        out, at = [], 0
        while len(rows) - at >= size or (force and at < len(rows)):
            part = rows[at : at + size]
            at += len(part)
            out.append((key[0], done, len(part), part[0][0], part[-1][0], sum(v for _, v in part)))
            done += 1
        state.update((done, [t for t, _ in rows[at:]], [v for _, v in rows[at:]]))
        if idle is not None and at < len(rows):
            state.setTimeoutDuration(idle)
        if out:
            yield pd.DataFrame(out, columns=["dev", "chunk", "n", "first", "last", "total"])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return records.groupBy("dev").applyInPandasWithState(run, CHUNK, "done long, t array<long>, v array<double>", "append", timeout)


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and means per device and time window, with a bound on late records (an addition, for streams)."""
    w = events.withWatermark("t", late).groupBy("dev", F.window("t", length))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("dev", F.col("window.start").alias("start"), "n", "mean")


def write_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """A sink for foreachBatch: a batch that is written again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


POINTER = "run_id long, rid long, t long, ego long"


def pointer_walk(rows: DataFrame) -> DataFrame:
    """The pointer walk of ``joins.asof_pointer`` on a stream of rows (run_id, t, rid), where an ego time has no rid.

    A row is decided once an ego time after it has come; until then it waits
    in its run's state.  Times of a run come in order, batch by batch: so a
    pointer behind which two ego times have come before the next row stays
    for good, and of the ego times before a run's first row only the last two
    matter.  So a run's state holds two ego times at most, beside the rows
    that came since the last one; once the pointer stays, it holds one, and
    rows are decided at once.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, stays, egos, ts, ids = state.get if state.exists else (False, False, [], [], [])
        egos, waiting = list(egos), list(zip(ts, ids, strict=True))
        for b in batches:
            ego = b["rid"].isna()
            if not stays:
                egos += b.loc[ego, "t"].tolist()
            waiting += list(zip(b.loc[~ego, "t"].tolist(), b.loc[~ego, "rid"].astype("int64").tolist(), strict=True))
        egos.sort()
        waiting.sort()
        out, at, spot = [], 0, 0
        while at < len(waiting) and egos and (stays or egos[-1] > waiting[at][0]):
            t, rid = waiting[at]
            at += 1
            if not begun:  # the latest time strictly before the first row, or the first
                begun, spot = True, max(bisect.bisect_left(egos, t) - 1, 0)
            if not stays and spot + 1 < len(egos) and egos[spot] < t < egos[spot + 1]:
                spot += 1
            out.append((key[0], rid, t, egos[spot]))
        waiting = waiting[at:]
        if begun and not stays and spot + 1 < len(egos):  # what comes is not before the last ego time
            stays = True
            out += [(key[0], rid, t, egos[spot]) for t, rid in waiting]
            waiting = []
        egos = (egos[spot : spot + 1] if begun else egos[-2:]) if egos else []
        state.update((begun, stays, egos, [t for t, _ in waiting], [i for _, i in waiting]))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "rid", "t", "ego"])

    return rows.groupBy("run_id").applyInPandasWithState(run, POINTER, "begun boolean, stays boolean, egos array<long>, ts array<long>, ids array<long>", "append", GroupStateTimeout.NoTimeout)
