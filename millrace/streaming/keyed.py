"""Keyed streams judged in event-time order: liveness, step rate, quorum, worker sets.

Rows may come in any order within ``delay``. :class:`InOrder` holds them in the state of
their key until the watermark has passed them, then hands them on sorted, a frame at a time,
so that what a stream says does not depend on how its rows were cut into batches. Timers
bring up what follows from silence, and remove a key that has nothing more to say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.operators.ledger import OFFLINE_AFTER_S

#: A key is forgotten when nothing was heard of it for so long.
FORGET_S = 7 * 86400.0
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Buffer, sort, apply.

    ``fold(key, state, rows, mark)`` gets the state (None for a new key), the rows that the
    watermark ``mark`` has passed, sorted by ``order`` (none when a timer is due), and
    returns the new state, the rows to emit (or None) and the time at which it wants to be
    called even without rows (or None). Times are microseconds; the first column of the
    rows is their time.
    """

    def __init__(self, row: str, order: list[str], state: str, fold: Callable, forget_us: int):
        self.row, self.order, self.state, self.fold, self.forget_us = row, order, state, fold, forget_us
        self.columns = [c.split()[0] for c in row.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.kept = handle.getValueState("kept", self.state)
        # When the next timer fires (ms), and up to when the key has been heard of (us).
        self.clock = handle.getValueState("clock", "due bigint, heard bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)[self.columns]
        times = fresh[self.columns[0]]
        self.waiting.appendList([tuple(_plain(v) for v in r) for r in fresh.itertuples(index=False)])
        due, heard = self.clock.get() if self.clock.exists() else (0, 0)
        self._wake(due, int(times.min()), max(heard, int(times.max())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, heard = self.clock.get()
        if expiredTimerInfo.getExpiryTimeInMs() != due:
            return  # another timer has taken its place
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.columns)
        passed = held[self.columns[0]].to_numpy("int64") < mark
        ready, rest = held[passed].sort_values(self.order, kind="stable"), held[~passed]
        state, out, wish = self.fold(key, self.kept.get() if self.kept.exists() else None, ready, mark)
        if len(ready):
            self.waiting.clear()
            if len(rest):
                self.waiting.put([tuple(_plain(v) for v in r) for r in rest.itertuples(index=False)])
        if not len(rest) and heard + self.forget_us < mark:
            for part in (self.waiting, self.kept, self.clock):
                part.clear()
        else:
            if state is not None:
                self.kept.update(state)
            soonest = [int(rest[self.columns[0]].min())] if len(rest) else []
            soonest += [wish] if wish is not None else []
            self._wake(0, min([*soonest, heard + self.forget_us]), heard)
        if out is not None and len(out):
            yield out

    def _wake(self, due: int, at_us: int, heard: int) -> None:
        """Have a timer at the first watermark past ``at_us``, in place of a later one."""
        at = at_us // 1000 + 1
        if due and due <= at:
            self.clock.update((due, heard))
            return
        if due:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        self.clock.update((at, heard))

    def close(self) -> None:
        pass


def _plain(v):
    """Values as the state store takes them."""
    if isinstance(v, (np.ndarray, list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    return None if v is None or v is pd.NaT or v != v else v


def in_order(
    rows: DataFrame, key: str, ts: Column, delay: str, columns: dict[str, Column], types: dict[str, str],
    order: list[str], state: str, output: str, fold: Callable, forget_s: float,
) -> DataFrame:
    """The stream ``rows`` through an :class:`InOrder` of each ``key``. The first of
    ``columns`` is the time in microseconds, as ``ts`` has it."""
    spark = rows.sparkSession
    if spark.conf.get(_STORE, None) != _ROCKS:  # state of several kinds needs this store
        spark.conf.set(_STORE, _ROCKS)
    timed = rows.select(F.col(key), ts.alias("_at"), *[c.alias(n) for n, c in columns.items()])
    timed = timed.where(F.col(key).isNotNull() & F.col("_at").isNotNull()).withWatermark("_at", delay)
    row = ", ".join(f"{c} {t}" for c, t in types.items())
    processor = InOrder(row, order, state, fold, int(forget_s * 1_000_000))
    return timed.groupBy(key).transformWithStateInPandas(processor, output, "append", "EventTime")


# -- liveness -----------------------------------------------------------------


def node_liveness(
    beats: DataFrame, timeout_s: float = OFFLINE_AFTER_S, delay: str = "1 minute", forget_s: float = FORGET_S
) -> DataFrame:
    """ONLINE when a node first beats or returns, OFFLINE once it has been silent for
    ``timeout_s``. ``beats``: ``node_id, ts[, pools]``; pools change only when stated. A node
    silent for ``forget_s`` as well is forgotten with its pools."""
    limit = int(timeout_s * 1_000_000)

    def fold(key, state, rows: pd.DataFrame, mark: int):
        last, online, pools = state or (0, False, None)
        if state is None and not len(rows):
            return None, None, None
        out, times = [], rows["ts_us"].to_numpy("int64")
        if len(times):
            stated = rows["pools"].tolist()
            before = np.concatenate([[last], times[:-1]])
            fell = times - before >= limit
            fell[0] = online and fell[0]
            came = fell.copy()
            came[0] = came[0] or not online
            named = np.flatnonzero([p is not None for p in stated])
            for k in np.flatnonzero(came):
                upto = named[named <= k]
                now = list(stated[upto[-1]]) if len(upto) else pools
                if fell[k]:
                    earlier = named[named < k]
                    out.append((key[0], int(before[k]) + limit, "OFFLINE", list(stated[earlier[-1]]) if len(earlier) else pools))
                out.append((key[0], int(times[k]), "ONLINE", now))
            if len(named):
                pools = list(stated[named[-1]])
            last, online = int(times[-1]), True
        if online and last + limit < mark:
            out.append((key[0], last + limit, "OFFLINE", pools))
            online = False
        frame = pd.DataFrame(out, columns=["node_id", "ts_us", "change", "pools"])
        return (last, online, pools), frame, last + limit if online else None

    pools = F.col("pools") if "pools" in beats.columns else F.lit(None).cast("array<string>")
    return in_order(
        beats, "node_id", F.col("ts"), delay, {"ts_us": F.unix_micros("ts"), "pools": pools},
        {"ts_us": "bigint", "pools": "array<string>"}, ["ts_us"], "last bigint, online boolean, pools array<string>",
        "node_id string, ts_us bigint, change string, pools array<string>", fold, max(forget_s, timeout_s),
    )


# -- step rate ----------------------------------------------------------------


def stream_step_rate(beats: DataFrame, delay: str = "1 minute", forget_s: float = FORGET_S) -> DataFrame:
    """Steps per second of each run between one beat and the next; only real progress
    gives a row. ``beats``: ``run_id, ts`` (seconds)``, step``. A run silent for ``forget_s``
    starts anew."""

    def fold(key, state, rows: pd.DataFrame, mark: int):
        if not len(rows):
            return state, None, None
        ts, at = rows["ts"].to_numpy("float64"), rows["step"].to_numpy("int64")
        if state is not None:
            ts, at = np.concatenate([[state[0]], ts]), np.concatenate([[state[1]], at])
        gap, gain = np.diff(ts), np.diff(at)
        real = (gap > 0) & (gain > 0)
        out = pd.DataFrame({"run_id": key[0], "ts": ts[1:][real], "step": at[1:][real], "rate": gain[real] / gap[real]})
        return (float(ts[-1]), int(at[-1])), out, None

    us = (F.col("ts") * 1_000_000).cast("bigint")
    return in_order(
        beats.where(F.col("step").isNotNull()), "run_id", F.timestamp_micros(us), delay,
        {"ts_us": us, "ts": F.col("ts").cast("double"), "step": F.col("step").cast("bigint")},
        {"ts_us": "bigint", "ts": "double", "step": "bigint"}, ["ts", "step"], "ts double, step bigint",
        "run_id string, ts double, step bigint, rate double", fold, forget_s,
    )


# -- quorum -------------------------------------------------------------------


def close_rounds(
    commits: DataFrame, m: int, timeout_s: float, delay: str = "1 minute", forget_s: float = FORGET_S
) -> DataFrame:
    """Close each round at its ``m``-th commit: ``participant`` rows up to that instant,
    ``late`` rows after, and one ``quorum_not_met`` row when ``timeout_s`` passes first.

    ``commits``: ``round, key, ts``, each key once per round. A round is forgotten when
    ``forget_s`` have passed since its last commit and its end.
    """
    limit = int(timeout_s * 1_000_000)

    def fold(key, state, rows: pd.DataFrame, mark: int):
        first, seen, closed, failed = state or (0, 0, 0, False)
        if state is None and not len(rows):
            return None, None, None
        times, names = rows["ts_us"].to_numpy("int64"), rows["key"].to_numpy(object)
        if not first:
            first = int(times[0])
        kinds = np.full(len(times), "late", object)
        out = []
        if not closed:
            inside = times < first + limit
            count = seen + np.cumsum(inside)
            enough = np.flatnonzero(inside & (count >= m))
            if len(enough):
                closed = int(times[enough[0]])
            elif mark > first + limit:
                closed, failed = first + limit, True
                out.append((key[0], None, closed, "quorum_not_met"))
            seen += int(inside.sum())
            kinds[(times <= closed) & inside if closed else inside] = "participant"
        elif not failed:  # a commit at the very instant of the m-th one is part of the round
            kinds[times <= closed] = "participant"
        out.extend(zip([key[0]] * len(times), names, times.tolist(), kinds))
        frame = pd.DataFrame(out, columns=["round", "key", "ts_us", "kind"])
        return (first, seen, closed, failed), frame, None if closed else first + limit

    return in_order(
        commits.withColumn("round", F.col("round").cast("bigint")), "round", F.col("ts"), delay,
        {"ts_us": F.unix_micros("ts"), "key": F.col("key")}, {"ts_us": "bigint", "key": "string"}, ["ts_us", "key"],
        "first bigint, seen bigint, closed bigint, failed boolean",
        "round bigint, key string, ts_us bigint, kind string", fold, max(forget_s, timeout_s),
    )


# -- worker sets --------------------------------------------------------------


def worker_changes(snapshots: DataFrame, delay: str = "1 minute", forget_s: float = FORGET_S) -> DataFrame:
    """Workers lost and replaced between snapshots of a job, with the job state that
    follows: RECOVERING after a loss, RUNNING again after a replacement.

    ``snapshots``: ``job_id, ts, seq, workers ARRAY<STRING>``, the sequence in the order of
    time. State is one set of worker names per job, until ``forget_s`` without a snapshot.
    """

    def fold(key, state, rows: pd.DataFrame, mark: int):
        workers = set(state[0]) if state else None
        out = []
        for seq, now in zip(rows["seq"].tolist(), map(set, rows["workers"])):
            if workers is not None:
                out += [(key[0], seq, w, "RAY_WORKER_LOST", "RECOVERING") for w in sorted(workers - now)]
                out += [(key[0], seq, w, "RAY_WORKER_REPLACED", "RUNNING") for w in sorted(now - workers)]
            workers = now
        frame = pd.DataFrame(out, columns=["job_id", "seq", "worker", "type", "job_state"])
        return (None if workers is None else (sorted(workers),)), frame, None

    return in_order(
        snapshots, "job_id", F.col("ts"), delay,
        {"ts_us": F.unix_micros("ts"), "seq": F.col("seq").cast("bigint"), "workers": F.col("workers")},
        {"ts_us": "bigint", "seq": "bigint", "workers": "array<string>"}, ["ts_us", "seq"], "workers array<string>",
        "job_id string, seq bigint, worker string, type string, job_state string", fold, forget_s,
    )
