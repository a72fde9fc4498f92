"""Operators with state of their own per key, on transformWithStateInPandas in event time (RocksDB state store).

Rows of one key in a batch come in any order, so each processor sorts them by time first.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugework.model import SERIES
from gaugework.operators.filters import keep_last_n
from gaugework.streaming.queries import DELAY, event_time, stream_earliest_alerts  # noqa: F401 (found here before it was an aggregate)


def _ms(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    own = list(rows)
    return pd.concat(own).sort_values(["ts", "seq"]) if own else pd.DataFrame({"ts": [], "seq": []})


def _frame(**columns) -> Iterator[pd.DataFrame]:
    """One frame of these columns, text as plain objects; none if they are empty."""
    made = {k: pd.Series(list(v), dtype=object) if k in ("host_id", "metric", "rule_id", "state", "status", "kind") else pd.Series(v) for k, v in columns.items()}
    if any(map(len, made.values())):
        yield pd.DataFrame(made)


class Liveness(StatefulProcessor):
    """offline once a host is silent for the timeout, healthy again with the next heartbeat."""

    def __init__(self, timeout_s: int):
        self.timeout_ms = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long, offline boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = _sorted(rows)
        last, offline = self.last.get() if self.last.exists() else (None, False)
        out = []
        for t in map(_ms, seen["ts"]):
            if offline or (last is not None and t - last > self.timeout_ms):
                if not offline:
                    out.append((last + self.timeout_ms, "offline"))
                out.append((t, "healthy"))
                offline = False
            last = t if last is None else max(last, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last, offline))
        if not offline:
            self.handle.registerTimer(last + self.timeout_ms)
        yield from _frame(host_id=[key[0]] * len(out), ts=pd.to_datetime([x for x, _ in out], unit="ms"), state=[s for _, s in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.update((last, True))
        yield from _frame(host_id=[key[0]], ts=[_time(last + self.timeout_ms)], state=["offline"])

    def close(self) -> None:
        pass


def stream_liveness(samples: DataFrame, timeout_s: int = 300, delay: str = DELAY) -> DataFrame:
    rows = event_time(samples, delay).select("host_id", "ts", "seq")
    return rows.groupBy("host_id").transformWithStateInPandas(
        Liveness(timeout_s), "host_id string, ts timestamp, state string", "Append", "EventTime"
    )


class Sustained(StatefulProcessor):
    """firing once a breach has lasted the rule's duration, resolved with the first sample that doesn't breach."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "start long, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, fired = self.run.get() if self.run.exists() else (None, False)
        own = _sorted(rows)
        if own.empty:
            return
        t, breach = own["ts"].to_numpy("datetime64[ms]").astype(np.int64), own["breach"].eq(True).to_numpy(bool)
        run = np.cumsum(~breach)  # a sample that doesn't breach ends a run; the run before the first is the one carried over
        opens = breach & ~np.append(start is not None, breach[:-1])
        at = np.maximum.accumulate(np.where(opens, np.arange(len(t)), -1))
        since = np.where(at >= 0, t[at], 0 if start is None else start)
        due = np.flatnonzero(breach & (t - since >= own["duration_s"].to_numpy(np.int64) * 1000))
        runs, first = np.unique(run[due], return_index=True)
        new = ~((runs == 0) & fired)
        firing, fires = due[first[new]], np.append(runs, 0) if fired else runs
        resolved = np.flatnonzero(~breach & np.isin(run - 1, fires))
        out = sorted([(int(t[k]), int(k), "firing") for k in firing] + [(int(t[k]), int(k), "resolved") for k in resolved])
        if breach[-1]:
            self.run.update((int(since[-1]), bool(np.isin(run[-1], fires))))
        else:
            self.run.clear()
        n = len(out)
        yield from _frame(host_id=[key[0]] * n, rule_id=[key[1]] * n, ts=pd.to_datetime([x for x, *_ in out], unit="ms"), status=[s for *_, s in out])

    def close(self) -> None:
        pass


def stream_sustained_alerts(breaches: DataFrame, delay: str = DELAY) -> DataFrame:
    """``breaches``: host_id, rule_id, ts, seq, breach, duration_s, as alerts.matched() gives them."""
    rows = event_time(breaches, delay).select("host_id", "rule_id", "ts", "seq", "breach", "duration_s")
    return rows.groupBy("host_id", "rule_id").transformWithStateInPandas(
        Sustained(), "host_id string, rule_id string, ts timestamp, status string", "Append", "EventTime"
    )


class TopK(StatefulProcessor):
    """The top of a metric among a bucket of its hosts after every batch, and hosts whose last sample has expired: update and expire rows.

    Beside all hosts' last samples the best k to 2k hosts are kept, all those up to some floor. A batch changes these alone; all
    hosts are gone through only when fewer than k are left of them, or when one may have expired.
    """

    def __init__(self, k: int, ttl_s: int):
        self.k, self.ttl_ms = k, ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hosts = handle.getMapState("hosts", "host_id string", "ts long, value double")
        self.best = handle.getListState("best", "value double, host_id string, ts long")  # by falling value
        self.turn = handle.getValueState("turn", "n long, timer long, complete boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, timer, complete = self.turn.get() if self.turn.exists() else (0, None, True)
        best = [(-v, h, t) for v, h, t in self.best.get()] if self.best.exists() else []
        oldest = None
        for own in rows:  # frame by frame: of each host its last sample
            own = own.sort_values(["ts", "seq"]).drop_duplicates("host_id", keep="last")
            for host, t, value in zip(own["host_id"], map(_ms, own["ts"]), own["value"]):
                had = self.hosts.getValue((host,)) if self.hosts.containsKey((host,)) else None
                if had is not None and had[0] > t:
                    continue
                self.hosts.updateValue((host,), (t, float(value)))
                oldest = t if oldest is None else min(oldest, t)
                if had is not None:
                    k = bisect.bisect_left(best, (-had[1], host, had[0]))
                    if k < len(best) and best[k][1] == host:
                        del best[k]
                if complete or best and (-float(value), host, t) < best[-1]:
                    bisect.insort(best, (-float(value), host, t))
                    if len(best) > 2 * self.k:
                        best.pop()
                        complete = False
        if len(best) < self.k and not complete:
            best, complete, _ = self._walked()
        self._wait(timer, oldest if timer is None or oldest is None else min(oldest, timer - self.ttl_ms), turn + 1, complete)
        yield from self._top(key, turn + 1, best)

    def _walked(self) -> tuple[list[tuple[float, str, int]], bool, int | None]:
        """The best 2k of all hosts, whether there are no others, and the oldest time."""
        oldest, count = None, 0

        def each():
            nonlocal oldest, count
            for h, (t, v) in self.hosts.iterator():
                oldest, count = t if oldest is None else min(oldest, t), count + 1
                yield -v, h[0], t

        best = heapq.nsmallest(2 * self.k, each())
        return best, count <= 2 * self.k, oldest

    def _wait(self, timer: int | None, oldest: int | None, turn: int, complete: bool) -> None:
        """One timer a bucket, not after the first expiry: hosts may have had samples since, then it is moved when it comes."""
        due = timer if oldest is None else oldest + self.ttl_ms
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.turn.update((turn, due, complete))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = [(h[0], v) for h, v in self.hosts.iterator() if v[0] + self.ttl_ms <= now]
        for host, _ in gone:
            self.hosts.removeKey((host,))
        turn, *_ = self.turn.get()
        best, complete, oldest = self._walked()
        self._wait(None, oldest, turn + 1 if gone else turn, complete)
        if gone:
            n = len(gone)
            yield from _frame(
                metric=[key[0]] * n, bucket=[key[1]] * n, turn=[turn + 1] * n, kind=["expire"] * n, host_id=[h for h, _ in gone],
                ts=[_time(v[0]) for _, v in gone], value=[v[1] for _, v in gone]
            )
            yield from self._top(key, turn + 1, best)

    def _top(self, key, turn: int, best: list[tuple[float, str, int]]) -> Iterator[pd.DataFrame]:
        if best:
            self.best.put([(-v, h, t) for v, h, t in best])
        else:
            self.best.clear()
        best = best[: self.k]
        n = len(best)
        yield from _frame(
            metric=[key[0]] * n, bucket=[key[1]] * n, turn=[turn] * n, kind=["update"] * n, host_id=[h for _, h, _ in best],
            ts=[_time(t) for *_, t in best], value=[-v for v, *_ in best]
        )

    def close(self) -> None:
        pass


def stream_topk(samples: DataFrame, k: int = 10, ttl_s: int = 3600, delay: str = DELAY, buckets: int = 64) -> DataFrame:
    """metric, bucket, turn, kind (update or expire), host_id, ts, value. State is kept by metric and bucket of hosts, so that a
    metric of many hosts is many tasks' work; merged_tops() makes a metric's top of its buckets'. Samples without a number don't count."""
    rows = event_time(samples, delay).select("metric", F.pmod(F.xxhash64("host_id"), F.lit(buckets)).alias("bucket"), "host_id", "ts", "seq", "value")
    rows = rows.where("value is not null and not isnan(value)")
    schema = "metric string, bucket long, turn long, kind string, host_id string, ts timestamp, value double"
    return rows.groupBy("metric", "bucket").transformWithStateInPandas(TopK(k, ttl_s), schema, "Append", "EventTime")


def merged_tops(rows: DataFrame, k: int = 10) -> DataFrame:
    """metric, rank, host_id, value: of the rows of stream_topk, the last update of each bucket without hosts that expired
    with or after it, cut to k: k rows a bucket at most are ranked."""
    one = Window.partitionBy("metric", "bucket")
    last = F.max(F.when(F.col("kind") == "update", F.col("turn"))).over(one)
    rows = rows.withColumn("last", last).where("turn >= last")
    gone = F.max(F.col("kind") == "expire").over(Window.partitionBy("metric", "bucket", "host_id"))
    live = rows.withColumn("gone", gone).where("kind = 'update' and not gone")
    top = live.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "host_id"))).where(F.col("rank") <= k)
    return top.select("metric", F.col("rank").cast("long").alias("rank"), "host_id", "value")


class Sliding(StatefulProcessor):
    """Statistics at every sample over the last ones, limited by size and age; an adaptive window grows when it is over 0.8
    full and shrinks under 0.3, once a minute at most."""

    def __init__(self, size: int, max_age_s: int, adaptive: tuple[int, int] | None):
        self.size, self.age_ms, self.adaptive = size, max_age_s * 1000, adaptive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "t long, v double")
        self.limit = handle.getValueState("limit", "size int, resized long")

    def _sizes(self, t: np.ndarray, held: int, size: int, resized: int) -> tuple[np.ndarray, int, int]:
        """The window's size at each of the times t, and its state after them. Only an adaptive window is gone through in order."""
        sizes = np.full(len(t), size)
        if self.adaptive:
            least, most = self.adaptive
            start = 0
            for k in range(held, len(t)):
                sizes[k] = size
                start = max(start, k + 1 - size, int(np.searchsorted(t, t[k] - self.age_ms)))
                if t[k] - resized >= 60_000:
                    full = (k + 1 - start) / size
                    new = min(most, int(size * 1.5)) if full > 0.8 else max(least, int(size * 0.8)) if full < 0.3 else size
                    size, resized = (new, int(t[k])) if new != size else (size, resized)
        return sizes, size, resized

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _sorted(rows)
        before = np.array([tuple(p) for p in self.points.get()] if self.points.exists() else [], np.float64).reshape(-1, 2)
        size, resized = self.limit.get() if self.limit.exists() else (self.size, 0)
        held = len(before)
        t = np.append(before[:, 0].astype(np.int64), new["ts"].to_numpy("datetime64[ms]").astype(np.int64))
        t = np.maximum.accumulate(t)  # a late row of a later batch counts as of the newest before it
        v = np.append(before[:, 1], new["value"].to_numpy(np.float64))
        sizes, size, resized = self._sizes(t, held, size, resized)
        at = np.arange(held, len(t))
        # a point that has left the window doesn't come back when the window grows: starts never go back
        first = np.maximum.accumulate(np.maximum(np.searchsorted(t, t[at] - self.age_ms), at + 1 - sizes[held:])).clip(0)
        n = at + 1 - first
        wide = int(n.max(initial=1))
        stats = [np.empty(len(at)) for _ in range(5)]
        for lo in range(0, len(at), max(1, 1_000_000 // wide)):  # windows as the rows of a table of bounded size
            own = slice(lo, lo + max(1, 1_000_000 // wide))
            place = first[own, None] + np.arange(wide)
            inside = place <= at[own, None]
            values = v[np.minimum(place, len(v) - 1)]
            total = np.where(inside, values, 0).sum(1)
            mean = total / n[own]
            spread = np.sqrt((np.where(inside, values - mean[:, None], 0) ** 2).sum(1) / n[own])
            for out, x in zip(stats, (total, mean, np.where(inside, values, np.inf).min(1), np.where(inside, values, -np.inf).max(1), spread)):
                out[own] = x
        keep = max(first[-1] if len(first) else 0, len(t) - size)
        self.points.put(list(zip(t[keep:].tolist(), v[keep:].tolist())))
        self.limit.update((int(size), int(resized)))
        total, mean, least, most, spread = stats
        yield from _frame(
            host_id=[key[0]] * len(at), metric=[key[1]] * len(at), ts=new["ts"].tolist(), count=n, sum=total, avg=mean, min=least, max=most, std_dev=spread, size=sizes[held:]
        )

    def close(self) -> None:
        pass


def stream_sliding_stats(samples: DataFrame, size: int, max_age_s: int, adaptive: tuple[int, int] | None = None, delay: str = DELAY) -> DataFrame:
    rows = event_time(samples, delay).select("host_id", "metric", "ts", "seq", "value")
    schema = "host_id string, metric string, ts timestamp, count long, sum double, avg double, min double, max double, std_dev double, size long"
    return rows.groupBy("host_id", "metric").transformWithStateInPandas(Sliding(size, max_age_s, adaptive), schema, "Append", "EventTime")


class Tail(StatefulProcessor):
    """The last points of a series by time and arrival, and whether the newest of them stands out after a batch."""

    def __init__(self, points: int, threshold: float, least: int):
        self.points, self.threshold, self.least = points, threshold, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "us long, seq long, v double")

    def _with(self, held: np.ndarray, rows: Iterable[pd.DataFrame]) -> np.ndarray:
        """The last points of those held and new, cut to the number kept after each frame."""
        for own in rows:
            new = np.empty(len(own), held.dtype)
            new["us"], new["seq"], new["v"] = own["ts"].to_numpy("datetime64[us]").astype(np.int64), own["seq"], own["value"]
            held = np.sort(np.concatenate([held, new]), order=["us", "seq"])[-self.points :]
        return held

    def _held(self) -> np.ndarray:
        kind = [("us", np.int64), ("seq", np.int64), ("v", np.float64)]
        return np.array([tuple(p) for p in self.tail.get()] if self.tail.exists() else [], kind)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.tail.put(self._with(self._held(), [initialState]).tolist())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = next(rows, None)
        if first is None or first.empty:  # a key of the initial state alone
            return
        held = self._with(self._held(), itertools.chain([first], rows))
        self.tail.put(held.tolist())
        mean, spread, last = held["v"].mean(), held["v"].std(), held["v"][-1]
        score = abs(last - mean) / spread if spread > 0 else 0.0
        if len(held) >= self.least and score > self.threshold:
            yield from _frame(
                host_id=[key[0]], metric=[key[1]], ts=[pd.Timestamp(int(held["us"][-1]), unit="us")], n=[len(held)], mean=[mean], stddev=[spread],
                last=[last], score=[score]
            )

    def close(self) -> None:
        pass


def stream_anomalies(
    samples: DataFrame, points: int = 100, threshold: float = 3.0, least: int = 10, history: DataFrame | None = None, delay: str = DELAY
) -> DataFrame:
    """After each batch the series that it has rows of and whose newest point stands out among their last ``points``, as
    anomaly() has it. State is kept by series (a batch touches its own series alone) and starts from ``history``, if it is given.
    Samples without a value don't count; rows behind the watermark are dropped."""
    columns = ("host_id", "metric", "ts", "seq", "value")
    rows = event_time(samples, delay).select(*columns).where("value is not null")
    first = None
    if history is not None:
        last = keep_last_n(history.where("value is not null").select(*columns), points, SERIES)
        first = last.select(*columns).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(*SERIES)
    schema = "host_id string, metric string, ts timestamp, n long, mean double, stddev double, last double, score double"
    return rows.groupBy(*SERIES).transformWithStateInPandas(Tail(points, threshold, least), schema, "Append", "EventTime", first)
