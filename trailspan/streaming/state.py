"""Stateful streams: engine health, live track statistics, cache misses under a TTL.

Streams run on event time. Rows of a key may arrive in any order within the watermark; rows behind it are
dropped, repeated ones count once. Memory of a key is what waits for the watermark (engine health) or one entry for each
stretch of a track without a hole (track statistics), never a key's rows.
"""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import EARTH_RADIUS_M
from ..operators.jobs import COOLDOWN_MINUTES, FAILURE_THRESHOLD, engine_events

_EPOCH = dt.datetime(1970, 1, 1)


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


class _Health(StatefulProcessor):
    """Events wait in the state, by time and number, until the watermark has passed them; then they count, in order.

    A timer stands at the first waiting event, and one at the end of a suspension, which ends it without any event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "failures int, until bigint, reason string, suspended boolean")
        self.waiting = handle.getMapState("waiting", "ts bigint, seq bigint", "success boolean, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for part in rows:
            for ok, ts, seq, why in zip(part["success"], part["ts"], part["seq"], part["reason"], strict=True):
                at = _micros(ts)
                if at > seen:
                    self.waiting.updateValue((at, int(seq)), (bool(ok), why))
                    first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        failures, until, reason, suspended = self.state.get() if self.state.exists() else (0, None, None, False)
        before = (failures, until, reason, suspended)
        due, ahead = [], None
        for at, event in self.waiting.iterator():
            if at[0] <= now:
                due.append((at[0], at[1], event))
            else:
                ahead = at[0] if ahead is None else min(ahead, at[0])
        for at, seq, (ok, why) in sorted(due, key=lambda e: e[:2]):
            if ok:
                failures, until = 0, None
            else:
                failures, reason = failures + 1, why
                if failures >= FAILURE_THRESHOLD:
                    until = at + COOLDOWN_MINUTES * 60_000_000
            self.waiting.removeKey((at, seq))
        suspended = until is not None and until > now
        if ahead is not None:
            self.handle.registerTimer(-(-ahead // 1000))
        if suspended:
            self.handle.registerTimer(-(-until // 1000))
        after = (failures, until, reason, suspended)
        if due or after != before:
            self.state.update(after)
            when = None if until is None else _EPOCH + dt.timedelta(microseconds=until)
            yield pd.DataFrame({"engine": [key[0]], "failures": [failures], "suspended_until": [when], "last_reason": [reason], "is_suspended": [suspended]}).astype(
                {"suspended_until": "datetime64[us]"}
            )

    def close(self) -> None:
        pass


def engine_health_stream(log: DataFrame, late: str = "5 minutes") -> DataFrame:
    """State of each engine whenever the watermark on ``ts`` passes an event or the end of a suspension (update mode).

    ``is_suspended`` is as of the watermark. Events of an engine with the same ``ts`` and ``seq`` are one.
    """
    return engine_events(log).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("engine").transformWithStateInPandas(
        _Health(), "engine string, failures int, suspended_until timestamp, last_reason string, is_suspended boolean", "Update", "EventTime"
    )


class _Stretch:
    """Statistics of consecutive points: its two ends, and sums between them. Two that meet add up."""

    FIELDS = "last bigint, a_lat double, a_lon double, a_ele double, b_lat double, b_lon double, b_ele double, length double, gain double, loss double, gap boolean"

    def __init__(self, first: int, values: tuple):
        self.first = first
        self.last, *ends, self.length, self.gain, self.loss, self.gap = values
        self.a, self.b = tuple(ends[:3]), tuple(ends[3:])

    @classmethod
    def point(cls, seq: int, lat: float, lon: float, ele: float | None) -> _Stretch:
        return cls(seq, (seq, lat, lon, ele, lat, lon, ele, 0.0, 0.0, 0.0, False))

    def add(self, after: _Stretch) -> None:
        """Take in the stretch that starts where this one ends."""
        (lat, lon, ele), (y, x, z) = self.b, after.a
        h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        step = 0.0 if ele is None or z is None else z - ele
        self.length += 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h)) + after.length
        self.gain += (step if step >= 2 else 0.0) + after.gain
        self.loss += (-step if step <= -2 else 0.0) + after.loss
        self.gap = self.gap or after.gap or ele is None or z is None
        self.last, self.b = after.last, after.b

    def values(self) -> tuple:
        return (self.last, *self.a, *self.b, self.length, self.gain, self.loss, self.gap)


class _Track(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("stretches", "first bigint", _Stretch.FIELDS)
        self.latest = handle.getValueState("latest", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: _Stretch(k[0], tuple(v)) for k, v in self.held.iterator()}
        before, starts = set(known), sorted(known)
        changed: set[int] = set()
        latest = self.latest.get()[0] if self.latest.exists() else 0
        for part in rows:
            latest = max(latest, _micros(part["ts"].max()) // 1000)
            part = part.sort_values("seq")
            for seq, y, x, z in zip(part["seq"].tolist(), part["lat"].tolist(), part["lon"].tolist(), part["ele"].tolist(), strict=True):
                at = bisect_right(starts, seq)
                left = known[starts[at - 1]] if at else None
                if left is not None and seq <= left.last:
                    continue  # a point that is here already
                new = _Stretch.point(seq, y, x, None if pd.isna(z) else z)
                if left is not None and left.last == seq - 1:
                    left.add(new)
                    new = left
                else:
                    starts.insert(at, seq)
                    known[seq], at = new, at + 1
                if at < len(starts) and starts[at] == seq + 1:
                    new.add(known.pop(starts.pop(at)))
                changed.add(new.first)
        for first in before - set(known):
            self.held.removeKey((first,))
        for first in changed & set(known):
            self.held.updateValue((first,), known[first].values())
        self.latest.update((latest,))
        self.handle.registerTimer(latest + self.idle)
        parts = known.values()
        gap = any(p.gap for p in parts)
        up, down = (0, 0) if gap else (math.floor(sum(p.gain for p in parts) + 0.5), math.floor(sum(p.loss for p in parts) + 0.5))
        yield pd.DataFrame({
            "track_id": [key[0]], "n_points": [sum(p.last - p.first + 1 for p in parts)], "n_stretches": [len(known)],
            "total_distance_m": [float(sum(p.length for p in parts))], "elevation_gain_m": [up], "elevation_loss_m": [down],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A track that has been still for long is forgotten."""
        if self.latest.exists() and self.latest.get()[0] + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_stats_stream(points: DataFrame, late: str = "1 hour", idle: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """Length, climb and descent of each track as its points arrive, in any order (update mode).

    ``points`` has a dense ``seq`` per track and an event time ``ts``. A track has one entry in the state for each stretch of points
    without a hole; two stretches that meet become one. ``n_stretches`` is 1 where nothing is missing.
    The state of a track goes once the watermark is ``idle`` behind its last point.
    """
    return points.select("track_id", "seq", "lat", "lon", "ele", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy("track_id").transformWithStateInPandas(
        _Track(int(idle.total_seconds() * 1000)),
        "track_id string, n_points bigint, n_stretches int, total_distance_m double, elevation_gain_m bigint, elevation_loss_m bigint",
        "Update", "EventTime",
    )


class _Misses(StatefulProcessor):
    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = dt.timedelta(seconds=ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "miss timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.state.get()[0]) if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("ts")
        missed = []
        for ts in batch["ts"]:
            if last is None or ts >= last + self.ttl:
                last = ts
                missed.append(ts)
        if missed:
            self.state.update((last.to_pydatetime(),))
            yield pd.DataFrame({"key": [key[0]] * len(missed), "ts": missed}).astype({"ts": "datetime64[us]"})

    def close(self) -> None:
        pass


def ttl_misses_stream(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Requests that find no live entry (append mode)."""
    return requests.select("key", "ts").groupBy("key").transformWithStateInPandas(
        _Misses(ttl_seconds), "key string, ts timestamp", "Append", "None"
    )


def _walk_misses(ttl_seconds: int):
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for rows in batches:
            missed = []
            for k, ts in zip(rows["key"], rows["ts"]):
                if k != key:
                    key, last = k, None
                new = last is None or ts >= last + ttl
                last = ts if new else last
                missed.append(new)
            yield rows[missed][["key", "ts"]]

    return walk


def ttl_misses(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """The same over a table.

    Requests of one key and instant are folded before the shuffle; the walk over
    the sorted instants holds one time stamp per task, never a key's rows.
    """
    instants = requests.groupBy("key", "ts").agg(F.lit(1).alias("_one")).select("key", "ts")
    in_order = instants.repartition("key").sortWithinPartitions("key", "ts")
    return in_order.mapInPandas(_walk_misses(ttl_seconds), "key string, ts timestamp")


def mark_misses(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Each request with ``is_miss``; of equal instants the first by ``event_id`` misses."""
    first = requests.groupBy("key", "ts").agg(F.min("event_id").alias("_first"))
    missed = ttl_misses(requests, ttl_seconds).join(first, ["key", "ts"]).select("key", F.col("_first").alias("event_id"), F.lit(True).alias("is_miss"))
    return requests.join(missed, ["key", "event_id"], "left").withColumn("is_miss", F.coalesce("is_miss", F.lit(False)))
