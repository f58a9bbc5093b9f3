"""Keyed state between micro-batches: entity windows, sessions and noise, open incidents, silent series, vectors.

Each processor gives over all batches what its batch operator gives over their union, in
whatever order rows arrive. A row waits in its key's state until the watermark has passed
it; a timer at the earliest waiting row then takes all that are due in the order of time (and
of the tie-break). Rows behind the watermark are dropped by Spark and show up in the query's
progress. What a key holds is its waiting rows and one state row; state that time alone
ends (a window, an open incident) has a timer of its own, which each row that extends it moves.

The state store must be RocksDB (``rocksdb``), whose state need not fit in memory. A key is
walked by one task, since each step depends on the one before; equal rows of a batch are
added up before they are stored where the operator only counts them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Steps through the rows of a key in order. A subclass says what is held and what a step gives.

    ``waiting``: DDL of a waiting row, which begins with ``at`` (microseconds) and the tie-break;
    ``held``: DDL of the state row; ``out``: names of the result's columns.
    """

    waiting: str
    held: str
    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("waiting", self.waiting)
        self._state = handle.getValueState("state", self.held)
        self._names = [x.split()[0] for x in self.waiting.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [row for part in rows for row in self.combined(part[self._names].astype(object).where(part[self._names].notna(), None).itertuples(index=False, name=None))]
        if new:
            self._rows.appendList(new)
            self._at(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for row in self._rows.get() if self._rows.exists() else ():
            (due if row[0] <= now else later).append(tuple(row))
        if due:
            if later:
                self._rows.put(later)
                self._at(min(row[0] for row in later))
            else:
                self._rows.clear()
        state = tuple(self._state.get()) if self._state.exists() else None
        state, made = self.walk(state, sorted(due, key=lambda row: (row[0], row[1] is not None, row[1])), now)
        if state is None:
            self._state.clear()
        else:
            self._state.update(state)
            ends = self.ends(state)
            if ends is not None:
                self._at(ends)
        if made:
            yield pd.DataFrame([(*key, *row) for row in made], columns=self.out)

    def close(self) -> None:
        pass

    def _at(self, micros: int) -> None:
        self._handle.registerTimer(-(-int(micros) // 1000))

    def combined(self, rows: Iterable[tuple]) -> Iterable[tuple]:
        """The rows of one batch as they are stored."""
        return rows

    def walk(self, state: tuple | None, due: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
        """The state after the due rows and at the time ``now``, and the rows to give out."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """When time alone changes the state."""
        return None


def _once(due: list[tuple]) -> list[tuple]:
    """Of rows with one time and id, the first: a batch that was written again upstream comes twice."""
    return [row for k, row in enumerate(due) if k == 0 or row[:2] != due[k - 1][:2]]


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(int(micros), unit="us")


class EntityWindows(InOrder):
    """Active windows of an entity, given out once each when the watermark has passed their end."""

    waiting = "at bigint, raw_id string, n bigint"
    held = "opened bigint, last bigint, n bigint, raw_ids array<string>"
    out = ["entity_id", "first_seen", "last_seen", "sightings", "raw_ids"]

    def __init__(self, ttl_seconds: int) -> None:
        self._ttl = ttl_seconds * 1_000_000

    def combined(self, rows):
        return [(at, raw, n) for (at, raw), n in Counter((at, raw) for at, raw, _ in rows).items()]

    def walk(self, state, due, now):
        made = []
        close = lambda s: made.append((_time(s[0]), _time(s[1]), s[2], sorted(x for x in s[3] if x is not None)))
        for at, raw, n in due:
            if state and at - state[0] >= self._ttl:
                close(state)
                state = None
            opened, last, count, ids = state or (at, at, 0, [])
            state = (opened, max(last, at), count + n, list(ids) if raw in ids else [*ids, raw])
        if state and now >= self.ends(state):
            close(state)
            state = None
        return state, made

    def ends(self, state):
        return state[0] + self._ttl


def entity_windows(sightings: DataFrame, ttl_seconds: int = 300, lateness: str = "5 seconds") -> DataFrame:
    """``dedup_entities`` on a stream (``entity_id, raw_id, ts``); a window comes out when no sighting can join it any more."""
    rows = sightings.where("entity_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness)
    rows = rows.select("entity_id", "ts", F.unix_micros("ts").alias("at"), "raw_id", F.lit(1).cast("long").alias("n"))
    out = "entity_id string, first_seen timestamp, last_seen timestamp, sightings long, raw_ids array<string>"
    return rows.groupBy("entity_id").transformWithStateInPandas(EntityWindows(ttl_seconds), out, "Append", "eventTime")


class Sessions(InOrder):
    """Which signals of a series are noise, and its sessions, given out again whenever they have grown."""

    waiting = "at bigint, event_id bigint, score double, anomalous boolean, passes boolean, payload string"
    held = "first bigint, session bigint, started bigint, ended bigint, peak double, points bigint, before double, last double, rows bigint"
    out = ["entity_id", "metric_name", "kind", "event_id", "keep", "payload", "session", "started", "ended", "peak", "points", "resolved"]

    def __init__(self, seconds: int, strong: float, low: float) -> None:
        self._seconds, self._strong, self._low = seconds * 1_000_000, strong, low

    def walk(self, state, due, now):
        first, session, started, ended, peak, points, before, last, rows = state or (None, 0, None, None, None, 0, None, None, 0)
        made, grown = [], False
        episode = lambda done: made.append(("session", None, None, None, session, _time(started), _time(ended), peak, points, done))
        for at, event, score, anomalous, passes, payload in _once(due):
            if anomalous:
                first = at if first is None else first
                keep = bool(passes) or (score is not None and score >= self._strong) or at - first >= self._seconds
                made.append(("signal", event, keep, payload, None, None, None, None, None, None))
            score = score if anomalous else 0.0
            started, ended, points, grown = (at if points == 0 else started), at, points + 1, True
            peak = score if peak is None or (score is not None and score > peak) else peak
            rows += 1
            last3 = (before, last, score)
            before, last = last, score
            if rows >= 3 and None not in last3 and max(last3) < self._low:
                episode(True)
                session, started, ended, peak, points, grown = session + 1, None, None, None, 0, False
        if grown:
            episode(False)
        return (first, session, started, ended, peak, points, before, last, rows), made


def sessions_and_noise(scored: DataFrame, seconds: int = 180, strong: float = 0.85, neighbors: int = 3, low: float = 0.5, lateness: str = "5 seconds") -> DataFrame:
    """``suppress_noise`` and ``anomaly_sessions`` on a stream of scored points (``entity_id, metric_name, event_id, ts, score, anomalous``).

    Rows of kind ``signal`` hold an anomalous point as JSON (``payload``) and whether to ``keep``
    it; rows of kind ``session`` are a session as it stands, of which the one with most points counts.
    """
    passes = F.lit(False)
    if "source_type" in scored.columns:
        passes = passes | F.coalesce(F.col("source_type") == "security", F.lit(False))
    if "affected_neighbors" in scored.columns:
        passes = passes | (F.coalesce("affected_neighbors", F.lit(0)) >= neighbors)
    payload = F.when(F.col("anomalous"), F.to_json(F.struct(*scored.columns)))
    rows = scored.withWatermark("ts", lateness).select("entity_id", "metric_name", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long"), F.col("score").cast("double"), F.coalesce("anomalous", F.lit(False)).alias("anomalous"), passes.alias("passes"), payload.alias("payload"))
    out = "entity_id string, metric_name string, kind string, event_id long, keep boolean, payload string, session long, started timestamp, ended timestamp, peak double, points long, resolved boolean"
    return rows.groupBy("entity_id", "metric_name").transformWithStateInPandas(Sessions(seconds, strong, low), out, "Append", "eventTime")


def latest_sessions(found: DataFrame) -> DataFrame:
    """The last state of each session of the rows that ``sessions_and_noise`` has given."""
    rows = found.where("kind = 'session'").groupBy("entity_id", "metric_name", "session").agg(F.max(F.struct("points", "started", "ended", "peak", "resolved")).alias("x"))
    rows = rows.select("entity_id", "metric_name", "session", "x.started", "x.ended", "x.peak", "x.points", "x.resolved")
    return rows.withColumn("duration_s", (F.unix_micros("ended") - F.unix_micros("started")) / 1e6)


class OpenIncidents(InOrder):
    """The open incident of an entity; each hit moves the time at which it is closed."""

    waiting = "at bigint, incident_id string, impact double, payload string"
    held = "incident_id string, created bigint, last bigint, n bigint, impact double, payload string"
    out = ["root_cause_entity", "incident_id", "created_at", "deduplicated_count", "impact", "related_incidents", "status", "payload"]

    def __init__(self, ttl_seconds: int) -> None:
        self._ttl = ttl_seconds * 1_000_000

    def walk(self, state, due, now):
        made, new = [], []

        def tell(s: tuple, closed: bool) -> None:
            if new:
                made.append((s[0], _time(s[1]), s[3], s[4], sorted(new), "opened" if s[3] == len(new) else "open", s[5]))
                new.clear()
            if closed:
                made.append((s[0], _time(s[1]), s[3], s[4], [], "closed", s[5]))

        for at, incident, impact, payload in _once(due):
            if state and at - state[2] > self._ttl:
                tell(state, True)
                state = None
            name, created, _, n, most, first = state or (incident, at, at, 0, None, payload)
            most = impact if most is None or (impact is not None and impact > most) else most
            state = (name, created, at, n + 1, most, first)
            new.append(incident)
        if state:
            over = now >= self.ends(state)
            tell(state, over)
            state = None if over else state
        return state, made

    def ends(self, state):
        return state[2] + self._ttl + 1000


def open_incidents(incidents: DataFrame, ttl_seconds: int = 300, lateness: str = "5 seconds") -> DataFrame:
    """``dedup_incidents`` on a stream (``root_cause_entity, incident_id, created_at, impact``).

    Each batch that touches an incident gives it as it stands, with the ids that are new in
    ``related_incidents``; it is ``closed`` once ``ttl_seconds`` have passed without a hit.
    Without an entity an incident is one of its own. ``payload`` is the first incident's row as
    JSON, ``status`` tells ``opened`` from ``open``.
    """
    entity = F.coalesce(F.when(F.col("root_cause_entity") != "", F.col("root_cause_entity")), F.col("incident_id").cast("string"))
    rows = incidents.withWatermark("created_at", lateness).select(entity.alias("root_cause_entity"), F.col("created_at"), F.unix_micros("created_at").alias("at"), F.col("incident_id").cast("string"), F.col("impact").cast("double"), F.to_json(F.struct(*incidents.columns)).alias("payload"))
    out = "root_cause_entity string, incident_id string, created_at timestamp, deduplicated_count long, impact double, related_incidents array<string>, status string, payload string"
    return rows.groupBy("root_cause_entity").transformWithStateInPandas(OpenIncidents(ttl_seconds), out, "Append", "eventTime")


def incident_store(found: DataFrame) -> DataFrame:
    """One row for each incident of the rows that ``open_incidents`` has given."""
    ids = F.array_sort(F.flatten(F.collect_list("related_incidents")))
    rows = found.groupBy("root_cause_entity", "incident_id", "created_at").agg(F.max("deduplicated_count").alias("deduplicated_count"), F.max("impact").alias("impact"), ids.alias("related_incidents"), F.max(F.col("status") == "closed").alias("closed"))
    return rows.withColumn("status", F.when(F.col("closed"), "closed").otherwise("open")).drop("closed")


class Absence(InOrder):
    """Whether a series is silent: told once when its time is over, and again when it is back."""

    waiting = "at bigint, event_id bigint"
    held = "last bigint, told boolean"
    out = ["entity_id", "metric_name", "since", "until"]

    def __init__(self, seconds: int) -> None:
        self._limit = seconds * 1_000_000

    def combined(self, rows):
        return {row[0]: row for row in rows}.values()

    def walk(self, state, due, now):
        made = []
        for at, _ in due:
            if state and at - state[0] > self._limit:
                made.append((_time(state[0]), _time(at)))
            state = (at, False)
        if state and not state[1] and now - state[0] > self._limit:
            made.append((_time(state[0]), None))
            state = (state[0], True)
        return state, made

    def ends(self, state):
        return None if state[1] else state[0] + self._limit + 1000


def absences(metrics: DataFrame, for_seconds: int, lateness: str = "5 seconds") -> DataFrame:
    """``absence_alerts`` on a stream (``entity_id, metric_name, event_id, ts``), by the clock of the watermark.

    A series that stops gives ``since`` without ``until`` when the others have gone on for
    ``for_seconds``; when it is back, the gap comes with both.
    """
    rows = metrics.withWatermark("ts", lateness).select("entity_id", "metric_name", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long"))
    out = "entity_id string, metric_name string, since timestamp, until timestamp"
    return rows.groupBy("entity_id", "metric_name").transformWithStateInPandas(Absence(for_seconds), out, "Append", "eventTime")


_STATS = ("min", "max", "avg", "p50", "p95", "p99", "error_rate")


class Vectors(InOrder):
    """The running vector of each window size of an entity, and its version."""

    waiting = "at bigint, tie string, start bigint, window_size string, metric_name string, n bigint, " + ", ".join(f"{c} double" for c in _STATS)
    held = "version bigint, sizes array<struct<size:string,start:bigint,p50:double,p95:double,p99:double,error_rate:double,weighted:double,n:bigint,low:double,high:double>>"
    out = ["entity_id", "window_size", "metric_name", "window_end", "first_start", "latency_p50", "latency_p95", "latency_p99", "error_rate", "latency_avg", "latency_min", "latency_max", "request_volume", "feature_version", "ttl"]

    def walk(self, state, due, now):
        version, sizes = (state[0], {x[0]: tuple(x) for x in state[1]}) if state else (0, {})
        made = []
        least = lambda a, b, pick=min: a if b is None else b if a is None else pick(a, b)
        for at, _, start, size, metric, n, low, high, avg, *given in due:
            version += 1
            had = sizes.get(size, (size, None, None, None, None, None, None, None, None, None))
            last = [new if new is not None else old for new, old in zip(given, had[2:6], strict=True)]
            weighted = had[6] if avg is None or n is None else (had[6] or 0.0) + avg * n
            now_ = (size, least(had[1], start), *last, weighted, had[7] if n is None else (had[7] or 0) + n, least(had[8], low), least(had[9], high, max))
            sizes[size] = now_
            mean = None if now_[6] is None or not now_[7] else now_[6] / now_[7]
            made.append((size, metric, _time(at), _time(now_[1]), *now_[2:6], mean, now_[8], now_[9], now_[7], version, 90))
        return (version, list(sizes.values())), made


def vectors(windows: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """``feature_vectors`` on a stream of closed windows: a batch costs its own rows, whatever the history."""
    given = lambda c: (F.col(c) if c in windows.columns else F.lit(None)).cast("double").alias(c)
    start = F.unix_micros("window_start")
    # The order of the batch operator: start (times before 1970 too), metric, size.
    tie = F.concat_ws("\u0000", F.lpad((start + F.lit(1 << 62)).cast("string"), 20, "0"), "metric_name", "window_size")
    rows = windows.withWatermark("window_end", lateness).select("entity_id", "window_end", F.unix_micros("window_end").alias("at"), tie.alias("tie"), start.alias("start"), "window_size", "metric_name", F.col("count").cast("long").alias("n"), *[given(c) for c in _STATS])
    out = "entity_id string, window_size string, metric_name string, window_end timestamp, first_start timestamp, latency_p50 double, latency_p95 double, latency_p99 double, error_rate double, latency_avg double, latency_min double, latency_max double, request_volume long, feature_version long, ttl int"
    return rows.groupBy("entity_id").transformWithStateInPandas(Vectors(), out, "Append", "eventTime")
