"""Log watcher: predicts error cascades after triggers, confirms and clears them, and flags odd error rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timekey import decode, line_epochs, sniff_grammar, stamps
from ..operators.logs import error_lines, levels
from ..operators.series import median_lag

# Trigger words, sensitivities (window factor, confirming errors, deviations, streak) and times in seconds.
TRIGGERS = ["deploy", "rollout", "redeploy", "rollback", "restart", "reload", "released"]
SENSITIVITY = {"high": (3, 1, 3.0, 2), "medium": (2, 2, 5.0, 3), "low": (1, 3, 8.0, 4)}
LEAST_WINDOW, UNKNOWN_LAG, RING, WARM_UP, LEAST_ERRORS, COOLDOWN = 45, 60, 120, 15, 3, 60


@dataclass
class Cascade:
    """Idle, armed by a trigger, or cooling down after a confirmed cascade."""

    sensitivity: str = "medium"
    lag: int | None = None
    phase: str = "idle"
    until: int = 0
    errors: int = 0

    def window(self) -> int:
        return max(LEAST_WINDOW, int((self.lag or UNKNOWN_LAG) * SENSITIVITY[self.sensitivity][0]))

    def tick(self, now: int, triggers: int, errors: int) -> list[tuple[str, int]]:
        """Alerts (kind, time): the old phase expires first, then what was seen counts."""
        out = []
        confirm = SENSITIVITY[self.sensitivity][1]
        if self.phase != "idle" and now >= self.until:
            if self.phase == "armed" and self.errors < confirm:
                out.append(("clear", now))
            self.phase = "idle"
        if self.phase == "cooldown":
            return out
        if self.phase == "idle":
            if not triggers:
                return out
            out.append(("predicted", now))
            self.phase, self.until, self.errors = "armed", now + self.window(), errors
        else:
            self.errors += errors
            if triggers:
                self.until = now + self.window()
        if self.errors >= confirm:
            out.append(("confirmed", now))
            self.phase, self.until = "cooldown", now + self.window()
        return out


@dataclass
class Rate:
    """Error counts of the last ticks; a streak of counts far over their median is an anomaly."""

    sensitivity: str = "medium"
    ring: list[int] = field(default_factory=list)
    streak: int = 0
    quiet_until: int = 0

    def tick(self, now: int, errors: int) -> list[tuple[str, int]]:
        _, _, k, streak = SENSITIVITY[self.sensitivity]
        out = []
        if now < self.quiet_until:
            self.streak = 0
        elif len(self.ring) >= WARM_UP:
            middle = median(self.ring)
            odd = errors >= LEAST_ERRORS and errors > middle + k * max(median([abs(x - middle) for x in self.ring]), 1.0)
            self.streak = self.streak + 1 if odd else 0
            if self.streak >= streak:
                out.append(("anomaly", now))
                self.streak, self.quiet_until = 0, now + COOLDOWN
        self.ring = [*self.ring, errors][-RING:]
        return out


def classify(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add ``trigger`` and ``errors``: whether a line holds a trigger word, and its ERROR and FATAL words."""
    lower = F.lower(line)
    trigger = F.lit(False)
    for word in TRIGGERS:
        trigger = trigger | lower.contains(word)
    return lines.withColumn("trigger", trigger).withColumn("errors", F.size(F.filter(levels(F.col(line)), lambda x: x.isin("ERROR", "FATAL"))))


def quiet_seconds(cascade: Cascade, rate: Rate, since: int, until: int) -> list[tuple[str, int]]:
    """Feed the seconds after ``since`` and before ``until`` in which no line came; alerts of theirs."""
    alerts = []
    # Once the cascade is over and the ring holds zeros only, more silence changes nothing.
    telling = min(until, max(since, cascade.until, rate.quiet_until) + RING + 1)
    for second in range(since + 1, telling):
        alerts += cascade.tick(second, 0, 0)
        rate.tick(second, 0)
    return alerts


def judge(cascade: Cascade, rate: Rate, waiting: dict[int, tuple[int, int]], last: int, now: int) -> tuple[list[tuple[str, int]], int]:
    """Alerts of the seconds up to ``now``, and the last second that was judged; those are taken out of ``waiting``."""
    alerts = []
    for second in sorted(s for s in waiting if s <= now):
        triggers, errors = waiting.pop(second)
        if second <= last:  # of a second that was judged before
            continue
        alerts += quiet_seconds(cascade, rate, last, second) if last >= 0 else []
        busy = cascade.phase != "idle"
        alerts += cascade.tick(second, triggers, errors)
        odd = rate.tick(second, errors)
        if not busy and cascade.phase == "idle":
            alerts += odd
        last = second
    if last >= 0 and cascade.phase != "idle" and cascade.until <= now:
        alerts += quiet_seconds(cascade, rate, last, now + 1)
        last = now
    return alerts, last


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watcher(StatefulProcessor):
    """One stream's watcher: a value for its phase and clocks, a list for the counts of the last seconds, a map for seconds not judged yet.

    A timer stands at the next second to judge, or at the cascade's end; with
    neither left it stands ``idle`` seconds after the last judged second, and
    then the stream's state is dropped.
    """

    def __init__(self, sensitivity: str, lag: int | None, idle: int) -> None:
        self.sensitivity, self.lag, self.idle = sensitivity, lag, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "phase string, until long, errors long, streak long, quiet long, last long")
        self.ring = handle.getListState("ring", "n long")
        self.waiting = handle.getMapState("waiting", "second long", "triggers long, errors long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for second, row in part.groupby("second")[["triggers", "errors"]].sum().iterrows():
                before = self.waiting.getValue((int(second),)) if self.waiting.containsKey((int(second),)) else (0, 0)
                self.waiting.updateValue((int(second),), (int(before[0] + row["triggers"]), int(before[1] + row["errors"])))
        yield from self.fold(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.fold(key, timerValues)

    def close(self) -> None:
        pass

    def fold(self, key, timerValues) -> Iterator[pd.DataFrame]:
        phase, until, errors, streak, quiet, last = self.held.get() if self.held.exists() else ("idle", 0, 0, 0, 0, -1)
        ring = [int(n) for (n,) in self.ring.get()] if self.ring.exists() else []
        waiting = {int(s): (int(t), int(e)) for (s,), (t, e) in self.waiting.iterator()}
        seconds = list(waiting)
        cascade, rate = Cascade(self.sensitivity, self.lag, phase, int(until), int(errors)), Rate(self.sensitivity, list(ring), int(streak), int(quiet))
        watermark = timerValues.getCurrentWatermarkInMs()
        alerts, last = judge(cascade, rate, waiting, int(last), watermark // 1000)
        for second in seconds:
            if second not in waiting:
                self.waiting.removeKey((second,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_one = min([*waiting, *([cascade.until] if cascade.phase != "idle" else [])], default=None)
        if next_one is None and last + self.idle <= watermark // 1000:
            for state in (self.held, self.ring, self.waiting):
                state.clear()
        else:
            self.held.update((cascade.phase, cascade.until, cascade.errors, rate.streak, rate.quiet_until, last))
            if rate.ring != ring:
                self.ring.put([(n,) for n in rate.ring])
            self.handle.registerTimer(max(watermark + 1, 1000 * (last + self.idle if next_one is None else next_one)))
        if alerts:
            yield pd.DataFrame([(key[0], k, t) for k, t in alerts], columns=["stream", "kind", "at"]).astype({"at": "int64"})


def watch(lines: DataFrame, stream: str = "stream", at: str = "ts", line: str = "value", sensitivity: str = "medium", lag: int | None = None, delay: str = "0 seconds", idle: int = 86_400) -> DataFrame:
    """Alerts ``stream``, ``kind``, ``at`` (Unix seconds) of a streaming DataFrame of lines.

    State is kept per stream. Lines are folded by second, and a second is judged
    when the watermark, the latest time less ``delay``, has reached it: so lines that
    come late by up to ``delay`` count in order, later ones are dropped. Seconds
    without lines count as such. A cascade that nothing confirms is cleared by
    the watermark, whether or not its stream has another line. Rate alerts are
    held back while a trigger's cascade is under way. A stream without a line
    for ``idle`` seconds is forgotten; if it comes back, it warms up anew. The
    state needs the RocksDB provider, which is set in the session.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = classify(lines, line).select(F.col(stream).alias("stream"), F.col(at).cast("timestamp").alias("ts"), F.col("trigger").cast("int").alias("triggers"), F.col("errors").cast("long").alias("errors")).withWatermark("ts", delay)
    ticks = timed.withColumn("second", F.unix_seconds("ts"))
    return ticks.groupBy("stream").transformWithStateInPandas(Watcher(sensitivity, lag, idle), "stream string, kind string, at long", "append", "EventTime")


def learned_lag(lines: DataFrame, grammar: str, line: str = "value") -> int | None:
    """The upper median of the seconds from each trigger line to the next error within the hour; None without any."""
    one = F.element_at(stamps(F.col(line), grammar), 1)
    triggers = classify(lines.where(F.size(stamps(F.col(line), grammar)) > 0), line).where("trigger").select(F.lit(0).alias("k"), decode(one, grammar).alias("epoch")).where("epoch IS NOT NULL")
    errors = line_epochs(error_lines(lines, grammar, line), grammar, line).select(F.lit(0).alias("k"), "epoch")
    return median_lag(triggers, errors, ["k"])


def with_pinned_grammar(folder: str, handle: Callable[[DataFrame, str | None, int], None], grammar: str | None = None, line: str = "value") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of lines: ``handle(batch, grammar, number)`` of every batch that has lines.

    The grammar is the given one (that of the file's history), else that of the
    first batch with a stamp. It is kept in ``folder`` (next to the stream's
    checkpoint), so that it stays what it is over restarts; until then it is None.
    """

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        kept = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/grammar/_SUCCESS")
        pinned = grammar
        if pinned is None and kept.getFileSystem(spark._jsc.hadoopConfiguration()).exists(kept):
            pinned = spark.read.text(f"{folder}/grammar").first()["value"]
        if pinned is None:
            pinned = sniff_grammar(batch, line)
            if pinned is not None:
                spark.createDataFrame([(pinned,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/grammar")
        handle(batch, pinned, number)

    return run


# How long an alert and an all-clear are news, and a watcher's last sign of life counts, in seconds.
ALERT_FRESH, CLEAR_FRESH, SIGN_FRESH = 600, 90, 120
ALERTING = ["confirmed", "anomaly"]


def snapshot(alerts: DataFrame) -> DataFrame:
    """``stream``, ``status``, ``kind``, ``at``: the last alert of each stream, and whether it is alerting or only watching."""
    last = alerts.groupBy("stream").agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("at"))
    return last.select("stream", F.when(F.col("kind").isin(ALERTING), "alerting").otherwise("watching").alias("status"), "kind", "at")


def news(snapshots: DataFrame, now: int, updated: str = "updated") -> DataFrame:
    """Snapshots (with ``updated``, Unix seconds) of live watchers, and in ``fresh`` whether their alert is still news at ``now``."""
    age = now - F.col("at")
    fresh = F.coalesce(age <= F.when(F.col("kind") == "clear", CLEAR_FRESH).otherwise(ALERT_FRESH), F.lit(False))
    return snapshots.where(now - F.col(updated) <= SIGN_FRESH).withColumn("fresh", fresh)


def snapshot_writer(path: str):
    """For ``foreachBatch`` of an alert stream: keeps the snapshot in ``path``, a folder for each batch; the last whole one counts."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest_snapshot(spark, path)
        every = batch if before is None else batch.unionByName(before.select("stream", "kind", "at"))
        snapshot(every).withColumn("updated", F.unix_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return write


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """What :func:`snapshot_writer` wrote last; None before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
    whole = [n for n in sorted(names) if n.startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{whole[-1]}") if whole else None
