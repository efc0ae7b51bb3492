"""Ingest jobs and sessions as keyed state machines with timers, over event streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvina.session import share_code
from corvina.streaming.ingest import MAX_ATTEMPTS, retry_delay

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = "job_id string, seq long, us long, event string, status string, stage string, attempts int"
SESSIONS = "session_id string, number int, started long, ended long, turns int, tail array<string>, reason string"
#: Stages of an ingest job, in order; a job that has passed the last one has succeeded.
STAGES = ["parse", "index", "extract"]
#: Turns that a session's history keeps.
TURNS = 200


def use_state(spark: SparkSession) -> None:
    """State in RocksDB: it lives on the executors' disks, with changes in the stream's checkpoint folder."""
    share_code(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class JobMachine(StatefulProcessor):
    """What happens to a job at each of its events: done (its stage is over), failed, cancelled.

    A job runs through the stages and succeeds after the last one. A failure counts an attempt and stops the job until its
    delay has passed, when a timer emits the retry and the stage runs again; the last attempt makes it a dead letter. An event while
    a job waits starts it before its timer. Finished jobs take no events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "seq long, status string, stage int, attempts int, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        seq, status, stage, attempts, timer = old if old else (0, "queued", 0, 0, 0)
        before = timer
        # A batch's rows of one job come in any order.
        for row in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
            if timer and row["us"] // 1000 >= timer:
                # The delay was over before this event, though the watermark hadn't got there yet.
                seq, status = seq + 1, "running"
                yield self._row(key, seq, 1000 * timer, "retry", status, stage, attempts)
                timer = 0
            seq += 1
            if status in ("succeeded", "dead_letter", "cancelled"):
                yield self._row(key, seq, row["us"], "ignored", status, stage, attempts)
                continue
            timer, status = 0, "running"
            if row["event"] == "done":
                stage += 1
                status = "succeeded" if stage == len(STAGES) else "running"
            elif row["event"] == "cancelled":
                status = "cancelled"
            elif row["event"] == "failed":
                attempts += 1
                status = "dead_letter" if attempts >= MAX_ATTEMPTS else "waiting"
                timer = row["us"] // 1000 + 1000 * retry_delay(attempts) if status == "waiting" else 0
            yield self._row(key, seq, row["us"], row["event"], status, stage, attempts)
        if timer != before:
            if before:
                self.handle.deleteTimer(before)
            if timer:
                self.handle.registerTimer(timer)
        self.state.update((seq, status, stage, attempts, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, status, stage, attempts, timer = self.state.get()
        if status == "waiting" and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((seq + 1, "running", stage, attempts, 0))
            yield self._row(key, seq + 1, 1000 * timer, "retry", "running", stage, attempts)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, seq: int, us: int, event: str, status: str, stage: int, attempts: int) -> Row:
        return Row(job_id=key[0], seq=seq, us=us, event=event, status=status, stage=STAGES[min(stage, len(STAGES) - 1)], attempts=attempts)


class SessionMachine(StatefulProcessor):
    """Turns of a session until nobody speaks for ``gap`` seconds; then its row, with the last ``TURNS`` turns."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "number int, started long, ended long, turns int, tail array<string>, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        number, started, ended, turns, tail, before = old if old else (0, 0, 0, 0, [], 0)
        tail = list(tail or [])
        for row in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
            if turns and row["us"] - ended > 1_000_000 * self.gap:
                yield self._row(key, number, started, ended, turns, tail, "gap")
                number, turns, tail = number + 1, 0, []
            started = row["us"] if not turns else started
            ended, turns, tail = row["us"], turns + 1, (tail + [row["turn"]])[-TURNS:]
        timer = ended // 1000 + 1000 * self.gap
        if timer != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.state.update((number, started, ended, turns, tail, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        number, started, ended, turns, tail, timer = self.state.get()
        if turns and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((number + 1, 0, 0, 0, [], 0))
            yield self._row(key, number, started, ended, turns, tail, "expired")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, number: int, started: int, ended: int, turns: int, tail: list[str], reason: str) -> Row:
        return Row(session_id=key[0], number=number, started=started, ended=ended, turns=turns, tail=list(tail), reason=reason)


def job_history(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of events(job_id, event_id, at, event) to the rows of every job's history (:class:`JobMachine`).

    Event time moves the timers, so a replayed stream gives the same rows; a job's events must not be later than ``late``.
    """
    use_state(events.sparkSession)
    keyed = events.select(F.col("job_id").cast("string").alias("job_id"), "event_id", F.col("at").cast("timestamp").alias("at"), "event").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    rows = keyed.groupBy("job_id").transformWithState(statefulProcessor=JobMachine(), outputStructType=HISTORY, outputMode="Append", timeMode="EventTime")
    return rows.select("job_id", "seq", F.timestamp_micros("us").alias("at"), "event", "status", "stage", "attempts")


def sessions(events: DataFrame, gap: int, late: str = "0 seconds") -> DataFrame:
    """A stream of events(session_id, event_id, at, turn) to closed sessions: a pause of more than ``gap`` seconds closes one."""
    use_state(events.sparkSession)
    keyed = events.select(F.col("session_id").cast("string").alias("session_id"), "event_id", F.col("at").cast("timestamp").alias("at"), "turn").withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    rows = keyed.groupBy("session_id").transformWithState(statefulProcessor=SessionMachine(gap), outputStructType=SESSIONS, outputMode="Append", timeMode="EventTime")
    return rows.select("session_id", "number", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "turns", "tail", "reason")
