"""The life of a lot: a keyed state machine over commands, as a batch fold of built-in expressions and as a stream with timers.

Commands are rows (lot_id, seq, day, event): still_have, finished, thrown_out,
opened, reopened, undo.  They may carry today (else the command's day), precision
(days give or take, else 0), and facts of the lot: bought_on, consumable and
openable (else unknown, true, true).

A command that breaks a rule changes nothing: a day in the future or before the
purchase, an event of a closed lot but reopened, a reopening of an open one,
opening food or an opened lot.  still_have puts the next question off by 7 days,
then twice as long each time up to 182.  undo takes back the last event once.
"""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

# Days to the question after a first still_have or a reopening, and at most.
FIRST_INTERVAL, MOST_INTERVAL = 7, 182
STATE = "status string, closed_on date, closed_precision int, next_check_on date, interval int, opened_on date"
FIELDS = [f.split()[0] for f in STATE.split(", ")]


class State(NamedTuple):
    status: str = "in_stock"
    closed_on: datetime.date | None = None
    closed_precision: int = 0
    next_check_on: datetime.date | None = None
    interval: int | None = None
    opened_on: datetime.date | None = None


class Command(NamedTuple):
    event: str
    day: datetime.date
    today: datetime.date | None = None
    precision: int = 0
    bought_on: datetime.date | None = None
    consumable: bool = True
    openable: bool = True


def step(state: State, before: State | None, command: Command) -> tuple[State, State | None]:
    """(state, state to return to by undo) after a command."""
    if command.event == "undo":
        return (before, None) if before else (state, None)
    today, day = command.today or command.day, command.day
    in_stock = state.status == "in_stock"
    if day > today or (command.bought_on and day < command.bought_on) or in_stock == (command.event == "reopened"):
        return state, before
    later = lambda start, days: start + datetime.timedelta(days=days)
    if command.event == "still_have":
        interval = min(MOST_INTERVAL, 2 * state.interval) if state.interval else FIRST_INTERVAL
        return state._replace(interval=interval, next_check_on=later(day, interval)), state
    if command.event in ("finished", "thrown_out"):
        return state._replace(status=command.event, closed_on=day, closed_precision=command.precision, next_check_on=None), state
    if command.event == "opened" and command.openable and state.opened_on is None:
        return state._replace(opened_on=day), state
    if command.event == "reopened":
        return state._replace(status="in_stock", closed_on=None, closed_precision=0, interval=None, next_check_on=later(today, FIRST_INTERVAL) if command.consumable else None), state
    return state, before


def _commands(frame: DataFrame, *more: str) -> DataFrame:
    """With the optional columns filled in."""
    given = set(frame.columns)
    fill = {"today": F.col("day"), "precision": F.lit(0), "bought_on": F.lit(None).cast("date"), "consumable": F.lit(True), "openable": F.lit(True)}
    return frame.select("lot_id", "seq", "event", "day", *(F.coalesce(F.col(c), v).alias(c) if c in given else v.alias(c) for c, v in fill.items()), *more)


def _next(held: Column, command: Column) -> Column:
    """``step`` as an expression over struct(now, was) and a command."""
    now, was, day = held["now"], held["was"], command["day"]
    in_stock, event = now["status"] == "in_stock", command["event"]
    refused = (day > command["today"]) | (command["bought_on"].isNotNull() & (day < command["bought_on"])) | (in_stock == (event == "reopened"))
    interval = F.when(now["interval"].isNotNull(), F.least(F.lit(MOST_INTERVAL), 2 * now["interval"])).otherwise(F.lit(FIRST_INTERVAL))
    changed = {
        "still_have": {"interval": interval, "next_check_on": F.date_add(day, interval)},
        "closed": {"status": event, "closed_on": day, "closed_precision": command["precision"], "next_check_on": F.lit(None)},
        "opened": {"opened_on": day},
        "reopened": {"status": F.lit("in_stock"), "closed_on": F.lit(None), "closed_precision": F.lit(0), "interval": F.lit(None), "next_check_on": F.when(command["consumable"], F.date_add(command["today"], FIRST_INTERVAL))},
    }

    def state(kind: str) -> Column:
        new = F.struct(*(changed[kind].get(f, now[f]).cast(t).alias(f) for f, t in (f.split() for f in STATE.split(", "))))
        return F.struct(new.alias("now"), now.alias("was"))

    undone = F.when(was.isNull(), held).otherwise(F.struct(was.alias("now"), F.lit(None).cast(f"struct<{_SHAPE}>").alias("was")))
    return (
        F.when(event == "undo", undone).when(F.coalesce(refused, F.lit(True)), held).when(event == "still_have", state("still_have")).when(event.isin("finished", "thrown_out"), state("closed"))
        .when((event == "opened") & command["openable"] & now["opened_on"].isNull(), state("opened")).when(event == "reopened", state("reopened")).otherwise(held)
    )


_SHAPE = ", ".join(f.replace(" ", ":", 1) for f in STATE.split(", "))


def fold(commands: DataFrame) -> DataFrame:
    """Each lot's state after all its commands, in order of seq; those of equal seq by day and event."""
    listed = _commands(commands).groupBy("lot_id").agg(F.array_sort(F.collect_list(F.struct("seq", "day", "event", *Command._fields[2:]))).alias("commands"))
    first = F.struct(F.struct(*((F.lit(v) if v is not None else F.lit(None)).cast(t).alias(f) for v, (f, t) in zip(State(), (f.split() for f in STATE.split(", ")), strict=True))).alias("now"), F.lit(None).cast(f"struct<{_SHAPE}>").alias("was"))
    return listed.select("lot_id", F.aggregate("commands", first.cast(f"struct<now:struct<{_SHAPE}>,was:struct<{_SHAPE}>>"), _next)["now"].alias("s")).select("lot_id", "s.*")


class Keeper(StatefulProcessor):
    """A lot's state and the one to undo to; if it asks, also a timer on the day of the next question."""

    def __init__(self, asks: bool):
        self.asks = asks

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"now struct<{_SHAPE}>, was struct<{_SHAPE}>")

    def _state(self) -> tuple[State, State | None]:
        found = self.held.get() if self.held.exists() else None
        return (State(*found[0]), State(*found[1]) if found[1] is not None else None) if found else (State(), None)

    def _row(self, key, state: State, due: datetime.date | None) -> Row:
        return Row(lot_id=key[0], **state._asdict(), **({"asks": due} if self.asks else {}))

    def handleInputRows(self, key, rows, timerValues):
        state, before = self._state()
        for row in sorted(rows, key=lambda r: (r["seq"], r["day"], r["event"])):
            state, before = step(state, before, Command(*(row[f] for f in Command._fields)))
        self.held.update((tuple(state), tuple(before) if before else None))
        if self.asks:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)
            if state.next_check_on:
                self.handle.registerTimer(_midnight(state.next_check_on))
        yield self._row(key, state, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, _ = self._state()
        yield self._row(key, state, state.next_check_on)

    def close(self) -> None:
        pass


def _midnight(day: datetime.date) -> int:
    return int(datetime.datetime.combine(day, datetime.time(), datetime.timezone.utc).timestamp() * 1000)


def stream(commands: DataFrame) -> DataFrame:
    """The same over a stream: each batch gives the new state of the lots it names.

    Typed state needs a store of the session that has it; where it has the default one,
    RocksDB's is set.
    """
    return _kept(_commands(commands), False, "None")


def asking(commands: DataFrame, time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """``stream`` plus asks: null in a row of a new state, and in a question of a lot the day that has come for it.

    Days come by the clock, and such a stream looks for them without end; or, with a
    timestamp column as ``time``, as a watermark on it, delay behind the newest command,
    passes them; commands that come later than that are dropped.
    """
    rows = commands if time is None else commands.withWatermark(time, delay)
    return _kept(_commands(rows, *([time] if time else [])), True, "EventTime" if time else "ProcessingTime")


def _kept(commands: DataFrame, asks: bool, time_mode: str) -> DataFrame:
    typed_state(commands.sparkSession)
    shape = f"lot_id long, {STATE}" + (", asks date" if asks else "")
    return commands.groupBy("lot_id").transformWithState(statefulProcessor=Keeper(asks), outputStructType=shape, outputMode="Update", timeMode=time_mode)


def typed_state(spark: SparkSession) -> None:
    """Sets RocksDB's state store where the session has the default one, which holds no typed state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
