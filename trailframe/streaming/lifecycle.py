"""Session machines with idle expiry: the same fold on tables (a window and an aggregation) and on streams (keyed state and timers).

A record begins with an id's first event and ends by idleness: strictly more than `idle` seconds after the last event that it
accepted (after its first, if it accepted none). The next event of the id then begins a new record, which needs its own `init`.
Events: `init` makes a record ready, `step` running, `end` terminated, `fail` failed, `close` closed. Refused are `init` of a
record that has a state, all but `close` before `init` and after `fail` or `close`, and other names, null too. Refused events
are counted and do not keep a record alive. Times count in whole milliseconds, as watermarks do; events of one time go by
`order` (null first), then by name. Events without an id or a time belong to no record and are left out.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE = 1800
STORE = "spark.sql.streaming.stateStore"
STATES = {"init": "ready", "step": "running", "end": "terminated", "fail": "failed", "close": "closed"}
DEAD = ("", "failed", "closed")
RECORD = "started long, last long, state string, steps int, refused int"


def _events(events: DataFrame, key: str, ts: str, order: str, event: str) -> DataFrame:
    """(key, ts as a timestamp, t in milliseconds, o, name) of events that have an id and a time."""
    stamp = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key), stamp.alias("ts"), F.unix_millis(stamp).alias("t"), F.col(order).cast("long").alias("o"), F.coalesce(event, F.lit("")).alias("name"))
    return rows.where(F.col(key).isNotNull() & F.col("ts").isNotNull())


def _told(records: DataFrame, key: str) -> DataFrame:
    ending = F.when(F.col("state") == "closed", "closed").otherwise("expired")
    return records.select(key, F.timestamp_millis("started").alias("started"), F.timestamp_millis("last").alias("last"), "state", "steps", "refused", ending.alias("ending"))


def lifecycles(events: DataFrame, now: int, key: str, ts: str = "ts", order: str = "event_id", event: str = "event", idle: int = IDLE) -> DataFrame:
    """(key, started, last, state, steps, refused, ending) of the records of a table that have ended by `now` (milliseconds).

    A pause of more than `idle` between any two events of an id always ends a record, so only the events between such pauses
    are gathered and folded.
    """
    most = idle * 1000
    w = Window.partitionBy(key).orderBy("t", "o")
    pauses = _events(events, key, ts, order, event).withColumn("_cut", (F.col("t") - F.lag("t").over(w) > most).cast("int"))
    bursts = pauses.withColumn("_burst", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    runs = bursts.groupBy(key, "_burst").agg(F.array_sort(F.collect_list(F.struct("t", "o", "name"))).alias("e"))  # one burst of one id
    start = F.from_json(F.lit('{"done": [], "state": "", "steps": 0, "refused": 0}'), f"done array<struct<{RECORD.replace(' ', ':').replace(',:', ', ')}>>, {RECORD}")
    of = lambda a: F.struct(*(a[c].alias(c) for c in ("started", "last", "state", "steps", "refused")))

    def step(a: Column, e: Column) -> Column:
        over = F.coalesce(e["t"] - a["last"] > most, F.lit(False))
        state = F.when(over, "").otherwise(a["state"])
        kept = lambda c: F.when(over, 0).otherwise(a[c])
        name = e["name"]
        refused = F.when(~name.isin(*STATES), True).when(name == "close", False).when(name == "init", state != "").otherwise(state.isin(*DEAD))
        following = F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), name)
        return F.struct(
            F.when(over, F.concat(a["done"], F.array(of(a)))).otherwise(a["done"]).alias("done"),
            F.when(over | a["started"].isNull(), e["t"]).otherwise(a["started"]).alias("started"),
            F.when(over | a["last"].isNull() | ~refused, e["t"]).otherwise(a["last"]).alias("last"),
            F.when(refused, state).otherwise(following).alias("state"),
            (kept("steps") + (~refused & (name == "step")).cast("int")).alias("steps"),
            (kept("refused") + refused.cast("int")).alias("refused"),
        )

    folded = runs.select(key, F.aggregate("e", start, step, lambda a: F.concat(a["done"], F.array(of(a)))).alias("r"))
    return _told(folded.select(key, F.inline("r")).where(F.col("last") + most < now), key)


class Lifecycle(StatefulProcessor):
    """The fold of one id: events wait in state until the watermark has passed them, so that they are taken in order."""

    def __init__(self, key: str, idle: int = IDLE) -> None:
        self.key, self.most = key, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.waiting = handle.getListState("waiting", "t long, o long, name string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r["t"], r["o"], r["name"]) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(min(t for t, _, _ in came))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Take what the watermark has passed, end the record if it is idle, and set the timer of what comes next."""
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(e) for e in self.waiting.get()]
        due = sorted((e for e in waiting if e[0] < mark), key=lambda e: (e[0], e[1] is not None, e[1] or 0, e[2]))
        later = [e for e in waiting if e[0] >= mark]
        record = tuple(self.record.get()) if self.record.exists() else None
        ended = []
        for t, _, name in due:
            if record and t - record[1] > self.most:
                ended.append(record)
                record = None
            record = self.taken(record or (t, t, "", 0, 0), t, name)
        if record and mark - record[1] > self.most:
            ended.append(record)
            record = None
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if record:
            self.record.update(record)
            self.handle.registerTimer(record[1] + self.most)
        else:
            self.record.clear()
        if later:
            self.handle.registerTimer(min(e[0] for e in later))
        for started, last, state, steps, refused in ended:
            yield Row(**{self.key: key[0]}, started=started, last=last, state=state, steps=steps, refused=refused)

    @staticmethod
    def taken(record: tuple, t: int, name: str) -> tuple:
        """The record after one event."""
        started, last, state, steps, refused = record
        if name not in STATES or (name == "init" and state) or (name not in ("init", "close") and state in DEAD):
            return started, last, state, steps, refused + 1
        return started, t, STATES[name], steps + (name == "step"), refused

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, key: str, ts: str = "ts", order: str = "event_id", event: str = "event", idle: int = IDLE, late: str = "0 seconds") -> DataFrame:
    """The rows of `lifecycles` from a stream, each as soon as the watermark is past its end; `late` is how far events may lag.

    State a partition holds: one record an id that is alive, and the events within `late` of the newest. Needs the RocksDB
    state store (`rocksdb_state`). The query's checkpoint carries records, waiting events and timers over a restart.
    """
    rows = _events(events, key, ts, order, event).withWatermark("ts", late)
    kind = rows.schema[key].dataType.simpleString()
    made = rows.groupBy(key).transformWithState(Lifecycle(key, idle), f"{key} {kind}, {RECORD}", "Append", "EventTime")
    return _told(made, key)


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, with changelogs in the checkpoint; settings are put back after."""
    wanted = {f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
