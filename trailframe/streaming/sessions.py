"""Session lifecycles: batch functions, and one streaming job with idle expiry."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import written


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(key, start, n) of sessions; a pause longer than `gap` starts a new one, one of exactly `gap` does not.

    Works on streams as on tables; a stream needs a watermark on a timestamp column.
    """
    stamp = F.col(ts).cast("timestamp")
    return events.groupBy(key, F.session_window(stamp, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("start")).select(key, "start", "n")


def session_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream, emitted once the watermark has passed their end."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def closed_once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Idempotent closing: one event of each key, within the watermark on a stream."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def live_sessions(deltas: DataFrame, pool: str, order: str, delta: str = "delta") -> DataFrame:
    """`deltas` with `live`: running count of open sessions in each pool, for admission control."""
    return deltas.withColumn("live", F.sum(delta).over(Window.partitionBy(pool).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def _admits(live: int, change: int, most: int) -> bool:
    return change < 0 or live < most


def _after(changes: list[int], most: int, top: int) -> list[int]:
    """The number of live sessions after all requests, for each number from 0 to `top` before them; numbers that meet stay together."""
    place, held = list(range(top + 1)), list(range(top + 1))
    for n, change in enumerate(changes):
        held = [max(0, x + change) if _admits(x, change, most) else x for x in held]
        if n % 16 == 0 and len(held) > 1:
            kept = {x: i for i, x in enumerate(dict.fromkeys(held))}
            place, held = [kept[held[i]] for i in place], list(kept)
    return [held[i] for i in place]


def admitted(requests: DataFrame, pool: str, order: str, most: int, delta: str = "delta") -> DataFrame:
    """`requests` with `admitted`: opening (+1) is refused while `most` sessions of the pool are live; closing (-1) frees one.

    Refused requests do not count as live; a missing delta changes nothing. One refusal changes what follows, but a run of requests, a row of up
    to an Arrow batch, is a function from the number of live sessions before it to that after it. Runs are made wherever their range of the order
    was dealt to; only these functions, of `most` + 1 numbers, are folded a pool, and each run is then told from its own start.
    """
    kind = {c: requests.schema[c].dataType.simpleString() for c in (pool, order)}
    rows = requests.select(F.col(pool).alias("pool"), F.col(order).alias("order"), F.coalesce(F.col(delta).cast("int"), F.lit(0)).alias("delta"))
    top = max(0, most, most - 1 + (rows.agg(F.max("delta")).first()[0] or 0))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pools, changes = b.column(0).to_pylist(), b.column(2).to_pylist()
            cuts = [i for i in range(len(pools)) if i == 0 or pools[i] != pools[i - 1]]
            ends = pa.array([*cuts, len(pools)], pa.int32())
            after = pa.array([_after(changes[i:j], most, top) for i, j in zip(cuts, [*cuts[1:], len(pools)])], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cuts, pa.int32())), *(pa.ListArray.from_arrays(ends, b.column(i)) for i in (1, 2)), after], ["pool", "orders", "deltas", "after"])

    def starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, live = (), 0  # no pool is equal to ()
        for b in batches:
            told = []
            for name, after in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                live = live if name == before else 0
                told.append(live)
                before, live = name, after[live]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(told, pa.int32())], ["run", "live"])

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = 0
        for b in batches:
            told = []
            for at, start, change in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))):
                live = start if at == 0 else live
                told.append(_admits(live, change, most))
                live = max(0, live + change) if told[-1] else live
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(told, pa.bool_())], ["pool", "order", "delta", "admitted"])

    keys = ("pool", "order", "delta")
    made = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(runs, f"pool {kind[pool]}, orders array<{kind[order]}>, deltas array<int>, after array<int>")
    made = written(made.withColumn("run", F.monotonically_increasing_id()), "admitted")  # ids rise with the order
    first = made.select("pool", "run", "after").repartition("pool").sortWithinPartitions("pool", "run").mapInArrow(starts, "run long, live int")
    each = made.join(first, "run").select("pool", "live", F.posexplode(F.arrays_zip("orders", "deltas")).alias("at", "x"))  # a run's rows stay together
    told = each.select("at", "live", "pool", F.col("x.orders").alias("order"), F.col("x.deltas").alias("delta")).mapInArrow(tell, f"pool {kind[pool]}, order {kind[order]}, delta int, admitted boolean")
    return told.select(F.col("pool").alias(pool), F.col("order").alias(order), F.col("delta").alias(delta), "admitted")


def session_states(events: DataFrame, key: str, order: str, event: str = "event") -> DataFrame:
    """(key, state, steps, refused): each session's events run through its machine, in order.

    `init` makes it ready, `step` running, `end` terminated, `fail` failed, `close` closed. Steps of failed or closed
    sessions are refused; terminated ones can still be stepped; closing twice is no error.
    """
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("steps"), F.lit(0).alias("refused"))

    def step(a: Column, e: Column) -> Column:
        name = e["event"]
        refused = F.when(name == "close", False).when(name == "init", a["state"] != "").otherwise(a["state"].isin("", "failed", "closed"))
        state = F.when(name == "init", "ready").when(name == "step", "running").when(name == "end", "terminated").when(name == "fail", "failed").when(name == "close", "closed")
        return F.struct(F.when(refused, a["state"]).otherwise(state).alias("state"), (a["steps"] + (~refused & (name == "step")).cast("int")).alias("steps"), (a["refused"] + refused.cast("int")).alias("refused"))

    runs = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(event).alias("event")))).alias("e"))  # one session's own events
    return runs.select(key, F.aggregate("e", start, step).alias("s")).select(key, "s.state", "s.steps", "s.refused")


#: Legal transitions of a session and of a port.
SESSION = {"ready": ("running", "failed", "closed"), "running": ("running", "terminated", "failed", "closed"), "terminated": ("terminated", "running", "closed"), "failed": ("closed",), "closed": ()}
PORT = {"idle": ("setting_up",), "setting_up": ("occupied", "error"), "occupied": ("tearing_down",), "tearing_down": ("idle", "error"), "error": ("setting_up", "tearing_down")}


def legal(before: Column, after: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether a transition is in the table."""
    out = F.lit(False)
    for a, many in table.items():
        if many:
            out = out | ((before == a) & after.isin(*many))
    return out


def illegal_transitions(states: DataFrame, key: str, order: str, state: str = "state", table: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose state may not follow the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("before", before).where(F.col("before").isNotNull() & ~legal(F.col("before"), F.col(state), table or PORT))


def overlapping_leases(leases: DataFrame, key: str = "vm") -> DataFrame:
    """Leases (start, end) that begin before an earlier one of the same machine ends."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return leases.withColumn("_until", F.max("end").over(w)).where("start < _until").drop("_until")


def assigned_ports(sites: Column, fixed: dict[str, int], bases: list[int], offset: Column, stride: int = 1) -> Column:
    """Ports of a task's sites: fixed ones as given, the i-th other site bases[i] + offset * stride; too many is an error."""
    known = F.create_map(*(x for k, v in fixed.items() for x in (F.lit(k), F.lit(v))))
    others = F.filter(sites, lambda s: ~F.map_contains_key(known, s))
    port = lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(F.array(*map(F.lit, bases)), F.array_position(others, s).cast("int")) + offset * stride)
    return F.when(F.size(others) > len(bases), F.raise_error(F.lit("more sites than port bases")).cast("array<int>")).otherwise(F.transform(sites, lambda s: port(s).cast("int")))


def eval_ports(sites: Column, bases: list[int], slot: Column) -> Column:
    """Ports by place: base + slot + 1, fixed sites taking a place too."""
    return F.transform(sites, lambda s, i: (F.get(F.array(*map(F.lit, bases)), i) + slot + 1).cast("int"))
