"""Curation: segmentation, filters, shortest per goal, resumable joins, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_spans(lines: DataFrame, key: str = "traj_num", order: str = "ordinal") -> DataFrame:
    """(key, low, high, error) of a crawl's runs: a run ends where `key` advances by one.

    `error` tells a gap before the key, or lines of it that do not all follow those of the key before. Keys meet their
    predecessors by a join, so no task sees the whole crawl in order.
    """
    spans = lines.groupBy(key).agg(F.min(order).alias("low"), F.max(order).alias("high"))
    before = spans.select((F.col(key) + 1).alias(key), F.col("high").alias("_before"))
    first = spans.agg(F.min(key)).first()[0]  # one number
    error = F.when((F.col(key) > F.lit(first)) & F.col("_before").isNull(), F.lit("gap")).when(F.col("_before") >= F.col("low"), F.lit("order"))
    return spans.join(before, key, "left").select(key, "low", "high", error.alias("error"))


def segment_runs(lines: DataFrame, key: str = "traj_num", order: str = "ordinal", carried: tuple[str, ...] = ()) -> DataFrame:
    """`lines` with run_id, the key of their run, and the last line's `carried` columns as last_<name>.

    Lines out of order or with a gap in their keys are an error, since no cut is sure there.
    """
    spans = run_spans(lines, key, order)
    told = F.when(F.col("error").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(": "), F.col("error"))).cast("long"))
    last = lines.groupBy(key).agg(*(F.max_by(c, order).alias(f"last_{c}") for c in carried)) if carried else None
    runs = spans.select(key, told.alias("run_id"))
    runs = runs.join(last, key) if last is not None else runs
    return lines.join(runs, key)


def dense_steps(steps: DataFrame, order: str, *needed: str) -> DataFrame:
    """Rows with all of `needed`, numbered densely from 0 within their trajectory."""
    kept = steps.where(" AND ".join(f"{c} IS NOT NULL" for c in needed)) if needed else steps
    return kept.withColumn("step_num", F.row_number().over(Window.partitionBy("traj_id").orderBy(order)) - 1)


def synthetic_response(thought: Column, action: Column) -> Column:
    return F.concat(F.lit("<think>"), thought, F.lit("</think>\n<action>"), action, F.lit("</action>"))


def usable(domain: Column, success: Column, num_steps: Column, excluded: str = "gitlab") -> Column:
    """Successful trajectories of a step or more outside the excluded domain."""
    return ~F.contains(F.lower(domain), F.lit(excluded)) & success & (num_steps >= 1)


def shortest_per_goal(trajectories: DataFrame, k: int = 1, goal: str = "goal", steps: str = "num_steps", ordinal: str = "ordinal") -> DataFrame:
    """The k shortest trajectories of each goal, the earliest first on ties; -1 keeps all, 0 none."""
    if k == -1:
        return trajectories
    place = F.row_number().over(Window.partitionBy(goal).orderBy(steps, ordinal))
    return trajectories.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def not_done(inputs: DataFrame, outputs: DataFrame, on: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(on), on, "left_anti")


def sliced(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows [start, end) in order."""
    return df.orderBy(order).offset(start).limit(max(0, end - start))


def count_mismatch(labels: DataFrame, steps: DataFrame, on: str) -> DataFrame:
    """Trajectories whose number of labels is not their number of steps: (on, n_labels, n_steps)."""
    a, b = labels.groupBy(on).agg(F.count(F.lit(1)).alias("n_labels")), steps.groupBy(on).agg(F.count(F.lit(1)).alias("n_steps"))
    return a.join(b, on).where(F.col("n_labels") != F.col("n_steps"))


def last_label(labels: DataFrame, *keys: str, line: str = "line_num", value: str = "memory") -> DataFrame:
    """One label a key: the last line wins."""
    return labels.groupBy(*keys).agg(F.max_by(value, line).alias(value))


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(on, side): keys that one side alone has."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def contiguity_errors(steps: DataFrame) -> DataFrame:
    """Trajectories whose step numbers are not 0, 1, ... n - 1."""
    sums = steps.groupBy("traj_id").agg(F.min("step_num").alias("low"), F.max("step_num").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("step_num").alias("d"))
    return sums.where("NOT (low = 0 AND high = n - 1 AND d = n)")


def selected(tasks: DataFrame, ids: list[int], on: str = "task_id", missing_ok: bool = False) -> DataFrame:
    """Tasks in the order of `ids`, repeated where an id is; ids without a task are an error that names them.

    The caller's list is the small side.
    """
    wanted = tasks.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{on} long, position int")
    if not missing_ok:
        known = {r[0] for r in tasks.where(F.col(on).isin(sorted(set(ids)))).select(on).distinct().collect()}  # no more than the list
        if gone := [i for i in dict.fromkeys(ids) if i not in known]:
            raise ValueError(f"no task for {gone}")
    return wanted.hint("broadcast").join(tasks, on).orderBy("position")


def task(tasks: DataFrame, task_id: int, on: str = "task_id", order: str = "position") -> DataFrame:
    """The task of an id, the first one if there are several."""
    return tasks.where(F.col(on) == task_id).orderBy(order).limit(1)


def with_labels(labels: DataFrame, trajectories: DataFrame, on: str = "traj_id") -> DataFrame:
    """Labels beside the trajectories of their stem; labels without one are left out."""
    return labels.join(trajectories, on)


def steps_with_memory(steps: DataFrame, labels: DataFrame, value: str = "memory") -> DataFrame:
    """Steps beside their label, of which the last line wins; a step without one is an error."""
    told = last_label(labels, "traj_id", "step_num", value=value)
    name = F.concat(F.lit("no label for step "), F.col("step_num").cast("string"), F.lit(" of "), F.col("traj_id").cast("string"))
    found = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(name).cast("string"))
    return steps.drop(value).join(told, ["traj_id", "step_num"], "left").withColumn(value, found)


def label_order_errors(labels: DataFrame, steps: DataFrame, on: str = "traj_id") -> DataFrame:
    """(on, labelled, expected): trajectories whose labels, line by line, do not name just their steps in order."""
    a = labels.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "step"))), lambda x: x["step"]).alias("labelled"))  # a trajectory's own steps
    b = steps.groupBy(on).agg(F.array_sort(F.collect_list("step_num")).alias("expected"))
    return a.join(b, on).where(F.col("labelled") != F.col("expected"))


def sound_labels(labels: DataFrame, steps: DataFrame, on: str = "traj_id") -> DataFrame:
    """The labels of trajectories that have just as many labels as steps; the others' are dropped."""
    return labels.join(count_mismatch(labels, steps, on).select(on), on, "left_anti")


def status_histogram(rows: DataFrame, status: str = "status") -> DataFrame:
    """(status, n)."""
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def planned(inputs: DataFrame, outputs: DataFrame, on: str, steps: str = "num_steps", force: bool = False) -> DataFrame:
    """One row: to_generate, to_skip, steps of all; what a run would do."""
    done = inputs.join(outputs.select(on, F.lit(True).alias("_done")).distinct(), on, "left")
    skip = F.coalesce("_done", F.lit(False)) & F.lit(not force)
    return done.agg(F.count_if(~skip).alias("to_generate"), F.count_if(skip).alias("to_skip"), F.coalesce(F.sum(steps), F.lit(0)).cast("long").alias("steps"))


def numeric_order(df: DataFrame, stem: str = "task_id") -> DataFrame:
    """Rows in the numeric order of stems; others are an error."""
    return df.orderBy(F.col(stem).cast("long"))


def stems(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The stems that either side has, each once."""
    return left.select(on).union(right.select(on)).distinct()


def shown(ids: Column, most: int = 10) -> Column:
    """The first `most` ids, and how many there are if there are more."""
    told = F.array_join(F.slice(ids.cast("array<string>"), 1, most), ", ")
    return F.when(F.size(ids) > most, F.concat(told, F.lit(", ... ("), F.size(ids).cast("string"), F.lit(" total)"))).otherwise(told)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def replicated(tasks: DataFrame, draws: int, samples: int) -> DataFrame:
    """Cyclic draws of tasks: `samples` rows a draw with unique index and one group_index; tasks have offsets from 0."""
    n = tasks.count()
    drawn = tasks.sparkSession.range(draws).withColumnRenamed("id", "group_index").withColumn("offset", F.col("group_index") % max(1, n))
    return drawn.join(tasks, "offset").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("index", F.col("group_index") * samples + F.col("_k")).drop("_k")
