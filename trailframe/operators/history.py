"""What a model sees of earlier steps, as window frames over (traj_id, step_num)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _steps(before: int | None = None) -> Window:
    return Window.partitionBy("traj_id").orderBy("step_num").rowsBetween(Window.unboundedPreceding if before is None else -before, -1)


def append_history(line: Column, separator: str = "\n") -> Column:
    """All earlier steps' lines; "" at the first step."""
    return F.array_join(F.collect_list(line).over(_steps()), separator)


def overwrite_history(value: Column) -> Column:
    """The step before alone."""
    return F.lag(value, 1).over(Window.partitionBy("traj_id").orderBy("step_num"))


def state_history(memory: Column, state: Column) -> Column:
    """struct(memory, state) of the step before: long memory and short state."""
    return F.lag(F.struct(memory.alias("memory"), state.alias("state")), 1).over(Window.partitionBy("traj_id").orderBy("step_num"))


def multi_turn(steps: DataFrame, window: int | None, user: str = "observation", assistant: str = "response") -> DataFrame:
    """`steps` with messages: user and assistant turns of the last `window` steps, and this step's user turn.

    None takes all steps, 0 this one alone; other values are refused.
    """
    if window is not None and (isinstance(window, bool) or not isinstance(window, int) or window < 0):
        raise ValueError("window must be None or an integer of 0 or more")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    earlier = F.flatten(F.collect_list(F.array(message("user", F.col(user)), message("assistant", F.coalesce(F.col(assistant), F.lit(""))))).over(_steps(window))) if window != 0 else F.array().cast("array<struct<role:string,content:string>>")
    return steps.withColumn("messages", F.concat(earlier, F.array(message("user", F.col(user)))))


def required_memory(steps: DataFrame, memory: str = "memory") -> DataFrame:
    """`steps` with `memory_missing`: an earlier step has no memory."""
    missing = F.max(F.col(memory).isNull().cast("int")).over(_steps())
    return steps.withColumn("memory_missing", F.coalesce(missing, F.lit(0)) == 1)
