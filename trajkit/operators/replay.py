"""Replay of recorded rollouts and planning of further ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import actions
from trajkit.functions import values as v


def blocked_streaks(events: DataFrame, limit: int = schema.BLOCKED_STREAK_LIMIT, trajectory: str = "task_id", order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """events (with boolean blocked) with streak, the blocked calls in a row up to here, and over, whether that reaches limit.

    A step that was carried out ends a streak: calls between two of them form an island.
    """
    before = Window.partitionBy(trajectory).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("_island", F.sum(F.when(F.col("blocked"), 0).otherwise(1)).over(before))
    inside = Window.partitionBy(trajectory, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("streak", F.sum(F.col("blocked").cast("int")).over(inside)).withColumn("over", F.col("streak") >= limit).drop("_island")


def replayed_status(events: DataFrame, max_steps: int, limit: int = schema.BLOCKED_STREAK_LIMIT, trajectory: str = "task_id", order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """How each recorded rollout must have ended, from its log: trajectory, status, steps, blocked, final_reward, after_end.

    events hold kind (step, blocked, final or error), done and reward. A rollout ends at the first event that a final answer,
    an error, a step that ends the environment, the last step allowed, or limit blocked calls in a row make the last; without
    one it is running. The reward is that of the last step carried out. after_end counts events that should not be there.
    """
    if max_steps < 1:
        raise ValueError("max_steps must be positive")
    kind, step = F.col("kind"), F.col("kind") == "step"
    rows = blocked_streaks(events.withColumn("blocked", kind == "blocked"), limit, trajectory, order)
    before = Window.partitionBy(trajectory).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_steps", F.count_if(step).over(before)).withColumn("_n", F.row_number().over(Window.partitionBy(trajectory).orderBy(*order)))
    ended = (
        F.when(kind == "final", "assistant_final")
        .when(kind == "error", "error")
        .when(F.col("over") & (kind == "blocked"), "invalid_action_limit")
        .when(step & F.coalesce(F.col("done"), F.lit(False)), "done")
        .when(step & (F.col("_steps") >= max_steps), "max_steps")
    )
    rows = rows.withColumn("_end", ended)
    rows = rows.withColumn("_last", F.min(F.when(F.col("_end").isNotNull(), F.col("_n"))).over(Window.partitionBy(trajectory)))
    inside = F.col("_last").isNull() | (F.col("_n") <= F.col("_last"))
    return rows.groupBy(trajectory).agg(
        F.coalesce(F.max(F.when(F.col("_n") == F.col("_last"), F.col("_end"))), F.lit("running")).alias("status"),
        F.count_if(inside & step).alias("steps"),
        F.count_if(inside & (kind == "blocked")).alias("blocked"),
        F.coalesce(F.max_by(F.when(inside & step, F.col("reward")), F.when(inside & step, F.col("_n"))), F.lit(0.0)).alias("final_reward"),
        F.count_if(~inside).alias("after_end"),
    )


def option_latch(events: DataFrame, tool: str = "tool", trajectory: str = "task_id", order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """events with late: an option was selected before, and this is neither a selection, a purchase nor a thought."""
    before = Window.partitionBy(trajectory).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    selected = F.coalesce(F.max(F.when(F.col(tool) == "select_option", 1).otherwise(0)).over(before), F.lit(0)) == 1
    return events.withColumn("late", selected & ~F.coalesce(F.col(tool).isin(*schema.AFTER_SELECTION), F.lit(False)))


def capped_steps(events: DataFrame, max_steps: int, trajectory: str = "task_id", order: tuple[str, ...] = ("step_index",)) -> DataFrame:
    """The first max_steps rows of each trajectory."""
    if max_steps < 1:
        raise ValueError("max_steps must be positive")
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(trajectory).orderBy(*order))).where(F.col("_n") <= max_steps).drop("_n")


def accept_until(rows: DataFrame, target: int, order: str = "ordinal") -> DataFrame:
    """Rows, in order, up to the one with which `accepted` reaches target, with running, the accepted ones so far.

    order is any column that sorts, a scan's ordinal included. The rows are sorted in ranges; the sums of the ranges before
    and a window inside each give the running total, so that no task sees all rows. Ranges are the sort's partitions: the rows
    are kept while both are made, so that a range means the same rows in both.
    """
    laid = rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    sums = laid.groupBy("_part").agg(F.count_if("accepted").alias("_sum"))
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.join(F.broadcast(sums), "_part").withColumn("running", F.col("_before") + F.sum(F.col("accepted").cast("long")).over(inside))  # one row a range
    return laid.where(F.col("running") - F.col("accepted").cast("long") < target).drop("_part", "_before", "_at")


def resume_plan(tasks: DataFrame, completed: DataFrame, attempts: int, key: str = "task_id") -> DataFrame:
    """(ordinal, key, attempt_index) still to run: each task by each attempt, less those completed."""
    if attempts < 1:
        raise ValueError("attempts must be positive")
    every = tasks.withColumn("attempt_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(attempts - 1).cast("long"))))
    return every.join(completed.select(key, "attempt_index").distinct(), [key, "attempt_index"], "left_anti")


def first_call(calls: Column) -> Column:
    """struct(kept, dropped): one call is carried out, the rest is recorded."""
    return F.struct(F.slice(calls, 1, 1).alias("kept"), F.slice(calls, F.lit(2), F.greatest(F.size(calls) - 1, F.lit(0))).alias("dropped"))


def observation_of(result: Column) -> Column:
    """The instruction of a reset, or else the observation, or nothing."""
    return F.coalesce(v.get(result, "instruction", "string"), v.get(result, "observation", "string"), F.lit(""))


def tool_message(call_id: Column, name: Column, content: Column) -> Column:
    return F.struct(F.lit("tool").alias("role"), call_id.alias("tool_call_id"), name.alias("name"), content.alias("content"))


def initial_messages(prompt: Column, system: str, instruction: Column) -> Column:
    """prompt (role, content structs) with the system message before it unless it has one, and the instruction after it."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.coalesce(prompt, F.array().cast("array<struct<role:string,content:string>>"))
    start = F.when(F.exists(prompt, lambda m: m["role"] == "system"), F.array().cast("array<struct<role:string,content:string>>")).otherwise(F.array(message("system", F.lit(system))))
    return F.concat(start, prompt, F.array(message("user", instruction)))


def action_mismatches(rows: DataFrame, trajectory: str = "trajectory") -> DataFrame:
    """Steps whose recorded action is not the one their call maps to: trajectory_id, step, recorded, derived, ok."""
    t = F.col(trajectory)
    steps = rows.select(v.get(t, "trajectory_id", "string").alias("trajectory_id"), F.posexplode(v.items(v.get(t, "steps"))).alias("step", "s"))
    derived = actions.tool_action(v.text(v.get(F.col("s"), "tool_call.function.name")), actions.parsed_arguments(v.get(F.col("s"), "tool_call.function.arguments")))
    out = steps.select("trajectory_id", "step", v.text(v.get(F.col("s"), "env_action")).alias("recorded"), derived.alias("d")).select("trajectory_id", "step", "recorded", F.col("d.action").alias("derived"), F.col("d.ok").alias("ok"))
    return out.where(~F.col("ok") | ~F.col("recorded").eqNullSafe(F.col("derived")))


def rl_record(task_id: Column, instruction: Column, system: str, split: str, index: Column, environment: str, ability: str = "shopping") -> Column:
    """The prompt record of an online-RL dataset, for the environment of that name: nothing the model may not see. An empty instruction fails the query."""
    shown = F.when(F.coalesce(instruction, F.lit("")) == "", F.raise_error(F.concat(F.lit("no instruction for task "), task_id.cast("string"))).cast("string")).otherwise(instruction)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    arguments = F.struct(F.lit(environment).alias("name"), task_id.cast("long").alias("task_id"))
    return F.struct(
        F.lit(environment).alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", shown)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.lit(None).cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), task_id.cast("long").alias("task_id"), arguments.alias("interaction_kwargs")).alias("extra_info"),
    )
