"""Summaries of evaluation runs, with the expected tasks as the denominator, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import values as v
from trajkit.operators.trajectories import strict_success


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n.cast("double") / of).otherwise(0.0)


def last_runs(rows: DataFrame, expected: DataFrame, key: str = "task_id", ordinal: str = "ordinal") -> DataFrame:
    """Of each expected task the last row by ordinal."""
    columns = [c for c in rows.columns if c != key]
    known = rows.join(expected.select(key).distinct(), key, "left_semi")
    return known.groupBy(key).agg(F.max_by(F.struct(*columns), ordinal).alias("_row")).select(key, "_row.*")


def first_runs(rows: DataFrame, key: str = "task_id", ordinal: str = "ordinal") -> DataFrame:
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), ordinal).alias("_row")).select(key, "_row.*")


def run_facts(rows: DataFrame, trajectory: str = "trajectory") -> DataFrame:
    """What a summary needs of each trajectory: narrow columns instead of the whole VARIANT."""
    t = F.col(trajectory)
    detail = v.get(t, "terminal_result.reward_detail")
    reasons = F.transform(v.items(v.get(t, "blocked_tool_calls")), lambda b: F.coalesce(v.get(b, "reason", "string"), F.lit("unknown")))
    return rows.select(
        "ordinal", v.get(t, "task_id", "long").alias("task_id"), F.coalesce(v.get(t, "status", "string"), F.lit("unknown")).alias("status"), v.truthy(v.get(t, "done")).alias("done"), strict_success(t).alias("strict"),
        *[(v.is_object(detail) & v.equals_one(v.get(detail, k))).alias(k) for k in schema.REWARD_KEYS], F.coalesce(v.get(t, "final_reward", "double"), F.lit(0.0)).alias("final_reward"), F.size(v.items(v.get(t, "steps"))).alias("steps"), reasons.alias("guard_reasons"),
    )


def benchmark_summary(expected: DataFrame, facts: DataFrame, key: str = "task_id") -> DataFrame:
    """One row of metrics. expected counts with its repeats; of facts the last row of each expected task counts.

    Rates are shares of the expected tasks; the mean reward and steps are means over the completed ones. A denominator of 0
    gives 0.
    """
    wanted = expected.select(F.col(key).cast("long").alias(key)).groupBy(key).agg(F.count("*").alias("times"))
    runs = last_runs(facts, wanted, key)
    both = wanted.join(runs.withColumn("ran", F.lit(True)), key, "left")
    ran, all_ = F.count_if("ran"), F.sum("times")
    one = both.agg(
        F.coalesce(all_, F.lit(0)).alias("expected_tasks"), ran.alias("completed_tasks"), F.array_sort(F.collect_list(F.when(F.col("ran").isNull(), F.col(key)))).alias("missing_tasks"),
        F.count_if("done").alias("done_tasks"), share(F.count_if("done"), all_).alias("done_rate"), F.count_if("strict").alias("strict_successes"),
        F.array_sort(F.collect_list(F.when(F.col("strict"), F.col(key)))).alias("strict_success_task_ids"), share(F.count_if("strict"), all_).alias("strict_success_rate"),
        *[share(F.count_if(k), all_).alias(f"{k}_rate") for k in schema.REWARD_KEYS],
        share(F.sum("final_reward"), ran).alias("mean_final_reward"), share(F.sum("steps"), ran).alias("average_steps"),
    )
    return one.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c.endswith(("rate", "reward", "steps")) and c != "done_tasks" else F.col(c) for c in one.columns])


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def guard_reason_counts(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode("guard_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reject_reason_counts(judged: DataFrame, normalised: bool = False) -> DataFrame:
    """Reasons with their places, or without them where normalised."""
    # An outer explode: for an inner one the optimizer puts a filter before it that computes the reasons again.
    rows = judged.select(F.explode_outer("reject_reasons").alias("reason")).where("reason is not null")
    if normalised:
        rows = rows.select(F.regexp_replace("reason", r"^(step|message)_\d+\.", "").alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def acceptance_totals(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def distinct_counts(rows: DataFrame) -> DataFrame:
    """The exact number of distinct values of each column."""
    return rows.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in rows.columns])


def retention_curve(lengths: DataFrame, limits: tuple[int, ...], length: str = "n_tokens") -> DataFrame:
    """Exact quantiles of lengths and how many rows each limit keeps."""
    c = F.col(length)
    return lengths.agg(F.count("*").alias("total"), *[F.percentile(c, p).alias(n) for p, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"))], F.max(c).alias("longest"), *[F.count_if(c <= k).alias(f"kept_{k}") for k in limits])


def first_block_steps(blocked: DataFrame, trajectory: str = "task_id", step: str = "step_index") -> DataFrame:
    """How many trajectories were first blocked at each step, and the share blocked up to there."""
    first = blocked.groupBy(trajectory).agg(F.min(step).alias("first_step")).groupBy("first_step").agg(F.count("*").alias("n"))
    upto = Window.orderBy("first_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per step number
    whole = Window.orderBy("first_step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return first.select("first_step", "n", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("cumulative_share"))


def group_rewards(rollouts: DataFrame, key: str = "task_id", reward: str = "reward") -> DataFrame:
    """Mean and variance of the rewards of each task's rollouts, and whether they are all 0 or all 1: groups that teach nothing."""
    return rollouts.groupBy(key).agg(F.count("*").alias("n"), F.avg(reward).alias("mean_reward"), F.var_pop(reward).alias("var_reward"), (F.max(reward) == 0).alias("all_zero"), (F.min(reward) == 1).alias("all_one"))
