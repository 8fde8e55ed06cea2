"""Rules over one trajectory: what was seen before a call, whether each step was legal, and why a trajectory is rejected.

A trajectory is a VARIANT column. All rules are expressions over the row's own lists: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import actions
from trajkit.functions import values as v


def call_ids(message: Column) -> Column:
    return F.transform(v.items(v.get(message, "tool_calls")), lambda c: v.get(c, "id", "string"))


def message_views(messages: Column) -> Column:
    """Of each message what the rules look at: role, ids of its calls, guard flag, content (empty if it is no string)."""
    return F.transform(
        messages,
        lambda m: F.struct(
            v.text(v.get(m, "role")).alias("role"),
            call_ids(m).alias("calls"),
            v.is_true(v.get(m, schema.GUARD_FIELD)).alias("guard"),
            F.coalesce(v.text(v.get(m, "content")), F.lit("")).alias("content"),
        ),
    )


def previous_observation(views: Column, call_id: Column) -> Column:
    """The nearest tool message before the first assistant message with that call, guard messages left out; "" without one."""
    asked = F.array_position(F.transform(views, lambda m: F.coalesce((m["role"] == "assistant") & F.array_contains(m["calls"], call_id), F.lit(False))), True)
    before = lambda at: F.filter(F.slice(views, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), lambda m: (m["role"] == "tool") & ~m["guard"])
    return F.coalesce(v.let(asked, lambda at: F.try_element_at(before(at), F.lit(-1))["content"]), F.lit(""))


def previous_observations(messages: DataFrame, trajectory: str = "trajectory_id", order: str = "message_index") -> DataFrame:
    """The same for messages as rows (role, guard, content), by a window: linear in a long trajectory's messages.

    Adds previous_observation, the content of the nearest earlier tool message without the guard flag.
    """
    seen = F.when((F.col("role") == "tool") & ~F.coalesce(F.col("guard"), F.lit(False)), F.coalesce(F.col("content"), F.lit("")))
    before = Window.partitionBy(trajectory).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_observation", F.coalesce(F.last(seen, ignorenulls=True).over(before), F.lit("")))


def step_reject_reason(views: Column, step: Column) -> Column:
    """The first check that a step fails, NULL if it is legal."""
    call = F.struct(
        v.text(v.get(step, "tool_call.function.name")).alias("name"),
        actions.parsed_arguments(v.get(step, "tool_call.function.arguments")).alias("arguments"),
        v.let(v.get(step, "tool_call.id"), lambda i: F.when(v.truthy(i), v.get(i, "", "string"))).alias("id"),
    )

    def allowed(c: Column) -> Column:
        seen = v.let(previous_observation(views, c["id"]), lambda o: actions.reject_reason(c["name"], c["arguments"], o))
        mapped = v.let(
            actions.tool_action(c["name"], c["arguments"]),
            lambda a: F.when(~a["ok"], "unknown_or_invalid_tool").when(~a["action"].eqNullSafe(v.text(v.get(step, "env_action"))), "env_action_mismatch"),
        )
        return F.coalesce(mapped, seen)

    return v.let(
        call,
        lambda c: F.when(F.coalesce(c["name"], F.lit("")) == "", "missing_tool_name")
        .when(c["arguments"].isNull(), "invalid_arguments_json")
        .when(~v.is_object(c["arguments"]), "arguments_not_object")
        .when(~c["name"].eqNullSafe(v.text(v.get(step, "tool_name"))), "tool_name_mismatch")
        .otherwise(allowed(c)),
    )


def reject_reasons(t: Column) -> Column:
    """Why a trajectory is not accepted, in order; empty if it is.

    Whole-trajectory reasons come first, then messages with several calls, then each step's: its first failed check, and
    whether it does something else than select, buy or think after an option was selected.
    """
    return F.concat(whole_reasons(t), part_reasons(v.items(v.get(t, "steps")), v.items(v.get(t, "messages"))))


def whole_reasons(t: Column) -> Column:
    """The reasons that concern the trajectory as a whole. Outside of lambdas, so that code is generated for it."""
    steps = v.items(v.get(t, "steps"))
    terminal, detail = v.get(t, "terminal_result"), v.get(t, "terminal_result.reward_detail")
    bought = F.exists(steps, lambda s: F.coalesce(v.text(v.get(s, "tool_name")) == "buy_now", F.lit(False)) | F.coalesce(v.text(v.get(s, "env_action")) == "click[Buy Now]", F.lit(False)))
    complete = v.is_object(detail)
    for key in schema.REWARD_KEYS:
        complete = complete & v.get(detail, key).isNotNull()
    whole = [
        F.when(v.truthy(v.get(t, "error")), "has_error"),
        F.when(~v.text(v.get(t, "status")).eqNullSafe(F.lit("done")), "status_not_done"),
        F.when(~v.truthy(v.get(t, "done")), "trajectory_not_done"),
        F.when(~(v.truthy(v.get(terminal, "done")) & v.truthy(v.get(terminal, "over"))), "environment_not_done"),
        F.when(~bought, "missing_buy"),
        F.when(~complete, "reward_detail_incomplete"),
        *[F.when(complete & ~v.equals_one(v.get(detail, key)), f"reward_detail.{key}_not_1") for key in schema.REWARD_KEYS],
    ]
    return F.array_compact(F.array(*whole))


def part_reasons(steps: Column, messages: Column) -> Column:
    """The reasons that concern single messages and steps. Each message is looked at once."""
    return v.let(message_views(messages), lambda views: _part_reasons(steps, views))


def _part_reasons(steps: Column, views: Column) -> Column:
    several = F.transform(views, lambda m, i: F.when((m["role"] == "assistant") & (F.size(m["calls"]) > 1), F.concat(F.lit("message_"), i.cast("string"), F.lit(".multiple_tool_calls"))))
    # Element i of the steps is after a selection if the first one stands before it.
    chosen = F.array_position(F.transform(steps, lambda s: F.coalesce(v.text(v.get(s, "tool_name")) == "select_option", F.lit(False))), True)

    def of_step(s: Column, i: Column, selected: Column) -> Column:
        reason, tool = step_reject_reason(views, s), v.text(v.get(s, "tool_name"))
        late = (selected > 0) & (i >= selected) & ~F.coalesce(tool.isin(*schema.AFTER_SELECTION), F.lit(False))
        prefix = F.concat(F.lit("step_"), i.cast("string"), F.lit("."))
        return F.array(F.concat(prefix, reason), F.when(late, F.concat(prefix, F.lit("action_after_option_selection"))))

    return F.array_compact(F.concat(several, F.flatten(v.let(chosen, lambda c: F.transform(steps, lambda s, i: of_step(s, i, c))))))


def judged(rows: DataFrame, trajectory: str = "trajectory") -> DataFrame:
    """rows with reject_reasons and accepted."""
    return rows.withColumn("reject_reasons", reject_reasons(F.col(trajectory))).withColumn("accepted", F.size("reject_reasons") == 0)


def strict_success(t: Column) -> Column:
    """Status done, done and over really true, all reward components one; steps and errors don't count."""
    out = F.coalesce(v.text(v.get(t, "status")) == "done", F.lit(False))
    for path in ("done", "terminal_result.done", "terminal_result.over"):
        out = out & v.is_true(v.get(t, path))
    for key in schema.REWARD_KEYS:
        out = out & v.equals_one(v.get(t, f"terminal_result.reward_detail.{key}"))
    return out


def terminal_reward(t: Column) -> Column:
    """final_reward of a trajectory that the environment ended, else 0."""
    ended = v.truthy(v.get(t, "done")) & v.is_true(v.get(t, "terminal_result.done")) & v.is_true(v.get(t, "terminal_result.over"))
    return F.when(ended, F.coalesce(v.get(t, "final_reward", "double"), F.lit(0.0))).otherwise(0.0)


def final_reward(t: Column) -> Column:
    """The recorded final reward, or else that of the last step; 0 without either."""
    last = v.get(F.try_element_at(v.items(v.get(t, "steps")), F.lit(-1)), "reward", "double")
    return F.coalesce(v.get(t, "final_reward", "double"), last, F.lit(0.0))


def infrastructure_failure(t: Column) -> Column:
    """Failures of the environment and not of the model, after which collection stops."""
    kind, message = v.text(v.get(t, "error.type")), v.text(v.get(t, "error.message"))
    lease = (kind == schema.LEASE_ERROR[0]) & F.contains(message, F.lit(schema.LEASE_ERROR[1]))
    return v.truthy(v.get(t, "release_error")) | F.coalesce(kind == schema.HTTP_ERROR, F.lit(False)) | F.coalesce(lease, F.lit(False))
