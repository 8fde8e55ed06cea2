"""Supervised fine-tuning rows from accepted trajectories: guard talk out, hidden fields out, the final page redacted."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import values as v
from trajkit.operators.trajectories import call_ids


def terminal_call_id(t: Column) -> Column:
    """The call of the last step that ended a trajectory that is done; NULL without one."""
    ended = F.filter(v.items(v.get(t, "steps")), lambda s: v.truthy(v.get(s, "done")))
    return F.when(v.truthy(v.get(t, "done")), v.get(F.try_element_at(ended, F.lit(-1)), "tool_call.id", "string"))


def blocked_ids(t: Column) -> Column:
    return F.array_compact(F.transform(v.items(v.get(t, "blocked_tool_calls")), lambda b: v.get(b, "tool_call.id", "string")))


def is_guard(message: Column) -> Column:
    return v.is_true(v.get(message, schema.GUARD_FIELD))


def is_blocked(message: Column, blocked: Column) -> Column:
    """A guard message, the answer to a blocked call, or an assistant message with any blocked call."""
    role = v.text(v.get(message, "role"))
    answer = (role == "tool") & F.array_contains(blocked, v.get(message, "tool_call_id", "string"))
    asked = (role == "assistant") & F.coalesce(F.arrays_overlap(call_ids(message), blocked), F.lit(False))
    return is_guard(message) | F.coalesce(answer, F.lit(False)) | F.coalesce(asked, F.lit(False))


def _object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of those fields whose JSON text isn't NULL."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(json.dumps(k) + ":"), c) for k, c in fields])), ","), F.lit("}"))


def _field(value: Column, name: str) -> Column:
    """The JSON text of a field, null if it holds null, NULL if it is missing."""
    return F.to_json(v.get(value, name))


def clean_call(call: Column) -> Column:
    function = v.get(call, "function")
    named = F.when(function.isNotNull(), F.when(v.is_object(function), _object([(k, _field(function, k)) for k in ("name", "arguments")])).otherwise(F.to_json(function)))
    return _object([("id", _field(call, "id")), ("type", _field(call, "type")), ("function", named)])


def clean_message(message: Column, terminal: Column, reasons: Column) -> Column:
    """JSON text of the fields that may be learned from; reasons says whether this message keeps its reasoning, in the content."""
    role = v.text(v.get(message, "role"))
    reasoning = F.regexp_replace(v.text(v.get(message, "reasoning_content")), r"(?U)^\s+|\s+$", "")
    content = v.get(message, "content")
    thought = F.concat(F.lit("<think>"), reasoning, F.lit("</think>"), F.when(v.truthy(content), F.concat(F.lit("\n"), v.as_text(content))).otherwise(""))
    thinks = reasons & (role == "assistant") & (F.coalesce(reasoning, F.lit("")) != "")
    last = (role == "tool") & v.get(message, "tool_call_id", "string").eqNullSafe(terminal)
    shown = F.when(F.coalesce(last, F.lit(False)), v.json_text(F.lit(schema.PURCHASE_DONE))).when(F.coalesce(thinks, F.lit(False)), v.json_text(thought)).otherwise(_field(message, "content"))
    calls = v.get(message, "tool_calls")
    cleaned = F.when(calls.isNotNull(), F.when(v.is_list(calls), F.concat(F.lit("["), F.array_join(F.transform(v.items(calls), clean_call), ","), F.lit("]"))).otherwise(F.to_json(calls)))
    special = {"content": shown, "tool_calls": cleaned}
    return _object([(k, special.get(k, _field(message, k))) for k in schema.MESSAGE_FIELDS])


def training_messages(t: Column, retain_reasoning: bool = False) -> Column:
    """The messages to learn from, as a list of VARIANT objects.

    A message that comes right after a guard message never keeps its reasoning, even where reasoning is retained.
    """
    messages, blocked, terminal = v.items(v.get(t, "messages")), blocked_ids(t), terminal_call_id(t)
    placed = F.transform(messages, lambda m, i: F.struct(m.alias("m"), F.coalesce(is_guard(F.try_element_at(messages, F.when(i > 0, i))), F.lit(False)).alias("after_guard")))
    kept = F.filter(placed, lambda p: ~is_blocked(p["m"], blocked))
    return F.transform(kept, lambda p: F.parse_json(clean_message(p["m"], terminal, F.lit(retain_reasoning) & ~p["after_guard"])))


def sft_rows(rows: DataFrame, trajectory: str = "trajectory", retain_reasoning: bool = False) -> DataFrame:
    """trajectory_id, task_id, messages, tools of accepted trajectories; other columns are dropped."""
    t = F.col(trajectory)
    tools = F.parse_json(F.lit(json.dumps(schema.tool_schemas())))
    return rows.select(v.get(t, "trajectory_id", "string").alias("trajectory_id"), v.get(t, "task_id", "long").alias("task_id"), training_messages(t, retain_reasoning).alias("messages"), tools.alias("tools"))


def sft_json(rows: DataFrame) -> DataFrame:
    """SFT rows as JSON lines in `value`."""
    def null(c: Column) -> Column:
        return F.coalesce(c, F.lit("null"))

    listed = F.concat(F.lit("["), F.array_join(F.transform("messages", lambda m: F.to_json(m)), ","), F.lit("]"))
    return rows.select(_object([("trajectory_id", null(v.json_text(F.col("trajectory_id")))), ("task_id", null(F.col("task_id").cast("string"))), ("messages", listed), ("tools", F.to_json("tools"))]).alias("value"))


def leaks(rows: DataFrame) -> DataFrame:
    """SFT rows with a message field that may not be there, or with a tool message that still shows the end of the purchase."""
    odd = F.exists("messages", lambda m: F.size(F.array_except(F.json_object_keys(F.to_json(m)), F.array(*map(F.lit, schema.MESSAGE_FIELDS)))) > 0)
    return rows.where(odd)
