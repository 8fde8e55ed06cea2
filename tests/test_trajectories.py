import json

import pytest
from pyspark.sql import functions as F

from tests.data import ASIN, PAGE, call, lines, trajectory
from trajkit import schema
from trajkit.functions import actions
from trajkit.functions import values as v
from trajkit.operators import evaluation, replay, sft, trajectories


def parsed(spark, rows):
    schema.configure(spark)
    return spark.createDataFrame(lines(rows), "ordinal long, raw string").withColumn("trajectory", F.parse_json("raw"))


def reasons(spark, rows):
    return [r[0] for r in trajectories.judged(parsed(spark, rows)).orderBy("ordinal").select("reject_reasons").collect()]


def edited(edit):
    t = trajectory()
    edit(t)
    return t


def _parallel(t):
    t["messages"][2]["tool_calls"].append(call(9, "think", {"note": "x"}))


def _stale_product(t):
    t["messages"][3]["content"] = "nothing"


def _unseen_option(t):
    t["messages"][5]["content"] = '可点击的按钮: ["Blue", "Buy Now"]'


def _browse_after_option(t):
    t["steps"][3]["tool_call"] = call(3, "prev_page", {})
    t["steps"][3] |= {"tool_name": "prev_page", "env_action": "click[< Prev]"}


def _extra(t):
    t["steps"][3]["tool_call"]["function"]["arguments"] = '{"b":1,"a":2}'


def _arguments(text):
    def edit(t):
        t["steps"][3]["tool_call"]["function"]["arguments"] = text

    return edit


def _guarded_detour(t):
    detour = call(8, "open_product", {"asin": "999999999999"})
    t["messages"][4:4] = [{"role": "assistant", "tool_calls": [detour]}, {"role": "tool", "tool_call_id": "c8", "content": "no", "runtime_action_guard": True}]
    t["blocked_tool_calls"] = [{"tool_call": detour, "reason": "x"}]


CASES = [
    (lambda t: None, []),
    (_guarded_detour, []),
    (lambda t: t.update(error={"type": "X"}), ["has_error"]),
    (lambda t: t.update(status="max_steps", done=0), ["status_not_done", "trajectory_not_done"]),
    (lambda t: t["terminal_result"].update(over=0), ["environment_not_done"]),
    (lambda t: t["terminal_result"]["reward_detail"].update(r_option="1"), ["reward_detail.r_option_not_1"]),
    (lambda t: t["terminal_result"]["reward_detail"].pop("r_att"), ["reward_detail_incomplete"]),
    (lambda t: t["terminal_result"].update(reward_detail=[1]), ["reward_detail_incomplete"]),
    (lambda t: t["steps"].pop(), ["missing_buy"]),
    (_parallel, ["message_2.multiple_tool_calls"]),
    (_stale_product, ["step_1.click_not_in_previous_observation"]),
    (_unseen_option, ["step_2.click_not_in_previous_observation"]),
    (_browse_after_option, ["missing_buy", "step_3.action_after_option_selection"]),
    (_extra, ["step_3.schema_extra_arguments:a,b"]),
    (_arguments("{"), ["step_3.invalid_arguments_json"]),
    (_arguments(3), ["step_3.invalid_arguments_json"]),
    (_arguments("[1]"), ["step_3.arguments_not_object"]),
    (_arguments(""), []),
    (lambda t: t["steps"][0].update(tool_name="think"), ["step_0.tool_name_mismatch"]),
    (lambda t: t["steps"][0].update(env_action="search[x]"), ["step_0.env_action_mismatch"]),
    (lambda t: t["steps"][0]["tool_call"]["function"].update(name=None), ["step_0.missing_tool_name"]),
    (lambda t: t["steps"][1]["tool_call"]["function"].update(arguments="{}"), ["step_1.unknown_or_invalid_tool"]),
    (lambda t: t["steps"][1].update(tool_call=t["steps"][1]["tool_call"] | {"id": "gone"}), ["step_1.missing_previous_observation"]),
    (lambda t: t["steps"][3].update(done=False), []),
]


def test_each_change_gives_its_reason(spark):
    assert reasons(spark, [edited(edit) for edit, _ in CASES]) == [r for _, r in CASES]


def test_an_added_error_never_makes_a_row_accepted(spark):
    rows = [edited(edit) | {"error": "x"} for edit, _ in CASES]
    assert all(r[0] == "has_error" for r in reasons(spark, rows))


def test_empty_trajectory(spark):
    assert reasons(spark, [{}]) == [["status_not_done", "trajectory_not_done", "environment_not_done", "missing_buy", "reward_detail_incomplete"]]


def test_truthiness(spark):
    values = ["null", "false", "0", "0.0", '""', "[]", "{}", "true", "1", "0.5", '"0"', "[0]", '{"a":0}', '"1"', "1.0", "2"]
    schema.configure(spark)
    rows = spark.createDataFrame(lines(values), "i long, j string").select("i", F.parse_json("j").alias("x")).orderBy("i")
    got = rows.select(v.truthy(F.col("x")).alias("t"), v.is_true(F.col("x")).alias("r"), v.equals_one(F.col("x")).alias("o")).collect()
    assert [g["t"] for g in got] == [bool(json.loads(x)) for x in values]
    assert [g["r"] for g in got] == [json.loads(x) is True for x in values]
    assert [g["o"] for g in got] == [json.loads(x) == 1 for x in values]
    assert not spark.range(1).select(v.truthy(F.lit(None).cast("variant"))).first()[0]


def test_actions(spark):
    cases = [("search_products", '{"query":5}', (True, "search[5]")), ("search_products", '{"query":null}', (True, "search[None]")), ("open_product", '{"asin":true}', (True, "click[True]")), ("buy_now", "{}", (True, "click[Buy Now]")), ("think", "{}", (True, None)), ("open_product", "{}", (False, None)), ("fly", "{}", (False, None)), ("select_option", '{"value":1.5}', (True, "click[1.5]"))]
    rows = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(cases)], "i long, n string, a string").orderBy("i")
    assert [tuple(r[0]) for r in rows.select(actions.tool_action(F.col("n"), F.parse_json("a"))).collect()] == [c for _, _, c in cases]


def test_observations(spark):
    texts = [f"a{ASIN}b {ASIN} 1{ASIN} ２２２２２２２２２２２２", PAGE, "可点击的按钮: [broken]", "可点击的按钮:\n [\"x\"] tail [1]", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(actions.product_ids(F.col("t")).alias("p"), actions.clickable_buttons(F.col("t")).alias("b")).collect()
    assert rows[0]["p"] == [ASIN, "２２２２２２２２２２２２"]
    assert [r["b"] for r in rows] == [[], ["Red", "Buy Now", "< Prev"], [], [], [], []]


@pytest.mark.parametrize(
    ("name", "arguments", "page", "reason"),
    [
        ("think", '{"note":"x"}', "", None),
        ("think", '{"other":1}', "", "schema_extra_arguments:other"),
        ("search_products", "{}", "", None),
        ("search_products", "{}", schema.NO_SEARCH, "search_not_available_on_current_page"),
        ("open_product", f'{{"asin":{ASIN}}}', ASIN, None),
        ("open_product", "{}", ASIN, "click_not_in_previous_observation"),
        ("select_option", '{"value":"BUY NOW"}', PAGE, "select_option_is_navigation_button"),
        ("select_option", "{}", PAGE, "unknown_or_invalid_tool"),
        ("fly", '{"far":1}', PAGE, "unknown_or_invalid_tool"),
        ("buy_now", "{}", None, "missing_previous_observation"),
        ("next_page", "{}", PAGE, "click_not_in_previous_observation"),
    ],
)
def test_guard(spark, name, arguments, page, reason):
    row = spark.createDataFrame([(name, arguments, page)], "n string, a string, o string")
    assert row.select(actions.reject_reason(F.col("n"), F.parse_json("a"), F.col("o"))).first()[0] == reason


def test_guard_message(spark):
    rows = spark.createDataFrame([(0, '可点击的按钮: ["< Prev", "Back to Search"]'), (1, f"{ASIN} {PAGE}"), (2, "")], "i long, o string").orderBy("i")
    back, page, nothing = (r[0] for r in rows.select(actions.guard_message(F.lit("why"), F.col("o"))).collect())
    assert "prev_page 或 back_to_search。" in back and "（why）" in back
    assert f"ASIN: {ASIN}；可点击按钮: Red, Buy Now, < Prev。" in page
    assert schema.GUARD_TEXT["nothing"] in nothing


def test_previous_observation_as_rows_agrees(spark):
    t = edited(_guarded_detour)
    views = trajectories.message_views(v.items(v.get(F.col("trajectory"), "messages")))
    by_row = parsed(spark, [t]).select(trajectories.previous_observation(views, F.lit("c1"))).first()[0]
    flat = spark.createDataFrame([("t", i, m["role"], m.get("runtime_action_guard"), m.get("content")) for i, m in enumerate(t["messages"])], "trajectory_id string, message_index long, role string, guard boolean, content string")
    got = {r["message_index"]: r["previous_observation"] for r in trajectories.previous_observations(flat).collect()}
    at = next(i for i, m in enumerate(t["messages"]) if m.get("tool_calls", [{}])[0].get("id") == "c1")
    assert by_row == got[at] == t["messages"][3]["content"]


def test_training_messages(spark):
    rows = parsed(spark, [edited(_guarded_detour)])
    row = sft.sft_rows(rows).select("task_id", F.transform("messages", lambda m: F.to_json(m)).alias("m")).first()
    messages = [json.loads(m) for m in row["m"]]
    assert row["task_id"] == 7 and len(messages) == 10
    assert not any("reasoning_content" in m or "runtime_action_guard" in m for m in messages)
    assert messages[2]["content"] is None and messages[2]["tool_calls"][0]["function"]["name"] == "search_products"
    assert messages[-1]["content"] == schema.PURCHASE_DONE
    assert "secret" not in str(messages) and "999999999999" not in str(messages)
    assert sft.leaks(sft.sft_rows(rows)).count() == 0
    line = json.loads(sft.sft_json(sft.sft_rows(rows)).first()[0])
    assert line["messages"] == messages and line["tools"] == schema.tool_schemas() and line["trajectory_id"] == "t1"


def test_retained_reasoning_skips_what_follows_a_guard(spark):
    row = sft.sft_rows(parsed(spark, [edited(_guarded_detour)]), retain_reasoning=True).select(F.transform("messages", lambda m: F.to_json(m)).alias("m")).first()
    contents = [json.loads(m).get("content") for m in row["m"] if json.loads(m)["role"] == "assistant"]
    assert contents == ["<think>why</think>", None, "<think>why</think>", "<think>why</think>"]


def test_unfinished_trajectory_redacts_messages_without_a_call(spark):
    t = trajectory(done=False, messages=[{"role": "tool", "content": "open"}, {"role": "tool", "tool_call_id": "c1", "content": "kept"}])
    row = sft.sft_rows(parsed(spark, [t])).select(F.transform("messages", lambda m: v.get(m, "content", "string")).alias("m")).first()
    assert row["m"] == [schema.PURCHASE_DONE, "kept"]


def test_rewards_and_failures(spark):
    rows = [trajectory(), trajectory(done=1), trajectory(status="error"), trajectory(final_reward=None), trajectory(release_error={"m": 1}), trajectory(error={"type": schema.HTTP_ERROR}), trajectory(error={"type": schema.LEASE_ERROR[0], "message": f"x {schema.LEASE_ERROR[1]}"}), trajectory(error={"type": schema.LEASE_ERROR[0], "message": "y"})]
    t = F.col("trajectory")
    got = parsed(spark, rows).orderBy("ordinal").select(trajectories.strict_success(t), trajectories.terminal_reward(t), trajectories.infrastructure_failure(t)).collect()
    assert [tuple(g) for g in got] == [(True, 1.0, False), (False, 1.0, False), (False, 1.0, False), (True, 0.0, False), (True, 1.0, True), (True, 1.0, True), (True, 1.0, True), (True, 1.0, False)]


def test_final_reward_falls_back_to_the_last_step(spark):
    rows = [trajectory(), trajectory(final_reward=None, steps=[{"reward": 0.25}, {"reward": 0.5}]), trajectory(final_reward=None, steps=[])]
    assert [r[0] for r in parsed(spark, rows).orderBy("ordinal").select(trajectories.final_reward(F.col("trajectory"))).collect()] == [1.0, 0.5, 0.0]


def test_histograms_and_mismatches(spark):
    rows = trajectories.judged(parsed(spark, [edited(e) for e, _ in CASES]))
    plain = {r["reason"]: r["n"] for r in evaluation.reject_reason_counts(rows, normalised=True).collect()}
    assert plain["click_not_in_previous_observation"] == 2 and plain["missing_buy"] == 2
    assert evaluation.acceptance_totals(rows).first().asDict() == {"total": len(CASES), "accepted": 4, "rejected": len(CASES) - 4}
    odd = replay.action_mismatches(parsed(spark, [trajectory(), edited(lambda t: t["steps"][0].update(env_action="search[x]"))])).collect()
    assert [(r["step"], r["recorded"], r["derived"]) for r in odd] == [(0, "search[x]", "search[tea]")]
