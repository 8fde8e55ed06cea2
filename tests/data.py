"""Literal trajectories."""

import copy
import json

ASIN = "123456789012"
PAGE = '可点击的按钮: ["Red", 7, "Buy Now", "< Prev"]'


def call(number, name, arguments):
    return {"id": f"c{number}", "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}


def trajectory(**changes):
    """search, open, select, buy: accepted as it is."""
    calls = [call(0, "search_products", {"query": "tea"}), call(1, "open_product", {"asin": ASIN}), call(2, "select_option", {"value": "red"}), call(3, "buy_now", {})]
    pages = [f"found {ASIN}, 1{ASIN}", PAGE, PAGE, "secret reward"]
    actions = ["search[tea]", f"click[{ASIN}]", "click[red]", "click[Buy Now]"]
    messages = [{"role": "system", "content": "shop"}, {"role": "user", "content": "buy tea"}]
    for c, page in zip(calls, pages, strict=True):
        messages += [{"role": "assistant", "content": None, "reasoning_content": " why ", "tool_calls": [c]}, {"role": "tool", "tool_call_id": c["id"], "name": c["function"]["name"], "content": page}]
    steps = [{"step_index": i, "tool_name": c["function"]["name"], "tool_call": c, "env_action": a, "done": i == 3} for i, (c, a) in enumerate(zip(calls, actions, strict=True))]
    out = {
        "trajectory_id": "t1", "task_id": 7, "status": "done", "done": True, "error": None, "messages": messages, "steps": steps, "blocked_tool_calls": [], "final_reward": 1.0,
        "terminal_result": {"done": True, "over": True, "goal": "hidden", "reward_detail": {"r_type": 1, "r_att": 1.0, "r_option": True, "r_price": True}},
    }
    return copy.deepcopy(out) | changes


def lines(rows):
    return [(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)]
