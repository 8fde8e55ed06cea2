"""Fixed values of the data contract: tools, statuses, field lists, texts."""

from __future__ import annotations

REWARD_KEYS = ("r_type", "r_att", "r_option", "r_price")
ELIGIBLE_STATUSES = ("assistant_final", "done", "invalid_action_limit", "max_steps")
LENGTH_BUCKETS = (("short", 10), ("medium", 20), ("long", None))
GUARD_FIELD = "runtime_action_guard"
MESSAGE_FIELDS = ("role", "content", "tool_calls", "tool_call_id", "name")
IGNORE_INDEX = -100
BLOCKED_STREAK_LIMIT = 3

#: Argument that a tool's action takes, and the fixed label of tools without one. Fixed values.
TOOL_ARGUMENTS = {"search_products": "query", "open_product": "asin", "select_option": "value", "think": "note"}
TOOL_LABELS = {
    "view_description": "Description",
    "view_features": "Features",
    "view_reviews": "Reviews",
    "view_attributes": "Attributes",
    "next_page": "Next >",
    "prev_page": "< Prev",
    "back_to_search": "Back to Search",
    "buy_now": "Buy Now",
}
#: What the tools say they do. Fixed values.
TOOL_DESCRIPTIONS = {
    "search_products": "Search products by query.",
    "open_product": "Open a product by ASIN.",
    "select_option": "Select a product option.",
    "view_description": "Open the description page.",
    "view_features": "Open the features page.",
    "view_reviews": "Open the reviews page.",
    "view_attributes": "Open the attributes page.",
    "next_page": "Go to the next search page.",
    "prev_page": "Go to the previous search page.",
    "back_to_search": "Return to search page.",
    "buy_now": "Buy the currently selected product.",
    "think": "Record private reasoning.",
}
#: Error types in recorded trajectories that stand for the environment's failures. Fixed values.
HTTP_ERROR = "ShopHttpError"
LEASE_ERROR = ("ShopEnvironmentError", "Unable to get available environment resource")
AFTER_SELECTION = ("select_option", "buy_now", "think")

#: Texts that observations and messages hold. Fixed values.
NO_SEARCH = "搜索功能是否可用: False"
BUTTONS = r"可点击的按钮:(?U:\s*)(\[[^\n]*\])"
PURCHASE_DONE = "购买已完成。"
GUARD_TEXT = {
    "products": "可打开的商品 ASIN: ",
    "buttons": "可点击按钮: ",
    "nothing": "当前页面没有可用点击目标",
    "return_only": "你处于信息子页，下一步只能调用 {tools}。",
    "or": " 或 ",
    "choose": "下一步只能从当前页面列出的目标中选择。",
    "whole": "上一工具调用被本地动作守卫拒绝（{reason}），未执行。{correction}{allowed}。不要重复使用历史页面目标；只调用一个合法工具。",
}


def tool_schemas() -> list[dict]:
    """The tools' function schemas, each argument a required string."""
    out = []
    for name, description in TOOL_DESCRIPTIONS.items():
        argument = TOOL_ARGUMENTS.get(name)
        parameters = {"type": "object", "properties": {argument: {"type": "string"}} if argument else {}, "required": [argument] if argument else []}
        out.append({"type": "function", "function": {"name": name, "description": description, "parameters": parameters}})
    return out


def configure(spark) -> None:
    """Settings that the JSON rules rely on: of repeated keys the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
