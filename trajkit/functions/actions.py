"""Tool calls, what they do, and whether the page that was seen allows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import values as v


def _literals(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parsed_arguments(raw: Column) -> Column:
    """A call's arguments as VARIANT: what is missing, null or empty counts as {}; NULL where they are no JSON text."""
    empty = F.parse_json(F.lit("{}"))
    text = lambda x: F.when(v.kind(x) == "STRING", v.get(x, "", "string"))
    return v.let(raw, lambda x: F.when(text(x) != "", v.parsed(text(x))).when(~v.truthy(x), empty))


def tool_action(name: Column, arguments: Column) -> Column:
    """struct(ok, action): the environment action of a call; think has none, and ok is false for unknown tools and missing arguments."""
    action = F.when(name == "think", F.lit(None).cast("string"))
    # The argument's name differs by tool, and paths into VARIANT are literals: one branch for each.
    for tool, key in schema.TOOL_ARGUMENTS.items():
        if tool != "think":
            verb = "search[" if tool == "search_products" else "click["
            action = action.when(name == tool, F.concat(F.lit(verb), v.as_text(v.get(arguments, key)), F.lit("]")))
    label = F.try_element_at(_literals(schema.TOOL_LABELS), name)
    action = action.otherwise(F.concat(F.lit("click["), label, F.lit("]")))
    return v.let(action, lambda a: F.struct(F.coalesce((name == "think") | a.isNotNull(), F.lit(False)).alias("ok"), a.alias("action")))


def extra_arguments(name: Column, arguments: Column) -> Column:
    """Names in arguments that the tool doesn't declare, sorted; none for an unknown tool or what is no object."""
    declared = F.create_map(*[x for tool in schema.TOOL_DESCRIPTIONS for x in (F.lit(tool), F.array(*[F.lit(a) for a in [schema.TOOL_ARGUMENTS.get(tool)] if a]).cast("array<string>"))])
    allowed = F.try_element_at(declared, name)
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(v.is_object(arguments) & allowed.isNotNull(), F.array_sort(F.array_except(F.json_object_keys(F.to_json(arguments)), allowed))), none)


def product_ids(observation: Column) -> Column:
    """Runs of exactly 12 digits, each once, as first seen."""
    return F.array_distinct(F.regexp_extract_all(observation, F.lit(r"(?U)(?<!\d)\d{12}(?!\d)"), F.lit(0)))


def clickable_buttons(observation: Column) -> Column:
    """The strings of the JSON list after the first buttons label; none where it is missing or broken."""
    listed = v.parsed(F.regexp_extract(observation, schema.BUTTONS, 1))
    strings = F.filter(v.items(listed), lambda b: v.kind(b) == "STRING")
    return F.transform(strings, lambda b: v.get(b, "", "string"))


def can_search(observation: Column) -> Column:
    return ~F.contains(observation, F.lit(schema.NO_SEARCH))


def reject_reason(name: Column, arguments: Column, observation: Column) -> Column:
    """Why the page forbids a call, NULL if it doesn't; the first check that fails counts. Labels compare lower-cased."""
    given = F.struct(name.alias("name"), arguments.alias("arguments"), observation.alias("observation"))
    return v.let(given, lambda g: v.let(F.struct(extra_arguments(g["name"], g["arguments"]).alias("extra"), tool_action(g["name"], g["arguments"]).alias("action")), lambda d: _first_failed(g["name"], g["arguments"], g["observation"], d["extra"], d["action"])))


def _first_failed(name: Column, arguments: Column, observation: Column, extra: Column, action: Column) -> Column:
    unseen = F.lit("click_not_in_previous_observation")
    target = F.lower(F.substring(action["action"], 7, 1 << 30))
    target = F.substring(target, F.lit(1), F.length(target) - 1)
    navigation = F.array(*[F.lit(label.lower()) for label in schema.TOOL_LABELS.values()])
    seen = F.array_contains(F.transform(clickable_buttons(observation), F.lower), target)
    asin = F.coalesce(v.as_text(v.get(arguments, "asin")), F.lit(""))
    return (
        F.when(F.size(extra) > 0, F.concat(F.lit("schema_extra_arguments:"), F.array_join(extra, ",")))
        .when(name == "think", F.lit(None))
        .when(name == "search_products", F.when(~can_search(observation), "search_not_available_on_current_page"))
        .when(F.coalesce(observation, F.lit("")) == "", "missing_previous_observation")
        .when(name == "open_product", F.when(~F.array_contains(product_ids(observation), asin), unseen))
        .when(~action["ok"], "unknown_or_invalid_tool")
        .when((name == "select_option") & F.array_contains(navigation, target), "select_option_is_navigation_button")
        .when(~F.coalesce(seen, F.lit(False)), unseen)
    )


def guard_message(reason: Column, observation: Column) -> Column:
    """The text that tells the model why its call was not carried out and what the page allows."""
    t = schema.GUARD_TEXT
    buttons, products = clickable_buttons(observation), product_ids(observation)
    labels = F.transform(buttons, F.lower)
    back = {tool: schema.TOOL_LABELS[tool].lower() for tool in ("prev_page", "back_to_search")}
    tools = F.array_compact(F.array(*[F.when(F.array_contains(labels, label), tool) for tool, label in back.items()]))
    only = (F.size(labels) > 0) & (F.size(F.array_except(labels, F.array(*map(F.lit, back.values())))) == 0)
    before, after = t["return_only"].split("{tools}")
    correction = F.when(only, F.concat(F.lit(before), F.array_join(tools, t["or"]), F.lit(after))).otherwise(t["choose"])
    parts = F.array_compact(F.array(
        F.when(F.size(products) > 0, F.concat(F.lit(t["products"]), F.array_join(F.slice(products, 1, 20), ", "))),
        F.when(F.size(buttons) > 0, F.concat(F.lit(t["buttons"]), F.array_join(F.slice(buttons, 1, 30), ", "))),
    ))
    allowed = F.when(F.size(parts) > 0, F.array_join(parts, "；")).otherwise(t["nothing"])
    start, rest = t["whole"].split("{reason}")
    middle, end = rest.split("{correction}{allowed}")
    return F.concat(F.lit(start), reason, F.lit(middle), correction, allowed, F.lit(end))
