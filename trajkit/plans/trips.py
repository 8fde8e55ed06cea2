"""Queries over stand-in trajectories: four events in a row are the steps of one shopping trip, most of them wrong in one way.

A trip searches, opens a product, selects an option and buys: four calls and the pages they show. Its number is that of its
events, divided by four; what is wrong, by its number % 30, is listed at _WRONG, and the SQL states the reasons that must be
found. Trips are written as a log of JSON lines, and read by the scan, as recorded ones are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import actions
from trajkit.functions import values as v
from trajkit.operators import evaluation, replay, sft, tokens, trajectories
from trajkit.plans.registered import query, table
from trajkit.sources import jsonl
from trajkit.sources.scratch import delete_at_end, own_folder

#: The trips of the events table: number and user. In the queries, event_id is the number.
TRIPS_SQL = "(SELECT event_id // 4 AS event_id, min(user_id) AS user_id FROM events GROUP BY event_id // 4) AS trips"
#: event_id % 30 -> the reject reasons, in order. 0 is whole; 26 has a blocked detour, 28 and 29 hold 1 for true.
_WRONG = {
    1: ["has_error"], 2: ["status_not_done"], 3: ["trajectory_not_done"], 4: ["environment_not_done"], 5: ["missing_buy"], 6: ["reward_detail_incomplete"], 7: ["reward_detail_incomplete"], 8: ["reward_detail.r_type_not_1"], 9: ["reward_detail.r_att_not_1"],
    10: ["reward_detail.r_option_not_1", "reward_detail.r_price_not_1"], 11: ["message_5.multiple_tool_calls"], 12: ["step_1.missing_tool_name"], 13: ["step_1.invalid_arguments_json"], 14: ["step_1.arguments_not_object"], 15: ["step_1.tool_name_mismatch"],
    16: ["step_1.unknown_or_invalid_tool"], 17: ["step_1.env_action_mismatch"], 18: ["step_1.schema_extra_arguments:b,zip"], 19: ["step_1.search_not_available_on_current_page"], 20: ["step_0.missing_previous_observation"], 21: ["step_1.click_not_in_previous_observation"],
    22: ["step_2.select_option_is_navigation_button"], 23: ["missing_buy", "step_3.action_after_option_selection"], 24: ["step_2.click_not_in_previous_observation"], 25: ["step_2.missing_previous_observation"], 27: ["step_2.missing_previous_observation"],
}
_BUTTONS = '可点击的按钮: ["Red", 7, "Buy Now", "< Prev", "Reviews"]'


def _case(usual: Column | str, **by: Column | str) -> Column:
    """usual, or for m12=... what stands there where event_id % 30 is 12."""
    m, out = F.col("event_id") % 30, None
    for name, value in by.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(m == int(name[1:]), value) if out is None else out.when(m == int(name[1:]), value)
    usual = usual if isinstance(usual, Column) else F.lit(usual)
    return usual if out is None else out.otherwise(usual)


def _quoted(text: Column | str) -> Column:
    return v.json_text(text if isinstance(text, Column) else F.lit(text))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, raw_json: one trip per event, as JSON text."""
    e = F.col("event_id")
    product = F.lpad(e.cast("string"), 12, "1")
    open_ = F.concat(F.lit('{"asin":"'), product, F.lit('"}'))
    clicked = F.concat(F.lit("click["), product, F.lit("]"))
    names = [_case("search_products", m20="open_product"), _case("open_product", m12="", m16="fly", m19="search_products"), F.lit("select_option"), _case("buy_now", m23="view_reviews")]
    said = [_case('{"query":"tea"}', m20=open_), _case(open_, m13="{", m14="[]", m18=F.concat(F.lit('{"zip":1,"asin":"'), product, F.lit('","b":2}')), m19='{"query":"x"}'), _case('{"value":"red"}', m22='{"value":"< prev"}', m24='{"value":"Green"}'), F.lit("{}")]
    done = [_case("search[tea]", m20=clicked), _case(clicked, m17="click[x]", m19="search[x]"), _case("click[red]", m22="click[< prev]", m24="click[Green]"), _case("click[Buy Now]", m23="click[Reviews]")]
    tools = [names[0], _case(names[1], m15="view_reviews"), names[2], names[3]]
    pages = [_quoted(_case(F.concat(F.lit("results [SEP] "), product), m19=F.concat(F.lit(schema.NO_SEARCH + " "), product), m21="results none")), _case(_quoted("detail " + _BUTTONS), m25="null"), _quoted("detail " + _BUTTONS), _quoted("bought")]

    def call(i: int, number: Column | str) -> Column:
        return F.concat(F.lit('{"id":"'), number if isinstance(number, Column) else F.lit(number), F.lit('","type":"function","index":0,"function":{"name":'), _quoted(names[i]), F.lit(',"arguments":'), _quoted(said[i]), F.lit("}}"))

    messages = [F.lit('{"role":"user","content":"buy tea"}')]
    for i in range(4):
        calls = F.concat(call(i, f"c{i}"), _case("", m11=F.concat(F.lit(","), call(i, "c9"))) if i == 2 else F.lit(""))
        messages.append(F.concat(F.lit('{"role":"assistant","content":' + ("null" if i % 2 == 0 else '"so"') + f',"reasoning_content":" why {i} ","tool_calls":['), calls, F.lit("]}")))
        messages.append(F.concat(F.lit(f'{{"role":"tool","tool_call_id":"c{i}","name":'), _quoted(names[i]), F.lit(',"content":'), pages[i], F.lit("}")))
        if i == 1:
            detour = '{"role":"assistant","content":null,"tool_calls":[{"id":"b1","type":"function","function":{"name":"next_page","arguments":"{}"}}]},{"role":"tool","tool_call_id":"b1","runtime_action_guard":true,"content":"not so"}'
            messages.append(_case(F.lit(None).cast("string"), m26=detour))
    steps = [
        F.concat(F.lit(f'{{"step_index":{i},"tool_name":'), _quoted(tools[i]), F.lit(',"tool_call":'), call(i, _case(f"c{i}", m27="zz") if i == 2 else f"c{i}"), F.lit(',"env_action":'), _quoted(done[i]), F.lit(f',"reward":{i}.5,"done":{"true" if i == 3 else "false"}}}'))
        for i in range(4)
    ]
    steps[3] = _case(steps[3], m5=F.lit(None).cast("string"))
    detail = _case('{"r_type":1,"r_att":1.0,"r_option":true,"r_price":true}', m6='{"r_type":1,"r_option":true,"r_price":true}', m7='"x"', m8='{"r_type":0,"r_att":1.0,"r_option":true,"r_price":true}', m9='{"r_type":1,"r_att":"1","r_option":true,"r_price":true}', m10='{"r_type":1,"r_att":1.0,"r_option":false,"r_price":2}')
    listed = lambda parts: F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("]"))
    fields = [
        ("trajectory_id", F.concat(F.lit('"t'), e.cast("string"), F.lit('"'))), ("task_id", F.col("user_id").cast("string")), ("status", _quoted(_case("done", m2="max_steps"))), ("done", _case("true", m3="false", m29="1")), ("error", _case("null", m1='{"type":"X"}')),
        ("final_reward", (e % 7 / F.lit(2.0)).cast("string")), ("blocked_tool_calls", _case("[]", m26='[{"tool_call":{"id":"b1"},"reason":"click_not_in_previous_observation"}]')), ("steps", listed(steps)), ("messages", listed(messages)),
        ("terminal_result", F.concat(F.lit('{"goal":"hidden","done":true,"over":'), _case("true", m4="false", m28="1"), F.lit(',"reward_detail":'), detail, F.lit("}"))),
    ]
    text = F.concat(F.lit("{"), *[x for i, (k, c) in enumerate(fields) for x in (F.lit(("," if i else "") + f'"{k}":'), c)], F.lit("}"))
    rows = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 4").alias("event_id")).agg(F.min("user_id").alias("user_id"))
    return rows.select("event_id", text.alias("raw_json"))


_logs: dict[tuple[str, str], str] = {}


def trip_log(spark: SparkSession, sf_dir: str) -> str:
    """The log of the trips, written once for an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _logs:
        path = f"{own_folder(spark)}/trips/{uuid.uuid4().hex}"
        jsonl.write_jsonl(trips(spark, sf_dir).withColumnRenamed("event_id", "ordinal"), path)
        delete_at_end(spark)
        _logs[key] = path
    return _logs[key]


def parsed_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jsonl.read_jsonl(spark, trip_log(spark, sf_dir), "trajectory")
    return rows.select(F.expr("cast(substring(try_variant_get(trajectory, '$.trajectory_id', 'string'), 2) as long)").alias("event_id"), "trajectory")


REASONS_SQL = (
    "r AS (SELECT event_id, event_id % 30 AS m, user_id, CASE event_id % 30 "
    + " ".join("WHEN {} THEN [{}]".format(m, ", ".join(f"'{x}'" for x in reasons)) for m, reasons in _WRONG.items())
    + " ELSE [] END AS reasons FROM " + TRIPS_SQL + ")"
)


@query(f"WITH {REASONS_SQL} SELECT event_id, array_to_string(reasons, ' ') AS reasons, len(reasons) = 0 AS accepted FROM r")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason there is, over trips of four steps."""
    rows = trajectories.judged(parsed_trips(spark, sf_dir))
    return rows.select("event_id", F.array_join("reject_reasons", " ").alias("reasons"), "accepted")


@query(f"WITH {REASONS_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def reason_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return evaluation.reject_reason_counts(trajectories.judged(parsed_trips(spark, sf_dir)))


@query(f"WITH {REASONS_SQL} SELECT count(*) AS total, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS rejected FROM r")
def accept_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8."""
    return evaluation.acceptance_totals(trajectories.judged(parsed_trips(spark, sf_dir)))


@query(f"SELECT event_id, event_id % 30 NOT IN (2, 3, 4, 6, 7, 8, 9, 10, 28, 29) AS strict, CASE WHEN event_id % 30 IN (3, 4, 28) THEN 0.0::DOUBLE ELSE event_id % 7 / 2.0::DOUBLE END AS reward, event_id % 7 / 2.0::DOUBLE AS recorded FROM {TRIPS_SQL}")
def terminal_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True is not 1 here."""
    t = F.col("trajectory")
    return parsed_trips(spark, sf_dir).select("event_id", trajectories.strict_success(t).alias("strict"), trajectories.terminal_reward(t).alias("reward"), trajectories.final_reward(t).alias("recorded"))


@query(f"SELECT event_id, 'c3' AS terminal_call, CASE WHEN event_id % 30 = 26 THEN 'b1' ELSE '' END AS blocked, 'buy_now' AS tool, 3.5::DOUBLE AS reward FROM {TRIPS_SQL} WHERE event_id % 30 NOT IN (3, 5, 23)")
def terminal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call that ended a trip, the calls that were blocked."""
    t = F.col("trajectory")
    last = F.element_at(v.items(v.get(t, "steps")), -1)
    rows = parsed_trips(spark, sf_dir).select("event_id", sft.terminal_call_id(t).alias("terminal_call"), F.array_join(sft.blocked_ids(t), ",").alias("blocked"), v.get(last, "tool_name", "string").alias("tool"), v.get(last, "reward", "double").alias("reward"))
    return rows.where("terminal_call is not null and event_id % 30 != 23")


_PAGE_SQL = f"'detail {_BUTTONS}'"
_CLEAN_SQL = f"""c AS (SELECT event_id, event_id % 30 AS m, lpad(event_id::VARCHAR, 12, '1') AS p FROM {TRIPS_SQL}),
g AS (SELECT *, CASE m WHEN 19 THEN '{schema.NO_SEARCH} ' || p WHEN 21 THEN 'results none' ELSE 'results [SEP] ' || p END AS p0, CASE WHEN m = 25 THEN '-' ELSE {_PAGE_SQL} END AS p1, {_PAGE_SQL} AS p2, CASE WHEN m IN (3, 5) THEN 'bought' ELSE '{schema.PURCHASE_DONE}' END AS p3 FROM c)"""


@query(f"""WITH {_CLEAN_SQL} SELECT event_id, 'user,assistant,tool,assistant,tool,assistant,tool,assistant,tool' AS roles, array_to_string(['buy tea', '-', p0, 'so', p1, '-', p2, 'so', p3], '|') AS contents,
  array_to_string(['buy tea', '<think>why 0</think>', p0, '<think>why 1</think>' || chr(10) || 'so', p1, CASE WHEN m = 26 THEN '-' ELSE '<think>why 2</think>' END, p2, '<think>why 3</think>' || chr(10) || 'so', p3], '|') AS with_reasoning,
  'content,role|content,role,tool_calls|content,name,role,tool_call_id' AS fields, 'function,id,type|arguments,name' AS call_fields, CASE WHEN m = 11 THEN 5 ELSE 4 END AS calls FROM g""")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training messages keep, with and without reasoning."""
    t = F.col("trajectory")
    rows = parsed_trips(spark, sf_dir).select("event_id", sft.training_messages(t).alias("m"), sft.training_messages(t, True).alias("r"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(v.get(x, "content", "string"), F.lit("-"))), "|")
    keys = lambda x: F.array_join(F.array_sort(F.json_object_keys(F.to_json(x))), ",")
    calls = F.flatten(F.transform("m", lambda x: v.items(v.get(x, "tool_calls"))))
    return rows.select(
        "event_id", F.array_join(F.transform("m", lambda x: v.get(x, "role", "string")), ",").alias("roles"), shown("m").alias("contents"), shown("r").alias("with_reasoning"),
        F.array_join(F.array_distinct(F.transform("m", keys)), "|").alias("fields"), F.array_join(F.flatten(F.array(F.array_distinct(F.transform(calls, keys)), F.array_distinct(F.transform(calls, lambda c: keys(v.get(c, "function")))))), "|").alias("call_fields"), F.size(calls).alias("calls"),
    )


@query(f"""SELECT event_id, CASE event_id % 30 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 14 THEN 1 WHEN 16 THEN 1 WHEN 17 THEN 1 END AS step,
  CASE WHEN event_id % 30 = 17 THEN 'click[x]' ELSE 'click[' || lpad(event_id::VARCHAR, 12, '1') || ']' END AS recorded, event_id % 30 = 17 AS ok FROM {TRIPS_SQL} WHERE event_id % 30 IN (12, 13, 14, 16, 17)""")
def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose recorded action is not that of their call."""
    found = replay.action_mismatches(parsed_trips(spark, sf_dir))
    return found.select(F.expr("cast(substring(trajectory_id, 2) as long)").alias("event_id"), "step", "recorded", "ok")


@query("SELECT event_id, event_id % 6 IN (0, 1, 2) AS stops FROM events")
def infrastructure_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    m = F.col("event_id") % 6
    kind, message = schema.LEASE_ERROR
    text = F.when(m == 0, '{"release_error":"lost"}').when(m == 1, f'{{"error":{{"type":"{schema.HTTP_ERROR}","message":"x"}}}}').when(m == 2, f'{{"error":{{"type":"{kind}","message":"1: {message}!"}}}}')
    text = text.when(m == 3, f'{{"error":{{"type":"{kind}","message":"else"}},"release_error":""}}').when(m == 4, f'{{"error":{{"type":"X","message":"{message}"}},"release_error":null}}').otherwise('{"error":null}')
    return table(spark, sf_dir, "events").select("event_id", trajectories.infrastructure_failure(F.parse_json(text)).alias("stops"))


_GUARD_SQL = """p AS (SELECT event_id, event_id % 4 AS m, list_transform(range(event_id % 25), lambda i: (100000000000 + i)::VARCHAR) AS products, list_transform(range(event_id % 35), lambda i: 'b' || i) AS buttons FROM events),
q AS (SELECT *, CASE m WHEN 0 THEN list_slice(products, 1, 20) ELSE [] END AS a, CASE m WHEN 0 THEN list_slice(buttons, 1, 30) WHEN 1 THEN ['< Prev', 'Back to Search'] WHEN 2 THEN ['Back to Search'] ELSE [] END AS b FROM p)"""


@query(f"""WITH {_GUARD_SQL} SELECT event_id, md5(replace(replace(replace('{schema.GUARD_TEXT["whole"]}', '{{reason}}', 'why'), '{{correction}}', CASE m WHEN 1 THEN replace('{schema.GUARD_TEXT["return_only"]}', '{{tools}}', 'prev_page{schema.GUARD_TEXT["or"]}back_to_search')
    WHEN 2 THEN replace('{schema.GUARD_TEXT["return_only"]}', '{{tools}}', 'back_to_search') ELSE '{schema.GUARD_TEXT["choose"]}' END), '{{allowed}}',
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN '{schema.GUARD_TEXT["nothing"]}' ELSE concat_ws('；', CASE WHEN len(a) > 0 THEN '{schema.GUARD_TEXT["products"]}' || array_to_string(a, ', ') END, CASE WHEN len(b) > 0 THEN '{schema.GUARD_TEXT["buttons"]}' || array_to_string(b, ', ') END) END)) AS message_md5 FROM q""")
def guard_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is told when its call was not carried out."""
    m = F.col("event_id") % 4
    upto = lambda n, most: F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: i < F.col("event_id") % n)
    listed = F.concat(F.lit("可点击的按钮: "), F.to_json(F.transform(upto(35, 35), lambda i: F.concat(F.lit("b"), i.cast("string")))))
    page = F.when(m == 0, F.concat(F.array_join(F.transform(upto(25, 25), lambda i: (F.lit(100000000000) + i).cast("string")), " "), F.lit("\n"), listed)).when(m == 1, '可点击的按钮: ["< Prev", "Back to Search"]').when(m == 2, '可点击的按钮: ["Back to Search", 5]').otherwise("可点击的按钮: [broken")
    return table(spark, sf_dir, "events").select("event_id", F.md5(actions.guard_message(F.lit("why"), page)).alias("message_md5"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'system:shop|user:hi' WHEN 1 THEN 'system:own' ELSE 'system:shop' END || '|user:' || CASE event_id % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'go' WHEN 2 THEN 'see' ELSE '' END AS start,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c0' END AS kept, greatest(event_id % 5 - 1, 0) AS dropped, 'tool:c' || event_id || ':buy_now:done' AS answer FROM events""")
def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how a rollout starts, the one call of a turn that counts, and the answer to it."""
    e = F.col("event_id")
    kind = "array<struct<role:string,content:string>>"
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), F.lit(content).alias("content")))
    prompt = F.when(e % 3 == 0, message("user", "hi")).when(e % 3 == 1, message("system", "own")).otherwise(F.lit(None).cast(kind))
    result = F.parse_json(F.when(e % 4 == 0, '{"instruction":"go","observation":"see"}').when(e % 4 == 1, '{"instruction":"go"}').when(e % 4 == 2, '{"observation":"see"}').otherwise("{}"))
    start = replay.initial_messages(prompt, "shop", replay.observation_of(result))
    calls = replay.first_call(F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < e % 5), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    answer = replay.tool_message(F.concat(F.lit("c"), e.cast("string")), F.lit("buy_now"), F.lit("done"))
    rows = table(spark, sf_dir, "events").select("event_id", start.alias("s"), calls.alias("c"), answer.alias("a"))
    return rows.select("event_id", F.array_join(F.transform("s", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("start"), F.array_join("c.kept", ",").alias("kept"), F.size("c.dropped").cast("long").alias("dropped"), F.concat_ws(":", "a.role", "a.tool_call_id", "a.name", "a.content").alias("answer"))


@query("""SELECT * FROM (VALUES ('search_products', 'query'), ('open_product', 'asin'), ('select_option', 'value'), ('view_description', ''), ('view_features', ''), ('view_reviews', ''), ('view_attributes', ''), ('next_page', ''), ('prev_page', ''), ('back_to_search', ''), ('buy_now', ''), ('think', 'note')) AS t(tool, required)""")
def tool_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tools and their required arguments, as the training rows list them."""
    kind = "array<struct<type:string,function:struct<name:string,parameters:struct<type:string,required:array<string>>>>>"
    rows = spark.createDataFrame([(json.dumps(schema.tool_schemas()),)], "text string").select(F.explode(F.from_json("text", kind)).alias("t"))
    return rows.select(F.col("t.function.name").alias("tool"), F.array_join("t.function.parameters.required", ",").alias("required"))


@query(f"SELECT event_id, event_id % 30 NOT IN (13, 14) AS objects FROM {TRIPS_SQL}")
def checked_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether all arguments of a trip are the JSON text of an object."""
    return parsed_trips(spark, sf_dir).select("event_id", tokens.arguments_as_objects(v.items(v.get(F.col("trajectory"), "messages"))).alias("objects"))
