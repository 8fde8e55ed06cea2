"""Queries registered with the driver and the SQL that must give the same rows.

The tables hold no trajectories, so the queries use stand-ins: a user's events are a task's runs or steps, conversations are
messages, labels are reward components, documents are observation texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import actions
from trajkit.functions import values as v
from trajkit.operators import evaluation, replay, splits, tokens, trajectories
from trajkit.plans import files, trips  # noqa: F401  they register queries, too
from trajkit.plans.registered import ORACLE_SQL, QUERIES, query  # noqa: F401
from trajkit.plans.registered import table as _table

def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one run of its user's task."""
    kind, amount = F.col("event_type"), F.floor("value").cast("double")
    done = kind == "purchase"
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"), F.col("user_id").alias("task_id"), F.when(done, "done").when(kind == "error", "error").otherwise("max_steps").alias("status"), done.alias("done"), (done & (F.col("event_id") % 3 == 0)).alias("strict"),
        *[(F.col("event_id") % (i + 2) == 0).alias(k) for i, k in enumerate(schema.REWARD_KEYS)], amount.alias("final_reward"), (F.col("event_id") % 40).cast("int").alias("steps"),
        F.when(kind == "error", F.array(F.lit("blocked"), F.col("props"))).otherwise(F.array().cast("array<string>")).alias("guard_reasons"),
    )


_RUNS_SQL = """runs AS (SELECT event_id AS ordinal, user_id AS task_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'max_steps' END AS status, event_type = 'purchase' AS done,
  event_type = 'purchase' AND event_id % 3 = 0 AS strict, event_id % 2 = 0 AS r_type, event_id % 3 = 0 AS r_att, event_id % 4 = 0 AS r_option, event_id % 5 = 0 AS r_price, floor(value) AS final_reward, event_id % 40 AS steps, event_type, props FROM events),
ids AS (SELECT DISTINCT user_id AS task_id FROM events),
expected AS (SELECT task_id FROM ids UNION ALL SELECT task_id FROM ids WHERE task_id % 40 = 0 UNION ALL SELECT -1 - task_id FROM ids WHERE task_id % 25 = 3),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ordinal DESC) AS k FROM runs WHERE task_id IN (SELECT task_id FROM expected)) WHERE k = 1)"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest: every user, some of them twice, and some ids that have no events."""
    ids = _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")).distinct()
    return ids.union(ids.where("task_id % 40 = 0")).union(ids.where("task_id % 25 = 3").select((-1 - F.col("task_id")).alias("task_id")))


def _share_sql(condition: str) -> str:
    return f"sum(times) FILTER (coalesce({condition}, false)) / 1"


@query(f"""WITH {_RUNS_SQL}, e AS (SELECT task_id FROM expected GROUP BY task_id), b AS (SELECT e.task_id, last.* EXCLUDE (task_id), last.task_id IS NOT NULL AS ran FROM e LEFT JOIN last ON e.task_id = last.task_id), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM expected)
SELECT (SELECT count(*) FROM expected) AS expected_tasks, count(*) FILTER (ran) AS completed_tasks, coalesce(string_agg(task_id::VARCHAR, ',' ORDER BY task_id) FILTER (NOT ran), '') AS missing_tasks, count(*) FILTER (done) AS done_tasks,
  count(*) FILTER (done) / any_value(n) AS done_rate, count(*) FILTER (strict) AS strict_successes, coalesce(string_agg(task_id::VARCHAR, ',' ORDER BY task_id) FILTER (strict), '') AS strict_success_task_ids, count(*) FILTER (strict) / any_value(n) AS strict_success_rate,
  count(*) FILTER (r_type) / any_value(n) AS r_type_rate, count(*) FILTER (r_att) / any_value(n) AS r_att_rate, count(*) FILTER (r_option) / any_value(n) AS r_option_rate, count(*) FILTER (r_price) / any_value(n) AS r_price_rate,
  sum(final_reward) / CAST(count(*) FILTER (ran) AS DOUBLE) AS mean_final_reward, CAST(sum(steps) AS DOUBLE) / CAST(count(*) FILTER (ran) AS DOUBLE) AS average_steps FROM b, n""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of each expected task, over all expected tasks."""
    out = evaluation.benchmark_summary(_expected(spark, sf_dir), _runs(spark, sf_dir))
    return out.withColumn("missing_tasks", F.array_join("missing_tasks", ",")).withColumn("strict_success_task_ids", F.array_join("strict_success_task_ids", ","))


@query(f"WITH {_RUNS_SQL} SELECT status, count(*) AS n FROM last GROUP BY status")
def status_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return evaluation.status_counts(evaluation.last_runs(_runs(spark, sf_dir), _expected(spark, sf_dir)))


@query(f"WITH {_RUNS_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(['blocked', props]) AS reason FROM last WHERE event_type = 'error') GROUP BY reason")
def guard_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return evaluation.guard_reason_counts(evaluation.last_runs(_runs(spark, sf_dir), _expected(spark, sf_dir)))


@query(f"WITH {_RUNS_SQL} SELECT DISTINCT task_id FROM expected WHERE task_id NOT IN (SELECT task_id FROM last)")
def missing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, U1."""
    return splits.held_out_pool(_expected(spark, sf_dir), _runs(spark, sf_dir))


@query("SELECT user_id AS task_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def lww_vs_fww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: first-wins and last-wins."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("task_id"), "event_type")
    first, last = evaluation.first_runs(rows), evaluation.last_runs(rows, rows)
    return first.select("task_id", F.col("event_type").alias("first_type")).join(last.select("task_id", F.col("event_type").alias("last_type")), "task_id")


@query("SELECT user_id AS task_id, count(*) AS n, avg(CAST(event_id % 2 AS DOUBLE)) AS mean_reward, max(event_id % 2) = 0 AS all_zero, min(event_id % 2) = 1 AS all_one, round(var_pop(CAST(event_id % 2 AS DOUBLE)), 9) AS var_reward FROM events GROUP BY user_id")
def group_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 2).cast("double").alias("reward"))
    return evaluation.group_rewards(rows).withColumn("var_reward", F.round("var_reward", 9))


@query("SELECT DISTINCT doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL)")
def heldout_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2, U1, U2."""
    ids = lambda t, c: _table(spark, sf_dir, t).select(F.col(c).alias("task_id"))
    return splits.held_out_pool(ids("documents", "doc_id"), ids("labels", "doc_id"), ids("benchmark", "item_id"))


@query("""WITH pool AS (SELECT DISTINCT doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
SELECT CAST(row_number() OVER (ORDER BY sha256('20260720:' || task_id::VARCHAR), task_id) - 1 AS INTEGER) AS ordinal, task_id FROM pool QUALIFY ordinal < 50""")
def heldout_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2 in the hash order; the limit is the sample's size."""
    ids = lambda t: _table(spark, sf_dir, t).select(F.col("doc_id").alias("task_id"))
    return splits.sample(splits.held_out_pool(ids("documents"), ids("labels")), 50, 20260720)


@query("SELECT conv_id AS ordinal, conv_id AS task_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY conv_id LIMIT 20")
def frozen_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the subset's size."""
    parent = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ordinal"), F.col("conv_id").alias("task_id")).distinct()
    return splits.frozen_prefix(parent, "conversations", 20, "")[0]


@query("""WITH g AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('42:' || conv_id::VARCHAR), conv_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT c.conv_id, turn, CASE WHEN k <= least(greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM conversations c JOIN g ON c.conv_id = g.conv_id""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, J8, F15, F16."""
    return splits.group_split(_table(spark, sf_dir, "conversations").select("conv_id", "turn"), key="conv_id")


@query("SELECT conv_id AS task_id FROM conversations INTERSECT SELECT doc_id FROM labels")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, U3."""
    return splits.overlap(_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "task_id"), _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "task_id"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a probe; its steps come from its value."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("max_steps")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("task_id"), status.alias("status"), (F.col("event_id") * 7 % 35).alias("steps"))


_FIRST_SQL = """f AS (SELECT user_id AS task_id, arg_min(CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'max_steps' END, event_id) AS status, arg_min(event_id * 7 % 35, event_id) AS probe_steps FROM events GROUP BY user_id),
p AS (SELECT *, CASE WHEN probe_steps <= 10 THEN 'short' WHEN probe_steps <= 20 THEN 'medium' ELSE 'long' END AS length_bucket, status != 'error' AS eligible FROM f)"""


@query(f"WITH {_FIRST_SQL} SELECT * FROM p")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, A2, J4, P9."""
    probes = _probes(spark, sf_dir)
    return splits.first_probes(probes, probes)


@query(f"""WITH {_FIRST_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY length_bucket ORDER BY sha256('7:' || length_bucket || ':' || task_id::VARCHAR), task_id) AS k, count(*) OVER (PARTITION BY length_bucket) AS n FROM p WHERE eligible)
SELECT CAST(row_number() OVER (ORDER BY sha256('7:final-order:' || task_id::VARCHAR), task_id) - 1 AS INTEGER) AS ordinal, task_id, probe_steps, length_bucket FROM c WHERE k <= (n + 9) // 10""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a tenth of each length bucket, in the hash order."""
    probes = _probes(spark, sf_dir)
    return splits.stratified_sample(probes, probes, _tenths(probes), 7)[0]


def _tenths(probes: DataFrame) -> dict[str, int]:
    sizes = splits.first_probes(probes, probes).where("eligible").groupBy("length_bucket").agg(F.count("*").alias("n"))
    return {r["length_bucket"]: (r["n"] + 9) // 10 for r in sizes.collect()}


@query(f"""WITH {_FIRST_SQL}, e AS (SELECT length_bucket, count(*) AS n FROM p WHERE eligible GROUP BY length_bucket)
SELECT 'candidate_task_count' AS name, '' AS part, count(*) AS n FROM p UNION ALL SELECT 'probed_candidate_count', '', count(*) FROM p UNION ALL SELECT 'eligible_probe_count', '', count(*) FROM p WHERE eligible
UNION ALL SELECT 'ignored_probe_status_counts', status, count(*) FROM p WHERE NOT eligible GROUP BY status UNION ALL SELECT 'bucket_available', length_bucket, n FROM e
UNION ALL SELECT 'bucket_targets', length_bucket, (n + 9) // 10 FROM e UNION ALL SELECT 'selected_by_bucket', length_bucket, (n + 9) // 10 FROM e UNION ALL SELECT 'selected_count', '', CAST(sum((n + 9) // 10) AS BIGINT) FROM e""")
def stratified_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report beside the sample, one row per number that is not 0."""
    probes = _probes(spark, sf_dir)
    report = splits.stratified_sample(probes, probes, _tenths(probes), 7)[1]
    rows = [(name, part, n) for name, x in report.items() for part, n in (x.items() if isinstance(x, dict) else [("", x)]) if n]
    return spark.createDataFrame(rows, "name string, part string, n long")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(DISTINCT props) AS props FROM events")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return evaluation.distinct_counts(_table(spark, sf_dir, "events").select(F.col("user_id").alias("users"), F.col("event_type").alias("kinds"), "props"))


_TOOLS = {"signup": "search_products", "view": "open_product", "click": "select_option", "purchase": "buy_now"}
_TOOL_SQL = "CASE event_type WHEN 'signup' THEN 'search_products' WHEN 'view' THEN 'open_product' WHEN 'click' THEN 'select_option' WHEN 'purchase' THEN 'buy_now' END"


def _tool(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for event, tool in _TOOLS.items():
        out = F.when(kind == event, tool).otherwise(out)
    return out


@query(f"""WITH t AS (SELECT event_id, user_id, ts, {_TOOL_SQL} AS tool FROM events)
SELECT event_id, coalesce(max(CASE WHEN tool = 'select_option' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND coalesce(tool NOT IN ('select_option', 'buy_now', 'think'), true) AS late FROM t""")
def option_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", _tool(F.col("event_type")).alias("tool"))
    return replay.option_latch(rows, trajectory="user_id", order=("ts", "event_id")).select("event_id", "late")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 != 0 THEN coalesce(text, '') END AS seen FROM conversations)
SELECT conv_id, turn, md5(coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS previous_md5 FROM m""")
def prev_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over rows: users' turns are observations, each third turn a guard message."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), (F.col("turn") % 3 == 0).alias("guard"), F.col("text").alias("content"))
    return trajectories.previous_observations(rows, "conv_id", "turn").select("conv_id", "turn", F.md5("previous_observation").alias("previous_md5"))


_STREAK_SQL = """i AS (SELECT *, event_type = 'error' AS blocked, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
s AS (SELECT *, CAST(sum(CAST(blocked AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i)"""


@query(f"WITH {_STREAK_SQL} SELECT event_id, streak, streak >= 3 AS over FROM s")
def blocked_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    rows = _table(spark, sf_dir, "events").withColumn("blocked", F.col("event_type") == "error")
    return replay.blocked_streaks(rows, trajectory="user_id", order=("ts", "event_id")).select("event_id", "streak", "over")


@query("""WITH k AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'blocked' WHEN event_type = 'signup' AND event_id % 40 = 0 THEN 'final' ELSE 'step' END AS kind, event_type = 'purchase' AND event_id % 25 = 0 AS done, CAST(event_id % 7 AS DOUBLE) AS reward FROM events),
i AS (SELECT *, sum(CASE WHEN kind = 'blocked' THEN 0 ELSE 1 END) OVER w AS island, sum(CASE WHEN kind = 'step' THEN 1 ELSE 0 END) OVER w AS steps, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(CASE WHEN kind = 'blocked' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i),
e AS (SELECT *, CASE WHEN kind = 'final' THEN 'assistant_final' WHEN kind = 'blocked' AND streak >= 3 THEN 'invalid_action_limit' WHEN kind = 'step' AND done THEN 'done' WHEN kind = 'step' AND steps >= 30 THEN 'max_steps' END AS ended FROM s),
l AS (SELECT user_id, coalesce(min(n) FILTER (ended IS NOT NULL), 1000000000) AS last FROM e GROUP BY user_id)
SELECT e.user_id, coalesce(max(ended) FILTER (n = last), 'running') AS status, count(*) FILTER (n <= last AND kind = 'step') AS steps, count(*) FILTER (n <= last AND kind = 'blocked') AS blocked,
  coalesce(arg_max(reward, n) FILTER (n <= last AND kind = 'step'), 0.0) AS final_reward, count(*) FILTER (n > last) AS after_end FROM e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id""")
def replayed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each user's events, taken as a rollout's log, must have ended."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "blocked").when((F.col("event_type") == "signup") & (e % 40 == 0), "final").otherwise("step")
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), ((F.col("event_type") == "purchase") & (e % 25 == 0)).alias("done"), (e % 7).cast("double").alias("reward"))
    return replay.replayed_status(rows, 30, trajectory="user_id", order=("ts", "event_id"))


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), f AS (SELECT min(step) AS first_step FROM n WHERE event_type = 'error' GROUP BY user_id), c AS (SELECT first_step, count(*) AS n FROM f GROUP BY first_step)
SELECT first_step, n, CAST(sum(n) OVER (ORDER BY first_step) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS cumulative_share FROM c""")
def first_block_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"))
    return evaluation.first_block_steps(rows.where("event_type = 'error'"), "user_id", "step")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT event_id FROM n WHERE step <= 35""")
def step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return replay.capped_steps(_table(spark, sf_dir, "events"), 35, "user_id", ("ts", "event_id")).select("event_id")


@query("""WITH r AS (SELECT event_id, event_type = 'purchase' AS accepted, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS running FROM events)
SELECT event_id, running FROM r WHERE running - CAST(accepted AS BIGINT) < 500""")
def accept_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the operator's own."""
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").alias("accepted"))
    return replay.accept_until(rows, 500, "event_id").select("event_id", "running")


@query("""WITH ids AS (SELECT DISTINCT user_id AS task_id FROM events), t AS (SELECT task_id FROM ids UNION ALL SELECT -1 - task_id FROM ids WHERE task_id % 25 = 3)
SELECT t.task_id, a.attempt_index FROM t, (SELECT range AS attempt_index FROM range(0, 3)) a
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.task_id AND e.event_id % 3 = a.attempt_index AND e.event_type = 'purchase')""")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, R2."""
    done = _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 3).alias("attempt_index"))
    return replay.resume_plan(_expected(spark, sf_dir).distinct(), done, 3)


_PAGE = "'a ' || lpad(doc_id::VARCHAR, 12, '1') || ' ' || lpad((doc_id % 7)::VARCHAR, 12, '2') || ',' || lpad(doc_id::VARCHAR, 13, '3') || 'x' || lpad((doc_id % 7)::VARCHAR, 12, '2') || 'y ' || coalesce(text, '')"


@query(rf"""WITH p AS (SELECT doc_id, regexp_extract_all({_PAGE}, '\d+') AS runs FROM documents)
SELECT doc_id, array_to_string(list_filter(runs, lambda x, i: length(x) = 12 AND list_position(runs, x) = i), ',') AS products FROM p WHERE len(list_filter(runs, lambda x: length(x) = 12)) > 0""")
def product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of exactly 12 digits, beside longer ones and repeats."""
    padded = lambda c, n, with_: F.lpad(c.cast("string"), n, with_)
    short = padded(F.col("doc_id") % 7, 12, "2")
    page = F.concat(F.lit("a "), padded(F.col("doc_id"), 12, "1"), F.lit(" "), short, F.lit(","), padded(F.col("doc_id"), 13, "3"), F.lit("x"), short, F.lit("y "), F.coalesce("text", F.lit("")))
    found = _table(spark, sf_dir, "documents").select("doc_id", actions.product_ids(page).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("products"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: arguments in a JSON text."""
    arguments = actions.parsed_arguments(F.col("props").cast("variant"))
    return _table(spark, sf_dir, "events").select("event_id", v.get(arguments, "k", "long").alias("k"))


@query(f"SELECT event_id, CASE WHEN {_TOOL_SQL} IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('query', 'asin', 'value'))), ',') END AS extra FROM events")
def extra_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    extra = actions.extra_arguments(_tool(F.col("event_type")), F.try_parse_json("props"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(extra, ",").alias("extra"))


@query("""WITH m AS (SELECT conv_id, turn, role, length(role) * 2 + 5 + length(coalesce(text, '')) AS n FROM conversations), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM m)
SELECT conv_id, CAST(e - n + 11 AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end FROM s WHERE role = 'assistant'""")
def assistant_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 with the tokenizer of single characters."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    return rows.select("conv_id", F.explode(tokens.char_spans(F.col("m"))).alias("s")).select("conv_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query("""WITH n AS (SELECT sum(length(text)) AS n_tokens FROM conversations GROUP BY conv_id)
SELECT count(*) AS total, quantile_cont(n_tokens, 0.5) AS p50, quantile_cont(n_tokens, 0.75) AS p75, quantile_cont(n_tokens, 0.9) AS p90, CAST(max(n_tokens) AS BIGINT) AS longest, count(*) FILTER (n_tokens <= 500) AS kept_500, count(*) FILTER (n_tokens <= 1000) AS kept_1000 FROM n""")
def retention_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    lengths = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n_tokens"))
    return evaluation.retention_curve(lengths, (500, 1000))


@query("""WITH a AS (SELECT event_id, range(event_id % 11) AS x, list_transform(range(event_id % 13), lambda i: CASE WHEN i = event_id % 5 THEN -1 ELSE i END) AS y FROM events)
SELECT event_id, least(len(x), len(y), CASE WHEN event_id % 5 < len(y) THEN event_id % 5 ELSE len(y) END) AS shared FROM a""")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 0, one of which the other list replaces."""
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long")), lambda i: i < F.col("event_id") % n)
    other = F.transform(upto(13), lambda i: F.when(i == F.col("event_id") % 5, F.lit(-1).cast("long")).otherwise(i))
    return _table(spark, sf_dir, "events").select("event_id", tokens.common_prefix(upto(11), other).alias("shared"))


@query("""WITH b AS (SELECT event_id, event_id // 8 AS batch, event_id % 6 AS n FROM events), m AS (SELECT batch, max(n) AS most FROM b GROUP BY batch)
SELECT event_id, array_to_string(list_concat(range(n), list_transform(range(most - n), lambda i: 0)), ',') AS ids, array_to_string(list_concat(list_transform(range(n), lambda i: 1), list_transform(range(most - n), lambda i: 0)), ',') AS mask,
  array_to_string(list_concat(range(n), list_transform(range(most - n), lambda i: -100)), ',') AS labels FROM b JOIN m USING (batch)""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lists filled up to the longest of their batch."""
    upto = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < F.col("event_id") % 6)
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 8").alias("batch"), upto.alias("ids"))
    rows = rows.join(rows.groupBy("batch").agg(F.max(F.size("ids")).alias("most")), "batch")
    mask = F.transform("ids", lambda _: F.lit(1))
    filled = {"ids": (F.col("ids"), 0), "mask": (mask, 0), "labels": (F.col("ids"), schema.IGNORE_INDEX)}
    return rows.select("event_id", *[F.array_join(tokens.padded(x, F.col("most"), with_), ",").alias(name) for name, (x, with_) in filled.items()])
