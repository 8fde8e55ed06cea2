"""Queries over files and streams: the tables are written as logs and manifests, read back by the scans, and run through whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajkit.functions import values as v
from trajkit.operators import replay, tokens
from trajkit.plans import commands, trips
from trajkit.plans.registered import query, table
from trajkit.sources import jsonl
from trajkit.sources.scratch import delete_at_end, own_folder
from trajkit.streaming import ingest


def _folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{own_folder(spark)}/files/{uuid.uuid4().hex}"


def _written(rows: DataFrame, **how) -> str:
    """rows (ordinal, raw_json) as a log of their own; its path."""
    path = _folder(rows.sparkSession)
    jsonl.write_jsonl(rows, path, **how)
    delete_at_end(rows.sparkSession)
    return path


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event: event_id, its user as task_id, and what its props hold."""
    line = F.to_json(F.struct("event_id", F.col("user_id").alias("task_id"), F.try_parse_json("props").alias("props")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), line.alias("raw_json"))


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select(v.get(F.col("value"), "event_id", "long").alias("event_id"), v.get(F.col("value"), "task_id", "long").alias("task_id"), v.get(F.col("value"), "props.k", "long").alias("k"))


_LINES_SQL = "SELECT event_id, user_id AS task_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


@query(_LINES_SQL)
def strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed log, written in order and read strictly."""
    return _fields(jsonl.read_jsonl(spark, _written(_event_lines(spark, sf_dir), compression="gzip")))


@query(f"WITH l AS ({_LINES_SQL}) SELECT l.event_id, n.event_id AS next_id FROM l JOIN (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS was FROM l) n ON n.was = l.event_id")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines keep the order that they were written in; each with the one that follows it."""
    rows = commands.numbered(jsonl.read_jsonl(spark, _written(_event_lines(spark, sf_dir))), "at").select("at", v.get(F.col("value"), "event_id", "long").alias("event_id"))
    return rows.join(rows.select((F.col("at") - 1).alias("at"), F.col("event_id").alias("next_id")), "at").select("event_id", "next_id")


@query(_LINES_SQL)
def optional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is there, and one that is missing."""
    there, missing = _written(_event_lines(spark, sf_dir)), _folder(spark)
    return _fields(jsonl.read_jsonl_optional(spark, there).select("value").union(jsonl.read_jsonl_optional(spark, missing).select("value")))


@query("SELECT DISTINCT user_id AS task_id, CASE WHEN event_id % 10 = 5 THEN 0 ELSE event_id % 3 END AS attempt_index FROM events WHERE event_id % 10 NOT IN (3, 4)")
def completed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with broken lines, lines without a task, and lines without an attempt."""
    e, task = F.col("event_id"), F.col("user_id").cast("string")
    whole = F.concat(F.lit('{"task_id":'), task, F.lit(',"attempt_index":'), (e % 3).cast("string"), F.lit("}"))
    line = F.when(e % 10 == 3, F.concat(F.lit('{"task_id":'), task, F.lit(","))).when(e % 10 == 4, '{"attempt_index":1}').when(e % 10 == 5, F.concat(F.lit('{"task_id":'), task, F.lit("}"))).otherwise(whole)
    return jsonl.read_completed_attempts(spark, _written(table(spark, sf_dir, "events").select(e.alias("ordinal"), line.alias("raw_json"))))


@query("SELECT user_id AS task_id, count(*) AS n FROM events GROUP BY user_id")
def task_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task's id at each of its three places."""
    task = F.concat(F.lit('"task_id":'), F.col("user_id").cast("string"))
    m = F.col("event_id") % 3
    line = F.when(m == 0, F.concat(F.lit("{"), task, F.lit(',"extra_info":{"task_id":-1}}'))).when(m == 1, F.concat(F.lit('{"extra_info":{'), task, F.lit("}}"))).otherwise(F.concat(F.lit('{"extra_info":{"interaction_kwargs":{'), task, F.lit("}}}")))
    rows = jsonl.read_tasks(spark, _written(table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), line.alias("raw_json"))))
    return rows.groupBy("task_id").agg(F.count("*").alias("n"))


@query("SELECT unnest(range(max(user_id) + 1)) AS task_id FROM events")
def task_id_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many ids as there are users, exported and read back."""
    path, count = _folder(spark), table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1
    commands.export_task_ids(spark, count, path)
    delete_at_end(spark)
    return jsonl.read_task_ids(spark, path).select("task_id")


@query(_LINES_SQL)
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: even events first, odd ones appended."""
    rows = _event_lines(spark, sf_dir)
    path = _written(rows.where("ordinal % 2 = 0"))
    jsonl.append_jsonl(rows.where("ordinal % 2 = 1"), path)
    return _fields(jsonl.read_jsonl(spark, path))


@query("""WITH t AS (SELECT DISTINCT user_id AS task_id FROM events)
SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS index, 'train' AS split, 'shop' AS data_source, 'rule' AS style, true AS no_truth, 'system:be brief|user:buy ' || task_id AS prompt, task_id AS argument FROM t""")
def rl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt records of a manifest, with a plug-in for the instructions, written as Parquet."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")).distinct()
    manifest, path = _written(ids.select(F.col("task_id").alias("ordinal"), F.to_json(F.struct("task_id")).alias("raw_json"))), _folder(spark)
    commands.prepare_rl_dataset(spark, manifest, lambda tasks: tasks.select("task_id", F.concat(F.lit("buy "), F.col("task_id").cast("string")).alias("instruction")), path, "be brief", "shop")
    shown = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return spark.read.parquet(path).select("extra_info.task_id", "extra_info.index", "extra_info.split", "data_source", "reward_model.style", F.col("reward_model.ground_truth").isNull().alias("no_truth"), shown.alias("prompt"), F.col("extra_info.interaction_kwargs.task_id").alias("argument"))


@query("""WITH g AS (SELECT user_id, row_number() OVER (ORDER BY sha256('42:' || user_id::VARCHAR), user_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id, CASE WHEN k <= least(greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM events JOIN g ON events.user_id = g.user_id""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log split into two files of whole tasks."""
    train, validation = _folder(spark), _folder(spark)
    commands.split_sft_data(spark, _written(_event_lines(spark, sf_dir)), train, validation)
    read = lambda path, name: _fields(jsonl.read_jsonl(spark, path)).select("event_id", F.lit(name).alias("split"))
    return read(train, "train").union(read(validation, "validation"))


@query(f"""WITH {trips.REASONS_SQL}, w AS (SELECT unnest(reasons) AS reason FROM r)
SELECT 'accepted' AS file, 't' || event_id AS name, '' AS detail, 1::BIGINT AS n FROM r WHERE len(reasons) = 0 UNION ALL SELECT 'rejected', 't' || event_id, array_to_string(reasons, ' '), 1 FROM r WHERE len(reasons) > 0
UNION ALL SELECT 'sft', 't' || event_id, user_id::VARCHAR, 9 FROM r WHERE len(reasons) = 0 UNION ALL SELECT 'stats', reason, '', count(*) FROM w GROUP BY reason
UNION ALL SELECT 'stats', 'total', '', count(*) FROM r UNION ALL SELECT 'stats', 'accepted', '', count(*) FROM r WHERE len(reasons) = 0 UNION ALL SELECT 'stats', 'rejected', '', count(*) FROM r WHERE len(reasons) > 0 UNION ALL SELECT 'empty', 'total', '', 0""")
def rebuilt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a batch's raw log is made into, its statistics, and a batch without a log."""
    folder = _folder(spark)
    paths = jsonl.batch_paths(folder)
    jsonl.write_jsonl(trips.trips(spark, sf_dir).withColumnRenamed("event_id", "ordinal"), paths["raw"])
    delete_at_end(spark)
    commands.build_batch(spark, folder)
    stats, empty = jsonl.read_summary(spark, paths["stats"]), commands.build_batch(spark, _folder(spark))
    value, name = F.col("value"), v.get(F.col("value"), "trajectory_id", "string").alias("name")
    one = F.lit(1).cast("long").alias("n")
    out = jsonl.read_jsonl(spark, paths["accepted"]).select(F.lit("accepted").alias("file"), name, F.lit("").alias("detail"), one)
    out = out.union(jsonl.read_jsonl(spark, paths["rejected"]).select(F.lit("rejected"), name, F.array_join(v.get(value, "reject_reasons", "array<string>"), " "), one))
    out = out.union(jsonl.read_jsonl(spark, paths["sft"]).select(F.lit("sft"), name, v.get(value, "task_id", "string"), F.size(v.items(v.get(value, "messages"))).cast("long")))
    numbers = [("stats", k, "", n) for k, n in (stats["reject_reasons"] | {k: stats[k] for k in ("total", "accepted", "rejected")}).items()] + [("empty", "total", "", empty["total"])]
    return out.union(spark.createDataFrame(numbers, "file string, name string, detail string, n long"))


@query("SELECT sha256(string_agg('{\"n\":' || n_nationkey || '}' || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation")
def lineage_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a manifest, part by part."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.concat(F.lit('{"n":'), F.col("n_nationkey").cast("string"), F.lit("}")).alias("raw_json"))
    return spark.createDataFrame([(jsonl.sha256_path(spark, _written(rows.repartition(3))),)], "sha256 string")


#: The longest conversation that the queries of loss masks keep, in characters.
_MOST = 3000


def _characters():
    """A template and a tokenizer: <role>content</role>, tokens are code points, <assistant> asks for an answer."""
    def render(messages: list[dict], tools: list[dict], ask: bool) -> str:
        return "".join(f"<{m['role']}>{m.get('content') or ''}</{m['role']}>" for m in messages) + "<assistant>" * ask

    return render, lambda text: [ord(c) for c in text]


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as training rows: by conv_id % 7, 0 with arguments that are no object, 1 broken off."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    calls = F.when(F.col("conv_id") % 7 == 0, F.array(F.struct(F.struct(F.lit("f").alias("name"), F.lit("[]").alias("arguments")).alias("function"))))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), calls.alias("tool_calls")))
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trajectory_id"), F.col("conv_id").alias("task_id"), messages.alias("messages")))
    rows = rows.select("conv_id", line.alias("raw_json")).withColumn("raw_json", F.when(F.col("conv_id") % 7 == 1, F.expr("substring(raw_json, 1, length(raw_json) - 1)")).otherwise(F.col("raw_json")))
    return tokens.supervised_examples(rows, _characters, _MOST)


_EXAMPLES_SQL = f"""t AS (SELECT conv_id, turn, role, '<' || role || '>' || coalesce(text, '') || '</' || role || '>' AS shown, CASE WHEN role = 'assistant' THEN coalesce(text, '') || '</assistant>' ELSE '' END AS learned FROM conversations),
c AS (SELECT conv_id, string_agg(shown, '' ORDER BY turn) AS shown, string_agg(learned, '' ORDER BY turn) AS learned FROM t GROUP BY conv_id),
x AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'bad_arguments' WHEN conv_id % 7 = 1 THEN 'bad_row' WHEN learned = '' THEN 'no_assistant' WHEN length(shown) > {_MOST} THEN 'too_long' END AS drop_reason FROM c)"""


@query(f"""WITH {_EXAMPLES_SQL} SELECT CASE WHEN conv_id % 7 != 1 THEN 'c' || conv_id END AS trajectory_id, coalesce(drop_reason, '') AS drop_reason, CASE WHEN drop_reason IS NULL THEN length(shown) ELSE 0 END AS n_tokens, CASE WHEN drop_reason IS NULL THEN length(shown) ELSE 0 END AS attended,
  CASE WHEN drop_reason IS NULL THEN length(learned) ELSE 0 END AS n_learned, CASE WHEN drop_reason IS NULL THEN md5(array_to_string(list_transform(string_split(learned, ''), lambda y: unicode(y)), ',')) ELSE md5('') END AS learned_md5 FROM x""")
def loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, masks and labels, or why a row is dropped, by a plug-in of single characters."""
    learned = F.filter("labels", lambda y: y != -100)
    return _examples(spark, sf_dir).select("trajectory_id", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"), F.size("input_ids").cast("long").alias("n_tokens"), F.size("attention_mask").cast("long").alias("attended"), F.size(learned).cast("long").alias("n_learned"), F.md5(F.array_join(learned, ",")).alias("learned_md5"))


@query(f"WITH {_EXAMPLES_SQL} SELECT count(*) AS total, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason IS NOT NULL) AS dropped FROM x")
def drop_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, S7."""
    return tokens.drop_counts(_examples(spark, sf_dir))


@query(f"WITH {_EXAMPLES_SQL} SELECT 'c' || conv_id AS trajectory_id, length(shown) AS n_tokens, array_to_string(list_transform(list_slice(string_split(shown, ''), 1, 64), lambda y: unicode(y)), ',') AS input_ids FROM x WHERE drop_reason IS NULL ORDER BY trajectory_id LIMIT 1")
def first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at the first example; showing one is the feature."""
    return tokens.preview(_examples(spark, sf_dir), 64).select("trajectory_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.array_join("input_ids", ",").alias("input_ids"))


@query("SELECT DISTINCT user_id AS task_id, event_id % 3 AS attempt_index FROM events WHERE event_id % 10 != 3")
def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: a log that arrives in files, read as a stream; each attempt is appended once."""
    task = F.col("user_id").cast("string")
    whole = F.concat(F.lit('{"task_id":'), task, F.lit(',"attempt_index":'), (F.col("event_id") % 3).cast("string"), F.lit("}"))
    arrived = _written(table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(whole).alias("raw_json")))
    out, checkpoint = _folder(spark), _folder(spark)
    ingest.append_log(ingest.first_attempts(ingest.stream_trajectories(spark, arrived, files_per_trigger=4)), out, checkpoint).awaitTermination()
    rows = jsonl.read_jsonl(spark, f"{out}/batch=*")
    return rows.select(v.get(F.col("value"), "task_id", "long").alias("task_id"), v.get(F.col("value"), "attempt_index", "long").alias("attempt_index"))


def _streamed(rows: DataFrame, how) -> DataFrame:
    """rows as a stream of one file, through how, and what came of it."""
    spark, arrived, out = rows.sparkSession, _folder(rows.sparkSession), _folder(rows.sparkSession)
    rows.coalesce(1).write.parquet(arrived)
    delete_at_end(spark)
    how(spark.readStream.schema(rows.schema).parquet(arrived)).writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("step_index"), (F.col("event_type") == "error").alias("blocked"), F.when(F.col("event_type") != "error", F.col("props")).alias("observation"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id AS task_id, event_id AS step_index, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")
def streamed_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked calls in a row, kept per task by a stream."""
    return _streamed(_steps(spark, sf_dir).drop("observation"), ingest.streak_events).select("task_id", "step_index", "streak")


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type != 'error' THEN props END AS observation FROM events)
SELECT user_id AS task_id, event_id AS step_index, coalesce(last_value(observation IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS seen FROM s""")
def streamed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page seen before each step, kept per task by a stream."""
    return _streamed(_steps(spark, sf_dir).drop("blocked"), ingest.latest_observations).select("task_id", "step_index", "seen")


@query("""WITH s AS (SELECT user_id AS task_id, event_id % 3 AS attempt_index, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS accepted FROM events), r AS (SELECT *, CAST(sum(accepted) OVER (ORDER BY event_id) AS BIGINT) AS running FROM s)
SELECT event_id, running FROM r WHERE running - accepted < 40""")
def accepted_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, T8 over a scanned log, in the order of its lines."""
    rows = jsonl.read_jsonl(spark, _written(table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.to_json(F.struct("event_id", "event_type")).alias("raw_json"))))
    rows = rows.select("ordinal", v.get(F.col("value"), "event_id", "long").alias("event_id"), (v.get(F.col("value"), "event_type", "string") == "purchase").alias("accepted"))
    return replay.accept_until(rows, 40).select("event_id", "running")
