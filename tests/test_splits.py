import random

import pytest
from pyspark.sql import functions as F

from trajkit.operators import evaluation, replay, splits


def ids(spark, values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "ordinal long, task_id long")


def test_held_out_pool_leaves_out_and_ignores_nulls(spark):
    pool = splits.held_out_pool(ids(spark, [1, 2, 2, 3, 4, None]), ids(spark, [2, None]), ids(spark, [4, 9]))
    assert sorted(r[0] for r in pool.collect()) == [1, 3]


def test_samples(spark):
    pool = ids(spark, range(50)).select("task_id")
    first = [r["task_id"] for r in splits.sample(pool, 10, 7).orderBy("ordinal").collect()]
    again = [r["task_id"] for r in splits.sample(pool.repartition(7).orderBy(F.rand()), 10, 7).orderBy("ordinal").collect()]
    assert first == again and len(set(first)) == 10
    expected = list(range(50))
    random.Random(7).shuffle(expected)
    assert [r["task_id"] for r in splits.sample(pool, 10, 7, order="shuffle").orderBy("ordinal").collect()] == expected[:10]
    for size in (0, 51):
        with pytest.raises(ValueError):
            splits.sample(pool, size, 7)


def probes(spark):
    rows = [(i, t, s, n) for i, (t, s, n) in enumerate([(1, "done", 8), (2, "done", 9), (3, "max_steps", 10), (4, "done", 11), (5, "done", 15), (6, "assistant_final", 20), (7, "done", 21), (8, "done", 25), (9, "max_steps", 35), (10, "error", 5), (10, "done", 5), (99, "done", 5), (1, "error", 30), (11, None, None)])]
    return spark.createDataFrame(rows, "ordinal long, task_id long, status string, steps int")


@pytest.mark.parametrize("order", ["hash", "shuffle"])
def test_stratified_sample(spark, order):
    rows, report = splits.stratified_sample(ids(spark, range(1, 12)), probes(spark), {"short": 2, "medium": 2, "long": 1}, 3, order=order)
    got = rows.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(5))
    assert sorted(r["length_bucket"] for r in got) == ["long", "medium", "medium", "short", "short"]
    assert 10 not in {r["task_id"] for r in got}
    assert report == {"candidate_task_count": 11, "probed_candidate_count": 11, "eligible_probe_count": 9, "ignored_probe_status_counts": {"error": 1, "unknown": 1}, "bucket_targets": {"short": 2, "medium": 2, "long": 1}, "bucket_available": {"short": 3, "medium": 3, "long": 3}, "selected_count": 5, "selected_by_bucket": {"short": 2, "medium": 2, "long": 1}}


def test_stratified_sample_never_fills_up(spark):
    with pytest.raises(ValueError, match="long: missing 2, short: missing 1"):
        splits.stratified_sample(ids(spark, range(1, 12)), probes(spark), {"short": 4, "long": 5}, 3)
    for targets in ({}, {"short": -1, "long": 2}):
        with pytest.raises(ValueError):
            splits.stratified_sample(ids(spark, [1]), probes(spark), targets, 3)


def test_frozen_prefix(spark):
    rows, about = splits.frozen_prefix(ids(spark, [5, 3, 9]), "v1", 2, "abc")
    assert [r["task_id"] for r in rows.orderBy("ordinal").collect()] == [5, 3] and about["parent_task_count"] == 3
    for values, size in (([5, 5, 3], 1), ([5], 0), ([5], 2)):
        with pytest.raises(ValueError):
            splits.frozen_prefix(ids(spark, values), "v1", size, "")


@pytest.mark.parametrize(("groups", "ratio", "expected"), [(30, 0.05, 2), (10, 0.25, 2), (14, 0.25, 4), (2, 0.9, 1), (1, 0.5, 0), (9, 0.0, 0), (20, 0.01, 1)])
def test_group_split(spark, groups, ratio, expected):
    rows = spark.createDataFrame([(None if t == 0 else t, a) for t in range(groups) for a in range(2)], "task_id long, attempt int")
    got = splits.group_split(rows, ratio)
    held = [r["task_id"] for r in got.where("split = 'validation'").collect()]
    assert len(held) == 2 * expected and len(set(held)) == expected and got.count() == 2 * groups
    with pytest.raises(ValueError):
        splits.group_split(rows, 1.0)


def test_summary_counts_what_is_missing(spark):
    facts = spark.createDataFrame([(0, 10, "error", False, False, 0.0, 9), (1, 10, "done", True, True, 1.0, 4), (2, 11, "max_steps", False, False, 0.0, 6), (3, 99, "done", True, True, 1.0, 1)], "ordinal long, task_id long, status string, done boolean, strict boolean, final_reward double, steps int")
    facts = facts.withColumns({k: F.col("strict") for k in ("r_type", "r_att", "r_option", "r_price")}).withColumn("guard_reasons", F.array().cast("array<string>"))
    row = evaluation.benchmark_summary(ids(spark, [10, 11, 12, 12]), facts).first().asDict()
    assert (row["expected_tasks"], row["completed_tasks"], row["missing_tasks"]) == (4, 2, [12])
    assert (row["strict_success_rate"], row["mean_final_reward"], row["average_steps"], row["strict_success_task_ids"]) == (0.25, 0.5, 5.0, [10])
    empty = evaluation.benchmark_summary(ids(spark, []), facts).first().asDict()
    assert (empty["expected_tasks"], empty["done_rate"], empty["mean_final_reward"], empty["average_steps"]) == (0, 0.0, 0.0, 0.0)


def test_streaks_are_broken_by_steps(spark):
    blocked = [True, True, False, True, True, True, False, True]
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(blocked)], "task_id long, step_index long, blocked boolean")
    got = replay.blocked_streaks(rows).orderBy("step_index").collect()
    assert [r["streak"] for r in got] == [1, 2, 0, 1, 2, 3, 0, 1] and [r["over"] for r in got].index(True) == 5


def test_replayed_status(spark):
    logs = {
        1: (["step", "blocked", "blocked", "step", "blocked", "final"], "assistant_final", 2, 3, 1.0, 0),
        2: (["blocked", "blocked", "blocked", "step"], "invalid_action_limit", 0, 3, 0.0, 1),
        3: (["step"] * 6, "max_steps", 4, 0, 1.0, 2),
        4: (["step", "done", "step"], "done", 2, 0, 1.0, 1),
        5: (["step", "error"], "error", 1, 0, 1.0, 0),
        6: (["step", "blocked"], "running", 1, 1, 1.0, 0),
    }
    rows = [(t, i, "step" if k == "done" else k, k == "done", 1.0) for t, (kinds, *_) in logs.items() for i, k in enumerate(kinds)]
    got = replay.replayed_status(spark.createDataFrame(rows, "task_id long, step_index long, kind string, done boolean, reward double"), 4).collect()
    assert {r["task_id"]: tuple(r)[1:] for r in got} == {t: x[1:] for t, x in logs.items()}


def test_accept_until(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "ordinal long, accepted boolean").repartition(5)
    got = replay.accept_until(rows, 4).collect()
    assert sorted(r["ordinal"] for r in got) == list(range(10)) and max(r["running"] for r in got) == 4


def test_resume_plan_and_caps(spark):
    done = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "task_id long, attempt_index long")
    left = replay.resume_plan(ids(spark, [1, 2, 3]), done, 2).select("task_id", "attempt_index").collect()
    assert sorted(map(tuple, left)) == [(1, 1), (2, 0), (3, 0), (3, 1)]
    with pytest.raises(ValueError):
        replay.resume_plan(ids(spark, [1]), done, 0)
    steps = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(5)], "task_id long, step_index long")
    assert replay.capped_steps(steps, 3).count() == 6


def test_groups_that_teach_nothing(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (2, 1.0), (3, 0.0), (3, 1.0)], "task_id long, reward double")
    got = {r["task_id"]: (r["mean_reward"], r["var_reward"], r["all_zero"], r["all_one"]) for r in evaluation.group_rewards(rows).collect()}
    assert got == {1: (0.0, 0.0, True, False), 2: (1.0, 0.0, False, True), 3: (0.5, 0.25, False, False)}


def test_message_helpers(spark):
    row = spark.range(1).select(
        replay.initial_messages(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))), "sys", F.lit("buy")).alias("m"), replay.initial_messages(F.lit(None).cast("array<struct<role:string,content:string>>"), "sys", F.lit("buy")).alias("n"),
        replay.first_call(F.array(F.lit(1), F.lit(2))).alias("c"), replay.observation_of(F.parse_json(F.lit('{"observation":"o"}'))).alias("o"),
    ).first()
    assert [tuple(x) for x in row["m"]] == [("system", "sys"), ("user", "hi"), ("user", "buy")] and [x["role"] for x in row["n"]] == ["system", "user"]
    assert tuple(row["c"]) == ([1], [2]) and row["o"] == "o"
    record = spark.range(1).select(replay.rl_record(F.lit(4), F.lit("buy"), "sys", "train", F.lit(0), "env").alias("r")).first()["r"].asDict(True)
    assert record["reward_model"] == {"style": "rule", "ground_truth": None} and record["extra_info"]["interaction_kwargs"] == {"name": "env", "task_id": 4}
    with pytest.raises(Exception, match="no instruction"):
        spark.range(1).select(replay.rl_record(F.lit(4), F.lit(""), "sys", "train", F.lit(0), "env").alias("r")).collect()


def test_accept_until_sees_no_table_in_one_task(spark, tmp_path):
    from trajkit.sources import jsonl

    (tmp_path / "log.jsonl").write_text("".join(f'{{"i":{i},"ok":{"true" if i % 3 == 0 else "false"}}}\n' for i in range(4000)))
    rows = jsonl.read_jsonl(spark, str(tmp_path / "log.jsonl")).repartition(7).selectExpr("ordinal", "variant_get(value, '$.i', 'long') AS i", "variant_get(value, '$.ok', 'boolean') AS accepted")
    out = replay.accept_until(rows, 500)
    assert sorted((r["i"], r["running"]) for r in out.collect()) == [(i, i // 3 + 1) for i in range(1498)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("_part" in line for line in windows)
