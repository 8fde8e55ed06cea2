import hashlib
import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from tests.data import trajectory
from trajkit import schema
from trajkit.operators import tokens
from trajkit.plans import commands
from trajkit.sources import jsonl
from trajkit.streaming import ingest


def put(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines() if x]


def test_strict_and_lenient_scans(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", ['{"task_id": 1, "t": "a b"}', "", "  ", '{"task_id": 2, "attempt_index": 3, "task_id": 4}'])
    assert [r["task_id"] for r in jsonl.read_task_ids(spark, path).orderBy("ordinal").collect()] == [1, 4]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"task_id": 7}\n')
    assert jsonl.read_task_ids(spark, str(tmp_path / "b.jsonl.gz")).collect()[0]["task_id"] == 7
    bad = put(tmp_path / "c.jsonl", ['{"task_id": 1}', "{broken", '{"task_id": 5} tail', '{"x": 1}', '{"task_id": 1}'])
    with pytest.raises(Exception, match="not JSON"):
        jsonl.read_jsonl(spark, bad).collect()
    assert sorted(map(tuple, jsonl.read_completed_attempts(spark, bad).collect())) == [(1, 0)]
    assert jsonl.corrupt_lines(spark, bad) == 2
    assert jsonl.read_completed_attempts(spark, str(tmp_path / "none")).count() == 0 == jsonl.read_jsonl_optional(spark, str(tmp_path / "none")).count()


def test_task_ids_come_from_three_places(spark, tmp_path):
    path = put(tmp_path / "t.jsonl", [{"task_id": 1}, {"extra_info": {"task_id": 2}}, {"extra_info": {"interaction_kwargs": {"task_id": 3}}}])
    assert [r["task_id"] for r in jsonl.read_tasks(spark, path).orderBy("ordinal").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="missing task_id"):
        jsonl.read_tasks(spark, put(tmp_path / "u.jsonl", [{"a": 1}])).collect()


def test_task_id_export(spark, tmp_path):
    path = tmp_path / "ids"
    jsonl.write_task_ids(spark, 25, str(path))
    assert [r["task_id"] for r in lines(path)] == list(range(25))
    with pytest.raises(FileExistsError):
        jsonl.write_task_ids(spark, 3, str(path))
    commands.export_task_ids(spark, 3, str(path), force=True)
    assert len(lines(path)) == 3
    with pytest.raises(ValueError):
        jsonl.write_task_ids(spark, -1, str(path), force=True)


def test_file_hashes(spark, tmp_path):
    path = put(tmp_path / "h.txt", ["abc"])
    assert jsonl.file_hashes(spark, path).first()["sha256"] == jsonl.sha256_path(spark, path)


def test_batch_is_rebuilt_from_all_raw(spark, tmp_path):
    assert commands.build_batch(spark, str(tmp_path))["total"] == 0
    raw = [trajectory(), trajectory(trajectory_id="t2", status="error", error={"type": "X"}), trajectory(trajectory_id="t3")]
    put(tmp_path / "raw.jsonl", raw)
    first = commands.build_batch(spark, str(tmp_path))
    assert first == {"total": 3, "accepted": 2, "rejected": 1, "reject_reasons": {"has_error": 1, "status_not_done": 1}, "retain_teacher_reasoning": False}
    assert lines(tmp_path / "accepted.jsonl") == [raw[0], raw[2]]
    assert lines(tmp_path / "rejected.jsonl") == [{"trajectory_id": "t2", "task_id": 7, "status": "error", "reject_reasons": ["has_error", "status_not_done"]}]
    assert [r["trajectory_id"] for r in lines(tmp_path / "sft.jsonl")] == ["t1", "t3"]
    assert commands.build_batch(spark, str(tmp_path)) == first == json.loads((tmp_path / "reject_stats.json").read_text())
    assert commands.accepted_count(spark, str(tmp_path / "raw.jsonl")) == 2


def test_evaluation(spark, tmp_path):
    manifest = put(tmp_path / "m.jsonl", [{"task_id": i} for i in (7, 8, 9)])
    runs = put(tmp_path / "r.jsonl", [trajectory(status="error"), trajectory(blocked_tool_calls=[{"reason": "x"}, {}]), trajectory(task_id=8, done=False, status=None, steps=None, final_reward=0.0), trajectory(task_id=1)])
    out = commands.evaluate_benchmark(spark, manifest, runs, str(tmp_path / "s.json"), {"max_steps": 35})
    assert (out["expected_tasks"], out["missing_tasks"], out["strict_success_task_ids"], out["average_steps"], out["mean_final_reward"]) == (3, [9], [7], 2.0, 0.5)
    assert out["status_counts"] == {"done": 1, "unknown": 1} and out["guard_reason_counts"] == {"unknown": 1, "x": 1}
    assert json.loads((tmp_path / "s.json").read_text())["protocol"] == {"max_steps": 35}
    assert commands.evaluate_benchmark(spark, manifest, str(tmp_path / "none"), str(tmp_path / "s2.json"))["completed_tasks"] == 0


def test_splitting_and_manifests(spark, tmp_path):
    rows = put(tmp_path / "sft.jsonl", [{"task_id": t, "a": a} for t in range(30) for a in range(2)])
    out = commands.split_sft_data(spark, rows, str(tmp_path / "train"), str(tmp_path / "val"))
    assert out == {"train": {"rows": 56, "tasks": 28}, "validation": {"rows": 4, "tasks": 2}}
    assert not {r["task_id"] for r in lines(tmp_path / "train")} & {r["task_id"] for r in lines(tmp_path / "val")}
    tasks, used = put(tmp_path / "all.jsonl", [{"task_id": i} for i in range(20)]), put(tmp_path / "used.jsonl", [{"task_id": i} for i in range(5)])
    assert commands.create_benchmark(spark, tasks, used, str(tmp_path / "bench"), 6, 1) == 15
    chosen = [r["task_id"] for r in lines(tmp_path / "bench")]
    assert len(chosen) == 6 and min(chosen) >= 5
    # Each job reads what the one before it wrote, a folder of parts.
    parent = str(tmp_path / "bench")
    about = commands.freeze_benchmark(spark, parent, str(tmp_path / "small"), str(tmp_path / "about.json"), 2)
    assert [r["task_id"] for r in lines(tmp_path / "small")] == chosen[:2] and about["parent_benchmark"] == "bench"
    assert about["parent_sha256"] == hashlib.sha256("".join(json.dumps({"task_id": i}, separators=(",", ":")) + "\n" for i in chosen).encode()).hexdigest()
    assert jsonl.read_summary(spark, str(tmp_path / "about.json")) == about
    commands.prepare_candidates(spark, tasks, used, str(tmp_path / "small"), str(tmp_path / "pool"), 9, 1)
    pool = str(tmp_path / "pool")
    assert not {r["task_id"] for r in lines(tmp_path / "pool")} & ({*range(5)} | set(chosen[:2]))
    runs = put(tmp_path / "probes.jsonl", [trajectory(task_id=r["task_id"], steps=[{}] * (5 + 10 * (i % 3))) for i, r in enumerate(lines(tmp_path / "pool"))])
    report = commands.select_candidates(spark, pool, runs, str(tmp_path / "chosen"), str(tmp_path / "report.json"), {"short": 1, "medium": 1, "long": 1}, 5)
    assert report["selected_count"] == 3 and len(lines(tmp_path / "chosen")) == 3
    plan = commands.plan_collection(spark, tasks, runs, 2, limit=10).select("task_id", "attempt_index").collect()
    assert len(plan) == 20 - sum(r["task_id"] < 10 for r in lines(tmp_path / "pool"))


def test_rl_dataset(spark, tmp_path):
    tasks = put(tmp_path / "t.jsonl", [{"task_id": 5}, {"task_id": 3}])
    said = spark.createDataFrame([(3, "buy tea"), (5, "buy cups")], "task_id long, instruction string")
    commands.prepare_rl_dataset(spark, tasks, said, str(tmp_path / "rl"), "sys", "env")
    got = [r.asDict(True) for r in spark.read.parquet(str(tmp_path / "rl")).orderBy("extra_info.index").collect()]
    assert [r["extra_info"]["task_id"] for r in got] == [5, 3] and got[0]["prompt"][1]["content"] == "buy cups"
    assert sorted(got[0]) == ["ability", "data_source", "extra_info", "prompt", "reward_model"]
    with pytest.raises(Exception, match="no instruction"):
        commands.prepare_rl_dataset(spark, tasks, said.where("task_id = 3"), str(tmp_path / "rl2"), "sys", "env")


def test_configs_hold_every_tool():
    tools, interaction = commands.adapter_configs("a.Tool", "a.Interaction", "env", "http://x", 35)
    assert [t["tool_schema"]["function"]["name"] for t in tools["tools"]] == list(schema.TOOL_DESCRIPTIONS) and interaction["interaction"][0]["config"]["max_steps"] == 35


def make_chars():
    def render(messages, tools, prompt):
        text = "".join(f"<{m['role']}>{m.get('content') or ''}" + "".join(f"[{c['function']['name']}={sorted(c['function']['arguments'])}]" for c in m.get("tool_calls") or []) + f"</{m['role']}>" for m in messages)
        if "explode" in text:
            raise ValueError
        return text + ("<assistant>" if prompt else "")

    return render, lambda text: [ord(c) for c in text]


def test_loss_masks(spark, tmp_path):
    user, said = {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}
    asked = {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "t", "arguments": '{"b":1}'}}]}
    rows = [{"trajectory_id": "a", "task_id": 1, "messages": [user, said, user, asked]}, {"messages": [user]}, {"messages": [user, {**asked, "tool_calls": [{"function": {"arguments": "["}}]}]}, {"messages": [user, {"role": "assistant", "content": "x" * 300}]}, {"messages": [{"role": "user", "content": "explode"}, said]}, {"no": 1}, "broken"]
    path = put(tmp_path / "s.jsonl", rows)
    out = tokens.supervised_examples(jsonl.read_jsonl_lenient(spark, path).orderBy("ordinal"), make_chars, 200).collect()
    assert [r["drop_reason"] for r in out] == [None, "no_assistant", "bad_arguments", "too_long", "template_error", "bad_row", "bad_row"]
    learned = "".join(chr(t) for t in out[0]["labels"] if t != schema.IGNORE_INDEX)
    assert learned == "yes</assistant>[t=['b']]</assistant>" and out[0]["attention_mask"] == [1] * len(out[0]["input_ids"])
    counts, first = commands.inspect_sft_data(spark, path, make_chars, 200)
    assert counts == {"total": 7, "kept": 1, "dropped": 6} and first["trajectory_id"] == "a"


def test_char_spans_agree_with_the_plugin(spark):
    messages = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}, {"role": "user", "content": ""}, {"role": "assistant", "content": "no"}]
    rows = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    spans = tokens.char_spans(F.col("m"))
    text = F.array_join(tokens.char_rendered(F.col("m")), "")
    ids = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    row = rows.select(tokens.labels(ids, spans).alias("labels"), ids.alias("ids")).first()
    whole, learned = tokens.learned_spans(messages, [], *make_chars(), 1000)
    assert row["ids"] == whole.tolist() and [(s["start"], s["end"]) for s in rows.select(spans.alias("s")).first()["s"]] == learned
    assert row["labels"] == [t if any(a <= i < b for a, b in learned) else schema.IGNORE_INDEX for i, t in enumerate(row["ids"])]


def test_spans_that_cannot_be_learned():
    said = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    render, tokenize = make_chars()

    def reason(render=render, tokenize=tokenize, messages=said, most=1000):
        with pytest.raises(tokens.Dropped) as e:
            tokens.learned_spans(messages, [], render, tokenize, most)
        return str(e.value)

    assert reason(messages=said[:1]) == "no_assistant" and reason(most=3) == "too_long"
    assert reason(render=lambda m, t, ask: render(m, t, ask) if len(m) > 1 else 1 / 0) == "boundary_error"
    assert reason(render=lambda m, t, ask: 1 / 0) == "template_error"
    assert reason(render=lambda m, t, ask: render(m[:1], t, False)) == "empty_or_overlong_span"
    calls = []
    first_differs = lambda m, t, ask: (calls.append(1), "z" * (len(calls) == 1) + render(m, t, ask))[1]
    assert reason(render=first_differs, messages=[*said, said[0]]) == "not_a_prefix"
    # Tokens of two characters: the prompt's last one may be another with the turn; the span begins where they part.
    pairs = lambda text: [hash(text[i : i + 2]) % 1000 for i in range(0, len(text), 2)]
    ids, spans = tokens.learned_spans(said, [], render, pairs, 1000)
    prompt = pairs("<user>a</user><assistant>")
    assert spans == [(next((i for i, (x, y) in enumerate(zip(prompt, ids, strict=False)) if x != y), len(prompt)), len(ids))]


def test_small_token_helpers(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(tokens.common_prefix(a(1, 2, 3), a(1, 2, 4, 5)), tokens.common_prefix(a(1), a(1, 2)), tokens.padded(a(1, 2), F.lit(4), 0)).first()
    assert tuple(row) == (2, 1, [1, 2, 0, 0])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.jsonl", [{"task_id": 1}, {"task_id": 1, "attempt_index": 0}, "broken"])
    put(tmp_path / "in/b.jsonl", [{"task_id": 1}, {"task_id": 2, "attempt_index": 1}])
    stream = ingest.stream_trajectories(spark, str(tmp_path / "in"), 1)
    query = ingest.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c1"))
    query.awaitTermination(60)
    assert spark.read.text(str(tmp_path / "log")).count() == 5
    query = ingest.first_attempts(stream).select("task_id", "attempt_index").writeStream.format("memory").queryName("attempts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("attempts").collect())) == [(1, 0), (2, 1)]


def test_streaks_hold_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, True), (1, 3, False), (1, 4, True)]
    for n, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        put(tmp_path / f"in/{n}.json", [dict(zip(("task_id", "step_index", "blocked"), r, strict=True)) for r in part])
        time.sleep(0.05)
    stream = spark.readStream.schema("task_id long, step_index long, blocked boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = ingest.streak_events(stream).writeStream.format("memory").queryName("streaks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["task_id"], r["step_index"]): (r["streak"], r["over"]) for r in spark.table("streaks").collect()}
    assert got == {(1, 0): (1, False), (1, 1): (2, False), (1, 2): (3, True), (2, 0): (1, False), (1, 3): (0, False), (1, 4): (1, False)}
