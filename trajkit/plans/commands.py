"""Whole jobs: what the command line of a collection and training project runs over its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import values as v
from trajkit.operators import evaluation, replay, sft, splits, tokens
from trajkit.operators.trajectories import judged
from trajkit.sources import jsonl


def build_sft_data(spark: SparkSession, raw: str, accepted: str, rejected: str, stats: str, sft_path: str, retain_reasoning: bool = False) -> dict:
    """Rebuild all derivatives from all raw trajectories; returns the statistics that it writes.

    Raw lines are judged once and kept while the accepted, rejected and training rows are written.
    """
    rows = judged(jsonl.read_jsonl(spark, raw, "trajectory")).persist()
    t = F.col("trajectory")
    good, bad = rows.where("accepted"), rows.where("not accepted")
    jsonl.write_jsonl(good, accepted)
    line = F.to_json(F.struct(v.get(t, "trajectory_id").alias("trajectory_id"), v.get(t, "task_id").alias("task_id"), v.get(t, "status").alias("status"), F.col("reject_reasons")))
    jsonl.write_jsonl(bad.select("ordinal", line.alias("raw_json")), rejected)
    jsonl.write_jsonl(sft.sft_json(sft.sft_rows(good.orderBy("ordinal"), retain_reasoning=retain_reasoning)), sft_path, line="value", ordinal=None)
    total = evaluation.acceptance_totals(rows).first()
    reasons = {r["reason"]: r["n"] for r in evaluation.reject_reason_counts(rows).orderBy("reason").collect()}
    rows.unpersist()
    summary = {"total": total["total"], "accepted": total["accepted"], "rejected": total["rejected"], "reject_reasons": reasons, "retain_teacher_reasoning": bool(retain_reasoning)}
    jsonl.write_summary(spark, stats, summary)
    return summary


def build_batch(spark: SparkSession, folder: str, retain_reasoning: bool = False) -> dict:
    """The derivatives of one batch folder; a batch without raw trajectories gives zeros and no files."""
    paths = jsonl.batch_paths(folder)
    if not jsonl.exists(spark, paths["raw"]):
        return {"total": 0, "accepted": 0, "rejected": 0, "reject_reasons": {}, "retain_teacher_reasoning": bool(retain_reasoning)}
    return build_sft_data(spark, paths["raw"], paths["accepted"], paths["rejected"], paths["stats"], paths["sft"], retain_reasoning)


def accepted_count(spark: SparkSession, raw: str) -> int:
    if not jsonl.exists(spark, raw):
        return 0
    return judged(jsonl.read_jsonl(spark, raw, "trajectory")).where("accepted").count()


def split_sft_data(spark: SparkSession, path: str, train: str, validation: str, ratio: float = 0.05, seed: int = 42) -> dict:
    """Two files of whole tasks; returns rows and tasks of each."""
    rows = splits.group_split(jsonl.read_jsonl(spark, path).withColumn("task_id", v.get(F.col("value"), "task_id", "string")), ratio, seed)
    out = {}
    for name, place in (("train", train), ("validation", validation)):
        part = rows.where(F.col("split") == name)
        jsonl.write_jsonl(part, place)
        out[name] = dict(zip(("rows", "tasks"), part.agg(F.count("*"), F.count_distinct("task_id")).first(), strict=True))
    return out


def inspect_sft_data(spark: SparkSession, path: str, make, max_length: int) -> tuple[dict, dict | None]:
    """Counts of kept and dropped rows, and a look at the first kept one."""
    rows = tokens.supervised_examples(jsonl.read_jsonl_lenient(spark, path), make, max_length)
    first = tokens.preview(rows).first()
    return tokens.drop_counts(rows).first().asDict(), first.asDict() if first else None


def _write_manifest(rows: DataFrame, path: str, *columns: str) -> None:
    jsonl.write_jsonl(rows.select("ordinal", F.to_json(F.struct(*columns)).alias("raw_json")), path)


def create_benchmark(spark: SparkSession, tasks: str, used: str, path: str, size: int, seed: int, order: str = "hash") -> int:
    """A manifest of held-out tasks; returns the number of tasks that may be held out."""
    pool = splits.held_out_pool(jsonl.read_task_ids(spark, tasks), jsonl.read_task_ids(spark, used))
    _write_manifest(splits.sample(pool, size, seed, order=order), path, "task_id")
    return pool.count()


def freeze_benchmark(spark: SparkSession, parent: str, path: str, about_path: str, size: int) -> dict:
    rows, about = splits.frozen_prefix(jsonl.read_task_ids(spark, parent), str(parent).rstrip("/").rpartition("/")[2], size, jsonl.sha256_path(spark, parent))
    _write_manifest(rows, path, "task_id")
    jsonl.write_summary(spark, about_path, about)
    return about


def evaluate_benchmark(spark: SparkSession, manifest: str, runs: str, path: str, protocol: dict | None = None) -> dict:
    """Summarise recorded runs, none if the file is missing, over a manifest's tasks."""
    expected = jsonl.read_tasks(spark, manifest)
    facts = evaluation.run_facts(jsonl.read_jsonl_optional(spark, runs, "trajectory")).persist()
    summary = evaluation.benchmark_summary(expected, facts).first().asDict()
    last = evaluation.last_runs(facts, expected)
    summary["reward_component_rates"] = {k: summary.pop(f"{k}_rate") for k in schema.REWARD_KEYS}
    summary["status_counts"] = {r[0]: r[1] for r in evaluation.status_counts(last).orderBy("status").collect()}
    summary["guard_reason_counts"] = {r[0]: r[1] for r in evaluation.guard_reason_counts(last).orderBy("reason").collect()}
    facts.unpersist()
    if protocol is not None:
        summary["protocol"] = protocol
    jsonl.write_summary(spark, path, summary)
    return summary


def prepare_candidates(spark: SparkSession, tasks: str, raw_runs: str, benchmark: str, path: str, size: int, seed: int, extra: str | None = None, order: str = "hash") -> DataFrame:
    """A probe pool that no recorded run, extra training row or benchmark has touched."""
    others = [jsonl.read_task_ids(spark, p) for p in (raw_runs, benchmark, extra) if p]
    rows = splits.sample(splits.held_out_pool(jsonl.read_task_ids(spark, tasks), *others), size, seed, order=order)
    _write_manifest(rows, path, "task_id")
    return rows


def select_candidates(spark: SparkSession, candidates: str, probes: str, path: str, about_path: str, targets: dict[str, int], seed: int, order: str = "hash") -> dict:
    t = F.col("trajectory")
    runs = jsonl.read_jsonl(spark, probes, "trajectory").select("ordinal", v.get(t, "task_id", "long").alias("task_id"), v.get(t, "status", "string").alias("status"), F.size(v.items(v.get(t, "steps"))).alias("steps"))
    rows, report = splits.stratified_sample(jsonl.read_task_ids(spark, candidates), runs, targets, seed, order=order)
    _write_manifest(rows, path, "task_id", "probe_steps", "length_bucket")
    jsonl.write_summary(spark, about_path, report)
    return report


def prepare_rl_dataset(spark: SparkSession, tasks: str, instructions: DataFrame | Callable[[DataFrame], DataFrame], path: str, system: str, environment: str, split: str = "train") -> None:
    """Prompt records in manifest order as Parquet; a task without an instruction fails the job.

    instructions are (task_id, instruction), or what makes them of the manifest (ordinal, task_id): a plug-in that asks an
    environment, say by mapInPandas or a data source of its own.
    """
    ids = jsonl.read_task_ids(spark, tasks)
    instructions = instructions if isinstance(instructions, DataFrame) else instructions(ids)
    rows = numbered(ids, "index").join(instructions, "task_id", "left").orderBy("index")
    record = replay.rl_record(F.col("task_id"), F.col("instruction"), system, split, F.col("index"), environment)
    rows.select(record.alias("r")).select("r.*").write.mode("overwrite").parquet(path)


def numbered(rows: DataFrame, name: str, ordinal: str = "ordinal") -> DataFrame:
    """rows with their place from 0 by ordinal, ranges of the order side by side: no task sees them all."""
    laid = rows.orderBy(ordinal).withColumn("_at", F.monotonically_increasing_id()).persist()
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    starts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_start"))  # one row a range
    return laid.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def plan_collection(spark: SparkSession, tasks: str, raw: str, attempts: int, limit: int | None = None) -> DataFrame:
    """The attempts that a collection still has to run."""
    rows = splits.first_tasks(jsonl.read_tasks(spark, tasks), limit).select("ordinal", "task_id")
    return replay.resume_plan(rows, jsonl.read_completed_attempts(spark, raw), attempts)


def export_task_ids(spark: SparkSession, count: int, path: str, force: bool = False) -> None:
    jsonl.write_task_ids(spark, count, path, force)


def adapter_configs(tool_class: str, interaction_class: str, environment: str, base_url: str, max_steps: int, timeout: int = 60) -> tuple[dict, dict]:
    """Tool and interaction settings of an online-RL adapter, made of the one list of tools."""
    tools = {"tools": [{"class_name": tool_class, "config": {"type": "native"}, "tool_schema": s} for s in schema.tool_schemas()]}
    interaction = {"interaction": [{"name": environment, "class_name": interaction_class, "config": {"base_url": base_url, "timeout": timeout, "max_steps": int(max_steps)}}]}
    return tools, interaction
