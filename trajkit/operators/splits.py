"""Held-out pools, stratified samples, frozen prefixes and grouped splits.

Random orders come in two kinds. "hash" orders by the SHA-256 of seed and id: it does not depend on partitions and runs
anywhere. "shuffle" is the seeded shuffle of the standard library over the ids in ascending order, done on the driver; it
takes at most MOST_SHUFFLED ids.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit import schema

MOST_SHUFFLED = 5_000_000


def hash_order(seed: int | str, *ids: str) -> list[Column]:
    text = F.concat(F.lit(f"{seed}"), *[x for i in ids for x in (F.lit(":"), F.coalesce(F.col(i).cast("string"), F.lit("None")))])
    return [F.sha2(text, 256), *map(F.col, ids)]


def first_by_hash(rows: DataFrame, count: int, order: list[Column]) -> DataFrame:
    """The first count rows by order, whose first column is a hex digest, without bringing them all into one task.

    The rows of each four-digit prefix are counted, at most 65,536 numbers for the driver; whole prefixes are taken, and
    only the one in which the count is reached is sorted.
    """
    prefix = F.substring(order[0], 1, 4)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(prefix.alias("p")).agg(F.count("*")).collect())
    taken = 0
    for last, n in sizes:
        if taken + n >= count:
            return rows.where(prefix < last).union(rows.where(prefix == last).orderBy(*order).limit(count - taken))
        taken += n
    return rows


def held_out_pool(everything: DataFrame, *excluded: DataFrame, key: str = "task_id") -> DataFrame:
    """Distinct ids of everything that no excluded table holds; nulls there exclude nothing."""
    pool = everything.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    for other in excluded:
        pool = pool.join(other.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return pool


def sample(pool: DataFrame, size: int, seed: int, *, key: str = "task_id", order: str = "hash") -> DataFrame:
    """size ids of pool as ordinal, key; ValueError if size is below 1 or above what there is."""
    if size < 1:
        raise ValueError("size must be positive")
    available = pool.count()
    if size > available:
        raise ValueError("size exceeds the available ids")
    if order == "hash":
        # The manifest of the chosen ids, and nothing else, is numbered in one task.
        ordinal = F.row_number().over(Window.orderBy(*hash_order(seed, key))) - 1
        return first_by_hash(pool, size, hash_order(seed, key)).select(ordinal.alias("ordinal"), key)
    if available > MOST_SHUFFLED:
        raise ValueError(f"a shuffle takes at most {MOST_SHUFFLED} ids; use the hash order")
    ids = [r[0] for r in pool.orderBy(key).collect()]
    random.Random(int(seed)).shuffle(ids)
    return pool.sparkSession.createDataFrame(list(enumerate(ids[:size])), f"ordinal long, {key} long")


def length_bucket(steps: Column) -> Column:
    out = F.lit(schema.LENGTH_BUCKETS[-1][0])
    for name, most in reversed(schema.LENGTH_BUCKETS[:-1]):
        out = F.when(steps <= most, name).otherwise(out)
    return out


def first_probes(probes: DataFrame, candidates: DataFrame, key: str = "task_id", ordinal: str = "ordinal") -> DataFrame:
    """Of each candidate the first probe (ordinal, key, status, steps), and whether its status lets it count. Later ones never do."""
    known = probes.join(candidates.select(key).distinct(), key, "left_semi")
    first = known.groupBy(key).agg(F.min_by(F.struct(F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("steps", F.lit(0)).alias("steps")), ordinal).alias("p"))
    out = first.select(key, "p.status", F.col("p.steps").alias("probe_steps"))
    return out.withColumn("length_bucket", length_bucket(F.col("probe_steps"))).withColumn("eligible", F.col("status").isin(*schema.ELIGIBLE_STATUSES))


def stratified_sample(candidates: DataFrame, probes: DataFrame, targets: dict[str, int], seed: int, *, key: str = "task_id", order: str = "hash") -> tuple[DataFrame, dict]:
    """Exactly targets[bucket] tasks of each length bucket, and a report; a bucket that falls short raises ValueError.

    Probes are (ordinal, key, status, steps). The rows are ordinal, key, probe_steps, length_bucket in their final order.
    """
    names = [name for name, _ in schema.LENGTH_BUCKETS]
    targets = {name: int(targets.get(name, 0)) for name in names}
    if min(targets.values()) < 0 or not any(targets.values()):
        raise ValueError("targets must be counts of 0 or more, and not all 0")
    first = first_probes(probes, candidates, key).persist()
    counted = {(r["eligible"], r["length_bucket"] if r["eligible"] else r["status"]): r["n"] for r in first.groupBy("eligible", F.when(F.col("eligible"), F.col("length_bucket")).otherwise(F.col("status")).alias("what")).agg(F.count("*").alias("n")).select("eligible", F.col("what").alias("length_bucket"), F.col("what").alias("status"), "n").collect()}
    available = {name: counted.get((True, name), 0) for name in names}
    short = [f"{name}: missing {targets[name] - available[name]}" for name in sorted(names) if available[name] < targets[name]]
    if short:
        first.unpersist()
        raise ValueError("too few eligible tasks by length bucket: " + ", ".join(short))
    rows = first.where("eligible").select(key, "probe_steps", "length_bucket")
    if order == "hash":
        text = F.concat(F.lit(f"{seed}:"), "length_bucket", F.lit(":"), F.col(key).cast("string"))
        chosen = None
        for name in names:
            part = first_by_hash(rows.where(F.col("length_bucket") == name), targets[name], [F.sha2(text, 256), F.col(key)])
            chosen = part if chosen is None else chosen.union(part)
        last = hash_order(f"{seed}:final-order", key)
        chosen = chosen.withColumn("ordinal", F.row_number().over(Window.orderBy(*last)) - 1).select("ordinal", key, "probe_steps", "length_bucket")
    else:
        if sum(available.values()) > MOST_SHUFFLED:
            raise ValueError(f"a shuffle takes at most {MOST_SHUFFLED} ids; use the hash order")
        # Before its shuffle a bucket is in the order of the first probes.
        placed = rows.join(probes.groupBy(key).agg(F.min("ordinal").alias("at")), key).orderBy("at").collect()
        picked = []
        for name in names:
            some = [r for r in placed if r["length_bucket"] == name]
            random.Random(f"{seed}:{name}").shuffle(some)
            picked += some[: targets[name]]
        random.Random(f"{seed}:final-order").shuffle(picked)
        chosen = rows.sparkSession.createDataFrame([(i, r[key], r["probe_steps"], r["length_bucket"]) for i, r in enumerate(picked)], f"ordinal long, {key} long, probe_steps long, length_bucket string")
    report = {
        "candidate_task_count": candidates.select(key).distinct().count(),
        "probed_candidate_count": sum(counted.values()),
        "eligible_probe_count": sum(available.values()),
        "ignored_probe_status_counts": {s: n for (eligible, s), n in sorted(counted.items()) if not eligible},
        "bucket_targets": targets,
        "bucket_available": available,
        "selected_count": sum(targets.values()),
        "selected_by_bucket": {name: n for name, n in targets.items() if n},
    }
    return chosen, report


def frozen_prefix(parent: DataFrame, parent_name: str, size: int, parent_sha256: str, *, key: str = "task_id") -> tuple[DataFrame, dict]:
    """The first size rows of a manifest (ordinal, key) in its order, and where they come from; ids must not repeat in the whole of it."""
    total, distinct = parent.agg(F.count("*"), F.count_distinct(key)).first()
    if total != distinct:
        raise ValueError("the parent holds an id twice")
    if size < 1:
        raise ValueError("size must be positive")
    if size > total:
        raise ValueError("size exceeds the parent")
    about = {"parent_benchmark": parent_name, "parent_sha256": parent_sha256, "parent_task_count": total, "task_count": size, "selection": "ordered_prefix"}
    return parent.orderBy("ordinal").limit(size).select("ordinal", key), about


def group_split(rows: DataFrame, ratio: float = 0.05, seed: int = 42, *, key: str = "task_id") -> DataFrame:
    """rows with split, validation or train: whole groups, the first by the hash of seed and id, a null id being one group.

    The share of groups is rounded half to even, at least one and not all of them; with ratio 0 or one group all train.
    """
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be in [0, 1)")
    groups = rows.select(F.col(key).alias("_group")).distinct()
    count = groups.count()
    if not ratio or count < 2:
        return rows.withColumn("split", F.lit("train"))
    chosen = first_by_hash(groups, min(max(1, round(count * ratio)), count - 1), hash_order(seed, "_group")).withColumn("_chosen", F.lit(True))
    out = rows.join(chosen, F.col(key).eqNullSafe(F.col("_group")), "left")
    return out.withColumn("split", F.when(F.col("_chosen"), "validation").otherwise("train")).drop("_group", "_chosen")


def first_tasks(tasks: DataFrame, limit: int | None) -> DataFrame:
    return tasks.orderBy("ordinal").limit(limit) if limit is not None else tasks


def overlap(left: DataFrame, right: DataFrame, key: str = "task_id") -> DataFrame:
    """Ids in both; leak-free splits have none."""
    return left.select(key).intersect(right.select(key))
