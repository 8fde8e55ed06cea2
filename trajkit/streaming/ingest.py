"""The append log as a stream: new files are read once, and each attempt of a task counts once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajkit import schema
from trajkit.functions import values as v
from trajkit.shipping import ship_code


def stream_trajectories(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """raw_json and the parsed trajectory of each line of the files that arrive in folder; broken lines are NULL."""
    schema.configure(spark)
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).select(F.col("value").alias("raw_json"), v.parsed(F.col("value")).alias("trajectory"))


def first_attempts(stream: DataFrame) -> DataFrame:
    """Each (task_id, attempt_index) once; a missing attempt is 0, rows without a task are left out.

    A log may repeat an attempt however late, so its key is never forgotten: the state grows with the number of attempts, two
    longs each. A log that is known to repeat within some time only should come with a watermark instead.
    """
    t = F.col("trajectory")
    rows = stream.withColumn("task_id", v.get(t, "task_id", "long")).withColumn("attempt_index", F.coalesce(v.get(t, "attempt_index", "long"), F.lit(0)))
    return rows.where("task_id is not null").dropDuplicates(["task_id", "attempt_index"])


def append_log(stream: DataFrame, path: str, checkpoint: str, halt: Callable[[DataFrame], bool] | None = None) -> StreamingQuery:
    """Append the raw lines to path, a folder for each batch so that a batch that is run again replaces its own.

    After a batch is written, halt may look at it; the query stops with an error where it returns True.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("raw_json").alias("value")).write.mode("overwrite").text(f"{path}/batch={number:010d}")
        if halt and halt(batch):
            raise RuntimeError(f"batch {number} asks to halt")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streak_events(events: DataFrame, limit: int = schema.BLOCKED_STREAK_LIMIT) -> DataFrame:
    """A stream of (task_id, step_index, blocked) -> the same with streak and over, kept per task across batches.

    State is one number per task. Events of a batch are taken by step_index; events must not arrive after later ones.
    """

    ship_code(events.sparkSession)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("step_index")
        streaks = []
        for blocked in rows["blocked"]:
            streak = streak + 1 if blocked else 0
            streaks.append(streak)
        state.update((streak,))
        yield rows.assign(streak=streaks, over=[s >= limit for s in streaks])[["task_id", "step_index", "blocked", "streak", "over"]]

    return events.groupBy("task_id").applyInPandasWithState(advance, "task_id long, step_index long, blocked boolean, streak long, over boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def latest_observations(events: DataFrame) -> DataFrame:
    """A stream of (task_id, step_index, observation) -> the same with seen, what the step before it in its task had observed.

    observation is null for what shows no page, such as a blocked call: then the page seen before stays. State is one text
    per task, "" at first. Events of a batch are taken by step_index; events must not arrive after later ones.
    """

    ship_code(events.sparkSession)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page = state.get[0] if state.exists else ""
        rows = pd.concat(list(parts)).sort_values("step_index")
        seen = []
        for shown in rows["observation"]:
            seen.append(page)
            page = page if shown is None else shown
        state.update((page,))
        yield rows.assign(seen=seen)[["task_id", "step_index", "observation", "seen"]]

    return events.groupBy("task_id").applyInPandasWithState(advance, "task_id long, step_index long, observation string, seen string", "page string", "append", GroupStateTimeout.NoTimeout)
