"""JSON-lines scans and sinks, manifests, file hashes and batch layouts. Order matters: every scan gives an ordinal."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajkit import schema
from trajkit.functions import values as v

#: Names of the files of one collection batch.
BATCH_FILES = {"raw": "raw.jsonl", "accepted": "accepted.jsonl", "rejected": "rejected.jsonl", "stats": "reject_stats.json", "sft": "sft.jsonl"}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, raw_json of each line that isn't blank; gzip by suffix. Lines end at newlines only, never inside a text.

    ordinal orders lines by file, place of the split in it, and place in the split; it has gaps and is stable for given files.
    """
    lines = spark.read.option("lineSep", "\n").text(str(path)).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("value").alias("raw_json"), F.monotonically_increasing_id().alias("m"))
    return lines.select(F.struct("f", "b", "m").alias("ordinal"), F.regexp_replace("raw_json", "\r$", "").alias("raw_json")).where(F.rlike("raw_json", F.lit(r"\S")))


def read_jsonl(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Strict scan: ordinal, raw_json and the parsed VARIANT; a line that is no JSON fails the query."""
    schema.configure(spark)
    bad = F.raise_error(F.concat(F.lit("line is not JSON: "), F.substring("raw_json", 1, 200))).cast("variant")
    return _lines(spark, path).withColumn(name, F.coalesce(v.parsed(F.col("raw_json")), bad))


def read_jsonl_lenient(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Lenient scan: the VARIANT is NULL for a line that is no JSON."""
    schema.configure(spark)
    return _lines(spark, path).withColumn(name, v.parsed(F.col("raw_json")))


def read_jsonl_optional(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Strict scan that gives no rows for a missing file."""
    if exists(spark, path):
        return read_jsonl(spark, path, name)
    return spark.createDataFrame([], f"ordinal struct<f:string,b:bigint,m:bigint>, raw_json string, {name} variant")


def resolved_task_id(row: Column) -> Column:
    """task_id, or where a row lacks it extra_info's, or that of its interaction arguments."""
    return F.coalesce(*[v.get(row, p, "long") for p in ("task_id", "extra_info.task_id", "extra_info.interaction_kwargs.task_id")])


def required_id(value: Column, message: str = "row is missing task_id") -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message)).cast("long"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, task_id, task; a row without any task id fails the query."""
    return read_jsonl(spark, path, "task").select("ordinal", required_id(resolved_task_id(F.col("task"))).alias("task_id"), "task")


def read_task_ids(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, task_id of rows that must have it themselves; repeats stay."""
    return read_jsonl(spark, path).select("ordinal", required_id(v.get(F.col("value"), "task_id", "long")).alias("task_id"))


def read_completed_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (task_id, attempt_index) of a raw log; broken lines and rows without a task count for nothing, a missing attempt is 0."""
    if not exists(spark, path):
        return spark.createDataFrame([], "task_id long, attempt_index long")
    rows = read_jsonl_lenient(spark, path)
    out = rows.select(v.get(F.col("value"), "task_id", "long").alias("task_id"), F.coalesce(v.get(F.col("value"), "attempt_index", "long"), F.lit(0)).alias("attempt_index"))
    return out.where("task_id is not null").distinct()


def corrupt_lines(spark: SparkSession, path: str) -> int:
    return read_jsonl_lenient(spark, path).where("value is null").count()


def write_jsonl(rows: DataFrame, path: str, *, line: str = "raw_json", ordinal: str | None = "ordinal", mode: str = "overwrite", compression: str = "none") -> None:
    """Write JSON texts as lines into the folder path, in the order of ordinal: part files sort by name as their rows do."""
    ordered = rows.orderBy(ordinal) if ordinal else rows
    ordered.select(F.col(line).alias("value")).write.mode(mode).option("lineSep", "\n").option("compression", compression).text(str(path))


def append_jsonl(rows: DataFrame, path: str, line: str = "raw_json") -> None:
    write_jsonl(rows, path, line=line, ordinal=None, mode="append")


def write_task_ids(spark: SparkSession, count: int, path: str, force: bool = False) -> None:
    """The ids 0 to count - 1 as a manifest; an existing one stays unless force."""
    if count < 0:
        raise ValueError("count must not be negative")
    if exists(spark, path) and not force:
        raise FileExistsError(path)
    write_jsonl(spark.range(count).select(F.col("id").alias("ordinal"), F.to_json(F.struct(F.col("id").alias("task_id"))).alias("raw_json")), path)


def _at(spark: SparkSession, path: str):
    """(file system, path) of a file or folder, wherever Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A small JSON file beside the data, written by the driver through the file system that Spark uses."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray((json.dumps(summary, ensure_ascii=False, indent=2) + "\n").encode("utf-8")))
    finally:
        out.close()


def read_summary(spark: SparkSession, path: str) -> dict:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def sha256_path(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, or of a folder's data files one after the other by name: of the manifest that they make up."""
    fs, at = _at(spark, path)
    files = [at] if not fs.getFileStatus(at).isDirectory() else sorted((s.getPath() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
    digest = spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
    for file in files:
        stream = spark._jvm.java.security.DigestInputStream(fs.open(file), digest)
        try:
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, spark._jvm.java.io.OutputStream.nullOutputStream())
        finally:
            stream.close()
    return digest.digest().hex()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below path, computed where the files are read; for files of up to 2 GB."""
    return spark.read.format("binaryFile").load(str(path)).select("path", F.sha2("content", 256).alias("sha256"))


def batch_paths(folder: str) -> dict[str, str]:
    return {k: f"{str(folder).rstrip('/')}/{name}" for k, name in BATCH_FILES.items()}
