"""What the operators share: table reads, durable intermediate tables, running totals, linked components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajkit.shipping import ship_code
from trajkit.sources.scratch import delete_at_end, own_folder

#: A word: what stands between the ASCII white-space characters. A fixed value.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one batch between Spark and a Python worker.
ARROW_BYTES = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """df, in a session whose Python workers have this package, and whose Arrow batches hold at most ARROW_BYTES.

    Workers that meet long texts then stay small. The size of batches is a setting of the session and stays set; one that the
    caller has chosen is left as it is.
    """
    ship_code(df.sparkSession)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == f"{64 << 20}b":  # the default, so that nobody has set it
        df.sparkSession.conf.set(name, str(ARROW_BYTES))
    return df


def row_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a text column with about `most` bytes each: only these become Python objects at once."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop
        start = stop


def tidy() -> None:
    """Give memory that a Python worker has freed back to the system; both allocators keep it otherwise, next to the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear(spark: SparkSession) -> None:
    """Delete all durable tables of this application. Results that were built on them can't be read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_names(columns: Iterable[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as keep it apart from columns; Spark compares names without case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there, whatever executors are lost."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._trajkit_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_trajkit_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def laid_out(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted and made durable, with _part and _at: the range partition of a row and its place there.

    A sort in ranges and no single task; running() and ranks build on it.
    """
    at = F.monotonically_increasing_id()
    return durable(df.sort(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))


def running(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add to a laid_out() table the sum of value over the rows before, in its order.

    Inside a partition by a window; across partitions by the sums per partition, one row for each.
    """
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    df = df.withColumn("_in", F.sum(value).over(inside) - F.col(value))
    df = df.join(sums, df["_part"] == sums["_p"])
    return df.withColumn(name, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step. Large: neighbours above a node go to its least neighbour; small: those below and the node itself do.

    The least neighbour comes from an aggregate with a partial step and a join that the engine splits where a node is hot;
    no task gets all neighbours of a node.
    """
    if small:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = near.join(least, "u")
    if small:
        out = out.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    else:
        out = out.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where("a < b").distinct()


def linked_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, any direction, loops and repeats allowed -> (node, component) for every node with a link.

    component is the least node that links reach. Alternates large-star and small-star steps until the edges are stars
    around their least node; each round is durable, and the number of rounds follows the logarithm of a component's size.
    """
    now = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        after = durable(_star(_star(now, small=False), small=True))
        was, seen = seen, mark(after)
        discard(now)
        now = after
        if seen == was:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())
