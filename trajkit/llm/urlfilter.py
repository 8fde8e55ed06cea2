"""URL filter by sort-merge range joins of reversed-host keys with nested rules. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit.llm.common import durable, laid_out, running

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands between a host's key and the path. No host holds it.
BETWEEN = "/"


class Rule(NamedTuple):
    """A rule fits its host, all subdomains of it, and paths that start with path."""

    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What stands after the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels reversed, each closed by a dot: a host and its subdomains are the keys that start with the host's key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def host_stacks(rules: DataFrame) -> DataFrame:
    """rules (home) -> key, stack: for each host with rules the keys of the hosts with rules that enclose it, its own included."""
    own = rules.select(F.col("home").alias("key")).distinct()
    labels = F.split(F.col("key"), r"\.", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("."))))
    over = own.select("key", F.explode(above).alias("over")).distinct()
    return over.join(own.withColumnRenamed("key", "over"), "over").groupBy("key").agg(F.collect_set("over").alias("stack"))


def path_stacks(rules: DataFrame) -> DataFrame:
    """rules (home, path, rule, verdict) -> key, stack: for each key of host and path the rules of that host whose paths start it.

    Prefixes are tried at the lengths that the host's rules have. A stack is as high as rules are nested, however many there are.
    """
    lengths = durable(rules.groupBy("home").agg(F.collect_set(F.length("path")).alias("lengths")))
    key = F.concat("home", F.lit(BETWEEN), "path")
    tried = rules.select("home", "path").distinct().join(lengths, "home").select(key.alias("key"), "home", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"), "path")
    tried = tried.select("key", F.concat("home", F.lit(BETWEEN), F.expr("substring(path, 1, n)")).alias("over"))
    entries = rules.select(key.alias("over"), F.struct(key.alias("key"), "rule", (F.length("rule") - F.length("path")).alias("host_length"), "verdict").alias("entry"))
    return tried.join(entries, "over").groupBy("key").agg(F.collect_set("entry").alias("stack"))


def swept(rows: DataFrame, marks: DataFrame, rows_per_sweep: int) -> DataFrame:
    """rows (key, id, ...) with open: the stack of the last of marks (key, stack) at or before each key.

    Marks and rows are sorted together, and a sweep carries the stack of the last mark that it has passed. Marks are cut into
    ranges of at most rows_per_sweep, each with the mark before it, whose stack is open where the range begins; the rows of
    a range are dealt evenly into sweeps of about rows_per_sweep by a hash of their id, each with the range's marks. No key
    can make a sweep large, and marks at most double the rows. The driver sees one key and one count per range.
    """
    marks = durable(marks)
    cuts: list[str] = []
    if marks.count() > rows_per_sweep:
        placed = durable(running(laid_out(marks.withColumn("one", F.lit(1)), F.col("key")), "one", "nth").select("key", "stack", "nth"))
        cuts = sorted((r[0] for r in placed.where((F.col("nth") % rows_per_sweep == 0) & (F.col("nth") > 0)).select("key").collect()), key=lambda k: k.encode())
        marks = placed.withColumn("range", F.expr(f"cast(nth div {rows_per_sweep} as int)"))
        before = placed.where((F.col("nth") + 1) % rows_per_sweep == 0).withColumn("range", F.expr(f"cast((nth + 1) div {rows_per_sweep} as int)"))
        marks = marks.union(before).select("range", "key", "stack")
    else:
        marks = marks.select(F.lit(0).alias("range"), "key", "stack")
    within = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    rows = durable(rows.withColumn("range", within))
    held = {r[0]: r[1] for r in rows.groupBy("range").agg(F.count("*")).collect()}
    sweeps = F.array(*[F.lit(max(1, -(-held.get(i, 0) // rows_per_sweep))) for i in range(len(cuts) + 1)])
    number = F.element_at(sweeps, F.col("range") + 1)
    own = rows.select("range", F.pmod(F.xxhash64("id"), number).cast("int").alias("sweep"), "key", F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"), F.struct(*[f"`{c}`" for c in rows.columns if c not in ("range", "key")]).alias("row"))
    passed = marks.select("range", F.explode(F.sequence(F.lit(0), number - 1)).alias("sweep"), "key", F.lit(0).alias("kind"), "stack", F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("range", "sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.union(passed).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1").select("key", "row.*", "open")


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule] = RULES, *, page_id: str = "page_id", url: str = "url", default: str = "allow", rows_per_sweep: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; the longest rule that fits wins, else default holds.

    Reversed-host keys make a host the interval of the keys that start with its own, and within a host a path the interval of
    those that start with it. A first sweep over hosts finds, for each url, the hosts with rules that enclose its own; a
    second one looks up host and path under each of them. Any rule that holds a key encloses the last rule passed in sorted
    order, or is it, so the stack of that rule, less what does not start the key, is all that fits. See swept().

    Nulls and texts without :// have an empty host and path, which no rule with a host or path fits. Ties: of rules equally
    long the one with the longer host wins, then block before allow. Repeated rows are judged each for itself; other columns
    of pages, whatever their names, are not read; empty tables give empty results; an empty rule set gives default.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = durable(rules.select(host_key(F.col("host")).alias("home"), "path", F.concat("host", "path").alias("rule"), "verdict").distinct())
    urls = durable(pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("id", F.monotonically_increasing_id()))
    urls = urls.withColumn("key", F.when(F.col("host") == "", F.lit(".")).otherwise(host_key(F.col("host"))))
    enclosed = swept(urls, host_stacks(rules), rows_per_sweep).withColumn("over", F.explode_outer(F.filter("open", lambda h: F.startswith(F.col("key"), h))))
    looked = enclosed.select("id", "page_id", "host", "path", F.concat(F.coalesce("over", F.lit(".")), F.lit(BETWEEN), "path").alias("key"))
    found = swept(looked, path_stacks(rules), rows_per_sweep)
    fits = F.filter("open", lambda e: F.startswith(F.col("key"), e["key"]))
    rank = lambda e: F.struct(F.length(e["rule"]).alias("n"), e["host_length"].alias("h"), (e["verdict"] == "block").alias("b"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))
    best = found.select("id", "page_id", "host", "path", F.array_max(F.transform(fits, rank)).alias("best")).groupBy("id").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
