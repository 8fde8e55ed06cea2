"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit.llm.common import WORD, durable, fresh_names, laid_out, running

#: Slots map to points k * STEP mod 2^31, the golden-ratio sequence in whole numbers: 1327217885 is odd and next to 2^31 / 1.618.
POINTS, STEP = 1 << 31, 1327217885


@dataclass
class Mix:
    """documents: one row per document; schedule: one row per slot; sources: one row per source."""

    documents: DataFrame
    schedule: DataFrame
    sources: DataFrame


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (source, size) -> sources laid out by code point, null last: src, weight, source_size, n_blocks' base and target.

    A target stops at most * source_size; what is over goes to the others by weight, round by round until none is above.
    A round is one aggregate over the sources; the driver sees two sums of it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(laid_out(per.withColumn("one", F.lit(1)), F.col("source").asc_nulls_last()), "one", "src").drop("one")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)
    stopped = -1
    while True:
        row = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if row[2] == stopped or not row[1]:
            break
        level, stopped = (total - row[0]) / row[1], row[2]
        full = F.col("cap") < level * F.col("weight")
    return per.withColumn("target", F.when(full, F.col("cap")).otherwise(level * F.col("weight")))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_tokens: int = 256, seed: int = 0) -> Mix:
    """Plan a mix of docs in which each source supplies its target of words.

    A source's documents, shuffled by a seeded hash, form one line of words, cut into blocks of block_tokens. Its target needs
    a number of blocks, the line starting anew when it is used up. Slot k of the schedule is the golden-ratio point of k,
    mapped through the cumulative numbers of blocks to a source; its rank among the slots of that source names the block it
    takes. There are as many slots as blocks are needed, and golden-ratio points give each source its number but for a few:
    slots over are left out, slots lacking stand at the end, and the last slot takes only the words that are still missing.
    most bounds how often a word is repeated.

    documents has doc_id, source, size, source_size, target, taken, and of the slots that take words of the document
    first_slot (-1 without one) and n_slots.

    Nulls: a null text has size 0, a null source is a source of its own (the last), a null id is shuffled as an empty one.
    Empty texts have size 0 and take 0. Ties in the shuffle are broken by id and size; rows that agree in these count each
    for itself. Very long texts span many blocks. An empty table gives empty results. Other columns are not read.

    No step sees a whole source: documents and slots are ranked in small even chunks plus the sums per chunk before them.
    """
    sized = durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    sources = durable(source_targets(sized, weights, share, most).drop("_at", "_part"))
    n_docs = sized.count()
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_tokens)).withColumn("words", F.round("target").cast("long"))
    need = F.expr(f"(words div source_size) * n_blocks + ceil((words % source_size) / {block_tokens})")
    sources = durable(sources.withColumn("need", F.when(F.col("source_size") > 0, need).otherwise(0).cast("long")))

    # Documents on their source's line of words.
    chunks = max(16, min(1 << 16, n_docs >> 11))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    placed = sized.where("size > 0").join(sources.select("source", "src"), sized["source"].eqNullSafe(sources["source"])).select("doc_id", "src", "size", key.alias("key"))
    placed = placed.withColumn("chunk", F.shiftright(F.shiftright("key", 28) * chunks, 32))
    inside = Window.partitionBy("chunk", "src").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("chunk", "src").agg(F.sum("size").alias("sum"))
    sums = sums.select("chunk", "src", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    placed = placed.repartition("chunk").withColumn("start", F.sum("size").over(inside) - F.col("size")).join(sums, ["chunk", "src"])
    placed = placed.select("doc_id", "src", "size", (F.col("start") + F.col("before")).alias("start"))

    schedule = durable(_schedule(sources, block_tokens))

    first, last = F.expr(f"start div {block_tokens}"), F.expr(f"(start + size - 1) div {block_tokens}")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("start"), F.col("block") * block_tokens), F.col("start") + F.col("size")
    used = schedule.select("src", "block", "slot", F.col("words").alias("used"))
    met = F.greatest(F.lit(0), F.least(high, F.col("block") * block_tokens + F.coalesce("used", F.lit(0))) - low)
    taken = pieces.join(used, ["src", "block"], "left").select("src", "start", "doc_id", "size", met.alias("met"), "slot")
    taken = taken.groupBy("src", "start", "doc_id", "size").agg(F.sum("met").alias("taken"), F.coalesce(F.min(F.when(F.col("met") > 0, F.col("slot"))), F.lit(-1)).alias("first_slot"), F.count_if(F.col("met") > 0).alias("n_slots"))
    out = taken.join(sources.select("src", "source", "source_size", "target"), "src").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")
    none = sized.where("size = 0").alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    none = none.select("doc_id", "s.source", "size", "source_size", "target", *[F.lit(x).cast("long").alias(c) for c, x in (("taken", 0), ("first_slot", -1), ("n_slots", 0))])
    return Mix(out.union(none), schedule, sources)


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots in order: slot, src, rank, block, words (how many of the block's words the slot takes)."""
    spark = sources.sparkSession
    table = running(laid_out(sources.where("need > 0"), F.col("src")), "need", "at")
    n_slots, n_sources = (x or 0 for x in table.agg(F.sum("need"), F.count("*")).first())
    # Each source holds an interval of points; cells of points make the lookup an equality join with about one source a cell.
    bits = min(24, max(6, (16 * n_sources).bit_length()))
    point = lambda c: F.expr(f"cast(cast({c} as decimal(20, 0)) * {POINTS}L div {max(n_slots, 1)}L as bigint)")
    table = durable(table.select("src", "source_size", "n_blocks", "need", "words", point("at").alias("low"), point("at + need").alias("high")))
    cells = table.where("high > low").withColumn("cell", F.explode(F.sequence(F.shiftright("low", 31 - bits), F.shiftright(F.col("high") - 1, 31 - bits))))
    length = max(1024, -(-n_slots >> 16))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", 31 - bits)).join(cells.select("cell", "src", "low", "high"), "cell").where("point >= low and point < high")
    slots = slots.select("slot", "src", F.expr(f"slot div {length}").alias("chunk"))
    per = slots.groupBy("chunk", "src").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("chunk", "src", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    ranked = slots.repartition("chunk").withColumn("i", F.row_number().over(Window.partitionBy("chunk", "src").orderBy("slot")) - 1)
    ranked = ranked.join(per.drop("n"), ["chunk", "src"]).select("slot", "src", (F.col("i") + F.col("before")).alias("rank"))
    # The few blocks that the points leave short come at the end.
    had = per.groupBy("src").agg(F.sum("n").alias("had"))
    short = table.join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("need > had")
    short = short.select((F.col("src") + n_slots).alias("slot"), "src", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    line = table.select("src", "source_size", "n_blocks", F.col("words").alias("goal"))
    out = ranked.union(short).join(line, "src")
    reach = lambda r: F.expr(f"(({r}) div n_blocks) * source_size + (({r}) % n_blocks) * {block}")
    out = out.withColumn("words", F.least(F.col("goal"), reach("rank + 1")) - reach("rank")).where("words > 0")
    return out.select("slot", "src", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), "words")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, whole, with the columns of docs: each as often as its taken words fill it, rounded.

    A document none of whose words, or less than half of them, are taken is out; at most `most` copies of one come.
    Rows that agree in id, source and size share what they take evenly. Keys, nulls and empty texts: see mix_sources().
    """
    names = {k: f"`{parameters.get(k, k)}`" for k in ("doc_id", "source", "text")}
    key, group, words, number, times = fresh_names(docs.columns, "key", "group", "words", "number", "times")
    plan = mix_sources(docs, **parameters).documents
    per = plan.where("taken > 0").groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.count("*") / F.first("size")).alias("share"))
    per = per.select(F.col("doc_id").alias(key), F.col("source").alias(group), F.col("size").alias(number), F.floor(F.col("share") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    rows = docs.withColumn(words, word_count(F.col(names["text"])))
    same = F.col(names["doc_id"]).eqNullSafe(F.col(key)) & F.col(names["source"]).eqNullSafe(F.col(group)) & (F.col(words) == F.col(number))
    out = rows.join(per, same).withColumn(key, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[f"`{c}`" for c in docs.columns])
