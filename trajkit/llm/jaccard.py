"""N-gram Jaccard join: pivots, Voronoi cells, triangle-inequality windows, regions joined recursively and exactly.

Jaccard distance, 1 - |x & y| / |x | y|, is a metric, and a pair links if its distance is at most r. Texts that share no
shingle are at distance 1, so pivots are sought where distances are below 1: a list holds the documents that have one shingle
among the few of lowest order, their prefix, of which a linked pair must share one. Each list elects a pivot, its least
document, and distances to it are computed exactly. A document goes to the Voronoi cell of the nearest pivot within r; lists
with many documents that are in no cell yet elect again, level by level. What is within r of no pivot is a cell of its own.

A pair that links and lies in two cells has one member x that is near the other cell's pivot q: with y in the cell, d(x, q) is
at most d(x, y) + d(y, q), r more than the cell's radius. So each document is measured against the pivots of the other cells
in its lists, and where the window allows, the boundary document is replicated into q's region. There it is compared with the
cell's documents y for which d(x, q) - d(y, q) is at most r. Cells of one component are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajkit.llm.common import WORD, discard, durable, fresh_names, lean, linked_components, row_slices, tidy
from trajkit.llm.shingles import set_key, shingle_sets


#: A sketch holds, for each of so many bins, whether an odd number of a set's hashes falls into it, as longs. An element that
#: only one of two sets has changes one bin: sketches differ in no more bins than the sets in elements. Halves of a sketch
#: laid over each other are a sketch of half as many bins.
LONGS = 16


def prefix_length(n: int, percent: int) -> int:
    """How many shingles of lowest order of a set of n hold at least one shared with any set of that similarity."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def sketch(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differing(left: str, right: str, longs: int) -> Column:
    """Bins in which the sketches with columns left0, left1, ... and right0, ... differ."""
    out = F.lit(0)
    for i in range(longs):
        out = out + F.bit_count(F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}")))
    return out


def _within(differing: Column, n: Column, m: Column, reach: Column) -> Column:
    """Whether sets of n and m elements, of which only one has at least `differing`, can be at distance reach or less."""
    return 2 * differing <= reach * (n + m + differing) + 1e-6


def common_shingles(docs: DataFrame, text: str, k: int, percent: int, least: int, most: int) -> np.ndarray:
    """Hashes of shingles that stand in the prefixes of `least` documents or more, the most frequent `most` of them.

    They come last in the order of shingles, so that passages that many documents share found no region where a rarer
    shingle can. The order, and so `most`, changes the work and not the result. Prefixes are counted over all documents.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch.column(0)):
                found = [f[: prefix_length(len(f), percent)] for f in shingle_sets(batch.column(0).slice(a, b - a).to_pylist(), k)]
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *found]).astype(np.int64))})
            tidy()

    often = docs.select(F.col(text)).mapInArrow(prefixes, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "h").limit(most)
    return np.sort(np.array([r[0] for r in often.select("h").collect()], dtype=np.int64).astype(np.uint64))


def _described(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, common: np.ndarray) -> DataFrame:
    def described(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        sizes, first, second, prefixes, sketches = [], [], [], [], []
        for found in shingle_sets(texts, k):
            at = np.searchsorted(common, found)
            late = common[np.minimum(at, len(common) - 1)] == found if len(common) else np.zeros(len(found), dtype=bool)
            a, b = set_key(found)
            sizes.append(len(found)), first.append(a), second.append(b), sketches.append(sketch(found))
            prefixes.append(np.concatenate([found[~late], found[late]])[: prefix_length(len(found), percent)].astype(np.int64))
        flat = lambda parts, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
        columns = [ids.cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, first, second)), flat(sketches, np.arange(len(sizes) + 1) * LONGS), flat(prefixes, np.cumsum([0, *map(len, prefixes)]))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key1", "key2", "sketch", "prefix"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                yield described(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist())
            tidy()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(describe, "doc_id bigint, n bigint, key1 bigint, key2 bigint, sketch array<bigint>, prefix array<bigint>")


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b, reach) that their sketches allow to be at distance reach or less."""
    left, right = (sketches.select(F.col("node").alias(node), F.col("n").alias(f"n{x}"), *[F.col("sketch")[i].alias(f"{x}{i}") for i in range(LONGS)]) for node, x in (("a", "x"), ("b", "y")))
    return pairs.join(right, "b").join(left, "a").where(_within(_differing("x", "y", LONGS), F.col("nx"), F.col("ny"), F.col("reach"))).select("a", "b")


def _whole_sets(docs: DataFrame, doc_id: str, text: str, k: int, nodes: DataFrame, broadcast_rows: int) -> DataFrame:
    """The sets of the documents that nodes names, as bytes of sorted hashes."""
    wanted = nodes.select(F.col("node").alias("_node"))
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)  # at most broadcast_rows longs
    some = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).join(wanted, F.col("node") == F.col("_node"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                found = [s.tobytes() for s in shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], names=["node", "hashes"])
            tidy()

    return some.mapInArrow(sets, "node bigint, hashes binary")


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> (a, b, linked, distance), from their whole sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, united = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(many, few)
                both = int((many[np.minimum(at, len(many) - 1)] == few).sum()) if len(many) else 0
                shared.append(both), united.append(max(1, len(x) + len(y) - both))
            shared, united = np.array(shared, dtype=np.int64), np.array(united, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(100 * shared >= percent * united), pa.array(1 - shared / united, pa.float64())], names=["a", "b", "linked", "distance"])
            tidy()

    return rows.mapInArrow(measure, "a bigint, b bigint, linked boolean, distance double")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, levels: int = 3, region_rows: int = 64, order_least: int = 12, order_most: int = 1 << 18, broadcast_rows: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two texts link when 100 * shared >= percent * united shingles.

    component_id is the smallest doc_id that links reach, the row's own included. Texts of equal shingle sets are one class,
    and only its least document is compared; links inside what is already connected are not looked for, so a group of copies
    gives links along stars and never all its pairs. Lists of more than region_rows documents without a cell elect pivots up
    to `levels` times; both change the work and not the result.

    Nulls: a null text and one without words have no shingles and link with nothing; rows with a null id get a null
    component_id unless an equal text has an id. Texts of fewer than k words are one shingle. Repeated rows are one class;
    rows that share an id but not a text count as linked if one of them is. A pair of exactly the threshold links. Very
    long texts are hashed in parts. An empty table stays empty; other columns are not read.
    """
    common = common_shingles(lean(docs), text, k, percent, order_least, order_most)
    every = durable(_described(docs, doc_id, text, k, percent, common))
    known = every.where("n > 0 and doc_id is not null")
    sketches = known.select(F.col("doc_id").alias("node"), "n", "key1", "key2", "sketch")
    # Where a row repeats, each of its sets must be joined once.
    repeats = known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count() > 0
    if repeats:
        sketches = durable(sketches.dropDuplicates(["node", "key1", "key2"]))
    classes = every.where("n > 0").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"))
    rows = classes.where("node is not null").select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "region"))
    # Lists of two or more: first by their hashes alone, then with what lies in them.
    shared = rows.groupBy("region").agg(F.count("*").alias("size")).where("size > 1").select("region")
    lists = durable(rows.join(shared, "region"))

    link = (100 - percent) / 100
    near = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    # In the list of the first shingle they share, two documents have at most what is left of either in common.
    reach = lambda n, at, m, to: (100 + percent) * F.least(n - at, m - to) >= percent * (n + m)
    measured: list[DataFrame] = []

    def links() -> DataFrame:
        return reduce(DataFrame.union, [m.where("linked").select("a", "b") for m in measured])

    def measure(pairs: DataFrame) -> None:
        """Add to measured the exact distances of the distinct pairs (a, b, reach), a < b, that may be at distance reach or less."""
        for m in measured:
            pairs = pairs.join(m.select("a", "b"), ["a", "b"], "left_anti")
        pairs = _possible(pairs, sketches)
        pairs = durable(pairs.distinct() if repeats else pairs)
        sets = _whole_sets(docs, doc_id, text, k, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), broadcast_rows)
        sets = durable(sets.dropDuplicates() if repeats else sets)
        out = _measured(pairs, sets, percent)
        if repeats:
            out = out.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("distance").alias("distance"))
        measured.append(durable(out))
        discard(pairs, sets)

    # Pivots, and the cells of what is within link of them.
    rest, found, made = lists, None, []
    for level in range(levels):
        pivots = durable(rest.groupBy("region").agg(F.min(F.struct("node", "n", "at")).alias("p"), F.count("*").alias("size")).where("size > 1"))
        made.append(pivots)
        if level and (pivots.agg(F.max("size")).first()[0] or 0) <= region_rows:
            break
        held = rest.join(pivots.select("region", "p"), "region").where(F.col("node") != F.col("p.node"))
        pairs = held.where(near(F.col("n"), F.col("p.n")) & reach(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at"))).select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
        measure(pairs.withColumn("reach", F.lit(link)))
        found = durable(linked_components(links()))
        made.append(found)
        if level + 1 < levels:
            own = found.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_label"))
            left = _labelled(held.withColumn("pivot", F.col("p.node")), found).join(own, "pivot", "left").where(F.col("label") != F.coalesce("pivot_label", "pivot"))
            rest = durable(left.select("region", "node", "n", "at"))
            made.append(rest)
    near_pivots = reduce(DataFrame.union, [m.where("linked").select(F.col("b").alias("node"), F.struct("distance", F.col("a").alias("pivot")).alias("p")) for m in measured])
    homes = durable(near_pivots.groupBy("node").agg(F.min("p").alias("p")).select("node", F.col("p.pivot").alias("cell"), F.col("p.distance").alias("away")))

    # Each document against the pivots of the other cells in its lists, from the greater cell to the lesser.
    placed = _labelled(lists, found).join(homes, "node", "left").select("region", "node", "n", "at", "label", F.coalesce("cell", "node").alias("cell"), F.coalesce("away", F.lit(0.0)).alias("away"))
    several = placed.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("region")
    placed = durable(placed.join(durable(several), "region"))
    half = sketches.select("node", F.col("n").cast("int").alias("size"), *[F.col("sketch")[i].bitwiseXOR(F.col("sketch")[i + LONGS // 2]).alias(f"s{i}") for i in range(LONGS // 2)])
    words = [f"s{i}" for i in range(LONGS // 2)]
    cells = placed.groupBy("region", "cell").agg(F.max("away").alias("radius"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("left"), F.min("label").alias("label"))
    cells = durable(cells.join(half.withColumnRenamed("node", "cell"), "cell").select("region", *[F.col(c).alias(f"{c}_q") for c in ("cell", "radius", "fewest", "most", "left", "label", "size")], *[F.col(c).alias(f"q{i}") for i, c in enumerate(words)]))
    those = durable(placed.join(half.drop("size"), "node").select("region", "node", "n", "at", "label", "cell", *[F.col(c).alias(f"x{i}") for i, c in enumerate(words)]))
    fits = (100 * F.col("n") >= percent * F.col("fewest_q")) & (100 * F.col("most_q") >= percent * F.col("n")) & ((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("left_q")) >= percent * (F.col("n") + F.col("fewest_q")))
    fits = fits & _within(_differing("x", "q", LONGS // 2), F.col("n"), F.col("size_q"), link + F.col("radius_q"))
    both = those.join(cells, (those["region"] == cells["region"]) & (F.col("cell") > F.col("cell_q")) & (F.col("label") != F.col("label_q")) & fits)
    pairs = durable(both.groupBy(F.col("cell_q").alias("a"), F.col("node").alias("b")).agg(F.max(link + F.col("radius_q")).alias("reach")))
    measure(pairs)
    found = durable(linked_components(links()))

    # The regions: a cell and the boundary documents that the window lets in, those already connected left out.
    distances = reduce(DataFrame.union, [m.where("not linked").select("a", "b", "distance") for m in measured])
    boundary = pairs.where(F.col("reach") > link).join(distances, ["a", "b"]).where(F.col("distance") <= F.col("reach") + 1e-9).select(F.col("a").alias("cell"), F.col("b").alias("node"), "distance")
    boundary = _labelled(boundary, found).join(_labelled(boundary.select(F.col("cell").alias("node")).distinct(), found).select(F.col("node").alias("cell"), F.col("label").alias("label_q")), "cell").where("label != label_q")
    ends = lambda x: [F.col("size").alias(f"n_{x}"), *[F.col(c).alias(f"{x}{i}") for i, c in enumerate(words)]]
    boundary = durable(boundary.join(half, "node").select("cell", F.col("node").alias("x"), "distance", *ends("x")))
    inside = homes.join(boundary.select("cell").distinct(), "cell", "left_semi").join(half, "node").select("cell", F.col("node").alias("y"), "away", *ends("y"))
    met = boundary.join(durable(inside), "cell").where((F.col("distance") - F.col("away") <= link + 1e-9) & near(F.col("n_x"), F.col("n_y")) & _within(_differing("x", "y", LONGS // 2), F.col("n_x"), F.col("n_y"), F.lit(link)))
    measure(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("reach", F.lit(link)))
    found = durable(linked_components(links()))
    discard(lists, placed, cells, those, pairs, homes, boundary, *made, *measured)

    group = every.where("n > 0").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("node"))
    # Durable, so that both sides of the join are dealt out anew and a class of many copies can be split.
    group = durable(group.join(found, "node", "left").select("key1", "key2", "n", F.coalesce("component", "node").alias("component_id")))
    some = every.where("n > 0").select("doc_id", "key1", "key2", "n").join(group, ["key1", "key2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(every.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def keep_representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of docs, with its columns, that stand for their component: the one with the smallest id.

    Where rows with shingles share that id they are of one group, and one of them stays, of the text with the least hash.
    Rows without shingles and rows with a null id all stay. Columns of any name are kept.
    """
    found = jaccard_components(docs, doc_id=doc_id, text=text, **parameters)
    gone, same, least = fresh_names(docs.columns, "gone", "same", "least")
    columns = [f"`{c}`" for c in docs.columns]
    away = found.where("component_id is not null and doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(away, F.col(f"`{doc_id}`").cast("long") == F.col(gone), "left_anti")
    twice = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(same))
    if not twice.limit(1).count():
        return kept
    among = F.col(f"`{doc_id}`").cast("long") == F.col(same)
    worded = F.coalesce(F.rlike(F.col(f"`{text}`"), F.lit(WORD)), F.lit(False))
    often = kept.where(worded).join(twice, among, "left_semi").withColumn(least, F.xxhash64(F.col(f"`{text}`")))
    chosen = often.groupBy(F.col(f"`{doc_id}`").cast("long").alias(same)).agg(F.min(least).alias(gone))
    often = often.join(chosen, among & (F.col(least) == F.col(gone))).dropDuplicates([same]).select(*columns)
    return kept.where(~worded).union(kept.where(worded).join(twice, (F.col(f"`{doc_id}`").cast("long") == F.col(same)), "left_anti")).union(often)
