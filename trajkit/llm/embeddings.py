"""Embedding near-duplicates by int8 tile products with rigorous error bounds; only possible pairs are recomputed in full precision.

Vectors travel as int8 codes. A first code's tile products leave the pairs that may reach the threshold; a second code of what
the first leaves out settles nearly all of these; the few that lie within its bound of the threshold, about 10^-4, are
recomputed from the vectors themselves. Angles are a metric: tiles gather vectors around the nearest of some pivots, and two
tiles whose angles to any pivot differ by more than the threshold's angle never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajkit.llm.common import discard, durable, lean, linked_components

#: Sums of so many products of two codes of at most 127 stay below 2^24 and are exact in single precision.
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)
#: Components of the vectors of one tile, about.
TILE_COMPONENTS = 1 << 18


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring the greatest component near 1: exact, and no square gets too large or too small."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two scaled() matrices, in double precision."""
    return (left * right).sum(axis=1) / np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors -> int8 codes, a scale per vector, and the exact length of what the codes leave out (an upper bound)."""
    scale = np.maximum(np.abs(vectors).max(axis=1) / 127, 1e-300)
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    rest = vectors - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def code_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of int8 codes, exact in whole numbers, by single-precision products of up to EXACT_DIMENSIONS at a time."""
    if left.shape[1] <= EXACT_DIMENSIONS:
        return left.astype(np.float32) @ right.astype(np.float32).T
    out = np.zeros((len(left), len(right)))
    for d in range(0, left.shape[1], EXACT_DIMENSIONS):
        out += left[:, d : d + EXACT_DIMENSIONS].astype(np.float32) @ right[:, d : d + EXACT_DIMENSIONS].astype(np.float32).T
    return out


class Tile:
    """Vectors of length 1 as two int8 codes: x = code * scale + code2 * scale2 + rest; error and error2 bound what each leaves out."""

    def __init__(self, code: np.ndarray, scale: np.ndarray, error: np.ndarray, code2: np.ndarray, scale2: np.ndarray, error2: np.ndarray):
        self.code, self.scale, self.error, self.code2, self.scale2, self.error2 = code, scale, error, code2, scale2, error2

    @classmethod
    def of(cls, vectors: np.ndarray) -> Tile:
        held = scaled(vectors)
        unit = held / np.sqrt((held * held).sum(axis=1, keepdims=True))
        code, scale, error = quantised(unit)
        code2, scale2, error2 = quantised(unit - code * scale[:, None])
        return cls(code, scale, error, code2, scale2, error2)

    def near(self, rows: np.ndarray) -> np.ndarray:
        """The rows' vectors, as far as both codes tell."""
        return self.code[rows] * self.scale[rows, None] + self.code2[rows] * self.scale2[rows, None]


def product_bound(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """With x = a + e and y = b + f of length 1, x.y differs from a.b by at most |a||f| + |e||b| + |e||f|, and |a| <= 1 + |e|."""
    return f * (1 + e) + e * (1 + f) + e * f


def tile_pairs(left: Tile, right: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) whose cosine surely is at threshold or above, and those (i, j) for which the codes leave it open.

    i < j where both are the same tile.
    """
    sure, open_ = [np.zeros((2, 0), dtype=np.int64)], [np.zeros((2, 0), dtype=np.int64)]
    for start in range(0, len(left.code), 512):
        rows = slice(start, start + 512)
        # A row's codes meet a limit in whole numbers, the same for all columns or smaller than each column's own.
        worst = product_bound(left.error[rows], right.error.max())
        product = code_products(left.code[rows], right.code)
        product *= right.scale.astype(np.float32)
        i, j = np.nonzero(product >= ((threshold - worst - 1e-5) / left.scale[rows]).astype(np.float32)[:, None])
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            first = (left.code[x].astype(np.int32) * right.code[y]).sum(axis=1) * left.scale[x] * right.scale[y]
            may = first + product_bound(left.error[x], right.error[y]) >= threshold - 1e-9
            x, y = x[may], y[may]
            second, bound = (left.near(x) * right.near(y)).sum(axis=1), product_bound(left.error2[x], right.error2[y]) + 1e-9
            yes, no = second - bound >= threshold, second + bound < threshold
            sure.append(np.stack([x[yes], y[yes]]))
            open_.append(np.stack([x[~yes & ~no], y[~yes & ~no]]))
    (i, j), (x, y) = np.concatenate(sure, axis=1), np.concatenate(open_, axis=1)
    return i, j, x, y


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that the links (i, j) connect each of n indices with."""
    labels = np.arange(n)
    while len(i):
        before = labels
        labels = labels.copy()
        np.minimum.at(labels, i, before[j])
        np.minimum.at(labels, j, before[i])
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, tile_rows: int = 4096, pivots: int = 32) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; rows link when their cosine in double precision is threshold or more.

    Equal vectors are one class with a count. Classes are dealt into tiles by the nearest of at most `pivots` vectors (chosen by
    a hash, for each length of vectors) and, where many are near one, by a hash of their least id: tile_rows rows or about
    TILE_COMPONENTS components to a tile. Tiles meet if, for each pivot, the ranges of their angles to it come within the
    threshold's angle of each other; each such pair is one task's work on int8 codes. A task returns counts, a spanning forest
    of its links, and the pairs that the codes leave open, never the pairs that link. Pivots change the work, not the result.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and neither do rows with a
    null vec_id (component_id and kept are null there). Vectors of different lengths never link. Repeated rows are vectors
    of their own that link. A cosine equal to the threshold links. An empty table stays empty; other columns are not read.
    """
    lean(vectors)
    rows = durable(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).withColumn("good", usable(F.col("v")) & F.col("vec_id").isNotNull()))
    classes = durable(rows.where("good").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    chosen: dict[int, np.ndarray] = {}
    for r in classes.orderBy(F.xxhash64(F.lit("pivot"), "node")).limit(pivots).select("v").collect():
        unit = scaled(np.array([r["v"]], dtype=np.float64))
        chosen[len(r["v"])] = np.concatenate([chosen.get(len(r["v"]), np.zeros((0, len(r["v"])))), unit / np.sqrt((unit * unit).sum())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, flat = batch.column(2), np.asarray(batch.column(2).flatten(), dtype=np.float64)
            sizes = np.asarray(lists.value_lengths())
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                matrix = flat[starts[at][:, None] + np.arange(d)]
                tile, unit = Tile.of(matrix), scaled(matrix)
                unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                angles = np.arccos(np.clip(unit @ chosen[d].T, -1, 1)) if d in chosen else np.zeros((len(at), 0))
                blob = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), d, dtype=np.int32)), pa.array((angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(at))).astype(np.int32))]
                columns += [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * angles.shape[1], pa.int32()), pa.array(angles.reshape(-1)))]
                columns += [blob(tile.code), blob(tile.code2), blob(np.stack([tile.scale, tile.error, tile.scale2, tile.error2], axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "d", "home", "angles", "code", "code2", "numbers"])

    codes = durable(classes.select("node", "copies", "v").mapInArrow(coded, "node long, copies long, d int, home int, angles array<double>, code binary, code2 binary, numbers binary"))
    # One number per pivot and length of vectors comes to the driver; lengths without a pivot share what is left of the list.
    counts = codes.groupBy("d", "home").agg(F.count("*").alias("n"))
    tiles = counts.select("d", "home", F.ceil(F.col("n") / F.least(F.lit(tile_rows), F.greatest(F.lit(256), F.lit(TILE_COMPONENTS) / F.col("d")))).cast("int").alias("tiles"))
    dealt = codes.join(durable(tiles), ["d", "home"]).withColumn("tile", F.concat_ws(".", "d", "home", F.pmod(F.xxhash64("node"), "tiles")))

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        joined = lambda c: b"".join(part.column(c).to_pylist())
        angles = np.asarray(part.column("angles").combine_chunks().flatten(), dtype=np.float64).reshape(part.num_rows, -1)
        ranges = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (angles.min(axis=0), angles.max(axis=0))]
        held = [pa.array([x], pa.binary()) for x in (part.column("node").to_numpy().tobytes(), part.column("copies").to_numpy().tobytes(), joined("code"), joined("code2"), joined("numbers"))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([part.column("d")[0].as_py()], pa.int32()), *ranges, *held], names=["tile", "d", "low", "high", "nodes", "copies", "code", "code2", "numbers"])

    packed = durable(dealt.groupBy("tile").applyInArrow(pack, "tile string, d int, low array<double>, high array<double>, nodes binary, copies binary, code binary, code2 binary, numbers binary"))
    # Tiles are few: rows over tile_rows. Those that may hold a link meet, by their angles alone.
    about = packed.select("d", "tile", "low", "high")
    left, right = (about.select(*[F.col(c).alias(f"{c}_{side}") for c in about.columns]) for side in "lr")
    between = F.zip_with(F.zip_with("low_l", "high_r", lambda a, b: a - b), F.zip_with("low_r", "high_l", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    apart = F.aggregate(between, F.lit(-4.0), lambda most, x: F.greatest(most, x))
    meets = left.join(right, (F.col("d_l") == F.col("d_r")) & (F.col("tile_l") <= F.col("tile_r")) & (apart <= math.acos(max(-1.0, min(1.0, threshold))) + 1e-6))
    pairs = durable(meets.select(F.col("tile_l").alias("i"), F.col("tile_r").alias("j")))
    blobs = packed.drop("low", "high")
    sent = pairs.join(blobs, F.col("i") == F.col("tile")).union(pairs.where("i != j").join(blobs, F.col("j") == F.col("tile")))

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        held = {}
        for r in part.to_pylist():
            numbers = np.frombuffer(r["numbers"], dtype=np.float64).reshape(-1, 4).T
            code, code2 = (np.frombuffer(r[c], dtype=np.int8).reshape(-1, r["d"]) for c in ("code", "code2"))
            held[r["tile"]] = (np.frombuffer(r["nodes"], dtype=np.int64), np.frombuffer(r["copies"], dtype=np.int64), Tile(code, numbers[0], numbers[1], code2, numbers[2], numbers[3]))
        a, b, x, y = tile_pairs(held[i][2], held[j][2], threshold, i == j)
        open_ = pa.table({"node": held[i][0][x], "other": held[j][0][y], "least": pa.nulls(len(x), pa.int64()), "n": pa.nulls(len(x), pa.int64())})
        (nodes, weight) = held[i][:2] if i == j else (np.concatenate([held[i][k], held[j][k]]) for k in (0, 1))
        b = b if i == j else b + len(held[i][0])
        order = np.argsort(nodes)  # so that the least index is the least node
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        count = np.bincount(a, weights=weight[b], minlength=len(nodes)) + np.bincount(b, weights=weight[a], minlength=len(nodes))
        least = nodes[order][least_labels(len(nodes), place[a], place[b])[place]]
        some = np.flatnonzero(count)
        return pa.concat_tables([open_, pa.table({"node": nodes[some], "other": pa.nulls(len(some), pa.int64()), "least": least[some], "n": count[some].astype(np.int64)})])

    found = durable(sent.groupBy("i", "j").applyInArrow(compare, "node long, other long, least long, n long"))

    def recomputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(k).flatten(), dtype=np.float64) for k in (2, 3))
            sizes = np.asarray(batch.column(2).value_lengths())
            yes = np.zeros(batch.num_rows, dtype=bool)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                where = starts[at][:, None] + np.arange(d)
                yes[at] = cosines(scaled(x[where]), scaled(y[where])) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(yes)), batch.column(1).filter(pa.array(yes))], names=["a", "b"])

    ends = [classes.select(F.col("node").alias(n), F.col("v").alias(f"v_{n}")) for n in "ab"]
    doubt = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).join(ends[0], "a").join(ends[1], "b").select("a", "b", "v_a", "v_b")
    linked = durable(doubt.mapInArrow(recomputed, "a long, b long"))
    both = linked.union(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n"))
    sure = found.where("other is null")
    counted = sure.select("node", "n").union(more).groupBy("node").agg(F.sum("n").alias("n"))
    components = linked_components(sure.select(F.col("least").alias("a"), F.col("node").alias("b")).union(linked))
    named = durable(classes.join(counted, "node", "left").join(components, "node", "left").select("v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(codes, packed, pairs)
    out = rows.where("good").join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
