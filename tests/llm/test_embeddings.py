import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from trajkit.llm import embeddings


def plain(rows, threshold=0.95):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold]
    found = brute.components([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), found[i], found[i] == i) for i, _ in rows}


def run(spark, rows, **parameters):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_duplicates(table, **parameters).collect()}


def near_copies(rng, groups, dimensions):
    rows = []
    for g in range(groups):
        base = rng.normal(size=dimensions)
        for _ in range(1 + g % 7):
            v = (base + rng.normal(size=dimensions) * rng.choice([0, 0.05, 0.2, 0.35])) * rng.choice([0.01, 1, 100])
            rows.append((len(rows), [float(np.float32(x)) for x in v]))
    return rows


def test_equals_brute_force_over_several_tiles(spark):
    rows = near_copies(np.random.default_rng(1), 60, 24)
    assert run(spark, rows, tile_rows=40) == plain(rows) == run(spark, rows) == run(spark, rows, pivots=0, tile_rows=100)


def test_query_equals_brute_force(spark):
    from trajkit.llm import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op3_embedding_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain(rows)


def test_pairs_the_codes_leave_open(spark):
    # Pairs at the threshold but for some 1e-7: neither code can tell.
    rng, rows = np.random.default_rng(6), []
    for _ in range(40):
        x, y = rng.normal(size=(2, 24))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        for c in (0.95 - 1e-6, 0.95 + 1e-6):
            rows += [(len(rows) + i, [float(v) for v in w]) for i, w in enumerate((x, c * x + np.sqrt(1 - c * c) * y))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == plain(rows)


def test_bound_is_never_broken():
    rng = np.random.default_rng(2)
    left, right = (rng.normal(size=(200, 16)) * rng.choice([1e-3, 1, 30], size=(1, 16)) for _ in range(2))
    left, right = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (left, right))
    (qa, sa, ea), (qb, sb, eb) = embeddings.quantised(left), embeddings.quantised(right)
    off = np.abs(embeddings.code_products(qa, qb) * sa[:, None] * sb - left @ right.T)
    assert (off <= eb * (1 + ea[:, None]) + ea[:, None] * (1 + eb) + ea[:, None] * eb).all()
    wide = rng.integers(-127, 128, size=(3, 3000)).astype(np.int8)
    assert (embeddings.code_products(wide, wide) == wide.astype(np.int64) @ wide.T.astype(np.int64)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [-0.0, 3.0])]
    assert run(spark, rows) == plain(rows)
    table = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>").withColumns({"label": F.lit(None).cast("int"), "v": F.lit(1), "node": F.lit("x")})
    got = sorted(map(tuple, embeddings.embedding_duplicates(table).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (5, 2, 1, False), (None, 0, None, None)], key=repr)
    assert embeddings.embedding_duplicates(table.where("false")).count() == 0


def test_exact_threshold_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [4.0, 3.0])]
    assert run(spark, rows, threshold=0.6) == plain(rows, 0.6)
    assert run(spark, rows, threshold=0.6)[1][0] == 2
