import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trajkit.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by plain resharing: {source: target}, sources in code-point order, None last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / rest > most * sizes[s]} if rest else set()
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        full |= over


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def many(sources):
    return [(i, " ".join(f"w{j}" for j in range(1 + i * 7 % 90)), s) for i, s in enumerate(s for s, n in sources.items() for _ in range(n))]


@pytest.mark.parametrize("sources", [{"a": 300, "b": 50, "c": 40, None: 30, "Z": 5}, {"only": 60}, {"a": 1, "b": 1, "c": 400}])
def test_targets_and_what_is_taken(spark, sources):
    rows = many(sources)
    plan = mixing.mix_sources(documents(spark, rows), block_tokens=16)
    got = plan.documents.collect()
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(text))
    goal = targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_schedule_is_even_and_whole(spark):
    plan = mixing.mix_sources(documents(spark, many({"a": 300, "b": 200, "c": 100})), block_tokens=8)
    slots = plan.schedule.orderBy("slot", "rank").collect()
    total = sum(r["words"] for r in slots)
    share = {r["src"]: r["target"] / sum(x["target"] for x in plan.sources.collect()) for r in plan.sources.collect()}
    ranks, seen = {}, 0
    for r in slots[: len(slots) * 9 // 10]:
        assert r["rank"] == ranks.get(r["src"], 0)
        ranks[r["src"]] = r["rank"] + 1
        seen += 1
        if seen > 50:  # at any time each source has had its share of slots
            assert all(abs(ranks.get(s, 0) - share[s] * seen) < 8 for s in share)
    assert total == sum(round(r["target"]) for r in plan.sources.collect())


def test_layout_does_not_matter(spark):
    docs = documents(spark, many({"a": 100, "b": 30}))
    one, other = (sorted(map(tuple, mixing.mix_sources(docs.repartition(n)).documents.collect())) for n in (1, 9))
    assert one == other


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one two", None), (5, "x", "b"), (5, "x", "b"), (None, "x y z", "b"), (6, "w " * 40_000, "c")]
    docs = documents(spark, rows).withColumns({"size": F.lit("clash"), "taken": F.lit("clash"), "src": F.lit(9)})
    got = mixing.mix_sources(docs).documents.collect()
    by = sorted((r["doc_id"] or 0, r["size"]) for r in got)
    assert by == [(0, 3), (1, 0), (2, 0), (3, 0), (4, 2), (5, 1), (5, 1), (6, 40_000)]
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    for name in ("source_size", "target"):
        assert len({(r["source"], r[name]) for r in got}) == 4
    assert mixing.mix_sources(documents(spark, [])).documents.count() == 0
    assert mixing.mix_sources(documents(spark, [(1, None, None)])).documents.first()["target"] == 0


def test_mixed_documents_are_whole_and_follow_the_plan(spark):
    docs = documents(spark, many({"a": 60, "b": 60, "c": 60, None: 10})).withColumn("n_chars", F.length("text"))
    plan = {r["doc_id"]: r for r in mixing.mix_sources(docs).documents.collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    count = {}
    for r in out.collect():
        assert r["text"] == texts[r["doc_id"]]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert all(count.get(i, 0) == int(p["taken"] / p["size"] + 0.5) for i, p in plan.items())


def test_points_decide_the_slots(spark, monkeypatch):
    docs = documents(spark, many({"a": 300, "b": 200, "c": 100, "d": 3}))
    plan = mixing.mix_sources(docs, block_tokens=16)
    slots = {r["slot"]: r["src"] for r in plan.schedule.collect()}
    need = {r["src"]: r["need"] for r in plan.sources.collect()}
    total = sum(need.values())
    ends = {s: sum(n for t, n in need.items() if t <= s) * mixing.POINTS // total for s in need}
    for k in range(total):
        point = k * mixing.STEP % mixing.POINTS
        if k in slots:
            assert slots[k] == min(s for s in ends if point < ends[s])
    # What is topped up at the end, and what is left out, is the points' discrepancy, which grows with the logarithm.
    late = sum(1 for k in slots if k >= total)
    assert late <= len(need) * (1 + total.bit_length()) / 2 and total - sum(1 for k in slots if k < total) <= late
    row = lambda m: sorted((r["doc_id"], r["first_slot"]) for r in m.documents.collect())
    usual = row(plan)
    monkeypatch.setattr(mixing, "STEP", 1)
    assert row(mixing.mix_sources(docs, block_tokens=16)) != usual


def test_mixed_documents_with_clashing_names(spark):
    docs = documents(spark, many({"a": 20, "b": 9})).withColumns({"words": F.lit("w"), "_words": F.lit("x"), "times": F.lit(1), "Key": F.lit("k"), "number": F.lit(2)})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.select("words", "_words", "times", "Key", "number").collect()} == {("w", "x", 1, "k", 2)}
