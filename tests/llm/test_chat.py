import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajkit.llm import chat

ODD = ["", "plain", "<turn>", "</turn>", "<turn|>", "<\\turn>", "<\\\\/turn>", "\\", "\\### Assistant: </turn> ok", "<<turn", "</turn></turn>", "\n<turn", "日本\U0001f600</turn>"]


def read(out):
    return out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("under", chat.masked_text(F.col("formatted"), F.col("mask")))


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_linear_conversations_come_back(spark):
    rows = [(c, t, "assistant" if t % 2 else ("</turn>" if t == 2 else "user"), ODD[(3 * c + t) % len(ODD)]) for c in range(20) for t in range(c % 9 + 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["tree"]: r for r in read(chat.format_trees(chat.conversation_messages(table))).collect()}
    for c in range(20):
        own = [(r, t) for i, _, r, t in rows if i == c]
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert got[c]["under"] == "".join(t for r, t in own if r == "assistant")
        for m, (role, _) in zip(got[c]["mask"], own, strict=True):
            assert m["loss"] == (role == "assistant")
        assert got[c]["formatted"].count("</turn>") == len(own)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("<\\/turn|>"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=20))
def test_escaping_is_reversible(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r["u"] == r["t"] and "<turn" not in r["e"] and "</turn" not in r["e"] for r in rows)


TREE = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 0.2), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 2, "user", "aa", 1.0), (1, 5, 2, "user", "ab", None), (1, 6, 4, "assistant", "aaa", 0.1), (2, 1, 9, "user", "lost parent", 0.0), (2, 2, 2, "user", "own parent", 0.0)]


def plain_paths(rows):
    """{(tree, leaf): nodes from the root} by walking up."""
    above = {(t, n): p if (t, p) in {(r[0], r[1]) for r in rows} and p != n else None for t, n, p, *_ in rows}
    inner = {(t, p) for (t, _), p in above.items() if p is not None}
    out = {}
    for t, n in above:
        if (t, n) not in inner:
            path = [n]
            while above[t, path[0]] is not None:
                path.insert(0, above[t, path[0]])
            out[t, n] = path
    return out


def test_paths_and_ranks(spark):
    rows = messages(spark, TREE)
    got = {}
    for r in chat.root_to_leaf_paths(rows).orderBy(F.col("up").desc()).collect():
        got.setdefault((r["tree"], r["leaf"]), []).append(r["node"])
    assert got == plain_paths(TREE)
    out = read(chat.format_trees(rows, score="score", best=2)).orderBy("tree", "rank").collect()
    assert [(r["tree"], r["leaf"], r["rank"]) for r in out] == [(1, 3, 1), (1, 6, 2), (2, 1, 1), (2, 2, 2)]
    assert [t["text"] for t in out[1]["turns"]] == ["hi", "a", "aa", "aaa"] and out[1]["under"] == "aaaa"


def test_long_chains_and_cycles(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    row = read(chat.format_trees(messages(spark, chain))).first()
    assert [t["text"] for t in row["turns"]] == [str(i) for i in range(300)]
    cycles = [(1, 1, 2, "user", "", 0.0), (1, 2, 1, "user", "", 0.0), (1, 3, 2, "user", "", 0.0), (1, 4, None, "user", "", 0.0), (2, 1, None, "user", "fine", 0.0), (None, 1, 2, "user", "", 0.0), (None, 2, 3, "user", "", 0.0), (None, 3, 1, "user", "", 0.0)]
    table = messages(spark, cycles)
    assert [(r["tree"], r["formatted"]) for r in chat.format_trees(table).collect()] == [(2, "<turn>user<turn|>fine</turn>")]
    assert {r["tree"] for r in chat.lifted(table.select("tree", "node", "parent", F.lit(0.0).alias("value")))[2].collect()} == {1, None}


def test_repeated_rows_count_once(spark):
    rows = [(1, 1, None, "user", "hi", 1.0)] * 3 + [(1, 2, 1, "assistant", "b", 0.5), (1, 2, 1, "assistant", "a", 0.1), (1, 2, None, "assistant", "z", 0.1)]
    got = read(chat.format_trees(messages(spark, rows), best=5)).orderBy("rank").collect()
    # The row without a parent is the least: a second root.
    assert [[t["text"] for t in r["turns"]] for r in got] == [["hi"], ["z"]]


def test_best_branches_equal_brute_force(spark):
    import random

    rng, rows = random.Random(2), []
    for tree in range(6):
        for n in range(rng.choice([1, 5, 40])):
            rows.append((tree, n, rng.randrange(n) if n and rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), f"{tree}.{n}", rng.choice([0.0, 0.25, 0.5, None])))
    value = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    want = {}
    for (tree, leaf), path in plain_paths(rows).items():
        want.setdefault(tree, []).append((-sum(value[tree, n] for n in path) / len(path), leaf, path))
    got = {}
    for r in read(chat.format_trees(messages(spark, rows), score="score", best=3)).orderBy("tree", "rank").collect():
        got.setdefault(r["tree"], []).append((-r["score"], r["leaf"], [int(t["text"].split(".")[1]) for t in r["turns"]]))
    assert got == {t: sorted(x)[:3] for t, x in want.items()}


def test_nulls_ties_and_empty(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (1, None, None, "first"), (2, 0, "assistant", "z" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "tree": F.lit("t"), "up": F.lit(0)})
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in read(chat.format_trees(chat.conversation_messages(table))).collect()}
    assert got == {None: [("user", "a"), ("assistant", "")], 1: [("", "first"), ("a", "y"), ("a", "y"), ("b", "x")], 2: [("assistant", "z" * 200_000)]}
    assert chat.format_trees(chat.conversation_messages(table.where("false"))).count() == 0


def test_query_digests(spark):
    from trajkit.llm import queries

    rows = queries.op4_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    said = "\\### Assistant: </turn> ok"
    assert len(rows) == 1 and rows[0]["n_turns"] == 2 and rows[0]["loss_chars"] == len(said)
    assert rows[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert rows[0]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
