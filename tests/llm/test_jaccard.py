import random

from pyspark.sql import functions as F

from tests.llm import brute
from trajkit.llm import jaccard
from trajkit.llm.common import linked_components

SF = "/root/testdata/sf0.001"


def run(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, **parameters).collect()}


def test_equals_brute_force_on_the_tables(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute.jaccard(rows)


def test_equals_brute_force_on_chains_of_edits(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for group in range(12):
        text = rng.choices(vocabulary, k=rng.choice([3, 5, 30, 80, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    for _ in range(12):
        rows.append((len(rows), " ".join(rng.choices(vocabulary, k=8) + passage)))
    assert run(spark, rows) == brute.jaccard(rows)
    assert run(spark, rows, levels=1) == brute.jaccard(rows)


def test_exact_threshold_links(spark):
    # 23 words make 20 shingles; a word more or less at the ends moves the similarity by whole shingles.
    base = [f"a{i}" for i in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join(base + ["x", "y", "z"])), (3, " ".join(base + ["x", "y", "z", "u"]))]
    got = run(spark, rows)
    assert got == brute.jaccard(rows)
    assert got[2][1] == 1  # 17 of 20
    assert got[3][1] == 1  # by way of 2


def test_nulls_empty_repeats_and_long_texts(spark):
    long_text = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one  TWO"), (9, "one two"), (10, long_text), (11, long_text + " more"), (None, "one two"), (None, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("prefix", F.lit(2))
    got = sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=repr)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8), (10, 59_997, 10), (11, 59_998, 10), (None, 1, 8), (None, 1, None)], key=repr)


def test_rows_that_repeat_often(spark):
    text = " ".join(f"r{i}" for i in range(60))
    rows = [(1, text)] * 400 + [(2, text + " end")] * 400 + [(3, "something else entirely here")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got) == [(1, 57, 1)] * 400 + [(2, 58, 1)] * 400 + [(3, 1, 3)] * 5


def test_empty_table_and_layouts(spark):
    assert run(spark, []) == {}
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, jaccard.jaccard_components(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_representatives_keep_the_columns(spark):
    rows = [(1, "a b c d e", "en"), (2, "A b c d e", "de"), (3, None, None), (4, "else", "fr"), (4, "else", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 164)] + [(3, i) for i in range(4, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in linked_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 165)} | {i: 3 for i in range(3, 40)}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_whose_polynomials_meet_are_apart(spark):
    word = thue_morse(1024)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, f"x {word}"), (4, f"x {word.translate(str.maketrans('ab', 'ba'))}"), (5, word)]
    assert run(spark, rows) == brute.jaccard(rows)


def test_near_copies_that_do_not_link(spark):
    # A group around one text: members are linked with some of the others, by way of others, or with none.
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(70):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            text[rng.randrange(len(text))] = f"n{rng.randrange(400)}"
        rows.append((i * 3 % 71, " ".join(text)))
    for percent in (85, 92):
        want = brute.jaccard(rows, percent=percent)
        assert len({c for _, c in want.values()}) > 3
        assert run(spark, rows, percent=percent) == want
        assert run(spark, rows, percent=percent, levels=4, region_rows=2) == want


def test_representatives_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "else"), (4, "else"), (7, ""), (7, ""), (8, "one text here now"), (8, "quite another one there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("_same", F.lit(2)).withColumn("away", F.lit(3))
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [4, 7, 7, 8, None, None]
