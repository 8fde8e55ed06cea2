import zlib

import numpy as np
from pyspark.sql import functions as F

from trajkit.llm import langid

TABLES = "/root/testdata/sf0.01"


def plain_vector(text, profile):
    """The bundle of a text, gram by gram."""
    kinds = [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""), 0]
    kinds = [k for i, k in enumerate(kinds) if k or not i or kinds[i - 1]]
    kinds += [0] if kinds[-1] else []
    letters = {k: langid.letter_vectors(np.array([k]), profile)[0].astype(int) for k in set(kinds)}
    out = np.zeros(profile.dimensions, dtype=int)
    for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False):
        if b:
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_vectors_equal_the_plain_sum():
    texts = ["Hello, world", None, "", "1 2 3", "é", "a", "ab  cd\n\n9x", "ÀB ß", " x", "日本語 ひらがな", "русский"]
    got = langid.text_vectors(texts, langid.Profile())
    for text, vector in zip(texts, got, strict=True):
        assert (vector == plain_vector(text, langid.Profile())).all(), text


def test_long_texts_in_parts(monkeypatch):
    texts = ["ab, cd! " * 20, "abc" * 30, "é 1 x" * 9, None]
    whole = langid.text_vectors(texts, langid.Profile())
    monkeypatch.setattr(langid, "LONG", 5)
    assert (langid.text_vectors(texts, langid.Profile()) == whole).all()


def test_held_out_accuracy_and_learning_set(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = langid.learn_languages(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify_languages(docs, model).withColumn("h", langid.held_out(F.col("doc_id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r["lang_pred"] == r["lang"] for r in rows if r["h"]]
    assert len(out) > 150 and sum(out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(300)
    model = langid.learn_languages(docs)
    plain = langid.identify_languages(docs, model).select("doc_id", "lang_pred", "score")
    blind = langid.identify_languages(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")}).repartition(5), model).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, blind.collect()))


def test_odd_rows(spark):
    rows = [(1, "hello there", "en"), (2, "bonjour à tous", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 34 !", "en"), (None, "hello", "en"), (6, "hello there", None), (6, "hello there", None), (7, "hello " * 50_000, None), (8, "日本語", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("sums", F.lit(1))
    model = langid.learn_languages(docs)
    assert model.languages == ["en", "fr"]
    got = langid.identify_languages(docs, model)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert [by[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3 and by[1][0] == by[6][0] == by[7][0] == by[None][0] == "en" and by[2][0] == "fr" and by[8][0] in ("en", "fr")
    assert got.count() == len(rows) and sorted(got.columns) == sorted([*docs.columns, "score"])
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (3, 4, 5)").count() == 0 and kept.count() == len(rows) - 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.learn_languages(docs)
    assert langid.identify_languages(docs, model).count() == 0
    assert langid.identify_languages(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first()["lang_pred"] == "und"


def test_letters_have_vectors_of_their_own():
    letters = np.array([0, *range(97, 123), 0xE9, 0x3B1, 0x439, 0x65E5, 0x672C, *range(0x4E00, 0x4F00)])
    vectors = langid.letter_vectors(letters, langid.Profile()).astype(int)
    products = vectors @ vectors.T - np.eye(len(letters), dtype=int) * langid.Profile().dimensions
    assert set(np.unique(vectors)) == {-1, 1} and np.abs(products).max() < 160


def test_query_equals_brute_force(spark):
    from trajkit.llm import queries

    # Fewer documents than texts_per_language: every labelled one that isn't held out is learned from.
    sf, profile = "/root/testdata/sf0.001", langid.Profile()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    vectors = {r["doc_id"]: plain_vector(r["text"], profile).astype(float) for r in docs}
    sums = {}
    for r in docs:
        v = vectors[r["doc_id"]]
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None and v.any():
            sums[r["lang"]] = sums.get(r["lang"], 0) + np.rint(v / np.sqrt(v @ v) * (1 << 20))
    names = sorted(sums)
    for r in queries.op5_language_id(spark, sf).collect():
        v = vectors[r["doc_id"]]
        cosines = [float(sums[n] @ v / np.sqrt((sums[n] @ sums[n]) * (v @ v))) if v.any() else 0.0 for n in names]
        assert r["held_out"] == held[r["doc_id"]]
        assert r["lang_pred"] == (names[int(np.argmax(cosines))] if v.any() else "und")
        assert abs(r["score"] - max(0.0, max(cosines))) < 1e-9


def test_stage_without_labels_or_with_clashing_names(spark):
    rows = [(1, "hello there", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("mine"), "Score": F.lit(3)})
    assert langid.keep_identified(docs, langid.learn_languages(docs)).count() == 2
    model = langid.learn_languages(spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour tous", "fr")], "doc_id long, text string, lang string"))
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and [(r["doc_id"], r["lang_pred"], r["Score"]) for r in kept.collect()] == [(1, "mine", 3)]
    assert langid.keep_identified(docs, model, languages=["fr"]).count() == 0
    assert langid.keep_identified(docs, model, least_score=1.1).count() == 0
