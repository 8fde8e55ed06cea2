import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_langid import plain_vector
from tests.llm.test_mixing import targets
from trajkit.llm import langid, unigram

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    """The table, with texts in a language that it isn't labelled with, without letters, null, and a copy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copied = docs.where("doc_id = 7").select((F.col("doc_id") + 100_000).alias("doc_id"), *COLUMNS[1:])
    odd = [(200_000, "Това е изречение на български език, което моделът не познава. " * 9, None, "src0", 1), (200_001, "12 34 !", "en", None, 7), (200_002, None, None, "src1", None), (200_003, "", "en", "src1", 0), (200_004, "Короткий текст", None, "src2", 14)]
    return docs.union(copied).union(spark.createDataFrame(odd, docs.schema)).persist()


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_language_stage_equals_brute_force(spark, documents):
    profile, rows = langid.Profile(), documents.collect()
    vectors = [plain_vector(r["text"], profile).astype(float) for r in rows]
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None and v.any():
            sums[r["lang"]] = sums.get(r["lang"], 0) + np.rint(v / np.sqrt(v @ v) * (1 << 20))
    want = []
    for r, v in zip(rows, vectors, strict=True):
        best = max(float(s @ v / np.sqrt((s @ s) * (v @ v))) for s in sums.values()) if v.any() else None
        if best is not None and (best >= corpus_pipeline.LEAST_SCORE or sum(c.isalpha() for c in r["text"]) < corpus_pipeline.LEAST_LETTERS):
            want.append(tuple(r[c] for c in COLUMNS))
    got = rows_of(stage("language_id")(spark, documents, SF))
    assert got == sorted(want, key=repr)
    gone = {r["doc_id"] for r in rows} - {r[0] for r in got}
    assert {200_000, 200_001, 200_002, 200_003} <= gone and 200_004 not in gone


def test_jaccard_stage_equals_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = brute.jaccard(rows, k=5, percent=80)
    want = sorted((tuple(r[c] for c in COLUMNS) for r in documents.collect() if found[r["doc_id"]][1] == r["doc_id"]), key=repr)
    assert rows_of(stage("jaccard_join")(spark, documents, SF)) == want and len(want) < len(rows)


def test_mixing_stage_equals_brute_force(spark, documents):
    rows, sizes = documents.collect(), {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    goal, want = targets(sizes), []
    for source in sizes:
        start, line = 0, sorted((hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest()[:15], r["doc_id"], r) for r in rows if r["source"] == source)
        for _, _, r in line:
            n, goal_words = len(brute.words(r["text"])), int(goal[source] + 0.5)
            taken = min(n, max(0, goal_words - start)) + min(n, max(0, goal_words - sizes[source] - start))
            want += [tuple(r[c] for c in COLUMNS)] * (int(taken / n + 0.5) if n else 0)
            start += n
    assert rows_of(stage("mixing")(spark, documents, SF)) == sorted(want, key=repr)


def test_pieces_stage_equals_brute_force(spark, documents):
    plain = brute.PlainEncoder(unigram.read_model(unigram.load_vocabulary(corpus_pipeline.MODEL)), unigram._UNIT)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = stage("sentencepiece")(spark, documents, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        assert r["ids"] == (None if text is None else plain.encode(text)) and (r["exact"] or text is None)
        assert r["n_tokens"] == (None if r["ids"] is None else len(r["ids"]))


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids", "exact"} and out.where("not exact").count() == 0
    for _, one in corpus_pipeline.STAGES:
        docs = one(spark, docs, SF).persist()
    key = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())
    assert key(out) == key(docs) and out.count() > 0


def test_every_query_has_the_columns_that_were_agreed(spark):
    from trajkit.llm import queries

    agreed = {
        "op1": {"doc_id", "size", "source_size", "target", "taken"},
        "op2": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op3": {"vec_id", "n_links", "component_id", "kept"},
        "op4": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
        "op5": {"doc_id", "held_out", "lang_pred", "score"},
        "op9": {"page_id", "host", "path", "rule", "verdict"},
        "op10": {"doc_id", "n_shingles", "component_id"},
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "mixing", "sentencepiece"]
    for name, query in queries.QUERIES.items():
        if name.split("_")[0] in agreed:
            assert set(query(spark, SF).columns) >= agreed[name.split("_")[0]], name
