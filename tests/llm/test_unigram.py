import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from trajkit.llm import unigram

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.read_model(unigram.load_vocabulary(MODEL))


def decoded(ids, v):
    return unigram.Decoder(v).decode(np.array(ids, dtype=np.int64))


def best_sum(unit, v, pieces):
    """The greatest sum of scores over all segmentations of a unit, character by character."""
    text = unit.replace(b"\xff", "▁".encode()).decode()
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if (score := pieces.get(text[i:j])) is not None:
                best[j] = max(best[j], best[i] + score)
        if text[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + v.unknown_score)
    return best[-1]


def test_segmentations_are_best(vocabulary):
    v = vocabulary
    pieces = {b.decode().replace(" ", "▁"): v.scores[i] for i, b in enumerate(v.bytes_of) if b and i not in set(v.byte_id)}
    rng = random.Random(1)
    units = {("".join(rng.choices("abehinorst▁éß日語\U0001f600", k=rng.randint(1, 14)))) for _ in range(400)} | {"▁" * 20, "▁the", "▁information"}
    units = [u.encode().replace("▁".encode(), b"\xff") for u in units]
    for unit, tokens in zip(units, unigram.best_segmentations(units, v), strict=True):
        ids = np.frombuffer(tokens, dtype=np.int32)
        known = [v.scores[i] for i in ids if i not in v.byte_id]
        characters = unit.decode("utf-8", "replace")
        unknown = sum(c != "�" and c not in pieces for c in characters)
        assert sum(known) + unknown * v.unknown_score == pytest.approx(best_sum(unit, v, pieces))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_every_text_comes_back(text):
    v = unigram.read_model(unigram.load_vocabulary(MODEL)) if not hasattr(test_every_text_comes_back, "v") else test_every_text_comes_back.v
    test_every_text_comes_back.v = v
    ids = unigram.Encoder(v).encode([text])[0]
    assert decoded(ids, v) == text


def test_no_segmentation_of_the_library_is_better(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder, worse = unigram.Encoder(vocabulary), 0
    for text in ["", " ", "   ", "a", "the cat", "  a  b ", "internationalisation of the others", "日本語 \U0001f600 é\x00\n\t"]:
        own, other = encoder.encode([text])[0], library.encode(text)
        assert decoded(own, vocabulary) == text and len(own) == 0 or decoded(own, vocabulary) == decoded(np.array(other), vocabulary)
        score = lambda ids: sum(vocabulary.scores[i] for i in ids if i not in vocabulary.byte_id)
        assert score(own) >= score(other)
        worse += score(own) > score(other)
    assert worse  # the library merges pairs in order instead


def test_double_array_holds_its_keys_and_no_others():
    keys = [(b"a", 0), (b"ab", 1), (b"abc", 2), (b"b", 3), (b"\xff", 4), (b"\xffa", 5)]
    base, check, piece = unigram.double_array(keys)

    def find(key):
        node = 0
        for c in key:
            step = base[node] + c
            if not base[node] or check[step] != node:
                return -1
            node = step
        return piece[node]

    assert [find(k) for k, _ in keys] == [n for _, n in keys]
    assert [find(k) for k in (b"c", b"ac", b"abcd", b"ba", b"\xffb")] == [-1] * 5


def test_long_texts_in_parts(vocabulary, monkeypatch):
    texts = ["a  bc ▁ def " * 50, "x" * 400, " " * 300, "日本 " * 100, None, ""]
    whole = unigram.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(unigram, "UNITS", 7)
    for a, b in zip(whole, unigram.Encoder(vocabulary).encode(texts), strict=True):
        assert (a is None and b is None) or list(a) == list(b)
    assert decoded(whole[0], vocabulary) == texts[0]


def test_tables(spark):
    model = unigram.load_vocabulary(MODEL)
    long_text = "word " * 30_000 + "x" * 5_000
    texts = [None, "", " ", "a", "a", "▁ mark", long_text, "tab\tline\n"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded")
    out = unigram.decode_texts(unigram.encode_texts(docs, model), model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i or None]["decoded"] for i in range(len(texts))] == texts
    assert got[None]["ids"] is None and got[1]["ids"] == [] and got[3]["ids"] == got[4]["ids"]
    at_once = {r["doc_id"]: r for r in unigram.encode_texts(docs, model, decode=True).collect()}
    assert all(at_once[i]["decoded"] == r["decoded"] and at_once[i]["ids"] == r["ids"] for i, r in got.items())
    assert unigram.decode_texts(unigram.encode_texts(docs.where("false"), model), model).count() == 0


def test_models_that_lose_text_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(unigram.load_vocabulary(MODEL))
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        unigram.read_model(model.SerializeToString())


def test_long_units_equal_short_ones(vocabulary, monkeypatch):
    rng, v = random.Random(4), vocabulary
    texts = ["".join(rng.choices("abehinorst日本語のはé😀", k=rng.randint(1, 90))) for _ in range(60)] + ["日本語" * 30, "QUJD" * 40, "😀" * 20]
    units = [b"\xff" + t.encode() for t in texts]
    short = unigram.best_segmentations(units, v)
    monkeypatch.setattr(unigram, "LONG", 0)
    for window in (5, 16, 1 << 16):
        monkeypatch.setattr(unigram, "WINDOW", window)
        assert unigram.best_segmentations(units, v) == short


def test_speed_and_memory_without_spaces(vocabulary):
    import base64
    import time

    rng = random.Random(9)
    encoder = unigram.Encoder(vocabulary)
    for text in ("".join(rng.choices([chr(c) for c in range(0x3041, 0x3090)] + list("日本語東京国会"), k=60_000)), base64.b64encode(rng.randbytes(120_000)).decode()):
        began = time.perf_counter()
        ids = encoder.encode([text])[0]
        assert time.perf_counter() - began < 5
        assert decoded(ids, vocabulary) == text
    for i in range(40):
        encoder.encode([" ".join(f"w{i}x{j}" * 5 for j in range(10_000))])
    assert encoder.held < unigram.REMEMBERED + (8 << 20) and all(len(u) <= unigram.MOST_REMEMBERED for u in encoder.known)


def test_query_equals_brute_force(spark):
    import hashlib

    from trajkit.llm import queries

    sf = "/root/testdata/sf0.001"
    v = unigram.read_model(unigram.load_vocabulary(queries.MODEL))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = brute.PlainEncoder(v, unigram._UNIT).encode
    for r in queries.op8_sentencepiece(spark, sf).collect():
        text = texts[r["doc_id"]]
        ids = plain(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_chars"] == len(text) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
