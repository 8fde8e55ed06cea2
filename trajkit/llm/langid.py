"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each rotated by its place; a
text's vector bundles (sums) the vectors of all its n-grams; a language's prototype bundles its texts. A document gets the
language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajkit.llm.common import fresh_names, lean, row_slices, tidy

#: Bytes of text that are counted together; counting takes about a hundred bytes for each.
SLICE_BYTES = 1 << 18
#: Characters of a text beyond which it is counted in parts.
LONG = 1 << 18


@dataclass(frozen=True)
class Profile:
    """What the model is made of; equal settings give equal letter vectors everywhere."""

    dimensions: int = 512
    seed: int = 20240607


@lru_cache(maxsize=1)
def _letter() -> np.ndarray:
    """The letter of each code point: 0 for what is no letter, else the code point of its lower case."""
    table = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and (char := chr(point)).isalpha():
            table[point] = ord(char.lower()[0])
    return table


def letter_vectors(letters: np.ndarray, profile: Profile) -> np.ndarray:
    """The random vectors of +1 and -1 of letters, from bits that a letter's code point and the seed give: (letters, dimensions)."""
    words = -(-profile.dimensions // 64)
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(profile.seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (2 * bits[:, : profile.dimensions].astype(np.int8) - 1).astype(np.int8)


def gram_vectors(first: np.ndarray, middle: np.ndarray, last: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, given as their letters' places in the rows of letters."""
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[middle] * letters[last]


def count_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of all trigrams of letters and word boundaries, the letters, and each trigram's three places among these.

    Runs of other characters are one boundary, letter 0.
    """
    joined = "\0".join(["", *(t or "" for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = _letter()[points]
    # Texts' numbers from the places where they begin: lengths are in code points, and so are the places.
    starts = np.cumsum([1, *(len(t or "") + 1 for t in texts)])
    keep = (kinds[:-1] != 0) | (kinds[1:] != 0)
    keep = np.append(keep, True)
    keep[starts - 1] = True
    places = np.flatnonzero(keep)
    used = np.zeros(0x110000, dtype=bool)
    used[0] = True
    used[kinds[places]] = True
    letters = np.flatnonzero(used)
    number = np.zeros(0x110000, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    kinds, n = number[kinds[places]], len(letters)
    # A boundary stays before each letter; a second one where two stand side by side makes a gram without a letter in the middle.
    text = np.searchsorted(starts, places, side="right") - 1
    middle = kinds[1:-1] != 0
    own, gram = np.unique(((kinds[:-2] * n + kinds[1:-1]) * n + kinds[2:])[middle], return_inverse=True)
    found, count = np.unique(text[1:-1][middle] * max(1, len(own)) + gram, return_counts=True)
    grams = np.stack([own // n // n, own // n % n, own % n])
    return found // max(1, len(own)), found % max(1, len(own)), count, letters, grams


def _parts(text: str) -> Iterator[str]:
    """text in parts of about LONG characters, cut where no letter stands: the grams of the parts are those of the text."""
    start = 0
    while len(text) - start > LONG:
        end = start + LONG
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def text_vectors(texts: list[str | None], profile: Profile) -> np.ndarray:
    """Bundles of the texts, one row each; sums of whole numbers, so they do not depend on what is counted together."""
    if any(len(t or "") > LONG for t in texts):
        return np.concatenate([sum(_bundled([part], profile) for part in _parts(t or "")) for t in texts])
    return _bundled(texts, profile)


def _bundled(texts: list[str | None], profile: Profile) -> np.ndarray:
    row, column, count, letters, grams = count_grams(texts)
    out = np.zeros((len(texts), profile.dimensions), dtype=np.float64)
    if not grams.shape[1]:
        return out
    vectors = gram_vectors(*grams, letter_vectors(letters, profile)).astype(np.float32)
    for start in range(0, len(texts), 256):
        a, b = np.searchsorted(row, [start, start + 256])
        used, at = np.unique(column[a:b], return_inverse=True)
        table = np.zeros((min(256, len(texts) - start), len(used)), dtype=np.float32)
        table[row[a:b] - start, at] = count[a:b]
        # Sums below 2^24 are exact in single precision; a larger text is summed in double precision.
        exact = np.float32 if table.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
        out[start : start + 256] = table.astype(exact) @ vectors[used].astype(exact)
    return out


@dataclass
class LanguageModel:
    """languages: names in code-point order; prototypes: their bundles, brought to length 1."""

    languages: list[str]
    prototypes: np.ndarray
    profile: Profile

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, cosine to its prototype, at least 0) of each text; ('und', 0.0) without a letter. Ties go to the first name."""
        out = []
        for vector in text_vectors(texts, self.profile):
            length = np.sqrt((vector * vector).sum())
            if not length or not self.languages:
                out.append(("und", 0.0))
                continue
            cosines = (self.prototypes * vector).sum(axis=1) / length
            best = int(np.argmax(cosines))
            out.append((self.languages[best], float(min(1.0, max(0.0, cosines[best])))))
        return out


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn_languages(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", texts_per_language: int = 3000, most_languages: int = 4096, profile: Profile = Profile()) -> LanguageModel:
    """Bundle prototypes from a sample of labelled (key, text, lang); rows without a language, text or key are left out.

    The sample is bounded: each language gives about texts_per_language whole texts, all if it has fewer, chosen by a hash
    of the key, whatever the size of the input. More than most_languages names raise ValueError. The driver gets the sums
    of the vectors, one row per language.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("key is not null and lang is not null and text is not null")
    sizes = [(r[0], r[1]) for r in rows.groupBy("lang").agg(F.count("*")).limit(most_languages + 1).collect()]
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return LanguageModel([], np.zeros((0, profile.dimensions)), profile)
    share = rows.sparkSession.createDataFrame([(name, min(1.0, texts_per_language / n)) for name, n in sizes], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("language sample"), "key"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b in row_slices(batch.column(1), SLICE_BYTES):
                for name, vector in zip(names[a:b], text_vectors(batch.column(1).slice(a, b - a).to_pylist(), profile), strict=True):
                    length = np.sqrt((vector * vector).sum())
                    if length:
                        sums[name] = sums.get(name, 0) + np.rint(vector / length * (1 << 20)).astype(np.int64)
            tidy()
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})

    parts = lean(sample).mapInArrow(bundle, "lang string, sums array<bigint>")
    flat = parts.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    learned = flat.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums")).collect()
    learned.sort(key=lambda r: r["lang"])
    vectors = np.array([r["sums"] for r in learned], dtype=np.float64).reshape(len(learned), profile.dimensions)
    return LanguageModel([r["lang"] for r in learned], vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), profile)


def identify_languages(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its cosine to that prototype.

    Nulls and texts without a letter, empty ones too, get 'und' and 0.0. Repeated rows get equal values, whatever rows they
    are counted with; ties go to the first name in code-point order; very long texts are counted whole; an empty table stays
    empty. Columns of docs that have the names of the new ones are replaced, all others are kept.
    """
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema), f"`{lang_pred}` string", f"`{score}` double"])
    at = kept.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for a, b in row_slices(batch.column(at), SLICE_BYTES) for x in model.score(batch.column(at).slice(a, b - a).to_pylist())]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, lang_pred, score])
            tidy()

    return lean(docs).select(*[f"`{c}`" for c in kept]).mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, *, text: str = "text", languages: Collection[str] | None = None, least_score: float = 0.0, least_letters: int = 0) -> DataFrame:
    """The rows of docs, with its columns, whose predicted language is one of languages, with a cosine of least_score or more.

    Without languages all that the model has learned count. Texts of fewer than least_letters letters are too short for a
    score to tell much: they keep what is predicted. Nulls and texts without a letter have no language and go. A model
    without languages can tell nothing apart: docs stay as they are. Columns of any name are kept.
    """
    if not model.languages:
        return docs
    lang, score = fresh_names(docs.columns, "lang_pred", "score")
    found = identify_languages(docs, model, text=text, lang_pred=lang, score=score)
    wanted = F.col(lang).isin(*sorted(set(model.languages) if languages is None else set(languages))) & (F.col(lang) != "und")
    short = F.length(F.regexp_replace(F.col(f"`{text}`"), r"\P{L}+", "")) < least_letters
    return found.where(wanted & ((F.col(score) >= least_score) | short)).select(*[f"`{c}`" for c in docs.columns])
