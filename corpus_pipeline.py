"""A training corpus from the documents table: language ID, near-duplicates, mixing, tokens.

STAGES names the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajkit.llm import jaccard, langid, mixing, unigram
from trajkit.llm.common import durable, table

#: The vocabulary of the last stage.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: Texts of at least so many letters whose cosine to the nearest language is below LEAST_SCORE are in none of the languages.
#: Random letters reach 0.1, and texts of that length in a language that was learned hardly ever less than 0.4.
LEAST_SCORE, LEAST_LETTERS = 0.15, 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the languages that the table is labelled with go, and those without a letter or a text.

    The model is learned from docs; a table without labels stays as it is.
    """
    model = langid.learn_languages(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model, least_score=LEAST_SCORE, least_letters=LEAST_LETTERS)


def join_by_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_representatives(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: sources weigh 5, 2, 1 and share 150% of all words, at most twice their own."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the tokens of the whole text, and whether decoding them gives back the text."""
    model = unigram.load_vocabulary(MODEL)
    rows = docs.select(F.struct("doc_id", "lang", "source", F.xxhash64("text").alias("mark")).alias("row"), "text")
    out = unigram.encode_texts(rows, model, doc_id="row", decode=True)
    return out.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("doc_id.mark")).alias("exact"))


STAGES = [("language_id", identify_language), ("jaccard_join", join_by_jaccard), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: SQL expresses neither the language model nor the segmentation; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
