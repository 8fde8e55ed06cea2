"""The registered queries of this subpackage, one per operator and the pipeline, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajkit.llm import audio, chat, embeddings, jaccard, langid, licenses, mixing, shards, unigram, urlfilter
from trajkit.llm.common import durable, table
from trajkit.sources.scratch import delete_at_end, own_folder


#: The vocabulary that the query of SentencePiece encodes with.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: Arrivals that the query of sharding takes the documents in.
ARRIVALS = 4


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_media(table(spark, sf_dir, "documents"))
    header = audio.HEADER.size  # payloads have an even number of bytes, so nothing follows them
    out = out.withColumn("payload", F.expr(f"substring(media, {header + 1}, length(media) - {header})"))
    found = F.concat("tensors", F.encode(F.to_json(F.struct("spans", "segments")), "UTF-8"))
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.sha2(found, 256).alias("feature"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = chat.format_trees(durable(chat.conversation_messages(rows)))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("under", chat.masked_text(F.col("formatted"), F.col("mask")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn_languages(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{own_folder(spark)}/shards/{uuid.uuid4().hex}"
    store = shards.shard_documents(table(spark, sf_dir, "documents"), root, arrivals=ARRIVALS, target_bytes=64 << 20)
    delete_at_end(spark)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), shards.arrival(F.col("doc_id"), ARRIVALS))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = unigram.load_vocabulary(MODEL)
    out = unigram.encode_texts(docs, model, decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py. Neither the language model nor the segmentation is SQL; see tests/llm/test_pipeline.py."""
    import corpus_pipeline  # it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_audio_features, op3_embedding_dedup, op4_chat_formatting, op5_language_id, op6_license_scan, op7_sharding, op8_sentencepiece, op9_url_filter, op10_jaccard_join, pipeline)}

ORACLE_SQL: dict[str, str] = {}

_rounds = "".join(
    f""",
l{i + 1} AS (SELECT CASE WHEN sum(CASE WHEN 2.0 * source_size < lam * weight THEN 0 ELSE weight END) = 0 THEN any_value(lam)
  ELSE (1.5 * sum(source_size) - sum(CASE WHEN 2.0 * source_size < lam * weight THEN 2.0 * source_size ELSE 0.0 END))
       / sum(CASE WHEN 2.0 * source_size < lam * weight THEN 0 ELSE weight END) END AS lam FROM per, l{i})"""
    for i in range(12)
)
ORACLE_SQL["op1_mixing"] = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
grouped AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
per AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM grouped),
l0 AS (SELECT 1.5 * sum(source_size) / sum(weight) AS lam FROM per){_rounds},
goals AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src, CASE WHEN 2.0 * source_size < lam * weight THEN 2.0 * source_size ELSE lam * weight END AS target FROM per, l12),
needs AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CAST(ceil(source_size / 256) AS BIGINT) AS blocks,
  CASE WHEN source_size = 0 THEN 0 ELSE (CAST(round(target) AS BIGINT) // source_size) * CAST(ceil(source_size / 256) AS BIGINT) + CAST(ceil((CAST(round(target) AS BIGINT) % source_size) / 256) AS BIGINT) END AS need FROM goals),
laid AS (SELECT *, sum(need) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS upto, CAST(sum(need) OVER () AS BIGINT) AS slots FROM needs),
parts AS (SELECT *, CAST((upto - need) * 2147483648::HUGEINT // slots AS BIGINT) AS low, CAST(upto * 2147483648::HUGEINT // slots AS BIGINT) AS high FROM laid WHERE need > 0),
points AS (SELECT slot, slot * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range(max(slots))) AS slot FROM parts)),
drawn AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM points JOIN parts ON point >= low AND point < high),
short AS (SELECT slots + src AS slot, src, unnest(range(coalesce(had, 0), need)) AS rank FROM parts LEFT JOIN (SELECT src AS s, count(*) AS had FROM drawn GROUP BY src) ON s = src),
schedule AS (SELECT slot, src, (rank % blocks) * 256 AS first, least(goal, ((rank + 1) // blocks) * source_size + ((rank + 1) % blocks) * 256) - ((rank // blocks) * source_size + (rank % blocks) * 256) AS words
  FROM (SELECT * FROM drawn UNION ALL SELECT * FROM short) JOIN parts USING (src)),
placed AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15), doc_id NULLS FIRST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM sized),
lines AS (SELECT doc_id, size, source_size, target, src, start FROM placed JOIN goals ON placed.source IS NOT DISTINCT FROM goals.source),
met AS (SELECT lines.src, lines.start, lines.doc_id, lines.size, slot, least(start + size, first + words) - greatest(start, first) AS words FROM lines JOIN schedule ON lines.src = schedule.src AND start < first + words AND start + size > first WHERE words > 0),
sums AS (SELECT src, start, doc_id, size, sum(words) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM met GROUP BY ALL)
SELECT lines.doc_id, lines.size, source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot, coalesce(n_slots, 0) AS n_slots
FROM lines LEFT JOIN sums ON lines.size > 0 AND lines.src = sums.src AND lines.start = sums.start AND lines.size = sums.size AND lines.doc_id IS NOT DISTINCT FROM sums.doc_id
"""

ORACLE_SQL["op4_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM c),
e AS (SELECT *, length(regexp_replace(r, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + length(regexp_replace(t, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + 20 AS n FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op7_sharding"] = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 4 AS arrival FROM documents
"""

ORACLE_SQL["op9_url_filter"] = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
f AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

ORACLE_SQL["op3_embedding_dedup"] = """
WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM good UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(component_id, e.vec_id) AS BIGINT) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.a LEFT JOIN counts ON e.vec_id = counts.a
"""

ORACLE_SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CAST(least(d.doc_id, coalesce(least.b, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON d.doc_id = least.a
"""
