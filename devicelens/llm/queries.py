"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm import (
    chat_format,
    collocations,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    html_extract,
    language,
    mixing,
    packing,
    quality,
    simhash,
    token_files,
    url_filter,
)
from devicelens.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

# The listed URL rules (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, tokenizer_path("piece_bpe_32k.model"))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 9))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).drop("fp")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired_all(turns, conversation_repair.damage(turns))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


OP5_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER () AS n FROM conversations),
participants AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
shown AS (
  SELECT s.*, perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user' END
           AS chat_role,
         CASE WHEN speaker NOT IN (perspective, 'system') THEN speaker END AS name
  FROM said s JOIN participants p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|' || chat_role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM shown),
whole AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, length(segment) AS length,
         (sum(length(segment)) OVER (PARTITION BY conv_id, perspective
            ORDER BY turn NULLS FIRST, speaker, text, n ROWS UNBOUNDED PRECEDING))::BIGINT - length(segment) AS start
  FROM whole)
SELECT conv_id, perspective, turn, speaker, chat_role, name, segment, start, length,
       start + length(head) AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN length - length(head) ELSE 0 END AS mask_length
FROM placed
"""

OP7_SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         row_number() OVER () AS n
  FROM pages),
ranked AS (
  SELECT s.*, r.rhost || r.rpath AS rule, r.verdict AS found,
         row_number() OVER (PARTITION BY n ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(rhost) DESC)
           AS place
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rhost OR s.host LIKE '%.' || r.rhost) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(found, 'allow') AS verdict FROM ranked WHERE place = 1
"""

OP8_SQL = f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * 1.0 * sum(size) OVER () / size AS rate FROM sizes),
spans AS (
  SELECT source, rate, greatest(0, floor(rate - {mixing.SPREAD} * (sqrt(rate) + 1)))::BIGINT AS least,
         ceil(rate + {mixing.SPREAD} * (sqrt(rate) + 1))::BIGINT AS most FROM rates),
counts AS (SELECT source, rate, least, unnest(range(least, most + 1)) AS k FROM spans),
heights AS (
  SELECT *, sum(CASE WHEN k = least THEN 0.0 ELSE ln(rate / k) END)
              OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS height FROM counts),
masses AS (SELECT *, exp(height - max(height) OVER (PARTITION BY source)) AS mass FROM heights),
cdfs AS (
  SELECT source, rate, least, max(k) OVER (PARTITION BY source) AS most, k,
         sum(mass) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)
           / sum(mass) OVER (PARTITION BY source) AS cdf FROM masses),
uniform AS (
  SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
              / {1 << 52}.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate,
         least(any_value(c.least) + count(*) FILTER (c.cdf <= u), any_value(c.most)) AS copies
  FROM uniform d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy, copies, round(rate, 9) AS rate,
       ('0x' || substr(md5('{mixing.SEED}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT
         AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""

OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)
"""

OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM split GROUP BY lang),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
grams AS (
  SELECT lang, list_slice(words, i, i + m - 1) AS words
  FROM (SELECT *, unnest(range(1, 6)) AS m FROM starts) WHERE i + m - 1 <= len(words)),
counts AS (SELECT lang, words, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
cuts AS (
  SELECT lang, words, f AS a, k, list_slice(words, 1, k) AS head, list_slice(words, k + 1, len(words)) AS tail
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM counts WHERE len(words) > 1)),
scored AS (
  SELECT c.lang, c.words, c.a, x.f AS l, y.f AS r, n, 1000 * c.a * n // (x.f * y.f) AS score, k
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.words = c.head
    JOIN counts y ON y.lang = c.lang AND y.words = c.tail JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
within AS (
  SELECT lang, list_slice(words, i, i + m - 1) AS words, max(f) AS longer
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, len(words))) AS m FROM counts WHERE len(words) > 2))
  GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.words, ' ') AS phrase
  FROM best b LEFT JOIN within w ON w.lang = b.lang AND w.words = b.words WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= {collocations.TOP}
"""

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_packing": op6_packing,
    "op7_url_filters": op7_url_filters,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op5_chat_formatting": OP5_SQL,
    "op7_url_filters": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_phrase_collocations": OP11_SQL,
}
