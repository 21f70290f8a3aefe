"""The registered queries of the text operators, over whole tables, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import alignment, byte_bpe, chat_format, decontaminate, lexical, license_scan, pseudonyms, quality_bayes, repetition, sharding, simhash_dedup, token_files, url_filter
from tablewright.llm.batches import small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Stands in for the secret that a deployment passes to ``pseudonymise``.
KEY = b"tablewright example key"

#: The host rules of the query.
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: The list of the query: canonical URLs of the pages on such hosts.
LISTED_HOSTS = "(spam-farm|cheap-pills|free-bets)[.]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.select(url_filter.canonical(F.col("url")).alias("canonical")).where(F.col("canonical").rlike(LISTED_HOSTS)).distinct()
    return url_filter.judge(pages, listed, RULES).drop("maybe")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents")))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.digests(chat_format.format_turns(rows.union(own))).withColumnRenamed("conv", "conv_id")


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", pseudonyms.hidden(F.col("text"), KEY).alias("h"))
    return docs.select("doc_id", "h.text", "h.n_replaced")


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summary(_table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECE_MODEL)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), BYTE_LEVEL)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_license_scan, op3_shards, op4_chat_format, op5_quality_bayes, op6_decontaminate, op7_simhash_dedup,
        op8_byte_bpe, op9_pseudonyms, op10_repetition, op11_lexical_search, op12_token_alignment, op13_token_files,
    )
}

#: The same results in DuckDB's SQL; the other operators are held against brute force in tests/llm.
CHECKS: dict[str, str] = {
    "op1_url_filter": r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*[?]([^#]*)', 1), ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))), '&') AS asked
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/$', '')
    || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(canonical, '(spam-farm|cheap-pills|free-bets)[.]')),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(verdict, rhost, rpath)),
best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(best.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best USING (page_id) LEFT JOIN l ON l.canonical = c.canonical
""",
    "op3_shards": """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 14))::BIGINT AS h
  FROM documents),
levels AS (SELECT doc_id, bytes, depth::INTEGER AS depth, h >> (56 - depth) AS bucket FROM d, range(0, 57) AS t(depth)),
sizes AS (SELECT depth, bucket, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n FROM levels GROUP BY ALL)
SELECT doc_id, bytes, depth, bucket, 0::BIGINT AS page, shard_bytes
FROM levels JOIN sizes USING (depth, bucket) WHERE shard_bytes <= 1048576 OR n = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""",
    "op4_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, '### ' || role || ': ' || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || ' </turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w)::BIGINT AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN wt USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
""",
}
