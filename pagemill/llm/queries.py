"""The queries opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import chunks, clusters, langid, lexicon, licenses, media, packing, pii, quality, quality_rules, simhash, sql, toxicity, turns

#: The key of surrogates; a deployment sets its own.
PII_KEY = "pagemill-demonstration-key"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(_table(spark, sf_dir, "documents"))


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, path = _table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    return lexicon.encode_documents(documents, path, lexicon.build_lexicon(documents, path))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.learn(documents))


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings")).drop("n_compared")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_toxicity, op2_simhash, op3_quality_rules, op4_packing, op5_pii, op6_quality, op7_media, op8_chunks, op9_lexicon, op10_langid, op11_annulus, op12_licenses, op13_prefix_trie)
    return {f.__name__: f for f in made}


def _quality_rules_sql() -> str:
    """The rules from their definition: windows as strings, counted within each document."""
    lengths = sorted(quality_rules.LIMITS)
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, array_to_string(words[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM d WHERE len(words) >= {n})" for n in lengths)
    shares = ", ".join(f"coalesce(max(chars) FILTER (n = {n}), 0) AS chars_{n}" for n in lengths)
    ratio = ", ".join(f"coalesce(chars_{n}, 0) / greatest(word_chars, 1) AS share_{n}" for n in lengths)
    verdict = " AND ".join([f"line_share <= {quality_rules.LINE_LIMIT}::DOUBLE", *[f"share_{n} <= {x}::DOUBLE" for n, x in quality_rules.LIMITS.items()]])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS ({grams}),
h AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM g) WHERE times > 1),
c AS (SELECT doc_id, n, sum(length(word)) AS chars, count(*) AS words FROM h JOIN w USING (doc_id, i) GROUP BY doc_id, n),
s AS (SELECT doc_id, {shares}, coalesce(max(words) FILTER (n = 5), 0) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS line_chars FROM (
  SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE nth > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, {ratio}, coalesce(line_chars, 0) / greatest(word_chars, 1) AS line_share FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {verdict} AS kept, {", ".join(f"share_{n}" for n in quality_rules.LIMITS)}, line_share FROM b"""


def oracle_sql() -> dict[str, str]:
    """Of the others SQL is too slow or can't express them on whole tables; tests/llm holds them against brute force."""
    return {"op3_quality_rules": _quality_rules_sql(), "op11_annulus": sql.annulus(), "op12_licenses": sql.license_scan(), "op13_prefix_trie": sql.prefix_trie()}


def with_length(documents: DataFrame) -> DataFrame:
    """documents with n_chars of the text as it now is."""
    return documents.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else documents
