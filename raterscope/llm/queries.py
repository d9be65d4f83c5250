"""Registered queries of the training-data operators, one for each, and their SQL where it exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations,
    decontamination,
    extraction,
    licenses,
    merkle,
    near_duplicates,
    packing,
    secrets,
    sharding,
    stages,
    token_counts,
    toxicity,
    vector_codes,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

# Shards for training readers: small enough that a reader holds several.
SHARD_BYTES = 256 << 10


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.cache
def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document. The ledger's method adds no spans of its own: ``spans`` are the base ones."""
    found = secrets.scan(_table(spark, folder, "documents"))
    text = secrets.spans_text("findings")
    return found.select(
        "doc_id",
        *[secrets.count_kind("findings", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(text, 256).alias("base_sha256"),
        text.alias("spans"),
    )


def op2_token_count(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary."""
    return token_counts.count_tokens(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    pages = _table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    read = warc.read_archives(warc.write_archives(pages))
    return read.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontamination.find_matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return decontamination.judge(found)


def op6_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its neighbour."""
    return merkle.fingerprints_with_next(_table(spark, folder, "documents"))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of three words are at least 90 percent alike."""
    return near_duplicates.components(_table(spark, folder, "documents"), width=3, percent=90)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(_table(spark, folder, "documents")).drop("places")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign_shards(_table(spark, folder, "documents"), SHARD_BYTES)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, under codebooks fitted on all of them."""
    return vector_codes.compress(_table(spark, folder, "embeddings"))


def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, folder, "pages")
    return extraction.extract(pages, extraction.train(pages))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    damaged = conversations.damage(_table(spark, folder, "conversations"))
    return conversations.repaired_digests(damaged).withColumnRenamed("conv", "conv_id")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return stages.run(spark, folder)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_secret_scan,
        op2_token_count,
        op3_warc,
        op4_best_fit_packing,
        op5_decontamination,
        op6_merkle,
        op7_ngram_jaccard,
        op8_license_scan,
        op9_toxicity,
        op10_shards,
        op11_vector_codes,
        op12_html_extraction,
        op13_conversation_repair,
        pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": SECRET_SQL,
        "op5_decontamination": CONTAMINATION_SQL,
        "op7_ngram_jaccard": COMPONENTS_SQL,
        "op10_shards": sharding.ORACLE.format(limit=SHARD_BYTES),
        "op11_vector_codes": vector_codes.ORACLE,
        "op13_conversation_repair": conversations.ORACLE,
    }


def _secret_sql() -> str:
    """Hits by position: the texts between them come from a split on the same expression."""
    parts = []
    for i, rule in enumerate(secrets.RULES):
        # RE2 has no \\x20 difference; quotes are doubled for SQL.
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {i} AS rank, '{rule.kind}' AS kind, {rule.min_chars} AS least,
  string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
  regexp_extract_all(t, '{pattern}', {rule.group}) AS tested FROM texts"""
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(parts)}),
hit AS (
  SELECT doc_id, rank, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, tested FROM pieces),
span AS (
  SELECT doc_id, rank, kind,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
    length(hits[i]) AS n
  FROM hit WHERE length(tested[i]) >= least),
doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM span GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN doc USING (doc_id)"""


SECRET_SQL = _secret_sql()

# Only A-Z become lower case; lower() would change other letters, too.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALPHANUMERIC = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+')"

# Windows of the items, joined to all windows of as many words of the documents.
CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_ALPHANUMERIC} AS w FROM documents),
b AS (SELECT item_id, {_ALPHANUMERIC} AS w FROM benchmark),
i AS (SELECT item_id, least(13, len(w)) AS k, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, w[s:s + k - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
dw AS (SELECT doc_id, s, k, w[s:s + k - 1] AS win FROM p, (SELECT DISTINCT k FROM iw) WHERE s + k - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, s, k, item_id FROM dw JOIN iw USING (k, win)),
word AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""

# Overlaps by a join on shingles, and what each document reaches over the links.
COMPONENTS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"""
