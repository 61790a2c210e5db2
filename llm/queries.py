"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    decontamination,
    line_dedup,
    near_dedup,
    oracles,
    pieces,
    quality_classifier,
    quality_rules,
    sharding,
    source_audit,
    substring_dedup,
    token_alignment,
    token_blocks,
    url_filter,
    warc,
)
from llm.tables import bounded, read


def tokenizer_file(name: str) -> str:
    """A public vocabulary file; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encoded(spark, read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules.judge(documents, quality_rules.fit(documents, labels))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


#: The rules that op6 is asked to apply, by verdict.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.table_of(spark, URL_RULES, ((p, "block") for p in url_filter.SPAM))
    return url_filter.judge(read(spark, sf_dir, "pages"), rules)


def _op6_sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, _, p in (r.partition("/") for r, _ in sorted(URL_RULES, key=lambda r: -len(r[0])))]
    blocked = ", ".join(f"'{r}'" for r, v in URL_RULES if v == "block")
    patterns = []
    for rule in sorted(url_filter.SPAM):
        body = ".*".join(f"(?:^|[^a-z0-9]){part}(?:[^a-z0-9].*|$)" for part in rule.split("*"))
        patterns.append(f"WHEN regexp_matches(lower(host || path), '{body}') THEN '{rule}'")
    return f"""
WITH parts AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule, CASE {' '.join(patterns)} END AS pattern FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NULL AND pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM ruled"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    cleaned = line_dedup.without_lines(documents, line_dedup.removed_lines(documents), figures=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept", F.lit("")).cast("binary")).alias("kept_md5"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learns = quality_classifier.fold() != 0
    machine = quality_classifier.fit(documents, labels, metadata=("n_chars",), where=learns)
    scored = quality_classifier.score(documents, machine, metadata=("n_chars",))
    return scored.select("doc_id", (quality_classifier.fold() == 0).alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_spans(read(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivative_records(read(spark, sf_dir, "pages"))
    size, checksum = F.octet_length("content").cast("long").alias("n_bytes"), F.crc32("content").alias("content_crc32")
    return records.select("page_id", "type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "source_payload_digest", size, checksum)


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = sharding.measured(read(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "size", "text_crc32")
    return sharding.sharded(metadata).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.statistics(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(read(spark, sf_dir, "documents"))


def _query(operator: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded(spark)
        return operator(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_blocks": _query(op1_token_blocks),
    "op2_sentencepiece": _query(op2_sentencepiece),
    "op3_quality_rules": _query(op3_quality_rules),
    "op4_benchmark_decontamination": _query(op4_benchmark_decontamination),
    "op5_minhash_near_dedup": _query(op5_minhash_near_dedup),
    "op6_url_filter": _query(op6_url_filter),
    "op7_line_dedup": _query(op7_line_dedup),
    "op8_quality_classifier": _query(op8_quality_classifier),
    "op9_substring_dedup": _query(op9_substring_dedup),
    "op10_warc_derivatives": _query(op10_warc_derivatives),
    "op11_hilbert_shards": _query(op11_hilbert_shards),
    "op12_token_alignment": _query(op12_token_alignment),
    "op13_source_audit": _query(op13_source_audit),
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op5_minhash_near_dedup": oracles.NEAR_DEDUP, "op6_url_filter": _op6_sql(), "op7_line_dedup": oracles.LINE_DEDUP,
    "op11_hilbert_shards": oracles.sharding(sharding.SHARDS, sharding.BITS), "op13_source_audit": oracles.source_audit(source_audit.MIN_DOCS, source_audit.SMOOTH, source_audit.UNIT, source_audit.TOP)}
