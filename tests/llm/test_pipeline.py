"""The pipeline's stages, each on its own input, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from llm import decontamination, line_dedup, near_dedup
from llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stage(spark, docs, DATA).persist()
        n = docs.count()
        assert n <= before, name
        if name == "line_dedup":
            assert n == before and line_dedup.removed_lines(docs.where("text <> ''")).count() <= line_dedup.removed_lines(given).count() // 10
        elif name == "near_dedup":
            assert near_dedup.near_duplicates(docs).where("NOT kept").count() == 0
        elif name == "decontamination":
            assert decontamination.contaminations(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
        assert docs.columns == (columns if name != "sentencepiece" else [*columns, "piece_ids"])
        before = n
    assert 0 < corpus_pipeline.run(spark, DATA).count() == before


def test_stages_on_odd_rows(spark, documents):
    """Rows without id or text, repeated rows and clashing columns: what each stage's docstring says, and nothing else goes."""
    odd = spark.createDataFrame([(None, "A text that has no id and some words of its own to keep"), (None, None), (800, None), (801, "")], "doc_id long, text string")
    docs = documents.unionByName(odd, allowMissingColumns=True)
    kept = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((str(r.doc_id) for r in df.select("doc_id").collect()))
    lines = kept["line_dedup"](spark, docs, DATA)
    assert ids(lines) == ids(docs) and lines.columns == docs.columns
    near = kept["near_dedup"](spark, docs, DATA)
    assert ids(near).count("None") == 2 and ids(near).count("7") == 0 and {"800", "801", "6"} <= set(ids(near)) and near.columns == docs.columns
    clean = kept["decontamination"](spark, docs, DATA)
    assert ids(clean) == ids(docs)
    encoded = kept["sentencepiece"](spark, docs, DATA)
    assert ids(encoded) == ids(docs) and all(r.piece_ids == [] for r in encoded.where("text IS NULL OR text = ''").collect())
    scored = kept["quality_classifier"](spark, docs, DATA)
    assert set(ids(scored)) <= set(ids(docs)) and scored.columns == docs.columns


def test_stages_on_an_empty_table(spark, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0, name


#: Columns that the contracts name, in their order, and their kinds.
CONTRACTS = {
    "op1_token_blocks": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_substring_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op11_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_source_audit": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_of_contracts(spark, name):
    kinds = [f"{c} {k}" for c, k in entry.queries()[name](spark, DATA).dtypes]
    expected = CONTRACTS[name].split(", ")
    assert kinds[: len(expected)] == expected


def test_rows_of_the_classifier(spark):
    import zlib

    from llm.quality_classifier import THRESHOLD

    rows = QUERIES["op8_quality_classifier"](spark, DATA).collect()
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in rows) == ids
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= THRESHOLD) and 0 <= r.score <= 1


def test_rows_of_the_derivatives(spark):
    """Every registered column, against records derived page by page."""
    import zlib

    from llm import warc

    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()
    expected = set()
    for page in pages:
        for record in warc.derivatives(warc.response_record(*page)):
            fields, block = next(warc.read_records(record))
            at = lambda name, fields=fields: warc.field(fields, name)
            names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest", "Source-WARC-Payload-Digest")
            expected.add((page.page_id, *map(at, names), len(block), zlib.crc32(block)))
    found = {tuple(r) for r in QUERIES["op10_warc_derivatives"](spark, DATA).collect()}
    assert found == expected and len(found) == 2 * len(pages)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for table in ("pages", "documents"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        expected = con.sql(ORACLE[name])
        assert sorted(expected.columns) == sorted(df.columns)
        assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r[c] for c in expected.columns)) for r in rows)
