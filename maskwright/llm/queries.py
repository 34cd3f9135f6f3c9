"""Queries of the training-data operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.llm import (
    alignment, common, decontaminate, host_rules, importance, language, licenses, packing, quality, run_index, simhash,
    substrings, token_files, warc,
)
from maskwright.plans.corpora import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def remainder(key, n):
    """crc32 of a number as text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


@query("op6_host_rules", r"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    grams AS (
        SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i,
            unnest(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram
        FROM docs WHERE len(words) >= 5),
    repeated AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM grams),
    repeat_words AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM repeated, (SELECT unnest(generate_series(0, 4)) AS k) WHERE times > 1 GROUP BY doc_id),
    base AS (
        SELECT doc_id, source, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
            len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))
                AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM docs LEFT JOIN repeat_words USING (doc_id)),
    failed AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
    hosts AS (
        SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY source),
    sums AS (
        SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2
            - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS spread FROM hosts),
    prior AS (
        SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1e-3::DOUBLE), 1e6::DOUBLE)
            ELSE 1e6::DOUBLE END AS strength FROM sums),
    rates AS (SELECT source, round((f + mean * strength) / (n + strength), 6) AS host_rate FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
        NOT base_failed AND host_rate <= 0.5 AS kept
    FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source""")
def op6_host_rules(spark, sf):
    return host_rules.judge(table(spark, sf, "documents"))


@query("op2_license_notices")
def op2_license_notices(spark, sf):
    return licenses.summary(licenses.scan(table(spark, sf, "documents"))).drop("notices")


@query("op10_language_profiles")
def op10_language_profiles(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = remainder("doc_id", 4) == 2
    names, profiles = language.learn(docs, ~held_out)
    predicted = language.predict(docs, names, profiles)
    return predicted.withColumn("held_out", held_out)


@query("op7_rule_ensemble")
def op7_rule_ensemble(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels, remainder("_label_key", 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


@query("op1_spaced_seeds")
def op1_spaced_seeds(spark, sf):
    found = decontaminate.contaminated(table(spark, sf, "documents"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.withColumn("n_spans", F.size("spans")).drop("spans")


@query("op3_shortest_pack_first")
def op3_shortest_pack_first(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), "word_bpe_49k.json", 2)


@query("op4_pigeonring_simhash")
def op4_pigeonring_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op5_seed_and_extend")
def op5_seed_and_extend(spark, sf):
    return substrings.keep_first(table(spark, sf, "documents")).drop("kept")


@query("op9_huffman_ids")
def op9_huffman_ids(spark, sf):
    folder = common.shared_folder(spark, "ids")
    token_files.write_documents(table(spark, sf, "documents"), folder, "byte_bpe_50k.json", 0)
    return token_files.digests(token_files.read_ids(spark, folder))


@query("op8_boundary_chains", r"""
    WITH sums AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    parts AS (
        SELECT page_id, payload_bytes, hex,
            list_transform(generate_series(0, 7), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT) AS p FROM sums),
    named AS (
        SELECT page_id, payload_bytes, array_to_string(list_transform(p, lambda x:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)
            ), '') AS payload_digest,
            max(page_id) OVER (PARTITION BY hex) AS first FROM parts)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id != first THEN first END AS refers_to
    FROM named""")
def op8_boundary_chains(spark, sf):
    folder = common.shared_folder(spark, "warc")
    warc.write(spark.read.parquet(f"{sf}/pages.parquet"), folder)
    number = "cast(nullif(replace({}, 'urn:page:', ''), '') AS bigint)".format
    return warc.read(spark, folder).selectExpr(
        f"{number('record_id')} AS page_id", "http_length AS payload_bytes", "payload_digest", "record_type",
        f"{number('refers_to')} AS refers_to",
    )


@query("op11_importance_resampling")
def op11_importance_resampling(spark, sf):
    return importance.resample(table(spark, sf, "documents"), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op12_run_length_index")
def op12_run_length_index(spark, sf):
    return run_index.remove_repeats(table(spark, sf, "documents"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf):
    return alignment.compare(table(spark, sf, "documents"))
