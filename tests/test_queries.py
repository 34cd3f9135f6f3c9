"""Registered queries against their SQL on the smallest data set."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "src_html_text src_file_dispatch doc_stats code_stats scan_report context_boost overlap_resolve "
    "overlap_conflicts mask_docs mask_people vault_build vault_roundtrip restore_docs unresolved "
    "vault_sessions mask_sessions vault_append vault_corpus mask_with_gazetteers allowlist user_hook "
    "mask_code snippets fp_filter shared_values_approx vuln_scan vuln_import vuln_ranked final_status exposure_rollup shared_values stream_vault "
    "src_mail_base64 src_mail_quoted src_mail_nested src_xml_errors fp_kinds restore_long vault_sparse_sequence gazetteer_person src_json_odd sink_masked sink_restored "
    "user_rules_grouped user_code_languages type_counts_sorted gazetteer_nrp"
).split()

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "region nation customer orders part documents pages conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    # the training-data operators, which may be left out, have queries that SQL cannot express
    assert {n for n in set(queries) - set(sqls) if not re.match(r"op\d+_|pipeline$", n)} == set()


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert got == want and got


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
