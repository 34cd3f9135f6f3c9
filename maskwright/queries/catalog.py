"""Every registered query: a Spark callable and, where SQL can say it, the same in SQL.

All of them read whole tables or corpora that Spark derives from whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as fn
from ..functions.spans import resolve_overlaps, with_once
from ..operators import filters, joins, mask, recognizers, report, restore, scan, sessions
from ..plans import corpora
from ..rules import (
    CODE_KINDS, DOCUMENT_KINDS, ENTITY_LABELS, PII_RULES, SECRET_RULES, VULNERABILITY_RULES, CodeRule,
    SpanRule, select_rules,
)
from ..sources import formats, readers, records, sinks, vaults
from ..streaming import streams
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


ENABLED = select_rules()
FINDING_OUT = ("doc_id", "entity", "label", "rule", "start", "end", "score", "value")
VAULT_OUT = "doc_id AS session_id, placeholder, label, n, value, seq"


def corpus(name: str):
    return {
        "people": (corpora.people, corpora.PEOPLE_SQL),
        "documents": (corpora.documents, o.DOCUMENTS_SQL),
        "code": (corpora.code, corpora.CODE_SQL),
        "chat": (corpora.chat, corpora.CHAT_SQL),
    }[name]


def masked_people(spark, sf):
    return mask.mask_documents(corpora.people(spark, sf))


def masked_documents(spark, sf):
    return mask.mask_documents(corpora.documents(spark, sf).select("doc_id", "source", "lang", "text"))


def masked_code(spark, sf):
    return mask.mask_code(corpora.code(spark, sf))


def written(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked texts and vault as tables of their own, as a later restore finds them."""
    kept = joins.checkpointed(done.select("doc_id", "masked", "vault"))
    return kept.select("doc_id", "masked"), mask.explode_vault(kept, "doc_id")


PEOPLE_SETTLED = o.with_settled(corpora.PEOPLE_SQL, ENABLED)
DOCUMENTS_SETTLED = o.with_settled(o.DOCUMENTS_SQL, ENABLED)
CODE_SETTLED = o.with_settled(corpora.CODE_SQL, SECRET_RULES, clean=False, boost=0)

# ---------------------------------------------------------------- sources


@query("src_csv_lines", """
    SELECT c_custkey AS doc_id,
           concat_ws(' | ', CAST(c_custkey AS VARCHAR), c_name, nullif(trim(c_mktsegment), '')) AS text
    FROM customer""")
def src_csv_lines(spark, sf):
    rows = corpora.table(spark, sf, "customer")
    return readers.table_lines(rows, ["c_custkey", "c_name", "c_mktsegment"]).select(
        F.col("c_custkey").alias("doc_id"), "text"
    )


@query("src_csv_records", """
    SELECT c_custkey AS doc_id,
           c_custkey || ' | ' || c_name || chr(10) || chr(10) || 'said "' || c_mktsegment || '", twice' || chr(10)
               || c_nationkey || ' | ' || trim(c_mktsegment) AS text
    FROM customer""")
def src_csv_records(spark, sf):
    """Records of four lines each, written as CSV files and read back in splits."""
    folder = scratch(spark)
    record = F.format_string(
        '%d,"%s\n\nsaid ""%s"", twice\n%d" , %s,,', "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_mktsegment"
    )
    corpora.table(spark, sf, "customer").select(record.alias("value")).write.text(folder)
    back = records.read_csv_records(spark, folder)
    return back.select(F.split("text", " [|] ")[0].cast("bigint").alias("doc_id"), "text")


@query("src_html_text", f"""
    SELECT page_id AS doc_id,
           {o.strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[' || chr(160) || '\\s]{2,}', chr(10), 'g')")} AS text
    FROM pages""")
def src_html_text(spark, sf):
    return corpora.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), formats.html_text(F.col("html")).alias("text")
    )


@query("src_json_compact", f"SELECT p_partkey AS doc_id, json({corpora.REPORT_JSON})::VARCHAR AS text FROM part")
def src_json_compact(spark, sf):
    return corpora.reports(spark, sf).select("doc_id", formats.json_compact(F.col("report")).alias("text"))


@query("src_file_dispatch", f"SELECT c_custkey AS doc_id, {corpora.FILE_EXT} AS ext, {corpora.FILE_TEXT} AS text FROM customer")
def src_file_dispatch(spark, sf):
    return readers.with_document_text(corpora.files(spark, sf)).select("doc_id", "ext", "text")


def _file_kind(ext: str, kind: str) -> None:
    @query(f"src_file_{ext}", f"""
        SELECT c_custkey AS doc_id, {lit(kind)} AS kind, {corpora.FILE_TEXT} AS text
        FROM customer WHERE {corpora.FILE_EXT} = '{ext}'""")
    def build(spark, sf):
        files = corpora.files(spark, sf).where(F.col("ext") == ext)
        return readers.with_document_text(files).select("doc_id", "kind", "text")


lit = o.lit
for _ext in ("txt", "md", "csv", "html", "json", "xml", "eml"):
    _file_kind(_ext, DOCUMENT_KINDS[_ext])
_file_kind("log", ".log file")


_JSON_ODD = (
    "'{\"a\": NaN, \"k\": ' || c_custkey || ', \"a\": {\"x\": 1, \"y\": [Infinity, {\"q\": 1, \"q\": 2}], \"x\": \"' || c_name || "
    "'\"}, \"k\": -Infinity, \"z\": ' || CASE WHEN c_custkey % 5 = 0 THEN 'oops' ELSE '{\"x\": []}' END || '}'"
)


@query("src_json_odd", """
    SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'invalid JSON' END AS error,
        CASE WHEN c_custkey % 5 != 0 THEN replace(replace(
            '{|  "a": {|    "x": "@",|    "y": [|      Infinity,|      {|        "q": 2|      }|    ]|  },|  "k": -Infinity,|  "z": {|    "x": []|  }|}',
            '|', chr(10)), '@', c_name) END AS text
    FROM customer""")
def src_json_odd(spark, sf):
    files = corpora.table(spark, sf, "customer").selectExpr("c_custkey AS doc_id", "'json' AS ext", f"{_JSON_ODD} AS raw")
    return readers.with_document_text(files).select("doc_id", "error", "text")


_MAIL_HEAD = "'From: a' || doc_id || '@example.com' || chr(10) || 'Subject: s' || chr(10)"
_MAIL_TEXT = f"{_MAIL_HEAD} || CASE WHEN text = '' THEN '' ELSE chr(10) || text END"


def _mails(spark, sf, body: str, headers: str) -> DataFrame:
    """Mails whose body is made of the whole text of a document."""
    raw = f"{_MAIL_HEAD} || '{headers}' || chr(10) || chr(10) || {body}"
    mails = corpora.documents(spark, sf).selectExpr("doc_id", f"{raw} AS raw")
    # a filter on the text does not read the mail again
    return with_once(mails, "text", formats.mail_text(F.col("raw"))).select("doc_id", "text")


@query("src_mail_base64", f"SELECT doc_id, {_MAIL_TEXT} AS text FROM documents WHERE text IS NOT NULL")
def src_mail_base64(spark, sf):
    return _mails(
        spark, sf, "base64(encode(text, 'UTF-8'))", "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: BASE64"
    ).where("text IS NOT NULL")


_QUOTED = "replace(replace(url_encode(text), '+', ' '), '%', '=')"
_QUOTED_LINES = f"regexp_replace({_QUOTED}, '((?:=[0-9A-F]{{2}}|[^=]){{70}})', '$1=\n')"


@query("src_mail_quoted", f"SELECT doc_id, {_MAIL_TEXT} AS text FROM documents WHERE text IS NOT NULL")
def src_mail_quoted(spark, sf):
    return _mails(
        spark, sf, _QUOTED_LINES, "Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable"
    ).where("text IS NOT NULL")


_NESTED = (
    "'no part of it' || chr(10) || '--out' || chr(10) || 'Content-Type: application/octet-stream' || chr(10) || chr(10) || "
    "'--in' || chr(10) || 'not open yet' || chr(10) || '--out' || chr(10) || "
    "'Content-Type: multipart/alternative; boundary=\"in er\"' || chr(10) || chr(10) || '--in er' || chr(10) || "
    "'Content-Type: text/html' || chr(10) || chr(10) || '<p>page</p>' || chr(10) || '--in er' || chr(10) || "
    "'Content-Type: text/plain' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || "
    "base64(encode('--out' || chr(10) || text, 'UTF-8')) || chr(10) || '--in er--' || chr(10) || 'epilogue' || chr(10) || "
    "'--out' || chr(10) || chr(10) || 'second plain part' || chr(10) || '--out--' || chr(10)"
)


@query("src_mail_nested", f"SELECT doc_id, {_MAIL_HEAD} || chr(10) || '--out' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL")
def src_mail_nested(spark, sf):
    return _mails(spark, sf, _NESTED, 'Content-Type: multipart/mixed;\n boundary="out"').where("text IS NOT NULL")


_XML_ROW = "'<r k=\"' || CAST(c_custkey AS VARCHAR(20)) || '\"><n>' || c_name || '</n>"
_XML_RAW = (
    f"CASE c_custkey % 9 WHEN 0 THEN {_XML_ROW}</r>' WHEN 1 THEN {_XML_ROW}' WHEN 2 THEN {_XML_ROW}</s>' "
    f"WHEN 3 THEN {_XML_ROW}</r><r/>' WHEN 4 THEN {_XML_ROW} a & b</r>' WHEN 5 THEN {_XML_ROW} 1 < 2</r>' "
    f"WHEN 6 THEN {_XML_ROW}</r> after' WHEN 7 THEN {_XML_ROW}<q a=\"1\" a=\"2\"/></r>' ELSE c_name END"
)


@query("src_xml_errors", """
    SELECT c_custkey AS doc_id, CASE c_custkey % 9 WHEN 1 THEN 'elements do not match' WHEN 2 THEN 'elements do not match'
        WHEN 3 THEN 'more than one root' WHEN 4 THEN 'broken entity' WHEN 5 THEN 'broken tag' WHEN 6 THEN 'text outside the root'
        WHEN 7 THEN 'repeated attribute' WHEN 8 THEN 'no element' END AS error,
        CASE c_custkey % 9 WHEN 0 THEN '<r k="' || CAST(c_custkey AS VARCHAR(20)) || '">' || chr(10) || '  <n> ' || c_name END AS text
    FROM customer""")
def src_xml_errors(spark, sf):
    files = corpora.table(spark, sf, "customer").selectExpr("c_custkey AS doc_id", "'xml' AS ext", f"{_XML_RAW} AS raw")
    return readers.with_document_text(files).select("doc_id", "error", "text")


@query("kind_labels", f"""
    SELECT doc_id, CASE ext WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' ELSE '.conf file' END AS kind
    FROM ({corpora.CODE_SQL})""")
def kind_labels(spark, sf):
    return corpora.code(spark, sf).select("doc_id", fn.kind_label(F.col("ext"), CODE_KINDS).alias("kind"))


# ---------------------------------------------------------------- projections


@query("doc_stats", """
    SELECT doc_id,
           len(list_filter(string_split_regex(text, '[\\s\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}]+'), lambda w: w <> ''))::INTEGER AS word_count,
           length(text)::INTEGER AS char_count
    FROM documents""")
def doc_stats(spark, sf):
    text = F.col("text")
    return corpora.documents(spark, sf).select(
        "doc_id", fn.word_count(text).alias("word_count"), F.length(text).alias("char_count")
    )


@query("code_stats", f"""
    SELECT doc_id,
           (len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INTEGER AS line_count,
           length(text)::INTEGER AS char_count
    FROM ({corpora.CODE_SQL})""")
def code_stats(spark, sf):
    text = F.col("text")
    return corpora.code(spark, sf).select(
        "doc_id", fn.line_count(text).alias("line_count"), F.length(text).alias("char_count")
    )


@query("blank_documents", f"""
    SELECT doc_id, '' AS masked FROM ({corpora.PEOPLE_SQL}) WHERE NOT regexp_matches(text, '\\S')""")
def blank_documents(spark, sf):
    people = corpora.people(spark, sf).where(fn.is_blank(F.col("text")))
    return mask.mask_documents(people).select("doc_id", "masked")


# ---------------------------------------------------------------- PII scans


def _scan_query(name: str, corpus_name: str, rules, **options) -> None:
    load, sql = corpus(corpus_name)
    entities = sorted({r.entity for r in rules})

    @query(name, o.scan_sql(sql, rules))
    def build(spark, sf):
        found = scan.scan(load(spark, sf).select("doc_id", "text"), rules=rules, entities=entities, **options)
        return scan.explode_findings(found, ["doc_id"]).select(*FINDING_OUT)


for _entity in ENTITY_LABELS:
    _rules = select_rules(entities=[_entity])
    if _rules:
        _scan_query(f"scan_{_entity.lower()}", "people", _rules)
for _rule in PII_RULES:
    _scan_query(f"rule_{_rule.rule.lower()}", "people", (_rule,))
for _entity in ("EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS", "PHONE_NUMBER"):
    _scan_query(f"documents_{_entity.lower()}", "documents", select_rules(entities=[_entity]))


@query("scan_report", f"""
    WITH corpus AS ({o.DOCUMENTS_SQL})
    SELECT doc_id, entity AS entity_type, value, (pct / 100.0)::DECIMAL(4,2) AS score, start, stop AS "end"
    FROM ({o.span_rows(ENABLED)})""")
def scan_report(spark, sf):
    return scan.scan_report(corpora.documents(spark, sf), "doc_id")


@query("threshold_080", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL})
    SELECT {o.FINDING_SELECT} FROM ({o.span_rows(ENABLED, least=80)})""")
def threshold_080(spark, sf):
    found = scan.scan(corpora.people(spark, sf), threshold=0.8)
    return scan.explode_findings(found, ["doc_id"]).select(*FINDING_OUT)


@query("context_boost", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL}),
    plain AS ({o.span_rows(ENABLED, boost=0, least=0)}),
    boosted AS ({o.span_rows(ENABLED, least=0)})
    SELECT b.doc_id, b.rule, b.start, (p.pct / 100.0)::DECIMAL(4,2) AS base, (b.pct / 100.0)::DECIMAL(4,2) AS score
    FROM boosted b JOIN plain p ON p.doc_id = b.doc_id AND p.rule = b.rule AND p.start = b.start
    WHERE b.pct > p.pct""")
def context_boost(spark, sf):
    base = F.create_map(*[F.lit(x) for r in PII_RULES for x in (r.rule, r.pct)])
    found = scan.scan(corpora.people(spark, sf), threshold=0.0)
    rows = scan.explode_findings(found, ["doc_id"]).withColumn(
        "base", (F.element_at(base, F.col("rule")) / F.lit(100)).cast(scan.SCORE)
    )
    return rows.where(F.col("score") > F.col("base")).select("doc_id", "rule", "start", "base", "score")


@query("pipe_clip", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL}), raw AS ({o.span_rows(ENABLED)})
    SELECT {o.FINDING_SELECT} FROM ({o.clipped_rows('raw')})""")
def pipe_clip(spark, sf):
    found = scan.scan(corpora.people(spark, sf))
    found = found.withColumn("findings", filters.clip_at_pipe(F.col("findings")))
    return scan.explode_findings(found, ["doc_id"]).select(*FINDING_OUT)


@query("fp_filter", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL}), raw AS ({o.span_rows(ENABLED)})
    SELECT {o.FINDING_SELECT} FROM raw WHERE {o.noise()}""")
def fp_filter(spark, sf):
    """The findings that FLT-4 to FLT-9 drop."""
    found = scan.scan(corpora.people(spark, sf))
    dropped = filters.false_positives(F.col("findings"))
    return scan.explode_findings(found.withColumn("findings", dropped), ["doc_id"]).select(*FINDING_OUT)


# A value for each filter and for what none of them drops.
_NOISE_ENTITY = "CASE c_custkey % 10 WHEN 2 THEN 'LOCATION' WHEN 3 THEN 'NATIONAL_ID' WHEN 4 THEN 'IBAN' WHEN 5 THEN 'URL' " \
    "WHEN 7 THEN 'LOCATION' WHEN 8 THEN 'NATIONAL_ID' ELSE 'PERSON' END"
_NOISE_VALUE = (
    f"CASE c_custkey % 10 WHEN 0 THEN upper({corpora.pick(corpora.FIRST, 'c_custkey')}) || ' ' || c_mktsegment WHEN 1 THEN ' Full Name ' "
    f"WHEN 2 THEN {corpora.pick('Mobile,Dubai,Paris', 'c_custkey')} WHEN 3 THEN 'AB' || {corpora.digits('c_custkey', 6)} "
    f"WHEN 4 THEN 'EMP' || {corpora.digits('c_custkey', 3)} WHEN 5 THEN c_name || '#' || c_mktsegment "
    f"WHEN 8 THEN 'A' || {corpora.digits('c_custkey', 7)} WHEN 9 THEN 'AB' "
    f"ELSE {corpora.pick(corpora.FIRST, 'c_custkey')} || ' ' || {corpora.pick(corpora.LAST, 'c_custkey')} END"
)


@query("fp_kinds", f"""
    SELECT c_custkey AS doc_id, entity, value, {o.noise()} AS dropped
    FROM (SELECT c_custkey, {_NOISE_ENTITY} AS entity, {_NOISE_VALUE} AS value FROM customer)""")
def fp_kinds(spark, sf):
    """FLT-4 to FLT-9 on a value for each of them."""
    rows = corpora.table(spark, sf, "customer").selectExpr(
        "c_custkey AS doc_id", f"{_NOISE_ENTITY} AS entity", f"{_NOISE_VALUE} AS value"
    )
    return rows.withColumn("dropped", filters.is_false_positive(
        F.col("entity"), F.col("value"), filters.NAME_DENYLIST, filters.LOCATION_DENYLIST
    ))


@query("overlap_resolve", f"{PEOPLE_SETTLED} SELECT {o.FINDING_SELECT} FROM kept")
def overlap_resolve(spark, sf):
    return scan.explode_findings(mask.find_pii(corpora.people(spark, sf)), ["doc_id"]).select(*FINDING_OUT)


@query("overlap_conflicts", f"""{PEOPLE_SETTLED}
    SELECT r.doc_id, r.rule, r.start, r.stop AS "end", k.rule AS kept_rule, k.start AS kept_start, k.stop AS kept_end
    FROM ranked r JOIN kept k ON k.doc_id = r.doc_id AND k.start < r.stop AND k.stop > r.start
    WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.doc_id = r.doc_id AND x.place = r.place)
    QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.place ORDER BY k.start) = 1""")
def overlap_conflicts(spark, sf):
    found = scan.scan(corpora.people(spark, sf))
    clean = filters.drop_false_positives(filters.clip_at_pipe(F.col("findings")))
    rows = scan.explode_findings(found.withColumn("findings", clean), ["doc_id"])
    return filters.conflicts(rows, "doc_id")


@query("span_rank", f"""{PEOPLE_SETTLED} SELECT doc_id, rule, start, place::INTEGER AS place FROM ranked""")
def span_rank(spark, sf):
    """SPAN-1: the total order in which overlapping findings compete."""
    found = scan.scan(corpora.people(spark, sf))
    clean = filters.drop_false_positives(filters.clip_at_pipe(F.col("findings")))
    order = F.sort_array(F.transform(clean, lambda f: F.struct(
        (-f["pct"]).alias("a"), f["start"].alias("b"), (f["start"] - f["end"]).alias("c"),
        f["entity"].alias("d"), f["rule"].alias("rule"),
    )))
    rows = found.select("doc_id", F.posexplode_outer(order).alias("place", "f")).where("place IS NOT NULL")
    return rows.select("doc_id", "f.rule", F.col("f.b").alias("start"), (F.col("place") + 1).alias("place"))


# ---------------------------------------------------------------- masking and vaults


@query("mask_docs", f"{DOCUMENTS_SETTLED}{o.numbered()}{o.masked()} SELECT doc_id, masked FROM masked")
def mask_docs(spark, sf):
    return masked_documents(spark, sf).select("doc_id", "masked")


@query("mask_people", f"{PEOPLE_SETTLED}{o.numbered()}{o.masked()} SELECT doc_id, masked FROM masked")
def mask_people(spark, sf):
    return masked_people(spark, sf).select("doc_id", "masked")


@query("vault_build", f"{PEOPLE_SETTLED}{o.numbered()} SELECT {VAULT_OUT} FROM named")
def vault_build(spark, sf):
    return mask.explode_vault(masked_people(spark, sf), "doc_id")


@query("vault_roundtrip", f"{PEOPLE_SETTLED}{o.numbered()} SELECT {VAULT_OUT} FROM named")
def vault_roundtrip(spark, sf):
    """Sealed with AES-GCM and opened again."""
    secret = F.lit("a shared secret")
    sealed = vaults.seal_vault(mask.explode_vault(masked_people(spark, sf), "doc_id"), secret)
    # numbers of a document's own vault have 32 bits
    return vaults.open_vault(sealed, secret).withColumns({c: F.col(c).cast("int") for c in ("n", "seq")})


def _written_and_read(spark, write, df, *more) -> DataFrame:
    folder = scratch(spark)
    write(df, folder, *more)
    return spark.read.parquet(folder)


@query("sink_masked", f"{CODE_SETTLED}{o.numbered('forward')}{o.masked()} SELECT m.doc_id, ext, masked FROM masked m JOIN corpus USING (doc_id)")
def sink_masked(spark, sf):
    """SNK-1: masked files, a folder for each extension."""
    done = mask.mask_code(corpora.code(spark, sf)).select("doc_id", "ext", "masked")
    return _written_and_read(spark, sinks.write_masked, done, ["doc_id", "ext"])


@query("sink_restored", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN text ELSE '' END AS restored FROM documents""")
def sink_restored(spark, sf):
    """SNK-3 behind an encrypted vault (SNK-2): what is read back was masked, sealed, opened and restored."""
    done, vault = written(masked_documents(spark, sf))
    secret = F.lit("a shared secret")
    opened = vaults.open_vault(_written_and_read(spark, sinks.write_vault, vault, secret), secret)
    back = restore.restore(done, opened, "doc_id", "doc_id", "masked")
    return _written_and_read(spark, sinks.write_restored, back, ["doc_id"])


@query("sink_findings", f"{CODE_SETTLED} SELECT {o.FINDING_SELECT} FROM kept")
def sink_findings(spark, sf):
    """SNK-4."""
    rows = scan.explode_findings(mask.find_secrets(corpora.code(spark, sf)), ["doc_id"]).select(*FINDING_OUT)
    return _written_and_read(spark, sinks.write_findings, rows)


@query("type_counts", f"""{PEOPLE_SETTLED}{o.numbered()}
    SELECT doc_id AS session_id, label, count(*) AS n FROM named GROUP BY ALL""")
def type_counts(spark, sf):
    return report.type_counts(mask.explode_vault(masked_people(spark, sf), "doc_id"))


@query("type_counts_sorted", f"""{PEOPLE_SETTLED}{o.numbered()}
    SELECT doc_id AS session_id, label, count(*) AS n,
           row_number() OVER (PARTITION BY doc_id ORDER BY label)::INTEGER AS place FROM named GROUP BY doc_id, label""")
def type_counts_sorted(spark, sf):
    return report.in_order(report.type_counts(mask.explode_vault(masked_people(spark, sf), "doc_id")), "session_id")


@query("vault_totals", f"""{DOCUMENTS_SETTLED}{o.numbered()}
    SELECT doc_id AS session_id, count(*) AS items, count(DISTINCT label) AS types FROM named GROUP BY ALL""")
def vault_totals(spark, sf):
    return report.vault_totals(mask.explode_vault(masked_documents(spark, sf), "doc_id"))


@query("restore_docs", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN text ELSE '' END AS restored FROM documents""")
def restore_docs(spark, sf):
    """Mask, then restore against the vault table: the text comes back."""
    done, vault = written(masked_documents(spark, sf))
    return restore.restore(done, vault, "doc_id", "doc_id", "masked").select("doc_id", "restored")


@query("restore_in_row", f"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN text ELSE '' END AS restored
    FROM ({corpora.PEOPLE_SQL})""")
def restore_in_row(spark, sf):
    """The vault travels with its document, so nothing is joined."""
    done = masked_people(spark, sf)
    return done.select("doc_id", restore.restore_column(
        F.col("masked"), restore.as_entries(F.col("vault"))
    ).alias("restored"))


@query("restore_count", f"""{PEOPLE_SETTLED}{o.numbered()}
    SELECT c.doc_id, count(n.placeholder)::INTEGER AS restored_count
    FROM corpus c LEFT JOIN named n ON n.doc_id = c.doc_id GROUP BY c.doc_id""")
def restore_count(spark, sf):
    done, vault = written(masked_people(spark, sf))
    return restore.restore(done, vault, "doc_id", "doc_id", "masked").select("doc_id", "restored_count")


# Two long texts with a placeholder for each customer; every tenth value holds the placeholder of a later one.
_LONG_VALUE = "lower(replace(c_name, '#', '')) || '@example.com'"


@query("restore_long", f"""
    WITH plain AS (SELECT c_custkey AS k, c_custkey % 2 AS doc_id, {_LONG_VALUE} AS value FROM customer),
    parts AS (
        SELECT a.k, a.doc_id, CASE WHEN a.k % 10 = 0
            THEN 'see ' || coalesce(b.value, '{{{{EMAIL_' || (a.k + 2) || '}}}}') ELSE a.value END || ' wrote' AS part
        FROM plain a LEFT JOIN plain b ON b.k = a.k + 2)
    SELECT doc_id, string_agg(part, ' ' ORDER BY k) AS restored, count(*)::INTEGER AS restored_count FROM parts GROUP BY doc_id""")
def restore_long(spark, sf):
    mark = "concat('{{EMAIL_', c_custkey, '}}')"
    rows = corpora.table(spark, sf, "customer").selectExpr(
        "c_custkey % 2 AS session_id", "c_custkey AS seq", f"{mark} AS placeholder",
        f"CASE WHEN c_custkey % 10 = 0 THEN concat('see {{{{EMAIL_', c_custkey + 2, '}}}}') ELSE {_LONG_VALUE} END AS value",
    )
    texts = rows.groupBy(F.col("session_id").alias("doc_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "placeholder"))), lambda p: F.concat(p["placeholder"], F.lit(" wrote"))
    ), " ").alias("text"))
    return restore.restore(texts, rows, "doc_id", "doc_id").select("doc_id", "restored", "restored_count")


@query("unresolved", f"""{PEOPLE_SETTLED}{o.numbered()}
    SELECT doc_id, doc_id AS session_id, placeholder FROM named WHERE label = 'EMAIL'""")
def unresolved(spark, sf):
    """Placeholders left over when the vault has lost its mail addresses."""
    done, vault = written(masked_people(spark, sf))
    vault = vault.where(F.col("label") != "EMAIL")
    return restore.unresolved(done, vault, "doc_id", "doc_id", "masked")


# ---------------------------------------------------------------- session vaults

CHAT_SETTLED = o.with_settled(corpora.CHAT_SQL, ENABLED)


def session_entries(session: str, sequence: str, rows: str = "kept k JOIN corpus d ON d.doc_id = k.doc_id") -> str:
    """CTE snamed: vault of sessions; documents in sequence, spans from the end."""
    return f""",
    occ AS (SELECT {session} AS session_id, label, value, {sequence} AS sequence, -start AS pos FROM {rows}),
    sfirst AS (SELECT session_id, label, value, min((sequence, pos)) AS first_at FROM occ GROUP BY ALL),
    sentries AS (
      SELECT session_id, label, value,
             row_number() OVER (PARTITION BY session_id, label ORDER BY first_at) AS n,
             row_number() OVER (PARTITION BY session_id ORDER BY first_at) AS seq
      FROM sfirst),
    snamed AS (SELECT *, '{{{{' || label || '_' || n || '}}}}' AS placeholder FROM sentries)"""


CHAT_ROWS = f"kept k JOIN ({corpora.CHAT_SQL}) d ON d.doc_id = k.doc_id"
CHAT_NAMED = session_entries("d.conv_id", "d.turn", CHAT_ROWS)
SESSION_OUT = "session_id, placeholder, label, n, value, seq"


def _found():
    return fn.remembered(mask.pii_findings, "text")


def chat_sessions(spark, sf):
    return sessions.mask_sessions(corpora.chat(spark, sf), _found(), "doc_id", "conv_id", "turn")


@query("vault_sessions", f"{CHAT_SETTLED}{CHAT_NAMED} SELECT {SESSION_OUT} FROM snamed")
def vault_sessions(spark, sf):
    return chat_sessions(spark, sf)[1]


CHAT_MASKED = (
    CHAT_SETTLED + CHAT_NAMED
    + ", dnamed AS (SELECT c.doc_id, s.label, s.value, s.placeholder FROM snamed s JOIN "
    + f"({corpora.CHAT_SQL}) c ON c.conv_id = s.session_id)"
    + o.masked("dnamed")
)


@query("mask_sessions", f"{CHAT_MASKED} SELECT doc_id, masked FROM masked")
def mask_sessions(spark, sf):
    return chat_sessions(spark, sf)[0].select("doc_id", "masked")


@query("restore_sessions", f"SELECT doc_id, text AS restored FROM ({corpora.CHAT_SQL})")
def restore_sessions(spark, sf):
    done, vault = chat_sessions(spark, sf)
    done = joins.checkpointed(done)
    back = restore.restore(done.select("doc_id", "conv_id", "masked"), vault, "doc_id", "conv_id", "masked")
    return back.select("doc_id", "restored")


@query("vault_corpus", f"""{DOCUMENTS_SETTLED}{session_entries("0", "k.doc_id", "kept k")}
    SELECT {SESSION_OUT} FROM snamed""")
def vault_corpus(spark, sf):
    """One vault for all documents: a single session that holds every row."""
    docs = corpora.documents(spark, sf).select("doc_id", F.lit(0).alias("session"), "text")
    return sessions.mask_sessions(docs, _found(), "doc_id", "session", "doc_id")[1]


#: Sequence values far apart, as hashes are.
SPARSE = "(doc_id * 7919 % 1000003) * 9000000000 - doc_id"


@query("vault_sparse_sequence", f"""{DOCUMENTS_SETTLED}{session_entries("0", SPARSE.replace("doc_id", "k.doc_id"), "kept k")}
    SELECT {SESSION_OUT} FROM snamed""")
def vault_sparse_sequence(spark, sf):
    """As ``vault_corpus``, with documents in an order of sparse numbers."""
    docs = corpora.documents(spark, sf).select("doc_id", F.lit(0).alias("session"), F.expr(SPARSE).alias("at"), "text")
    return sessions.mask_sessions(docs, _found(), "doc_id", "session", "at")[1]


@query("vault_append", f"{CHAT_SETTLED}{CHAT_NAMED} SELECT {SESSION_OUT} FROM snamed")
def vault_append(spark, sf):
    """First turns make a vault, later turns extend it: equal to one run over all turns."""
    chat = corpora.chat(spark, sf)
    _, first = sessions.mask_sessions(chat.where("turn < 2"), _found(), "doc_id", "conv_id", "turn")
    _, both = sessions.mask_sessions(
        chat.where("turn >= 2"), _found(), "doc_id", "conv_id", "turn", existing=first
    )
    return both


# ---------------------------------------------------------------- recognizers

PEOPLE_NAMES_SQL = (
    f"SELECT DISTINCT {corpora.pick(corpora.FIRST, 'c_custkey')} || ' ' || "
    f"{corpora.pick(corpora.LAST, 'c_custkey * 7 + 3')} AS name FROM customer"
)


def person_gazetteer(spark, sf):
    return corpora.table(spark, sf, "customer").selectExpr(
        f"{corpora.pick(corpora.FIRST, 'c_custkey')} || ' ' || "
        f"{corpora.pick(corpora.LAST, 'c_custkey * 7 + 3')} AS name", "'PERSON' AS entity"
    )


def location_gazetteer(spark, sf):
    return corpora.table(spark, sf, "nation").selectExpr(
        "replace(n_name, '_', ' ') AS name", "'LOCATION' AS entity"
    )


def _gazetteer_sql(names_sql: str, entity: str) -> str:
    return f"""
      SELECT doc_id, '{entity}' AS entity, '{ENTITY_LABELS[entity]}' AS label, 'GAZETTEER' AS rule,
             start, (start + length(value))::INTEGER AS stop, 85 AS pct, value, text
      FROM (
        SELECT doc_id, text, unnest(parts) AS value, unnest(range(1, len(parts) + 1)) AS j,
               unnest(starts)::INTEGER AS start
        FROM (
          SELECT doc_id, text, parts,
                 list_transform(range(1, len(parts) + 1), lambda j: coalesce(list_sum(list_transform(parts[:j - 1], lambda p: length(p))), 0)) AS starts
          FROM (
            SELECT doc_id, text, string_split(regexp_replace(text, '(?i)\\b(' || name || ')\\b', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts
            FROM corpus, ({names_sql}) WHERE contains(text, name)))
      ) WHERE j % 2 = 0"""


NATION_NAMES_SQL = "SELECT replace(n_name, '_', ' ') AS name FROM nation"


@query("gazetteer_person", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL})
    SELECT {o.FINDING_SELECT} FROM ({_gazetteer_sql(PEOPLE_NAMES_SQL, 'PERSON')})""")
def gazetteer_person(spark, sf):
    return recognizers.gazetteer_findings(
        corpora.people(spark, sf), person_gazetteer(spark, sf), "doc_id"
    ).select(*FINDING_OUT)


@query("gazetteer_location", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL})
    SELECT {o.FINDING_SELECT} FROM ({_gazetteer_sql(NATION_NAMES_SQL, 'LOCATION')})""")
def gazetteer_location(spark, sf):
    return recognizers.gazetteer_findings(
        corpora.people(spark, sf), location_gazetteer(spark, sf), "doc_id"
    ).select(*FINDING_OUT)


SEGMENT_NAMES_SQL = "SELECT DISTINCT c_mktsegment AS name FROM customer"


def _segments(spark, sf, entity: str) -> DataFrame:
    return corpora.table(spark, sf, "customer").selectExpr("c_mktsegment AS name", f"'{entity}' AS entity").distinct()


def _segment_query(name: str, entity: str) -> None:
    @query(name, f"""
        WITH corpus AS (SELECT c_custkey AS doc_id, c_name || ' of ' || c_mktsegment || ', ' || lower(c_mktsegment) AS text FROM customer)
        SELECT {o.FINDING_SELECT} FROM ({_gazetteer_sql(SEGMENT_NAMES_SQL, entity).replace("(?i)", "")})""")
    def build(spark, sf):
        texts = corpora.table(spark, sf, "customer").selectExpr(
            "c_custkey AS doc_id", "c_name || ' of ' || c_mktsegment || ', ' || lower(c_mktsegment) AS text"
        )
        return recognizers.gazetteer_findings(texts, _segments(spark, sf, entity), "doc_id").select(*FINDING_OUT)


_segment_query("gazetteer_organization", "ORGANIZATION")
_segment_query("gazetteer_nrp", "NRP")
GAZETTEER_COLUMNS = "doc_id, entity, label, rule, start, stop, pct, value, text"
_BOTH_GAZETTEERS = (
    f"SELECT {GAZETTEER_COLUMNS} FROM ({_gazetteer_sql(PEOPLE_NAMES_SQL, 'PERSON')}) UNION ALL "
    f"SELECT {GAZETTEER_COLUMNS} FROM ({_gazetteer_sql(NATION_NAMES_SQL, 'LOCATION')})"
)


@query("mask_with_gazetteers", f"""
    {o.with_settled(corpora.PEOPLE_SQL, ENABLED, extra=_BOTH_GAZETTEERS)}{o.numbered()}{o.masked()}
    SELECT doc_id, masked FROM masked""")
def mask_with_gazetteers(spark, sf):
    people = corpora.people(spark, sf)
    names = person_gazetteer(spark, sf).unionByName(location_gazetteer(spark, sf))
    found = recognizers.with_gazetteer(scan.scan(people), names, "doc_id", plain=people)
    found = found.withColumn("findings", filters.settle(F.col("findings")))
    return mask.mask_findings(found, "text", "findings", mask.BACKWARD).select("doc_id", "masked")


@query("entity_selection", f"""
    {o.with_settled(corpora.PEOPLE_SQL, select_rules(entities=['EMAIL_ADDRESS', 'VEHICLE']))}{o.numbered()}{o.masked()}
    SELECT doc_id, masked FROM masked""")
def entity_selection(spark, sf):
    people = corpora.people(spark, sf)
    return mask.mask_documents(people, entities=["EMAIL_ADDRESS", "VEHICLE"]).select("doc_id", "masked")


@query("allowlist", f"""
    {o.with_settled(corpora.PEOPLE_SQL, ENABLED, where=" WHERE value NOT IN (SELECT 'www.site' || c_custkey || '.com/p' FROM customer)")}
    SELECT {o.FINDING_SELECT} FROM kept""")
def allowlist(spark, sf):
    """UDF-5 with a table of safe values: anti-join before the overlaps are resolved."""
    safe = corpora.table(spark, sf, "customer").selectExpr(
        "concat('www.site', c_custkey, '.com/p') AS value"
    )
    found = scan.scan(corpora.people(spark, sf))
    clean = filters.drop_false_positives(filters.clip_at_pipe(F.col("findings")))
    rows = scan.explode_findings(found.withColumn("findings", clean), ["doc_id"])
    kept = scan.collect_findings(filters.without_values(rows, safe, ["value"]), "doc_id")
    kept = kept.withColumn("findings", resolve_overlaps(F.col("findings")))
    return scan.explode_findings(kept, ["doc_id"]).select(*FINDING_OUT)


@query("denylist_table", f"""
    WITH corpus AS ({corpora.PEOPLE_SQL}), raw AS ({_gazetteer_sql(NATION_NAMES_SQL, 'LOCATION')})
    SELECT {o.FINDING_SELECT} FROM raw
    WHERE lower(value) NOT IN (SELECT lower(replace(n_name, '_', ' ')) FROM nation WHERE n_regionkey = 2)""")
def denylist_table(spark, sf):
    denied = corpora.table(spark, sf, "nation").where("n_regionkey = 2").selectExpr(
        "'LOCATION' AS entity", "lower(replace(n_name, '_', ' ')) AS value"
    )
    rows = recognizers.gazetteer_findings(
        corpora.people(spark, sf), location_gazetteer(spark, sf), "doc_id"
    )
    return filters.drop_denied(rows, denied).select(*FINDING_OUT)


USER_RULES = (
    SpanRule("EMPLOYEE", "EMPLOYEE_NO", r"\bEMP\d+\b", 70, context=("staff",)),
    SpanRule("REFERENCE", "REFERENCE_NO", r"\bREF\d{3}\b", 55),
)


@query("user_rules", o.scan_sql(corpora.PEOPLE_SQL, USER_RULES))
def user_rules(spark, sf):
    table = spark.createDataFrame(
        [(r.entity, r.rule, r.regex, r.pct / 100, list(r.context)) for r in USER_RULES],
        "entity string, rule string, regex string, score double, context array<string>",
    )
    rules = recognizers.rules_from_table(table)
    found = scan.scan(corpora.people(spark, sf), rules=rules)
    return scan.explode_findings(found, ["doc_id"]).select(*FINDING_OUT)


GROUPED_RULES = (
    SpanRule("EMPLOYEE", "EMPLOYEE_DIGITS", r"\bEMP(\d+)\b", 70, group=1),
    SpanRule("REFERENCE", "REFERENCE_HEAD", r"\bREF(\d{2})\d", 55, label="REF", group=1, tail=1),
)


@query("user_rules_grouped", o.scan_sql(corpora.PEOPLE_SQL, GROUPED_RULES))
def user_rules_grouped(spark, sf):
    """Rules of a table that mask a group of their match only."""
    table = spark.createDataFrame(
        [(r.entity, r.rule, r.regex, r.pct / 100, [], r.label, r.group, r.tail) for r in GROUPED_RULES],
        "entity string, rule string, regex string, score double, context array<string>, label string, group int, tail int",
    )
    found = scan.scan(corpora.people(spark, sf), rules=recognizers.rules_from_table(table))
    return scan.explode_findings(found, ["doc_id"]).select(*FINDING_OUT)


def shouted_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A small user recognizer: the word VIN."""
    for batch in batches:
        at = batch["text"].str.find(" VIN ")
        hits = batch[at >= 0]
        start = at[at >= 0] + 1
        yield pd.DataFrame({
            "doc_id": hits["doc_id"], "entity": "MARK", "label": "MARK", "rule": "USER",
            "start": start.astype("int32"), "end": (start + 3).astype("int32"),
            "score": None, "line_number": 1, "value": "VIN",
        })


@query("user_hook", f"""
    SELECT doc_id, 'USER' AS rule, (strpos(text, ' VIN '))::INTEGER AS start,
           (strpos(text, ' VIN ') + 3)::INTEGER AS "end", 'VIN' AS value
    FROM ({corpora.PEOPLE_SQL}) WHERE contains(text, ' VIN ')""")
def user_hook(spark, sf):
    return recognizers.user_recognizer(corpora.people(spark, sf), shouted_words, "doc_id").select(
        "doc_id", "rule", "start", "end", "value"
    )


# ---------------------------------------------------------------- secrets

SECRET_OUT = "doc_id, label, rule, start, stop AS \"end\", (pct / 100.0)::DECIMAL(4,2) AS score, value"


def _secret_query(rule: SpanRule) -> None:
    @query(f"secret_{rule.rule.lower()}", f"""
        WITH corpus AS ({corpora.CODE_SQL})
        SELECT {SECRET_OUT}, {o.line_of()} AS line_number FROM ({o.span_rows((rule,), boost=0)})""")
    def build(spark, sf):
        found = scan.scan_secrets(corpora.code(spark, sf), rules=(rule,))
        return scan.explode_findings(found, ["doc_id"]).select(
            "doc_id", "label", "rule", "start", "end", "score", "value", "line_number"
        )


for _rule in SECRET_RULES:
    _secret_query(_rule)


@query("documents_secrets", f"""
    {o.with_settled(o.DOCUMENTS_SQL, SECRET_RULES, clean=False, boost=0)}
    SELECT {SECRET_OUT}, {o.line_of()} AS line_number, pct::INTEGER AS percent FROM kept""")
def documents_secrets(spark, sf):
    done = mask.find_secrets(corpora.documents(spark, sf).select("doc_id", "text"))
    return scan.secret_report(done, "doc_id").select(
        "doc_id", "label", "rule", "start", "end", "score", "value", "line_number", "percent"
    )


@query("secret_report", f"""{CODE_SETTLED}
    SELECT doc_id, label, CASE rule {' '.join(f"WHEN '{r.rule}' THEN {lit(r.description)}" for r in SECRET_RULES)} END AS description,
           {o.line_of()} AS line_number, pct::INTEGER AS percent FROM kept""")
def secret_report(spark, sf):
    return scan.secret_report(mask.find_secrets(corpora.code(spark, sf)), "doc_id").select(
        "doc_id", "label", "description", "line_number", "percent"
    )


@query("mask_code", f"{CODE_SETTLED}{o.numbered('forward')}{o.masked()} SELECT doc_id, masked FROM masked")
def mask_code(spark, sf):
    return masked_code(spark, sf).select("doc_id", "masked")


@query("vault_code", f"{CODE_SETTLED}{o.numbered('forward')} SELECT {VAULT_OUT} FROM named")
def vault_code(spark, sf):
    return mask.explode_vault(masked_code(spark, sf), "doc_id")


@query("secret_counts", f"{CODE_SETTLED} SELECT doc_id, label, count(*) AS n FROM kept GROUP BY ALL")
def secret_counts(spark, sf):
    rows = scan.explode_findings(mask.find_secrets(corpora.code(spark, sf)), ["doc_id"])
    return report.secret_counts(rows, "doc_id")


@query("secret_counts_sorted", f"""{CODE_SETTLED} SELECT doc_id, label, count(*) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY label)::INTEGER AS place FROM kept GROUP BY doc_id, label""")
def secret_counts_sorted(spark, sf):
    rows = scan.explode_findings(mask.find_secrets(corpora.code(spark, sf)), ["doc_id"])
    return report.in_order(report.secret_counts(rows, "doc_id"), "doc_id")


@query("snippets", f"""{CODE_SETTLED}
    SELECT doc_id, label, line_number, start, greatest(line_number - 2, 1)::INTEGER AS first_line,
           array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[greatest(line_number - 2, 1):line_number + 2], chr(10)) AS snippet
    FROM (SELECT *, {o.line_of()} AS line_number FROM kept)""")
def snippets(spark, sf):
    return report.snippets(mask.find_secrets(corpora.code(spark, sf)), "findings", "doc_id")


# ---------------------------------------------------------------- vulnerabilities

SEC_OUT = "doc_id, rule_id, title, severity, line_number, line_text"


def _vulnerability_query(rule: CodeRule) -> None:
    @query(f"vuln_{rule.rule_id[-3:]}", f"""
        WITH corpus AS ({corpora.CODE_SQL})
        SELECT {SEC_OUT} FROM ({o.vulnerability_rows((rule,))})""")
    def build(spark, sf):
        return scan.scan_vulnerabilities(corpora.code(spark, sf), "doc_id", rules=(rule,)).select(
            "doc_id", "rule_id", "title", "severity", "line_number", "line_text"
        )


for _code_rule in VULNERABILITY_RULES:
    _vulnerability_query(_code_rule)


@query("vuln_scan", f"""
    WITH corpus AS ({corpora.CODE_SQL})
    SELECT doc_id, rule_id, title, description, severity, line_number, line_text, cwe, advice, source
    FROM ({o.vulnerability_rows()})""")
def vuln_scan(spark, sf):
    return scan.scan_vulnerabilities(corpora.code(spark, sf), "doc_id").select("doc_id", *scan.SEC_COLUMNS)


_EXTERNAL_SQL = f"""
    SELECT doc_id, coalesce(r->>'test_id', 'B000') AS rule_id,
           array_to_string(list_transform(regexp_extract_all(replace(coalesce(r->>'test_name', 'Bandit Issue'), '_', ' '),
                           '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title,
           coalesce(r->>'issue_text', '') AS description,
           CASE WHEN upper(coalesce(r->>'issue_severity', 'LOW')) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO')
                THEN upper(coalesce(r->>'issue_severity', 'LOW')) ELSE 'LOW' END AS severity,
           coalesce((r->>'line_number')::INTEGER, 0) AS line_number,
           {o.strip("coalesce(r->>'code', '')")} AS line_text,
           coalesce(r->'issue_cwe'->>'id', '') AS cwe,
           'See https://bandit.readthedocs.io for remediation guidance.' AS advice,
           'bandit' AS source, j AS rule_no, 0 AS start
    FROM (SELECT p_partkey AS doc_id, unnest(from_json(({corpora.REPORT_JSON})::JSON->'results', '["JSON"]')) AS r,
                 unnest(range(0, 2)) AS j FROM part)"""


def external(spark, sf):
    parsed = corpora.reports(spark, sf).select(
        "doc_id", F.from_json("report", report.EXTERNAL_SCHEMA)["results"].alias("results")
    )
    return report.external_findings(parsed, "doc_id")


@query("vuln_import", f"""
    SELECT doc_id, rule_id, title, description, severity, line_number, line_text, cwe, advice, source
    FROM ({_EXTERNAL_SQL})""")
def vuln_import(spark, sf):
    return external(spark, sf).select("doc_id", *scan.SEC_COLUMNS)


_MERGED_SQL = f"""
    WITH corpus AS ({corpora.CODE_SQL}),
    custom AS ({o.vulnerability_rows()}),
    outside AS ({_EXTERNAL_SQL}),
    both_ AS (
      SELECT e.doc_id, rule_id, title, description, severity, line_number, line_text, cwe, advice, source,
             rule_no, start, 0 AS source_rank
      FROM outside e JOIN corpus c ON c.doc_id = e.doc_id WHERE c.ext = 'py'
      UNION ALL
      SELECT doc_id, rule_id, title, description, severity, line_number, line_text, cwe, advice, source,
             rule_no, start, 1 FROM custom),
    merged AS (
      SELECT *, {o.SEVERITY_RANK_SQL} AS sev_rank FROM both_
      QUALIFY row_number() OVER (PARTITION BY doc_id, title, line_number
                                 ORDER BY source_rank, rule_no, start) = 1)"""


def merged_findings(spark, sf, show_low: bool = True):
    code = corpora.code(spark, sf)
    outside = external(spark, sf).join(code.select("doc_id", "ext"), "doc_id")
    custom = scan.scan_vulnerabilities(code, "doc_id")
    return report.merge_findings(custom, "doc_id", outside, ext="ext", show_low=show_low)


@query("vuln_dedup", f"{_MERGED_SQL} SELECT doc_id, rule_id, title, severity, line_number, source FROM merged")
def vuln_dedup(spark, sf):
    return merged_findings(spark, sf).select("doc_id", "rule_id", "title", "severity", "line_number", "source")


@query("vuln_ranked", f"""{_MERGED_SQL}
    SELECT doc_id, rule_id, line_number, row_number() OVER (PARTITION BY doc_id
      ORDER BY sev_rank, line_number, source_rank, rule_no)::INTEGER AS place FROM merged""")
def vuln_ranked(spark, sf):
    return report.ranked(merged_findings(spark, sf), "doc_id").select("doc_id", "rule_id", "line_number", "place")


@query("vuln_without_low", f"""{_MERGED_SQL}
    SELECT doc_id, rule_id, severity, line_number FROM merged WHERE severity NOT IN ('LOW', 'INFO')""")
def vuln_without_low(spark, sf):
    return merged_findings(spark, sf, show_low=False).select("doc_id", "rule_id", "severity", "line_number")


_COUNTS = """
    SELECT doc_id, count_if(severity = 'CRITICAL') AS critical, count_if(severity = 'HIGH') AS high,
           count_if(severity = 'MEDIUM') AS medium, count_if(severity IN ('LOW', 'INFO')) AS low
    FROM merged GROUP BY doc_id"""


@query("severity_counts", f"""{_MERGED_SQL}
    SELECT doc_id, critical::BIGINT AS critical, high::BIGINT AS high, medium::BIGINT AS medium, low::BIGINT AS low
    FROM ({_COUNTS})""")
def severity_counts(spark, sf):
    return report.severity_counts(merged_findings(spark, sf), "doc_id")


@query("blockers", f"""{_MERGED_SQL}
    SELECT doc_id, bool_or(severity IN ('CRITICAL', 'HIGH')) AS has_blockers FROM merged GROUP BY doc_id""")
def blockers(spark, sf):
    return report.blockers(merged_findings(spark, sf), "doc_id")


@query("blocking_details", f"""{_MERGED_SQL}
    SELECT doc_id, rule_id, title, description, line_text, advice FROM merged
    WHERE severity IN ('CRITICAL', 'HIGH')""")
def blocking_details(spark, sf):
    return report.blocking_details(merged_findings(spark, sf)).select(
        "doc_id", "rule_id", "title", "description", "line_text", "advice"
    )


@query("riskiest", f"""{_MERGED_SQL}
    SELECT doc_id, critical::BIGINT AS critical, high::BIGINT AS high, medium::BIGINT AS medium, low::BIGINT AS low
    FROM ({_COUNTS}) ORDER BY critical DESC, high DESC, medium DESC, low DESC, doc_id LIMIT 25""")
def riskiest(spark, sf):
    return report.riskiest(report.severity_counts(merged_findings(spark, sf), "doc_id"), "doc_id", 25)


FINAL_STATUS = f"""
    {o.with_settled(corpora.CODE_SQL, SECRET_RULES, clean=False, boost=0)},
    custom AS ({o.vulnerability_rows()}),
    b AS (SELECT doc_id, bool_or(severity IN ('CRITICAL', 'HIGH')) AS blocked FROM custom GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS secrets FROM kept GROUP BY doc_id)
    SELECT c.doc_id, coalesce(blocked, false) AS has_blockers, coalesce(secrets, 0) AS secrets,
           CASE WHEN coalesce(blocked, false) AND coalesce(secrets, 0) = 0 THEN 'unsafe_no_secrets'
                WHEN coalesce(blocked, false) THEN 'masked_but_unsafe'
                WHEN coalesce(secrets, 0) > 0 THEN 'safe_masked' ELSE 'clean' END AS status
    FROM corpus c LEFT JOIN b ON b.doc_id = c.doc_id LEFT JOIN s ON s.doc_id = c.doc_id"""


@query("final_status", FINAL_STATUS)
def final_status(spark, sf):
    return report.status_of_texts(corpora.code(spark, sf), "doc_id")


@query("final_status_joined", FINAL_STATUS)
def final_status_joined(spark, sf):
    """The same from tables of findings."""
    code = corpora.code(spark, sf)
    secrets = scan.explode_findings(mask.find_secrets(code), ["doc_id"])
    return report.final_status(code, scan.scan_vulnerabilities(code, "doc_id"), secrets, "doc_id")


USER_CODE_RULES = (
    CodeRule("USER-1", "Return", "A return statement.", "INFO", r"^\s*return\b", "", "None."),
)


@query("user_code_rules", f"""
    WITH corpus AS ({corpora.CODE_SQL})
    SELECT {SEC_OUT} FROM ({o.vulnerability_rows(USER_CODE_RULES)})""")
def user_code_rules(spark, sf):
    table = spark.createDataFrame(
        [(r.rule_id, r.title, r.description, r.severity, r.regex, r.cwe, r.advice) for r in USER_CODE_RULES],
        "rule_id string, title string, description string, severity string, regex string, cwe string, advice string",
    )
    rules = recognizers.code_rules_from_table(table)
    return scan.scan_vulnerabilities(corpora.code(spark, sf), "doc_id", rules=rules).select(
        "doc_id", "rule_id", "title", "severity", "line_number", "line_text"
    )


LANGUAGE_RULES = (
    CodeRule("USER-2", "Import", "An import.", "LOW", r"^import\b.*$", "", "None.", ("py",)),
    CodeRule("USER-3", "Return", "A return statement.", "INFO", r"^\s*return\b", "", "None.", ("js", "conf")),
)


@query("user_code_languages", f"""
    WITH corpus AS ({corpora.CODE_SQL})
    SELECT {SEC_OUT} FROM ({o.vulnerability_rows(LANGUAGE_RULES)}) JOIN (SELECT doc_id, ext FROM corpus) USING (doc_id)
    WHERE CASE rule_id WHEN 'USER-2' THEN ext = 'py' ELSE ext IN ('js', 'conf') END""")
def user_code_languages(spark, sf):
    """Rules of a table that hold for some kinds of files."""
    table = spark.createDataFrame(
        [(r.rule_id, r.title, r.description, r.severity, r.regex, r.cwe, r.advice, list(r.languages)) for r in LANGUAGE_RULES],
        "rule_id string, title string, description string, severity string, regex string, cwe string, advice string, "
        "languages array<string>",
    )
    rules = recognizers.code_rules_from_table(table)
    return scan.scan_vulnerabilities(corpora.code(spark, sf), "doc_id", ext="ext", rules=rules).select(
        "doc_id", "rule_id", "title", "severity", "line_number", "line_text"
    )


# ---------------------------------------------------------------- corpus reports


@query("exposure_rollup", f"""{DOCUMENTS_SETTLED}
    SELECT d.source, d.lang, k.label, grouping(d.source, d.lang, k.label)::INTEGER AS level,
           count(*) AS findings, count(DISTINCT k.doc_id) AS documents
    FROM kept k JOIN documents d ON d.doc_id = k.doc_id GROUP BY ROLLUP (d.source, d.lang, k.label)""")
def exposure_rollup(spark, sf):
    docs = corpora.documents(spark, sf).select("doc_id", "source", "lang", "text")
    rows = scan.explode_findings(mask.find_pii(docs), ["doc_id", "source", "lang"])
    return report.exposure(rows, ["source", "lang"], "doc_id")


@query("shared_values", f"""{DOCUMENTS_SETTLED}
    SELECT label, sha256(value) AS value_hash, count(DISTINCT doc_id) AS documents
    FROM kept GROUP BY label, value HAVING count(DISTINCT doc_id) >= 2""")
def shared_values(spark, sf):
    return report.shared_values(mask.explode_vault(masked_documents(spark, sf), "doc_id"))


@query("shared_values_approx", f"""{DOCUMENTS_SETTLED}
    SELECT label, sha256(value) AS value_hash, count(DISTINCT doc_id) AS documents, TRUE AS within
    FROM kept GROUP BY label, value HAVING count(DISTINCT doc_id) >= 2""")
def shared_values_approx(spark, sf):
    return report.shared_values_approx(mask.explode_vault(masked_documents(spark, sf), "doc_id"))


# ---------------------------------------------------------------- pages


@query("mask_pages", f"""
    {o.with_settled(
        "SELECT page_id AS doc_id, "
        + o.strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[' || chr(160) || '\\s]{2,}', chr(10), 'g')")
        + " AS text FROM pages", ENABLED)}{o.numbered()}{o.masked()}
    SELECT doc_id, masked FROM masked""")
def mask_pages(spark, sf):
    text = corpora.table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), formats.html_text(F.col("html")).alias("text")
    )
    return mask.mask_documents(text).select("doc_id", "masked")


# ---------------------------------------------------------------- streams


def scratch(spark: SparkSession) -> str:
    """A new folder for stream output, below the checkpoint folder that all executors share."""
    joins.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = corpora.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


@query("stream_mask", f"{DOCUMENTS_SETTLED}{o.numbered()}{o.masked()} SELECT doc_id, masked FROM masked")
def stream_mask(spark, sf):
    folder = scratch(spark)
    masked = streams.mask_stream(stream_of(spark, sf, "documents").select("doc_id", "text"))
    masked.select("doc_id", "masked").writeStream.format("parquet").option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def chat_stream(spark, sf):
    turns = stream_of(spark, sf, "conversations")
    return turns.selectExpr("conv_id * 100 + turn AS doc_id", "conv_id", "turn", f"{corpora.CHAT_TEXT} AS text")


@query("stream_vault", f"{CHAT_SETTLED}{CHAT_NAMED} SELECT {SESSION_OUT} FROM snamed")
def stream_vault(spark, sf):
    folder = scratch(spark)
    vault = streams.SessionVault(folder, "conv_id", "turn", "doc_id")
    vault.start(chat_stream(spark, sf), f"{folder}/state").awaitTermination()
    return vault.current_vault(spark)


@query("stream_restore", f"SELECT doc_id, text AS restored FROM ({corpora.CHAT_SQL})")
def stream_restore(spark, sf):
    folder = scratch(spark)
    done, vault = chat_sessions(spark, sf)
    done.select("doc_id", "conv_id", "masked").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("doc_id bigint, conv_id bigint, masked string").parquet(f"{folder}/in")
    streams.restore_stream(
        stream, vault, f"{folder}/out", f"{folder}/state", "doc_id", "conv_id", "masked"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "restored")
