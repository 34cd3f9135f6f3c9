"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

With ``BENCH_PYTHON=1`` it also times a single-threaded loop of Python's ``re`` over
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession, functions as F

from maskwright.queries import catalog
from maskwright.rules import SECRET_RULES, VULNERABILITY_RULES, select_rules

HEADLINE = (
    "scan_report", "mask_docs", "mask_people", "mask_pages", "documents_secrets", "mask_code",
    "vuln_scan", "vuln_dedup", "severity_counts", "final_status", "restore_docs", "mask_sessions",
    "vault_corpus", "exposure_rollup", "shared_values", "gazetteer_person", "src_html_text",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def python_seconds(folder: str) -> dict[str, float]:
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    flags = re.MULTILINE | re.DOTALL
    out = {}
    for name, rules in (
        ("scan_report", select_rules()), ("documents_secrets", SECRET_RULES),
        ("vuln_documents", VULNERABILITY_RULES),
    ):
        compiled = [re.compile(r.regex.replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", r"[^\W\d_]"), flags) for r in rules]
        started = time.perf_counter()
        for text in texts:
            for pattern in compiled:
                for match in pattern.finditer(text):
                    match.span()
        out[name] = round(time.perf_counter() - started, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or n in only]
    spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.length("text"))).collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    if os.environ.get("BENCH_PYTHON"):
        result["python_single_thread"] = python_seconds(folder)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
