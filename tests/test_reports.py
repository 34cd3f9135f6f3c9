"""Code reports on small inputs."""

from pyspark.sql import functions as F

from maskwright.operators import mask, report, scan
from maskwright.rules import CodeRule, VULNERABILITY_RULES

UNSAFE = "import random\nx = 1\nh = hashlib.md5(b)\n"
SECRET = 'password = "abcdef"\n'


def test_final_status(texts):
    docs = texts(UNSAFE, SECRET, UNSAFE + SECRET, "x = 1\n", "import random\n")
    secrets = scan.explode_findings(mask.mask_code(docs), ["doc_id"])
    rows = report.final_status(docs, scan.scan_vulnerabilities(docs, "doc_id"), secrets, "doc_id").collect()
    assert {r.doc_id: r.status for r in rows} == {
        0: "unsafe_no_secrets", 1: "safe_masked", 2: "masked_but_unsafe", 3: "clean", 4: "clean",
    }


def test_merge_prefers_external_and_only_for_python(spark, texts):
    docs = texts(UNSAFE, UNSAFE).withColumn("ext", F.when(F.col("doc_id") == 0, "py").otherwise("js"))
    custom = scan.scan_vulnerabilities(docs, "doc_id")
    outside = spark.createDataFrame(
        [(i, [("B1", "weak hashing algorithm", "t", "LOW", 3, " code ", (1,))]) for i in (0, 1)],
        "doc_id bigint, " + report.EXTERNAL_SCHEMA.replace("results ", "results ", 1),
    )
    external = report.external_findings(outside, "doc_id").withColumn(
        "ext", F.when(F.col("doc_id") == 0, "py").otherwise("js")
    )
    rows = report.ranked(report.merge_findings(custom, "doc_id", external, ext="ext"), "doc_id").collect()
    got = {(r.doc_id, r.place): (r.rule_id, r.severity, r.source) for r in rows}
    assert got == {
        (0, 1): ("SEC-RULE-007", "MEDIUM", "custom"), (0, 2): ("B1", "LOW", "bandit"),
        (1, 1): ("SEC-RULE-005", "HIGH", "custom"), (1, 2): ("SEC-RULE-007", "MEDIUM", "custom"),
    }
    high = report.merge_findings(custom, "doc_id", external, ext="ext", show_low=False)
    assert high.where("severity = 'LOW'").count() == 0


def test_languages_limit_a_rule(spark, texts):
    rule = CodeRule("L-1", "T", "D", "LOW", r"import", languages=("js",))
    docs = texts("import a", "import b").withColumn("ext", F.when(F.col("doc_id") == 0, "py").otherwise("js"))
    rows = scan.scan_vulnerabilities(docs, "doc_id", ext="ext", rules=(rule, VULNERABILITY_RULES[6])).collect()
    assert [(r.doc_id, r.rule_id) for r in rows] == [(1, "L-1")]


def test_shared_values_and_rollup(texts):
    docs = mask.mask_documents(texts("a@x.example", "a@x.example b@x.example", "b@x.example a@x.example"))
    shared = report.shared_values(mask.explode_vault(docs, "doc_id")).collect()
    assert sorted(r.documents for r in shared) == [2, 3]
    approx = report.shared_values_approx(mask.explode_vault(docs, "doc_id")).collect()
    assert sorted(r.documents for r in approx) == [2, 3]
    rows = report.exposure(scan.explode_findings(docs, ["doc_id"]), [], "doc_id").collect()
    assert {(r.label, r.level, r.findings, r.documents) for r in rows} == {("EMAIL", 0, 5, 3), (None, 1, 5, 3)}
