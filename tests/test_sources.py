"""Readers, sinks and scanner reports: expected texts written out."""

import json
import quopri
import random
from email.mime.message import MIMEMessage
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from maskwright.sources import formats, readers, sinks


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r.t for r in df.select("i", function(F.col("raw")).alias("t")).orderBy("i").collect()]


def test_csv(spark):
    samples = [
        "a,b,c\n1,2,3\n", 'x," y, z ",\r\n,,\r\n"say ""hi""","two\nlines"', "one", "\n\na,b\n", "a,\n", ",", "",
    ]
    want = [
        "a | b | c\n1 | 2 | 3", 'x | y, z\n\nsay "hi" | two\nlines', "one", "\n\na | b", "a", "", "",
    ]
    assert apply(spark, formats.csv_text, samples) == want


def test_html(spark):
    samples = ["<p>Hi  <b>there</b></p>\n\n<p>x</p>", "plain", "<a\nhref='x'>y</a>  z"]
    want = ["Hi\nthere\nx", "plain", "y\nz"]
    assert apply(spark, formats.html_text, samples) == want


def test_json(spark):
    samples = [
        '{"b": 1, "a": [1,2, {"c": null}], "s": "x, {y}: [z]"}', "[]", '{"e": {}, "f": [[]]}', '"text"',
        '{"u": "\\u00e9 \\"q\\" \\n \\/"}', "[true,\n false]", "{bad", '{"k":"v"',
    ]
    want = [
        '{\n  "b": 1,\n  "a": [\n    1,\n    2,\n    {\n      "c": null\n    }\n  ],\n  "s": "x, {y}: [z]"\n}', "[]",
        '{\n  "e": {},\n  "f": [\n    []\n  ]\n}', '"text"', '{\n  "u": "é \\"q\\" \\n /"\n}', "[\n  true,\n  false\n]", None, None,
    ]
    assert apply(spark, formats.json_layout, samples) == want


def test_xml(spark):
    samples = [
        "<a><b x='1' y=\"two &amp; 3\">t &lt; u</b>tail<c/><d><e> deep </e></d></a>",
        "<?xml version='1.0'?>\n<!DOCTYPE a>\n<a>\n  <!-- <no/> -->\n  <b><![CDATA[1 < 2 & 3]]></b>\n</a>",
        "<only attr = 'v' />",
    ]
    want = [
        '<a>\n  <b x="1" y="two & 3"> t < u\n  <c>\n  <d>\n    <e> deep', "<a>\n  <b> 1 < 2 & 3", '<only attr="v">',
    ]
    assert apply(spark, formats.xml_outline, samples) == want


PLAIN = "Subject: Hello\n  folded\nX: y\nFrom: a@b.c\nTo: d@e.f\n\nBody line\n\nmore\n"
MIXED = (
    "From: a@b.c\nContent-Type: multipart/mixed; boundary=\"outer\"\n\npreamble\n--outer\n"
    "Content-Type: multipart/alternative; boundary=inner\n\n--inner\nContent-Type: text/html\n\n<p>hi</p>\n"
    "--inner\nContent-Type: text/plain; charset=utf-8\n\nplain hi\nsecond\n--inner--\n\n--outer\n"
    "Content-Type: text/plain\n\nlater\n--outer--\nepilogue\n"
)
HTML = "From: a@b.c\nContent-Type: multipart/mixed; boundary=z\n\n--z\nContent-Type: text/html\n\n<b>only</b> html\n--z--\n"
BARE = "From: a@b.c\nContent-Type: multipart/mixed; boundary=z\n\n--z\n\nno part headers\n--z--\n"


def test_mail(spark):
    samples = [PLAIN, MIXED, HTML, BARE, "Date: now\n\n"]
    want = [
        "From: a@b.c\nTo: d@e.f\nSubject: Hello  folded\n\nBody line\n\nmore\n", "From: a@b.c\n\nplain hi\nsecond",
        "From: a@b.c\n\n only  html", "From: a@b.c\n\nno part headers", "Date: now\n",
    ]
    assert apply(spark, formats.mail_text, samples) == want


def test_reading_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = {
        "a.txt": b"one\r\ntwo\n", "b.md": b"# t\n", "c.csv": b"h,i\r\n1, 2\r\n", "d.html": b"<p>x</p>",
        "e.json": b'{"k": [1]}', "f.xml": b"<r><s>t</s></r>", "g.eml": PLAIN.encode(), "h.weird": b"as \xff is",
        "i.json": b"{no", "noext": b"z",
    }
    for name, data in put.items():
        (tmp_path / "in" / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == set(put)
    assert rows["a.txt"].text == "one\ntwo\n" and rows["a.txt"].kind == "Plain Text"
    assert rows["c.csv"].text == "h | i\n1 | 2"
    assert rows["e.json"].text == '{\n  "k": [\n    1\n  ]\n}' and rows["e.json"].error is None
    assert rows["f.xml"].text == "<r>\n  <s> t"
    assert rows["h.weird"].text == b"as \xff is".decode("utf-8", "replace") and rows["h.weird"].kind == ".weird file"
    assert rows["i.json"].text is None and rows["i.json"].error == "invalid JSON"
    assert rows["noext"].ext == ""
    code = {r.path.rsplit("/", 1)[1]: r for r in readers.read_code(spark, str(tmp_path / "in")).collect()}
    assert code["e.json"].kind == "JSON" and code["e.json"].known and not code["h.weird"].known
    (tmp_path / "ragged.csv").write_text('h,i\n1, 2,3,,5\n\n"x ""q"", y",z\n')
    lines = readers.read_csv_lines(spark, str(tmp_path / "ragged.csv")).collect()
    assert [r.text for r in lines] == ["h | i", "1 | 2 | 3 | 5", "", 'x "q", y | z']


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "py", "m", "r")], "doc_id int, ext string, masked string, restored string")
    sinks.write_masked(df, str(tmp_path / "m"), ["doc_id", "ext"])
    sinks.write_restored(df, str(tmp_path / "r"), ["doc_id"])
    sinks.write_findings(df, str(tmp_path / "f"))
    assert (tmp_path / "m" / "ext=py").is_dir()
    assert spark.read.parquet(str(tmp_path / "r")).first().restored == "r"
    with pytest.raises(Exception):
        sinks.write_findings(df, str(tmp_path / "f"))


def test_scanner_reports(spark, tmp_path):
    from maskwright.operators.report import external_findings

    (tmp_path / "r.json").write_text(json.dumps({"results": [
        {"test_id": "B301", "test_name": "md5-use_of2hash", "issue_text": "t", "issue_severity": "high",
         "line_number": 4, "code": "\n4 x\n5 y\n", "issue_cwe": {"id": 502}, "extra": 1},
        {"issue_severity": "odd"},
    ]}))
    rows = external_findings(readers.read_scanner_reports(spark, str(tmp_path / "r.json")), "path").orderBy("rule_no").collect()
    assert (rows[0].title, rows[0].severity, rows[0].line_text, rows[0].cwe) == ("Md5-Use Of2Hash", "HIGH", "4 x\n5 y", "502")
    assert (rows[1].rule_id, rows[1].title, rows[1].severity, rows[1].line_number) == ("B000", "Bandit Issue", "LOW", 0)


def test_json_as_python_reads_it(spark):
    """Repeated keys, numbers that JSON does not have, broken texts."""
    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.35:
            return rng.choice(["1", "-2.5", '"s"', '"a\\u0062\\n"', "true", "null", "NaN", "Infinity", "-Infinity", '"[x]"'])
        if kind < 0.55:
            return "[" + ", ".join(value(depth + 1) for _ in range(rng.randint(0, 3))) + "]"
        members = (f'"{rng.choice(["a", "b", "c", chr(92) + "u0061"])}": {value(depth + 1)}' for _ in range(rng.randint(0, 5)))
        return "{" + ", ".join(members) + "}"

    samples = [value(0) for _ in range(300)] + ['{"a":1,}', "[1 2]", '{"a" 1}', '"x', '{"a":1}"', "", '{"a":1}}', "nan", "1,2", '1,"b":2']
    want = []
    for sample in samples:
        try:
            want.append(json.dumps(json.loads(sample), indent=2, ensure_ascii=False))
        except ValueError:
            want.append(None)
    assert apply(spark, formats.json_layout, samples) == want


def test_mail_parts(spark):
    """Transfer encodings, nested parts, lines that look like boundaries, a message inside a message."""
    body = "Grüße = 100%+\n--x\nline  \nend é"
    for encoding in ("base64", "quoted-printable"):
        inner = MIMEText(body, "plain", "utf-8")
        if encoding == "quoted-printable":
            del inner["Content-Transfer-Encoding"]
            inner["Content-Transfer-Encoding"] = encoding
            inner.set_payload(quopri.encodestring(body.encode()).decode())
        alternative = MIMEMultipart("alternative", boundary="b 2")
        alternative.attach(MIMEText("<p>no</p>", "html"))
        alternative.attach(inner)
        attached = MIMEText("--x\nContent-Type: text/plain\n\nnot a part\n--b 2\nneither", "csv")
        outer = MIMEMultipart("mixed", boundary="x--y")
        outer["From"] = "a@b.c"
        holder = MIMEMessage(alternative)
        outer.attach(attached)
        outer.attach(holder)
        outer.attach(MIMEText("later", "plain"))
        assert apply(spark, formats.mail_text, [outer.as_string(), f"From: a@b.c\n{inner.as_string()}"]) == ["From: a@b.c\n\n" + body] * 2


def test_xml_errors_as_a_parser_finds_them(spark):
    pieces = ["<a>", "</a>", "<b k='1'>", "</b>", "<c/>", "t", "&amp;", "&", "<", "<!-- x -->", "<![CDATA[<]]>", " "]
    rng = random.Random(7)
    samples = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    samples += ["<a>" + s + "</a>" for s in samples[:150]] + ["<a k='1' k='2'/>", "<a><b></a></b>", "<?xml version='1.0'?>\n<a/>\n", ""]
    got = apply(spark, formats.xml_error, samples)
    for sample, error in zip(samples, got):
        try:
            ElementTree.fromstring(sample)
            broken = False
        except ElementTree.ParseError:
            broken = True
        assert (error is not None) == broken, (sample, error)


def test_a_mail_body_is_decoded_once(spark, capsys):
    """Neither the expressions of a decoded body nor a filter on the text repeat the passes over it."""
    def passes(df):
        df.explain()
        return capsys.readouterr().out.count("[^A-Za-z0-9+/]")

    mails = spark.createDataFrame([(1, "Subject: s\nContent-Transfer-Encoding: base64\n\nYWJj")], "doc_id int, raw string")
    read = mails.select(formats.mail_text(F.col("raw")).alias("text"))
    assert read.first()["text"] == "Subject: s\n\nabc"
    assert passes(read) == 2  # of a plain body and of a part


def test_mail_queries_read_a_mail_once(spark, tmp_path, capsys):
    from maskwright.queries import catalog

    text = "line one\n" * 3000
    spark.createDataFrame([(1, text), (3, "")], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    for name, head in (("src_mail_base64", ""), ("src_mail_nested", "\n--out")):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        df.explain()
        assert capsys.readouterr().out.count("[^A-Za-z0-9+/]") == 2
        found = {r["doc_id"]: r["text"] for r in df.collect()}
        assert set(found) == {1, 3}
        assert found[1] == f"From: a1@example.com\nSubject: s\n{head}\n{text}"
