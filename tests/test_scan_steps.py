"""Shortcuts of the scan: first characters, words in front of a match, blanks around a value."""

import random
import re

from pyspark.sql import functions as F

from maskwright.functions.spans import MATCH, near_words, resolve_overlaps, runs_of
from maskwright.operators.filters import is_false_positive
from maskwright.rules import PII_RULES
from maskwright.rules.model import FLAGS


def test_first_characters_change_no_match(spark):
    """Every rule that starts with a border names its first characters, and finds what its regex alone finds."""
    assert {r.rule for r in PII_RULES if not r.first} == {"EMAIL"}
    assert all(not r.ignoring_case().first for r in PII_RULES)
    rng = random.Random(3)
    seeds = [
        "AB12 XYZ", "AE07 0331 2345 6789 0123 456", "+971 50 123 4567", "(04) 123 4567", "4111-1111-1111-1111", "٤٤٤-٤٤-٤٤٤٤",
        "A12345678", "123456789", "784-1982-1234567-2", "10.1.2.3", "2001:0db8:0000:0000:0000:ff00:0042:8329", "D1234567",
        "https://a.example/x", "www.site.com/p", "1/2/2003", "12 March 2024", "2024-03-12", "JTMRV33V876543210", "Contact: Ana Lima",
        "Bank Name: Ben Costa", "ab1234567", "é12345678", "\n", " ", "x", "_", "ß", "a@b.co",
    ]
    texts = ["".join(rng.choice(seeds) + rng.choice(["", " ", ",", "-"]) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule in PII_RULES:
        both = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (rule.pattern, FLAGS + rule.regex)]
        assert df.where(both[0] != both[1]).count() == 0, rule.rule


def test_near_words_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["card", "Card", "cards", "x-card", "id", "é", "naïve", "_id", "λόγος", "a.b.c.d", "--", "\n", "K", "w" * 40, "42", "ID:"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = [(t, sorted(rng.sample(range(len(t) + 1), min(len(t), 9)))) for t in texts]
    matches = F.transform("at", lambda s: F.struct(
        s.alias("start"), (s + 1).alias("end"), F.lit(1).alias("line"), F.lit("v").alias("value"),
    )).cast(f"array<{MATCH}>")
    df = spark.createDataFrame(rows, "text string, at array<int>")
    words = ("card", "id", "card id")
    got = df.select("text", "at", near_words(
        F.col("text"), runs_of(F.col("text")), matches, F.array(*map(F.lit, words)), 5
    ).alias("near")).collect()
    for r in got:
        for at, near in zip(r["at"], r["near"], strict=True):
            assert bool(near) == any(w in words for w in re.findall(r"\w+", r["text"][:at].lower())[-5:]), (r["text"], at)


def test_blanks_around_a_value_do_not_hide_noise(spark):
    values = ["EMP12", " EMP12", "EMP12\x1c", " EMP12 ", "éEMP12", "AB123", "Ab1234567", "a=b", "x│", "plain", "", " ", "Full Name ", "\tANA"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    noise = is_false_positive(F.lit("PERSON"), F.col("value"), ("full name",), ())
    got = {r["value"]: r["noise"] for r in df.select("value", noise.alias("noise")).collect()}
    assert {v for v in values if got[v]} == {
        "EMP12", " EMP12", "EMP12\x1c", " EMP12 ", "AB123", "a=b", "x│", "Full Name ", "\tANA",
    }


def test_chains_and_lone_findings_resolve_alike(spark):
    """Runs of touching, nested and chained findings between lone ones, over more than one block."""
    def finding(start, end, pct, rule):
        return (start, end, pct, "E", "L", rule, 1, f"v{start}")

    rows = []
    for k in range(300):
        at = 20 * k
        rows += [finding(at, at + 5, 60, "A"), finding(at + 5, at + 8, 50, "B")]
        if k % 3 == 0:
            rows += [finding(at + 7, at + 12, 70, "C"), finding(at + 11, at + 13, 40, "D")]
    kind = "array<struct<start:int,end:int,pct:int,entity:string,label:string,rule:string,line:int,value:string>>"
    df = spark.createDataFrame([(random.Random(1).sample(rows, len(rows)),)], f"f {kind}")
    got = [(r["start"], r["rule"]) for r in df.select(resolve_overlaps(F.col("f")).alias("k")).first()["k"]]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0], r[0] - r[1], r[3], r[5])):
        if not any(k[0] < r[1] and k[1] > r[0] for k in kept):
            kept.append(r)
    assert got == [(r[0], r[5]) for r in sorted(kept)]
