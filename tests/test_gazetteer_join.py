from pyspark.sql import functions as F

from maskwright.operators import recognizers, scan


def test_texts_are_scanned_once_and_names_met_by_name(spark, texts, capsys):
    """Names that share their words: a place meets its own name, and the scan is not made again for the names."""
    df = texts("Ana Nine met Bo Three at http://a.b/c", "Ana Three, ana nine and Bo", None)
    # no word is rarer than another, and each stands in several names
    listed = [(f"{a} {b}", "PERSON") for a in ("Ana", "Bo", "Cy") for b in ("Three", "Nine", "Ten")]
    names = spark.createDataFrame([*listed, ("Bo", "ORGANIZATION")], "name string, entity string")

    def scans(rows):
        rows.explain()
        return capsys.readouterr().out.count("https?://")

    scanned = scan.scan(df)
    once = scans(scanned)
    found = recognizers.with_gazetteer(scanned, names, "doc_id", plain=df)
    assert once and scans(found) == once
    got = {r["doc_id"]: sorted((f["entity"], f["start"], f["value"]) for f in r["findings"] if f["rule"] == "GAZETTEER") for r in found.collect()}
    assert got == {
        0: [("ORGANIZATION", 13, "Bo"), ("PERSON", 0, "Ana Nine"), ("PERSON", 13, "Bo Three")],
        1: [("ORGANIZATION", 24, "Bo"), ("PERSON", 0, "Ana Three")],
        2: [],
    }
    plan_rows = recognizers.gazetteer_findings(df, names, "doc_id").select(F.count(F.lit(1))).first()[0]
    assert plan_rows == 5


def test_offsets_are_made_of_names_alone(spark, texts, capsys):
    """Words that are in no name are not located; lines, parts of words and long chains before a name are as they were."""
    far = "Q-" + "q-" * 150
    df = texts(
        "a\nb Ana\tBo,\nO'Neil", "Zed-Ana and zed-Ana-x and zed-Ana", f"{far}Ana", f"{far}q-Ana", "é 😀 Ana  Bo Ana", "ana Bo", "van  Gogh Van Gogh",
    )
    names = spark.createDataFrame(
        [(n, "PERSON") for n in ("Ana", "Ana Bo", "O'Neil", "van Gogh")], "name string, entity string"
    )
    rows = recognizers.gazetteer_findings(df, names, "doc_id")
    rows.explain()
    # marks are put around the matches of which offsets are made
    assert "regexp_replace(_text" not in capsys.readouterr().out
    got = {}
    for r in rows.collect():
        got.setdefault(r["doc_id"], set()).add((r["start"], r["end"], r["line_number"], r["value"]))
    assert got == {
        0: {(4, 7, 2, "Ana"), (4, 10, 2, "Ana\tBo"), (12, 18, 3, "O'Neil")},
        1: {(30, 33, 1, "Ana")},
        # 257 characters are looked at, of which the first is a small letter
        2: {(len(far), len(far) + 3, 1, "Ana")},
        3: {(len(far) + 2, len(far) + 5, 1, "Ana")},
        4: {(4, 7, 1, "Ana"), (4, 11, 1, "Ana  Bo"), (12, 15, 1, "Ana")},
        6: {(0, 9, 1, "van  Gogh"), (10, 18, 1, "Van Gogh")},
    }
