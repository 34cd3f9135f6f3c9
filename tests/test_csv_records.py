"""Records of CSV files that are read in many splits, against the whole file at once."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.sources import formats, records


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "9", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def whole_files(spark, folder):
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return {r.path: r.text for r in raw.select("path", formats.csv_text(F.make_valid_utf8("value")).alias("text")).collect()}


def by_file(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.path, r.at)):
        found.setdefault(r.path, []).append(r.text)
    return found


def test_line_functions(spark):
    lines = ["", "a,b", '"', '"a', '"a"', 'a"b', '"a""', '"a"""', '"a"b"', 'x,"y', '"a","b', '"a,b",c', ',"",', '""']
    rows = spark.createDataFrame([(v,) for v in lines], "v string")
    got = [tuple(r) for r in rows.select(
        records.ends_quoted(F.col("v")), records.ends_quoted(F.concat(F.lit('"'), F.col("v")))).collect()]

    def walk(line, state):  # the automaton, character by character
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif c == '"' and state in ("cell", "quote"):
                state = "quoted"
            else:
                state = "cell" if c == "," else "plain"
        return state == "quoted"

    assert got == [(walk(v, "cell"), walk(v, "quoted")) for v in lines]


def test_records_equal_whole_files(spark, tmp_path, small_splits):
    draw = random.Random(5)
    for i in range(24):
        parts = draw.choices(["a", "bc", '"', '""', ",", "\n", "\r\n", '"x\ny"', ',"p, q"\n', " ", "é"], k=draw.randint(1, 60))
        (tmp_path / f"f{i}.csv").write_bytes("".join(parts).encode())
    (tmp_path / "long.csv").write_text('h,i\n' + ''.join(f'{i},"one\n\ntwo ""{i}"" , three",z\n' for i in range(40)))
    (tmp_path / "open.csv").write_text('h,i\n1,"never\nclosed\n\n')
    (tmp_path / "bytes.csv").write_bytes(b'a\xff,"b\n\xfe"\nc')
    (tmp_path / "empty.csv").write_bytes(b"")
    want = whole_files(spark, str(tmp_path))
    lines = spark.read.text(str(tmp_path / "long.csv")).select(F.col("_metadata.file_block_start").alias("b"))
    assert lines.distinct().count() > 20
    got = by_file(records.read_csv_records(spark, str(tmp_path)).collect())
    assert {path: "\n".join(texts) for path, texts in got.items()} == {p: t for p, t in want.items() if not p.endswith("/empty.csv")}
    long = next(texts for path, texts in got.items() if path.endswith("/long.csv"))
    assert len(long) == 41 and long[7] == '6 | one\n\ntwo "6" , three | z'


def test_long_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"' + "word, \n" * 30_000 + '"\n2,x\n')
    rows = by_file(records.read_csv_records(spark, str(tmp_path)).collect())
    (texts,) = rows.values()
    assert texts[0] == "k | v" and texts[2] == "2 | x" and len(texts) == 3
    assert texts[1] == "1 | " + ("word, \n" * 30_000).strip()
