"""WARC archives over many splits, the pipeline against brute force, the registered queries."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import (
    brute_fingerprint, brute_groups, brute_overlap, brute_removed, known, reference_ids, BLANK,
)

import __spark_entry__ as entry
import corpus_pipeline
from maskwright.llm import decontaminate, quality, warc
from maskwright.llm.queries import remainder

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture
def pages(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"http://x/{i}", "<p>" + "é".join(map(str, rng.integers(0, 99, rng.integers(0, 400)))) + "</p>") for i in range(120)]
    rows += [
        (500, None, None), (501, "http://a\r\nContent-Length: 3\r\n\r\nx", ""), (502, "u", FAKE), (503, "u", "x" + FAKE * 200 + "y"),
        (504, "u", "WARC/1.0\r\n"), (505, "u", "\r\n\r\nWARC/1.0\r\n\r\nContent-Length: 1\r\n\r\n"), (506, "u", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"),
        (600, "a", rows[0][2]), (601, "b", rows[0][2]), (602, "c", rows[5][2]), (602, "c", rows[5][2]), (None, "n", rows[0][2]),
        (603, "long", "0123456789" * 40_000),
    ]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, record string").repartition(3)


@pytest.mark.parametrize("split", ["128m", "700", "5000"])
def test_warc_round_trip(spark, pages, tmp_path, split):
    folder = f"file://{tmp_path}/warc"
    warc.write(pages, folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    largest = {}
    for k, p in rows:
        if k is not None:
            largest[p] = max(k, largest.get(p, -1))
    want = Counter()
    for k, p in rows:
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        again = k is not None and largest[p] != k
        want["urn:page:" + ("" if k is None else str(k)), "revisit" if again else "response", digest,
             f"urn:page:{largest[p]}" if again else None, len(p), None if again else p] += 1
    assert Counter(
        (r.record_id, r.record_type, r.payload_digest, r.refers_to, r.http_length, None if r.payload is None else bytes(r.payload)) for r in got
    ) == want


def test_warc_edges(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/none"
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0
    small = [r for r in warc.records(pages, least=1 << 20).collect() if "revisit" in r.record[:40]]
    assert small == []
    assert list(warc.chains([(0, 50), (20, None), (50, 200), (70, 90)], 100)) == [(0, 200, 50), (50, 200, 50), (70, -1, 70)]


@pytest.mark.parametrize("links", [1, 2, 7, 40])
def test_pointer_jumping(spark, links):
    real = [(1, i, i + 1) for i in range(links)] + [(1, links, None)]
    stray = [(1, 1000, 3), (1, 1001, 1002), (1, 1002, None), (2, 0, None)]
    doors = spark.createDataFrame(real + stray, "file bigint, node bigint, leaves bigint")
    starts = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "file bigint, node bigint")
    got = {tuple(r) for r in warc.reach(doors, starts).collect()}
    assert got == {(1, i) for i in range(links + 1)} | {(2, 0)}


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    vocabulary = [f"word{i}" for i in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n)) + "."

    shared, leak = prose(60), prose(30)
    texts = [prose(int(n)) for n in rng.integers(30, 300, 60)]
    texts += [texts[3], texts[3] + " more", texts[5].replace("word1", "word1 "), f"{prose(40)} {shared} {prose(30)}", f"{prose(20)} {shared}"]
    texts += [f"{prose(40)}\n{leak}\n{prose(40)}", " ".join(rng.choice(["$$$", "&&x", "BUY!!", "A%%"], 40)), None, "", "x"]
    texts += [" ".join(rng.choice(["$$$", "&&x", "BUY!!", "A%%"], 40)) for _ in range(40)]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("$$$" not in (t or "$$$")), 0) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{corpus}/labels.parquet"), remainder("_label_key", 5) != 0)
    good = known(quality.score(docs, model).where("score >= 0.3"))
    assert 50 < len(good) < 80
    fps = [(k, brute_fingerprint(t)) for k, t in good]
    group = brute_groups({f for _, f in fps}, 4)
    firsts = [(k, t) for (k, f), (_, t) in zip(fps, good) if k == min(x for x, g in fps if g in group[f])]
    assert len(firsts) < len(good)
    gone = brute_removed(firsts)
    assert sum(map(sum, gone.values())) >= 60
    kept = [(k, [w for w, g in zip(BLANK.findall(t), gone[k, t]) if not g]) for k, t in firsts]
    items = [decontaminate.words_of(r.text or "") for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    clean = [(k, " ".join(w)) for k, w in kept if not any(brute_overlap(decontaminate.words_of(" ".join(w)), i) for i in items)]
    assert len(clean) == len(kept) - 1
    want = Counter((k, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for k, ids in reference_ids("word_bpe_49k.json", clean, 2))
    got = corpus_pipeline.run(spark, corpus).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_stages_take_awkward_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    odd = docs.withColumns({c: F.lit("own") for c in ("score", "predicted", "words", "fingerprint", "component_id", "n_removed", "ranges", "item_id")})
    odd = odd.union(odd.limit(3)).union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, corpus)
        assert got.columns == odd.columns, name
        assert 0 < got.count() <= odd.count()
        assert got.where("score != 'own'").count() == 0
        assert stage(spark, odd.limit(0), corpus).count() == 0, name


def test_near_copies_stage_keeps_one_row_of_a_group(spark, corpus):
    own, copy = " ".join(f"own{i}" for i in range(50)), " ".join(f"copy{i}" for i in range(50))
    rows = [(1, copy), (2, copy), (2, own), (None, copy), (3, own), (3, own), (None, "x"), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(known(corpus_pipeline.drop_near_copies(spark, table, corpus)), key=repr) == [(1, copy), (2, own), (None, "x")]


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
