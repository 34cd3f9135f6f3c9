"""Operators on texts against brute-force versions, on texts with every awkward case."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, host_rules, language, licenses, packing, quality, simhash, substrings, token_files, tokens
from maskwright.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 7919}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    None, "", " \t\n", "one", "Two words", PASSAGE, f"before {PASSAGE} after", f"other {PASSAGE}", PASSAGE + " tail",
    LONG, LONG, LONG + " end", "same " * 50, "same " * 30, "ÀÉÎ ünïcode space \U0001f600 x\x1cy",
    f"{PASSAGE} {PASSAGE}", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s t u",
    "It's the end, isn't it? <|endoftext|> Yes.\n\nNew  line, here.\tTab. 12,5 ×, é.",
]
SCHEMA = "doc_id bigint, text string, n_words string, score string, fingerprint string, start string, ranges string, words string"


@pytest.fixture(scope="module")
def docs(spark):
    """All texts, a repeated row, a row without a key, and extra columns with the operators' names."""
    rows = [(i, t, "x", "y", "z", None, "r", "w") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, f"no key {PASSAGE}", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def known(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- substrings


def brute_removed(rows, size=20):
    """{(key, text): removed words} by looking at every window."""
    unique = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, out = {}, {}
    for key, text in unique:
        words = BLANK.findall(text)
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            gram = tuple(words[s : s + size])
            if first.setdefault(gram, (key, text, s)) != (key, text, s):
                gone[s : s + size] = [True] * size
        out[key, text] = gone
    return out


def test_substrings_equal_brute_force(docs):
    rows = known(docs)
    rows = [r for r in rows if r[0] is not None]
    want = brute_removed(rows)
    got = substrings.keep_first(docs.where("doc_id IS NOT NULL")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        gone = want[r.doc_id, texts[r.doc_id]]
        kept = [w for w, g in zip(BLANK.findall(texts[r.doc_id]), gone) if not g]
        assert (r.n_words, r.n_removed) == (len(gone), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert BLANK.findall(r.kept or "") == kept
    assert sum(r.n_removed for r in got) > 30_000


def test_substrings_random_words(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 2, rng.integers(0, 60)))) for i in range(40)]
    rows += [(40 + i, rows[i][1][:70] + " " + rows[i + 1][1]) for i in range(20)]
    want = brute_removed(rows, 8)
    got = substrings.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=8, gram=3).collect()
    assert {r.doc_id: r.n_removed for r in got} == {k: sum(g) for (k, _), g in want.items()}


def test_substrings_null_key_and_columns(docs, none):
    got = substrings.cut_documents(docs)
    assert got.columns == [*docs.columns, "_removed"] and got.count() == docs.count()
    # a row without a key comes first and keeps its passage
    assert got.where("doc_id IS NULL AND text IS NOT NULL").first().text == f"no key {PASSAGE}"
    assert got.where("doc_id = 0").first().text is None
    assert substrings.keep_first(none).count() == 0


def test_smallest_is_the_rightmost():
    h = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64) << np.uint64(40)
    want = [max((i + j for j in range(7) if h[i + j] == h[i : i + 7].min())) for i in range(len(h) - 6)]
    assert substrings.smallest(h, 7).tolist() == want


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in BLANK.findall(text)]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance):
    group = {f: {f} for f in fps}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= distance and group[a] is not group[b]:
            group[a] |= group[b]
            for f in group[b]:
                group[f] = group[a]
    return group


def test_simhash_equals_brute_force(docs, none):
    rows = known(docs)
    fps = [(k, brute_fingerprint(t)) for k, t in rows]
    group = brute_groups({f for _, f in fps}, 4)
    want = sorted(((k, f"{f:016x}", min((x for x, g in fps if g in group[f] and x is not None), default=None)) for k, f in fps), key=repr)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_group_is_kept(docs, spark, none):
    own = " ".join(f"own{i}" for i in range(50))
    rows = [
        (1, PASSAGE, "a"), (1, own, "a"), (1, PASSAGE, "b"), (2, PASSAGE, "c"), (None, PASSAGE, "d"), (None, own, "e"),
        *[(None, LONG, None)] * 3, *[(5, "one two", "f")] * 4, (6, None, "g"), (None, "", "h"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, _key string").repartition(3)
    got = simhash.keep_first(table)
    assert got.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, PASSAGE), (1, own), (None, LONG), (5, "one two"), (6, None)])
    assert rows_of(simhash.keep_first(table.repartition(7)), *table.columns) == rows_of(got, *table.columns)
    group = brute_groups({brute_fingerprint(t) for _, t in known(docs)}, 4)
    kept = simhash.keep_first(docs)
    assert kept.count() == len({min(g) for g in group.values()}) and kept.columns == docs.columns
    assert simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("distance", [2, 4, 6])
def test_links_lose_none(spark, distance):
    rng = np.random.default_rng(distance)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)}
    for f in list(fps):
        for n in range(8):
            fps.add(f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), distance)
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert {tuple(r) for r in got.collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- tokens, packing, files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    letters = list("ab'stAÉ× ,.!1\n\t\r\x1c\x85 　​漢ß́Σ<|>")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    table = tokens.Pieces(public_tokenizers.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert table.encode(texts) == want
    tokens_kept, tokens.PIECES_KEPT = tokens.PIECES_KEPT, 50
    try:
        assert [table.encode([t])[0] for t in texts[:300]] == want[:300]
    finally:
        tokens.PIECES_KEPT = tokens_kept


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_before_a_mark_equal_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    letters = [chr(c) for c in range(ord("A"), 0x250) if chr(c).isalpha()]
    texts = ["TÜRKİYE CUMHURİYETİ. ANKARA", *(f"ab {before}{c}{mark} x" for c in letters for before in ("", "x", "'", "1") for mark in ".,")]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Pieces(public_tokenizers.path(name)).encode(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_share_their_words(name):
    import public_tokenizers

    table = tokens.Pieces(public_tokenizers.path(name))
    sent = []
    model = table.tokenizer
    table.tokenizer = type("Counting", (), {
        "encode_batch_fast": lambda _, texts, **how: sent.extend(texts) or model.encode_batch_fast(texts, **how),
    })()
    marks = [".", ",", "&&&", ".%%%", "!", ""]
    table.encode([f"été{m} Straße{m}\nword{m} word{m}" for m in marks])
    assert set(table) == {"été", " Straße", "\n", "word", " word", *marks} - {""}
    assert set(sent) == {"\n", *marks} - {""}  # words go to the model alone


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_beside_wide_space_and_marks(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    letters = list("as'tE.!&_-1²\n\t\r\x0b\x0c\x1f\x7f\x85\xa0    éÉàè×÷İıſªµɐ\u1680\u2003\u2028\u202f\u205f\u3000\u200b漢\u0307\u0301Σ“”…–😀K=\u0338")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(5000)]
    texts += ["", "\n", " \n a", "\n\na", "a \n", "a  ", "a\u3000  b", "a\xa0 ", "x<|endoftext|>y"]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Pieces(public_tokenizers.path(name)).encode(texts) == want


def test_ids_are_counted_over_rows():
    import pyarrow as pa

    rows = [np.array(x, "<u2").tobytes() for x in ([7], [1, 2, 3], [], [4, 5])]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array(rows, kind)
        runs = list(token_files.id_runs(column, "<u2"))
        assert [r.tolist() for r in runs] == [[7, 1, 2, 3, 4, 5]]  # one run, not one a document
        assert [r.tolist() for r in token_files.id_runs(column.slice(1, 2), "<u2")] == [[1, 2, 3]]
        assert not list(token_files.id_runs(column.slice(0, 0), "<u2"))


def test_long_texts_are_cut_in_parts(spark, monkeypatch):
    import pyarrow as pa

    rows = [(1, "ab " * 400), (None, None), (2, ""), (2, "x" * 3000), (3, "é, b")]
    batch = pa.record_batch([pa.array([k for k, _ in rows]), pa.array([t or "" for _, t in rows])], names=["doc_id", "_text"])
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", 1000)
    parts = list(tokens.parts_of(batch))
    assert len(parts) > 1 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]).combine_chunks())
    assert not list(tokens.parts_of(batch.slice(0, 0)))
    monkeypatch.undo()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for kind in ("<u4", "<u2"):
        got = Counter((r.doc_id, bytes(r.ids)) for r in tokens.tokenize(docs, "byte_bpe_50k.json", 0, kind=kind).collect())
        want = [(k, np.array(ids, kind).tobytes()) for k, ids in reference_ids("byte_bpe_50k.json", [(k, t or "") for k, t in rows], 0)]
        assert got == Counter(want)


def reference_ids(name, rows, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    return [(k, [*whole.encode(t, add_special_tokens=False).ids, end]) for k, t in rows]


def test_lengths_come_by_one_job_however_many_partitions(spark):
    confs = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    pieces = spark.range(300).selectExpr("id AS doc_id", "0L AS start", "1 + id % 150 AS length")
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("place", "lengths of pieces")
        placed = packing.place(pieces)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("place")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < len(jobs) < 32
    assert placed.count() == 300 and placed.agg(F.sum("length")).first()[0] == 300 * 151 // 2


def test_packing(docs, none):
    got = packing.pack_documents(docs, "word_bpe_49k.json", 2, keep_ids=True).cache()
    pieces = got.collect()
    want = Counter(
        (k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids))
        for k, ids in reference_ids("word_bpe_49k.json", known(docs), 2) for s in range(0, len(ids), 4096)
    )
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    used = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 4096
    assert len(used) <= -(-sum(used.values()) // 4096) + 1
    by_id = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(got).collect()}
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4")
        assert (by_id[p.sequence_id][p.offset : p.offset + p.length] == own).all()
    assert all(len(x) == 4096 or len(x).bit_count() == 1 for x in by_id.values())
    assert packing.pack_documents(none, "word_bpe_49k.json", 2).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_place_every_length_once(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(rng.integers(1, 101, 400).tolist() + [100] * 7 + [3] * 50)
    made = packing.patterns(histogram, 100)
    placed = Counter()
    for packs, pattern in made:
        assert sum(length * n for length, n in pattern) <= 100 and packs > 0
        for length, n in pattern:
            placed[length] += packs * n
    assert placed == histogram
    assert packing.patterns({}) == [] and packing.slots([]).shape == (0, 5)


def test_token_files(spark, docs, none, tmp_path):
    folder = f"file://{tmp_path}/ids"
    token_files.write_documents(docs, folder, "byte_bpe_50k.json", 0)
    got = token_files.read_ids(spark, folder).orderBy("start").collect()
    want = reference_ids("byte_bpe_50k.json", known(docs), 0)
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((k, np.array(i, "<u4").tobytes()) for k, i in want)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    ends = np.cumsum([len(r.ids) // 4 for r in got])
    assert [r.start for r in got] == [0, *ends[:-1]]
    token_files.write_documents(none, folder + "0", "byte_bpe_50k.json", 0)
    assert token_files.read_ids(spark, folder + "0").count() == 0


def test_repeated_rows_are_spread(spark, tmp_path, monkeypatch):
    rows = [(None, "same text")] * 900 + [(i, f"text {i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = f"file://{tmp_path}/ids"
    token_files.write_documents(table, folder, "byte_bpe_50k.json", 0)
    files = spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum(F.size("keys")).alias("n")).collect()
    assert sum(r.n for r in files) == 1200 and max(r.n for r in files) < 700
    monkeypatch.setattr(packing, "CHUNK", 100)
    pieces = table.select("doc_id", F.lit(0).cast("long").alias("start"), F.monotonically_increasing_id().alias("_row")).cache()
    by = packing.dealt_out(pieces, "doc_id", 64, "_row")
    assert max(r["count"] for r in by.groupBy("_bucket").count().collect()) < 100
    alone = by.where("doc_id IS NOT NULL")
    assert alone.where("_bucket != pmod(xxhash64(doc_id, start), 64)").count() == 0 and alone.count() == 300
    got = packing.pack_documents(table, "word_bpe_49k.json", 2, size=64)
    assert "_row" not in got.columns and got.count() == 1200
    assert got.select("sequence_id", "offset").distinct().count() == 1200
    packed = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.where("n != end OR n > 64").count() == 0


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_huffman_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.2, n) % 3000
    counts = np.bincount(ids)
    lengths = token_files.code_lengths(counts)
    codes = token_files.canonical_codes(lengths)
    payload, offsets = token_files.encode(ids, lengths, codes)
    assert (token_files.decode(payload, offsets, n, token_files.decoding_table(lengths)) == ids).all()


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 300)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    free = np.zeros(300, int)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        free[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1] + 1000, a[2] + b[2]))
    assert (counts * token_files.code_lengths(counts)).sum() == (counts * free).sum()
    steep = np.array([1 << min(i, 60) for i in range(40)])
    lengths = token_files.code_lengths(steep, 8)
    assert lengths.max() <= 8 and sum(2.0**-x for x in lengths) <= 1


# ---------------------------------------------------------------- decontamination


def test_masks_miss_no_two_substitutions():
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(
            not {at + p for p in mask} & set(bad) for mask in decontaminate.MASKS for at in range(decontaminate.WINDOW - mask[-1])
        ), bad


def brute_overlap(doc, item):
    """Whether some stretch of the item's window size differs in two words at most, of a shorter item in one or none."""
    size = min(13, len(item))
    allowed = 2 if len(item) >= 13 else 1 if len(item) >= 7 else 0
    return size >= 5 and any(
        sum(x != y for x, y in zip(doc[a : a + size], item[b : b + size])) <= allowed
        for a in range(len(doc) - size + 1) for b in range(len(item) - size + 1)
    )


def test_contamination_equals_brute_force(spark, none):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"b{x}" for x in rng.integers(0, 400, n))) for i, n in enumerate([40, 13, 12, 5, 7, 0, 60])] + [(7, None)]
    rows = [(None, items[0][1]), (1, None), (2, "")]
    for i in range(60):
        base = [f"d{x}" for x in rng.integers(0, 400, 30)]
        own = (items[i % 8][1] or "").split()
        at = rng.integers(0, max(1, len(own) - 12))
        piece = own[at : at + rng.integers(10, 20)] if i % 3 else own
        for p in rng.choice(len(piece), min(len(piece), i % 5), replace=False) if piece else []:
            piece[p] = "other"
        rows.append((10 + i, " ".join(base[:15] + piece + base[15:])))
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(10, rows[3][1], "x")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {
        (k, i) for k, t in rows for i, u in items
        if brute_overlap(decontaminate.words_of(t or ""), decontaminate.words_of(u or ""))
    }
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in want}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_clean_judges_texts_of_one_key_each(spark):
    bench = spark.createDataFrame([(0, PASSAGE)], "item_id bigint, text string")
    leak, fine = f"x {PASSAGE} y", "nothing of it"
    rows = [(None, leak), (None, fine), (None, None), (1, leak), (1, fine), (1, fine), (2, leak), (3, leak + " z"), (3, "")]
    table = spark.createDataFrame([(*r, "a", 7) for r in rows], "doc_id bigint, text string, item_id string, _tie int")
    want = [(k, t, "a", 7) for k, t in rows if not t or t == fine]
    assert rows_of(decontaminate.clean(table, bench), *table.columns) == sorted(want, key=repr)


# ---------------------------------------------------------------- licenses


def test_license_notices(docs, none):
    n, found = licenses.places("Released under the GNU-General public License, or the gnu genral public licence! CC BY mit license mit license")
    phrase = [(licenses.NOTICES[i][0], at, words, errors) for i, at, words, errors in found]
    assert ("gnu general public license", 3, 4, 0) in phrase and ("gnu general public license", 9, 4, 2) in phrase
    assert ("cc by", 13, 2, 0) in phrase and [p[1] for p in phrase if p[0] == "mit license"] == [15, 17]
    assert licenses.places("summit license xmit licenses")[1] == [] or all(p[3] for p in licenses.places("summit license xmit licenses")[1])
    got = licenses.summary(licenses.scan(docs))
    assert got.count() == docs.count()
    assert rows_of(got.where("doc_id = 0"), "n_words", "n_base", "first_word", "base_labels", "labels", "score") == [(0, 0, None, "", "", 0.0)]
    assert licenses.scan(none).count() == 0


def test_license_base_places_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = "gnu general public license apache cc by mit the MIT x".split()
    texts = [(i, " ".join(rng.choice(vocabulary, 60))) for i in range(80)]
    got = licenses.summary(licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"))).collect()
    for r in got:
        words = texts[r.doc_id][1].lower().split()
        at = [(i, label) for p, label in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert r.n_base == len(at) and r.first_word == min((i for i, _ in at), default=None)
        assert r.last_word == max((i for i, _ in at), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.score == (1.0 if at else r.score)


# ---------------------------------------------------------------- rules, classifier, language


def brute_measure(text):
    words = BLANK.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_host_rules(spark, docs, none):
    rows = known(docs) + [(50, "a\nb\n a\na\n\n \na b # $"), (51, " ".join(map(str, range(40))))]
    sources = [None if i % 3 == 0 else f"h{i % 3}" for i in range(len(rows))]
    table = spark.createDataFrame([(k, t, s) for (k, t), s in zip(rows, sources)], "doc_id bigint, text string, source string")
    got = host_rules.judge(table)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(got, *names) == sorted(((k, *brute_measure(t)) for k, t in rows), key=repr)
    assert got.where("kept AND base_failed").count() == 0
    assert host_rules.judge(none.withColumn("source", F.lit("h"))).count() == 0


def test_bad_host_loses_its_other_documents(spark):
    rows = [(i, "x", "bad") for i in range(95)] + [(95 + i, " ".join(map(str, range(20 + i))), "bad") for i in range(5)]
    rows += [(200 + i, " ".join(map(str, range(20 + i % 9))), f"good{i % 4}") for i in range(100)]
    kept = host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept")
    assert {r.doc_id for r in kept.collect()} == set(range(200, 300))


def test_quality_held_out(spark, docs, none):
    rng = np.random.default_rng(6)
    good = [(i, " ".join(rng.choice(["tree", "house", "river", "walks", "slowly"], 40)) + ".", 1) for i in range(300)]
    junk = [(300 + i, " ".join(rng.choice(["$$$", "&&x", "BUY!!", "A%%"], 40)), 0) for i in range(150)]
    table = spark.createDataFrame(good + junk, "doc_id bigint, text string, label int")
    labels = table.select("doc_id", F.col("label").alias("quality")).union(spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id bigint, quality int"))
    model = quality.learn(table.select("doc_id", "text"), labels, F.col("_label_key") % 5 != 0)
    assert 0 < len(model.rules) < 12 * 14
    got = quality.score(table, model).where("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    rated = quality.score(docs, model)
    assert rated.count() == docs.count() and rated.where("score IS NULL OR isnan(score)").count() == 0
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.score(none, model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        constant = quality.learn(table, few, F.lit(True))
        assert constant.rules == () and quality.score(docs, constant).where("score < 0.3").count() == 0


def test_language_held_out(spark, docs, none):
    rng = np.random.default_rng(8)
    parts = {"xx": ["ka", "to", "mi", "ra"], "yy": ["sch", "ung", "ber", "ein"], "zz": ["ção", "lh", "nh", "os"]}
    rows = [(i, " ".join("".join(rng.choice(p, 3)) for _ in range(30)), name) for i in range(150) for name, p in [list(parts.items())[i % 3]]]
    table = spark.createDataFrame([*rows, (999, "ka to", None), (1000, None, "xx"), (1001, "12 !", "ww")], "doc_id bigint, text string, lang string")
    names, profiles = language.learn(table, F.col("doc_id") % 4 != 2)
    assert names == ["xx", "yy", "zz"]
    got = language.predict(table, names, profiles).where("doc_id < 150").collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got if r.doc_id % 4 == 2]) == 1
    rest = {r.doc_id: r for r in language.predict(docs, names, profiles).collect()}
    assert rest[0].lang_pred == rest[1].lang_pred == rest[2].lang_pred == "und" and rest[0].score == 0
    assert all(0 <= r.score <= 1 for r in rest.values())
    assert language.predict(docs, [], profiles).where("lang_pred != 'und'").count() == 0
    assert language.predict(none, names, profiles).count() == 0


def test_bundle_is_the_sum_of_bound_letters():
    space = language.Space()
    codes = space.codes(" ab ")
    want = sum(
        space.places[0][codes[i]].astype(int) * space.places[1][codes[i + 1]] * space.places[2][codes[i + 2]] for i in range(len(codes) - 2)
    )
    assert (space.bundle(["ab"])[0] == want).all()


@pytest.mark.parametrize("most", [1, 10, 30, 1000])
def test_seeds_of_batches_equal_those_of_single_texts(most):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 9, n))) for n in (0, 1, 3, 12, 13, 14, 0, 40, 5)]
    single = [decontaminate.hashes_of(decontaminate.words_of(t)) for t in texts]
    for mask in (*decontaminate.MASKS, tuple(range(5))):
        got = []
        for first, held in decontaminate.batches(texts, most):
            row, start, h = decontaminate.seeds_of_many(held, mask)
            got += zip((row + first).tolist(), start.tolist(), h.tolist())
        assert got == [(i, j, int(x)) for i, h in enumerate(single) for j, x in enumerate(decontaminate.seeds(h, mask))]
