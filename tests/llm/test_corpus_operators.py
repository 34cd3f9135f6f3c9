"""Importance resampling, run-length index and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import alignment, common, importance, licenses, quality, run_index, simhash, substrings

PASSAGE = " ".join(f"shared{i}" for i in range(90))
TEXTS = [
    None, "", " \t\n", "one", "Two words", PASSAGE, f"before {PASSAGE} after", f"other {PASSAGE}", PASSAGE, PASSAGE,
    "same " * 200, "ÀÉÎ ünïcode \U0001f600 x\x1cy, isn't it?\r\n\r\n  New;\r\nline\tTab.  12,5 × é ﬁ ①\xa0z", "a" * 900, "ab" * 500,
    "<|endoftext|> <s> plain", "▁ odd mark", "x" * 3000 + " tail", "\n\n lead and trail \n ", "日本語のテキスト 混ぜ text", "\x00nul\x7f",
]
SCHEMA = "doc_id bigint, text string, n_a string, rank string, score string, n_bytes string, _key string, _text string, _row string"


@pytest.fixture(scope="module")
def docs(spark):
    """All texts, repeated rows, rows without a key, and extra columns with the operators' names."""
    extra = ("a", "b", "c", "d", "e", "f", "g")
    rows = [(i, t, *extra) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, f"no key {PASSAGE}", *extra), (None, None, *extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def known(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same_rows(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# ---------------------------------------------------------------- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_features(text):
    words = WORD.findall(text.translate(LOWER))
    runs = words + [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_sample(rows, target, percent=25, least=20):
    found = [(k, *brute_features(t)) for k, t in rows]
    s, t = Counter(x for r in found for x in r[2]), Counter(x for u in target for x in brute_features(u)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (total_s + 10_000) / ((s[i] + 1) * (total_t + 10_000)))) for i in range(10_000)]
    out = []
    for key, n, places in found:
        weight = sum(gain[p] for p in places) // len(places) if places else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(places), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def test_resampling_equals_brute_force(spark, docs, none):
    rng = random.Random(1)
    more = [(100 + i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 60)))) for i in range(300)]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    target = [" ".join(f"w{i}" for i in range(0, 60, 3)), None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table, goal).select("doc_id", "n_features", "weight", "score", "rank")
    want = brute_sample(known(table), [t or "" for t in target])
    same_rows(got.collect(), want)
    assert sum(r[4] is not None for r in want) > 50
    assert importance.resample(none, goal).count() == 0
    empty = importance.resample(table, goal.limit(0)).select("doc_id", "n_features", "weight", "score", "rank")
    same_rows(empty.collect(), brute_sample(known(table), []))


@pytest.mark.parametrize("most", [10**6, 1])
def test_cutoff_is_the_rank(spark, most):
    rng = random.Random(4)
    values = [rng.randint(-40, 40) for _ in range(3000)] + [5] * 800
    rows = spark.createDataFrame([(v,) for v in values], "score bigint").repartition(7).cache()
    ordered = sorted(values, reverse=True)
    for n in (1, 17, 1500, len(values)):
        score, above = importance.cutoff(rows, n, margin=1e-4, most=most)
        assert score == ordered[n - 1] and above == sum(v > score for v in values)


def test_ties_are_cut_by_key(spark):
    scored = spark.createDataFrame([(i, 3 if i % 2 else 7) for i in range(100)], "_key bigint, score bigint").repartition(4)
    got = {r["_key"]: r["rank"] for r in importance.draw(scored.cache(), 60).collect()}
    assert got == {k: i + 1 for i, k in enumerate([*range(0, 100, 2), *range(1, 21, 2)])}


# ---------------------------------------------------------------- run-length index


def brute_removed(texts, size):
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_index_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([1, 3, 5])
        parts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))})
        index = run_index.RunIndex(parts, size)
        assert index.lengths.sum() == sum(max(len(p) - size + 1, 0) for p in parts)
        for k, p in enumerate(parts):
            for i, found in enumerate(index.statistics(k)):
                best = 0
                for m, q in enumerate(parts):
                    for j in range(len(q) - size + 1):
                        if (m, j) != (k, i):
                            n = 0
                            while i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n]:
                                n += 1
                            best = max(best, n)
                assert found == (best if best >= size else 0)


def test_repeats_equal_brute_force(docs, none):
    rows = known(docs)
    got = run_index.remove_repeats(docs, spans=True).collect()
    want = brute_removed([t.encode() for _, t in rows], 400)
    same_rows([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], [(k, *w) for (k, _), w in zip(rows, want)])
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
    assert sum(w[1] for w in want) > 5000 and run_index.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most, segment", [(1024, 1 << 20), (1, 37)])
def test_repeats_of_random_letters(spark, monkeypatch, most, segment):
    """Also with cores that are too frequent for an index, and with texts cut into segments."""
    monkeypatch.setattr(run_index, "SEGMENT", segment)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [texts[i][5:40] + "x" + texts[i + 1][:50] for i in range(15)] + ["a" * 100, "ab" * 60, texts[3]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = run_index.remove_repeats(table, threshold=20, gram=4, span=7, most=most).collect()
    want = brute_removed([t.encode() for t in texts], 20)
    same_rows(got, [(i, *w) for i, w in enumerate(want)])


# ---------------------------------------------------------------- tokenizer alignment


def brute_alignment(rows):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = alignment.Aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    found, counts = [], Counter()
    for key, text in rows:
        raw = (" " + text).encode()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        if not text or b"".join(table.b_bytes[x] for x in b) != raw:
            found.append((key, None))
            continue
        ends_a, ends_b = np.cumsum([table.a_size[x] for x in a]), np.cumsum([len(table.b_bytes[x]) for x in b])
        links = [
            (x, y) for x, s, e in zip(a, [0, *ends_a], ends_a) for y, t, f in zip(b, [0, *ends_b], ends_b) if s < f and t < e
        ]
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups = [
            ",".join(str(x) for x, e in zip(a, ends_a) if lo < e <= hi) + "|" + ",".join(str(y) for y, e in zip(b, ends_b) if lo < e <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        ]
        counts.update(links)
        found.append((key, (len(a), len(b), groups, links)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (key, 0, 0, 0, 0, 0, 0, "") if of is None else (
            key, of[0], of[1], len(of[2]), len(of[3]), sum(counts[x] == most[x[1]] for x in of[3]), sum(counts[x] for x in of[3]),
            hashlib.sha256(";".join(of[2]).encode()).hexdigest(),
        )
        for key, of in found
    ]


@pytest.mark.parametrize("size", [1 << 20, 150])
def test_alignment_equals_brute_force(docs, none, monkeypatch, size):
    monkeypatch.setattr(alignment.sums_of_counts, "__defaults__", (size,))
    rows = [(k, t if len(t) < 2000 else t) for k, t in known(docs)]
    got = alignment.compare(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same_rows(got.collect(), brute_alignment(rows))
    assert alignment.compare(none).count() == 0


def test_pieces_join_to_the_whole_text():
    """Random texts of awkward characters: both tokenizers give the same ids by pieces and whole."""
    rng = random.Random(6)
    table = alignment.Aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    signs = ["a", "B", "the", " ", "  ", "\n", "\r\n", "\t", "\r", "\xa0", "　", ";", ")", "{", "'s", ".", "é", "日", "\x1c", "<s>", "<0x41>", "1"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 25)))
        pieces = alignment._PIECE.findall(" " + text)
        assert "".join(pieces) == " " + text
        assert [x for p in pieces for x in table.a.encode_ordinary(p)] == table.a.encode_ordinary(" " + text), text
        assert [x for ids in table.second(pieces) for x in ids] == table.b.encode(text), text


# ---------------------------------------------------------------- shared parts


def test_bit_sets_hold_their_hashes(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = common.bits_for(5000)
    table = np.frombuffer(common.hash_bits(rows, "h", bits), np.uint8)
    own = np.array([r.h for r in rows.collect()], np.int64).view(np.uint64)
    assert len(table) == 1 << (bits - 3) and common.in_bits(table, own, bits).all()
    other = np.array([r.h for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert common.in_bits(table, other.view(np.uint64), bits).mean() < 0.01
    assert not any(common.hash_bits(rows.limit(0), "h", 15))


def test_clashing_columns_are_kept(spark):
    copy = " ".join(f"copy{i}" for i in range(60))
    names = ["_tie", "_ranges", "_removed", "_kept", "_row_hash", "_text_hash", "_row", "_key"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate([copy, f"x {copy}", copy, None])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    assert {tuple(r) for r in kept.collect()} <= set(rows)
    cut = substrings.cut_documents(table, removed="words_cut")
    assert cut.columns == [*table.columns, "words_cut"]
    same_rows(
        [(r.doc_id, r.words_cut, *(r[n] for n in names)) for r in cut.collect()],
        [(0, 0, *rows[0][2:]), (1, 60, *rows[1][2:]), (2, 60, *rows[2][2:]), (3, 0, *rows[3][2:])],
    )


def test_long_collections_of_notices():
    words, found = licenses.places("cc by mit license gnu genral public license " * 20_000)
    assert words == 160_000 and len(found) == 60_000
    assert found[:3] == [(2, 0, 2, 0), (3, 2, 2, 0), (0, 4, 4, 1)]


def test_score_equals_the_rules(spark):
    rules = (
        quality.Rule((("words", True, 4.0),), 1.5), quality.Rule((("stops", False, 0.01), ("words", False, 2.0)), -0.75),
        quality.Rule((("word_length", False, 3.0),), 0.25),
    )
    model = quality.Model(-0.5, rules)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    stats = quality.statistics(table.withColumn("_in", F.col("text")), "_in").collect()
    scores = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    for r in stats:
        z = model.intercept + sum(
            rule.weight for rule in rules if all((r[n] <= v) == at_most for n, at_most, v in rule.conditions)
        )
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert {r.doc_id for r in quality.accepted(table, model, threshold=0.5).collect()} == {k for k, s in scores.items() if s >= 0.5}
