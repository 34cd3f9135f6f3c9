"""Benchmark passages in documents: spaced seeds, hash join, verification that allows substitutions.

Two stretches of ``WINDOW`` words overlap if at most ``SUBSTITUTIONS`` words at equal places differ.  A mask
names the places that a seed reads and ignores the others; the masks are chosen so that every overlap
leaves at least one seed of one mask untouched, so none is missed.  Items shorter than the window must
stand whole: from ``ONE_FROM`` words on with one substitution at most, found by a mask of every second place,
shorter ones unchanged, by a mask of their own length; items under ``LEAST`` words are no evidence and match
nothing.  In scripts that are written without blanks every character is a word.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.llm.common import hash_bits, hashes_of, in_bits, map_rows, mix, salted_join, text_or_empty, written

WINDOW = 13
SUBSTITUTIONS = 2
LEAST = 5
ONE_FROM = 7
#: Places read; any two substitutions in thirteen words leave one of them whole somewhere (see the tests).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 9, 10))
# Words whose seeds are computed together: bounds the memory of a batch of long texts.
WORDS_AT_ONCE = 1 << 18
# Places of the bit sets over seeds and over documents: 2 MB each, whatever the input.
BITS = 24
# Thai to Khmer and Chinese to Japanese characters: scripts without blanks between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; single characters of scripts without blanks."""
    return _WORD.findall(text.lower())


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of ``n`` words.

    Of every second place there is one start of an even and one of an odd place; a single substitution leaves
    one of them whole.
    """
    if n >= WINDOW:
        return MASKS
    if n >= ONE_FROM:
        return (tuple(range(0, n // 2 * 2, 2)),)
    return (tuple(range(n)),) if n >= LEAST else ()


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash for every start of the mask in a row of word hashes."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask) * 64 + mask[-1], np.uint64)
    for factor, at in zip(_FACTORS, mask):
        total += h[at : at + n] * factor
    return mix(total)


def seeds_of_many(rows: list[np.ndarray], mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, hash) of the seeds of many rows of word hashes, taken at once; none spans two rows."""
    sizes = np.array([len(r) for r in rows], np.int64)
    got = seeds(np.concatenate(rows) if rows else np.zeros(0, np.uint64), mask)
    row = np.repeat(np.arange(len(rows)), sizes)[: len(got)]
    start = np.arange(len(got)) - (np.cumsum(sizes) - sizes)[row]
    inside = start + mask[-1] < sizes[row]
    return row[inside], start[inside], got[inside]


def batches(texts: list[str], most: int = WORDS_AT_ONCE):
    """(first row, word hashes of some rows): a batch is closed by the text that brings it to ``most`` words."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(hashes_of(words_of(t)))
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def overlaps(doc: list[str], item: list[str], diagonal: int) -> list[tuple[int, int, int]]:
    """(first word, end, substitutions): maximal overlapping stretches of a document, the item laid at ``diagonal``."""
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    differ = np.array([doc[p] != item[p - diagonal] for p in range(a, b)], np.int64)
    if len(item) < WINDOW:
        allowed = 1 if len(item) >= ONE_FROM else 0
        return [(a, b, int(differ.sum()))] if b - a == len(item) >= LEAST and differ.sum() <= allowed else []
    if b - a < WINDOW:
        return []
    total = np.concatenate([[0], np.cumsum(differ)])
    good = total[WINDOW:] - total[:-WINDOW] <= SUBSTITUTIONS
    cover = np.zeros(b - a + 1, np.int64)
    cover[: len(good)] += good
    cover[WINDOW:] -= good
    inside = np.cumsum(cover)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]))).reshape(-1, 2)
    return [(int(a + x), int(a + y), int(differ[x:y].sum())) for x, y in edges]


def _tie(text: Column) -> Column:
    """Tells texts of one key apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _verified(
    docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str
) -> DataFrame:
    """(_key, _tie, _item, spans): a row for each text of a key and each item that overlap."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), _tie(F.col(text)).alias("_tie"), text_or_empty(text).alias("_text"))
    items = benchmark.select(F.col(item_key).alias("_item"), text_or_empty(item_text).alias("_words")).distinct()

    def item_seeds(columns):
        out = {"_item": [], "_h": [], "at": [], "span": []}
        for item, t in zip(columns["_item"], columns["_words"]):
            h = hashes_of(words_of(t))
            for mask in masks_of(len(h)):
                got = seeds(h, mask)
                out["_item"] += [item] * len(got)
                out["_h"] += got.view(np.int64).tolist()
                out["at"] += range(len(got))
                out["span"] += [min(len(h), WINDOW)] * len(got)
        return out

    index = written(map_rows(items, item_seeds, f"_item {item_kind}, _h bigint, at int, span int"), "seeds")
    bits = spark.sparkContext.broadcast(hash_bits(index, "_h", BITS))
    # at most nine lengths; a mask that no item was cut with can meet nothing
    spans = {r["span"] for r in index.select("span").distinct().collect()}
    used = sorted({m for n in spans for m in masks_of(n)})

    def hits(columns):
        table = np.frombuffer(bits.value, np.uint8)
        out = {"_key": [], "_tie": [], "_h": [], "at": []}
        for first, held in batches(columns["_text"]):
            for mask in used:
                row, start, got = seeds_of_many(held, mask)
                hit = np.flatnonzero(in_bits(table, got, BITS))
                of = (row[hit] + first).tolist()
                out["_key"] += [columns["_key"][i] for i in of]
                out["_tie"] += [columns["_tie"][i] for i in of]
                out["_h"] += got[hit].view(np.int64).tolist()
                out["at"] += start[hit].tolist()
        return out

    found = map_rows(rows, hits, f"_key {kind}, _tie bigint, _h bigint, at int")
    joined = salted_join(found, index.select("_item", "_h", F.col("at").alias("item_at")), ["_h"], F.xxhash64("_key", "at"))
    candidates = written(
        joined.select("_key", "_tie", "_item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "candidates"
    )
    of_item = candidates.groupBy("_key", "_tie", "_item").agg(F.collect_list("diagonal").alias("diagonals"))
    with_words = of_item.alias("c").join(items.alias("i"), F.expr("c._item <=> i._item")).select("c.*", "i._words")
    of_doc = with_words.groupBy("_key", "_tie").agg(F.collect_list(F.struct("_item", "_words", "diagonals")).alias("_items"))
    marked = candidates.select(F.xxhash64("_key", "_tie").alias("_h")).distinct()
    wanted = spark.sparkContext.broadcast(hash_bits(marked, "_h", BITS))

    def possible(columns):
        own = np.array(columns["_h"], np.int64).view(np.uint64)
        keep = np.flatnonzero(in_bits(np.frombuffer(wanted.value, np.uint8), own, BITS))
        return {c: [columns[c][i] for i in keep] for c in ("_key", "_tie", "_text")}

    few = map_rows(
        rows.withColumn("_h", F.xxhash64("_key", "_tie")), possible, f"_key {kind}, _tie bigint, _text string"
    )
    to_verify = few.alias("d").join(of_doc.alias("c"), F.expr("d._key <=> c._key AND d._tie = c._tie")).select(
        "d._key", "d._tie", "d._text", "c._items"
    ).dropDuplicates(["_key", "_tie"])

    def verify(columns):
        out = {"_key": [], "_tie": [], "_item": [], "spans": []}
        for k, tie, t, found_items in zip(*(columns[c] for c in ("_key", "_tie", "_text", "_items"))):
            words = words_of(t)
            for item in found_items:
                own = words_of(item["_words"])
                spans = sorted({s for d in set(item["diagonals"]) for s in overlaps(words, own, d)})
                if spans:
                    out["_key"].append(k)
                    out["_tie"].append(tie)
                    out["_item"].append(item["_item"])
                    out["spans"].append([{"start": a, "end": b, "substitutions": n} for a, b, n in spans])
        return out

    return map_rows(
        to_verify, verify,
        f"_key {kind}, _tie bigint, _item {item_kind}, spans array<struct<start:bigint,end:bigint,substitutions:bigint>>", rows=64,
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, item_key, first_word, end_word, substitutions, spans): one row for a document and an item that overlap.

    ``spans`` holds all stretches (start, end, substitutions), the other columns the longest, the first of
    equal ones.  Null and empty texts overlap with nothing, so they give no row.  Rows with one key and
    different texts are looked at one by one; a row repeated with key and text counts once.  A null key is
    a key like any other.
    """
    verified = _verified(docs, benchmark, key, text, item_key, item_text)
    longest = F.expr("array_max(transform(spans, x -> struct(x.end - x.start AS n, -x.start AS s, x AS span))).span")
    return verified.withColumn("_best", longest).select(
        F.col("_key").alias(key), F.col("_item").alias(item_key), F.col("_best.start").alias("first_word"), F.col("_best.end").alias("end_word"),
        F.col("_best.substitutions").alias("substitutions"), "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap with no benchmark item, all columns unchanged.

    Rows with one key, or none, are judged each by its own text.
    """
    found = _verified(docs, benchmark, key, text, "item_id", "text").select(
        F.col("_key").alias("_leaked"), F.col("_tie").alias("_leaked_text")
    ).distinct()
    same = docs[key].eqNullSafe(F.col("_leaked")) & (_tie(docs[text]) == F.col("_leaked_text"))
    return docs.join(found, same, "left_anti")
