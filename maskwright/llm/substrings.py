"""Removal of repeated passages: winnowed anchors, extension both ways, maximal repeats.

Of every ``THRESHOLD`` consecutive words (a *window*) the anchor is its smallest ``GRAM``-word hash, the
rightmost of equal ones, so equal windows have equal anchors at equal places.  The windows that share an
anchor occurrence join to its *zone*: the anchor extended left and right as far as it is the anchor.

1. Anchors are joined: count, smallest and largest zone hash of each anchor of the corpus.
2. An anchor that occurs once is done.  Of the others the zones are compared; a zone that has an equal one
   earlier in the order of (key, start) is a repeat.  Where the surroundings of an anchor differ, the first
   of each kind of zone is compared window by window, so that a match goes exactly as far as the words agree.
3. Repeats of a document that overlap or touch join to maximal repeats, which are cut out.

Words are compared by sums of 64-bit hashes: two per unit, 128 bits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from maskwright.llm.common import SPACES, WORD, bits_for, hash_bits, in_bits, map_rows, mix, text_or_empty, words_of, written
from maskwright.operators.joins import CHUNK, HOT_SHARE, left_join_hot_keys

THRESHOLD = 20
GRAM = 6
# Where the start of a zone goes in the number of its place.
_START_AT = 38
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as long as the longest text so far."""

    def __init__(self, base: int):
        self.base, self.inverse_base = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n >= len(self.up):
            size = 2 * n + 1
            for name, b in (("up", self.base), ("down", self.inverse_base)):
                row = np.full(size, b, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))


# Bytes of texts whose words are hashed at once; a longer text is cut between words.
BYTES_AT_ONCE = 1 << 18
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE2))
_BLANK = np.isin(np.arange(256), list(SPACES.encode()))
_BLANK_BYTE = re.compile(rb"[\x20\x09-\x0D]")


class Hasher:
    """Hashes of words and of word sequences of many texts at once, out of prefix sums."""

    def __init__(self):
        self.powers = Powers(_BASE), Powers(_BASE2)

    def of_words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, 64-bit hash) of every word: its bytes as a polynomial."""
        data = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        p = self.powers[0]
        p.to(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * p.up[: len(data)], dtype=np.uint64)])
        value = (sums[end] - sums[start]) * p.down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE2)
        return start, mix(value)

    def groups(self, texts: list[str]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """(first text, word hashes in parts, words of each text) of texts that are hashed together."""
        held, first, size = [], 0, 0
        for i, t in enumerate(texts):
            held.append(t.encode())
            size += len(held[-1])
            if size >= BYTES_AT_ONCE or i + 1 == len(texts):
                if len(held) == 1:
                    parts = [self.of_words(p)[1] for p in _between_words(held[0])]
                    yield first, parts, np.array([sum(map(len, parts))], np.int64)
                else:
                    # the last text may be long; it goes by itself
                    long = len(held[-1]) >= BYTES_AT_ONCE
                    short = held[:-1] if long else held
                    place, h = self.of_words(b"\n".join(short))
                    ends = np.cumsum([len(b) + 1 for b in short])
                    yield first, [h], np.diff(np.searchsorted(place, ends), prepend=0)
                    if long:
                        parts = [self.of_words(p)[1] for p in _between_words(held[-1])]
                        yield i, parts, np.array([sum(map(len, parts))], np.int64)
                held, first, size = [], i + 1, 0

    def sums(self, parts: list[np.ndarray], both: bool = True) -> list[np.ndarray]:
        h = np.concatenate(parts)
        out = []
        for p in self.powers if both else self.powers[:1]:
            p.to(len(h))
            out.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p.up[: len(h)], dtype=np.uint64)]))
            h = mix(h)
        return out

    def ranges(self, sums: list[np.ndarray], which: int, start: np.ndarray, length) -> np.ndarray:
        s = sums[which]
        value = (s[start + length] - s[start]) * self.powers[which].down[start]
        return mix(value + np.asarray(length).astype(np.uint64) * np.uint64(_BASE2))


def _between_words(raw: bytes) -> list[bytes]:
    """A long text in parts of about ``BYTES_AT_ONCE``, cut at white space."""
    out, at = [], 0
    while len(raw) - at > BYTES_AT_ONCE and (m := _BLANK_BYTE.search(raw, at + BYTES_AT_ONCE)):
        out.append(raw[at : m.start()])
        at = m.start()
    return [*out, raw[at:]]


# Low bits of a hash that make room for its place when hashes are compared.
_PLACES = 24


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash in every ``width`` consecutive ones, the rightmost of equal ones.

    The top 40 bits are compared, so that hash and place fit one number; a text of more words than there
    are places is compared without.
    """
    mask = (1 << _PLACES) - 1
    top = h & np.uint64(~mask & (1 << 64) - 1)
    if len(h) > mask:
        views = np.lib.stride_tricks.sliding_window_view(top, width)
        parts = (np.argmin(views[i : i + (1 << 16), ::-1], axis=1) for i in range(0, len(views), 1 << 16))
        return np.arange(len(views)) + width - 1 - np.concatenate(list(parts))
    low = top | np.arange(mask, mask - len(h), -1, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(h) - width + 1], low[width - size :])
    return mask - (low & np.uint64(mask)).astype(np.int64)


def zones(
    hasher: Hasher, sums: list[np.ndarray], sizes: np.ndarray, threshold: int, gram: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, last window) of each anchor occurrence of texts that stand one behind the other.

    Windows are counted from the first word of all; none spans two texts.
    """
    count = np.maximum(sizes - threshold + 1, 0)
    total, n = int(count.sum()), len(sums[0]) - 1
    if not total:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    grams = hasher.ranges(sums, 0, np.arange(n - gram + 1), gram)
    at = smallest(grams, threshold - gram + 1)
    text = np.repeat(np.arange(len(count)), count)
    window = np.arange(total) + (np.cumsum(sizes) - sizes - np.cumsum(count) + count)[text]
    anchor = at[window]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    return text[first], grams[anchor[first]], window[first], window[last]


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _tie, _text): the tie tells rows of one key with different texts apart."""
    return docs.select(
        F.col(key).alias("_key"), F.xxhash64(F.col(key), text_or_empty(text)).alias("_tie"),
        text_or_empty(text).alias("_text"),
    )


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(_key, _same, ranges): word ranges [first, last) of each document that hold repeats, not merged.

    A repeat is a stretch of windows of ``threshold`` words each of which also starts earlier: in a smaller
    key, or before in the same document.  Rows with one key are ordered by a hash of their text; a row
    repeated with the same key and text is the same document.  A null key comes before all others.
    """
    spark = docs.sparkSession
    rows = _identified(docs, key, text)

    def anchors(columns, hasher):
        got = []
        for _, parts, sizes in hasher.groups(columns["_text"]):
            sums = hasher.sums(parts, both=False)
            _, a, first, last = zones(hasher, sums, sizes, threshold, gram)
            got.append((a, hasher.ranges(sums, 0, first, last - first + threshold)))
        a, z = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        return {"anchor": a.view(np.int64), "zone": z.view(np.int64)}

    seen = map_rows(rows.select("_text"), anchors, "anchor bigint, zone bigint", setup=Hasher)
    joined = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("zone").alias("z"), F.max("zone").alias("y"))
    joined = written(joined.where("n > 1").select("anchor", (F.col("z") != F.col("y")).alias("mixed")), "anchors")
    n_mixed, n_alike = joined.agg(F.count_if("mixed"), F.count_if(~F.col("mixed"))).first()
    alike_bits, mixed_bits = bits_for(n_alike), bits_for(n_mixed)
    alike = spark.sparkContext.broadcast(hash_bits(joined.where("not mixed"), "anchor", alike_bits))
    mixed = spark.sparkContext.broadcast(hash_bits(joined.where("mixed"), "anchor", mixed_bits))

    def units(columns, hasher, chosen, of=None):
        """Ranges of words that ``chosen`` takes from the zones of each text, with two hashes; of the texts ``of``, if given."""
        of = np.arange(len(columns["_text"])) if of is None else of
        keys, ties = [columns["_key"][i] for i in of], np.array(columns["_tie"], np.int64)[of]
        parts = []
        for begin, hashed, sizes in hasher.groups([columns["_text"][i] for i in of]):
            sums = hasher.sums(hashed)
            text, anchor, first, last = zones(hasher, sums, sizes, threshold, gram)
            before = np.cumsum(sizes) - sizes
            text, start, n, extra = chosen(text, anchor, first, last, before, ties[begin : begin + len(sizes)])
            parts.append((
                text + begin, start - before[text], n, hasher.ranges(sums, 0, start, n), hasher.ranges(sums, 1, start, n), extra
            ))
        none = np.zeros(0, np.int64)
        at, start, n, h1, h2, extra = (np.concatenate(c) for c in zip(*parts)) if parts else (
            none, none, none, none, none, none.astype(bool)
        )
        return {
            "_key": [keys[i] for i in at], "_tie": ties[at],
            "start": start, "n": n, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "mixed": extra,
        }

    def whole_zones(text, anchor, first, last, before, ties):
        many = in_bits(np.frombuffer(mixed.value, np.uint8), anchor, mixed_bits)
        keep = in_bits(np.frombuffer(alike.value, np.uint8), anchor, alike_bits) | many
        return text[keep], first[keep], (last - first)[keep] + threshold, many[keep]

    schema = f"_key {docs.schema[key].dataType.simpleString()}, _tie bigint, start int, n int, h1 bigint, h2 bigint, mixed boolean"
    all_zones = written(map_rows(rows, lambda c, h: units(c, h, whole_zones), schema, setup=Hasher), "zones")
    firsts = written(_firsts(all_zones), "firsts")
    # of equal zones only the first is looked at window by window: the windows of the others start there
    place = _place(F.col("first._tie"), F.col("first.start"))
    places = firsts.where("mixed").select(place.alias("p"))
    opened_bits = bits_for(places.count())
    opened = spark.sparkContext.broadcast(hash_bits(places, "p", opened_bits))

    holders = firsts.where("mixed").select(F.col("first._tie").alias("t")).distinct()
    holder_bits = bits_for(holders.count())
    holding = spark.sparkContext.broadcast(hash_bits(holders, "t", holder_bits))

    def single_windows(text, anchor, first, last, before, ties):
        keep = np.flatnonzero(in_bits(np.frombuffer(mixed.value, np.uint8), anchor, mixed_bits))
        at = (first - before[text])[keep].astype(np.uint64)
        own = ties[text[keep]].view(np.uint64) ^ (at << np.uint64(_START_AT)) ^ at
        keep = keep[in_bits(np.frombuffer(opened.value, np.uint8), own, opened_bits)]
        count = (last - first + 1)[keep]
        windows = np.repeat(first[keep] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(text[keep], count), windows, np.full(len(windows), threshold), np.ones(len(windows), bool)

    def opened_windows(columns, hasher):
        # a text none of whose zones is opened is not read any further
        ties = np.array(columns["_tie"], np.int64).view(np.uint64)
        return units(columns, hasher, single_windows, np.flatnonzero(in_bits(np.frombuffer(holding.value, np.uint8), ties, holder_bits)))

    windows = written(map_rows(rows, opened_windows, schema, setup=Hasher), "windows")
    found = _later(all_zones, firsts).union(_later(windows, written(_firsts(windows), "firsts")))
    # rows repeated with key and text give the same ranges: sets, made on the map side first
    return found.groupBy("_key", F.col("_tie").alias("_same")).agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("ranges")
    )


def _place(tie, start):
    """A number for a place in a document, as ``single_windows`` computes it."""
    return tie.bitwiseXOR(F.shiftleft(start.cast("long"), _START_AT)).bitwiseXOR(start.cast("long"))


def _firsts(units: DataFrame) -> DataFrame:
    """(h1, h2, first, times, mixed): the first place of each unit that occurs again or has mixed surroundings."""
    place = F.struct("_key", "_tie", "start")
    return units.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), F.max("mixed").alias("mixed")
    ).where("times > 1 OR mixed")


def _later(units: DataFrame, firsts: DataFrame) -> DataFrame:
    """(_key, _tie, start, n): units that are not the first of their kind.

    A unit with a large share of all rows is found by its count and joined by broadcast: fewer than
    ``HOT_SHARE`` units can be so frequent.  The rest is joined by shuffle.
    """
    again = firsts.where("times > 1")
    total = again.agg(F.sum("times")).first()[0] or 0
    hot = again.where(F.col("times") > max(CHUNK, total // HOT_SHARE)).select("h1", "h2", F.col("first").alias("hot"))
    marked = units.drop("mixed").join(F.broadcast(hot), ["h1", "h2"], "left")
    rest = marked.where("hot IS NULL").drop("hot").join(again.select("h1", "h2", "first"), ["h1", "h2"])
    both = rest.unionByName(marked.where("hot IS NOT NULL").withColumnRenamed("hot", "first"))
    place = F.struct("_key", "_tie", "start")
    return both.where(~place.eqNullSafe(F.col("first"))).select("_key", "_tie", "start", "n")


def removed_words(ranges: list[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` words the ranges cover."""
    turn = np.zeros(n + 1, np.int64)
    if ranges:
        np.add.at(turn, [r["start"] for r in ranges], 1)
        np.add.at(turn, [r["end"] for r in ranges], -1)
    return np.cumsum(turn)[:n] > 0


def _marked(docs: DataFrame, key: str, text: str, threshold: int, gram: int) -> DataFrame:
    """(_row, _key, _text, _ranges): each row with the word ranges that hold repeats, null where there are none."""
    found = repeats(docs, key, text, threshold, gram)
    # joined by hashes of key and text, which a null key has, too
    own = F.xxhash64(F.lit("key"), "_key").alias("_name")
    ranges = written(found.select(F.col("_same").alias("_tie"), own, F.col("ranges").alias("_ranges")), "ranges")
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"),
        F.xxhash64(F.col(key), text_or_empty(text)).alias("_tie"),
    ).select("*", own)
    # ranges are about ten times larger than their file
    return left_join_hot_keys(rows, ranges.hint("merge"), ["_tie", "_name"])


def without(text: str, ranges: list[dict] | None) -> tuple[str, list[bytes], int]:
    """(text without the ranges, its words, number of words before)."""
    words = words_of(text)
    gone = removed_words(ranges, len(words))
    if not gone.any():
        return text, words, len(words)
    spans = [m.span() for m in WORD.finditer(text)]
    # every repeat goes with the white space behind it
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
    parts, at = [], 0
    for a, b in edges:
        parts.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    return "".join([*parts, text[at:]]), [w for w, g in zip(words, gone) if not g], len(words)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, kept, kept_sha256): each document without the passages that occur earlier.

    ``kept`` is the text with maximal repeats cut out, its other white space unchanged (null where the
    text is null); ``kept_sha256`` is taken of the kept words joined by one space.
    """
    rows = _marked(docs, key, text, threshold, gram).select("_key", "_text", "_ranges")

    def cut(columns):
        got = [without(t or "", ranges) for t, ranges in zip(columns["_text"], columns["_ranges"])]
        return {
            key: columns["_key"], "n_words": [n for _, _, n in got], "n_removed": [n - len(w) for _, w, n in got],
            "kept": [None if t is None else kept for t, (kept, _, _) in zip(columns["_text"], got)],
            "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for _, w, _ in got],
        }

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(rows, cut, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def cut_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM,
    removed: str = "_removed",
) -> DataFrame:
    """``docs`` with repeats cut out of their text, and the column ``removed``, the words cut; every row stays.

    Other columns may have any name and type; one called as ``removed`` is replaced.
    """
    rows = _marked(docs, key, text, threshold, gram).select("_row", "_text", "_ranges")

    def cut(columns):
        got = [without(t or "", ranges) for t, ranges in zip(columns["_text"], columns["_ranges"])]
        return {
            "_row": columns["_row"], "_n": [n - len(w) for _, w, n in got],
            "_cut": [None if t is None else kept for t, (kept, _, _) in zip(columns["_text"], got)],
        }

    schema = StructType().add("_row", docs.schema).add("_cut", "string").add("_n", "long")
    done = map_rows(rows, cut, schema)
    names = [c for c in docs.columns if c != removed]
    return done.select(
        *[F.col("_cut").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names], F.col("_n").alias(removed)
    )
