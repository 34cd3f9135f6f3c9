"""Removal of long byte strings that occur twice, by run-length indexes of the repetitive parts of a corpus.

A *window* is a string of ``THRESHOLD`` bytes inside one text.  Its anchor is its smallest ``GRAM``-byte hash,
the rightmost of equal ones.  The consecutive windows of a text that share an anchor, at a distance of the same
``SPAN``, make a *fragment*; they have a *core* in common, a string at a fixed place from the anchor.  Equal
windows have equal cores, so windows can only be equal within a core's group of fragments:

1. Cores are counted over the corpus; those that occur once are done.
2. Fragments of the others are collected, equal ones once, and dealt out by their core.
3. A task sorts the suffixes of its fragments that are as long as a window and builds the Burrows-Wheeler
   transform as runs of equal preceding bytes.  Both ends of each run are sampled: place in the text and
   length of the match across the border.  Inside a run a suffix matches its neighbour one byte less than
   the suffix before it does (its preceding byte is the neighbour's, too), so the samples are all there is to keep.
4. Streaming a fragment along its samples gives the matching statistics (longest match elsewhere) of its windows;
   samples of a window or more mark the bytes of a match.
5. Marks go back to all texts that hold the fragment; every text drops the marked bytes.

A core that over ``MOST`` different fragments share would make one large task; there, single windows are
counted by 128-bit hash instead, with sums on the map side.  Fragments, cores and texts are compared by two
64-bit hashes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.llm.common import (
    bits_for, hash_bits, in_bits, map_rows, mix, pa_schema, text_or_empty, written,
)
from maskwright.llm.substrings import Powers, smallest
from maskwright.operators.joins import join_hot_keys, left_join_hot_keys

THRESHOLD = 400
GRAM = 8
SPAN = 200
# Different fragments of a core that one task takes.
MOST = 1024
# Bytes of texts that are hashed at once, and of a long text: bounds the memory of a task.
CHUNK_BYTES = 1 << 18
SEGMENT = 1 << 20
# Bytes of suffixes that are sorted at once; the fragments of one core stay together.
SUFFIX_BYTES = 1 << 24
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in (_BASES[1], _BASES[0])]


class Chunk:
    """Parts of texts side by side, with hashes of their substrings out of prefix sums."""

    def __init__(self, parts: list[bytes], powers: tuple[Powers, Powers]):
        self.parts, self.powers = parts, powers
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(parts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sums = []
        for p, table in zip(powers, _BYTES):
            p.to(len(self.data) + 1)
            self.sums.append(np.concatenate([
                np.zeros(1, np.uint64), np.cumsum(table[self.data] * p.up[: len(self.data)], dtype=np.uint64)
            ]))

    def hashes(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        s = self.sums[which]
        value = (s[start + length] - s[start]) * self.powers[which].down[start]
        return mix(value + np.asarray(length).astype(np.uint64) * np.uint64(_BASES[1]))

    def fragments(self, threshold: int, gram: int, span: int) -> tuple[np.ndarray, ...]:
        """(part, start in the chunk, length, core hash) of each fragment, in order."""
        count = np.maximum(self.sizes - threshold + 1, 0)
        total = int(count.sum())
        if not total:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        grams = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,)).copy() if gram == 8 else (
            self.hashes(0, np.arange(len(self.data) - gram + 1), gram)
        )
        at = smallest(mix(grams), threshold - gram + 1)
        part = np.repeat(np.arange(len(count)), count)
        window = np.arange(total) + (self.starts - np.cumsum(count) + count)[part]
        anchor = at[window]
        step = (anchor - window) // span
        new = np.ones(total, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, total))
        core = anchor[first] - span * step[first]
        # what windows at this distance from the anchor have in common, and which distance it is
        name = self.hashes(0, core, threshold - span + 1) ^ mix(step[first].astype(np.uint64) + np.uint64(1))
        return part[first], window[first], windows + threshold - 1, name


def chunks(texts: list[bytes], threshold: int, powers) -> Iterator[tuple[Chunk, list[int], list[int]]]:
    """(chunk, text of each part, start of each part in its text); parts of a text overlap by a window less one byte."""
    parts, of, at, held = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < threshold:
            continue
        for start in range(0, len(t) - threshold + 1, SEGMENT):
            parts.append(t[start : start + SEGMENT + threshold - 1])
            of.append(i)
            at.append(start)
            held += len(parts[-1])
            if held >= CHUNK_BYTES:
                yield Chunk(parts, powers), of, at
                parts, of, at, held = [], [], [], 0
    if parts:
        yield Chunk(parts, powers), of, at


class RunIndex:
    """Run-length Burrows-Wheeler transform of the long suffixes of some fragments, sampled at the ends of its runs."""

    def __init__(self, fragments: list[bytes], threshold: int = THRESHOLD):
        self.threshold = threshold
        self.sizes = np.array([len(f) for f in fragments], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = b"".join(fragments)
        data = np.frombuffer(raw, np.uint8)
        count = np.maximum(self.sizes - threshold + 1, 0)
        of = np.repeat(np.arange(len(fragments)), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)  # in the fragment
        suffixes = [f[i:] for f, n in zip(fragments, count.tolist()) for i in range(n)]
        order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
        of, place = of[order], place[order]
        text = self.starts[of] + place
        # preceding bytes; the start of a fragment has none and is a run by itself
        before = np.where(place > 0, data[np.maximum(text - 1, 0)].astype(np.int64) if len(data) else 0, -1)
        border = np.ones(len(order), bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(border)
        #: run-length transform: symbol (-1 for none) and length of each run
        self.symbols, self.lengths = before[heads], np.diff(np.append(heads, len(order)))
        inner = heads[heads > 0]
        left = self.sizes[of] - place
        match = common_prefixes(raw, text[inner - 1], text[inner], np.minimum(left[inner - 1], left[inner]))
        #: samples (fragment, place, match): first suffix of a run with the one before, last with the one behind
        samples = np.stack([
            np.concatenate([of[inner], of[inner - 1]]), np.concatenate([place[inner], place[inner - 1]]),
            np.concatenate([match, match]),
        ])
        self.samples = samples[:, np.lexsort((samples[1], samples[0]))]

    def statistics(self, fragment: int) -> np.ndarray:
        """Bytes that match elsewhere from the start of every window of a fragment on; 0 where no whole window does."""
        own = self.samples[:, self.samples[0] == fragment]
        size = max(int(self.sizes[fragment]) - self.threshold + 1, 0)
        reach = np.zeros(size, np.int64)
        np.maximum.at(reach, own[1], own[1] + own[2])
        # between samples a match loses a byte a step, which leaves its end where it is
        match = np.maximum.accumulate(reach) - np.arange(size)
        return np.where(match >= self.threshold, match, 0)

    def marks(self) -> list[list[tuple[int, int]]]:
        """Ranges of each fragment that matches of ``threshold`` bytes or more cover, joined."""
        of, place, match = self.samples[:, self.samples[2] >= self.threshold]
        out = [[] for _ in self.sizes]
        for f, a, b in zip(of.tolist(), place.tolist(), (place + match).tolist()):
            got = out[f]
            if got and a <= got[-1][1]:
                got[-1] = got[-1][0], max(got[-1][1], b)
            else:
                got.append((a, b))
        return out


def common_prefixes(raw: bytes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at ``a`` and ``b`` in ``raw``, at most ``most``."""
    words = np.ndarray(len(raw) + 1, "<u8", raw + b"\0" * 8, strides=(1,))
    out = np.array(most, np.int64)
    open_ = np.arange(len(a))
    done = 0
    while len(open_):
        diff = words[a[open_] + done] ^ words[b[open_] + done]
        stop = diff != 0
        if stop.any():
            low = diff[stop] & -diff[stop].astype(np.int64).astype(np.uint64)
            same = np.log2(low.astype(np.float64)).astype(np.int64) >> 3
            out[open_[stop]] = np.minimum(out[open_[stop]], done + same)
        done += 8
        open_ = open_[~stop]
        open_ = open_[out[open_] > done]
    return out


def _text_hashes(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts have equal marks."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("second"), text).alias("_t2")]


def cores(docs: DataFrame, text: str, threshold: int, gram: int, span: int) -> DataFrame:
    """(core): a row for each fragment of each row of ``docs``."""
    out = pa_schema("core bigint", docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_BASES[0]), Powers(_BASES[1])
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(0)]
            for chunk, _, _ in chunks(texts, threshold, powers):
                core = chunk.fragments(threshold, gram, span)[3]
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], schema=out)

    return docs.select(text_or_empty(text)).mapInArrow(run, "core bigint")


def fragments_of(docs: DataFrame, bits: bytes, size: int, text: str, threshold: int, gram: int, span: int) -> DataFrame:
    """(core, h, _t1, _t2, start, content) of fragments whose core is in the bit set.

    ``content`` is there for the first fragment of its kind in a task and null for the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = "core bigint, h bigint, _t1 bigint, _t2 bigint, start int, content binary"
    out = pa_schema(schema, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = (Powers(_BASES[0]), Powers(_BASES[1])), set()
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(2)]
            t1, t2 = (batch.column(i).to_numpy() for i in range(2))
            for chunk, of, at in chunks(texts, threshold, powers):
                part, start, length, core = chunk.fragments(threshold, gram, span)
                keep = np.flatnonzero(in_bits(table, core, size))
                part, start, length, core = part[keep], start[keep], length[keep], core[keep]
                h = chunk.hashes(1, start, length)
                contents = []
                for kind, a, n in zip(zip(core.tolist(), h.tolist()), start.tolist(), length.tolist()):
                    new = kind not in seen
                    contents.append(chunk.raw[a : a + n] if new else None)
                    if new:
                        seen.add(kind)
                text_of = np.array(of, np.int64)[part]
                place = (start - chunk.starts[part] + np.array(at, np.int64)[part]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(core.view(np.int64)), pa.array(h.view(np.int64)), pa.array(t1[text_of]), pa.array(t2[text_of]),
                    pa.array(place), pa.array(contents, pa.binary()),
                ], schema=out)

    texts = text_or_empty(text)
    return docs.select(*_text_hashes(texts), texts.alias("_text")).mapInArrow(run, schema)


_RANGES = "ranges array<struct<start:int,end:int>>"


def indexed(fragments: DataFrame, threshold: int) -> DataFrame:
    """(core, h, ranges): marks of (core, h, n, content), by an index for the cores of a task's part."""
    schema = f"core bigint, h bigint, {_RANGES}"
    out = pa_schema(schema, fragments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def made():
            index = RunIndex([f[3] for f in held], threshold)
            # a fragment that occurs again matches itself as a whole
            rows = [
                (core, h, [(0, len(content))] if n > 1 else marks)
                for (core, h, n, content), marks in zip(held, index.marks())
            ]
            rows = [r for r in rows if r[2]]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], out.field("ranges").type),
            ], schema=out)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != last and size >= SUFFIX_BYTES:
                    yield made()
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += (len(row[3]) - threshold + 1) * (len(row[3]) + threshold) // 2
        if held:
            yield made()

    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fragments.select("core", "h", "n", "content").repartition(4 * parts, "core").sortWithinPartitions("core", "h")
    return dealt.mapInArrow(run, schema)


def counted(fragments: DataFrame, threshold: int) -> DataFrame:
    """(core, h, ranges) of (core, h, n, content), window by window: those that occur twice in all."""

    def windows(columns):
        rows = {c: [] for c in ("core", "h", "n", "w1", "w2", "at")}
        for core, h, n, content in zip(columns["core"], columns["h"], columns["n"], columns["content"]):
            chunk = Chunk([content], powers)
            at = np.arange(len(content) - threshold + 1)
            rows["at"].append(at)
            for i in (0, 1):
                rows[f"w{i + 1}"].append(chunk.hashes(i, at, threshold).view(np.int64))
            for c, v in (("core", core), ("h", h), ("n", n)):
                rows[c].append(np.full(len(at), v, np.int64))
        return {c: np.concatenate(v) for c, v in rows.items()}

    powers = Powers(_BASES[0]), Powers(_BASES[1])
    found = written(map_rows(
        fragments.select("core", "h", "n", "content"), windows,
        "core bigint, h bigint, n bigint, w1 bigint, w2 bigint, at int",
    ), "windows")
    again = found.groupBy("w1", "w2").agg(F.sum("n").alias("_times")).where("_times > 1")
    span = F.struct(F.col("at").alias("start"), (F.col("at") + threshold).alias("end"))
    return join_hot_keys(found, again, ["w1", "w2"]).groupBy("core", "h").agg(F.collect_list(span).alias("ranges"))


def repeats(
    docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, span: int = SPAN, most: int = MOST,
) -> DataFrame:
    """(_t1, _t2, marks): for each text that holds repeats their byte ranges, as (start of a fragment, ranges from there).

    A text is named by two hashes; null is the empty text.
    """
    seen = cores(docs, text, threshold, gram, span).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    again = written(seen.where("n > 1").select("core"), "cores")
    size = bits_for(again.count())
    places = written(fragments_of(docs, hash_bits(again, "core", size), size, text, threshold, gram, span), "places")
    fragments = written(
        places.groupBy("core", "h").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("content")), "fragments"
    )
    large = fragments.groupBy("core").agg(F.count(F.lit(1)).alias("_kinds")).where(F.col("_kinds") > most)
    sorted_out = fragments.join(large.withColumn("_large", F.lit(True)).drop("_kinds"), "core", "left")
    marks = indexed(sorted_out.where("_large IS NULL"), threshold).unionByName(
        counted(sorted_out.where("_large"), threshold).select("core", "h", F.col("ranges").cast(_RANGES.split(" ", 1)[1]))
    )
    found = join_hot_keys(places.drop("content"), written(marks, "marks"), ["core", "h"])
    # copies of a text give the same marks: sets, made on the map side first
    return found.groupBy("_t1", "_t2").agg(F.collect_set(F.struct("start", "ranges")).alias("marks"))


def joined_ranges(marks: list[dict] | None) -> list[tuple[int, int]]:
    """Byte ranges of a text, ascending; those that overlap or touch are joined."""
    out = []
    for a, b in sorted((m["start"] + r["start"], m["start"] + r["end"]) for m in marks or [] for r in m["ranges"]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM,
    span: int = SPAN, most: int = MOST, spans: bool = False,
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]): a row for each row of ``docs``.

    Texts are UTF-8 bytes (null: empty).  Each byte that a string of ``threshold`` bytes covers which also starts
    anywhere else goes; ``spans`` adds the removed ranges and what is left as binary, as a cut may fall inside
    a character.  Repeated rows are copies of each other, so both lose what is long enough; a null key is a
    key like any other; other columns are not looked at, whatever their names.  An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    rows = rows.select("*", *_text_hashes(F.col("_text")))
    marked = left_join_hot_keys(rows, written(repeats(docs, text, threshold, gram, span, most), "repeats"), ["_t1", "_t2"])

    def cut(columns):
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for t, marks in zip(columns["_text"], columns["marks"]):
            raw, ranges = t.encode(), joined_ranges(marks)
            edges = [0, *(x for r in ranges for x in r), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if ranges else raw
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(ranges))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if spans:
                out["spans"].append([{"start": a, "end": b} for a, b in ranges])
                out["kept"].append(kept)
        return out | {key: columns["_key"]}

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if spans:
        schema += ", spans array<struct<start:bigint,end:bigint>>, kept binary"
    return map_rows(marked.select("_key", "_text", "marks"), cut, schema)
