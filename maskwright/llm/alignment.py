"""Alignment of two tokenizers over a corpus: every distinct text is tokenised and aligned once.

1. Texts are shuffled as a whole (``groupBy`` with a count on the map side): distinct texts and how often
   each occurs.
2. Each distinct text is encoded by both tokenizers.  Where a token of either ends at the same byte, a
   group ends; tokens whose byte ranges overlap are linked.
3. Links are counted per id pair over the corpus, each text weighted by its multiplicity.
4. Measures of a text (among them sums of corpus-wide counts) are joined to all documents that hold it.

Both tokenizers cut a text before a blank, line feed or tab behind a non-space, so a text is aligned piece
by piece and the pieces that recur come out of a table of this worker.  The byte-level tokenizer is read
from its file of ranks (``.tiktoken``), which has the ids of the ``.json`` file of the same name; a test
compares the two.

The table of pair counts cannot outgrow the product of the two vocabularies, but that is too much to send:
it goes to the tasks in slices of about ``SLICE`` pairs, packed in the executors, one pass over the texts a slice.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import map_rows, pa_schema, text_or_empty, written
from maskwright.operators.joins import join_hot_keys

# Pairs sent to the tasks at once: 16 bytes each.
SLICE = 1 << 20
# Pieces in a generation of a worker's table; it keeps two.  Bounds its memory, not the result.
PIECES_KEPT = 150_000
# Longer pieces are aligned but not kept.
LONGEST_KEPT = 64
# Pairs summed in a task before they are passed on.
PAIRS_AT_ONCE = 1 << 21
# A piece begins with a blank, line feed or tab behind a non-space.  White space as the tokenizers know it:
# without the four separators that Python adds.
_PIECE = re.compile(
    r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+(?:[^\S\x1c-\x1f \n\t][^\S\x1c-\x1f]*[\S\x1c-\x1f]*)*|[^\S\x1c-\x1f]+"
)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
# Four counts in one number, so that one sum adds them all.
_FIELD = 48
_MASK = (1 << _FIELD) - 1


def file_of(name: str) -> str:
    return name if os.path.sep in name else public_tokenizers.path(name)


def align(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> tuple[list[tuple[int, int]], str, int]:
    """(links, groups as ``a1,a2|b1;...``, number of groups) of two token lists over the same bytes."""
    links, groups = [], []
    i = j = first_a = first_b = 0
    end_a, end_b = a_sizes[0], b_sizes[0]
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
            if i == len(a) or j == len(b):
                return links, ";".join(groups), len(groups)
            first_a, first_b = i, j
            end_a, end_b = end_a + a_sizes[i], end_b + b_sizes[j]
        elif end_a < end_b:
            i += 1
            end_a += a_sizes[i]
        else:
            j += 1
            end_b += b_sizes[j]


class Aligner:
    """Aligned pieces: (counts, pairs as numbers, groups), or None where the bytes differ."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken

        with open(file_of(a), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_size = {rank: len(token) for token, rank in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_of(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p or "\t" in p for p in pieces):
            raise ValueError("a token of the second tokenizer runs over the end of a piece")
        self.b_bytes = [
            bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.blank = self.b.piece_to_id("▁")
        self.kind = "<u4" if (max(ranks.values()) + 1) * len(pieces) <= 1 << 32 else "<u8"
        self.width = len(pieces)
        self.kept, self.older = {}, {}

    def second(self, pieces: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer; it puts a blank before each text, so that of a piece is left out."""
        bare = [p[1:] if p[0] == " " else p for p in pieces]
        out = self.b.encode(bare, num_threads=1)
        for i, p in enumerate(pieces):
            if p == " ":
                out[i] = [self.blank]
            elif p[0] != " " and out[i] and out[i][0] == self.blank:
                out[i] = out[i][1:]
        return out

    def aligned(self, piece: str, b: list[int]) -> tuple[int, bytes, bytes] | None:
        a = self.a.encode_ordinary(piece)
        raw = piece.encode()
        parts = [self.b_bytes[x] for x in b]
        if b"".join(parts) != raw:
            return None
        sizes = [self.a_size[x] for x in a]
        if sum(sizes) != len(raw):
            return None
        links, groups, n = align(a, sizes, b, [len(p) for p in parts])
        pairs = np.array([x * self.width + y for x, y in links], self.kind)
        counts = len(a) | len(b) << _FIELD | n << 2 * _FIELD | len(links) << 3 * _FIELD
        return counts, pairs.tobytes(), groups.encode()

    def pieces(self, texts: list[str]) -> list[list]:
        """The aligned pieces of each text, in order."""
        cut = [_PIECE.findall(" " + t) if t else [] for t in texts]
        every = set().union(*cut)
        if len(self.kept) + len(every) > PIECES_KEPT:
            self.older, self.kept = self.kept, {}
        found, new = {}, []
        for piece in every:
            if piece in self.kept:
                found[piece] = self.kept[piece]
            elif piece in self.older:
                found[piece] = self.kept[piece] = self.older[piece]
            else:
                new.append(piece)
        for piece, ids in zip(new, self.second(new)):
            found[piece] = self.aligned(piece, ids)
            if len(piece) <= LONGEST_KEPT and len(self.kept) < PIECES_KEPT:
                self.kept[piece] = found[piece]
        return [list(map(found.__getitem__, parts)) for parts in cut]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The table of this worker; kept over its tasks."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, times): every distinct text and the number of rows that hold it; null is the empty text."""
    return docs.select(text_or_empty(text).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("times"))


def _hashes(text) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("second"), text).alias("_h2")]


def align_texts(texts: DataFrame, a: str, b: str) -> DataFrame:
    """(_h1, _h2, times, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, counts) of (text, times).

    ``groups`` is left to the digest; ``pairs`` (little-endian, ascending) and ``counts`` (32 bits) hold the
    different id pairs of a text, a pair being ``a * vocabulary of b + b``.  A text that is empty or that a
    tokenizer does not give back byte by byte has no tokens.
    """
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def measure(columns, table):
        out = {n: [] for n in [*names, "groups_sha256", "pairs", "counts"]}
        for parts in table.pieces(columns["text"]):
            good = bool(parts) and None not in parts
            packed = sum(p[0] for p in parts) if good else 0
            for i, n in enumerate(names):
                out[n].append(packed >> i * _FIELD & _MASK)
            pairs, counts = np.unique(
                np.frombuffer(b"".join([p[1] for p in parts]) if good else b"", table.kind), return_counts=True
            )
            out["pairs"].append(pairs.astype(table.kind).tobytes())
            out["counts"].append(counts.astype("<u4").tobytes())
            out["groups_sha256"].append(hashlib.sha256(b";".join([p[2] for p in parts])).hexdigest() if good else "")
        return {"_h1": columns["_h1"], "_h2": columns["_h2"], "times": columns["times"]} | out

    return map_rows(
        texts.select(*_hashes(F.col("text")), "times", "text"), measure,
        "_h1 bigint, _h2 bigint, times bigint, " + ", ".join(f"{n} bigint" for n in names)
        + ", groups_sha256 string, pairs binary, counts binary",
        setup=lambda: aligner(a, b), rows=128,
    )


def pair_counts(measures: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, best): links of every id pair in the corpus; ``best`` if no pair of its ``b`` has more."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(a, b)
        pairs, counts, held = [], [], 0

        def made():
            each, at = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, at, np.concatenate(counts))
            low, high = each % table.width, each // table.width
            return each, total, pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (high, low, total)], names=["a", "b", "n"]
            )

        for batch in batches:
            for p, c, times in zip(*(batch.column(i) for i in range(3))):
                pairs.append(np.frombuffer(p.as_py(), table.kind).astype(np.int64))
                counts.append(np.frombuffer(c.as_py(), "<u4").astype(np.int64) * times.as_py())
                held += len(pairs[-1])
                if held > PAIRS_AT_ONCE:
                    each, total, out = made()
                    if len(each) > PAIRS_AT_ONCE // 2:
                        yield out
                        pairs, counts, held = [], [], 0
                    else:
                        pairs, counts, held = [each], [total], len(each)
        if pairs:
            yield made()[2]

    summed = measures.select("pairs", "counts", "times").mapInArrow(sums, "a bigint, b bigint, n bigint").groupBy(
        "a", "b"
    ).agg(F.sum("n").alias("n"))
    summed = written(summed, "pairs")
    most = summed.groupBy("b").agg(F.max("n").alias("_most"))  # one row for an id of the vocabulary
    return summed.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def _packed(pairs: DataFrame, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """(pair, 2 * n + best) of a slice, sorted; packed in the executors, a row for each of their batches."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = aligner(a, b).width
        for batch in batches:
            x, y, n, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            pair, value = (x * width + y).astype("<i8"), (2 * n + best).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (pair, value)], names=["p", "v"])

    got = pairs.select("a", "b", "n", "best").mapInArrow(pack, "p binary, v binary").collect()
    pair, value = (np.frombuffer(b"".join(bytes(r[i]) for r in got), "<i8") for i in (0, 1))
    order = np.argsort(pair)
    return pair[order], value[order]


def sums_of_counts(measures: DataFrame, pairs: DataFrame, a: str, b: str, size: int = SLICE) -> DataFrame:
    """(_h1, _h2, n_best, count_sum) of every text, from the corpus-wide counts of its links."""
    spark = measures.sparkSession
    pairs = written(pairs, "counted")
    slices = -(-pairs.count() // size) or 1
    place = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
    schema = "_h1 bigint, _h2 bigint, n_best bigint, count_sum bigint"
    out = pa_schema(schema, spark)
    parts = None
    for at in range(slices):
        known = spark.sparkContext.broadcast(_packed(pairs.where(place == at), a, b))

        def add(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            pair, value = known.value
            kind = aligner(a, b).kind
            for batch in batches:
                of, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                ends = np.cumsum([0, *(len(c) // 4 for c in counts)])
                mine = np.frombuffer(b"".join(of), kind).astype(np.int64)
                links = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
                spot = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
                hit = pair[spot] == mine if len(pair) else np.zeros(len(mine), bool)
                got = np.where(hit, value[spot] if len(pair) else 0, 0)
                sums = [np.concatenate([[0], np.cumsum(links * v)]) for v in (got & 1, got >> 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], schema=out
                )

        part = measures.select("_h1", "_h2", "pairs", "counts").mapInArrow(add, schema)
        parts = part if parts is None else parts.union(part)
    if slices == 1:
        return parts
    return parts.groupBy("_h1", "_h2").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compare(docs: DataFrame, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each row of ``docs``.

    ``a`` is a file of byte-level ranks, ``b`` a piece model, both names of the public vocabularies or
    paths.  Special tokens are not known, so their spelling is ordinary text.  Null, empty and changed texts
    have zeros and an empty digest.  Repeated rows and rows of equal text have equal measures; a null key
    is a key like any other; other columns of ``docs`` are not looked at, whatever their names.  An empty table
    gives no rows.
    """
    measures = written(align_texts(distinct_texts(docs, text), a, b), "aligned")
    sums = sums_of_counts(measures, pair_counts(measures, a, b), a, b)
    facts = docs.select(F.col(key).alias("_key"), *_hashes(text_or_empty(text)))
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    whole = written(measures.select("_h1", "_h2", *columns).join(sums, ["_h1", "_h2"]), "measures")
    return join_hot_keys(facts, whole, ["_h1", "_h2"]).select(
        F.col("_key").alias(key), *columns[:4], "n_best", "count_sum", "groups_sha256"
    )
