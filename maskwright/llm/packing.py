"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``size`` tokens.  Only the histogram of piece lengths (at most
``size`` rows) reaches the driver.  Lengths are placed longest first, each into the shortest pack that has
room; packs of one make are one *pattern* with a count, so the work depends on ``size`` alone.  Pieces find
their place by rank: the r-th piece of a length takes the r-th slot of that length.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from maskwright.llm.common import map_rows, written
from maskwright.llm.tokens import tokenize
from maskwright.operators.joins import CHUNK, HOT_SHARE

SIZE = 4096


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns: (packs of this pattern, [(length, how many in a row), ...]).

    Longest lengths come first.  A length goes into the shortest pack with room for it; where none has
    room, a pack is opened and, being the shortest, filled with the same length as far as it goes.
    """
    open_packs: dict[int, list] = {}  # used tokens -> [(packs, pattern)]
    used_sizes: list[int] = []
    done: list = []

    def put(used: int, packs: int, pattern: list) -> None:
        if used == size:
            done.append((packs, pattern))
            return
        if used not in open_packs:
            open_packs[used] = []
            insort(used_sizes, used)
        open_packs[used].append((packs, pattern))

    def add(pattern: list, length: int, n: int) -> list:
        if pattern and pattern[-1][0] == length:
            return [*pattern[:-1], (length, pattern[-1][1] + n)]
        return [*pattern, (length, n)]

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if used_sizes and used_sizes[0] + length <= size:
                used = used_sizes[0]
                packs, pattern = open_packs[used].pop()
                if not open_packs[used]:
                    del open_packs[used], used_sizes[0]
                taken = min(packs, left)
                if taken < packs:
                    put(used, packs - taken, pattern)
                put(used + length, taken, add(pattern, length, 1))
                left -= taken
            else:
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    put(each * length, full, [(length, each)])
                if rest:
                    put(rest * length, 1, [(length, rest)])
                left = 0
    for used in used_sizes:
        done += open_packs[used]
    return done


def slots(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, in a row, first sequence, offset), sorted: where ranks of a length go."""
    rows, next_rank, sequence = [], {}, 0
    for packs, pattern in made:
        offset = 0
        for length, n in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, n, sequence, offset))
            next_rank[length] = rank + packs * n
            offset += length * n
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(tokens: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(key, start, length, ids, doc_tokens): pieces of at most ``size`` ids, binary as ``tokenize`` makes them."""
    tokens = tokens.withColumn("doc_tokens", (F.octet_length("ids") / 4).cast("long"))
    at = F.expr(f"explode(sequence(0L, doc_tokens - 1, {size}L))")
    return tokens.select(key, "doc_tokens", "ids", at.alias("start")).select(
        key, "start", F.least(F.lit(size), F.col("doc_tokens") - F.col("start")).cast("long").alias("length"),
        F.expr(f"substring(ids, cast(4 * start + 1 AS int), {4 * size})").alias("ids"), "doc_tokens",
    )


def dealt_out(pieces: DataFrame, key: str, buckets: int, row: str | None = None) -> DataFrame:
    """Add ``_bucket``, a hash of (key, start); rows of a (key, start) that holds a large share go by ``row`` too."""
    at = F.xxhash64(key, "start")
    if row is None:
        return pieces.withColumn("_bucket", F.pmod(at, F.lit(buckets)).cast("int"))
    total = pieces.agg(F.count(F.lit(1))).scalar()
    often = pieces.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("_n")).where(
        (F.col("_n") > CHUNK) & (F.col("_n") * HOT_SHARE > total)
    ).select("_at", F.lit(True).alias("_often"))  # fewer than HOT_SHARE rows
    salt = F.when(F.col("_often"), F.col(row))  # a null leaves the hash as it is
    return pieces.withColumn("_at", at).join(F.broadcast(often), "_at", "left").withColumn(
        "_bucket", F.pmod(F.xxhash64(key, "start", salt), F.lit(buckets)).cast("int")
    ).drop("_at", "_often")


def place(pieces: DataFrame, key: str = "doc_id", size: int = SIZE, row: str | None = None) -> DataFrame:
    """Add (sequence_id, offset) to pieces with (key, start, length); any other column rides along.

    ``pieces`` is read twice: pass a written table.  Ranks are counted inside (length, bucket), so a
    length that a third of all rows share is still spread; bucket sizes, a few rows a length, are summed
    before.  Equal rows (same key and start) are told apart by nothing and get a place each; ``row``, a
    column of distinct numbers written with the table and not passed on, spreads them where they are
    many.  An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt_out(pieces, key, buckets, row)
    sizes = written(dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # at most ``size`` rows: collected by one job; an iterator would start a job for each shuffle partition
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = slots(patterns(counts, size))
    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # up to ``size`` rows a bucket, which a file holds in a few bytes each: broadcast, they would be many times larger
    ranked = dealt.withColumn(
        "_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(key, "start", *([row] if row else []))) - 1
    ).join(before.hint("merge"), ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = [c for c in pieces.columns if c != row]
    slot_table = spark.sparkContext.broadcast(table)  # at most size**2 / 2 rows, mostly a few thousand

    def find(got):
        rows = slot_table.value
        length, rank = np.array(got["length"], np.int64), np.array(got["_rank"], np.int64)
        by = rows[:, 0] * (1 << 45) + rows[:, 1]
        at = rows[np.searchsorted(by, length * (1 << 45) + rank, "right") - 1]
        nth = rank - at[:, 1]
        return {c: got[c] for c in columns} | {
            "sequence_id": at[:, 3] + nth // np.maximum(at[:, 2], 1),
            "offset": at[:, 4] + nth % np.maximum(at[:, 2], 1) * length,
        }

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != row)
    return map_rows(
        ranked.select(*columns, "_rank"), find, f"{fields}, sequence_id bigint, offset bigint", rows=8192
    )


def sequences(placed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, padded to ``size``.

    A sequence that fills a power of two is left as it is.  ``placed`` must carry the column ``ids``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    full = F.col("ids")
    n = F.octet_length(full) / 4
    padding = F.expr(f"repeat('{pad.to_bytes(4, 'little').hex()}', cast({size} - octet_length(ids) / 4 AS int))")
    power = F.expr("bit_count(cast(octet_length(ids) / 4 AS bigint)) = 1")
    return placed.groupBy("sequence_id").agg(joined.alias("ids")).select(
        "sequence_id", F.when(power | (n >= size), full).otherwise(F.concat(full, F.unhex(padding))).alias("ids")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Null and empty texts are the end id alone.  A null key is a document like any other.  Very long texts
    become many pieces.  ``keep_ids`` carries the ids for ``sequences``.
    """
    pieces = cut_pieces(tokenize(docs, tokenizer, end_id, key, text), key, size)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    numbered = pieces.select(*names).withColumn("_row", F.monotonically_increasing_id())
    return place(written(numbered, "pieces"), key, size, "_row")
