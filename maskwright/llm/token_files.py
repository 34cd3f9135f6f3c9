"""Token-id files: canonical, length-limited Huffman code over the ids' global counts.

Format, version 1.  A folder holds Parquet containers: ``codebook`` (id, bits) and ``blocks``, whose files
in order of their name hold the documents in ascending order of their key.  A block holds whole documents
and decodes alone:

``file``, ``block``   place in the order: number of the file, of the block in it
``file_start``        ids of this file before this block
``keys``              the documents' keys, ascending
``lengths``           ids of each document
``payload``           their ids' codes, one behind the other, most significant bit first
``offsets``           bit offset of every ``EVERY``-th id: 32 bits each, little-endian

Any id is reached by decoding at most ``EVERY`` ids from a checkpoint.  The decoder runs all stretches
between checkpoints side by side, one table look-up an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from maskwright.llm.common import pa_schema, written
from maskwright.llm.tokens import narrowest, tokenize

# Longest code in bits: the decoding table has 2**LIMIT places.
LIMIT = 18
# Ids from one checkpoint to the next.
EVERY = 128
# A block is closed with the document that brings it to so many ids.
BLOCK_IDS = 1 << 17
# Ids counted at once.
COUNT_IDS = 1 << 20
# A file takes about so many ids, where there are more than one for a shuffle partition.
FILE_IDS = 1 << 25


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most ``limit`` bits (package-merge); 0: unused."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        merged = both[order]
        packages = merged[0 : len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (bits, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and bits by the next ``LIMIT`` bits."""
    symbols, bits = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    codes = canonical_codes(lengths)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        at = int(codes[s]) << (LIMIT - n)
        symbols[at : at + (1 << (LIMIT - n))] = s
        bits[at : at + (1 << (LIMIT - n))] = n
    return symbols, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, offsets) of a block."""
    n = lengths[ids].astype(np.uint64)
    ends = np.cumsum(n, dtype=np.uint64)
    if not len(ids):
        return b"", b""
    at = ends - n
    if int(ends[-1]) >= 1 << 32:
        raise ValueError("a document of over four billion bits")
    word, shift = (at >> np.uint64(5)).astype(np.int64), np.uint64(64) - (at & np.uint64(31)) - n
    value = codes[ids] << shift  # within the 64 bits from the word on; codes do not overlap, so sums join them
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    payload = out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]
    return payload, at[::EVERY].astype("<u4").tobytes()


def decode(payload: bytes, offsets: bytes, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a block."""
    symbols, bits = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8)
    # 32 bits from every byte on: enough for LIMIT bits behind an offset of up to 7
    window = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    out = np.zeros((min(EVERY, n), len(at)), np.uint32)
    last = n - (len(at) - 1) * EVERY  # ids behind the last checkpoint
    for i in range(len(out)):
        lanes = at if i < last else at[:-1]
        look = (window[lanes >> 3] << (lanes & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[i, : len(lanes)] = symbols[look]
        lanes += bits[look]
    return out.T.reshape(-1)[:n] if len(out) == EVERY else out.T.reshape(-1)


def id_runs(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """The ids of all rows of a binary column, which stand one behind the other, at most ``COUNT_IDS`` at once."""
    if not len(column) or column.buffers()[2] is None:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = ends[column.offset], ends[column.offset + len(column)]
    ids = np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(kind)
    for at in range(0, len(ids), COUNT_IDS):
        yield ids[at : at + COUNT_IDS]


def write_ids(tokens: DataFrame, folder: str, key: str = "doc_id", ties: str | None = None, row: str | None = None, kind: str = "<u4") -> None:
    """Write (key, ids) in the format above.  ``ids`` is binary, little-endian of the numpy type ``kind``.

    ``tokens`` is read twice (counts, then codes): pass a written table.  Keys may repeat; equal keys are
    ordered by ``ties``, then by ``row``, a column of distinct numbers written with the table, which lets
    the ranges split equal rows.  A null key comes first.  An empty table makes an empty folder of blocks.
    """
    spark = tokens.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in id_runs(batch.column(0), kind):
                got = np.bincount(ids, minlength=len(total))
                got[: len(total)] += total
                total = got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # one row for an id of the vocabulary
    of = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    of[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    lengths = code_lengths(of)
    book = spark.createDataFrame(
        [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "id bigint, bits int"
    )
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    key_kind, width = tokens.schema[key].dataType.simpleString(), np.dtype(kind).itemsize
    schema = (
        f"file int, block int, file_start bigint, keys array<{key_kind}>, lengths array<bigint>, "
        "payload binary, offsets binary"
    )
    out = pa_schema(schema, spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, start = TaskContext.get().partitionId(), 0, 0
        keys, ids, held = [], [], 0

        def made():
            sizes = [len(x) // width for x in ids]
            payload, offsets = encode(np.frombuffer(b"".join(ids), kind), *shared.value)
            row = [file], [block], [start], [keys], [sizes], [payload], [offsets]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, out)], schema=out)

        for batch in batches:
            for k, b in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                ids.append(b.as_py())
                held += len(ids[-1]) // width
                if held >= BLOCK_IDS:
                    yield made()
                    block, start, keys, ids, held = block + 1, start + held, [], [], 0
        if keys:
            yield made()

    order = [key, *(c for c in (ties, row) if c)]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(of.sum()) // FILE_IDS)
    tokens.repartitionByRange(files, *order).sortWithinPartitions(*order).select(key, "ids").mapInArrow(
        blocks, schema
    ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document in the files: ``start`` counts the ids of all documents before it."""
    rows = spark.read.parquet(f"{folder}/codebook").toPandas()  # one row for an id of the vocabulary
    lengths = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    lengths[rows["id"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row a file: files before this one
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    files = blocks.groupBy("file").agg(F.max(F.col("file_start") + ids).alias("n"))
    before = files.select(
        "file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    starts = {r["file"]: r["before"] for r in before.collect()}
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"`{key}` {kind}, start bigint, ids binary"
    out = pa_schema(schema, spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or decoding_table(shared.value)
            for row in batch.to_pylist():
                n = sum(row["lengths"])
                ids = decode(row["payload"], row["offsets"], n, table).astype("<u4")
                ends = np.cumsum(row["lengths"])
                start = starts[row["file"]] + row["file_start"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], out[0].type), pa.array(start + ends - row["lengths"], pa.int64()),
                    pa.array([ids[e - k : e].tobytes() for e, k in zip(ends, row["lengths"])], pa.binary()),
                ], schema=out)

    return blocks.select("file", "file_start", "keys", "lengths", "payload", "offsets").mapInArrow(documents, schema)


def write_documents(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Tokenize whole texts (null: empty), append the end id, write them.  Repeated keys are ordered by text."""
    kind = narrowest(tokenizer, end_id)
    tokens = tokenize(docs, tokenizer, end_id, key, text, kind).withColumns(
        {"_tie": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()}
    )
    write_ids(written(tokens, "tokens"), folder, key, "_tie", "_row", kind)


def digests(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of documents read back."""
    return documents.select(
        key, "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
