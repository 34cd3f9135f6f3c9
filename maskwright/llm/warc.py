"""WARC archives written and read by Spark, with records found by verifying chains of boundaries.

Records are written as text rows that end in the two blank lines of the format, so any file system that
Spark knows will do.  To read, the files are split at the record magic wherever it stands, in payloads too:

1. Every occurrence is a *candidate*.  A task reads its header and computes where the successor must start.
   Within a split it follows the successors at once, so each candidate points out of the split.
2. Pointer jumping from the file start, doubling the reach each round, keeps the candidates that a chain of
   records really enters a split by.  A magic inside a payload is on no such chain.
3. Tasks walk their split again from its verified entry and take the records off.  Records that go on in a
   later split are joined from their pieces.

A chain that meets bytes that are no record ends there; the rest of that file is not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from maskwright.llm.common import pa_schema, text_or_empty, written
from maskwright.operators.joins import join_hot_keys

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hexadecimal digits make four letters."""
    digits = F.sha1(payload.cast("binary"))
    letters = []
    for i in range(8):
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record): WARC text of every row.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest key is the response,
    the others revisit it.  A null payload is empty.  A null key names nothing: such a row is a response
    of its own.  Rows repeated with key and payload are all responses.
    """
    rows = pages.select(F.col(key).cast("string").alias("_key"), F.col(key).alias("_order"), F.col(url).cast("string").alias("_url"), text_or_empty(html).alias("_html"))
    size = F.octet_length("_html")
    named = written(
        rows.where(F.col("_order").isNotNull() & (size >= least)).select("_order", F.sha1(F.col("_html").cast("binary")).alias("_sha")), "digests"
    )
    groups = named.groupBy("_sha").agg(F.max("_order").alias("_first"), F.min("_order").alias("_last"))
    groups = groups.where("_first != _last").select("_sha", "_first")
    # usually short; written, so that Spark knows its size and broadcasts it or shuffles as that says
    revisits = written(
        join_hot_keys(named, groups, ["_sha"]).where("_order != _first").select("_order", "_sha", F.col("_first").cast("string").alias("_first")).distinct(), "revisits"
    )
    sha = F.sha1(F.col("_html").cast("binary"))
    marked = rows.withColumn("_sha", sha).join(revisits, ["_order", "_sha"], "left")
    safe = F.coalesce(F.col("_url"), F.lit(""))
    for bad in "\r\n\0":
        safe = F.replace(safe, F.lit(bad), F.lit(f"%{ord(bad):02X}"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END)
    )
    revisit = F.col("_first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "_html"))
    head = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce("_key", F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), safe,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("_html")),
        F.when(revisit, F.concat(F.lit(
            "\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"
        ), "_first", F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return marked.select(F.concat(head, block).alias("record"))


def write(pages: DataFrame, folder: str, **options) -> None:
    records(pages, **options).write.option("lineSep", END).text(folder)


def body(segment: bytes) -> tuple[int, int] | None:
    """(start, length) of the block of a record, by what stands behind its magic; None: no record."""
    end = segment.find(b"\r\n\r\n")
    found = _LENGTH.search(segment, 0, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else None


def successor(start: int, segment: bytes) -> int | None:
    """Where what stands behind the next record's magic must start."""
    found = body(segment)
    return start + sum(found) + 4 + len(MAGIC) if found else None


def chains(found: list[tuple[int, int | None]], end: int) -> Iterator[tuple[int, int, int]]:
    """(candidate, where its chain leaves the split, last candidate of the chain in it); broken ones left out.

    ``found``: candidates with their successors in ascending order; ``end``: first place behind the split.
    """
    out: dict[int, tuple[int, int]] = {}
    for start, then in reversed(found):
        if then is None:
            continue
        if then >= end:
            out[start] = then, start
        elif then in out:
            out[start] = out[then]
        else:  # the next record is broken or no candidate at all: this one stands, the chain ends
            out[start] = -1, start
    return ((start, *out[start]) for start in sorted(out))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, url, payload_digest, refers_to, http_length, payload) of all records in the files.

    ``payload`` is null for a revisit.  An empty folder gives no rows.
    """
    lines = spark.read.option("lineSep", MAGIC.decode()).text(folder)
    segments = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("data"),
    )
    gap = len(MAGIC)

    def by_split(batches):
        """(file, split, data) in the order of the files."""
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(split, found, end):
            rows = [(*split, end, *r) for r in chains(found, end)] or [(*split, end, None, None, None)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        at, found, end = None, [], 0
        names = ["file", "split", "size", "start", "leaves", "last"]
        for file, split, data in by_split(batches):
            if at != (file, split):
                if at:
                    yield made(at, found, end)
                at, found, end = (file, split), [], 0
            if end or split:  # what stands before the first magic of a file is no record
                found.append((end, successor(end, data)))
            end += len(data) + gap
        if at:
            yield made(at, found, end)

    seen = written(segments.mapInArrow(
        candidates, "file bigint, split bigint, size bigint, start bigint, leaves bigint, last bigint"
    ), "candidates")
    # one row for a split of a file
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = written(seen.select("file", "split", "size").distinct().withColumn(
        "base", F.coalesce(F.sum("size").over(before), F.lit(0))
    ), "splits")
    nodes = seen.where("start IS NOT NULL").join(splits.drop("size"), ["file", "split"]).select(
        "file", "split", (F.col("base") + F.col("start")).alias("node"),
        F.when(F.col("leaves") >= 0, F.col("base") + F.col("leaves")).alias("leaves"), (F.col("base") + F.col("last")).alias("last"),
    )
    starts = splits.select("file", F.lit(gap).cast("long").alias("node")).distinct()
    doors = starts.union(nodes.where("leaves IS NOT NULL").select("file", F.col("leaves").alias("node"))).distinct()
    doors = written(nodes.join(doors, ["file", "node"]), "doors")
    reached = reach(doors.select("file", "node", "leaves"), starts)
    entered = doors.join(reached, ["file", "node"])
    entered = entered.groupBy("file", "split").agg(F.min_by(F.struct("node", "last"), "node").alias("e")).select(
        "file", "split", "e.node", "e.last"
    )
    # of a split: where its first record starts, and whose record goes on before that
    plan = splits.join(entered, ["file", "split"], "left").select(
        "file", "split", "base", (F.col("node") - F.col("base")).alias("entry"), F.max("last").over(before).alias("owner")
    )
    # one short row for a split, so bounded by the bytes read over the split size
    entries = {(r["file"], r["split"]): (r["base"], r["entry"], r["owner"]) for r in plan.toLocalIterator()}
    shared = spark.sparkContext.broadcast(entries)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
        """(whole?, (file, record start, piece start, bytes)) of the records that the chains hold."""
        at, end, current, parts, then, base, owner = None, 0, None, [], None, 0, None

        def close(file):
            if current is not None:
                yield end == then, (file, base + current, base + current, b"".join(parts))

        for file, split, data in by_split(batches):
            if at != (file, split):
                if at:
                    yield from close(at[0])
                at, end, current, parts = (file, split), 0, None, []
                base, then, owner = shared.value[at]
            if then is not None and end == then:
                yield from close(file)
                current, parts = end, [data]
                then = successor(end, data)
                if then is None:
                    current = None
            elif current is not None:
                if end < then:
                    parts += [MAGIC, data]
            elif owner is not None and (then is None or end < then):
                yield False, (file, owner, base + end, MAGIC + data)
            end += len(data) + gap
        if at:
            yield from close(at[0])

    def only(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for is_whole, row in pieces(batches):
                if is_whole == whole:
                    held.append(row)
                    size += len(row[3])
                    if size > 1 << 24:
                        yield batch_of(held)
                        held, size = [], 0
            if held:
                yield batch_of(held)

        def batch_of(rows):
            file, start, piece, data = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(piece, pa.int64()), pa.array(data, pa.binary())],
                ["file", "start", "piece", "data"],
            )

        return segments.mapInArrow(run, "file bigint, start bigint, piece bigint, data binary")

    whole = only(True).select("data")
    parts = F.array_sort(F.collect_list(F.struct("piece", "data")))
    joined = only(False).groupBy("file", "start").agg(
        F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["data"])).alias("data")
    ).select("data")
    return parsed(whole.union(joined))


def reach(doors: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, node): nodes on the chains from the starts; rounds grow with the logarithm of the longest chain."""
    jump = written(doors.where("leaves IS NOT NULL"), "jumps")
    reached = written(starts.join(doors.select("file", "node"), ["file", "node"], "left_semi"), "reached")
    n = reached.count()
    while True:
        further = reached.join(jump, ["file", "node"]).select("file", F.col("leaves").alias("node"))
        known = further.join(doors.select("file", "node"), ["file", "node"], "left_semi")
        reached = written(reached.union(known).distinct(), "reached")
        last, n = n, reached.count()
        if n == last:
            return reached
        on = jump.select("file", F.col("node").alias("leaves"), F.col("leaves").alias("further"))
        jump = written(jump.join(on, ["file", "leaves"]).select("file", "node", F.col("further").alias("leaves")), "jumps")


def parsed(raw: DataFrame) -> DataFrame:
    """Fields of records given by what stands behind their magic.  A payload that does not fit its digest fails the query."""
    schema = (
        "record_id string, record_type string, url string, payload_digest string, refers_to string, http_length bigint, payload binary"
    )
    out = pa_schema(schema, raw.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for data in batch.slice(at, 256).column(0).to_pylist():
                    start, length = body(data)
                    head = dict(
                        (k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[: start - 4].decode("utf-8", "replace").split("\r\n")) if v
                    )
                    http, _, payload = data[start : start + length].partition(b"\r\n\r\n")
                    size = _LENGTH.search(http + b"\r\n")
                    kind = head.get("warc-type")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind != "response":
                        payload = None
                    elif digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {head.get('warc-record-id')} does not fit its digest")
                    rows.append((
                        head.get("warc-record-id", "").removeprefix("<").removesuffix(">") or None, kind, head.get("warc-target-uri"),
                        digest, head.get("warc-refers-to", "").removeprefix("<").removesuffix(">") or None,
                        int(size[1]) if size else None, payload,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return raw.mapInArrow(run, schema)
