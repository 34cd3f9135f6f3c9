"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from maskwright.operators.joins import ensure_checkpoint_dir

# Rows handled at once inside a task: bounds the Python memory of a batch of long texts.
ROWS_AT_ONCE = 256

#: Words by the contracts' definition: runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same white space as a string, for SQL trim and translate.
SPACES = " \t\n\x0b\x0c\r"
#: ``str.translate`` table that lower-cases A-Z.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str) -> list[bytes]:
    """Words by the contracts' definition, in UTF-8: ``bytes.split`` knows the six ASCII white-space characters alone."""
    return text.encode().split()


def hashes_of(words: list) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def map_rows(
    df: DataFrame, function: Callable[[list[dict]], dict[str, list]], schema: str | StructType,
    rows: int = ROWS_AT_ONCE, setup: Callable[[], object] | None = None,
) -> DataFrame:
    """``mapInArrow`` in small batches: ``function`` gets columns as lists and returns columns.

    ``setup`` runs once in a task; its result is the second argument of ``function``.
    """
    names = list(df.columns)
    out = pa_schema(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                got = function(columns, state) if setup else function(columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)


def pa_schema(schema: str | StructType, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# Bits in a slice of a bit set: 4 kB, one row on the way to the driver.
SLICE_BITS = 15
#: Largest bit set: 32 MB.
MOST_BITS = 28


def bits_for(n: int) -> int:
    """Size of a bit set for ``n`` hashes, as a power of two: 64 places a hash, 32 MB at most."""
    return min(max((64 * n).bit_length(), SLICE_BITS), MOST_BITS)


def _rotated(h: Column) -> Column:
    return F.shiftleft(h, 32).bitwiseOR(F.shiftrightunsigned(h, 32))


def hash_bits(df: DataFrame, hashes: str, bits: int) -> bytes:
    """A bit set of ``2**bits`` places, two of them set for each 64-bit hash: by its upper and by its lower half.

    Its size is bounded, whatever the table holds, so it may be sent to every task.  Tasks make slices of
    4 kB; the driver puts at most ``2**(bits - 15)`` of them together.  A set bit may be a coincidence:
    what passes has to be joined exactly afterwards.
    """
    halves = F.array(F.col(hashes), _rotated(F.col(hashes)))
    place = F.shiftrightunsigned(F.col("h"), 64 - bits)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = -1, np.zeros(1 << SLICE_BITS, bool)
        for batch in batches:
            at = batch.column(1).to_numpy()
            done = []
            for part in np.split(at, np.flatnonzero(np.diff(at >> SLICE_BITS)) + 1):
                if len(part) and part[0] >> SLICE_BITS != number:
                    done.append((number, made))
                    number, made = int(part[0] >> SLICE_BITS), np.zeros(1 << SLICE_BITS, bool)
                made[part & ((1 << SLICE_BITS) - 1)] = True
            yield packed(done)
        yield packed([(number, made)])

    def packed(done):
        return pa.RecordBatch.from_arrays([
            pa.array([n for n, _ in done if n >= 0], pa.int64()),
            pa.array([np.packbits(m, bitorder="little").tobytes() for n, m in done if n >= 0], pa.binary()),
        ], names=["slice", "bits"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.explode(halves).alias("h")).select(F.shiftright(place, SLICE_BITS).alias("slice"), place.alias("place")).repartition(
        parts, "slice"
    ).sortWithinPartitions("slice")
    out = np.zeros(max(1 << (bits - 3), 1 << (SLICE_BITS - 3)), np.uint8)
    size = 1 << (SLICE_BITS - 3)
    for r in dealt.mapInArrow(slices, "slice bigint, bits binary").collect():
        out[r["slice"] * size : (r["slice"] + 1) * size] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def in_bits(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the uint64 hashes have both of their bits set."""
    out = np.ones(len(hashes), bool)
    for h in (hashes, hashes << np.uint64(32) | hashes >> np.uint64(32)):
        place = h >> np.uint64(64 - bits)
        out &= (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a sum of hashes so that all its bits depend on all of its input."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def salted_join(facts: DataFrame, dim: DataFrame, on: list[str], salt: Column, parts: int = 16, how: str = "inner") -> DataFrame:
    """Join on keys of which one may hold a large share of ``facts``.

    ``facts`` are dealt over ``parts`` by ``salt``; each row of ``dim``, the smaller side, is repeated
    once a part.  Both are shuffled: Spark takes the repeated rows for as many as ``dim`` has, and would broadcast them.
    """
    left = facts.withColumn("_part", F.pmod(salt, F.lit(parts)).cast("int"))
    right = dim.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right.hint("merge"), [*on, "_part"], how).drop("_part")
