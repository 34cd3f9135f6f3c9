"""SimHash near-duplicates: pigeonring candidates, Hamming check, connected components.

Sixty-four bits lie on a ring of ``m`` segments.  If two fingerprints differ in at most ``d`` bits,
then from some segment on every chain of ``l`` consecutive segments differs in at most ``l * d / m``
bits in total (pigeonring principle).  With five segments and four bits the budgets are 0, 1, 2, 3, 4.  The
first two links make the join key: a segment that agrees wholly, and the next one that agrees but for at
most one bit.  The longer chains prune what the key lets through, the full distance decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.llm.common import bits_for, hash_bits, in_bits, map_rows, text_or_empty, written
from maskwright.llm.components import components
from maskwright.operators.joins import join_hot_keys, left_join_hot_keys

SEED = 42
SHINGLE = 4
DISTANCE = 4
# Shingles hashed at once: bounds the memory of a very long text.
CHUNK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set where it is set in over half of its shingles' hashes."""
    words = text.encode().lower().split()  # of bytes, lower() changes A-Z alone
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], ">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp): one row per row; ``fp`` holds the 64 bits as a signed long.  No words (null, empty): zero."""
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(
        docs.select(key, text_or_empty(text).alias("_text")),
        lambda c: {key: c[key], "fp": np.array([fingerprint(t, size) for t in c["_text"]], np.uint64).view(np.int64)},
        f"`{key}` {kind}, fp bigint",
    )


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the ring's segments, one more than the distance."""
    m = distance + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints that differ in at most ``distance`` bits.

    ``fps`` has a distinct column ``fp``.  With ``distance + 1`` segments the budget of a chain of ``l``
    segments is ``l - 1`` bits.  Keys hold (segment, its bits, the next segment's bits); one side is keyed
    as it is, the other also with every single bit of the next segment flipped.
    """
    ring = segments(distance)
    m = len(ring)

    def part(at: int, bits: int) -> Column:
        return F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << bits) - 1))

    def base(i: int) -> Column:
        low = F.shiftleft(part(*ring[i]), ring[(i + 1) % m][1]).bitwiseOR(part(*ring[(i + 1) % m]))
        return F.struct(F.lit(i).alias("i"), low.alias("bits"))

    def flipped(i: int) -> Column:
        flips = F.array(*[F.lit(f).cast("long") for f in (0, *(1 << n for n in range(ring[(i + 1) % m][1])))])
        return F.transform(flips, lambda f: F.struct(F.lit(i).alias("i"), base(i)["bits"].bitwiseXOR(f).alias("bits")))

    left = fps.select(F.col("fp").alias("a"), F.explode(F.array(*map(base, range(m)))).alias("k")).select("a", "k.*")
    right = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*map(flipped, range(m)))).alias("k")).select("b", "k.*")

    def mask(i: int, length: int) -> Column:
        value = sum(((1 << bits) - 1) << at for at, bits in (ring[(i + n) % m] for n in range(length)))
        return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")

    different = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for length in range(3, m):
        masks = F.array(*(mask(i, length) for i in range(m)))
        chain &= F.bit_count(different.bitwiseAND(F.element_at(masks, F.col("i") + 1))) < length
    # Spark takes an exploded table for as small as it was before, here by a factor of 69, and would broadcast it
    near = left.join(right.hint("merge"), ["i", "bits"]).where("a < b").where(chain)
    return near.where(F.bit_count(different) <= distance).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id): one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest key that links of at most ``distance``
    bits reach.  Links are searched among different fingerprints only, so copies cost nothing.  Null and
    empty texts share the fingerprint zero.  A null key is never a ``component_id`` unless its whole group
    has none; repeated rows stay.
    """
    rows = written(fingerprints(docs, key, text, size).withColumnRenamed(key, "_key"), "fingerprints")
    of = least_of_groups(written(rows.groupBy("fp").agg(F.min("_key").alias("_least")), "distinct"), distance)
    return join_hot_keys(rows, of.hint("merge"), ["fp"]).select(  # rows are several times larger than their file
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("_first").alias("component_id"),
    )


def least_of_groups(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, _first): the smallest ``_least`` that links reach.  ``fps`` is a written table (fp, _least), distinct in ``fp``."""
    roots = written(components(links(fps.select("fp"), distance)), "roots")
    linked = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("_least").alias("_first"))
    of_linked = join_hot_keys(linked, least, ["root"]).select("fp", "_first")  # one root may hold most
    return fps.join(of_linked, "fp", "left").select("fp", F.coalesce("_first", "_least").alias("_first"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near copies, all columns unchanged.

    It is the row with the smallest key, of equal keys that with the smallest text hash; rows without a key
    come last.  Rows that are equal in all columns count as one.  No column may hold a map.  A bit set of at most
    32 MB tells which rows may have copies; the others are not shuffled.
    """
    columns = docs.columns
    # rows are known by their text's and their whole content's hash; a null moves no value to another column's place
    content = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))
    marked = docs.select(
        F.struct(*columns).alias("_row"), F.col(key).alias("_key"), text_or_empty(text).alias("_text"),
        F.xxhash64(text_or_empty(text)).alias("_text_hash"), content.alias("_row_hash"),
    )
    identity = ["_text_hash", "_row_hash"]
    prints = map_rows(
        marked.select("_key", *identity, "_text"),
        lambda c: {n: c[n] for n in ("_key", *identity)}
        | {"fp": np.array([fingerprint(t, size) for t in c["_text"]], np.uint64).view(np.int64)},
        f"_key {docs.schema[key].dataType.simpleString()}, _text_hash bigint, _row_hash bigint, fp bigint",
    )
    rows = written(prints.groupBy("fp", "_key", *identity).agg(F.count(F.lit(1)).alias("_n")), "fingerprints")
    order = F.struct(F.col("_key").isNull().alias("last"), "_key", *identity)
    of = least_of_groups(written(rows.groupBy("fp").agg(F.min(order).alias("_least")), "distinct"), distance)
    first = (F.col("_first._text_hash") == F.col("_text_hash")) & (F.col("_first._row_hash") == F.col("_row_hash"))
    judged = join_hot_keys(rows, of.hint("merge"), ["fp"]).select(*identity, "_n", first.alias("_kept"))
    copies = written(judged.where("NOT _kept OR _n > 1").select(*identity, "_kept"), "copies")
    name = F.xxhash64(*identity)
    bits = bits_for(copies.count())
    held = docs.sparkSession.sparkContext.broadcast(hash_bits(copies.select(name.alias("_name")), "_name", bits))

    @F.pandas_udf("boolean")
    def listed(names: pd.Series) -> pd.Series:
        return pd.Series(in_bits(np.frombuffer(held.value, np.uint8), names.to_numpy().view(np.uint64), bits))

    # most rows have no copy and stay where they are; only those that may have one are joined by shuffle
    sorted_out = marked.select("_row", *identity, listed(name).alias("_listed"))
    found = left_join_hot_keys(sorted_out.where("_listed").drop("_listed"), copies, identity)
    alone = sorted_out.where("NOT _listed").select("_row.*").unionByName(found.where("_kept IS NULL").select("_row.*"))
    return alone.unionByName(found.where("_kept").dropDuplicates(identity).select("_row.*"))
