"""Importance resampling towards a target set: hashed n-gram features, Gumbel scores, a bracketed cutoff.

1. Words and pairs of words of source and target are hashed into ``BUCKETS`` places and counted (one array
   a task, summed by place).  The gain of a place is the log ratio of its two smoothed shares, in thousandths.
2. Tasks score texts with the array of gains: the weight is the mean gain of a text's features.  A Gumbel
   number drawn from the key is added, so that the highest scores are a sample by importance without
   replacement.
3. The cutoff score is bracketed by a quantile sketch of all scores.  The rows above and within the bracket are
   counted exactly; where the cutoff is not within, the bracket is widened.  Only the bracket is sorted.
4. The drawn rows are numbered by ranges of their order, with the sizes of the ranges before added.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.llm.common import map_rows, text_or_empty, written
from maskwright.operators.joins import number_by_rank

BUCKETS = 10_000
# Share of the candidates on either side of the sought rank that the first bracket spans.
MARGIN = 0.002
# Relative rank error of the sketch: a task keeps some thousands of scores at most.
ACCURACY = 2e-4
# A bracket of at most so many rows is sorted; a wider one is sketched again first.
SORTED_AT_MOST = 1_000_000
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
# Lower-cases A-Z and makes all that is no word byte a blank.
_TABLE = bytes(
    b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """(place of every word and of every pair of neighbours, number of words); repeats are kept."""
    words = text.encode().translate(_TABLE).split()
    first = list(map(zlib.crc32, words))
    # the checksum of a pair goes on from that of its first word
    pairs = map(zlib.crc32, map(b" ".__add__, words[1:]), first)
    return np.fromiter((*first, *pairs), np.int64, max(2 * len(words) - 1, 0)) % buckets, len(words)


def place_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features at each place over all texts; ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(features(t.as_py(), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(text_or_empty(text)).mapInArrow(count, "place bigint, n bigint")
    for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of target and source at each place, floored."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((int(y) + 1) * (s + n) / ((int(x) + 1) * (t + n)))) for x, y in zip(source, target)],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, n_words, n_features, weight): the floored mean gain of a text's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # ``buckets`` numbers

    def weigh(columns):
        table = shared.value
        got = [features(t, len(table)) for t in columns["_text"]]
        return {
            "_key": columns["_key"], "n_words": [n for _, n in got], "n_features": [len(at) for at, _ in got],
            "weight": [int(table[at].sum()) // len(at) if len(at) else 0 for at, _ in got],
        }

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(
        docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")), weigh,
        f"_key {kind}, n_words bigint, n_features bigint, weight bigint",
    )


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number fixed by seed and key, floored; a null key counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, n: int, margin: float = MARGIN, most: int = SORTED_AT_MOST) -> tuple[int, int]:
    """(score, above): the ``n``-th highest ``score`` of ``rows`` (n >= 1), and how many rows lie above it.

    A sketch of the scores gives a bracket around the sought rank; the rows above and inside it are
    counted, which proves it or tells on which side it has to grow.  A proven bracket of more than ``most`` rows
    is narrowed by a sketch of itself; scores that tie need no sorting, so the last bracket is sorted by
    its different scores alone.
    """
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    if n > total:
        raise ValueError("fewer rows than the rank sought")
    above, inside, first, last, proven = 0, total, low, high, False
    while (inside > most or not proven) and first < last:
        # ranks count from the lowest score inside the bracket
        want, width = (inside - (n - above)) / inside, margin
        within = rows.where(F.col("score").between(first, last))
        while True:
            shares = [max(0.0, want - width), min(1.0, want + width)]
            a, b = (math.floor(x) for x in within.approxQuantile("score", shares, ACCURACY))
            a, b = max(first, a), min(last, b)
            over, held = within.agg(
                F.count(F.when(F.col("score") > b, 1)), F.count(F.when(F.col("score").between(a, b), 1))
            ).first()
            if above + over < n <= above + over + held or width >= 1:
                break
            width *= 4
        proven = True
        if (a, b) == (first, last):
            break
        above, inside, first, last = above + over, held, a, b
    counted = rows.where(F.col("score").between(first, last)).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    for r in counted.orderBy(F.desc("score")).toLocalIterator():
        if above + r["n"] >= n:
            return r["score"], above
        above += r["n"]
    raise AssertionError("the bracket does not hold the cutoff")


def draw(scored: DataFrame, n: int, key: str = "_key") -> DataFrame:
    """(key, rank): the ``n`` rows of highest ``score``, ties to smaller keys, numbered from 1 in that order.

    ``scored`` is read several times: pass a written table.  Everything down to the cutoff score is a candidate;
    numbering by ranges cuts what ties there.
    """
    if n <= 0:
        return scored.limit(0).withColumn("rank", F.lit(0).cast("long"))
    score, _ = cutoff(scored, n)
    order = [F.desc("score"), F.asc_nulls_first(key)]
    return number_by_rank(scored.where(F.col("score") >= score), order, "rank").where(F.col("rank") <= n)


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, weight, score, rank): every row of ``docs``; ``rank`` is null where it is not drawn.

    ``floor(percent * N / 100)`` of the N rows with ``least_words`` or more are drawn.  Null and empty texts
    have no features and weigh 0; an empty target makes gains of the smoothing alone.  Repeated rows are
    scored alike and are drawn one by one; a null key is hashed as an empty one and comes first among ties.
    Other columns of ``docs`` are not looked at, whatever their names.  An empty table gives no rows.
    """
    gain = gains(place_counts(docs, text, buckets), place_counts(target, target_text, buckets))
    scored = weighted(docs, gain, key, text).withColumn("score", F.col("weight") + gumbel(F.col("_key"), seed))
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    enough = scored.where(F.col("n_words") >= least_words)
    n = percent * enough.count() // 100
    drawn = draw(enough, n).select("_row", "rank")
    return scored.join(drawn, "_row", "left").select(
        F.col("_key").alias(key), "n_features", "weight", "score", "rank"
    )
