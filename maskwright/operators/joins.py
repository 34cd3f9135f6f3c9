"""Joins and numbering that hold when one key has a large share of all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than
# HOT_SHARE hot keys whatever the size of the data: safe to broadcast.
HOT_SHARE = 2000
# A key of no more rows than this is never hot.
CHUNK = 65_536


def join_hot_keys(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on a unique key of ``dim`` where a few keys may be hot in ``facts``.

    Hot keys are found by a pre-aggregated count; their ``dim`` rows (fewer than
    ``HOT_SHARE``) are broadcast, everything else is joined by shuffle.
    """
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = facts.agg(F.count(F.lit(1))).scalar()
    hot_keys = (
        counts.where(F.col("_n") > CHUNK).where(F.col("_n") * HOT_SHARE > total).select(*on)
    )
    fields = [c for c in dim.columns if c not in on]
    hot = dim.join(F.broadcast(hot_keys), on, "left_semi").select(
        *on, F.struct(*fields).alias("_hot")
    )
    marked = facts.join(F.broadcast(hot), on, "left")
    done = marked.where(F.col("_hot").isNotNull()).select(
        *facts.columns, *[F.col("_hot")[c].alias(c) for c in fields]
    )
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(dim, on)
    return done.unionByName(rest.select(*done.columns))


def left_join_hot_keys(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """``join_hot_keys`` as a left join: rows without a partner stay, with nulls.  ``facts`` is read twice."""
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK)
    total = facts.agg(F.count(F.lit(1))).scalar()
    hot_keys = counts.where(F.col("_n") * HOT_SHARE > total).select(*on)
    fields = [c for c in dim.columns if c not in on]
    hot = dim.join(F.broadcast(hot_keys), on, "left_semi").select(*on, F.struct(*fields).alias("_hot"))
    marked = facts.join(F.broadcast(hot), on, "left")
    done = marked.where(F.col("_hot").isNotNull()).select(
        *facts.columns, *[F.col("_hot")[c].alias(c) for c in fields]
    )
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(dim, on, "left")
    return done.unionByName(rest.select(*done.columns))


def _ranged(rows: DataFrame, order: list, parts: int | None) -> DataFrame:
    """Rows sorted by ranges of a total order, each with its range (``_part``) and place (``_at``, ascending).

    The sorted rows are checkpointed, so that numbers made of both are of one run.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the upper bits of the place number the range, the lower 33 its rows
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.monotonically_increasing_id().alias("_at")
    )
    return checkpointed(placed).withColumn("_part", F.shiftrightunsigned("_at", 33))


def number_rows(rows: DataFrame, numbers: dict[str, list[str]], order: list, parts: int | None = None) -> DataFrame:
    """``row_number`` by ``order`` in groups, without one task for a group: a column for each of ``numbers``.

    ``numbers`` maps a column to its group; the first group is part of the others.  Rows are sorted once, by
    ranges of (first group, order).  A range numbers its rows of a group, and the sizes of the ranges before,
    one small row for a group and range, are added.  However the values of the order are spread, a range
    has its share of the rows.
    """
    first = next(iter(numbers.values()))
    out = _ranged(rows, [*first, *order], parts)
    for into, group in numbers.items():
        keys = [*group, "_part"]
        sizes = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
        local = out.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy("_at")))
        out = local.join(offsets, keys).withColumn(into, F.col("_local") + F.col("_before")).drop("_local", "_before")
    return out.drop("_part", "_at")


def number_by_rank(rows: DataFrame, order: list[Column], into: str, parts: int | None = None) -> DataFrame:
    """Number all ``rows`` from 1 in a total ``order``: ``number_rows`` without groups, and without a shuffle after the sort."""
    ranged = _ranged(rows, order, parts)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(into, F.col("_before") + F.expr("_at & 8589934591") + 1)
        .drop("_part", "_at", "_before")
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage behind a costly scan by a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
    local master may fall back to a scratch folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="maskwright-checkpoint-")
    sc.setCheckpointDir(folder)
