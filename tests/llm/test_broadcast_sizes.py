"""Tables that Spark takes for much smaller than they are must not be broadcast."""

import pytest
from pyspark.sql import functions as F

from maskwright.llm import common, packing, simhash, substrings


@pytest.fixture
def joins(capsys):
    """How many joins of a kind a plan has."""
    def count(df, kind="BroadcastHashJoin"):
        df.explain()
        return capsys.readouterr().out.count(f"{kind} ")

    return count


def test_keys_of_fingerprints_are_shuffled(spark, joins):
    fps = common.written(spark.range(50).select(F.xxhash64("id").alias("fp")), "distinct")
    assert joins(fps.join(fps.select("fp", F.lit(1)), "fp")) == 1  # the table as it is may be
    assert joins(simhash.links(fps)) == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_repeated_rows_are_shuffled(spark, joins, how):
    facts = common.written(spark.range(200).select((F.col("id") % 3).alias("k"), "id"), "facts")
    dim = common.written(spark.range(2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")), "dim")
    joined = common.salted_join(facts, dim, ["k"], F.xxhash64("id"), how=how)
    assert joins(joined) == 0
    got = {tuple(r) for r in joined.select("k", "id", "v").collect()}
    assert got == {(i % 3, i, None if i % 3 == 2 else i % 3 * 10) for i in range(200) if how == "left" or i % 3 < 2}


def test_sizes_of_buckets_are_shuffled(spark, joins):
    pieces = common.written(spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 5 + 1).alias("length")
    ), "pieces")
    placed = packing.place(pieces, size=8)
    assert joins(placed) == 0
    taken = [(r["sequence_id"], r["offset"] + i) for r in placed.collect() for i in range(r["length"])]
    assert len(taken) == len(set(taken)) == sum(i % 5 + 1 for i in range(40)) and max(at for _, at in taken) < 8


def test_rows_and_ranges_are_shuffled(spark, joins):
    """By broadcast come only hot keys and their rows, which are bounded; a plan shows them for both halves."""
    docs = common.written(spark.range(30).select(
        F.col("id").alias("doc_id"),
        F.expr("concat_ws(' ', transform(sequence(0, 70), i -> concat('w', i * (id % 3 + 1))))").alias("text"),
    ), "docs")
    cut = substrings.cut_documents(docs)
    assert joins(cut, "SortMergeJoin") == 1
    assert {r["_removed"] > 0 for r in cut.where("doc_id >= 3").collect()} == {True}
    near = simhash.near_duplicates(docs)
    assert joins(near, "SortMergeJoin") >= 1
    assert {(r["doc_id"], r["component_id"]) for r in near.collect()} == {(i, i % 3) for i in range(30)}
