"""Connected components by alternating stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskwright.llm.common import salted_join, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge the smallest node it is connected with.

    Each round hangs the larger neighbours of every node under its smallest neighbour (large star), then
    the smaller ones (small star); edges never grow in number and the rounds grow with the logarithm of
    the longest path.  Every round is written to the shared folder.  Self loops and repeated edges are
    allowed.  No edges: no rows.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    now = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    def pairs(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
        """(a, b): a row for each of the pairs of columns, of one reading of ``df``; a union would plan and run it for each."""
        each = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in columns))
        return df.select(F.explode(each).alias("_pair")).select("_pair.*")

    last = None
    while (new := state(now)) != last:
        last = new
        both = pairs(now, ("a", "b"), ("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = salted_join(both, least, ["u"], F.xxhash64("v")).where("v > u").select(
            F.col("v").alias("a"), F.col("m").alias("b")
        ).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        now = written(pairs(tied, ("b", "m"), ("a", "m")).where("a > b").distinct(), "edges")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("root"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    return found.union(loops.join(found, "node", "left_anti").distinct())
