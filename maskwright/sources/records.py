"""SRC-3 for CSV files of any size: quoted cells may hold line ends, and a file is read in many splits.

In front of a line a file is in one of two states: between records, or inside a quoted cell.  So a line is a
function from state to state, which its text alone decides.  The functions of a split's lines are chained for
both states that may lie in front of the split, the splits of a file by one small row each; then every line
knows its record, wherever that began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.joins import checkpointed
from .formats import csv_text

# A cell that ends in its line, up to the comma or the line end.
_CLOSED_CELL = r'\G(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+)(?:,|\z)'


def ends_quoted(line: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell."""
    return F.contains(line, F.lit('"')) & (F.regexp_replace(line, _CLOSED_CELL, "") != "")


def _with_states(rows: DataFrame, order) -> DataFrame:
    """``quoted_0`` and ``quoted_1``: the state in front of a row if the first row begins unquoted or quoted.

    ``after_0`` and ``after_1`` are the row's function.  The state is that of the last row that ends alike from
    both states, turned once by each row since then that swaps them.
    """
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((F.col("after_0") & ~F.col("after_1")).cast("bigint")).over(earlier)
    rows = rows.withColumn("swaps", F.coalesce(swaps, F.lit(0)))
    fixes = F.when(F.col("after_0") == F.col("after_1"), F.struct("after_0", "swaps"))
    rows = rows.withColumn("fixed", F.last(fixes, ignorenulls=True).over(earlier))
    turned = (F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    return rows.withColumns({
        f"quoted_{first}": F.coalesce("fixed.after_0", F.lit(bool(first))) != turned for first in (0, 1)
    }).drop("swaps", "fixed")


def _chained(lines: DataFrame) -> DataFrame:
    """Per split: the state in front of it, and where the last record before it began."""
    def after(quoted):
        return F.max_by(F.when(F.col(quoted), F.col("after_1")).otherwise(F.col("after_0")), "line")

    splits = lines.groupBy("path", "block").agg(
        after("quoted_0").alias("after_0"), after("quoted_1").alias("after_1"),
        F.max(F.when(~F.col("quoted_0"), F.col("line"))).alias("last_0"),
        F.max(F.when(~F.col("quoted_1"), F.col("line"))).alias("last_1"),
    )
    # a row per split: a file of 100 TB has fewer than a million
    order = Window.partitionBy("path").orderBy("block")
    splits = _with_states(splits, order).withColumn(
        "last", F.when(F.col("quoted_0"), F.col("last_1")).otherwise(F.col("last_0"))
    )
    began = F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("line")))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(
        "path", "block", F.col("quoted_0").alias("quoted"), F.last(began, ignorenulls=True).over(earlier).alias("before")
    )


def read_csv_records(spark: SparkSession, paths) -> DataFrame:
    """``path``, ``at``, ``text``: a row per record, as ``csv_text`` writes it; ``at`` puts a file's records in order.

    The rows of a file, joined by line ends, are what ``csv_text`` makes of the whole file.  A blank line is a record
    with an empty text, the header is a record, wrong UTF-8 is replaced, an empty file has no rows.  A quote that
    never closes is an ordinary character; what follows its record's start is one row then, as many lines as it has.
    Splits are groups of bounded size, so a file with most of the rows is spread like any other.
    """
    value = F.make_valid_utf8("value")
    # the splits of a second reading could differ, so there is one reading only
    lines = checkpointed(spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), value.alias("value"), ends_quoted(value).alias("after_0"),
        # a line inside a quoted cell is one that begins with its quote
        (~F.contains(value, F.lit('"')) | ends_quoted(F.concat(F.lit('"'), value))).alias("after_1"),
    ))
    order = Window.partitionBy("path", "block").orderBy("line")
    lines = _with_states(lines, order)
    placed = lines.join(_chained(lines), ["path", "block"])
    quoted = F.when(F.col("quoted"), F.col("quoted_1")).otherwise(F.col("quoted_0"))
    here = F.last(F.when(~quoted, F.struct("block", "line")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    # a line end behind the record: blank lines after a quote that never closes count, too
    whole = F.concat(F.array_join(F.col("pieces.value"), "\n"), F.lit("\n"))
    return (
        placed.select("path", "block", "line", "value", F.coalesce(here, "before").alias("at"))
        .groupBy("path", "at").agg(pieces.alias("pieces"))
        .select("path", "at", csv_text(whole).alias("text"))
    )
