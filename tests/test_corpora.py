from pyspark.sql import functions as F

from maskwright.plans import corpora


def test_one_row_group_over_many_splits_is_dealt_out(spark, tmp_path):
    """A file of one row group has as many splits as its size asks for, and all rows in one of them."""
    cores = spark.sparkContext.defaultParallelism
    rows = 3 * corpora.TASK_ROWS
    path = str(tmp_path / "orders.parquet")
    spark.range(rows).selectExpr("id AS o_orderkey", "repeat(md5(CAST(id AS STRING)), 4) AS pad").coalesce(1).write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "64k")
        plain = spark.read.parquet(path)
        assert plain.rdd.getNumPartitions() >= cores  # enough tasks by their number
        shares = corpora.table(spark, str(tmp_path), "orders").groupBy(F.spark_partition_id()).count()
        found = [r["count"] for r in shares.collect()]
        assert sum(found) == rows
        assert max(found) <= 2 * rows / min(len(found), 4 * cores) and len(found) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
