"""Running totals, joins of hot keys and stored tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folio.plans import lineage
from folio.plans.prefix import running_total
from folio.plans.sizes import split_join, spread


def test_running_total_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", 7, 70, 5), (2, "a", 8, 80, 6), (3, None, 9, 90, 7), (4, None, 1, 10, 8)], "id long, g string, _bucket long, _amount long, _own long")
    got = running_total(rows, ["g"], F.col("id") % 2, ["id"], F.lit(1).cast("long"), "n").collect()
    assert sorted((r["id"], r["_bucket"], r["_amount"], r["_own"], r["n"]) for r in got) == [(1, 7, 70, 5, 1), (2, 8, 80, 6, 0), (3, 9, 90, 7, 1), (4, 1, 10, 8, 0)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_a_join(spark, how):
    rows = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 9).alias("k"), "id")
    table = rows.where("k <> 4").groupBy("k").agg(F.count("*").alias("n"))
    want = rows.join(table, "k", how).select("k", "id", "n")
    got = split_join(rows, table, ["k"], "n", how, heavy=50).select("k", "id", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stored_tables_lie_in_the_checkpoint_folder(spark):
    kept = lineage.store(spark.range(3), "three")
    assert kept.count() == 3 and all(spark.conf.get("spark.checkpoint.dir") in f for f in kept.inputFiles())


def test_spread_deals_a_small_scan_over_all_tasks(spark):
    rows = spread(spark.range(1000).coalesce(1), "id")
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 1000
