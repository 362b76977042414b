import pytest
from pyspark.sql import functions as F

from criteria_engine.operators import bloom
from criteria_engine.operators.models import select_models
from criteria_engine.plans import resume
from helpers import rows_table


def test_nothing_is_lost_and_little_else_is_kept(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "seq")
    keys = rows.where("seq % 100 = 7")
    found = bloom.likely_in(rows, keys, "seq", 2000)
    assert found.join(keys, "seq").count() == 2000
    assert found.count() <= 2000 + 0.02 * 200_000


def test_sizes_of_the_filter(spark):
    assert [bloom.filter_bits(n) for n in (1, 6, 7, 100, 10**7)] == [64, 64, 128, 1024, 1 << 26]
    assert bloom.filter_bits(1 << 26) == 0
    rows = spark.range(10).withColumnRenamed("id", "seq")
    assert bloom.likely_in(rows, rows, "seq", 1 << 26).count() == bloom.likely_in(rows, rows, "seq", 0).count() == 10
    negative = spark.createDataFrame([(-5,), (None,), (2**62,)], "seq long")
    assert bloom.likely_in(negative, negative.where("seq is not null"), "seq", 2).where("seq is not null").count() == 2


@pytest.mark.parametrize("threshold, filtered", [("-1", True), ("10MB", False), ("1k", True)])
def test_heads_that_are_not_broadcast_filter_the_texts(spark, tmp_path, threshold, filtered):
    keys = [f"k{i}" for i in range(5000)]
    rows_table(spark, keys).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    heads = rows.where("seq % 50 = 0").select("key_hash", "seq", F.array(F.lit("qwen")).alias("open_models"))
    heads.write.parquet(str(tmp_path / "heads"))
    heads = spark.read.parquet(str(tmp_path / "heads"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, threshold)
    try:
        asks = resume._head_rows(rows, heads, 100, 2, select_models("qwen"))
        plan = asks._jdf.queryExecution().optimizedPlan().toString()
        assert ("scalar-subquery" in plan) == filtered
        assert sorted(r.seq for r in asks.collect()) == list(range(0, 5000, 50))
    finally:
        spark.conf.set(name, before)
