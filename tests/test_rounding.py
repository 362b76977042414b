import random

import pytest
from pyspark.sql import functions as F

from criteria_engine.functions.rounding import round_exact


@pytest.mark.parametrize("places", [4, 2, 0])
def test_as_the_exact_value_rounds(spark, places):
    draw = random.Random(3)
    values = [a / b for b in range(1, 120) for a in range(b + 1)] + [k / 32 for k in range(33)] + [k / 20000 for k in range(20001)]
    values += [draw.random() * 10 ** -draw.randint(0, 9) for _ in range(2000)] + [1e-300, 5e-324, 0.0, 1.0, 0.99995, 0.00005]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_exact(F.col("v"), places).alias("r"))
    assert [r for r in found.collect() if r.r != round(r.v, places)] == []


def test_null_and_values_out_of_range(spark):
    one = spark.range(1)
    assert one.select(round_exact(F.lit(None).cast("double"))).first()[0] is None
    for bad in (1.5, -0.1, float("nan"), float("inf")):
        with pytest.raises(Exception, match="not from 0 to 1"):
            one.select(round_exact(F.lit(bad))).collect()
    with pytest.raises(ValueError):
        round_exact(F.lit(0.5), 5)
