import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import skew


@pytest.mark.parametrize("largest", [0, 1, 3, 1000])
def test_with_least(spark, monkeypatch, largest):
    monkeypatch.setattr(skew, "LARGEST", largest)
    r = random.Random(5)
    rows = [(r.choice([None, 1, 1, 1, 1, 2, r.randrange(3, 60)]), r.choice([None, r.randrange(100)]), k) for k in range(600)]
    rows += rows[:20]
    least = {}
    for key, value, _ in rows:
        if key is not None and value is not None:
            least[key] = min(value, least.get(key, value))
    got = skew.with_least(spark.createDataFrame(rows, "key long, value long, id long"), "key", F.col("value"), "least", "id")
    assert got.columns == ["key", "value", "id", "least"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*x, least.get(x[0])) for x in rows), key=str)


def test_no_rows(spark):
    assert skew.with_least(spark.createDataFrame([], "key long, value long"), "key", F.col("value"), "least", "value").count() == 0
