"""Rows meet their buckets by a broadcast or, beyond its bound, by a shuffle that leaves large buckets out: the same rows."""

import pytest
from pyspark.sql import functions as F

from certloom.llm import jaccard_join


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(3000).select(F.col("id").alias("rep"), (F.col("id") % 2).cast("int").alias("run"), F.when(F.col("id") < 2000, 5).otherwise(F.col("id") % 400).alias("key"))
    sizes = rows.groupBy("run", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return jaccard_join.durable(rows), jaccard_join.durable(sizes)


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("most_hot", [1, 10, 10**6])
def test_rows_meet_their_buckets(tables, monkeypatch, bound, most_hot):
    rows, sizes = tables
    monkeypatch.setattr(jaccard_join, "BROADCAST_BUCKETS", bound)
    monkeypatch.setattr(jaccard_join, "MOST_HOT", most_hot)
    found = jaccard_join._in_buckets(rows, sizes, "n", 3000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(sizes, ["run", "key"]).collect()))
    assert "LeftAnti" not in found._jdf.queryExecution().toString()


def test_classes_are_the_same_beyond_the_bound(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[: 57 + i % 3]) for i in range(40)] + [" ".join(f"{w}{i}" for w in words) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.near_duplicates(docs).drop("text").collect()))
    monkeypatch.setattr(jaccard_join, "BROADCAST_BUCKETS", 0)
    monkeypatch.setattr(jaccard_join, "MOST_HOT", 10)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).drop("text").collect())) == want
    assert len({r[1] for r in want}) == 21
