import pytest

from talus.streaming.dedup import counts_by_window, first_seen


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:10:00"), (2, "a", "2024-01-01 00:20:00"), (3, "b", "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "id long, k string, ts string").selectExpr("id", "k", "cast(ts as timestamp_ntz) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def finished(spark, out, mode, name):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name).collect()


def test_first_seen(spark, stream):
    assert sorted(r.k for r in finished(spark, first_seen(stream, "k", "ts"), "append", "seen")) == ["a", "b"]


def test_counts_by_window(spark, stream):
    assert sorted((r.k, r.n) for r in finished(spark, counts_by_window(stream, "k", "ts"), "complete", "counted")) == [("a", 2), ("b", 1)]
