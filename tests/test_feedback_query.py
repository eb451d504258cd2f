import pytest
from pyspark.sql import functions as F

from cwlight.bench_queries import PLAN, QUERIES
from cwlight.plans.recordings import CHANNELS


def test_regions_cover_all_channels():
    assert sorted(c for cs in PLAN.regions.values() for c in cs) == list(range(CHANNELS))


def vectors(spark, path, bad=None):
    rows = spark.range(2 * CHANNELS).select(F.col("id").alias("vec_id"), F.sequence(F.lit(1), F.lit(64)).cast("array<double>").alias("embedding"))
    value = F.when(F.col("vec_id") == bad, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding"))
    rows.withColumn("embedding", value).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("channel", [1, 6, 23])
def test_every_channel_reaches_the_operator(spark, tmp_path, channel):
    assert QUERIES["feedback_replay"](spark, vectors(spark, tmp_path / "good")).where("value = 0").count() > 0
    with pytest.raises(Exception, match="samples must be finite"):
        QUERIES["feedback_replay"](spark, vectors(spark, tmp_path / "bad", channel)).collect()
