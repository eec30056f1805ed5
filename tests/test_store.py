import pytest
from pyspark.sql import functions as F


from quantloom.sources.store import Store, require


def test_writing_a_name_keeps_the_others(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([("000001", "2020-01-01", 1.0), ("000002", "2020-02-01", 2.0)], "ticker string, trade_date string, value double")
    store.write("feature", df, kind="factor", name="mom_3")
    store.write("feature", df, kind="factor", name="mom_6")
    store.write("feature", df.limit(1), kind="factor", name="mom_3")
    assert store.read("feature", kind="factor", name="mom_3").count() == 1
    assert store.read("feature", kind="factor", name="mom_6", dates=("2020-01-15", "2020-12-31")).count() == 1
    for _ in range(2):
        store.write("summary", df)
    assert store.read("summary").count() == 4
    with pytest.raises(ValueError):
        store.write("signal", df)
    with pytest.raises(ValueError):
        store.path("nothing")


def test_unknown_tickers_are_an_error(spark):
    """Found where the rows are read, by the plan itself: planning starts no job."""
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "ticker string, x int")
    assert require(df, df.where("x = 1")).count() == 1
    assert require(df, df.where("x = 9")).count() == 0
    for unknown in ("zz", None):
        group = f"planning-{unknown}"
        spark.sparkContext.setJobGroup(group, "")
        got = require(df, spark.createDataFrame([(unknown,), ("a",)], "ticker string"))
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
        spark.sparkContext.setJobGroup("running", "")
        with pytest.raises(Exception, match="unknown ticker"):
            got.collect()


def test_names_with_different_columns(spark, tmp_path):
    """A name is read with its own columns, whichever other names of its kind are there."""
    store = Store(spark, str(tmp_path))
    plain = spark.createDataFrame([("a", 1.0)], "ticker string, value double")
    store.write("feature", plain, kind="a", name="plain")
    store.write("feature", plain.withColumn("window_id", F.lit(7)), kind="ml", name="windowed")
    store.write("feature", plain, kind="z", name="plain")
    assert [r.window_id for r in store.read("feature", kind="ml", name="windowed").collect()] == [7]
    assert "window_id" not in store.read("feature", kind="a", name="plain").columns
    assert store.read("feature", kind="ml", name="nothing").count() == 0
