"""Look-up joins: both strategies on a table with 40 % of its rows in one key."""

from pyspark.sql import functions as F

from roadwatch.operators import clusters
from roadwatch.operators.lookup import look_up


def test_both_ways_agree_and_do_not_shuffle_on_the_key(spark):
    feed = spark.range(2000).select("id", F.when(F.col("id") % 5 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    table = spark.createDataFrame([("hot", 1.0), *((f"k{i}", float(i)) for i in range(40))], "key string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = look_up(feed, table, ["key"]), look_up(feed, table, ["key"], limit=3)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in large._jdf.queryExecution().executedPlan().toString()
        assert small.columns == large.columns == ["key", "id", "v"]
        want = {r.id: r.v for r in feed.join(table, "key", "left").collect()}
        assert {r.id: r.v for r in small.collect()} == {r.id: r.v for r in large.collect()} == want and len(want) == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_ids_fall_into_many_ordered_buckets(spark):
    ids = spark.range(2000).select(F.format_string("FKID%06d", "id").alias("id"))
    got = ids.withColumn("b", clusters._id_bucket(ids, "id")).orderBy("id").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and len({r.b for r in got}) > 200
