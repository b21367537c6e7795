from pyspark.sql import functions as F

from cohortlab.operators.joins import checked_join
from cohortlab.operators.ranking import bucketed_rank


def test_numbers_without_gaps_in_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") < 4500, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    rows = bucketed_rank(df, ["g"], ["id"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r["rank"])
    assert len(rows) == 5000 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, bucketed_rank(df.repartition(5), ["g"], ["id"]).collect()))


def test_equal_rows_and_empty(spark):
    df = spark.createDataFrame([("a", 1)] * 4, "g string, id long")
    assert sorted(r["rank"] for r in bucketed_rank(df, ["g"], ["id"]).collect()) == [0, 1, 2, 3]
    assert bucketed_rank(df.limit(0), ["g"], ["id"]).count() == 0


def test_checked_join_both_ways(spark):
    big, small = spark.range(100), spark.range(10).withColumn("x", F.lit(1))
    for rows in (5, 50):
        joined = checked_join(big, small, "id", max_rows=rows)
        assert joined.count() == 10
        assert ("strategy=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in joined._jdf.queryExecution().toString().lower()) or rows == 5
