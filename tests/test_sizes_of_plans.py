from pyspark.sql import functions as F

from graphloom.graph import durable


def test_rounds_do_not_multiply_estimates(spark):
    """Each round joins what the last one wrote with itself: an estimate that multiplied would have 2^rounds digits."""
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    own = spark.range(20).select(F.col("id").alias("q"), F.col("id").alias("label"))
    for _ in range(8):
        own = durable(own.join(own.select(F.col("label").alias("q"), F.col("q").alias("l")), "q").groupBy("q").agg(F.max("l").alias("label")))
    assert own.count() == 20 and bits(own) < 63
