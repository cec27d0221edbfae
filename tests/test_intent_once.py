"""An intent's steps are computed once, however many conditions need them."""

from pyspark.sql import functions as F

from facetgraph.operators import intent


def test_tokens_are_made_once(spark):
    found = spark.range(3).select(intent.intent(F.concat(F.lit("show me mom and Asha "), F.col("id").cast("string"))).alias("intent"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("RLIKE ^[A-Z]") <= 1
    assert {r.intent for r in found.collect()} == {"two people"}
    assert spark.sql("SELECT CAST(NULL AS STRING) AS q").select(intent.intent(F.col("q")).alias("i")).first().i == ""
