"""Spelling correction by symmetric deletes: an equi-join on shortened words, then the exact distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..storage import tasks
from . import intent

# Words that queries are about: those that intents know, in their order.
TERMS = (*intent.PEOPLE, *intent.PLACES, *intent.EVENTS)
FREQUENCY = 1000
ACCEPT = 0.75
DISTANCE = 2


def dictionary(spark: SparkSession, entities: DataFrame | None = None) -> DataFrame:
    """term, place, frequency: the fixed terms, then words of names and relations."""
    fixed = spark.createDataFrame([(i, t) for i, t in enumerate(TERMS)], "place long, term string")
    if entities is not None:
        said = F.concat_ws(" ", F.coalesce("display_name", F.lit("")), F.coalesce("relation", F.lit("")))
        if "entity_type" in entities.columns:
            entities = entities.filter(F.col("entity_type") == "person")
        own = entities.select(F.explode(F.split(F.lower(said), r"\s+")).alias("term")).filter("term != ''").distinct()
        fixed = fixed.unionByName(own.join(fixed, "term", "left_anti").select(F.lit(1 << 30).cast("long").alias("place"), "term"))
    return fixed.withColumn("frequency", F.lit(FREQUENCY))


def corrections(words: DataFrame, terms: DataFrame, distance: int = DISTANCE, accept: float = ACCEPT) -> DataFrame:
    """word, correction, distance, confidence for the distinct words (word) that change.

    Words with a digit, of up to two letters, or in the dictionary stay. The order
    among candidates: distance, whether one delete of the word is enough to meet the
    term, place in the dictionary, term. Terms are dealt out before they are shortened.
    """
    asked = words.select("word").distinct().filter((F.length("word") > 2) & ~F.col("word").rlike("[0-9]"))
    asked = asked.join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    dealt = terms.repartition(tasks(words.sparkSession, 0), "term")
    keys = dealt.select("term", "place", "frequency", F.explode(text.deletes(F.col("term"), distance)).alias("key"))
    found = asked.select("word", F.explode(text.deletes(F.col("word"), distance)).alias("key")).join(keys, "key")
    tier = F.when(F.array_contains(text.deletes(F.col("word"), 1), F.col("key")), 1).otherwise(2)
    found = found.groupBy("word", "term", "place", "frequency").agg(F.min(tier).alias("tier"))
    scored = found.withColumn("distance", text.osa(F.col("word"), F.col("term"))).filter(F.col("distance") <= distance)
    scored = scored.withColumn("confidence", text.confidence(F.col("distance"), F.col("frequency"))).filter(F.col("confidence") >= accept)
    order = Window.partitionBy("word").orderBy("distance", "tier", "place", "term")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("word", F.col("term").alias("correction"), "distance", "confidence")


def correct_queries(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries with corrected (words joined by single blanks) and was_corrected."""
    norm = queries.withColumn("_words", F.filter(F.split(text.normalized(F.col("text")), " +"), lambda w: w != ""))
    words = norm.select("query_id", F.posexplode("_words").alias("i", "word"))
    fixed = words.join(corrections(words, terms), "word", "left").groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("correction", "word").alias("w")))), lambda x: x["w"]), " ").alias("corrected"),
        F.max(F.col("correction").isNotNull()).alias("was_corrected"),
    )
    return queries.join(fixed, "query_id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(""))).withColumn("was_corrected", F.coalesce("was_corrected", F.lit(False)))
