"""Words and spans of queries to entities, by edit distance to names and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..storage import tasks
from . import intent

# Words of a query that never name anybody: those of intents and two more (fixed values).
FILLERS = (*intent.FILLERS, "pics", "pic")
DISTANCE = 2


def resolve(spans: DataFrame, entities: DataFrame, distance: int = DISTANCE, empty_names: bool = False) -> DataFrame:
    """text, entity_id, distance: the nearest entity of each distinct span, by name or relation.

    Candidates come from an equi-join of shortened forms; two texts within distance
    share one. Ties go to the larger sample_count, then the lower id. Empty names
    match short spans only where asked for. Of entities with an entity_type, persons alone count (S8).

    Of the entities of one name only the first by those ties can be meant, so names are compared, each
    once; they are dealt out before they are shortened, as few bytes become many forms.
    """
    if "entity_type" in entities.columns:
        entities = entities.filter(F.col("entity_type") == "person")
    said = F.lower(text.strip_possessive(text.strip_my(F.lower("text"))))
    asked = spans.select("text").distinct().withColumn("said", said)
    names = entities.select("entity_id", "sample_count", F.explode(F.array(F.lower(F.coalesce("display_name", F.lit(""))), F.lower(F.coalesce("relation", F.lit(""))))).alias("name"))
    if not empty_names:
        names = names.filter("name != ''")
    names = names.repartition(tasks(spans.sparkSession, 0), "name").groupBy("name").agg(F.min(F.struct(F.col("sample_count").isNull().alias("uncounted"), (-F.col("sample_count")).alias("rare"), F.col("entity_id"))).alias("best"))
    left = asked.select("text", "said", F.explode(text.deletes(F.col("said"), distance)).alias("key"))
    right = names.select("name", "best", F.explode(text.deletes(F.col("name"), distance)).alias("key"))
    pairs = left.join(right, "key").select("text", "said", "name", "best").distinct()
    near = pairs.withColumn("distance", text.osa(F.col("said"), F.col("name"))).filter(F.col("distance") <= distance)
    order = Window.partitionBy("text").orderBy("distance", "best")
    return near.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("text", F.col("best.entity_id").alias("entity_id"), "distance")


def resolve_words(queries: DataFrame, entities: DataFrame, column: str = "text") -> DataFrame:
    """query_id, word, entity_id for the words of queries that name somebody, fillers and short words aside."""
    words = queries.select("query_id", F.explode(F.split(column, r"\s+")).alias("word"))
    bare = text.strip_possessive(F.lower("word"))
    words = words.filter(~bare.isin(list(FILLERS)) & (F.length(bare) > 2)).withColumnRenamed("word", "text")
    found = words.join(resolve(words, entities), "text").select("query_id", F.col("text").alias("word"), "entity_id")
    first = Window.partitionBy("query_id", "entity_id").orderBy("word")
    return found.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def uncovered(words, spans):
    """Of an array of words, those that neither hold a span nor are held by one."""
    bare = lambda w: text.strip_possessive(F.lower(w))
    covered = lambda w: F.exists(spans, lambda s: F.contains(s, bare(w)) | F.contains(bare(w), s))
    return F.filter(words, lambda w: ~covered(w))


def caption(words, spans, unresolved):
    """What is left of a query, with the spans that named nobody once more after it."""
    return F.array_join(F.concat(uncovered(words, spans), unresolved), " ")
