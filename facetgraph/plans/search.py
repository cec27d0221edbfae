"""Search: many queries as one job, from their texts to ranked files.

Every step is keyed by query_id. Which way a query goes depends on two things: whether
it names entities, and whether its text says anything besides.

* entities and a caption: the files that hold them all, ranked by the caption's vector;
* entities alone: those files, ranked by the least membership score;
* no entities: the nearest vectors of all.

Entities without a common file are a final answer: nothing is found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, vector
from ..models import apply_model
from ..operators import burst, graph, intent, resolve, spans, spell, vectors
from ..storage import stored

Loader = Callable[[], Callable[[list], list]]


@dataclass(frozen=True)
class Options:
    """Which steps run. Without the graph neither the tagger nor the search for names runs."""

    graph: bool = True
    spelling: bool = True
    intent: bool = True
    top_k: int = 30
    burst_seconds: int = burst.WINDOW_S
    empty_names: bool = False


@dataclass(frozen=True)
class Tables:
    files: DataFrame
    entities: DataFrame
    members: DataFrame
    detections: DataFrame
    #: None: pairs are made from detections, of the entities asked for alone.
    pair_files: DataFrame | None
    vectors: DataFrame


def understand(queries: DataFrame, entities: DataFrame, tagger: Loader | None, options: Options) -> DataFrame:
    """query_id, corrected, ids (entities, sorted), caption for queries (query_id, text, owner_entity_id)."""
    spark = queries.sparkSession
    if options.spelling:
        read = spell.correct_queries(queries, spell.dictionary(spark, entities))
    else:
        read = queries.withColumn("corrected", F.coalesce("text", F.lit("")))
    read = stored(read.select("query_id", "owner_entity_id", "corrected"), "queries")
    spoken = spark.createDataFrame([], "query_id long, entity_id long, said string, loose string")
    if options.graph and tagger is not None:
        tagged = apply_model(read, tagger, "corrected", "labels", "array<string>")
        words = F.filter(F.split("corrected", r"\s+"), lambda w: w != "")
        found = tagged.select("query_id", "owner_entity_id", F.explode(spans.decode(words, F.col("labels"))).alias("s")).select("query_id", "owner_entity_id", F.col("s.label").alias("label"), F.col("s.text").alias("text"))
        found = found.filter(F.col("label").isin("SELF", "PERSON", "RELATION"))
        named = found.join(resolve.resolve(found.filter("label <> 'SELF'"), entities, empty_names=options.empty_names).withColumnRenamed("entity_id", "near"), "text", "left")
        own = F.when(F.col("label") == "SELF", F.when(F.col("owner_entity_id") >= 0, F.col("owner_entity_id"))).otherwise(F.col("near"))
        spoken = stored(named.select("query_id", own.alias("entity_id"), F.when(own.isNotNull(), F.lower("text")).alias("said"), F.when(own.isNull(), F.col("text")).alias("loose")), "named")
    if options.graph:
        silent = read.join(spoken.filter("entity_id IS NOT NULL").select("query_id").distinct(), "query_id", "left_anti")
        words = resolve.resolve_words(silent, entities, "corrected").select("query_id", "entity_id", F.lower(text.strip_possessive(F.lower("word"))).alias("said"), F.lit(None).cast("string").alias("loose"))
        spoken = spoken.unionByName(words)
    told = spoken.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"), F.collect_set("said").alias("said"), F.array_sort(F.collect_list("loose")).alias("loose"))
    strings = F.array().cast("array<string>")
    told = stored(told, "told")
    whole = read.join(told, "query_id", "left").select("query_id", "corrected", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"), F.coalesce("said", strings).alias("said"), F.coalesce("loose", strings).alias("loose"))
    words = F.filter(F.split("corrected", r"\s+"), lambda w: w != "")
    cleaned = whole.select("query_id", "corrected", "ids", resolve.caption(words, F.col("said"), F.col("loose")).alias("cleaned"))
    meant = F.when(intent.intent(F.col("cleaned")) != "", intent.intent(F.col("cleaned"))).otherwise(F.col("cleaned")) if options.intent else F.col("cleaned")
    return cleaned.select("query_id", "corrected", "ids", meant.alias("caption"))


#: Rows of what was asked or found that are broadcast at most; more are joined as Spark sees fit.
FEW = 100_000


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few: the large side is then filtered where it lies, also below a grouping."""
    return rows.hint("broadcast") if rows.limit(FEW + 1).count() <= FEW else rows


def common_files(understood: DataFrame, members: DataFrame, pair_files: DataFrame) -> DataFrame:
    """query_id, file_id, score (the least of its members): the files that hold all entities of each query.

    Two entities are looked up in the pair table first; queries it has nothing for, and
    all others, are answered by division of the memberships. Those of other entities go before they are
    grouped or dealt out.
    """
    wanted = understood.filter(F.size("ids") > 0).select("query_id", "ids", F.size("ids").alias("n"))
    one = wanted.select("query_id", "n", F.explode("ids").alias("entity_id"))
    held = one.join(members.join(_few(one.select("entity_id").distinct()), "entity_id", "left_semi"), "entity_id").groupBy("query_id", "n", "file_id").agg(F.count_distinct("entity_id").alias("hit"), F.min("score").alias("score"))
    divided = held.filter(F.col("hit") == F.col("n")).select("query_id", "file_id", "score")
    two = wanted.filter("n = 2").select("query_id", F.get("ids", F.lit(0)).alias("entity_a"), F.get("ids", F.lit(1)).alias("entity_b"))
    indexed = two.join(pair_files, ["entity_a", "entity_b"]).select("query_id", "file_id").distinct()
    scored = indexed.join(divided, ["query_id", "file_id"], "left")
    rest = divided.join(indexed.select("query_id").distinct(), "query_id", "left_anti")
    return rest.unionByName(scored)


def _pairs(understood: DataFrame, tables: Tables) -> DataFrame:
    """The pair table, or those of its rows that queries for two entities can ask for."""
    if tables.pair_files is not None:
        return tables.pair_files
    asked = understood.filter(F.size("ids") == 2).select(F.explode("ids").alias("entity_id")).distinct()
    return graph.edge_files(tables.detections.join(_few(asked), "entity_id", "left_semi"))


def _finish(hits: DataFrame, understood: DataFrame, tables: Tables, options: Options) -> DataFrame:
    """Ranked hits (query_id, file_id, distance, metric): the best top_k, with their files, verified and spread in time.

    The best are written, as they are few whatever the tables hold: files and detections are then filtered where they lie.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "file_id")
    best = stored(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.top_k), "best")
    known = _few(best).join(tables.files.select(F.col("id").alias("file_id"), "abs_path", "display_name", "size_bytes", "mtime_unix"), "file_id")
    known = stored(known, "known")
    wanted = understood.select("query_id", F.explode("ids").alias("entity_id"), F.size("ids").alias("n"))
    seen = known.select("query_id", "file_id").join(wanted, "query_id")
    held = tables.detections.select("file_id", "entity_id").join(_few(seen.select("file_id", "entity_id").distinct()), ["file_id", "entity_id"], "left_semi").distinct()
    seen = seen.join(held, ["file_id", "entity_id"])
    whole = seen.groupBy("query_id", "file_id", "n").count().filter(F.col("count") == F.col("n")).select("query_id", "file_id")
    return burst.deburst(known.join(whole, ["query_id", "file_id"], "left_semi").select(*known.columns), seconds=options.burst_seconds)


RESULT = ["query_id", "rank", "file_id", "abs_path", "display_name", "size_bytes", "mtime_unix", "distance", "metric"]


def search(queries: DataFrame, tables: Tables, embedder: Loader, tagger: Loader | None = None, options: Options = Options()) -> DataFrame:
    """Ranked files for each of queries (query_id, text, owner_entity_id); metric says what distance measures.

    The embedder runs only on captions, once for each. What is understood of the queries is written
    between the steps, as several of them read it: it has a row for each query.
    """
    understood = stored(understand(queries, tables.entities, tagger, options), "understood")
    named = F.size("ids") > 0
    said = understood.filter(F.col("caption") != "")
    embedded = apply_model(said.select("query_id", "caption", named.alias("named")), embedder, "caption", "embedding", "array<float>").filter(F.col("embedding").isNotNull())
    embedded = stored(embedded, "captions")
    found = common_files(understood, tables.members, _pairs(understood, tables))
    near = found.join(embedded.filter("named").select("query_id", F.col("embedding").alias("q")), "query_id").join(tables.vectors, "file_id").filter(F.size("q") == F.size("embedding"))
    by_vector = near.select("query_id", "file_id", (1 - vector.dot(F.col("q"), F.col("embedding"))).alias("distance"), F.lit("cosine").alias("metric"))
    by_member = found.join(understood.filter(F.col("caption") == "").select("query_id"), "query_id", "left_semi").select("query_id", "file_id", (1 - F.col("score")).alias("distance"), F.lit("membership").alias("metric"))
    ranked = _finish(by_vector.unionByName(by_member), understood, tables, options).select(*RESULT)
    overall = vectors.knn_join(tables.vectors, embedded.filter("NOT named").select("query_id", "embedding"), options.top_k, key="file_id")
    overall = stored(overall, "overall")
    order = Window.partitionBy("query_id").orderBy("distance", "file_id")
    files = tables.files.select(F.col("id").alias("file_id"), "abs_path", "display_name", "size_bytes", "mtime_unix")
    overall = _few(overall.withColumn("rank", F.row_number().over(order))).join(files, "file_id").withColumn("metric", F.lit("l2")).select(*RESULT)
    return ranked.unionByName(overall)
