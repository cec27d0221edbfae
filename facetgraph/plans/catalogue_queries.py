"""The engine's own operators as queries over whole tables, with SQL for their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import burst, catalog, graph, intent, resolve, spans, spell, stats, vectors
from ..sources import media, proxies
from ..sources.proxies import PAIRS_SQL, WITH, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Distance that makes the test vectors meet: no two lie within 1.0 of each other.
NEAR = 1.25


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").filter("vec_id = 7").first()["embedding"]


L2_SQL = "round(sqrt(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"
DOT_SQL = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: z[1] * z[2]))"


@query(f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, label, {L2_SQL.format(a='embedding', b='e')} AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 30""")
def knn_global_l2(spark, d):
    return _six(vectors.nearest(read(spark, d, "embeddings"), _query_vector(spark, d), 30, keep=("label",)), "distance")


@query(f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), r AS (
SELECT vec_id, round(1 - {DOT_SQL.format(a='embedding', b='e')}, 6) AS distance FROM embeddings, q WHERE label IN (1, 3))
SELECT vec_id, distance FROM r ORDER BY distance, vec_id LIMIT 30""")
def knn_rerank_candidates(spark, d):
    rows = read(spark, d, "embeddings").filter(F.col("label").isin(1, 3))
    return _six(vectors.nearest(rows, _query_vector(spark, d), 30, metric="dot"), "distance")


CENTROIDS_SQL = """WITH cells AS (SELECT label, unnest(range(1, 65)) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, place, avg(x) AS m FROM cells GROUP BY 1, 2),
norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY 1),
centroids AS (SELECT label, list(m / n ORDER BY place) AS c FROM means JOIN norms USING (label) GROUP BY 1)"""


def _centroids(spark, d):
    return vectors.mean_vectors(read(spark, d, "embeddings"), "label").withColumnRenamed("label", "entity_id")


@query(CENTROIDS_SQL + " SELECT label, CAST(place AS INTEGER) AS place, round(m / n, 6) AS x FROM means JOIN norms USING (label)")
def centroid_mean_norm(spark, d):
    return _centroids(spark, d).select(F.col("entity_id").alias("label"), F.posexplode("embedding").alias("p", "v")).select("label", (F.col("p") + 1).alias("place"), F.round("v", 6).alias("x"))


@query(CENTROIDS_SQL + f""" SELECT vec_id, entity_id, distance FROM (SELECT vec_id, CAST(label2 AS BIGINT) AS entity_id, distance,
row_number() OVER (PARTITION BY vec_id ORDER BY distance, label2) AS n FROM (SELECT vec_id, c.label AS label2, {L2_SQL.format(a='embedding', b='c')} AS distance FROM embeddings, centroids c)) WHERE n = 1""")
def knn_join_centroids(spark, d):
    return _six(vectors.assign_to_centroids(read(spark, d, "embeddings"), _centroids(spark, d), None), "distance")


@query(CENTROIDS_SQL + f""" SELECT vec_id, entity_id, distance FROM (SELECT vec_id, CAST(label2 AS BIGINT) AS entity_id, distance,
row_number() OVER (PARTITION BY vec_id ORDER BY distance, label2) AS n FROM (SELECT vec_id, c.label AS label2, {L2_SQL.format(a='embedding', b='c')} AS distance FROM embeddings, centroids c)) WHERE n = 1 AND distance <= {NEAR}""")
def recluster_pending(spark, d):
    return _six(vectors.assign_to_centroids(read(spark, d, "embeddings"), _centroids(spark, d), NEAR), "distance")


@query(f"""SELECT a, b, distance FROM (SELECT x.vec_id AS a, y.vec_id AS b, {L2_SQL.format(a='x.embedding', b='y.embedding')} AS distance
FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE distance <= 1.1""")
def similarity_self_join(spark, d):
    return _six(vectors.similar_pairs(read(spark, d, "embeddings"), 1.1), "distance")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length,
CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS largest FROM embeddings""")
def vec_norm_argmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("length"), vector.argmax(F.col("embedding")).alias("largest"))


@query(WITH + """ SELECT filetype, count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes,
round(sum(size_bytes) * 100.0 / (SELECT sum(size_bytes) FROM files), 4) AS share FROM files GROUP BY 1""")
def files_stats_by_type(spark, d):
    return stats.by_type(proxies.files(spark, d))


@query(WITH + """ SELECT count(*) AS n_files, count(*) FILTER (WHERE filetype = 'picture') AS n_pictures,
count(*) FILTER (WHERE filetype = 'picture' AND status = 'pending') AS n_pending_pictures,
count(*) FILTER (WHERE filetype = 'picture' AND status <> 'skipped') AS n_targets,
(SELECT count(*) FROM embeddings) AS n_vectors FROM files""")
def counts_dashboard(spark, d):
    return stats.counts(proxies.files(spark, d), read(spark, d, "embeddings"))


@query(WITH + """, c AS (SELECT count(*) FILTER (WHERE filetype = 'picture') AS total, count(*) FILTER (WHERE filetype = 'picture' AND status = 'pending') AS pending FROM files)
SELECT total - pending AS processed, total, CAST(least(100, ceil(100.0 * (total - pending) / total)) AS BIGINT) AS percent FROM c""")
def index_progress(spark, d):
    return stats.progress(proxies.files(spark, d))


@query(WITH + " SELECT id, abs_path, status FROM files WHERE filetype = 'picture' AND status = 'pending' ORDER BY id LIMIT 10")
def pending_batch(spark, d):
    return stats.pending_pictures(proxies.files(spark, d)).select("id", "abs_path", "status")


@query(WITH + " SELECT id, abs_path FROM files WHERE filetype = 'picture' AND status = 'indexed'")
def indexed_pictures(spark, d):
    return stats.indexed_pictures(proxies.files(spark, d)).select("id", "abs_path")


@query(WITH + " SELECT abs_path AS uri, filetype AS type, mime_type AS mime, size_bytes AS size FROM files ORDER BY id LIMIT 100")
def stored_files(spark, d):
    return stats.stored_files(proxies.files(spark, d))


@query(WITH + """, old AS (SELECT * FROM files WHERE id % 3 <> 0), fresh AS (SELECT * FROM files WHERE id % 2 = 0)
SELECT id, abs_path, status FROM old UNION ALL SELECT id, abs_path, status FROM fresh WHERE abs_path NOT IN (SELECT abs_path FROM old)""")
def insert_ignore_files(spark, d):
    files = proxies.files(spark, d)
    return catalog.insert_ignore(files.filter("id % 3 <> 0"), files.filter("id % 2 = 0")).select("id", "abs_path", "status")


@query(WITH + """ SELECT id, CASE WHEN id % 5 = 0 THEN 'indexed' WHEN id % 7 = 0 THEN 'failed' ELSE status END AS status,
CAST(CASE WHEN id % 5 = 0 THEN 1700000000 ELSE last_indexed_at END AS BIGINT) AS last_indexed_at FROM files""")
def upsert_status(spark, d):
    files = proxies.files(spark, d)
    failed = catalog.set_status(files, files.filter("id % 7 = 0").select("id", F.lit("failed").alias("status")))
    return catalog.mark_indexed(failed, files.filter("id % 5 = 0").select("id"), 1_700_000_000).select("id", "status", "last_indexed_at")


@query("""SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 99 ELSE label END AS label FROM embeddings""")
def upsert_vectors(spark, d):
    rows = read(spark, d, "embeddings")
    return catalog.upsert(rows, rows.filter("vec_id % 4 = 0").withColumn("label", F.lit(99)), "vec_id").select("vec_id", "label")


@query(WITH + """ SELECT file_id, id, coalesce(CASE WHEN entity_id % 10 <> 0 THEN entity_id END, -1) AS entity_id, count(*) AS n FROM detections GROUP BY 1, 2, 3""")
def fk_cascade_detections(spark, d):
    found = proxies.detections(spark, d)
    e = graph.edges(found)
    gone = proxies.entities(spark, d).filter("entity_id % 10 = 0")
    left = catalog.delete_entities(gone, found, proxies.members(spark, d), e, graph.edge_files(found))
    return left["face_detections"].withColumn("entity_id", F.coalesce("entity_id", F.lit(-1).cast("long"))).groupBy("file_id", "id", "entity_id").agg(F.count("*").alias("n"))


@query(WITH + "," + PAIRS_SQL + """ SELECT entity_a, entity_b, count(*) AS co_occurrence_count FROM pair_files
WHERE entity_a % 10 <> 0 AND entity_b % 10 <> 0 GROUP BY 1, 2""")
def fk_cascade_edges(spark, d):
    found = proxies.detections(spark, d)
    gone = proxies.entities(spark, d).filter("entity_id % 10 = 0")
    return catalog.delete_entities(gone, found, proxies.members(spark, d), graph.edges(found), graph.edge_files(found))["entity_relations"]


@query(WITH + """ SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'P' || entity_id ELSE display_name END AS display_name,
CASE WHEN entity_id % 3 = 0 THEN 'friend' ELSE relation END AS relation, CAST(CASE WHEN entity_id % 3 = 0 THEN entity_id % 40 ELSE 0 END AS INTEGER) AS age FROM entities""")
def set_entity_metadata(spark, d):
    e = proxies.entities(spark, d).withColumn("age", F.lit(None).cast("int"))
    changes = e.filter("entity_id % 3 = 0").select("entity_id", F.concat(F.lit("P"), "entity_id").alias("display_name"), F.lit("friend").alias("relation"), (F.col("entity_id") % 40).cast("int").alias("age"))
    return catalog.set_metadata(e, changes, 1_700_000_000).select("entity_id", "display_name", "relation", F.coalesce("age", F.lit(0)).alias("age"))


@query(WITH + " SELECT entity_id, display_name, sample_count FROM entities ORDER BY sample_count DESC, entity_id LIMIT 50")
def top_entities(spark, d):
    return graph.top_entities(proxies.entities(spark, d))


@query(WITH + " SELECT file_id, abs_path, score FROM members JOIN files ON file_id = id WHERE entity_id = 7 ORDER BY score DESC, file_id LIMIT 100")
def entity_files(spark, d):
    return graph.entity_files(proxies.members(spark, d), proxies.files(spark, d), 7)


@query(WITH + "," + PAIRS_SQL + """, e AS (SELECT entity_a, entity_b, count(*) AS c FROM pair_files GROUP BY 1, 2),
b AS (SELECT entity_a AS entity_id, entity_b AS neighbor_id, c FROM e UNION ALL SELECT entity_b, entity_a, c FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, neighbor_id) AS n FROM b)
SELECT r.entity_id, neighbor_id, display_name, c AS co_occurrence_count FROM r JOIN entities ON entities.entity_id = neighbor_id WHERE n <= 20""")
def entity_neighbors(spark, d):
    found = proxies.detections(spark, d)
    return graph.neighbours(graph.edges(found), proxies.entities(spark, d), parts=graph.parts_of(found))


@query(WITH + "," + PAIRS_SQL + """ SELECT entity_a, entity_b, count(*) AS co_occurrence_count, min(mtime_unix) AS first_seen_at, max(mtime_unix) AS last_seen_at
FROM pair_files JOIN files ON file_id = id GROUP BY 1, 2""")
def cooccurrence_edges(spark, d):
    return graph.edges(proxies.detections(spark, d), proxies.files(spark, d))


@query(WITH + "," + PAIRS_SQL + " SELECT entity_a, entity_b, file_id FROM pair_files")
def edge_files(spark, d):
    return graph.edge_files(proxies.detections(spark, d))


@query(WITH + " SELECT file_id FROM members WHERE entity_id IN (1, 2) GROUP BY 1 HAVING count(DISTINCT entity_id) = 2")
def pair_candidates(spark, d):
    return graph.candidates(proxies.members(spark, d), [2, 1, 1])


@query(WITH + " SELECT DISTINCT file_id FROM members WHERE entity_id = 3")
def single_candidates(spark, d):
    return graph.candidates(proxies.members(spark, d), [3])


@query(WITH + " SELECT file_id FROM members WHERE entity_id IN (0, 1, 2) GROUP BY 1 HAVING count(DISTINCT entity_id) = 3")
def intersect_n_candidates(spark, d):
    return graph.candidates(proxies.members(spark, d), [0, 1, 2, -1])


@query(WITH + """ SELECT file_id, min(score) AS score FROM members WHERE entity_id IN (1, 2) GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, file_id LIMIT 30""")
def membership_min_rank(spark, d):
    return graph.ranked_by_membership(proxies.members(spark, d), [1, 2])


@query(WITH + """, top AS (SELECT file_id, min(score) AS score FROM members WHERE entity_id IN (1, 2) GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, file_id LIMIT 30)
SELECT file_id, score FROM top WHERE file_id IN (SELECT file_id FROM detections WHERE entity_id IN (1, 2) GROUP BY 1 HAVING count(DISTINCT entity_id) = 2)""")
def verify_entities(spark, d):
    hits = graph.ranked_by_membership(proxies.members(spark, d), [1, 2])
    return graph.verified(hits, proxies.detections(spark, d), [1, 2])


@query(WITH + """, r AS (SELECT entity_id, file_id, abs_path, d.id, bbox_w, bbox_h, det_score, row_number() OVER (PARTITION BY entity_id ORDER BY
CASE WHEN det_score > 0.65 AND bbox_w > 60 AND bbox_h > 60 THEN 0 ELSE 1 END, bbox_w * bbox_h DESC, d.id, det_score, file_id) AS n
FROM detections d JOIN files f ON d.file_id = f.id WHERE entity_id IS NOT NULL)
SELECT entity_id, file_id, abs_path, id, bbox_w, bbox_h, det_score FROM r WHERE n = 1""")
def best_face_crop(spark, d):
    return graph.best_crops(proxies.detections(spark, d), proxies.files(spark, d))


@query(WITH + " SELECT f.id, count(d.file_id) AS face_count FROM files f LEFT JOIN detections d ON d.file_id = f.id GROUP BY 1")
def face_count(spark, d):
    return graph.face_counts(proxies.files(spark, d), proxies.detections(spark, d))


@query("SELECT s_suppkey AS entity_id, CASE WHEN trim(s_name) = '' THEN 'Unnamed' ELSE s_name END AS shown FROM supplier")
def display_names(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), text.shown_name(F.col("s_name")).alias("shown"))


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS mtime, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
l AS (SELECT user_id, list({'rank': rank, 'event_id': event_id, 'mtime': mtime} ORDER BY rank) AS hits FROM h WHERE rank <= 30 GROUP BY 1),
f AS (SELECT user_id, hits, 1 AS i, hits[1:0] AS kept FROM l
UNION ALL SELECT user_id, hits, i + 1, CASE WHEN hits[i].mtime > 0 AND len(list_filter(kept, lambda k: k.mtime > 0 AND abs(k.mtime - hits[i].mtime) < 86400)) > 0 THEN kept ELSE list_append(kept, hits[i]) END FROM f WHERE i <= len(hits)),
d AS (SELECT user_id, unnest(kept) AS k FROM f WHERE i = len(hits) + 1)
SELECT user_id, CAST(k.rank AS INTEGER) AS rank, k.event_id AS event_id, k.mtime AS mtime_unix FROM d""")
def deburst_rank(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    hits = read(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("mtime_unix"), F.row_number().over(order).alias("rank")).filter("rank <= 30")
    return burst.deburst(hits, "user_id", seconds=86_400).select("user_id", "rank", "event_id", "mtime_unix")


def _listing(spark, d):
    o = read(spark, d, "orders")
    ends = F.array(*map(F.lit, [".JPG", ".mp4", ".flac", ".pdf", ".xyz", ""]))
    mimes = F.array(*map(F.lit, ["image/png", "video/mp4", "audio/ogg", "text/csv", "", "font/ttf", "image/raw"]))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("mediaId"),
        F.concat(F.lit("content://"), k).alias("contentUri"),
        F.concat(F.lit("/m/"), k, F.get(ends, (k % 6).cast("int"))).alias("absPath"),
        F.concat(F.lit("m"), k).alias("displayName"),
        F.get(mimes, (k % 7).cast("int")).alias("mimeType"),
        F.when(k % 11 == 0, 0).otherwise(F.floor("o_totalprice")).cast("long").alias("sizeBytes"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtimeUnix"),
        F.lit(640).alias("widthPx"),
        F.lit(480).alias("heightPx"),
        F.lit(1000).cast("long").alias("durationMs"),
    )


LISTING_SQL = """WITH l AS (SELECT o_orderkey AS k, ['.JPG', '.mp4', '.flac', '.pdf', '.xyz', ''][CAST(o_orderkey % 6 AS INTEGER) + 1] AS ext,
['image/png', 'video/mp4', 'audio/ogg', 'text/csv', '', 'font/ttf', 'image/raw'][CAST(o_orderkey % 7 AS INTEGER) + 1] AS mime,
CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice) END AS BIGINT) AS size FROM orders),
t AS (SELECT *, coalesce(CASE ext WHEN '.JPG' THEN 'image' WHEN '.mp4' THEN 'video' WHEN '.flac' THEN 'audio' WHEN '.pdf' THEN 'document' END,
CASE mime WHEN 'image/png' THEN 'image' WHEN 'image/raw' THEN 'image' WHEN 'video/mp4' THEN 'video' WHEN 'audio/ogg' THEN 'audio' WHEN 'text/csv' THEN 'document' END) AS kind FROM l)"""


@query(LISTING_SQL + " SELECT k AS media_id, kind FROM t")
def media_type_inference(spark, d):
    return _listing(spark, d).select(F.col("mediaId").alias("media_id"), media.media_type(F.col("absPath"), F.col("mimeType")).alias("kind"))


@query(LISTING_SQL + """ SELECT k AS id, '/m/' || k || ext AS abs_path, 'm' || k AS display_name, CASE kind WHEN 'image' THEN 'picture' ELSE kind END AS filetype, size AS size_bytes,
CAST(CASE WHEN kind IN ('image', 'video') THEN 640 ELSE 0 END AS INTEGER) AS width_px, CAST(CASE WHEN kind IN ('video', 'audio') THEN 1000 ELSE 0 END AS BIGINT) AS duration_ms
FROM t WHERE size > 0 AND mime <> '' AND kind IS NOT NULL""")
def scan_filter(spark, d):
    return media.to_files(media.scan_phone(_listing(spark, d))).select("id", "abs_path", "display_name", "filetype", "size_bytes", "width_px", "duration_ms")


@query(LISTING_SQL + ' SELECT kind AS "fileDtype", count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM t WHERE size > 0 AND mime <> \'\' AND kind IS NOT NULL GROUP BY 1')
def scan_summary(spark, d):
    return stats.scan_summary(media.scan_phone(_listing(spark, d)))


@query("""WITH s AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 1024 END) AS n FROM orders)
SELECT id, n, CASE WHEN n <= 0 THEN '0 B' ELSE regexp_replace(printf('%.2f', round(n / power(1024.0, least(floor(ln(n) / ln(1024.0) + 1e-12), 4)), 2)), '\\.?0+$', '') || ' ' ||
['B', 'KB', 'MB', 'GB', 'TB'][CAST(least(floor(ln(n) / ln(1024.0) + 1e-12), 4) AS INTEGER) + 1] END AS shown FROM s""")
def format_bytes(spark, d):
    n = F.floor("o_totalprice").cast("long") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(1024)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n.cast("long").alias("n"), text.format_bytes(n).alias("shown"))


@query("SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%-d %b %Y %-I:%M %p') AS shown FROM events")
def format_date(spark, d):
    return read(spark, d, "events").select("event_id", text.format_date(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("shown"))


def _normalized_sql(column: str) -> str:
    """DuckDB's expressions have no back references: one replacement for each character that may repeat."""
    sql = f"regexp_replace(lower({column}), '[^a-z0-9 ]', '', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        sql = f"regexp_replace({sql}, '{c}{{3,}}', '{c}{c}', 'g')"
    return f"trim({sql})"


@query(f"SELECT conv_id, turn, {_normalized_sql('text')} AS normalized FROM conversations")
def normalize_query(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.normalized(F.col("text")).alias("normalized"))


def _typos(spark, d):
    names = read(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    typo = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring("w", 2, 1), F.substring("w", 1, 1), F.expr("substring(w, 3)"))).when(F.col("p_partkey") % 3 == 1, F.expr("substring(w, 2)")).otherwise(F.col("w"))
    return names.select("p_partkey", "w", typo.alias("word"))


def _part_terms(spark, d):
    words = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return words.select("term", F.lit(0).alias("place"), F.lit(spell.FREQUENCY).alias("frequency"))


_TERMS_SQL = ", ".join(f"'{t}'" for t in spell.TERMS)


@query(WITH + f""", fixed AS (SELECT CAST(unnest(range(0, {len(spell.TERMS)})) AS BIGINT) AS place, unnest([{_TERMS_SQL}]) AS term),
own AS (SELECT DISTINCT unnest(string_split(lower(display_name || ' ' || coalesce(relation, '')), ' ')) AS term FROM entities)
SELECT place, term, 1000 AS frequency FROM fixed
UNION ALL SELECT CAST(1073741824 AS BIGINT), term, 1000 FROM own WHERE term <> '' AND term NOT IN (SELECT term FROM fixed)""")
def spell_dictionary(spark, d):
    return spell.dictionary(spark, proxies.entities(spark, d))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'portrait of a woman' WHEN 1 THEN 'two people at a beach' WHEN 2 THEN 'birthday celebration in a park' WHEN 3 THEN 'portrait of a person at home' ELSE '' END AS intent FROM orders""")
def intent_caption(spark, d):
    said = F.array(*map(F.lit, ["photos of mom", "mom and dad at the beach", "my birthday in the park", "show me home", "red car"]))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), intent.intent(F.get(said, (F.col("o_orderkey") % 5).cast("int"))).alias("intent"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws, [substr(string_split(p_name, ' ')[1], 1, 4)] AS ss FROM part)
SELECT p_partkey, array_to_string(list_filter(ws, lambda w: len(list_filter(ss, lambda s: contains(s, w) OR contains(w, s))) = 0), ' ') AS cleaned FROM w""")
def caption_cleaning(spark, d):
    words = F.split("p_name", " ")
    return read(spark, d, "part").select("p_partkey", F.array_join(resolve.uncovered(words, F.array(F.substring(F.get(words, F.lit(0)), 1, 4))), " ").alias("cleaned"))


@query("""WITH t AS (SELECT l_orderkey AS q, l_linenumber AS i, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN f = 'A' THEN 1 WHEN f = 'R' AND lag(f) OVER (PARTITION BY q ORDER BY i) IN ('A', 'R') THEN 0 WHEN f = 'R' THEN 1 END AS opens FROM t),
g AS (SELECT *, sum(coalesce(opens, 0)) OVER (PARTITION BY q ORDER BY i) AS grp FROM s)
SELECT q AS query_id, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) AS span FROM g WHERE f <> 'N' GROUP BY q, grp""")
def bio_spans(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("i")).agg(F.min("l_returnflag").alias("f"))
    label = F.when(F.col("f") == "A", "B-PERSON").when(F.col("f") == "R", "I-PERSON").otherwise("O")
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", label.alias("x")))).alias("p"))
    found = packed.select("query_id", F.explode(spans.decode(F.transform("p", lambda x: x["i"].cast("string")), F.transform("p", lambda x: x["x"]))).alias("s"))
    return found.select("query_id", F.col("s.text").alias("span"))


@query(WITH + """, t AS (SELECT entity_id, sample_count FROM entities ORDER BY sample_count DESC, entity_id LIMIT 5)
SELECT '[' || string_agg('{"entity_id":' || entity_id || ',"sample_count":' || sample_count || '}', ',' ORDER BY entity_id) || ']' AS json FROM t""")
def json_results(spark, d):
    return catalog.as_json(graph.top_entities(proxies.entities(spark, d), 5).select("entity_id", "sample_count"), ["entity_id"])


@query(WITH + """, r AS (SELECT entity_id, abs_path, d.id, row_number() OVER (PARTITION BY entity_id ORDER BY
CASE WHEN det_score > 0.65 AND bbox_w > 60 AND bbox_h > 60 THEN 0 ELSE 1 END, bbox_w * bbox_h DESC, d.id, det_score, file_id) AS n
FROM detections d JOIN files f ON d.file_id = f.id WHERE entity_id IS NOT NULL), t AS (SELECT * FROM entities ORDER BY sample_count DESC, entity_id LIMIT 50)
SELECT t.entity_id, display_name, sample_count, abs_path AS crop_path, r.id AS detection_id FROM t LEFT JOIN r ON r.entity_id = t.entity_id AND n = 1""")
def people_cards(spark, d):
    return graph.people_cards(proxies.entities(spark, d), proxies.detections(spark, d), proxies.files(spark, d))
