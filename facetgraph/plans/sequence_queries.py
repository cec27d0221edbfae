"""Queries of operators that go step by step (clustering, merging, suppression) or match words, with SQL that says the same plainly."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import models
from ..functions import boxes, text, vector
from ..operators import catalog, graph, intent, pivots, postings, resolve, spans, spell, vectors
from ..sources import proxies
from ..sources.proxies import PAIRS_SQL, WITH, read
from ..storage import stored
from . import search
from .catalogue_queries import CENTROIDS_SQL, DOT_SQL, L2_SQL, NEAR, _normalized_sql, _part_terms, _query_vector, _six, _typos, query


def _lead_sql(rows: str, near: float) -> str:
    """Leader clustering of rows (vec_id, e), one after the other."""
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT vec_id, e, row_number() OVER (ORDER BY vec_id) AS n FROM ({rows})),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[][]) AS c, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS entity_id, CAST(NULL AS DOUBLE) AS distance
UNION ALL SELECT n, CASE WHEN least <= {near} THEN list_concat(c[1:best - 1], [list_transform(moved, lambda x: x / sqrt(list_sum(list_transform(moved, lambda y: y * y))))], c[best + 1:]) ELSE list_append(c, e) END,
vec_id, CASE WHEN least <= {near} THEN best ELSE len(c) + 1 END, CASE WHEN least <= {near} THEN least ELSE 0 END
FROM (SELECT *, list_transform(list_zip(c[best], e), lambda z: 0.9 * z[1] + 0.1 * z[2]) AS moved
FROM (SELECT *, coalesce(list_min(d), 1e9) AS least, CAST(list_position(d, list_min(d)) AS BIGINT) AS best
FROM (SELECT f.n, s.c, f.vec_id, f.e, list_transform(s.c, lambda x: list_distance(x, f.e)) AS d FROM s JOIN f ON f.n = s.n + 1))))
SELECT CAST(0 AS BIGINT) AS scope, vec_id, entity_id, round(distance, 6) AS distance FROM s WHERE vec_id IS NOT NULL"""


@query(_lead_sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings", NEAR))
def cluster_online(spark, d):
    return _six(vectors.cluster_online(read(spark, d, "embeddings"), near=NEAR, blurry=NEAR), "distance")


@query("""WITH RECURSIVE o AS (SELECT label, list(vec_id ORDER BY vec_id % 97 DESC, vec_id) AS ids, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id % 97 DESC, vec_id) AS v,
list(CAST(greatest(vec_id % 97, 1) AS DOUBLE) ORDER BY vec_id % 97 DESC, vec_id) AS w FROM embeddings GROUP BY label),
s AS (SELECT label, ids, v, w, list_transform(ids, lambda x: false) AS gone, 1 AS i, 2 AS j, CAST(NULL AS BIGINT) AS merged_id, CAST(NULL AS BIGINT) AS keeper_id FROM o
UNION ALL SELECT label, ids, CASE WHEN hit THEN list_concat(v[1:i - 1], [list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y))))], v[i + 1:]) ELSE v END,
CASE WHEN hit THEN list_concat(w[1:i - 1], [w[i] + w[j]], w[i + 1:]) ELSE w END, CASE WHEN hit THEN list_concat(gone[1:j - 1], [true], gone[j + 1:]) ELSE gone END,
CASE WHEN gone[i] OR j >= len(ids) THEN i + 1 ELSE i END, CASE WHEN gone[i] OR j >= len(ids) THEN i + 2 ELSE j + 1 END,
CASE WHEN hit THEN ids[j] END, CASE WHEN hit THEN ids[i] END
FROM (SELECT *, list_transform(list_zip(v[i], v[j]), lambda z: (z[1] * w[i] + z[2] * w[j]) / (w[i] + w[j])) AS mean, NOT gone[i] AND NOT gone[j] AND list_distance(v[i], v[j]) <= 1.15 AS hit
FROM s WHERE i < len(ids)))
SELECT merged_id, keeper_id FROM s WHERE merged_id IS NOT NULL""")
def merge_entities(spark, d):
    rows = read(spark, d, "embeddings")
    weights = rows.select(F.col("vec_id").alias("entity_id"), "embedding", (F.col("vec_id") % 97).alias("sample_count"), "label")
    return vectors.merge_entities(weights, 1.15, scope="label")


#: Vectors of people with eight pictures each: the first vector of eight, and a quarter of the picture's own.
FACES_SQL = """SELECT vec_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS e FROM
(SELECT x.vec_id, list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), lambda z: z[1] + 0.25 * z[2]) AS m FROM embeddings x JOIN embeddings a ON a.vec_id = x.vec_id - x.vec_id % 8)"""


def _faces(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    first = rows.select(F.col("vec_id").alias("of"), F.col("embedding").alias("a"))
    drawn = F.zip_with("a", "embedding", lambda x, y: x.cast("double") + 0.25 * y.cast("double"))
    return rows.join(first, F.col("of") == F.col("vec_id") - F.col("vec_id") % 8).select("vec_id", vector.unit(drawn).alias("embedding"))


@query(_lead_sql(FACES_SQL, 0.6))
def cluster_in_rounds(spark, d):
    """Leader clustering of people's pictures, many tasks a round."""
    return _six(vectors.cluster_online(_faces(spark, d), most=256), "distance")


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT vec_id, e, CAST(greatest(vec_id % 97, 1) AS DOUBLE) AS w, row_number() OVER (ORDER BY vec_id % 97 DESC, vec_id) AS n FROM ({FACES_SQL})),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[][]) AS c, CAST([] AS DOUBLE[]) AS ws, CAST([] AS BIGINT[]) AS ids, CAST(NULL AS BIGINT) AS merged_id, CAST(NULL AS BIGINT) AS keeper_id
UNION ALL SELECT n, CASE WHEN hit > 0 THEN list_concat(c[1:hit - 1], [list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y))))], c[hit + 1:]) ELSE list_append(c, e) END,
CASE WHEN hit > 0 THEN list_concat(ws[1:hit - 1], [ws[hit] + w], ws[hit + 1:]) ELSE list_append(ws, w) END, CASE WHEN hit > 0 THEN ids ELSE list_append(ids, vec_id) END, CASE WHEN hit > 0 THEN vec_id END, CASE WHEN hit > 0 THEN ids[hit] END
FROM (SELECT *, list_transform(list_zip(c[hit], e), lambda z: (z[1] * ws[hit] + z[2] * w) / (ws[hit] + w)) AS mean
FROM (SELECT f.*, s.c, s.ws, s.ids, coalesce(list_position(list_transform(s.c, lambda x: list_distance(x, f.e) <= 0.6), true), 0) AS hit FROM s JOIN f ON f.n = s.n + 1)))
SELECT merged_id, keeper_id FROM s WHERE merged_id IS NOT NULL""")
def merge_in_rounds(spark, d):
    """Each picture a person of its own, merged greedily, many tasks a round."""
    people = _faces(spark, d).select(F.col("vec_id").alias("entity_id"), "embedding", (F.col("vec_id") % 97).alias("sample_count"))
    return vectors.merge_entities(people, 0.6, most=100)


@query(f"""SELECT query_id, vec_id, distance FROM (SELECT q.vec_id AS query_id, x.vec_id, {L2_SQL.format(a='x.embedding', b='q.embedding')} AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2_SQL.format(a='x.embedding', b='q.embedding')}, x.vec_id) AS n FROM embeddings x, embeddings q WHERE q.vec_id % 20 = 0) WHERE n <= 5""")
def knn_join_pivots(spark, d):
    """The five nearest of all vectors to every twentieth, both sides joined by pivots."""
    rows = read(spark, d, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _six(pivots.knn_by_pivots(rows, asked, 5), "distance")


BOXES_SQL = WITH + """, b AS (SELECT file_id, list({'conf': det_score, 'i': CAST(bbox_h / 30 AS INTEGER), 'x': CAST(bbox_w % 40 AS DOUBLE), 'y': CAST(bbox_h % 50 AS DOUBLE), 'w': CAST(bbox_w + 20 AS DOUBLE), 'h': CAST(bbox_h + 20 AS DOUBLE)}
ORDER BY det_score DESC, bbox_h, bbox_w % 40, bbox_w) AS all_boxes FROM detections GROUP BY 1)"""


@query(BOXES_SQL.replace("WITH files", "WITH RECURSIVE files") + """, s AS (SELECT file_id, all_boxes, 1 AS n, all_boxes[1:0] AS kept FROM b
UNION ALL SELECT file_id, all_boxes, n + 1, CASE WHEN len(list_filter(kept, lambda k: greatest(least(k.x + k.w, all_boxes[n].x + all_boxes[n].w) - greatest(k.x, all_boxes[n].x), 0)
* greatest(least(k.y + k.h, all_boxes[n].y + all_boxes[n].h) - greatest(k.y, all_boxes[n].y), 0) / (k.w * k.h + all_boxes[n].w * all_boxes[n].h
- greatest(least(k.x + k.w, all_boxes[n].x + all_boxes[n].w) - greatest(k.x, all_boxes[n].x), 0) * greatest(least(k.y + k.h, all_boxes[n].y + all_boxes[n].h) - greatest(k.y, all_boxes[n].y), 0)) > 0.4)) > 0
THEN kept ELSE list_append(kept, all_boxes[n]) END FROM s WHERE n <= len(all_boxes))
SELECT file_id, unnest(list_transform(kept, lambda k: k.i)) AS i, round(unnest(list_transform(kept, lambda k: k.conf)), 6) AS conf FROM s WHERE n = len(all_boxes) + 1""")
def nms_boxes(spark, d):
    box = F.struct(F.col("det_score").alias("conf"), F.floor(F.col("bbox_h") / 30).cast("int").alias("i"), (F.col("bbox_w") % 40).cast("double").alias("x"), (F.col("bbox_h") % 50).cast("double").alias("y"), (F.col("bbox_w") + 20).cast("double").alias("w"), (F.col("bbox_h") + 20).cast("double").alias("h"))
    found = proxies.detections(spark, d).groupBy("file_id").agg(F.collect_list(box).alias("boxes"))
    kept = found.select("file_id", F.explode(boxes.suppressed(F.col("boxes"))).alias("b"))
    return kept.select("file_id", F.col("b.i").alias("i"), F.round("b.conf", 6).alias("conf"))


#: The words of parts with the typos of catalogue_queries, and all that up to two deletes make of a word.
WORDS_SQL = """w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part),
y AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(w, 2, 1) || substr(w, 1, 1) || substr(w, 3) WHEN 1 THEN substr(w, 2) ELSE w END AS word FROM w),
terms AS (SELECT DISTINCT w AS term FROM w)"""


def _shorter_sql(word: str) -> str:
    return f"list_distinct(list_append(list_transform(range(1, len({word}) + 1), lambda k: substr({word}, 1, k - 1) || substr({word}, k + 1)), {word}))"


CORRECT_SQL = WORDS_SQL + f""", asked AS (SELECT DISTINCT word, {_shorter_sql('word')} AS one FROM y WHERE len(word) > 2 AND NOT regexp_matches(word, '[0-9]') AND word NOT IN (SELECT term FROM terms)),
a2 AS (SELECT word, one, list_distinct(flatten(list_transform(one, lambda x: {_shorter_sql('x')}))) AS two FROM asked),
t2 AS (SELECT term, list_distinct(flatten(list_transform({_shorter_sql('term')}, lambda x: {_shorter_sql('x')}))) AS two FROM terms),
m AS (SELECT word, term, damerau_levenshtein(word, term) AS distance, CASE WHEN list_has_any(one, t2.two) THEN 1 ELSE 2 END AS tier FROM a2 JOIN t2 ON list_has_any(a2.two, t2.two)),
fixes AS (SELECT word, term AS correction, CAST(distance AS INTEGER) AS distance, least(1.0, CASE distance WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.80 END + least(0.05, log10(1000.0) * 0.01)) AS confidence FROM
(SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, tier, term) AS n FROM m WHERE distance <= 2) WHERE n = 1)"""


@query(f"WITH {CORRECT_SQL} SELECT word, correction, distance, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM fixes")
def symspell_correct(spark, d):
    return _six(spell.corrections(_typos(spark, d), _part_terms(spark, d)), "confidence")


@query(f"""WITH {CORRECT_SQL}, q AS (SELECT p_partkey, w.i, y.word FROM (SELECT p_partkey, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i, unnest(string_split(p_name, ' ')) AS w FROM part) w
JOIN (SELECT p_partkey AS k, w AS v, max(word) AS word FROM (SELECT p_partkey, w, CASE p_partkey % 3 WHEN 0 THEN substr(w, 2, 1) || substr(w, 1, 1) || substr(w, 3) WHEN 1 THEN substr(w, 2) ELSE w END AS word FROM w) GROUP BY 1, 2) y ON y.k = w.p_partkey AND y.v = w.w)
SELECT p_partkey AS query_id, string_agg(coalesce(correction, q.word), ' ' ORDER BY i) AS corrected, bool_or(correction IS NOT NULL) AS was_corrected FROM q LEFT JOIN fixes ON fixes.word = q.word GROUP BY 1""")
def correct_queries(spark, d):
    w = F.split("p_name", " ")
    typo = lambda x: F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(x, 2, 1), F.substring(x, 1, 1), F.substring(x, F.lit(3), F.length(x)))).when(F.col("p_partkey") % 3 == 1, F.substring(x, F.lit(2), F.length(x))).otherwise(x)
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.array_join(F.transform(w, typo), " ").alias("text"))
    return spell.correct_queries(asked, _part_terms(spark, d)).select("query_id", "corrected", "was_corrected")


PEOPLE_SQL = "people AS (SELECT w AS display_name, min(p_partkey) AS entity_id, count(*) AS sample_count FROM w GROUP BY 1)"


def _people(spark, d):
    words = read(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("display_name"))
    named = words.groupBy("display_name").agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("sample_count"))
    return named.withColumn("relation", F.lit("")).withColumn("entity_type", F.lit("person"))


@query(f"""WITH {WORDS_SQL}, {PEOPLE_SQL}, asked AS (SELECT DISTINCT word FROM y WHERE word <> ''),
m AS (SELECT word, entity_id, damerau_levenshtein(lower(word), lower(display_name)) AS distance, sample_count FROM asked, people)
SELECT word AS text, entity_id, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, sample_count DESC, entity_id) AS n FROM m WHERE distance <= 2) WHERE n = 1""")
def resolve_entity(spark, d):
    return resolve.resolve(_typos(spark, d).select(F.col("word").alias("text")).filter("text != ''"), _people(spark, d))


@query(f"""WITH {WORDS_SQL}, {PEOPLE_SQL}, said AS (SELECT p_partkey AS query_id, unnest(string_split('Show me ' || p_name || '''s photos of my ' || p_name, ' ')) AS word FROM part),
bare AS (SELECT DISTINCT word, regexp_replace(lower(word), '^(.+)''s$', '\\1') AS b FROM said WHERE len(regexp_replace(lower(word), '^(.+)''s$', '\\1')) > 2),
m AS (SELECT word, entity_id, damerau_levenshtein(b, lower(display_name)) AS distance, sample_count FROM bare, people WHERE b NOT IN ({', '.join(f"'{x}'" for x in resolve.FILLERS)})),
best AS (SELECT word, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, sample_count DESC, entity_id) AS n FROM m WHERE distance <= 2) WHERE n = 1)
SELECT query_id, min(word) AS word, entity_id FROM said JOIN best USING (word) GROUP BY query_id, entity_id""")
def resolve_words(spark, d):
    said = F.concat(F.lit("Show me "), "p_name", F.lit("'s photos of my "), "p_name")
    return resolve.resolve_words(read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), said.alias("text")), _people(spark, d))


@query("""SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN '''s' ELSE '' END, '^(.+)''s$', '\\1') AS bare,
regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN 'my ' ELSE '' END || p_name, '^my (.)', '\\1') AS mine FROM part""")
def strip_possessive_and_my(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        "p_partkey",
        text.strip_possessive(F.concat("p_name", F.when(k % 2 == 0, "'s").otherwise(""))).alias("bare"),
        text.strip_my(F.concat(F.when(k % 3 == 0, "my ").otherwise(""), F.col("p_name"))).alias("mine"),
    )


@query("""WITH t AS (SELECT l_orderkey AS query_id, l_linenumber AS place, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CAST(place // 2 - 1 AS INTEGER) AS word_id FROM t), f AS (SELECT *, lag(word_id) OVER (PARTITION BY query_id ORDER BY place) AS before FROM p)
SELECT query_id, word_id, 'w' || word_id AS word, label FROM f WHERE word_id >= 0 AND word_id IS DISTINCT FROM before""")
def first_subwords(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place")).agg(F.min("l_returnflag").alias("label"))
    pieces = rows.withColumn("word_id", (F.floor(F.col("place") / 2) - 1).cast("int")).withColumn("word", F.concat(F.lit("w"), "word_id"))
    return spans.word_labels(pieces)


#: A caption of words that intents know and others, by a number.
SAID = [["photos of", "show me", "my", "find pictures of", ""], ["mom", "dad and me", "family", "Asha", "friends", "Asha Ravi Mira", "car", "uncle"], ["birthday", "wedding", "", "trip", ""], ["beach", "", "office", "kedarnath", "", "home", "sky"]]


def _said_sql(k: str) -> str:
    pick = lambda xs, by: f"CASE CAST({k} AS BIGINT) // {by} % {len(xs)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
    return " || ' ' || ".join(pick(xs, by) for xs, by in zip(SAID, (1, 5, 40, 200), strict=True))


@query(f"""WITH q AS (SELECT o_orderkey AS id, {_said_sql('o_orderkey')} AS text, o_orderkey AS k FROM orders),
p AS (SELECT *, CASE WHEN k // 1 % 5 IN (0, 1, 3) THEN true ELSE false END AS prefixed, k // 5 % 8 AS who, k // 40 % 5 AS what, k // 200 % 7 AS whereat FROM q)
SELECT id, trim(concat_ws(' ', CASE what WHEN 0 THEN 'birthday celebration' WHEN 1 THEN 'wedding ceremony' WHEN 3 THEN 'holiday trip' ELSE
CASE who WHEN 0 THEN 'portrait of a woman' WHEN 1 THEN 'two people' WHEN 2 THEN 'family photo' WHEN 3 THEN 'portrait of a person' WHEN 4 THEN 'group of people' WHEN 5 THEN 'group of people' WHEN 7 THEN 'portrait of a man'
ELSE CASE WHEN k % 5 = 1 THEN 'portrait of a person' ELSE '' END END END,
CASE whereat WHEN 0 THEN 'at a beach' WHEN 2 THEN 'in an office' WHEN 3 THEN 'at kedarnath' WHEN 5 THEN 'at home' ELSE '' END)) AS intent FROM p""")
def intent_combinations(spark, d):
    k = F.col("o_orderkey")
    parts = [F.get(F.array(*map(F.lit, xs)), (F.floor(k / by) % len(xs)).cast("int")) for xs, by in zip(SAID, (1, 5, 40, 200), strict=True)]
    return read(spark, d, "orders").select(k.alias("id"), intent.intent(F.concat_ws(" ", *parts)).alias("intent"))


@query(WITH + """, q AS (SELECT s_suppkey AS query_id, unnest(list_distinct([s_suppkey, (s_suppkey * 7 + 3) % 90, (s_suppkey * 11 + 5) % 120][1:s_suppkey % 3 + 1])) AS entity_id FROM supplier),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1)
SELECT query_id, file_id FROM (SELECT query_id, file_id, count(DISTINCT entity_id) AS hit FROM q JOIN members USING (entity_id) GROUP BY 1, 2) JOIN n USING (query_id) WHERE hit = n""")
def posting_intersections(spark, d):
    """One, two or three entities of every supplier's query, intersected by their posting lists; some have no list."""
    k = F.col("s_suppkey").cast("long")
    ids = F.slice(F.array(k, (k * 7 + 3) % 90, (k * 11 + 5) % 120), F.lit(1), (k % 3 + 1).cast("int"))
    asked = read(spark, d, "supplier").select(k.alias("query_id"), ids.alias("ids"))
    members = proxies.members(spark, d)  # a row of lineitem each, at most
    return postings.intersect(asked, stored(postings.postings(members, read(spark, d, "lineitem").count()), "lists"))


@query(WITH + "," + PAIRS_SQL + " SELECT file_id FROM pair_files WHERE entity_a = 1 AND entity_b = 2")
def pair_table_candidates(spark, d):
    return graph.candidates(proxies.members(spark, d), [2, 1], graph.edge_files(proxies.detections(spark, d)))


@query(WITH + " SELECT file_id FROM members WHERE entity_id IN (1, 2) GROUP BY 1 HAVING count(DISTINCT entity_id) = 2")
def pair_table_without_the_pair(spark, d):
    return graph.candidates(proxies.members(spark, d), [2, 1], graph.edge_files(proxies.detections(spark, d)).filter("entity_a > 2"))


@query(WITH + " SELECT file_id FROM members WHERE entity_id IN (1, 2, 123456789) GROUP BY 1 HAVING count(DISTINCT entity_id) = 3")
def no_common_files(spark, d):
    return graph.candidates(proxies.members(spark, d), [1, 2, 123_456_789])


@query(WITH + "," + PAIRS_SQL + """ SELECT entity_a, entity_b, count(*) AS co_occurrence_count, min(mtime_unix) AS first_seen_at, max(mtime_unix) AS last_seen_at
FROM pair_files JOIN files ON file_id = id GROUP BY 1, 2""")
def merged_edges(spark, d):
    found, files = proxies.detections(spark, d), proxies.files(spark, d)
    return graph.merge_edges(graph.edges(found.filter("file_id % 2 = 0"), files), graph.edges(found.filter("file_id % 2 = 1"), files), graph.parts_of(found))


@query("""WITH cells AS (SELECT label, vec_id % 5 + 1 AS w, unnest(range(1, 65)) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, place, sum(w * x) / sum(w) AS m FROM cells GROUP BY 1, 2), norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY 1)
SELECT label, CAST(place AS INTEGER) AS place, round(m / n, 6) AS x FROM means JOIN norms USING (label)""")
def weighted_centroids(spark, d):
    found = vectors.mean_vectors(read(spark, d, "embeddings"), "label", F.col("vec_id") % 5 + 1)
    return found.select("label", F.posexplode("embedding").alias("p", "v")).select("label", (F.col("p") + 1).alias("place"), F.round("v", 6).alias("x"))


@query(f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT label, {DOT_SQL.format(a='embedding', b='e')} AS cosine FROM embeddings, q)
SELECT label, count(*) AS n, round(min(cosine), 6) AS least, round(max(cosine), 6) AS most, round(avg(cosine), 6) AS mean FROM s GROUP BY 1""")
def vec_cosine_stats(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    scored = read(spark, d, "embeddings").select("label", vector.dot(F.col("embedding"), q).alias("cosine"))
    return _six(scored.groupBy("label").agg(F.count("*").alias("n"), F.min("cosine").alias("least"), F.max("cosine").alias("most"), F.avg("cosine").alias("mean")), "least", "most", "mean")


@query(CENTROIDS_SQL + """, b AS (SELECT vec_id, list_transform(list_zip(c, embedding::DOUBLE[]), lambda z: 0.9 * z[1] + 0.1 * z[2]) AS m FROM embeddings JOIN centroids USING (label)),
n AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS l FROM b)
SELECT vec_id, CAST(unnest(range(1, 65)) AS INTEGER) AS place, round(unnest(list_transform(m, lambda x: x / l)), 6) AS x FROM n""")
def blended_vectors(spark, d):
    rows = read(spark, d, "embeddings").join(_labelled_centroids(spark, d), "label")
    return rows.select("vec_id", F.posexplode(vector.blend(F.col("centroid"), F.col("embedding"))).alias("p", "v")).select("vec_id", (F.col("p") + 1).alias("place"), F.round("v", 6).alias("x"))


def _labelled_centroids(spark, d):
    return vectors.mean_vectors(read(spark, d, "embeddings"), "label").withColumnRenamed("embedding", "centroid")


@query("""SELECT vec_id, CAST(unnest(range(1, 65)) AS INTEGER) AS place, round(unnest(list_transform(embedding, lambda x: CASE WHEN embedding[1] < 0 OR embedding[1] > 1 THEN 1 / (1 + exp(-x::DOUBLE)) ELSE x::DOUBLE END)), 6) AS x FROM embeddings""")
def scores_of_logits(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(vector.logits_to_scores(F.col("embedding"))).alias("p", "v")).select("vec_id", (F.col("p") + 1).alias("place"), F.round("v", 6).alias("x"))


@query("""SELECT '[' || string_agg('{"id":' || n_nationkey || ',"name":' || CAST(to_json(n_name || ' "' || chr(10) || '\\' || chr(9) || '/é') AS VARCHAR) || '}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation""")
def json_strings(spark, d):
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(' "\n\\\t/é')).alias("name"))
    return catalog.as_json(rows, ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'Unnamed' ELSE o_orderpriority END AS shown FROM orders")
def blank_names(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 4 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    return read(spark, d, "orders").select(k.alias("id"), text.shown_name(name).alias("shown"))


@query(f"SELECT p_partkey, {_normalized_sql('p_name')} AS normalized, CAST(damerau_levenshtein(p_name, p_type) AS INTEGER) AS apart FROM part")
def edit_distance(spark, d):
    return read(spark, d, "part").select("p_partkey", text.normalized(F.col("p_name")).alias("normalized"), text.osa(F.col("p_name"), F.col("p_type")).cast("int").alias("apart"))


@query()
def search_pipeline(spark, d):
    """Every nation's name as a query over the whole catalogue: spelling, names, caption, neighbours, burst filter."""
    asked = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("photos of "), F.lower("n_name")).alias("text"), F.lit(-1).cast("long").alias("owner_entity_id"))
    found = proxies.detections(spark, d)
    pictures = read(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), "embedding")
    tables = search.Tables(proxies.files(spark, d), stored(proxies.entities(spark, d), "entities"), proxies.members(spark, d), found, None, pictures)
    return search.search(asked, tables, partial(models.hash_embedder, 64), partial(models.gazetteer, {"france": "PERSON", "germany": "PERSON", "china": "PERSON"}))



