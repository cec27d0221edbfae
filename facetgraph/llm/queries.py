"""The corpus operators as queries of the driver contract.

Each query is thin: it applies its operator, with production parameters, to the
whole table and derives the columns that the contract asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_format, decontamination, lm_scoring, periodic_runs, quality_classifier, quality_rules, secrets, sentence_pieces, sharding, simhash, token_counts, token_store
from .common import small_batches, table, whole_text

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_store.fresh_store(spark))
    return token_store.read_documents(spark, path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    found = secrets.scan(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("findings", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(said(of(*base)), 256).alias("base_sha256"),
        said(F.col("findings")).alias("spans"),
    )


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "ids", "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents"), 8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).withColumn("held_out", quality_classifier.held_out(F.col("doc_id")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, with the contract's period planted in those whose hash is divisible by ten; a null doc_id gets none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # the others keep their text as it is, so few texts are split here
    chosen = docs.select("doc_id", whole_text().alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    first = F.try_mod(g, n)
    period = 1 + F.floor((n - first) / (3 + g % 8))
    placed = chosen.withColumn("n", n).withColumn("a", first).withColumn("p", period)
    word = lambda w, i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("w", word), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", periodic_runs.longest(F.col("runs")))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", whole_text().alias("text"))
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    formatted = chat_format.format_conversations(turns.unionByName(more).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))
    read = formatted.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(chat_format.read_texts(t["body"]), ""), F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centers = centroids.clustered(table(spark, sf_dir, "embeddings"))
    told = centers.select("cluster", "cluster_inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


QUERIES: dict[str, Query] = {
    "op1_token_store": op1_token_store,
    "op2_secret_scan": op2_secret_scan,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_format": op12_chat_format,
    "op13_centroid_clustering": op13_centroid_clustering,
}


def escaped_sql(text: str) -> str:
    """The escapes of op12's template."""
    for pattern, first in chat_format.ESCAPES:
        text = f"regexp_replace({text}, '{pattern}', '{first}\\\\\\1\\2', 'g')"
    return text


def clusters_sql(rounds: int = 10) -> str:
    """Op13's rounds one after another: c0, c1 ... are the centroids, a0, a1 ... the assignments to them."""
    near = "SELECT v.vec_id, v.e, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.nth, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, {c} AS c) AS v GROUP BY v.nth, v.vec_id, v.e"
    steps = [f"a0 AS MATERIALIZED ({near.format(c='c0')})"]
    for r in range(rounds):
        cells = f"SELECT k, place, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(1, 65)) AS place FROM a{r}) GROUP BY 1, 2"
        moved = f"SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS e FROM ({cells}) GROUP BY 1"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.e, c{r}.e) AS e FROM c{r} LEFT JOIN ({moved}) AS m USING (k))")
        steps.append(f"a{r + 1} AS MATERIALIZED ({near.format(c=f'c{r + 1}')})")
    return (
        "WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64), "
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT 8)), "
        + ", ".join(steps)
        + f" SELECT vec_id, CAST(a{rounds}.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} AS c USING (k)"
    )

def words_sql(table: str, key: str) -> str:
    """Words of contract 10 of a table's texts, as a list."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, list_filter(string_split_regex({lowered}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM {table}"


def windows_sql(n: str) -> str:
    return f"unnest(range(1, len(w) - {n} + 2)) AS pos, unnest(list_transform(range(1, len(w) - {n} + 2), lambda k: array_to_string(w[k:k + {n} - 1], ' '))) AS gram"


#: Op10 is plain SQL. Of op4 and op7 SQL can say what quality_counts and text_sizes return. All other results rest on
#: tokenizers, hashes, places of matches or estimated models, and are tested in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": f"""WITH d AS MATERIALIZED ({words_sql('documents', 'doc_id')}), i AS ({words_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0), g AS (SELECT DISTINCT n, item_id, gram FROM (SELECT n, item_id, {windows_sql('n')} FROM n)),
grams AS (SELECT DISTINCT n, gram FROM g), sizes AS (SELECT DISTINCT n FROM g),
h AS (SELECT doc_id, n, pos, gram FROM (SELECT doc_id, n, {windows_sql('n')} FROM d, sizes WHERE len(w) >= n) SEMI JOIN grams USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h JOIN g USING (n, gram)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "quality_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) AS windows, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ 	-
]+', '', 'g') <> '') AS lines FROM d),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 3)) AS place FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (SELECT doc_id, unnest(range(1, len(windows) + 1)) AS pos, unnest(windows) AS gram FROM g)) WHERE times > 1) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM g LEFT JOIN r USING (doc_id)""",
    "op12_chat_format": f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t.turn, CASE t.turn WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS turn) AS t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(7 + length({escaped_sql('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 0 ELSE 13 + length({escaped_sql('role')}) END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op13_centroid_clustering": clusters_sql(),
    "text_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
}


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts, without its verdict."""
    counted = quality_rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that op7 returns beside its counts."""
    return op7_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES |= {"quality_counts": quality_counts, "text_sizes": text_sizes}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
