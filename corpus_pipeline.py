"""The corpus pipeline: five operators one after another over documents.

Each stage takes all that its predecessor kept and returns the columns of documents,
but for the last, which adds the encoding. A null text is the empty text: quality rules drop it.
A null doc_id is an id like any other, rows of one doc_id are told apart by their texts, rows equal in both
share each verdict (one of them stays in near-dedup), an empty table stays empty, very long texts are taken whole. Each result is written as Parquet to the
shared folder and read again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.llm import decontamination, near_texts, quality_rules, secrets, sentence_pieces
from facetgraph.llm.common import blob_of_text, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Findings that are broadcast at most, about; more are joined by shuffle.
SENT_BYTES = 16 << 20
#: SQL has neither the estimated label model nor fingerprints and pieces; tests compare with brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """_row (all columns of docs), _id and _blob (the text's hash), so that no name of docs meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), blob_of_text().alias("_blob"))


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """_rows of docs whose doc_id and text (blob, its hash) are in verdict; a null id is an id like any other."""
    wanted = verdict.select(F.col("doc_id").alias("kept_id"), F.col("blob").alias("kept_blob")).distinct()
    same = F.col("_id").eqNullSafe(F.col("kept_id")) & (F.col("_blob") == F.col("kept_blob"))
    return _rows(docs).join(wanted.hint("shuffle_hash"), same, "left_semi")


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with doc_id and the text's hash as doc_id: an operator's verdict on it is that on the row."""
    return docs.select(F.struct("doc_id", blob_of_text().alias("blob")).alias("doc_id"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own text."""
    return quality_rules.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that near_texts links: five-word shingles, Jaccard similarity 0.8 or more.

    Candidates come from op6's index of SimHash fingerprints, and from MinHash bands where fingerprints of
    near texts lie farther apart; whole shingle sets decide.

    One row of each group stays: that of the least doc_id, null ones last, and of its
    rows the one of the least text hash. Rows of one doc_id are told apart by text.
    """
    kept = stored(near_texts.firsts(docs), "first-of-group")
    rows = _keep(docs, kept)
    copies = docs.select("doc_id", blob_of_text().alias("blob")).groupBy("doc_id", "blob").count().filter("count > 1")
    if copies.limit(1).count():
        rows = rows.dropDuplicates(["_id", "_blob"])
    return rows.select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage covers to a twentieth, each row by its own text."""
    clean = decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))
    if clean is not None:
        return clean
    found = decontamination.contamination(_told_apart(docs), table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.filter(~decontamination.contaminated()).select("doc_id.*")).select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, other columns as they are; what the secret scan has found in a row's own text is replaced by a mark, and n_chars follows."""
    found = secrets.scan(docs).filter(F.size("findings") > 0).select(F.col("doc_id").alias("found_id"), F.col("blob").alias("found_blob"), "findings").dropDuplicates(["found_id", "found_blob"])
    found = stored(found, "found-secrets")
    size = found.agg(F.count("*").alias("rows"), F.sum(F.size("findings")).alias("spans")).first()
    few = 128 * size["rows"] + 64 * (size["spans"] or 0) <= SENT_BYTES
    same = F.col("_id").eqNullSafe(F.col("found_id")) & (F.col("_blob") == F.col("found_blob"))
    joined = _rows(docs).join(found.hint("broadcast" if few else "shuffle_hash"), same, "left")
    clean = F.when(F.col("findings").isNull(), F.col("_row.text")).otherwise(secrets.redacted(F.coalesce("_row.text", F.lit("")), F.col("findings")))
    cleaned = joined.withColumn("clean", clean)
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("findings").isNull(), F.col("_row.n_chars")).otherwise(F.length("clean")).cast("long")}
    return cleaned.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the pieces of their texts; a column named like a new one is replaced."""
    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
