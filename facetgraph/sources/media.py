"""Media listings as a source: classification, validation and the union of the four scanners."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions and MIME types by category (fixed values).
EXTENSIONS = {
    "image": (
        "jpg", "jpeg", "png", "webp", "bmp", "heic", "heif", "tiff", "tif", "dng", "arw", "cr2", "cr3", "nef", "raf", "orf", "rw2",
    ),
    "video": (
        "mp4", "webm", "mov", "avi", "mkv", "prores", "r3d",
    ),
    "document": (
        "pdf", "docx", "txt", "md", "csv", "pptx", "xlsx", "xls", "odt", "ods", "rtf",
    ),
    "audio": (
        "mp3", "flac", "wav", "aac", "m4a", "ogg", "alac",
    ),
}
MIME_TYPES = {
    "image": (
        "image/jpeg", "image/png", "image/webp", "image/bmp", "image/heic", "image/heif", "image/tiff", "image/x-adobe-dng", "image/x-canon-cr2",
        "image/x-canon-cr3", "image/x-nikon-nef", "image/x-fuji-raf", "image/x-panasonic-rw2", "image/x-olympus-orf", "image/x-sony-arw",
        "image/raw",
    ),
    "video": (
        "video/mp4", "video/webm", "video/quicktime", "video/x-msvideo", "video/x-matroska",
    ),
    "document": (
        "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.ms-excel",
        "application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet", "application/rtf", "text/plain",
        "text/markdown", "text/csv",
    ),
    "audio": (
        "audio/mpeg", "audio/flac", "audio/wav", "audio/aac", "audio/mp4", "audio/ogg", "audio/x-alac",
    ),
}
CATEGORIES = ("image", "video", "audio", "document")


def _lookup(values: dict[str, tuple[str, ...]], key: Column) -> Column:
    pairs = [(x, kind) for kind, names in values.items() for x in names]
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs))), key)


def extension(path: Column) -> Column:
    """What follows the last dot, lowered; nothing without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def media_type(path: Column, mime: Column) -> Column:
    """Category by extension, else by MIME type; null where neither is known."""
    return F.coalesce(_lookup(EXTENSIONS, extension(F.coalesce(path, F.lit("")))), _lookup(MIME_TYPES, F.coalesce(mime, F.lit(""))))


def valid_media(path: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, extension(path)).isNotNull() & (F.trim(path) != ""), F.lit(False))


def stored_type(category: Column) -> Column:
    """Images are called pictures in the catalogue."""
    return F.when(category == "image", "picture").otherwise(category)


def scan_phone(listing: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Valid rows of a listing, of the given categories, in one pass: a size, a MIME type, and an inferred type.

    Pictures and videos have a width and a height, videos and audio a duration.
    """
    kind = F.col("_kind")
    rows = listing.filter((F.col("sizeBytes") > 0) & (F.trim(F.coalesce("mimeType", F.lit(""))) != ""))
    rows = rows.withColumn("_kind", media_type(F.col("absPath"), F.col("mimeType"))).filter(kind.isin(*categories))
    side = lambda name: F.when(kind.isin("image", "video"), F.coalesce(name, F.lit(0))).otherwise(0).cast("int").alias(name)
    return rows.select(
        "mediaId",
        "contentUri",
        "absPath",
        "displayName",
        kind.alias("fileDtype"),
        "mimeType",
        "sizeBytes",
        "mtimeUnix",
        F.lit(0).cast("long").alias("lastIndexedAt"),
        side("widthPx"),
        side("heightPx"),
        F.when(kind.isin("video", "audio"), F.col("durationMs")).cast("long").alias("durationMs"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("retryCount"),
    )


def scan_category(listing: DataFrame, category: str) -> DataFrame:
    """Valid rows of one category."""
    return scan_phone(listing, (category,))


def to_files(scanned: DataFrame, first_id: Column | None = None) -> DataFrame:
    """Catalogue rows of scanned ones: the path if there is one, else the URI; nothing null that the catalogue counts."""
    return scanned.select(
        (F.col("mediaId") if first_id is None else first_id).alias("id"),
        F.coalesce(F.when(F.col("absPath") != "", F.col("absPath")), F.col("contentUri")).alias("abs_path"),
        F.coalesce("displayName", F.lit("")).alias("display_name"),
        stored_type(F.col("fileDtype")).alias("filetype"),
        F.col("mimeType").alias("mime_type"),
        F.col("sizeBytes").alias("size_bytes"),
        F.col("mtimeUnix").alias("mtime_unix"),
        F.col("lastIndexedAt").alias("last_indexed_at"),
        F.col("widthPx").alias("width_px"),
        F.col("heightPx").alias("height_px"),
        F.coalesce("durationMs", F.lit(0)).cast("long").alias("duration_ms"),
        F.lit(0).alias("face_count"),
        "status",
        F.col("retryCount").alias("retry_count"),
    )


def pictures_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files, for models that read pixels; unreadable ones are skipped."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)


def merges(spark: SparkSession, path: str) -> DataFrame:
    """rank, a, b of a tokenizer's merge list: one pair a line, a line that starts with # is a comment."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    pairs = lines.filter(~F.startswith("value", F.lit("#")) & F.contains("value", F.lit(" ")))
    from pyspark.sql.window import Window

    # a merge list is one small file; its order is its content
    return pairs.select((F.row_number().over(Window.orderBy("line")) - 1).alias("rank"), F.split("value", " ")[0].alias("a"), F.split("value", " ")[1].alias("b"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of a JSON object of tokens."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
