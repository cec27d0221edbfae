"""Labels of words to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def word_labels(pieces: DataFrame) -> DataFrame:
    """query_id, word_id, word, label: the label of each word's first piece (W2). pieces: query_id, place, word_id, word, label."""
    before = F.lag("word_id").over(Window.partitionBy("query_id").orderBy("place"))
    first = pieces.withColumn("_before", before).filter((F.col("word_id") >= 0) & ~F.col("word_id").eqNullSafe(F.col("_before")))
    return first.select("query_id", "word_id", "word", "label")


def decode(words: Column, labels: Column) -> Column:
    """Spans (label, text) of aligned arrays of words and BIO labels (W3), as one fold.

    B opens a span, I continues one of its own label and else opens one, O closes.
    """
    pairs = F.zip_with(F.slice(words, 1, F.least(F.size(words), F.size(labels))), labels, lambda w, x: F.struct(w.alias("w"), x.alias("x")))
    pairs = F.filter(pairs, lambda p: p["w"].isNotNull() & p["x"].isNotNull())
    start = F.struct(F.array().cast("array<struct<label:string,text:string>>").alias("done"), F.lit("").alias("label"), F.lit("").alias("text"))
    closed = lambda s: F.when(s["label"] != "", F.concat(s["done"], F.array(F.struct(s["label"].alias("label"), s["text"].alias("text"))))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        tagged = (F.length(p["x"]) > 2) & F.substring(p["x"], 1, 1).isin("B", "I")
        base = F.when(F.substring(p["x"], 2, 1) == "-", F.substring(p["x"], F.lit(3), F.length(p["x"]))).otherwise(p["x"])
        goes_on = tagged & F.startswith(p["x"], F.lit("I")) & (s["label"] == base)
        opened = F.struct(closed(s).alias("done"), base.alias("label"), p["w"].alias("text"))
        longer = F.struct(s["done"].alias("done"), s["label"].alias("label"), F.concat_ws(" ", s["text"], p["w"]).alias("text"))
        ended = F.struct(closed(s).alias("done"), F.lit("").alias("label"), F.lit("").alias("text"))
        return F.when(goes_on, longer).when(tagged, opened).when(p["x"] == "O", ended).otherwise(s)

    return F.aggregate(pairs, start, step, closed)
