"""Text functions of queries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_possessive(word: Column) -> Column:
    return F.regexp_replace(word, "^(.+)'s$", "$1")


def strip_my(text: Column) -> Column:
    return F.regexp_replace(text, "^my (?=.)", "")


def normalized(text: Column) -> Column:
    """Lower case letters, digits and blanks only, runs of a character cut to two."""
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, r"([a-z0-9])\1{2,}", "$1$1"))


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and swaps of neighbours, no part edited twice.

    A fold over a's characters; the state is the last two rows of the table.
    """
    chars = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
    width = F.length(b)
    first = F.sequence(F.lit(0), width)
    state = F.struct(F.transform(first, lambda x: F.lit(0)).alias("before"), first.alias("last"), F.lit("").alias("char"), F.lit(0).alias("i"))
    letters = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))

    def row(s: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            same = F.element_at(chars, j) == c
            cost = F.when(same, 0).otherwise(1)
            plain = F.least(F.element_at(s["last"], j + 1) + 1, F.element_at(done, -1) + 1, F.element_at(s["last"], j) + cost)
            swap = (s["i"] > 0) & (j > 1) & (F.try_element_at(chars, j - 1) == c) & (F.element_at(chars, j) == s["char"])
            swapped = F.when(F.coalesce(swap, F.lit(False)), F.least(plain, F.try_element_at(s["before"], j - 1) + cost)).otherwise(plain)
            return F.concat(done, F.array(swapped))

        places = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
        now = F.aggregate(places, F.array(s["i"] + 1), cell)
        return F.struct(s["last"].alias("before"), now.alias("last"), c.alias("char"), (s["i"] + 1).alias("i"))

    return F.aggregate(letters, state, row, lambda s: F.element_at(s["last"], -1))


def deletes(word: Column, distance: int = 2) -> Column:
    """The word and all that deleting up to distance characters makes of it."""
    found = F.array(word)
    for _ in range(distance):
        shorter = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def confidence(distance: Column, frequency: Column) -> Column:
    """Of a correction: by its distance, a little more for frequent words."""
    base = F.when(distance == 0, 1.0).when(distance == 1, 0.95).when(distance == 2, 0.80).otherwise(0.0)
    bonus = F.least(F.lit(0.05), F.log10(F.greatest(frequency, F.lit(1)).cast("double")) * 0.01)
    return F.when(distance > 2, 0.0).otherwise(F.least(F.lit(1.0), base + bonus))


def format_bytes(n: Column) -> Column:
    """A size to a base of 1024 with two decimals at most."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    power = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(4)).cast("int")
    number = F.round(n / F.pow(F.lit(1024.0), power), 2)
    shown = F.regexp_replace(F.format_string("%.2f", number), r"\.?0+$", "")
    return F.when(n.isNull() | (n <= 0), "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(units, power + 1)))


def format_date(unix: Column) -> Column:
    at = F.timestamp_seconds(unix)
    return F.when(unix.isNull() | (unix == 0), "").otherwise(F.date_format(at, "d MMM yyyy h:mm a"))


def shown_name(name: Column) -> Column:
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "Unnamed").otherwise(name)
