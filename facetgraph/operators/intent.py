"""Intents: what a query's picture shows, by fixed vocabularies."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies (fixed values): what each word stands for.
PEOPLE = {
    "me": "portrait of a person",
    "myself": "portrait of a person",
    "self": "portrait of a person",
    "family": "family photo",
    "group": "group of people",
    "people": "group of people",
    "father": "portrait of a man",
    "dad": "portrait of a man",
    "mother": "portrait of a woman",
    "mom": "portrait of a woman",
    "brother": "portrait of a man",
    "sister": "portrait of a woman",
    "friend": "portrait of a person",
    "friends": "group of people",
    "wife": "portrait of a woman",
    "husband": "portrait of a man",
    "uncle": "portrait of a man",
    "aunt": "portrait of a woman",
    "cousin": "portrait of a person",
}
PLACES = {
    "beach": "at a beach",
    "mountain": "in the mountains",
    "mountains": "in the mountains",
    "kedarnath": "at kedarnath",
    "temple": "near a temple",
    "office": "in an office",
    "school": "at school",
    "home": "at home",
    "park": "in a park",
    "restaurant": "at a restaurant",
}
EVENTS = {
    "graduation": "graduation ceremony",
    "birthday": "birthday celebration",
    "wedding": "wedding ceremony",
    "diwali": "diwali celebration",
    "holi": "holi celebration",
    "festival": "festival celebration",
    "vacation": "holiday trip",
    "trip": "holiday trip",
}
# Words of a query that name nobody and nothing (fixed values).
FILLERS = (
    "show", "me", "pictures", "picture", "photos", "photo", "of", "and", "in", "at", "on", "the", "a", "an", "please", "find", "my", "some", "i",
    "want", "to", "see", "with", "images", "image", "give", "looking", "for",
)
# How queries start, longest forms first (fixed values).
PREFIXES = (
    "show me pictures of ",
    "show me photos of ",
    "show me images of ",
    "show me a picture of ",
    "show me a photo of ",
    "show me an image of ",
    "find pictures of ",
    "find photos of ",
    "find images of ",
    "please find pictures of ",
    "please find photos of ",
    "pictures of ",
    "photos of ",
    "images of ",
    "picture of ",
    "photo of ",
    "image of ",
    "show me ",
    "find me ",
    "please show me ",
    "please find ",
    "looking for ",
)
SELF = ("me", "myself", "self")
GROUPS = ("group", "friends", "people")


def _prefix(query: Column) -> Column:
    low = F.lower(query)
    found = F.lit("")
    for p in reversed(PREFIXES):
        found = F.when(F.startswith(low, F.lit(p)), F.lit(p)).otherwise(found)
    return found


def _meaning(words: dict[str, str], token: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(words.items()))), token)


def _first(words: dict[str, str], low: Column) -> Column:
    known = F.filter(low, lambda t: t.isin(list(words)))
    return F.coalesce(_meaning(words, F.try_element_at(known, F.lit(1))), F.lit(""))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def intent(query: Column) -> Column:
    """The picture that a query asks for: an event or people, then a place; empty if it names none.

    What several steps need is bound, as an expression is computed again at each place that names it.
    """
    return _bound(F.struct(query.alias("query"), _prefix(query).alias("prefix")), _meant)


def _meant(asked: Column) -> Column:
    query, prefix = asked["query"], asked["prefix"]
    rest = F.substring(query, F.length(prefix) + 1, F.length(query))
    tokens = F.filter(F.transform(F.split(rest, r"[ \t\n]+"), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w != "")
    return _bound(F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))), lambda words: _of_words(words, prefix))


def _of_words(words: Column, prefix: Column) -> Column:
    others = F.filter(words, lambda w: ~w["low"].isin("family", *GROUPS))
    known = F.filter(others, lambda w: w["low"].isin(list(PEOPLE)))
    names = F.filter(others, lambda w: ~w["low"].isin([*PEOPLE, *FILLERS, *PLACES, *EVENTS]) & w["t"].rlike("^[A-Z]"))
    found = F.struct(F.transform(words, lambda w: w["low"]).alias("low"), F.transform(known, lambda w: w["low"]).alias("known"), F.size(names).alias("names"))
    return _bound(found, lambda x: _told(x["low"], x["known"], F.size(x["known"]) + x["names"], prefix))


def _told(low: Column, known: Column, count: Column, prefix: Column) -> Column:
    spoken = F.filter(known, lambda t: ~t.isin(*SELF))
    one = F.coalesce(_meaning(PEOPLE, F.coalesce(F.try_element_at(spoken, F.lit(-1)), F.try_element_at(known, F.lit(1)))), F.lit("portrait of a person"))
    people = (
        F.when(F.array_contains(low, "family"), "family photo")
        .when(F.exists(low, lambda t: t.isin(*GROUPS)) | (count > 2), "group of people")
        .when(count == 2, "two people")
        .when(count == 1, one)
        .when(F.endswith(prefix, F.lit("me ")), "portrait of a person")
        .otherwise("")
    )
    place = _first(PLACES, low)
    return _bound(_first(EVENTS, low), lambda event: F.trim(F.concat_ws(" ", F.when(event != "", event).otherwise(people), place)))
