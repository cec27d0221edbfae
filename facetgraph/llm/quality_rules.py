"""Quality rules with weak supervision, in DataFrame functions alone.

Each rule votes for a text, against it, or abstains. No rule decides: expectation
maximisation estimates, from the votes of all documents and without labels, what
share of texts is bad in each of several ways and how often each rule votes rightly
on good and on bad ones, and a text is kept by its posterior probability of being good.

Both steps run in one SQL expression over the table of vote patterns, which has at
most 3 ** rules rows however many documents there are; the driver holds only the
model's parameters. A text's own statistics are array functions of its row: nothing
is exploded, so neither long texts nor repeated ones are gathered in a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 30
#: Votes that the starting parameters count as, so that a rule with few votes stays near them.
PRIOR_VOTES = 20.0
#: Estimated shares of votes stay between these, so that logarithms are finite; nothing else bounds them.
RARE, SURE = 0.0001, 0.9999
#: Where the search starts: the share of each bad way, votes for good texts, votes against bad ones.
START = (0.03, 0.99, 0.8)
KEEP = 0.5


#: The way of being bad that each rule speaks of. Several rules speak of each, so that their agreement tells how often each is right.
WAYS = {
    "length": "form",
    "word_length": "form",
    "stops": "form",
    "symbols": "symbols",
    "symbol_chars": "symbols",
    "symbol_kinds": "symbols",
    "punctuation": "symbols",
    "capitals": "shouting",
    "exclamations": "shouting",
    "repeated_lines": "repetition",
    "repeated_words": "repetition",
}


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 2).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule: 1 for the text, 2 against it, 0 abstains. An abstention is what lies between two clear cases."""
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 20),
        "symbols": _vote(_share("n_symbols", "n_words") < 0.05, _share("n_symbols", "n_words") > 0.3),
        "symbol_chars": _vote(_share("n_symbols", "word_chars") < 0.01, _share("n_symbols", "word_chars") > 0.05),
        "symbol_kinds": _vote(F.col("n_kinds") < 2, F.col("n_kinds") > 3),
        "punctuation": _vote(_share("n_punctuation", "word_chars") < 0.08, _share("n_punctuation", "word_chars") > 0.15),
        "capitals": _vote(_share("n_upper", "word_chars") < 0.15, _share("n_upper", "word_chars") > 0.4),
        "repeated_lines": _vote(_share("n_dup_lines", "n_lines") < 0.05, _share("n_dup_lines", "n_lines") > 0.5),
        "repeated_words": _vote(_share("n_repeat_words", "n_words") < 0.15, _share("n_repeat_words", "n_words") > 0.4),
        "word_length": _vote(_share("word_chars", "n_words").between(3.5, 9.5), ~_share("word_chars", "n_words").between(2.5, 12)),
        "exclamations": _vote(_share("n_marks", "n_words") < 0.02, _share("n_marks", "n_words") > 0.2),
        "stops": _vote(_share("n_stops", "n_words").between(0.015, 0.35), ~_share("n_stops", "n_words").between(0.004, 0.6)),
    }


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _times(text: Column, char: str) -> Column:
    """How often an ASCII character occurs in a text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, for each row of docs; every other column of docs is passed on.

    Names of the counts that docs has as well are overwritten by the counts. A null text
    is the empty one, of which all counts are 0; null doc_ids and repeated rows are rows
    like any other; an empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in COUNTS]
    text = docs.select(*own, whole_text().alias("_text"))
    # each step below is used more than once by the next, so it is computed once
    words = text.select("*", F.filter(F.split("_text", SPACE), lambda w: w != "").alias("_words"), F.length("_text").alias("_n"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    sized = words.select("*", F.size("_words").alias("_size"), lines.alias("_lines"), _without(F.col("_text"), BLANKS).alias("_chars"), F.array(*[_times(F.col("_text"), c) for c in SYMBOLS]).alias("_symbols"))
    places = F.when(F.col("_size") > 2, F.sequence(F.lit(0), F.col("_size") - 3)).otherwise(F.array().cast("array<int>"))
    hashed = sized.select("*", F.transform(places, lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2])).alias("_hashes"))
    # only texts in which some window may repeat are sorted; words themselves are compared there
    window = lambda i: F.struct(F.concat_ws(" ", F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2]).alias("w"), i.alias("i"))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    ordered = hashed.select("*", F.when(repeats, F.sort_array(F.transform(places, window))).alias("_ordered"))
    same = lambda x, k: (F.get(F.col("_ordered"), k - 1)["w"] == x["w"]) | (F.get(F.col("_ordered"), k + 1)["w"] == x["w"])
    found = ordered.select("*", F.transform(F.filter("_ordered", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]).alias("_repeats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_repeats", lambda i: F.array(i, i + 1, i + 2)))))
    return found.select(
        *own,
        F.col("_size").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.aggregate("_symbols", F.lit(0), lambda a, x: a + x).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.greatest(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.col("_n") - _without(F.col("_text"), UPPER)).cast("long").alias("n_upper"),
        _times(F.col("_text"), "!").cast("long").alias("n_marks"),
        (F.col("_n") - _without(F.col("_text"), ".?。")).cast("long").alias("n_stops"),
        (F.col("_n") - _without(F.col("_text"), PUNCTUATION)).cast("long").alias("n_punctuation"),
        F.size(F.filter("_symbols", lambda x: x > 0)).cast("long").alias("n_kinds"),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stops", "n_punctuation", "n_kinds"]


@dataclass
class LabelModel:
    """Shares of the classes and votes of the rules.

    A text is good or bad in one of several ways. shares: of each bad way; right_on_good:
    how often a rule that votes votes for a text that isn't bad in the rule's way;
    right_on_bad: how often it votes against one that is.
    """

    names: list[str]
    shares: dict[str, float]
    right_on_good: list[float]
    right_on_bad: list[float]

    def odds(self, pattern: Column) -> dict[str, Column]:
        """Of each bad way, its probability against that of a good text. pattern: votes as digits to the base 3."""
        out, good = {}, 1 - sum(self.shares.values())
        for way, share in self.shares.items():
            logit = F.lit(math.log(share / good))
            for j, name in enumerate(self.names):
                if WAYS[name] == way:
                    g, b, vote = self.right_on_good[j], self.right_on_bad[j], vote_of(pattern, j)
                    logit = logit + F.when(vote == 2, math.log(b / (1 - g))).when(vote == 1, math.log((1 - b) / g)).otherwise(0.0)
            out[way] = F.exp(logit)
        return out

    def posterior(self, pattern: Column) -> Column:
        """Probability that a text with these votes is good."""
        return 1 / (1 + sum(self.odds(pattern).values(), F.lit(0.0)))


def vote_of(pattern: Column, j: int) -> Column:
    return F.floor(pattern / F.lit(3**j)) % 3


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over patterns (pattern, n), all rounds in one SQL expression.

    A rule counts where it votes; an abstention says nothing. Which class is the good
    one follows from where the search starts: good texts are many, and rules are right. The
    patterns, at most 3 ** rules, are folded from one row; c are the patterns with p,
    their chances of each bad way under the model m so far.
    """
    ways = sorted({WAYS[x] for x in names})
    way_of = [ways.index(WAYS[x]) for x in names]
    rules_of = [[j for j, w in enumerate(way_of) if w == k] for k in range(len(ways))]
    doubles = lambda x: f"array({', '.join(f'{v}D' for v in x)})"
    total = lambda term: f"aggregate(c, 0D, (a, x) -> a + x.n * ({term}))"
    logit = lambda j: f"CASE x.v[{j}] WHEN 2 THEN ln(m.b[{j}] / (1 - m.g[{j}])) WHEN 1 THEN ln((1 - m.b[{j}]) / m.g[{j}]) ELSE 0D END"
    good = "(1 - aggregate(m.s, 0D, (a, x) -> a + x))"
    odds = ", ".join(f"m.s[{k}] / {good} * exp({' + '.join(map(logit, own))})" for k, own in enumerate(rules_of))
    chances = f"transform(pats, x -> transform(array(array({odds})), o -> named_struct('v', x.v, 'n', x.n, 'p', transform(o, y -> y / (1 + aggregate(o, 0D, (a, z) -> a + z)))))[0])"
    prior = PRIOR_VOTES
    shares = [f"({total(f'x.p[{k}]')} + {START[0] * prior}D) / ({total('1D')} + {prior}D)" for k in range(len(ways))]
    voted = lambda j, v, chance: total(f"CASE WHEN x.v[{j}] = {v} THEN {chance} ELSE 0D END")
    on_good, on_bad = [], []
    for j, k in enumerate(way_of):
        g, b = (f"1 - x.p[{k}]", f"x.p[{k}]")
        on_good.append(f"least(greatest(({voted(j, 1, g)} + {START[1] * prior}D) / ({voted(j, 1, g)} + {voted(j, 2, g)} + {prior}D), {RARE}D), {SURE}D)")
        on_bad.append(f"least(greatest(({voted(j, 2, b)} + {START[2] * prior}D) / ({voted(j, 1, b)} + {voted(j, 2, b)} + {prior}D), {RARE}D), {SURE}D)")
    new = f"named_struct('s', array({', '.join(shares)}), 'g', array({', '.join(on_good)}), 'b', array({', '.join(on_bad)}))"
    start = f"named_struct('s', {doubles([START[0]] * len(ways))}, 'g', {doubles([START[1]] * len(names))}, 'b', {doubles([START[2]] * len(names))})"
    fold = f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> transform(array({chances}), c -> {new})[0])"
    votes = F.array(*[vote_of(F.col("pattern"), j).cast("int") for j in range(len(names))])
    row = patterns.agg(F.collect_list(F.struct(votes.alias("v"), F.col("n").cast("double").alias("n"))).alias("pats")).select(F.expr(fold).alias("m")).first()["m"]
    return LabelModel(names, dict(zip(ways, row["s"], strict=True)), list(row["g"]), list(row["b"]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the counts, votes by rule, good (posterior), base_failed and kept for each row of docs (doc_id, text).

    A null or empty text has no words, votes accordingly and fails the base rule. A
    null doc_id is kept; repeated rows are repeated; an empty table gives an empty
    result. Other columns of docs are ignored.
    """
    counted = stored(statistics(docs.select("doc_id", "text")).drop("text").withColumn("pattern", _pattern()), "quality-counts")
    model = _model(counted)
    votes = F.struct(*[vote_of(F.col("pattern"), j).cast("int").alias(name) for j, name in enumerate(rules())])
    good = model.posterior(F.col("pattern"))
    return counted.select("doc_id", *COUNTS, votes.alias("votes"), good.alias("good"), base_failed().alias("base_failed"), (~base_failed() & (good >= keep)).alias("kept"))


def _pattern() -> Column:
    return sum((v * 3**j for j, v in enumerate(rules().values())), F.lit(0)).cast("int")


def _model(counted: DataFrame) -> LabelModel:
    """The label model of counted (pattern)."""
    patterns = stored(counted.groupBy("pattern").agg(F.count("*").alias("n")).coalesce(1), "vote-patterns")
    return fit(patterns, list(rules()))


def kept_rows(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that judged() keeps, whole.

    Rows are written with their votes and filtered where they lie, so no text is shuffled. Nulls, repeated rows and empty tables as for judged().
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    counted = statistics(docs.select(whole.alias("_row"), "text"))
    voted = stored(counted.select("_row", _pattern().alias("pattern"), base_failed().alias("base_failed")), "voted-rows")
    good = _model(voted).posterior(F.col("pattern"))
    return voted.filter(~F.col("base_failed") & (good >= keep)).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
