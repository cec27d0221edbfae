"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every historical version of a path is a blob, named by the SHA-256 of its text. The
ledger remembers which rules, at which version, have seen which blob and what they
found. A scan runs each rule only on blobs that this version of it hasn't seen, adds
what it finds to the ledger, and joins findings back to all paths of each blob.

Ledger format: Parquet rows ``blob, scanned, findings``: the rule versions ("name@n")
that a run applied to a blob, and the spans that they found. Runs only append.

Texts cross one shuffle, by path, in which the paths that carry a new blob are picked
out. Copies don't meet in one task there; the join of findings with paths is a plain
equi-join, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, whole_text


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression. group and least: the group whose length counts, and the least length.

    hint: a cheaper expression that matches wherever pattern does, to skip most texts.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None


#: In the order in which spans with one start are listed. Fixed values.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)password|passwd|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ"),
)
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def none() -> Column:
    """No spans."""
    return F.array().cast(f"array<{SPAN}>")


def rule_version(rule: Rule) -> str:
    return f"{rule.name}@{rule.version}"


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _matches(rule: Rule, rank: int, text: str) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, failing ones dropped.

    A match starts where the pieces between matches and the matches before it end, so
    places follow from the lengths of both.
    """
    of = lambda i: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(i))
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(of(0), F.length)
    counted = F.transform(of(rule.group), F.length)
    state = F.struct(F.lit(0).alias("at"), none().alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["piece"]
        span = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("kind"), (start + x["size"]).cast("int").alias("end"))
        return F.struct((start + x["size"]).cast("int").alias("at"), F.when(x["counted"] >= rule.least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    both = F.zip_with(sizes, counted, lambda a, b: F.struct(a.alias("size"), b.alias("counted")))
    matches = F.zip_with(F.slice(pieces, 1, F.size(sizes)), both, lambda p, x: F.struct(p.alias("piece"), x["size"].alias("size"), x["counted"].alias("counted")))
    return F.aggregate(matches, state, step, lambda s: s["spans"])


def _shortened(rule: Rule) -> Rule:
    """The same matches with fewer failing ones: a run of one class is matched whole or not at all, so its least length may stand in the pattern."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
        start = rule.pattern.rindex("[")
        fixed = len(rule.pattern[:start])
        return Rule(rule.name, rule.version, f"{rule.pattern[:-1]}{{{rule.least - fixed},}}", 0, rule.least, rule.hint)
    return rule


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, scanned, findings for blobs (blob, text, due: the rule versions to apply)."""
    found = [F.when(F.array_contains("due", rule_version(r)) & (F.col("text").rlike(r.hint) if r.hint else F.lit(True)), _matches(_shortened(r), k, "text")).otherwise(none()) for k, r in enumerate(rules)]
    return blobs.select("blob", F.col("due").alias("scanned"), F.sort_array(F.concat(*found)).alias("findings"))


def unseen(named: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, due for the distinct blobs of named (blob, ...) that some rule version hasn't seen."""
    wanted = F.array(*[F.lit(rule_version(r)) for r in rules])
    distinct = named.select("blob").distinct()
    if ledger is None:
        return distinct.select("blob", wanted.alias("due"))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
    due = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return distinct.join(seen, "blob", "left").select("blob", due.alias("due")).filter(F.size("due") > 0)


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, None where there is none yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return None
    return spark.read.schema(f"blob string, scanned array<string>, findings array<{SPAN}>").parquet(path)


def scan(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """key, blob, findings (sorted spans) for each row of versions (key, text); the ledger grows.

    A null text is the empty blob. Null and repeated keys are paths like any other,
    each row keeps its own result, and a blob that several rows share is scanned once.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = versions.sparkSession
    ledger_path = ledger_path or shared_path(spark, "ledger")
    text = whole_text()
    named = stored(versions.select(F.col(key).alias("path"), blob_of(text).alias("blob")), "paths")
    due = unseen(named, open_ledger(spark, ledger_path), rules)
    # one path stands for each new blob; its text is fetched by path, so copies are spread
    paths = named.groupBy("blob", "path").agg(F.count("*").alias("n")).groupBy("blob").agg(F.min(F.struct("path", "n")).alias("one"))
    chosen = stored(paths.join(due, "blob").select("blob", "due", F.col("one.path").alias("chosen"), (F.col("one.n") > 1).alias("repeated")), "due")
    texts = versions.select(F.col(key).alias("path"), text.alias("text"), blob_of(text).alias("here"))

    def fetched(some: DataFrame) -> DataFrame:
        return texts.join(some.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("chosen")) & (F.col("here") == F.col("blob"))).select("blob", "text", "due")

    new = fetched(chosen.filter("NOT repeated"))
    # rows equal in path and text are one blob: few, and looked for again only where there are any
    if chosen.filter("repeated").limit(1).count():
        new = new.unionByName(fetched(chosen.filter("repeated")).groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due")))
    scan_blobs(new, rules).write.mode("append").parquet(ledger_path)
    found = findings_of(open_ledger(spark, ledger_path), rules)
    return named.join(found, "blob", "left").select(F.col("path").alias(key), "blob", F.coalesce("findings", none()).alias("findings"))


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, findings of the blobs in which the rules, at their present versions, have found something."""
    version = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(rule_version(r)))])
    current = F.filter("findings", lambda s: F.coalesce(F.array_contains("scanned", version[s["kind"]]), F.lit(False)))
    hits = ledger.filter(F.size("findings") > 0).select("blob", current.alias("findings")).filter(F.size("findings") > 0)
    return hits.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("findings")))).alias("findings"))


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping findings replaced by the mark."""

    def step(s: Column, x: Column) -> Column:
        before = F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], before).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(findings, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(findings) > 0, whole).otherwise(text)
