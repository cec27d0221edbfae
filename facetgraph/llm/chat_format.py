r"""Conversations as training texts, with typed content parts: DataFrame functions alone.

A visitor goes over the parts of all turns in order. Text is escaped; an image, a sound or a document becomes
a placeholder, of which the attachments keep the reference, the place and the number of tokens that a model puts there.
The parts are rows until the end, so places are running sums in one window for each conversation.

    <s>[INST] user's parts [/INST]</s>   <s>[SYS] system's parts [/SYS]</s>
    <s>assistant's parts</s>             <s>[ROLE]any other role[/ROLE]parts</s>

Two neighbouring texts have <|part|> between them. Escaping puts a backslash behind the first character of a control
string, and one more where there are some already (<s>, <\s>, <\\s> become <\s>, <\\s>, <\\\s>), so texts come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a part may be beside text, and the tokens that it takes: of an image one for each tile of TILE pixels,
#: of audio AUDIO_RATE a second, of a document PAGE_TOKENS a page; each at least one.
ATTACHED = ("image", "audio", "document")
TILE, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Control strings as patterns of what may follow their first character, with the backslashes that a text has there.
ESCAPES = [(r"<(\\*)(/?s>|\|(?:image|audio|document|part)\|>)", "<"), (r"\[(\\*)(/?(?:INST|SYS|ROLE)\])", "[")]
HEADS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "")}


def escaped(text: Column) -> Column:
    """text with one backslash more in all that looks like a control string."""
    for pattern, first in ESCAPES:
        text = F.regexp_replace(text, pattern, first + r"\\$1$2")
    return text


def unescaped(text: Column) -> Column:
    """What was escaped."""
    for pattern, first in ESCAPES:
        text = F.regexp_replace(text, pattern.replace(r"(\\*)", r"\\(\\*)"), first + "$1$2")
    return text


def text_part(text: Column) -> Column:
    """One text as the parts of a turn."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()]))


def expanded(part: Column) -> Column:
    """Tokens that an attachment takes; null measures count as nothing, and an attachment takes one at least."""
    tiles = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(0)), F.lit(0)) / TILE)
    count = (
        F.when(part["kind"] == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .otherwise(F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
    )
    return F.greatest(count.cast("long"), F.lit(1).cast("long"))


def format_conversations(turns: DataFrame) -> DataFrame:
    r"""conv_id, formatted, turn_starts, loss_spans, attachments for conversations of turns (conv_id, turn, role, parts).

    parts is an array of PART. turn_starts: where each turn begins in formatted; loss_spans (turn, start, end): the
    texts of assistants, turn being the number from 0; attachments (n, kind, ref, turn, start, tokens) in the order of
    their placeholders. All places are code points of formatted, ends exclusive.

    Turns go by turn, null first, then role, then a hash of their parts; equal rows all stay. A null role is the
    empty role; a null text and null or empty parts are empty texts; a kind that isn't known is a document. Rows
    of a null conv_id belong to no common conversation: each is one by itself. An empty table gives an empty one.
    Other columns are ignored. A conversation is one value, like a text: its turns meet in one task; only formatted parts travel there.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    rows = turns.select(
        F.col("conv_id"), lone.alias("_lone"), F.monotonically_increasing_id().alias("_row"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.xxhash64("parts").alias("_tie"),
        F.coalesce(F.size("parts"), F.lit(0)).alias("_size"), F.posexplode_outer(F.transform("parts", lambda p, k: F.struct(p.alias("part"), ((k > 0) & (F.coalesce(F.get("parts", k - 1)["kind"], F.lit("text")) == "text")).alias("after_text")))).alias("_place", "_one"),
    )
    part, is_text = F.col("_one.part"), F.col("_is_text")
    first, last = F.coalesce("_place", F.lit(0)) == 0, F.coalesce("_place", F.lit(0)) >= F.col("_size") - 1
    pick = lambda side: F.coalesce(*[F.when(F.col("role") == r, h[side]) for r, h in HEADS.items()])
    head = F.coalesce(pick(0), F.concat(F.lit("[ROLE]"), escaped(F.col("role")), F.lit("[/ROLE]")))
    rows = rows.withColumn("_is_text", F.coalesce(part["kind"], F.lit("text")) == "text").withColumn("_kind", F.when(part["kind"].isin(*ATTACHED), part["kind"]).otherwise("document"))
    shown = F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.col("_kind"), F.lit("|>")))
    rows = rows.select(
        "conv_id", "_lone", "_row", "turn", "role", "_tie", "_place", first.alias("_first"), F.col("_is_text"), F.col("_kind"), part["ref"].alias("_ref"), expanded(part).alias("_tokens"),
        F.concat(F.when(first, F.concat(F.lit("<s>"), head)).otherwise(F.lit("")), F.when(is_text & F.col("_one.after_text"), "<|part|>").otherwise("")).alias("_head"),
        shown.alias("_shown"), F.when(last, F.concat(F.coalesce(pick(1), F.lit("")), F.lit("</s>"))).otherwise("").alias("_tail"),
    )
    order = Window.partitionBy("conv_id", "_lone").orderBy("turn", "role", "_tie", "_row", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("_head") + F.length("_shown") + F.length("_tail")
    rows = rows.withColumn("_n", F.count("*").over(order)).withColumn("_turn", F.count_if("_first").over(order) - 1).withColumn("_nth", F.count_if(~is_text).over(order) - 1)
    rows = rows.withColumn("_start", F.sum(size.cast("long")).over(order) - size)
    at = F.col("_start") + F.length("_head")
    span = F.struct(F.col("_turn").alias("turn"), at.alias("start"), (at + F.length("_shown")).alias("end"))
    attached = F.struct(F.col("_nth").alias("n"), F.col("_kind").alias("kind"), F.col("_ref").alias("ref"), F.col("_turn").alias("turn"), at.alias("start"), F.col("_tokens").alias("tokens"))
    whole = rows.groupBy("conv_id", "_lone").agg(
        F.collect_list(F.struct("_n", F.concat("_head", "_shown", "_tail").alias("said"))).alias("_said"),
        F.sort_array(F.collect_list(F.when(F.col("_first"), F.col("_start")))).alias("turn_starts"),
        F.sort_array(F.collect_list(F.when(is_text & (F.col("role") == "assistant"), span))).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(~is_text, attached))).alias("attachments"),
    )
    return whole.select("conv_id", F.array_join(F.transform(F.sort_array("_said"), lambda s: s["said"]), "").alias("formatted"), "turn_starts", "loss_spans", "attachments")


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, without <s> and </s>. No text has a bare </s>."""
    found = F.split(formatted, "</s>")
    return F.transform(F.slice(found, 1, F.size(found) - 1), lambda t: F.substring(t, F.lit(4), F.length(t)))


def read_turns(formatted: Column) -> Column:
    """Array of (role, body) of a formatted conversation; body as it stands there, escaped and with placeholders."""

    def turn(piece: Column) -> Column:
        within = lambda role: F.substring(piece, F.lit(len(HEADS[role][0]) + 1), F.length(piece) - sum(map(len, HEADS[role])))
        close = F.locate("[/ROLE]", piece)
        said = lambda role, body: F.struct(role.alias("role"), body.alias("body"))
        other = said(unescaped(F.substring(piece, F.lit(7), close - 7)), F.substring(piece, close + 7, F.length(piece)))
        return (
            F.when(piece.startswith("[INST] "), said(F.lit("user"), within("user")))
            .when(piece.startswith("[SYS] "), said(F.lit("system"), within("system")))
            .when(piece.startswith("[ROLE]"), other)
            .otherwise(said(F.lit("assistant"), piece))
        )

    return F.transform(_pieces(formatted), turn)


def read_texts(body: Column) -> Column:
    """The texts of a body, unescaped, without what stands for attachments."""
    return F.transform(F.split(body, r"<\|(?:image|audio|document|part)\|>"), unescaped)


def read_loss(formatted: Column, starts: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped. Each is cut from its own turn, so the work grows with the text alone."""
    cut = lambda turns, s: F.substring(F.get(turns, s["turn"].cast("int")), (s["start"] - F.get(starts, s["turn"].cast("int")) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    # an array of one binds the turns, so the conversation is split once, not for each span
    return F.get(F.transform(F.array(F.split(formatted, "</s>")), lambda turns: F.transform(spans, lambda s: unescaped(cut(turns, s)))), F.lit(0))
