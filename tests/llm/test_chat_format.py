"""Chat formatting: round trips, masks, attachments, and turns that look like the template."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from facetgraph.llm import chat_format as chat
from facetgraph.llm import queries

NASTY = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\/s>", "[INST]", r"[\/INST]", "<", "[", "/s>", "<|image|>", r"<\|part|>", "<|ima", "ge|>", "[ROLE]user[/ROLE]", "é\U0001f600\n\t", "", "\\", "<<s>>[[SYS]]", "\r\n", "$1\\1"]


def plain_escape(text):
    text = re.sub(r"<(\\*)(/?s>|\|(?:image|audio|document|part)\|>)", r"<\\\1\2", text)
    return re.sub(r"\[(\\*)(/?(?:INST|SYS|ROLE)\])", r"[\\\1\2", text)


def test_every_text_comes_back(spark):
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choices(NASTY + ["a", " "], k=rng.randrange(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and r.e == plain_escape(r.t) and "</s>" not in r.e and "[/INST]" not in r.e and "<|image|>" not in r.e for r in found)
    assert len({r.e for r in found}) == len({r.t for r in found})


def test_op12(spark, tmp_path):
    rng = random.Random(5)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]", "", None]), rng.choice([None, *NASTY, "".join(rng.choices(NASTY, k=6))])) for c in range(60) for t in range(rng.randrange(1, 9))]
    rng.shuffle(turns)
    turns += [(None, 1, "user", "alone"), (None, 2, "assistant", "too")]
    spark.createDataFrame([(*r, "clash") for r in turns], "conv_id long, turn long, role string, text string, formatted string").repartition(4).write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = queries.queries()["op12_chat_format"](spark, f"file://{tmp_path}").collect()
    expected = {}
    for c, t, role, text in turns + [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]:
        expected.setdefault((c, t if c is None else 0), []).append((t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = []
    for (c, _), own in expected.items():
        own.sort(key=lambda r: r[0])
        loss = "".join(x for _, r, x in own if r == "assistant")
        size = sum(7 + len(plain_escape(x)) + {"user": 15, "system": 13, "assistant": 0}.get(r, 13 + len(plain_escape(r))) for _, r, x in own)
        told.append((c, len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss), size))
    key = lambda r: (r[0] is None, r)
    said = [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in found]
    assert sorted(map(str, said)) == sorted(map(str, told))


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_parts_become_placeholders(spark):
    turns = [
        (1, 0, "user", [part("text", "look <s>"), part("image", ref="i1", width=28, height=15), part("text", "and"), part("text", "<|ima"), part("text", "ge|>"), part("audio", ref="a1", seconds=2.5)]),
        (1, 1, "assistant", [part("text", "well"), part("document", ref="d1", pages=3), part("text", "é]")]),
        (1, 1, "assistant", [part("text", "well"), part("document", ref="d1", pages=3), part("text", "é]")]),
        (1, 2, "system", []),
        (1, 3, "tool", None),
        (1, 4, "assistant", [part("hologram", ref="h"), None]),
    ]
    rows = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>").repartition(3)
    r = chat.format_conversations(rows).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("loss")).first()
    assert r.formatted == (
        r"<s>[INST] look <\s><|image|>and<|part|><|ima<|part|>ge|><|audio|> [/INST]</s>" + "<s>well<|document|>é]</s>" * 2 + "<s>[SYS]  [/SYS]</s><s>[ROLE]tool[/ROLE]</s><s><|document|></s>"
    )
    assert [(a.n, a.kind, a.ref, a.turn, a.tokens) for a in r.attachments] == [(0, "image", "i1", 0, 4), (1, "audio", "a1", 0, 63), (2, "document", "d1", 1, 768), (3, "document", "d1", 2, 768), (4, "document", "h", 5, 1)]
    assert all(r.formatted[a.start :].startswith(f"<|{a.kind}|>") for a in r.attachments)
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["well", "é]"] * 2 + [""] and r.loss == ["well", "é]"] * 2 + [""]
    assert [r.formatted[s:].startswith("<s>") for s in r.turn_starts] == [True] * 6 and [t.role for t in r.turns] == ["user", "assistant", "assistant", "system", "tool", "assistant"]
    texts = spark.createDataFrame([(r.turns[0].body,)], "b string").select(chat.read_texts(F.col("b")).alias("t")).first().t
    assert texts == ["look <s>", "and", "<|ima", "ge|>", ""]
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_no_python_worker(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
