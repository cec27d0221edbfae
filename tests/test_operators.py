"""Column functions and operators against hand-made values and plain Python models."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetgraph.functions import boxes, text, tokenizers
from facetgraph.operators import burst, catalog, intent, resolve, spans, spell, vectors
from facetgraph.sources import media


def osa(a, b):
    d = {(-1, -1): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            cost = a[i - 1] != b[j - 1]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + cost)
    return d[len(a), len(b)]


def column(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_osa(spark):
    rng = random.Random(1)
    pairs = [("ca", "abc"), ("vrey", "very"), ("", "x"), ("", "")] + [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(200)]
    found = column(spark, pairs, "a string, b string", "a", "b", text.osa(F.col("a"), F.col("b")))
    assert all(d == osa(a, b) for a, b, d in found)
    assert osa("ca", "abc") == 3


def test_deletes_and_confidence(spark):
    assert set(column(spark, [("abc",)], "w string", text.deletes(F.col("w"), 2))[0][0]) == {"abc", "bc", "ac", "ab", "a", "b", "c"}
    found = column(spark, [(d,) for d in range(4)], "d int", text.confidence(F.col("d"), F.lit(1000)))
    assert [round(x, 4) for (x,) in found] == [1.0, 0.98, 0.83, 0.0]


def test_text_values(spark):
    assert column(spark, [("  Heeello, WORLD!! ",)], "t string", text.normalized(F.col("t"))) == [("heello world",)]
    sizes = column(spark, [(0,), (-100,), (512,), (1536,), (2 * 1024**2,), (1024**3 * 3 // 2,)], "n long", text.format_bytes(F.col("n")))
    assert [s for (s,) in sizes] == ["0 B", "0 B", "512 B", "1.5 KB", "2 MB", "1.5 GB"]
    assert column(spark, [(0,), (1704067200,)], "n long", text.format_date(F.col("n"))) == [("",), ("1 Jan 2024 12:00 AM",)]
    assert column(spark, [("mum's",), ("'s",)], "w string", text.strip_possessive(F.col("w"))) == [("mum",), ("'s",)]


def test_intents(spark):
    expected = {
        "mom": "portrait of a woman",
        "mom dad": "two people",
        "birthday at the beach": "birthday celebration at a beach",
        "family": "family photo",
        "show me beach": "portrait of a person at a beach",
        "red car": "",
        "Asha and Ravi": "two people",
        "me and mom dad": "group of people",
    }
    found = column(spark, [(q,) for q in expected], "q string", "q", intent.intent(F.col("q")))
    assert dict(found) == expected


def test_spelling(spark):
    asked = spark.createDataFrame([(0, "beech mum freind dads the with car sunset gpt4 of", -1)], "query_id long, text string, owner long")
    found = spell.correct_queries(asked, spell.dictionary(spark)).first()
    assert found.corrected == "beach mom friend dad me wife park sunset gpt4 of" and found.was_corrected


def test_resolution(spark):
    people = spark.createDataFrame([(1, "Asha", "mother", 5), (2, "Ravi", "father", 4), (3, "", "", 2)], "entity_id long, display_name string, relation string, sample_count int")
    asked = spark.createDataFrame([("ahsa",), ("my fathr",), ("mom",), ("me",)], "text string")
    assert {r.text: r.entity_id for r in resolve.resolve(asked, people).collect()} == {"ahsa": 1, "my fathr": 2}
    assert {r.text: r.entity_id for r in resolve.resolve(asked, people, empty_names=True).collect()}["me"] == 3


def test_spans(spark):
    rows = [("my big brother and Tom", "B-SELF I-RELATION I-RELATION O B-PERSON"), ("a b c", "I-X B-X I-Y"), ("a", "O")]
    found = column(spark, rows, "w string, x string", spans.decode(F.split("w", " "), F.split("x", " ")))
    assert [[tuple(s) for s in f[0]] for f in found] == [[("SELF", "my"), ("RELATION", "big brother"), ("PERSON", "Tom")], [("X", "a"), ("X", "b"), ("Y", "c")], []]


def test_burst(spark):
    times = [100, 120, 131, 145, 0, 0, 160]
    hits = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(times)], "query_id long, rank int, mtime_unix long")
    assert sorted(r["rank"] for r in burst.deburst(hits).collect()) == [1, 3, 5, 6]


def test_suppression(spark):
    rng = np.random.default_rng(2)

    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    rows = [[(float(rng.random()), i, *map(float, rng.uniform(1, 20, 4))) for i in range(12)] for _ in range(20)]
    found = column(spark, [(r,) for r in rows], "b array<struct<conf:double,i:int,x:double,y:double,w:double,h:double>>", F.transform(boxes.suppressed(F.col("b")), lambda x: x["i"]))
    for r, (kept,) in zip(rows, found, strict=True):
        expected = []
        for b in sorted(r, key=lambda b: (-b[0], b[1])):
            if all(iou(b[2:], k[2:]) <= 0.4 for k in expected):
                expected.append(b)
        assert kept == [b[1] for b in expected]


def unit(rng, n, d=4):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_leader_clustering_and_merging(spark):
    x = unit(np.random.default_rng(4), 60).astype(np.float32)
    rows = [(i, v.tolist(), 0.4 if i % 9 == 0 else 0.9) for i, v in enumerate(x)]
    faces = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(3)
    found = {r.vec_id: r.entity_id for r in vectors.cluster_online(faces).collect()}
    centroids, expected = [], {}
    for i, v, score in rows:
        d = [float(np.linalg.norm(np.array(c) - v)) for c in centroids]
        if d and min(d) <= (0.75 if score < 0.5 else 0.6):
            k = d.index(min(d))
            c = 0.9 * centroids[k] + 0.1 * np.array(v)
            centroids[k], expected[i] = c / np.linalg.norm(c), k + 1
        elif score < 0.5:
            expected[i] = None
        else:
            centroids.append(np.array(v))
            expected[i] = len(centroids)
    assert found == expected
    merged = vectors.absorb([(1, [1.0, 0.0], 5), (2, [0.8, 0.6], 3), (3, [0.0, 1.0], 1)], 1.0)
    assert merged == [(2, 1)]


def test_knn_join_and_pairs(spark):
    x = unit(np.random.default_rng(5), 80)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1.0]), (101, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 9)], "query_id long, embedding array<double>")
    found = vectors.knn_join(table, asked, 5).collect()
    for q in (3, 9):
        d = np.linalg.norm(x - x[q], axis=1)
        assert [r.vec_id for r in sorted(found, key=lambda r: (r.distance, r.vec_id)) if r.query_id == q] == np.lexsort((np.arange(80), d))[:5].tolist()
    near = vectors.similar_pairs(table.filter("vec_id < 80"), 0.5, block_rows=20).collect()
    assert sorted((r.a, r.b) for r in near) == [(i, j) for i in range(80) for j in range(i + 1, 80) if np.linalg.norm(x[i] - x[j]) <= 0.5]


def test_catalogue(spark):
    old = spark.createDataFrame([(1, "/a", "picture", "pending")], "id long, abs_path string, filetype string, status string")
    new = spark.createDataFrame([(2, "/a", "picture", "pending"), (3, "/b", "picture", "pending"), (4, "/b", "video", "pending"), (5, "/c", "song", "pending")], old.schema)
    assert sorted(r.id for r in catalog.insert_ignore(old, new).collect()) == [1, 3]
    assert catalog.set_status(old, spark.createDataFrame([(1, "failed"), (9, "failed")], "id long, status string")).first().status == "failed"
    assert catalog.as_json(old.select("id", "abs_path"), ["id"]).first().json == '[{"id":1,"abs_path":"/a"}]'


def test_detections_get_ids(spark):
    from facetgraph import schemas

    found = spark.createDataFrame([(f, float(k), 1.9, 5.0, 5.0, 0.9, None) for f in range(30) for k in range(f % 4)], "file_id long, x double, y double, w double, h double, conf double, crop_path string")
    once = catalog.append_detections(schemas.empty(spark, "face_detections"), found, 7)
    assert sorted(r.id for r in once.collect()) == list(range(1, found.count() + 1))
    again = catalog.append_detections(once, found.limit(3), 8)
    assert again.count() == found.count() + 3 and {r.bbox_y for r in again.collect()} == {1}


def test_alignment():
    from facetgraph.functions import pixels

    turn = np.array([[0.8, -0.6], [0.6, 0.8]])
    points = (np.array(pixels.FACE_POINTS) @ turn.T) * 2 + [205, 109]
    m = pixels.alignment(points)
    assert np.allclose(points @ m[:, :2].T + m[:, 2], pixels.FACE_POINTS)
    flat = np.full((600, 600, 3), 51.0)
    assert np.allclose(pixels.aligned(flat, points)[40:60, 40:60], 51)
    assert np.allclose(pixels.model_input(flat)[0], (0.2 - pixels.MEAN[0]) / pixels.DEVIATION[0])


def test_media_types(spark):
    rows = [("/x/A.JPG", "text/plain"), (None, "image/png"), ("/x/a.xyz", "audio/ogg"), ("/x/noext", "font/ttf"), ("", "video/mp4")]
    found = column(spark, rows, "p string, m string", media.media_type(F.col("p"), F.col("m")))
    assert [f for (f,) in found] == ["image", "image", "audio", None, "video"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=20))
def test_word_tokenizer(t):
    ranks = {("a", "b"): 0, ("ab", "a</w>"): 1, ("a", "a"): 2}
    vocabulary = {"a": 1, "b": 2, "a</w>": 3, "b</w>": 4, "ab": 5, "aba</w>": 6}
    ids = tokenizers.encode_words(t, vocabulary, ranks)
    assert len(ids) == 77 and ids[0] == tokenizers.BEGIN and tokenizers.END in ids


def test_word_pieces():
    vocabulary = {x: i for i, x in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##s", "my", "!"])}
    assert tokenizers.word_pieces("playing", vocabulary) == ["play", "##ing"]
    assert tokenizers.word_pieces("playx", vocabulary) == ["play", "[UNK]"]
    found = tokenizers.encode_pieces("My plays!", vocabulary, 8)
    assert found["ids"] == [2, 7, 4, 6, 8, 3, 0, 0] and found["word_ids"][:6] == [-1, 0, 1, 1, 2, -1]


@pytest.mark.parametrize("name", ["knn_global_l2", "best_face_crop", "deburst_rank", "bio_spans", "scan_filter", "format_bytes", "intent_caption"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    as_rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).values.tolist()))
    assert as_rows(a) == as_rows(b)
