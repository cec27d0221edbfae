"""Stages of the pipeline on rows that doc_id alone doesn't tell apart: null ids, and one id with several texts."""

import random

import pytest

import corpus_pipeline

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KINDS)


def by_row(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def expected(rows):
    return sorted((i is None, i or 0, t or "") for i, t in rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [" ".join("".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 8))) for _ in range(120)) + " end." for _ in range(8)]


def test_near_duplicates_leave_one_row_of_each_group(spark, texts):
    a, b, c, d, e, f, *_ = texts
    rows = [(None, a), (None, b), (1, c), (1, d), (1, d), (None, d), (None, e), (None, e), (2, e.upper()), (None, f), (None, f)]
    found = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "")
    assert found.columns == corpus_pipeline.COLUMNS
    assert by_row(found) == expected([(None, a), (None, b), (1, c), (1, d), (2, e.upper()), (None, f)])


def test_secrets_are_cut_from_the_row_that_holds_them(spark, texts):
    a, b, c, *_ = texts
    key = ' token = "0123456789abcdef0123456789abcdef" '
    rows = [(1, a), (1, b + key), (1, key + c), (None, a), (None, c[:50] + key + c[50:]), (None, key + b), (None, None), (2, key)]
    found = by_row(corpus_pipeline.redact_secrets(spark, table(spark, rows), ""))
    assert found == expected([(i, t and t.replace('token = "0123456789abcdef0123456789abcdef', "[secret]")) for i, t in rows])


def test_rejected_rows_go_beside_kept_ones_of_the_same_id(spark, texts):
    a, b, c, d, *_ = texts
    bad = "again and again " * 40
    rows = [(None, a), (None, bad), (None, None), (1, b), (1, bad), (1, "too short"), (2, c), (2, c), (3, bad), (None, d)]
    found = corpus_pipeline.keep_good(spark, table(spark, rows), "")
    assert found.columns == corpus_pipeline.COLUMNS
    assert by_row(found) == expected([(None, a), (1, b), (2, c), (2, c), (None, d)])


def test_contaminated_rows_go_beside_clean_ones_of_the_same_id(spark, texts, tmp_path):
    a, b, c, *_ = texts
    passage = " ".join(c.split()[:30])
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, b + " " + passage), (1, b), (1, passage), (None, None)]
    found = corpus_pipeline.drop_contaminated(spark, table(spark, rows), f"file://{tmp_path}")
    assert by_row(found) == expected([(None, a), (1, b), (None, None)])


def test_few_texts_are_shuffled(spark, texts, tmp_path):
    spark.createDataFrame([(1, texts[0])], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = table(spark, [(i, t) for i, t in enumerate(texts)])
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.drop_contaminated, corpus_pipeline.redact_secrets):
        plan = stage(spark, docs, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan, stage.__name__


def test_many_findings_are_joined_by_shuffle(spark, texts, monkeypatch):
    rows = [(i, t + (" token = abcdef123456 " if i % 2 else "")) for i, t in enumerate(texts)]
    few = by_row(corpus_pipeline.redact_secrets(spark, table(spark, rows), ""))
    monkeypatch.setattr(corpus_pipeline, "SENT_BYTES", 0)
    assert by_row(corpus_pipeline.redact_secrets(spark, table(spark, rows), "")) == few


def test_repeated_rows_are_one_blob(spark, tmp_path):
    from facetgraph.llm import secrets

    rows = table(spark, [(1, "password: hunter22")] * 3 + [(2, "password: hunter22"), (None, "api_key=abcdefgh")] + [(None, None)] * 2)
    found = secrets.scan(rows, f"file://{tmp_path}/ledger").collect()
    assert len(found) == 7 and [len(r.findings) for r in sorted(found, key=str)].count(1) == 5
    ledger = spark.read.parquet(f"file://{tmp_path}/ledger")
    assert ledger.count() == ledger.select("blob").distinct().count() == 3


def test_a_task_of_decontamination_keeps_one_python_worker(spark, texts, tmp_path):
    spark.createDataFrame([(1, texts[0]), (2, "a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, texts[0]), (2, texts[1]), (None, texts[2])]
    found = corpus_pipeline.drop_contaminated(spark, table(spark, rows), str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert by_row(found) == expected(rows[1:])
