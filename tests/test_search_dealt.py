"""What a search reads of large tables: names are compared once each and dealt out, pairs and memberships are of the entities asked for alone."""

from dataclasses import replace

from test_engine import load_embedder, load_tagger, tables  # noqa: F401 (a fixture)

from facetgraph.operators import resolve, spell
from facetgraph.plans import search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_compared_once_each_and_dealt_out(spark):
    rows = [(5, "Asha", "sister", 3), (4, "Asha", "sister", 3), (3, "asha", "sister", 2), (2, "Asha", "sister", None), (7, "Ravi", "sister", 9), (8, "Mina", "aunt", None), (6, "Mina", "aunt", None)]
    people = spark.createDataFrame(rows, "entity_id long, display_name string, relation string, sample_count int")
    asked = spark.createDataFrame([("asha",), ("sistr",), ("mina",), ("nobody at all",)], "text string")
    found = resolve.resolve(asked, people)
    assert sorted(map(tuple, found.collect())) == [("asha", 4, 0), ("mina", 6, 0), ("sistr", 7, 1)]
    assert "RepartitionByExpression [name" in plan(found)


def test_terms_are_dealt_out(spark):
    words = spark.createDataFrame([("sunet",)], "word string")
    assert "RepartitionByExpression [term" in plan(spell.corrections(words, spell.dictionary(spark)))


def test_a_search_without_a_pair_table(spark, tables):  # noqa: F811
    asked = spark.createDataFrame([(0, "Asha Ravi", -1), (1, "Asha beach", -1), (2, "me Ravi", 3), (3, "zebra temple", -1)], "query_id long, text string, owner_entity_id long")
    options = search.Options(spelling=False, intent=False)
    hits = lambda t: sorted(map(tuple, search.search(asked, t, load_embedder, load_tagger, options).collect()))
    assert hits(replace(tables, pair_files=None)) == hits(tables) != []


def test_other_entities_go_before_memberships_are_grouped(spark, tables):  # noqa: F811
    asked = spark.createDataFrame([(0, [1, 2])], "query_id long, ids array<bigint>")
    grouped = tables.members.groupBy("entity_id", "file_id").max("score").withColumnRenamed("max(score)", "score")
    found = search.common_files(asked, grouped, tables.pair_files)
    assert sorted(r.file_id for r in found.collect()) == [10, 11, 13]
    lines = plan(found).splitlines()
    semi = next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    assert any("Aggregate [entity_id" in x and "file_id" in x for x in lines[:semi])
