"""States of a stream in their order: finished, failed, paused and gone on with."""

import time
from functools import partial

import pytest

from facetgraph import models
from facetgraph.plans.api import Engine
from facetgraph.streaming.progress import Progress


def wait(what):
    end = time.time() + 60
    while not what():
        assert time.time() < end
        time.sleep(0.05)


@pytest.fixture
def heard(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/c", partial(models.hash_embedder, 8))
    listener = Progress(engine, "indexing")
    spark.streams.addListener(listener)
    spark.range(12).repartition(3).write.parquet(f"file://{tmp_path}/in")
    yield engine, listener, f"file://{tmp_path}"
    spark.streams.removeListener(listener)


def start(spark, at, sink, name="indexing"):
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return stream.writeStream.queryName(name).foreachBatch(sink).option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()


def test_states_in_order(spark, heard):
    engine, progress, at = heard
    assert engine.get_index_progress().first().status == "idle"
    start(spark, at, lambda batch, n: batch.count(), "another").awaitTermination()
    start(spark, at, lambda batch, n: batch.count()).awaitTermination()
    wait(lambda: engine.state == "finished")
    assert [s for s, _ in progress.seen] == ["idle", "loading_models", "processing", "processing", "processing", "finished"] and progress.rows == 12
    assert engine.get_index_progress().first().status == "finished"


def test_failure_and_pause(spark, heard):
    engine, progress, at = heard

    def failing(batch, n):
        if n == 1:
            raise OSError("no model")
        batch.count()

    with pytest.raises(Exception, match="no model"):
        start(spark, at, failing).awaitTermination()
    wait(lambda: engine.state == "failed")
    slow = start(spark, at, lambda batch, n: (batch.count(), time.sleep(5 if n == 2 else 0)))
    wait(lambda: engine.state == "processing")
    progress.pause(slow)
    wait(lambda: engine.state == "paused")
    start(spark, at, lambda batch, n: batch.count()).awaitTermination()
    wait(lambda: engine.state == "finished")
    states = [s for s, _ in progress.seen]
    assert [s for i, s in enumerate(states) if i == 0 or states[i - 1] != s] == ["idle", "loading_models", "processing", "failed", "loading_models", "processing", "paused", "loading_models", "processing", "finished"]
