"""People of faces that keep coming: the state of each owner's library lies in the state store, its tables follow.

Centroids and counts are carried from batch to batch as in a run over all files, so a stream and a run give the same
tables. A batch that is tried again after a failure finds the old state and skips the changes that it made before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.vectors import lead
from ..plans.api import Engine
from ..schemas import SCHEMAS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the stream brings of each face, its detection and its vector, and what comes out: faces with their people, and centroids (null id).
FACE = f"owner bigint, {SCHEMAS['face_detections']}, embedding array<float>"
FOUND = f"{FACE}, samples bigint"


class Library(StatefulProcessor):
    """Leader clustering of one owner's faces in the order of their files, going on from the people in the state."""

    def __init__(self, near: float, loose: float):
        self.near, self.loose = near, loose

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.people = handle.getMapState("people", "entity_id bigint", "embedding array<double>, samples bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.people.updateValue((int(r.entity_id),), ([float(x) for x in r.embedding], int(r.samples)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        faces = pd.concat(list(rows)).sort_values(["file_id", "id"])
        known = {k[0]: (list(v[0]), v[1]) for k, v in self.people.iterator()}
        given = [(i, None if v is None else list(v), 1.0 if pd.isna(s) else s) for i, v, s in zip(faces["id"], faces["embedding"], faces["det_score"], strict=True)]
        found, after = lead(given, sorted((e, v) for e, (v, _) in known.items()), self.near, self.loose)
        own = pd.Series([f[1] for f in found], dtype="Int64")
        counts, after = own.value_counts().to_dict(), dict(after)
        for e, n in counts.items():
            self.people.updateValue((int(e),), (after[e], known.get(e, (None, 0))[1] + int(n)))
        yield faces.assign(entity_id=own.to_numpy(dtype=object, na_value=None), samples=None)
        moved = pd.DataFrame({"owner": key[0], "entity_id": list(counts), "embedding": [after[e] for e in counts], "samples": [known.get(e, (None, 0))[1] + int(n) for e, n in counts.items()]})
        yield moved.reindex(columns=[c.split(" ")[0] for c in FOUND.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    def close(self) -> None:
        pass


def follow(faces: DataFrame, engine_of: Callable[[int], Engine], checkpoint: str, now: int = 0, people: DataFrame | None = None, near: float = 0.6, loose: float = 0.75) -> StreamingQuery:
    """Cluster a stream of FACE rows until nothing is left, and keep the tables of engine_of(owner) with it.

    people (owner, entity_id, embedding, samples): the state of a first start, such as the tables after people were
    merged; a query that goes on from its checkpoint has its own. A row of a null owner is left out. The owners of a micro-batch are
    gone through by the driver, as each has a catalogue; its rows aren't.
    """
    spark = faces.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    initial = None if people is None else people.select("owner", "entity_id", F.col("embedding").cast("array<double>").alias("embedding"), "samples").groupBy("owner")
    grouped = faces.filter(F.col("owner").isNotNull()).groupBy("owner")
    found = grouped.transformWithStateInPandas(Library(near, loose), FOUND, "Append", "None", initial)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for owner in [r[0] for r in batch.select("owner").distinct().collect()]:
                engine, own = engine_of(owner), batch.filter(F.col("owner") == owner)
                with engine.once(f"people_{number}"):
                    engine.take_in(own.filter("id IS NOT NULL"), own.filter("id IS NULL"), now)
        finally:
            batch.unpersist()

    return found.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
