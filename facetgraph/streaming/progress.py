"""The states of an indexing stream, from Spark's own events, as the progress of the engine shows them."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.api import Engine


class Progress(StreamingQueryListener):
    """Keeps engine.state with the queries of one name: models load until the first rows are through, then files are processed, until the run is
    finished, paused (stop was asked for) or failed. Every state that was entered, with the rows taken in so far, stays in seen.

    Add it with spark.streams.addListener before the query starts; events come some time after what they tell of.
    """

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name
        self.run, self.rows, self.stopping = None, 0, False
        self.seen: list[tuple[str, int]] = [("idle", 0)]

    def _enter(self, state: str) -> None:
        self.engine.state = state
        if self.seen[-1] != (state, self.rows):
            self.seen.append((state, self.rows))

    def pause(self, query: StreamingQuery) -> None:
        """Stop the query after what it is doing; the same checkpoint goes on with what is left."""
        self.stopping = True
        query.stop()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run, self.rows, self.stopping = event.runId, 0, False
            self._enter("loading_models")

    def onQueryProgress(self, event) -> None:
        if event.progress.runId == self.run and event.progress.numInputRows > 0:
            self.rows += event.progress.numInputRows
            self._enter("processing")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            # a batch that was broken off by stopping ends with an exception, too
            self._enter("paused" if self.stopping else "failed" if event.exception else "finished")
