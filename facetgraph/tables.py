"""The catalogue's tables: a base and a log of changed rows, both in buckets of the key, merged when read.

A change writes the changed rows alone, and what asks for some keys reads their buckets alone, so the cost of a batch is that
of its rows. Every write makes a pointer with the next number, which one writer can claim, so readers always see a
whole table. When the log has many layers they are made one; when it has grown to a share of the base, both become a new base.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import KEYS, SCHEMAS, empty, ensure_columns

#: Buckets of a table, layers of a log before they are made one, and the base's rows for each of the log's that make a new base.
BUCKETS, LAYERS, SHARE = 256, 16, 4
#: Changed rows whose keys are broadcast when read: 16 MB at most. More are joined as Spark chooses.
SENT = 1_000_000


def bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(BUCKETS)).cast("int")


class Catalogue:
    """Tables of one folder. Where there is none yet, reads return empty tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._step = spark, path.rstrip("/"), None
        # the folders of all buckets are listed by the driver, not by a job
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", str(4 * BUCKETS))

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(conf)

    def _pointers(self, name: str) -> list[str]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_pointers")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self, name: str) -> int:
        """The number of the newest change, -1 before the first."""
        return max((int(x.split("-")[0]) for x in self._pointers(name)), default=-1)

    def _layers(self, name: str) -> list[tuple[str, int, str]]:
        """(kind, rows, folder) of the newest base and the layers of the log after it, a log that sums up before the changes after it."""
        found: list[tuple[str, int, str]] = []
        for pointer in self._pointers(name):
            if "-" in pointer:
                kind, rows, folder = pointer.split("-", 1)[1].split(".")[:3]
                found = [] if kind == "base" else found[:1] if kind == "log" else found
                found.append((kind, int(rows), f"{self.path}/{name}/{folder}"))
        return found

    def _write(self, name: str, kind: str, rows: DataFrame, at: int | None, tag: str | None = None) -> None:
        """A new layer; its pointer is made last.

        The pointer's number is that after at, or after the newest one when writing begins, and is
        claimed by a file that one writer alone can make: of two that began from the
        same state, the second gets an error and nothing is lost unseen.
        """
        jvm, fs = self._fs()
        file = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_pointers/{x}")
        number, folder = f"{1 + (self.version(name) if at is None else at):012d}", uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", bucket(name))
        (dealt.repartition("_bucket") if kind == "base" else dealt).write.partitionBy("_bucket").parquet(f"{self.path}/{name}/{folder}")
        count = self._read(name, f"{self.path}/{name}/{folder}", kind).count()
        try:
            fs.create(file(number), False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"{name} was changed meanwhile: read it again and repeat the change") from e
        fs.create(file(f"{number}-{kind}.{count}.{folder}" + ("" if tag is None else f".{tag}")), False).close()

    def _read(self, name: str, folder: str, kind: str) -> DataFrame:
        more = "" if kind == "base" else ", _deleted boolean"
        return self.spark.read.schema(f"{SCHEMAS[name]}{more}, _bucket int").parquet(folder)

    def _log(self, name: str, layers: list[tuple[str, int, str]], within: Column) -> DataFrame:
        """The newest state of each key of the log."""
        keys, parts = KEYS[name], [self._read(name, folder, kind).filter(within).drop("_bucket").withColumn("_nth", F.lit(i)) for i, (kind, _, folder) in enumerate(layers)]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        if len(parts) == 1:
            return whole.drop("_nth")
        rest = [c for c in whole.columns if c not in keys and c != "_nth"]
        return whole.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_nth").alias("_new")).select(*keys, "_new.*")

    def _merged(self, name: str, within: Column) -> DataFrame:
        found = self._layers(name)
        if not found:
            return empty(self.spark, name)
        base = self._read(name, found[0][2], "base").filter(within).drop("_bucket")
        if len(found) == 1:
            return ensure_columns(base, name)
        log, changed = self._log(name, found[1:], within), sum(n for _, n, _ in found[1:])
        keys = log.select(*KEYS[name])
        kept = base.join(F.broadcast(keys) if changed <= SENT else keys, KEYS[name], "left_anti")
        return ensure_columns(kept, name).unionByName(ensure_columns(log.filter("NOT _deleted"), name))

    def table(self, name: str) -> DataFrame:
        """The whole table."""
        return self._merged(name, F.lit(True))

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The table's rows of keys (its key columns); only their buckets are read."""
        own = keys.select(*KEYS[name]).distinct()
        wanted = [r[0] for r in own.select(bucket(name)).distinct().collect()]  # at most BUCKETS
        return self._merged(name, F.col("_bucket").isin(wanted)).join(own, KEYS[name], "left_semi") if wanted else empty(self.spark, name)

    @contextmanager
    def once(self, tag: str) -> Iterator[None]:
        """Changes in here are numbered under tag; when they are made again after a failure, those that were written are skipped, whatever came of the others."""
        self._step = (tag, 0)
        try:
            yield
        finally:
            self._step = None

    def replace(self, name: str, rows: DataFrame, at: int | None = None) -> None:
        """rows as the whole table. at: the version that they were made of, if another must not have come in between."""
        self._write(name, "base", ensure_columns(rows, name), at)

    def save(self, name: str, rows: DataFrame | None, gone: DataFrame | None = None, at: int | None = None) -> None:
        """rows, one for each key, in place of those of the same key or beside the others; the keys of gone are deleted.

        Within once(), a change that was made before is left out.
        """
        tag = None
        if self._step is not None:
            tag, self._step = f"{self._step[0]}_{self._step[1]}", (self._step[0], self._step[1] + 1)
            if any(x.endswith(f".{tag}") for x in self._pointers(name)):
                return
        if not self._layers(name):
            self._write(name, "base", empty(self.spark, name) if rows is None else ensure_columns(rows, name), at, tag)
            return
        parts = [] if rows is None else [ensure_columns(rows, name).withColumn("_deleted", F.lit(False))]
        if gone is not None:
            parts.append(ensure_columns(gone.select(*KEYS[name]).distinct(), name).withColumn("_deleted", F.lit(True)))
        self._write(name, "change", parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), at, tag)
        found = self._layers(name)
        if len(found) <= LAYERS:
            return
        if SHARE * sum(n for _, n, _ in found[1:]) > found[0][1]:
            self._write(name, "base", self.table(name), self.version(name))
        else:
            self._write(name, "log", self._log(name, found[1:], F.lit(True)), self.version(name))
