"""Tables written once between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a temporary folder;
    on a cluster that is an error, as executors wouldn't see such a folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="facetgraph-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: What this driver has written to the shared folder.
_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append(path)
    return path


def _remove_written() -> None:
    jvm = SparkContext._jvm
    for path in _WRITTEN if jvm is not None else []:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except Exception:  # the session may be gone already; what is left lies in the folder for temporary files
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what several steps use is computed once, and a lost executor costs no lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task takes, about, where a table is dealt by its size.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Parts that so many rows are dealt to: as many as the session's shuffles have, and more where a part would have more than each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
