"""Tables in the shared checkpoint folder: they cut lineage, survive a lost executor and free shuffle files early."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table (some 16 bytes each) up to which it may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: Rows of nodes for each shuffle partition at least, where dealt() says how many there are. Pairs and grid cells are some nine rows a node.
PARTITION_ROWS = 16384
_PARTITIONS = "spark.sql.shuffle.partitions"

#: Bytes of a batch that goes to a Python worker, about. Batches of long texts have fewer rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one is made only in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_open: list[Store] = []


class Store:
    """Written tables of one operator call. cut() writes and rereads one; free() deletes those no longer read; close() deletes all.

    A result may still read tables of its store, so whoever has written or collected it closes the store, or all stores with close_all(). In the
    session, batches for Python workers are bounded in bytes unless it sets a smaller bound itself.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        _open.append(self)

    def cut(self, df: DataFrame, name: str, mode: str = "errorifexists", partition_by: str | None = None) -> DataFrame:
        path = self.paths.setdefault(name, f"{self.root}/{name}")
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer = df.write.mode(mode)
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        gc.collect()
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def dealt(self, rows: int) -> Iterator[None]:
        """What is written inside has a shuffle partition for each PARTITION_ROWS of so many rows at least; adaptive execution joins the small ones.

        Else a session's few partitions hold so much each that executors grow to all the memory they may have.
        """
        before = self.spark.conf.get(_PARTITIONS)
        self.spark.conf.set(_PARTITIONS, max(int(before), -(-rows // PARTITION_ROWS)))
        try:
            yield
        finally:
            self.spark.conf.set(_PARTITIONS, before)

    def free(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self.paths.clear()
        delete(self.spark, self.root)
        if self in _open:
            _open.remove(self)


def close_all() -> None:
    """Deletes the tables of all stores: after the results of queries have been written or collected."""
    for store in list(_open):
        store.close()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """keys, marked for broadcast if a count shows that it is at most so many narrow rows; else left to a shuffled join."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def id_key(column: str = "doc_id"):
    """An id as long; rows without one share the largest, and so come last in any order."""
    return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))


def doc_key(column: str = "doc_id", text: str = "text"):
    """An id as long that tells documents apart; for rows without one, a hash of the text."""
    return F.coalesce(F.col(column).cast("long"), F.xxhash64(F.col(text).cast("string")))
