"""Helpers shared by the training-data operators: shared storage, Arrow slicing, broadcast files."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import Files

#: Text bytes that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder, removed at exit; a cluster has no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is there goes at the session's end, or before by discard()."""
    path = f"{shared_root(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_discard_all, Files(spark))
    _made.append(path)
    return path


def made() -> int:
    """A mark for discard()."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete what was put into the shared folder since a mark, but for the last `keep` paths: results that nothing reads any more."""
    old = _made[since : len(_made) - keep]
    files = Files(spark)
    for path in old:
        files.delete(path)
    del _made[since : len(_made) - keep]


def _discard_all(files: Files) -> None:
    for path in _made:
        try:
            files.delete(path)
        except (Py4JError, OSError):  # the session's JVM has gone already
            return


def materialize(df: DataFrame, label: str, large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    large: its shuffle files are worth waiting for their removal, before the next step writes its own.
    """
    spark, path, schema = df.sparkSession, shared_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    del df  # its plan holds on to its shuffle files
    if large:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs; they'd else stay until the driver's next collection.

    The first round ends the plans that Python held, the second what those plans held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df; only where it has none (data of the session) a job counts text bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    texts = [c for c, kind in df.dtypes if kind == "string"]
    per_row = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8))
    return int(df.agg(F.sum(per_row)).first()[0] or 0)


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions so that one holds about bytes_each of df's input, and no fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, -(-input_bytes(df) // bytes_each)))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, share: int = 500, parts: int = 64) -> DataFrame:
    """rows joined to table, which has one row a key and, in column copies, how many of rows have it.

    Keys of over 1 in `share` of all rows (so fewer than `share` keys, which are broadcast) are dealt over `parts`
    tasks by column `by`; the result has no column copies.
    """
    total = table.agg(F.sum("copies")).first()[0] or 0
    hot = table.where(F.col("copies") > total // share + 1000).select(key, F.lit(parts).alias("__parts"))
    if total <= 1000 or hot.isEmpty():
        return rows.join(table.drop("copies"), key)
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - F.lit(1).cast("long")))
    table = table.drop("copies").join(hot, key, "left").withColumn("__salt", salts).drop("__parts")
    return dealt.join(table, [key, "__salt"]).drop("__salt")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on between tasks, and would hold it beside the next step's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library's own, where it has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about `most` bytes of text each (one text at least), and the texts as bytes."""
    give_back()
    for batch in batches:
        texts = text_bytes(batch.column(text))
        start = size = 0
        for i, x in enumerate(texts):
            if size and size + len(x) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(x)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
        del batch, texts
    give_back()


class TwoGenerations(dict):
    """A bounded cache: entries not used through a whole generation go. Look up with find()."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """The keys that neither generation has; those of the older one move to the younger."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        absent, old = [], self.old
        for k in keys - self.keys():
            if (v := old.get(k)) is None:
                absent.append(k)
            else:
                self[k] = v
        return absent
