"""Small files and folders through Hadoop's FileSystem, so a catalog may lie wherever Spark reads and writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which the driver and all executors see.

    Where that is unset, a local session gets a temporary folder, removed at exit; a cluster has no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """All or nothing: a file of another name first, then a rename over the old one."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        other = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(other, True)
        try:
            stream.write(bytearray(text.encode()))
            if hasattr(stream, "hsync"):
                stream.hsync()
        finally:
            stream.close()
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
        options[0] = option.OVERWRITE
        context.rename(other, p, options)

    def move(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        q = self.jvm.org.apache.hadoop.fs.Path(new)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"{old} can't be moved to {new}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
