"""The durable command log: one committed Parquet folder for each append, named by its first and last seq.

A folder becomes visible with its rename, so a torn append is never seen. Reading stops before the first
folder that does not follow on, and in a folder before the first row with a bad checksum.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.mapping import COMPRESSION
from quillon.operators.commands import COMMANDS, sound_prefix, with_crc
from quillon.sources.files import Files

SEGMENT = re.compile(r"segment-(\d{20})-(\d{20})$")
STORED = COMMANDS + ", crc long"


class CommandLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, f"{root}/_log", Files(spark)
        self.files.mkdirs(self.root)

    def segments(self) -> list[tuple[int, int, str]]:
        """(first, last, path) of the segments that follow on from the first; later ones don't count."""
        found = [(int(m[1]), int(m[2]), f"{self.root}/{m[0]}") for n in self.files.names(self.root) if (m := SEGMENT.match(n))]
        out: list[tuple[int, int, str]] = []
        for first, last, path in sorted(found, key=lambda x: (x[0], -x[1])):
            if out and last <= out[-1][1]:  # part of a merged one
                continue
            if out and first != out[-1][1] + 1:
                break
            out.append((first, last, path))
        return out

    def last_seq(self) -> int:
        own = self.segments()
        return own[-1][1] if own else 0

    def append(self, commands: DataFrame, first: int, last: int) -> None:
        """Commands first .. last, after all others. ValueError for a gap: contiguity is a rule here, not a hope."""
        own = self.segments()
        if own and first != own[-1][1] + 1 or last < first:
            raise ValueError(f"commands {first} to {last} don't follow on {own[-1][1] if own else 0}")
        tmp = f"{self.root}/.tmp-{uuid.uuid4().hex}"
        with_crc(commands).write.option("compression", COMPRESSION).parquet(tmp)
        self.files.move(tmp, f"{self.root}/segment-{first:020d}-{last:020d}")

    def read(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """start <= seq < stop; only segments that can hold such rows are opened."""
        paths = [p for a, b, p in self.segments() if b >= start and (stop is None or a < stop)]
        if not paths:
            return self.spark.createDataFrame([], COMMANDS)
        rows = sound_prefix(self.spark.read.schema(STORED).parquet(*paths))
        rows = rows.where(F.col("seq") >= start)
        return rows if stop is None else rows.where(F.col("seq") < stop)

    def purge(self, upto: int) -> None:
        """Drop segments that end at or below upto; one that reaches beyond stays, its rows hidden by the reader's start."""
        for _, last, path in self.segments():
            if last <= upto:
                self.files.delete(path)

    def truncate(self, start: int) -> None:
        """Drop all commands from start on."""
        for first, last, path in reversed(self.segments()):
            if first >= start:
                self.files.delete(path)
            elif last >= start:
                kept = self.spark.read.schema(STORED).parquet(path).where(F.col("seq") < start)
                tmp = f"{self.root}/.tmp-{uuid.uuid4().hex}"
                kept.write.parquet(tmp)
                self.files.move(tmp, f"{self.root}/segment-{first:020d}-{start - 1:020d}")
                self.files.delete(path)

    def merge(self) -> None:
        """All segments as one. A crash before the last step leaves a segment that starts where others do; the longest counts."""
        own = self.segments()
        if len(own) < 2:
            return
        first, last = own[0][0], own[-1][1]
        tmp = f"{self.root}/.tmp-{uuid.uuid4().hex}"
        self.spark.read.schema(STORED).parquet(*[p for _, _, p in own]).repartitionByRange("seq").write.parquet(tmp)
        self.files.move(tmp, f"{self.root}/segment-{first:020d}-{last:020d}")
        for _, _, path in own:
            self.files.delete(path)
