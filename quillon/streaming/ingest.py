"""Command streams folded into a versioned table by Structured Streaming.

Each micro-batch writes what is new as a segment and then replaces the manifest, which names the segments and
the batch that made the last; a batch that is run again after a crash is skipped, so each takes effect once. The
sequence number guards as well: commands at or below the committed one change nothing, late or repeated.
Segments are merged once what came after an older one is as large. Reading takes the last command of each
document over all segments.

A stream may hold several collections. One that is created or dropped in the stream holds, at any time, what
came after its last creation, and nothing once dropped; one that is neither is taken to have been there before.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.mapping import ID, SEQ, SOURCE, Mapping
from quillon.operators.commands import collections_after, latest
from quillon.operators.documents import with_reason
from quillon.sources.files import Files

STATE = f"collection string, {ID} string, {SEQ} long, op string, {SOURCE} string"


class StreamedTable:
    """The latest state of the collections of a command stream, under a folder of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def manifest(self) -> dict:
        path = f"{self.root}/manifest.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {"batch": -1, "seq": 0, "segments": [], "ddl": []}

    def _rows(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.root}/segment-{s['n']}" for s in segments]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("collection", ID).agg(F.max_by(F.struct(SEQ, "op", SOURCE), SEQ).alias("last"))
        return last.select("collection", ID, f"last.{SEQ}", "last.op", f"last.{SOURCE}")

    def read(self, collection: str | None = None) -> DataFrame:
        """collection, _id, _source, _seq of the live documents, or of one collection's."""
        m = self.manifest()
        rows = self._last(self._rows(m["segments"])) if len(m["segments"]) > 1 else self._rows(m["segments"])
        rows = rows.where("op = 'index'")
        if m["ddl"]:
            ddl = self.spark.createDataFrame([tuple(r) for r in m["ddl"]], "seq long, op string, collection string, uuid string, mapping string")
            known = ddl.select("collection", F.lit(True).alias("known")).distinct()
            alive = collections_after(ddl).select("collection", "created_seq")
            rows = rows.join(F.broadcast(known), "collection", "left").join(F.broadcast(alive), "collection", "left")
            rows = rows.where(F.col("known").isNull() | (F.col(SEQ) > F.col("created_seq")))
        rows = rows.select("collection", ID, SOURCE, SEQ)
        return rows if collection is None else rows.where(F.col("collection") == collection)

    def apply(self, batch: DataFrame, number: int) -> None:
        m = self.manifest()
        if number <= m["batch"]:
            return
        news = batch.where(F.col("seq") > m["seq"])
        top = news.agg(F.max("seq")).first()[0]
        new = m | {"batch": number}
        if top is not None:
            new["seq"] = top
            ddl = news.where(F.col("op").isin("create", "drop")).select("seq", "op", "collection", "uuid", "mapping").orderBy("seq").collect()
            new["ddl"] = m["ddl"] + [list(r) for r in ddl]  # as few as there are collections ever made
            new["segments"] = [*m["segments"], self._segment(m, latest(news))]
            sizes = [s["rows"] for s in new["segments"]]
            for i, own in enumerate(sizes[:-1]):
                if own <= sum(sizes[i + 1 :]):
                    rows = self._last(self._rows(new["segments"][i:]))
                    new["segments"] = [*new["segments"][:i], self._segment(new, rows if i else rows.where("op = 'index'"))]
                    break
        self.files.write(f"{self.root}/manifest.json", json.dumps(new))
        keep = {f"segment-{s['n']}" for s in m["segments"] + new["segments"]}  # a reader of the last version may still be at work
        for name in self.files.names(self.root):
            if name.startswith("segment-") and name not in keep:
                self.files.delete(f"{self.root}/{name}")

    def _segment(self, m: dict, rows: DataFrame) -> dict:
        n = max((s["n"] for s in m["segments"]), default=0) + 1
        path = f"{self.root}/segment-{n}"
        self.files.delete(path)  # of a batch that did not get to the manifest
        rows.select("collection", ID, SEQ, "op", SOURCE).write.parquet(path)
        return {"n": n, "rows": self.spark.read.schema(STATE).parquet(path).count()}


def ingest(stream: DataFrame, table: StreamedTable, mapping: Mapping | None = None, once: bool = True) -> StreamingQuery:
    """Start folding a stream of commands (COMMANDS columns) into the table; once: all there is now, then stop.

    With a mapping, index commands of invalid documents are dropped before they are folded.
    """

    def step(batch: DataFrame, number: int) -> None:
        if mapping is not None:
            batch = with_reason(batch, mapping, "source").where("op <> 'index' or reason is null").drop("reason")
        table.apply(batch, number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{table.root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
