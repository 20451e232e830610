"""The catalog: named collections, a durable log, checkpoints, recovery and snapshots.

Layout under a root folder:

    _log/segment-*            the command log
    <uuid>/segment-<n>/       documents of a collection: Parquet by id, with a bloom filter on it, typed columns, joined tokens
    <uuid>/gone-<n>/          ids of older segments that segment n replaces or deletes
    <uuid>/packed-<n>/        the terms of segment n's documents; each file holds those of some documents, by term
    _catalog.json             {applied_seq, collections: {name: {uuid, mapping, created_seq, version, committed_seq, segments}}}
    _lock                     the writer that opened the catalog last
    _snapshots/<id>/          a catalog file; the folders that it names stay as long as it is there
    _quarantine/<uuid>.<seq>  folders that no live collection owns

A write is durable once logged, and visible from the next checkpoint on: searches read the committed version,
which is the segments that the catalog file names, without the ids that later segments replace. A commit writes
what is new; segments are merged once what came after an older one is as large, so each document is rewritten
some log(n) times. The catalog file is replaced last and in one step, together with the data it names, so a
crash at any point leaves either the old state and the log, or the new one.

One driver writes at a time: opening a catalog for writing takes its lock, and a writer whose lock another has
taken can't write any more (WriterLost). Reading, with read_only, takes none.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import CollectionNotFound, RecoveryError, SchemaConflict, ValidationError, WriterLost
from quillon.mapping import COMPRESSION, ID, SEQ, SOURCE, Mapping, check_name
from quillon.operators import commands as C
from quillon.operators import search as S
from quillon.operators.documents import extract, from_stored, reason, to_stored, with_places, with_tokens
from quillon.sources.files import Files
from quillon.sources.log import CommandLog

UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
#: Logged commands after which write_if_due() makes a snapshot, and snapshots kept.
SNAPSHOT_EVERY, SNAPSHOTS = 1000, 2
#: How documents' files are written.
STORED = {"compression": COMPRESSION, f"parquet.bloom.filter.enabled#{ID}": "true"}
#: Segments of the log after which they are made one.
LOG_SEGMENTS = 64


class Catalog:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        """Open, and recover what the log holds beyond the last checkpoint."""
        self.spark, self.root, self.files, self.read_only = spark, root.rstrip("/"), Files(spark), read_only
        self.owner = uuid.uuid4().hex
        self.quarantined: list[str] = []
        if not read_only:
            self.files.mkdirs(self.root)
            self.files.write(f"{self.root}/_lock", self.owner)
        self.log = CommandLog(spark, self.root)
        self._load()
        if not read_only:
            self._recover()

    def _own(self) -> None:
        """Raise WriterLost unless this is the catalog's writer."""
        if self.read_only or self.files.read(f"{self.root}/_lock") != self.owner:
            raise WriterLost(self.root)

    # the catalog file

    @property
    def path(self) -> str:
        return f"{self.root}/_catalog.json"

    def _load(self) -> None:
        self.applied_seq, self.collections = 0, {}
        if self.files.exists(self.path):
            try:
                j = json.loads(self.files.read(self.path))
                self.applied_seq = int(j["applied_seq"])
                self.collections = {n: dict(c, mapping=Mapping.from_json(json.dumps(c["mapping"]))) for n, c in j["collections"].items()}
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                raise RecoveryError(f"the catalog file is damaged: {e}") from None
        self.seq = max(self.applied_seq, self.log.last_seq())

    def _store(self) -> None:
        self._own()
        own = {n: dict(c, mapping=json.loads(c["mapping"].to_json())) for n, c in self.collections.items()}
        self.files.write(self.path, json.dumps({"applied_seq": self.applied_seq, "collections": own}, sort_keys=True))

    # recovery

    def _recover(self) -> None:
        tail = self.log.read(self.applied_seq + 1)
        ddl = tail.where(F.col("op").isin("create", "drop")).orderBy("seq").collect()
        dropped = {r["collection"] for r in ddl if r["op"] == "drop"}
        for name, c in self.collections.items():
            if name not in dropped and not all(self.files.exists(self._at(c, n)) for n in self._named(c)):
                raise RecoveryError(f"the data of collection {name!r} are missing")
        replayed = self.log.last_seq() > self.applied_seq
        for r in ddl:
            if r["op"] == "create":
                self._install(r["collection"], r["uuid"], Mapping.from_json(r["mapping"]), r["seq"])
            else:
                self.collections.pop(r["collection"], None)
        self.quarantined = self.sweep()
        if replayed:
            self.checkpoint()

    def _install(self, name: str, uid: str, mapping: Mapping, seq: int) -> None:
        """An existing collection stands: replay never overwrites it."""
        self.collections.setdefault(name, {"uuid": uid, "mapping": mapping, "created_seq": seq, "version": 0, "committed_seq": 0, "segments": []})

    def sweep(self) -> list[str]:
        """Move folders of uuid names that no collection owns to _quarantine; their new names."""
        owned, moved = {c["uuid"] for c in self.collections.values()} | set(self._pinned()), []
        for n in self.files.names(self.root):
            if UUID.match(n) and n not in owned:
                self.files.move(f"{self.root}/{n}", f"{self.root}/_quarantine/{n}.{self.seq}")
                moved.append(f"{n}.{self.seq}")
        return moved

    # collections

    def _get(self, name: str) -> dict:
        if name not in self.collections:
            raise CollectionNotFound(name)
        return self.collections[name]

    def _append(self, rows: DataFrame, n: int = 1) -> None:
        self._own()
        self.log.append(rows, self.seq + 1, self.seq + n)
        self.seq += n

    def create(self, name: str, mapping: Mapping) -> bool:
        """Whether it was created; one of the same mapping stays as it is."""
        check_name(name)
        if name in self.collections:
            if self.collections[name]["mapping"] != mapping:
                raise SchemaConflict(name)
            return False
        row = C.create_command(self.spark, self.seq + 1, name, mapping)
        uid = row.first()["uuid"]
        self._append(C.one(self.spark, self.seq + 1, "create", name, uuid=uid, mapping=mapping.to_json()))
        self._install(name, uid, mapping, self.seq)
        return True

    def drop(self, name: str) -> None:
        c = self._get(name)
        self._append(C.drop_command(self.spark, self.seq + 1, name))
        del self.collections[name]
        if c["uuid"] not in self._pinned():
            self.files.delete(f"{self.root}/{c['uuid']}")

    def describe(self, name: str) -> Mapping:
        return self._get(name)["mapping"]

    def list(self) -> list[str]:
        return sorted(self.collections)

    def as_frame(self) -> DataFrame:
        rows = [(n, c["uuid"], c["mapping"].to_json(), c["created_seq"], c["version"], c["committed_seq"]) for n, c in sorted(self.collections.items())]
        return self.spark.createDataFrame(rows, "name string, uuid string, mapping string, created_seq long, version long, committed_seq long")

    # documents

    def upsert(self, name: str, source: str, doc_id: str | None = None) -> tuple[str, bool]:
        """(id, created); created is judged on the committed view."""
        why = reason(self._get(name)["mapping"], source)
        if why:
            raise ValidationError(why)
        doc_id = C.new_id() if doc_id is None else doc_id
        created = S.get(self.committed(name), doc_id).isEmpty()
        self._append(C.one(self.spark, self.seq + 1, "index", name, id=doc_id, source=source))
        return doc_id, created

    def _in_order(self, rows: DataFrame, stage: str) -> tuple[DataFrame, int]:
        """rows written to `stage` with order as 0, 1, 2, ...: a count by partition of the order, then its running sum; no single-task sort."""
        spread = rows.repartitionByRange("order").sortWithinPartitions("order").withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        spread.write.parquet(stage)
        spread = self.spark.read.parquet(stage)
        counts = {r["p"]: r["n"] for r in spread.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
        base, at = {}, 0
        for p in sorted(counts):
            base[p], at = at, at + counts[p]
        if not at:
            return spread.drop("p", "k"), 0
        start = self.spark.createDataFrame(list(base.items()), "p int, base long")
        return spread.join(F.broadcast(start), "p").withColumn("order", F.col("base") + F.col("k")).drop("p", "k", "base"), at

    def upsert_batch(self, name: str, rows: DataFrame) -> tuple[int, DataFrame]:
        """Log the valid of rows (order, id, source), in their order; (their number, the others with reason)."""
        mapping, schema = self._get(name)["mapping"], T.StructType([*rows.schema.fields, T.StructField("reason", T.StringType())])
        stage = f"{self.root}/_log/.stage-{uuid.uuid4().hex}"
        with_places(rows.withColumn("id", F.coalesce("id", F.uuid())), mapping, "source", "order").write.option("compression", COMPRESSION).parquet(stage)  # ids are made once
        checked = self.spark.read.parquet(stage)
        runs = checked.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("low"), F.max("order").alias("high")).collect()  # at most RUNS + 2 rows a partition
        valid = checked.where("reason is null")
        starts = C.run_starts([tuple(r) for r in runs if r["run"] is not None])
        if starts is None:
            ordered, n = self._in_order(valid.select("order", "id", "source"), f"{stage}-dense")
        else:
            n = sum(r["n"] for r in runs if r["run"] is not None)
            bases = F.broadcast(self.spark.createDataFrame(starts, "part int, run int, base long"))
            ordered = valid.join(bases, ["part", "run"]).select((F.col("base") + F.col("place")).alias("order"), "id", "source")
        if n:
            self._append(C.index_commands(ordered, name, self.seq + 1), n)
        refused = self.spark.createDataFrame([], schema)
        if any(r["run"] is None for r in runs):
            checked.where("reason is not null").select(*schema.names).write.parquet(f"{stage}-refused")
            refused = self.spark.read.parquet(f"{stage}-refused")
        self.files.delete(f"{stage}-dense")
        self.files.delete(stage)
        return n, refused

    def delete_batch(self, name: str, ids: DataFrame) -> DataFrame:
        """Log a deletion for each of ids (order, id), in their order; id, existed in the committed view of now."""
        self._get(name)
        stage = f"{self.root}/_log/.stage-{uuid.uuid4().hex}"
        C.existed_flags(self.committed(name), ids).write.parquet(f"{stage}-existed")
        ordered, n = self._in_order(ids.select("order", "id"), stage)
        if n:
            self._append(C.delete_commands(ordered, name, self.seq + 1), n)
        self.files.delete(stage)
        return self.spark.read.parquet(f"{stage}-existed")

    def delete(self, name: str, doc_id: str) -> bool:
        """Whether the committed view had it; logged in either case."""
        self._get(name)
        existed = not S.get(self.committed(name), doc_id).isEmpty()
        self._append(C.one(self.spark, self.seq + 1, "delete", name, id=doc_id))
        return existed

    def get(self, name: str, doc_id: str, fresh: bool = False) -> str:
        """The source. fresh: commit the collection first, so the read sees all that is logged."""
        self._get(name)
        if fresh:
            self.commit(name)
        return S.get_source(self.committed(name), doc_id)

    def search(self, name: str, query: str = "", limit: int = S.LIMIT, offset: int = S.OFFSET) -> S.Result:
        """By the stored postings where the query has only terms and boolean operators, else by a scan; both agree."""
        docs, mapping = self.committed(name), self._get(name)["mapping"]
        if S.has_postings(mapping, query):
            return S.search_postings(self.postings(name), docs, mapping, query, limit, offset, self._totals(self._get(name)))
        return S.search(docs, mapping, query, limit, offset)

    # versions

    @staticmethod
    def _named(c: dict) -> list[str]:
        """The folders of a collection's state."""
        return [f"{kind}-{s['n']}" for s in c["segments"] for kind in ("segment", *(["gone"] if s["gone"] else []), *(["packed"] if s["postings"] else []))]

    def _at(self, c: dict, folder: str) -> str:
        return f"{self.root}/{c['uuid']}/{folder}"

    def _gone(self, c: dict, segments: list[dict]) -> DataFrame | None:
        """_id, by: the last of the segments that replaces or deletes each id; None if none does."""
        out = None
        for s in segments:
            if s["gone"]:
                own = self.spark.read.schema(f"{ID} string").parquet(self._at(c, f"gone-{s['n']}")).withColumn("by", F.lit(s["n"]))
                out = own if out is None else out.union(own)
        return None if out is None else out.groupBy(ID).agg(F.max("by").alias("by"))

    def _read(self, c: dict, folder: str) -> DataFrame:
        """The documents or the postings of a segment."""
        if folder.startswith("packed"):
            return S.unpacked(self.spark.read.schema(S.PACKED).parquet(self._at(c, folder)))
        return from_stored(self.spark.read.schema(c["mapping"].stored_schema()).parquet(self._at(c, folder)), c["mapping"])

    def _live(self, c: dict, kind: str, schema, segments: list[dict]) -> DataFrame:
        """What the segments hold of a kind of rows, without those of ids that a later segment has taken over."""
        out = None
        for s in segments:
            if kind == "packed" and not s["postings"]:
                continue
            own = self._read(c, f"{kind}-{s['n']}").withColumn("_in", F.lit(s["n"]))
            out = own if out is None else out.union(own)
        if out is None:
            return self.spark.createDataFrame([], schema)
        gone = self._gone(c, segments)
        if gone is not None:
            gone = gone.withColumnRenamed(ID, "_gone")
            out = out.join(gone, (F.col(ID) == F.col("_gone")) & (F.col("_in") < F.col("by")), "left_anti")
        return out.drop("_in")

    def committed(self, name: str) -> DataFrame:
        """The last committed version: immutable, so a total and its page agree."""
        c = self._get(name)
        return self._live(c, "segment", c["mapping"].schema(), c["segments"])

    def postings(self, name: str) -> DataFrame:
        """field, term, _id, tf, length, bucket of the last committed version's documents."""
        c = self._get(name)
        return self._live(c, "packed", S.POSTINGS, c["segments"])

    @staticmethod
    def _totals(c: dict) -> dict | None:
        """search.field_totals() of the committed version, from its segments' own; None where some documents are replaced."""
        if any(s["gone"] for s in c["segments"]):
            return None
        return {f: [sum(s["totals"][f][k] for s in c["segments"]) for k in (0, 1)] for f in c["mapping"].default_fields()}

    def _write_segment(self, c: dict, rows: DataFrame, gone: DataFrame | None) -> dict:
        """A segment of rows (_id, _source, _seq), which lie by range of the id and in its order, and of the ids that are gone.

        It gets a new number: those of commits that did not get to the catalog file, or of later snapshots, aren't used again.
        """
        mapping, counts = c["mapping"], {}
        n = 1 + max((int(f.rpartition("-")[2]) for f in self.files.names(f"{self.root}/{c['uuid']}")), default=0)
        own = self._at(c, f"segment-{n}")
        to_stored(with_tokens(extract(rows, mapping), mapping), mapping).write.options(**STORED).parquet(own)
        docs = self.spark.read.schema(mapping.stored_schema()).parquet(own)
        counts["n"], counts["rows"] = n, docs.count()
        counts["totals"] = S.field_totals(docs, mapping, stored=True)
        counts["postings"] = bool(mapping.default_fields()) and counts["rows"] > 0
        if counts["postings"]:
            S.write_packed(docs, mapping, self._at(c, f"packed-{n}"))
        counts["gone"] = gone is not None
        if gone is not None:
            gone.select(ID).distinct().write.parquet(self._at(c, f"gone-{n}"))
        return counts

    def _write_version(self, name: str, upto: int) -> bool:
        """A segment of the commands up to `upto` that are not committed yet, and of the newest segments that they outgrow."""
        c = self._get(name)
        if c["committed_seq"] >= upto:
            return False
        tail = self.log.read(max(c["committed_seq"], c["created_seq"]) + 1, upto + 1).where((F.col("collection") == name) & F.col("op").isin("index", "delete"))
        new = dict(c, committed_seq=upto)
        # ids and numbers only: how many commands, documents and documents that are left there are
        last = tail.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seq") * 2 + (F.col("op") == "index").cast("long")).alias("last"))
        r = last.agg(F.sum("n").alias("commands"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("last") % 2 == 1).alias("live")).first()
        if r["ids"]:
            news = tail.select(F.col("id").alias(ID), F.col("seq").alias(SEQ), "op", F.col("source").alias(SOURCE)) if r["commands"] == r["ids"] else C.latest(tail).drop("collection")
            i = self._outgrown(c, r["live"])
            part, ids = c["segments"][i:], tail.select(F.col("id").alias(ID))
            gone = self._gone(c, part)
            ids = ids if gone is None else ids.union(gone.select(ID))
            new["segments"] = [*c["segments"][:i], self._write_segment(c, self._folded(c, part, news), ids if i else None)]
            new["version"] = c["version"] + 1
        self.collections[name] = new
        return True

    @staticmethod
    def _outgrown(c: dict, rows: int) -> int:
        """The place of the first segment that is not larger than all that comes after it, `rows` new ones included; their number if none is."""
        sizes = [*(s["rows"] for s in c["segments"]), rows]
        return next((i for i, own in enumerate(sizes[:-1]) if own <= sum(sizes[i + 1 :])), len(c["segments"]))

    def _folded(self, c: dict, part: list[dict], news: DataFrame) -> DataFrame:
        """_id, _source, _seq of the segments of part and the newer commands (one an id), by range of the id and in its order.

        Sources alone are shuffled, once; what is made of them is made after that.
        """
        if not part:
            return news.where("op = 'index'").select(ID, SOURCE, SEQ).repartitionByRange(ID).sortWithinPartitions(ID)
        # a segment's documents come before the ids that it takes over, both before what is older
        rows = news.select(ID, SOURCE, SEQ, F.lit((1 << 63) - 1).alias("at"), (F.col("op") == "index").alias("live"))
        for k, s in enumerate(part):
            own = self._read(c, f"segment-{s['n']}")
            rows = rows.union(own.select(ID, SOURCE, SEQ, F.lit(2 * s["n"] + 1).cast("long"), F.lit(True)))
            if k and s["gone"]:
                ids = self.spark.read.schema(f"{ID} string").parquet(self._at(c, f"gone-{s['n']}"))
                rows = rows.union(ids.select(ID, F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(2 * s["n"]).cast("long"), F.lit(False)))
        first = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("at")))
        return rows.repartitionByRange(ID).withColumn("rank", first).where("rank = 1 and live").select(ID, SOURCE, SEQ)

    def commit(self, name: str) -> bool:
        """Make what is logged of one collection searchable; whether there was anything."""
        old = dict(self._get(name))
        done = self._write_version(name, self.seq)
        if done:
            self._store()
            self._forget(old)
        return done

    def checkpoint(self) -> None:
        """Commit every collection at the log's end, store the catalog, then trim the log."""
        olds = [dict(c) for c in self.collections.values()]
        for name in self.list():
            self._write_version(name, self.seq)
        self.applied_seq = self.seq
        self._store()
        for c in olds:
            self._forget(c)
        self.log.purge(self.applied_seq)

    def tidy(self) -> None:
        """Make the log's many small segments one; no command is lost or changed."""
        self._own()
        if len(self.log.segments()) > LOG_SEGMENTS:
            self.log.merge()

    def _forget(self, old: dict) -> None:
        """Drop folders that neither this version nor the last one names: a reader of the last may still be at work."""
        now = next((c for c in self.collections.values() if c["uuid"] == old["uuid"]), None)
        if now is not None and now["version"] != old["version"]:
            keep = {*self._named(now), *self._named(old), *self._pinned().get(now["uuid"], ())}
            for folder in self.files.names(f"{self.root}/{now['uuid']}"):
                if folder not in keep:
                    self.files.delete(self._at(now, folder))

    def min_committed(self) -> int | None:
        return C.min_committed(self.as_frame()).first()["min_committed"]

    # snapshots

    def snapshot(self) -> str:
        """Keep the committed version: its folders never change, so the catalog file that names them is all there is to write; the snapshot's id."""
        self.checkpoint()
        sid = f"{self.applied_seq:020d}-{uuid.uuid4().hex[:8]}"
        self.files.write(f"{self.root}/_snapshots/{sid}/_catalog.json", self.files.read(self.path))
        return sid

    def _pinned(self) -> dict[str, set[str]]:
        """The folders that snapshots name, by collection."""
        out: dict[str, set[str]] = {}
        for sid in self.snapshots():
            for c in json.loads(self.files.read(f"{self.root}/_snapshots/{sid}/_catalog.json"))["collections"].values():
                out.setdefault(c["uuid"], set()).update(self._named(c))
        return out

    def snapshots(self) -> list[str]:
        """Ids of the whole snapshots, oldest first."""
        folder = f"{self.root}/_snapshots"
        return [n for n in self.files.names(folder) if self.files.exists(f"{folder}/{n}/_catalog.json")]

    def snapshot_if_due(self, every: int = SNAPSHOT_EVERY, keep: int = SNAPSHOTS) -> str | None:
        """A snapshot if `every` commands were logged since the last one; all but the last `keep` go."""
        last = self.snapshots()[-1:]
        if self.seq - (int(last[0].split("-")[0]) if last else 0) < every:
            return None
        sid = self.snapshot()
        for old in self.snapshots()[:-keep]:
            self.files.delete(f"{self.root}/_snapshots/{old}")
        return sid

    def install(self, folder: str) -> None:
        """Replace the whole state by a snapshot's (its folder in this root or another's); the catalog file comes last."""
        if not self.files.exists(f"{folder}/_catalog.json"):
            raise RecoveryError("the snapshot has no catalog")
        try:
            j = json.loads(self.files.read(f"{folder}/_catalog.json"))
            named = [(c, own) for c in j["collections"].values() for own in self._named(c)]
        except (ValueError, KeyError, TypeError) as e:
            raise RecoveryError(f"the snapshot's catalog is damaged: {e}") from None
        self._own()
        source = folder.rstrip("/").rpartition("/_snapshots/")[0]
        for c, own in named:
            if not self.files.exists(f"{source}/{c['uuid']}/{own}"):
                raise RecoveryError("the snapshot lacks data that its catalog names")
        if source != self.root:  # copied by the executors
            for c, own in named:
                kind, to = own.partition("-")[0], f"{self.root}/{c['uuid']}/{own}"
                schema = {"segment": Mapping.from_json(json.dumps(c["mapping"])).stored_schema(), "gone": f"{ID} string", "packed": S.PACKED}[kind]
                options = S.PACKED_STORED if kind == "packed" else STORED
                self.files.delete(to)
                self.spark.read.schema(schema).parquet(f"{source}/{c['uuid']}/{own}").write.options(**options).parquet(to)
        self.log.truncate(0)
        self.files.write(self.path, json.dumps(j, sort_keys=True))
        self._load()
        self.quarantined = self.sweep()


__all__ = ["ID", "SEQ", "SOURCE", "Catalog"]
