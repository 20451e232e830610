"""The command log as DataFrames: building, folding to the latest state, replay, and log maintenance.

A command is a row (seq, op, collection, id, source, uuid, mapping); op is create, index, delete or drop.
State is a pure function of the commands, so replaying any of them twice changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.mapping import ID, SEQ, SOURCE, Mapping, check_name

COMMANDS = "seq long, op string, collection string, id string, source string, uuid string, mapping string"
COLUMNS = ["seq", "op", "collection", "id", "source", "uuid", "mapping"]


def one(spark: SparkSession, seq: int, op: str, collection: str, **values) -> DataFrame:
    """A single command row."""
    row = {"id": None, "source": None, "uuid": None, "mapping": None} | values
    return spark.createDataFrame([(seq, op, collection, row["id"], row["source"], row["uuid"], row["mapping"])], COMMANDS)


def create_command(spark: SparkSession, seq: int, name: str, mapping: Mapping) -> DataFrame:
    return one(spark, seq, "create", check_name(name), uuid=str(uuid.uuid4()), mapping=mapping.to_json())


def drop_command(spark: SparkSession, seq: int, name: str) -> DataFrame:
    return one(spark, seq, "drop", name)


def new_id() -> str:
    return str(uuid.uuid4())


def index_commands(rows: DataFrame, collection: str, first_seq: int) -> DataFrame:
    """Commands for rows (order, id, source), numbered from first_seq in that order without a sort of all rows in one task.

    Ids that are null are made here, so a caller that writes the result writes each of them once.
    """
    return _numbered(rows.withColumn("id", F.coalesce("id", F.uuid())), collection, "index", first_seq)


def delete_commands(rows: DataFrame, collection: str, first_seq: int) -> DataFrame:
    """Tombstones for rows (order, id); also for ids that don't exist."""
    return _numbered(rows.withColumn("source", F.lit(None).cast("string")), collection, "delete", first_seq)


def _numbered(rows: DataFrame, collection: str, op: str, first_seq: int) -> DataFrame:
    return rows.select((F.col("order").cast("long") + first_seq).alias("seq"), F.lit(op).alias("op"), F.lit(collection).alias("collection"), "id", "source", F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("string").alias("mapping"))


def run_starts(runs: list[tuple[int, int, int, object, object]]) -> list[tuple[int, int, int]] | None:
    """(part, run, rows in all runs before it) of runs (part, run, n, low, high); None if they overlap or one is no run (-1)."""
    if any(r[1] < 0 or r[3] is None for r in runs):
        return None
    out, at, before = [], 0, None
    for part, run, n, low, high in sorted(runs, key=lambda r: (r[3], r[4])):
        if before is not None and low < before:
            return None
        out.append((part, run, at))
        at, before = at + n, high
    return out


def latest(commands: DataFrame) -> DataFrame:
    """collection, _id, _seq, op, _source: the last command of each document; partial aggregation, no window."""
    last = F.max_by(F.struct("op", "source"), "seq")
    kept = commands.where(F.col("op").isin("index", "delete")).groupBy("collection", F.col("id").alias(ID)).agg(F.max("seq").alias(SEQ), last.alias("last"))
    return kept.select("collection", ID, SEQ, F.col("last.op").alias("op"), F.col("last.source").alias(SOURCE))


def live(commands: DataFrame) -> DataFrame:
    """latest() without deleted documents."""
    return latest(commands).where("op = 'index'").drop("op")


def fold(committed: DataFrame, commands: DataFrame, committed_seq: int) -> DataFrame:
    """_id, _source, _seq of one collection after its commands beyond committed_seq; those at or below it are skipped, so replay is idempotent."""
    news = latest(commands.where(F.col("seq") > committed_seq)).drop("collection")
    old = committed.select(ID, SOURCE, SEQ).join(news.select(ID), ID, "left_anti")
    return old.unionByName(news.where("op = 'index'").select(ID, SOURCE, SEQ))


def created_flags(committed: DataFrame, batch: DataFrame) -> DataFrame:
    """batch ids (id) with created: absent from the last committed view, so two upserts before a commit both say created."""
    seen = committed.select(F.col(ID).alias("id"), F.lit(False).alias("seen")).distinct()
    return batch.select("id").join(seen, "id", "left").select("id", F.coalesce("seen", F.lit(True)).alias("created"))


def existed_flags(committed: DataFrame, batch: DataFrame) -> DataFrame:
    """batch ids (id) with existed, judged on the committed view."""
    return created_flags(committed, batch).select("id", (~F.col("created")).alias("existed"))


def collections_after(commands: DataFrame) -> DataFrame:
    """collection, uuid, mapping, created_seq of those that live after the create and drop commands.

    Of creates since the last drop the first stands: a later one, alike or not, changes nothing.
    """
    ddl = commands.where(F.col("op").isin("create", "drop"))
    dropped = ddl.groupBy("collection").agg(F.coalesce(F.max(F.when(F.col("op") == "drop", F.col("seq"))), F.lit(-1)).alias("dropped"))
    creates = ddl.where("op = 'create'").join(dropped, "collection").where(F.col("seq") > F.col("dropped"))
    return creates.groupBy("collection").agg(F.min_by(F.struct("uuid", "mapping"), "seq").alias("c"), F.min("seq").alias("created_seq")).select("collection", "c.uuid", "c.mapping", "created_seq")


def of_live(commands: DataFrame) -> DataFrame:
    """Document commands that fall to a collection that is live at the end and was created before them; others do nothing."""
    alive = collections_after(commands).select("collection", "created_seq")
    return commands.where(F.col("op").isin("index", "delete")).join(alive, "collection").where(F.col("seq") > F.col("created_seq")).select(*COLUMNS)


# maintenance of a log table

def log_range(log: DataFrame, start: int, stop: int) -> DataFrame:
    """start <= seq < stop, in order."""
    return log.where((F.col("seq") >= start) & (F.col("seq") < stop)).orderBy("seq")


def purged(log: DataFrame, upto: int) -> DataFrame:
    """Without seq <= upto."""
    return log.where(F.col("seq") > upto)


def truncated(log: DataFrame, start: int) -> DataFrame:
    """Without seq >= start."""
    return log.where(F.col("seq") < start)


def with_crc(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", F.crc32(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).cast("binary")))


def sound_prefix(log: DataFrame) -> DataFrame:
    """Rows before the first gap or bad checksum of a log with crc; what follows a torn record is not trusted.

    One aggregation tells a whole log (as many rows, and as large a sum, as its ends say; an append numbers its
    rows once); only a damaged one is searched for the place.
    """
    bad = F.coalesce(F.crc32(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).cast("binary")) != F.col("crc"), F.lit(True))
    at = F.col("seq").cast("decimal(38,0)")
    r = log.agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum(at).alias("s")).first()
    n = r["n"]
    if not n or not r["bad"] and r["b"] - r["a"] + 1 == n and int(r["s"]) * 2 == (r["a"] + r["b"]) * n:
        return log.select(*COLUMNS)
    checked = log.withColumn("ok", F.crc32(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).cast("binary")) == F.col("crc"))
    after = checked.select((F.col("seq") - 1).alias("seq"), F.lit(True).alias("followed"))
    ends = checked.join(after, "seq", "left").where(F.coalesce(~F.col("ok"), F.lit(True)) | F.col("followed").isNull())
    # the first bad row, or the row before the first gap, ends the prefix
    stop = ends.agg(F.min(F.when(F.coalesce("ok", F.lit(False)), F.col("seq") + 1).otherwise(F.col("seq"))).alias("stop"))
    return checked.join(F.broadcast(stop), F.col("seq") < F.col("stop")).select(*COLUMNS)


def min_committed(marks: DataFrame) -> DataFrame:
    """One row: the least committed_seq over collections, one without counting as 0; null if there are none."""
    return marks.agg(F.min(F.coalesce("committed_seq", F.lit(0))).cast("long").alias("min_committed"))


def latest_by_window(commands: DataFrame) -> DataFrame:
    """latest() by row_number; kept as the plainer definition that tests compare with."""
    w = Window.partitionBy("collection", "id").orderBy(F.desc("seq"))
    rows = commands.where(F.col("op").isin("index", "delete")).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select("collection", F.col("id").alias(ID), F.col("seq").alias(SEQ), "op", F.col("source").alias(SOURCE))
