"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: centred vectors, rotated by iterative quantisation (several rotations, each learned from its own
start), one sign bit a coordinate, CODE_BITS in all. A code is cut into substrings of 16 bits, each with an
index of its own (buckets by value). Two codes at most r bits apart agree in some substring up to
floor(r / substrings) bits, so probing those buckets of each index retrieves every code within r; the rest
of the bits are then checked and the exact distances of the original vectors decide.

The rotations and r come from a bounded sample (SAMPLE rows, by a hash of vec_id; r is the `reach` quantile
of the Hamming distances of the sample's true neighbours). Every row is indexed, in blocks dealt over parts; a
part is one task's, and its size doesn't grow with the table. Queries are a table too: in blocks, each is sent to
every part, so none come to the driver. Queries that find fewer than k within r are searched once more in all
rows, exactly, in the same way.

Rows that are null, of another length than most, all zero, or hold null or non-finite components take no part.
Rows of one vec_id count once, by their nearest; of a query's rows the least vector (component by component)
asks; a query's own vec_id is no candidate. Vectors keep their type, and distances are taken in doubles. An
empty table gives no rows. Only vec_id and embedding are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

CODE_BITS, SUB = 256, 16
SAMPLE, INDEX_BLOCK, QUERY_BLOCK, PART_BLOCKS = 8192, 8192, 256, 4
#: Bytes of vectors in a block of the index.
BLOCK_BYTES = 4 << 20


def taking_part(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the rows that take part, and the vectors' length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size("embedding") == d), d


def vectors(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Coder:
    mean: np.ndarray
    rotation: np.ndarray  # d x CODE_BITS
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, CODE_BITS / 64) unsigned words."""
        bits = (x.astype(np.float64) - self.mean) @ self.rotation > 0
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def quantise(x: np.ndarray, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    """A rotation that brings the rows of x near to the corners of the cube, by alternating signs and Procrustes."""
    d = x.shape[1]
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ v
    return r


def learn(x: np.ndarray, k: int, reach: float = 0.98, seed: int = 11) -> Coder:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    mean = x.mean(0)
    d = x.shape[1]
    few = x[: 20 * d + 1000] - mean
    rotation = np.concatenate([quantise(few, rng) for _ in range(-(-CODE_BITS // d))], 1)[:, :CODE_BITS]
    coder = Coder(mean, rotation, CODE_BITS)
    probes = rng.permutation(len(x))[:256]
    codes = coder.codes(x)
    far: list[np.ndarray] = []
    for i in probes:
        distance = ((x - x[i]) ** 2).sum(1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(x) - 1)]
        far.append(np.bitwise_count(codes[near] ^ codes[i]).sum(1))
    found = np.concatenate(far) if far else np.zeros(0)
    coder.radius = int(np.quantile(found, reach)) if len(found) else CODE_BITS
    return coder


INDEX = "ids binary, vectors binary, codes binary, orders binary, offsets binary"
INDEX_NAMES = ["ids", "vectors", "codes", "orders", "offsets"]


def build_index(rows: DataFrame, coder: Coder, d: int) -> DataFrame:
    """Blocks of rows: ids, vectors, codes and, for each substring, the rows by its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = vectors(batch, d)
            step = max(64, min(INDEX_BLOCK, BLOCK_BYTES // (d * x.itemsize)))
            for k in range(0, len(ids), step):
                part, own = x[k : k + step], ids[k : k + step]
                codes = coder.codes(part)
                values = codes.view("<u2")
                orders = np.argsort(values, axis=0, kind="stable").T.astype("<u2")
                body = [own.astype("<i8"), part, codes, orders, np.take_along_axis(values.T, orders.astype(np.int64), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in body], names=INDEX_NAMES)

    return rows.mapInArrow(run, INDEX)


def query_blocks(rows: DataFrame, coder: Coder, d: int) -> DataFrame:
    """Blocks of queries: ids, vectors, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = vectors(batch, d)
            for k in range(0, len(ids), QUERY_BLOCK):
                body = [ids[k : k + QUERY_BLOCK].astype("<i8"), x[k : k + QUERY_BLOCK], coder.codes(x[k : k + QUERY_BLOCK])]
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in body], names=INDEX_NAMES[:3])

    return rows.select("vec_id", "embedding").mapInArrow(run, "ids binary, vectors binary, codes binary")


class Block:
    def __init__(self, row: dict, d: int, kind: str):
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, d).astype(np.float64)
        self.codes = np.frombuffer(row["codes"], "<u8").reshape(n, -1)
        self.orders = np.frombuffer(row["orders"], "<u2").reshape(-1, n)
        self.buckets = []
        for values in np.frombuffer(row["offsets"], "<u2").reshape(-1, n):
            value, start = np.unique(values, return_index=True)
            self.buckets.append((value, np.append(start, n)))

    def within(self, code: np.ndarray, radius: int, balls: list[np.ndarray]) -> np.ndarray:
        """Rows whose code differs in at most `radius` bits, by the substring indexes."""
        n_sub = len(self.buckets)
        reach = radius // n_sub
        hit = np.zeros(len(self.ids), bool)
        for (value, start), order, q in zip(self.buckets, self.orders, code.view("<u2"), strict=True):
            if reach < len(balls) and len(balls[reach]) * 4 < len(value):  # look each probe up
                probe = q ^ balls[reach]
                at = np.minimum(np.searchsorted(value, probe), len(value) - 1)
                at = at[value[at] == probe]
            else:  # as many probes as buckets: go through the buckets
                at = np.flatnonzero(np.bitwise_count(value ^ q) <= reach)
            sizes = start[at + 1] - start[at]
            if len(at):
                rows = np.repeat(start[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                hit[order[rows]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def hamming_balls(most: int = 3) -> list[np.ndarray]:
    """For each reach up to `most`, all 16-bit masks of at most so many bits."""
    every = np.arange(1 << SUB, dtype=np.uint16)
    return [every[np.bitwise_count(every) <= r] for r in range(most + 1)]


NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_in(block: Block, own: int, query: np.ndarray, code: np.ndarray, radius: int | None, balls: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the block's k nearest to a query, distinct ids."""
    rows = np.arange(len(block.ids)) if radius is None else block.within(code, radius, balls)
    rows = rows[block.ids[rows] != own]
    return first_k(np.sqrt(((block.vectors[rows] - query) ** 2).sum(1)), block.ids[rows], k)


def first_k(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, score))
    _, first = np.unique(ids[by], return_index=True)
    by = by[np.sort(first)][:k]
    return score[by], ids[by]


def search(index: DataFrame, queries: DataFrame, d: int, kind: str, k: int, radius: int | None, parts: int) -> DataFrame:
    """query_id, vec_id, score: of each part of the index, the k nearest to each query; radius None: of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, blocks = hamming_balls(), []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in INDEX_NAMES}
                if row["orders"] is not None:  # the index's blocks come first
                    blocks.append(Block(row, d, kind))
                    continue
                ids = np.frombuffer(row["ids"], "<i8")
                x = np.frombuffer(row["vectors"], kind).reshape(-1, d).astype(np.float64)
                codes = np.frombuffer(row["codes"], "<u8").reshape(len(ids), -1)
                found = []
                for j, q in enumerate(ids.tolist()):
                    got = [nearest_in(b, q, x[j], codes[j], radius, balls, k) for b in blocks]
                    found.append(first_k(*(np.concatenate(c) for c in zip(*got, strict=True)), k) if got else (np.zeros(0), np.zeros(0, np.int64)))
                lens = [len(near) for _, near in found]
                if sum(lens):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lens)), pa.array(np.concatenate([n for _, n in found])), pa.array(np.concatenate([s for s, _ in found]))], schema=NEAR)

    none = F.lit(None).cast("binary")
    own = index.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), *INDEX_NAMES)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), *INDEX_NAMES[:3], none.alias("orders"), none.alias("offsets"))
    both = own.union(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    return both.select(*INDEX_NAMES).mapInArrow(run, "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, reach: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean) for the rows whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    rows, d = taking_part(embeddings)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f8" if dict(rows.dtypes)["embedding"] == "array<double>" else "<f4"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).toArrow().combine_chunks()
    coder = learn(sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d), k, reach)
    index = materialize(build_index(rows, coder, d), "index")
    queries = materialize(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // PART_BLOCKS))
    found = materialize(search(index, query_blocks(queries, coder, d), d, kind, k, coder.radius, parts), "near")
    full = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k).select("vec_id")
    short = materialize(queries.join(full, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        exact = search(index, query_blocks(short, coder, d), d, kind, k, None, parts)
        found = found.union(exact)  # what the first search found of them is among the rest
    return top(found, k)
