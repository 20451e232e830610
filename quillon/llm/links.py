"""Bucket joins that find close binary codes, and connected components; both free of hot tasks.

A bucket is the rows of one key. Buckets of more than `most` rows are dealt over chunk pairs, so that every
pair of rows still meets in some task, and no task holds more than two chunks. Within a task, close pairs
are found by blocks of numpy comparisons, never materialised as all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: Rows of a bucket that one task compares at once; more are dealt over pairs of chunks of about this size.
MOST = 4096
#: Groups up to this size are compared by shifts over the whole sorted array.
SMALL = 24
#: Pairs a row up to which a larger group gives its candidate pairs; beyond, its rows are compared on their whole codes.
CROWD = 2
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
MEETINGS = pa.schema([(c, pa.int64()) for c in ("u", "v", "key", "part")])


def deal(rows: DataFrame, most: int = MOST, partitions: int | None = None) -> DataFrame:
    """rows (key, node, code, and what else they have) with column part: equal (key, part) rows meet in one task, sorted so.

    Large buckets come from a count by key (partially aggregated); their keys join back, never collected.
    """
    spark = rows.sparkSession
    n, names = partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), rows.columns
    large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large-buckets")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        chunks = F.ceil(F.col("n") / most).cast("long")
        own = F.pmod(F.xxhash64("node", "code"), chunks)
        dealt = rows.join(large, "key", "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)).cast("long")).withColumn("own", F.coalesce(own, F.lit(0)).cast("long"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        part = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")
        rows = dealt.select(*names, part.alias("part"))
    return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "node", "code")


def groups(batches: Iterator[pa.RecordBatch], target: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(start of each group, nodes, codes, other columns) of whole groups, some 200,000 rows at a time."""
    held: list[list[np.ndarray]] = []
    size = 0

    def cut(columns: list[np.ndarray]):
        key, part, *others = columns
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        return np.flatnonzero(new), *others

    for batch in batches:
        names = ["key", "part", *(c for c in batch.schema.names if c not in ("key", "part"))]
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        size += batch.num_rows
        if size < target:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        starts = cut(columns)[0]
        last = int(starts[-1])  # the last group may go on
        if last:
            yield cut([c[:last] for c in columns])
        held, size = [[c[last:] for c in columns]], len(columns[0]) - last
    if size:
        yield cut([np.concatenate(c) for c in zip(*held, strict=True)])


def close_pairs(starts: np.ndarray, codes: np.ndarray, radius: int, on_large: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a group with at most `radius` differing bits; groups over SMALL go to on_large(lo, hi)."""
    codes = codes.view(np.uint64)
    ends = np.append(starts[1:], len(codes))
    sizes = ends - starts
    small = np.repeat(sizes <= SMALL, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    for d in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= radius]
        a.append(i)
        b.append(i + d)
    for g in np.flatnonzero(sizes > SMALL):
        x, y = on_large(int(starts[g]), int(ends[g]))
        a.append(x)
        b.append(y)
    empty = np.zeros(0, np.int64)
    return np.concatenate(a or [empty]), np.concatenate(b or [empty])


def forest(codes: np.ndarray, radius: int) -> Callable:
    """on_large for exact links: edges that join the components of a group, at most one a row."""

    def run(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        own = codes[lo:hi].view(np.uint64)
        n = len(own)
        root = np.arange(n)
        for i in range(0, n, 256):
            near = np.bitwise_count(own[i : i + 256, None] ^ own[None, :]) <= radius
            x, y = np.nonzero(near)
            root = join_roots(root, x + i, y)
        moved = np.flatnonzero(root != np.arange(n))
        return moved + lo, root[moved] + lo

    return run


def join_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root after the links x-y: every row's root is the least index of its component."""
    while True:
        a, b = root[x], root[y]
        differ = a != b
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def exact_links(rows: DataFrame, radius: int, partitions: int | None = None) -> DataFrame:
    """u, v: links that connect just the nodes whose codes, meeting in a bucket, differ in at most `radius` bits.

    Links within a task are contracted to a star for each of its components before they leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, nodes, codes in groups(batches):
            a, b = close_pairs(starts, codes, radius, forest(codes, radius))
            u, v = nodes[a], nodes[b]
            differ = u != v
            ids, at = np.unique(np.concatenate([u[differ], v[differ]]), return_inverse=True)
            if len(ids):
                n = len(at) // 2
                root = join_roots(np.arange(len(ids)), at[:n], at[n:])
                moved = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[root[moved]]), pa.array(ids[moved])], schema=PAIRS)

    return deal(rows, partitions=partitions).mapInArrow(run, "u long, v long").distinct()


def star_links(rows: DataFrame, radius: int, partitions: int | None = None) -> DataFrame:
    """u, v: each node with the least of its bucket, where their codes are at most `radius` apart; to be verified.

    At most one pair a row. The least node is the same in many buckets of a large group, so distinct pairs are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, nodes, codes in groups(batches):
            first = np.repeat(starts, np.diff(np.append(starts, len(nodes))))
            codes = codes.view(np.uint64)
            own = np.flatnonzero((np.bitwise_count(codes ^ codes[first]) <= radius) & (nodes != nodes[first]))
            pairs = np.unique(np.stack([nodes[first[own]], nodes[own]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=PAIRS)

    return deal(rows, partitions=partitions).mapInArrow(run, "u long, v long").distinct()


def candidate_links(rows: DataFrame, radius: int, partitions: int | None = None) -> DataFrame:
    """u, v, key, part: pairs of nodes of different roots (column root) that meet in a bucket with codes at most `radius` apart, to be verified.

    A bucket of over SMALL rows that has more than CROWD such pairs a row gives its rows that are in one, as
    node and root with its key and part (null for pairs): crowd_links compares all of these on their whole codes.
    """

    def close(codes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the pairs, or none, and which rows are in one if the pairs are too many."""
        n, count = len(codes), 0
        a, b, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(n, bool)
        if (roots != roots[0]).any():
            for i in range(0, n, 256):
                near = np.bitwise_count(codes[i : i + 256, None] ^ codes[None, i:]) <= radius
                near &= roots[i : i + 256, None] != roots[None, i:]
                near = np.triu(near)
                member[i : i + 256] |= near.any(1)
                member[i:] |= near.any(0)
                count += np.count_nonzero(near)
                if count <= CROWD * n:
                    x, y = np.nonzero(near)
                    a.append(x + i)
                    b.append(y + i)
        if count > CROWD * n:
            return a[0], b[0], np.flatnonzero(member)
        return np.concatenate(a), np.concatenate(b), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, nodes, codes, roots, keys, parts in groups(with_group(batches)):
            crowds = []

            def on_large(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
                a, b, members = close(codes[lo:hi].view(np.uint64), roots[lo:hi])
                crowds.append(members + lo)
                return a + lo, b + lo

            a, b = close_pairs(starts, codes, radius, on_large)
            differ = roots[a] != roots[b]
            a, b = a[differ], b[differ]
            pairs = np.unique(np.stack([np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])], 1), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], schema=MEETINGS)
            if crowds:
                m = np.concatenate(crowds)
                yield pa.RecordBatch.from_arrays([pa.array(c[m]) for c in (nodes, roots, keys, parts)], schema=MEETINGS)

    return deal(rows, partitions=partitions).mapInArrow(run, "u long, v long, key long, part long").distinct()


def with_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, code, root and, for groups() to keep, copies of key and part after them."""
    for batch in batches:
        names = ["key", "part", "node", "code", "root"]
        columns = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, *columns[:2]], names=[*names, "own_key", "own_part"])


def crowd_links(rows: DataFrame, radius: int, partitions: int | None = None, words: int | None = None, settle: Callable | None = None) -> DataFrame:
    """u, v: links between roots that join those of which two rows of a group have codes at most `radius` apart.

    rows: key, part, root and wide (the whole code); all pairs of a (key, part) are compared, by blocks. words: of
    wide, the first so many 64-bit words are the code; settle(bits apart, wide of one, of the other) has the last say.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, roots, wides in groups(batches, 20_000):
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(roots)], strict=True):
                ids, at = np.unique(roots[lo:hi], return_inverse=True)
                raw = np.frombuffer(b"".join(wides[lo:hi]), np.uint8).reshape(hi - lo, -1)
                code = np.ascontiguousarray(raw[:, : 8 * words] if words else raw).view("<u8")
                top = np.arange(len(ids))
                for i in range(0, hi - lo, 256):
                    apart = np.zeros((min(256, hi - lo - i), hi - lo - i), np.uint16)
                    for w in np.ascontiguousarray(code.T):
                        apart += np.bitwise_count(w[i : i + 256, None] ^ w[None, i:])
                    own = top[at]
                    x, y = np.nonzero((apart <= radius) & (own[i : i + 256, None] != own[None, i:]))
                    if settle is not None and len(x):
                        ok = np.concatenate([settle(apart[x[k : k + 50_000], y[k : k + 50_000]], raw[x[k : k + 50_000] + i], raw[y[k : k + 50_000] + i]) for k in range(0, len(x), 50_000)])
                        x, y = x[ok], y[ok]
                    top = join_roots(top, at[x + i], at[y + i])
                moved = np.flatnonzero(top != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[top[moved]]), pa.array(ids[moved])], schema=PAIRS)

    dealt = rows.select("key", "part", "root", "wide").repartition(n, "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in links (u, v).

    Each round hooks every node to its least neighbour, shortens the paths twice and contracts the links; the
    number of components at least halves. Rounds are written to the shared folder; all joins and sums are
    by node, with partial aggregation, and nothing is collected. A root of very many nodes is a hot key of the joins
    by root, which adaptive execution splits (one side has a row a root).
    """
    links = materialize(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    total = None
    while not links.isEmpty():
        both = links.select(F.col("u").alias("node"), F.col("v").alias("near")).union(links.select(F.col("v").alias("node"), F.col("u").alias("near")))
        up = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "hooks")
        for _ in range(2):
            again = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            up = up.join(again, "root").select("node", F.col("top").alias("root"))
        up = materialize(up, "roots")
        a, b = up.toDF("u", "ru"), up.toDF("v", "rv")
        links = links.join(a, "u").join(b, "v").where("ru <> rv")
        links = materialize(links.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        if total is None:
            total = up
        else:
            step = up.toDF("root", "top")
            total = materialize(total.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components")
    if total is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return total
