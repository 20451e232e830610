"""Token ids as files of fixed-width packed bits.

A shard file is one header and four sections, all little-endian:

    magic "QTB2", width uint32, n_docs uint64, n_null uint64, n_ids uint64, n_blocks uint64
    doc_ids   int64[n_docs]       ascending; the first n_null have none (0 stands for it)
    ends      uint64[n_docs]      ids of the shard up to and with each document
    blocks    uint64[n_blocks+1]  byte offset of each block of BLOCK ids in the data
    data      the ids, `width` bits each, least significant bit first, each block from a whole byte

`width` is the least that holds the vocabulary. Any id is found from its index alone: its block's offset
and its bit in the block; a block is unpacked with numpy in one step.

A range of doc_id is one task's, which streams it and ends a shard once it holds `shard_bytes` bytes of ids: a shard is
bounded whatever the texts' lengths, beyond its last text. Each file has a name of its own and a manifest
row; only rows of successful tasks are committed (Spark's Parquet commit), so files of lost or repeated
attempts are never read.

Null texts are empty documents (the end id alone). Rows without doc_id come first. Repeated doc_ids, and
repeated rows, are all kept, in an order fixed by their ids' bytes. An empty table gives an empty manifest
and report. Only doc_id and text are read, so other columns and their names have no effect. A very long text
is encoded by blocks, but its ids are one value of a row: some two bytes a token.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import input_bytes, release, shared_path, slices
from quillon.llm.encoding import read_file
from quillon.llm.library import LibraryEncoder

MAGIC, BLOCK = b"QTB2", 1 << 14
HEAD = struct.Struct("<4sIQQQQ")
#: Ranges of doc_id at most; a range of more bytes makes more shards.
MOST_RANGES = 20_000
MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, first_doc long, last_doc long"


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_shard(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray, width: int, n_null: int = 0) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]) if blocks else np.zeros(1)
    head = HEAD.pack(MAGIC, width, len(doc_ids), n_null, len(ids), len(blocks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), np.cumsum(lens).astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Shard:
    """Random access to a shard file's bytes."""

    def __init__(self, data: bytes):
        magic, self.width, n_docs, self.n_null, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of packed token ids")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.ends = np.frombuffer(data, "<u8", n_docs, at := at + 8 * n_docs).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * n_docs).astype(np.int64)
        self.data, self.base = data, at + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK + 1
        parts = [unpack(self.data[self.base + self.blocks[k] : self.base + self.blocks[k + 1]], self.width, min(BLOCK, self.n_ids - k * BLOCK)) for k in range(a, b)]
        return np.concatenate(parts)[start - a * BLOCK : stop - a * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


@lru_cache(1)
def library_encoder(spec: str) -> LibraryEncoder:
    """One for a Python worker, with its cache."""
    return LibraryEncoder(spec)


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encode every text with the tokenizers library, append end_id, write shards in ascending doc_id order.

    Returns the manifest (MANIFEST), one row a shard, committed in `folder`/manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    spec = spark.sparkContext.broadcast(read_file(path))
    docs = docs.select("doc_id", "text")
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * input_bytes(docs) // shard_bytes)))
    # Bounds from a scan of doc_id alone: a range exchange of the encoded rows would sample, and so encode, twice.
    probs = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", probs, 10 * n)).first()[0] if n > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(spec.value)
        for part, texts in slices(batches):
            got = [x.tobytes() for x in encoder.encode(texts)]
            ids = part.column("doc_id")
            shard = np.searchsorted(bounds, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(got, pa.binary())], names=["shard", "doc_id", "ids"])

    vocabulary = library_encoder(spec.value).vocabulary
    width, kind = width_of(max(vocabulary, end_id + 1)), "<u2" if vocabulary <= 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()
    row = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lens: list = []
        parts: list = []
        held = 0

        def close() -> pa.RecordBatch:
            to, root = fs.FileSystem.from_uri(f"{folder}/data")
            to.create_dir(root, recursive=True)
            name = f"shard-{shard:06d}-{part:06d}-{uuid.uuid4().hex}.qtb"
            n_null = sum(d is None for d in doc_ids)
            own = np.array([d or 0 for d in doc_ids], np.int64)
            with to.open_output_stream(f"{root}/{name}") as f:
                f.write(write_shard(own, np.array(lens), np.frombuffer(b"".join(parts), kind), width, n_null))
            out = [shard, part, f"{folder}/data/{name}", len(own), sum(lens), doc_ids[0], doc_ids[-1]]
            for x in (doc_ids, lens, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, row, strict=True)], schema=row)

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(d)
                parts.append(x + end)
                lens.append(len(parts[-1]) // len(end))
                held += len(parts[-1])
                if held >= shard_bytes:
                    yield close()
                    held, part = 0, part + 1
        if lens:
            yield close()

    rows = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    release(spark)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, emit, schema: str) -> DataFrame:
    """emit(start, Shard) -> record batches, for every shard of a manifest; start counts the ids of all shards before.

    The running sum is over shards (of some tens of MB, so some thirty rows a GB of ids), not documents. Files are read by Spark's own
    binary reader, so any store that Spark reads will do.
    """
    spark = manifest.sparkSession
    rows = [r for r in manifest.orderBy("shard", "part").select("path", "n_ids").toLocalIterator()]
    if not rows:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0, *[r["n_ids"] for r in rows]])
    start_of = {r["path"].rpartition("/")[2]: int(s) for r, s in zip(rows, starts, strict=False)}
    folder = rows[0]["path"].rpartition("/")[0]
    names = spark.sparkContext.broadcast(start_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                start = names.value.get(path.rpartition("/")[2])
                if start is not None:  # else of an attempt that was not committed
                    yield from emit(start, Shard(content.as_py()))

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, schema)


def token_file_report(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def emit(start: int, shard: Shard) -> Iterator[pa.RecordBatch]:
        ids = shard.ids(0, shard.n_ids).astype("<u4")
        begins = np.concatenate([[0], shard.ends[:-1]])
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
        null = np.arange(len(begins)) < shard.n_null
        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), mask=null), pa.array(begins + start), pa.array(shard.ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_files(manifest, emit, "doc_id long, start long, n_tokens long, ids_crc32 long")


__all__ = ["Shard", "pack", "read_token_files", "token_file_report", "unpack", "width_of", "write_shard", "write_token_files"]
