"""BPE encoding and decoding (segment tree), token counts (rank-synchronous arrays).

Both work on a word-end BPE file of the `tokenizers` library, given by its path and sent to the executors as
a broadcast of the file's text (a vocabulary's size does not grow with the data). They are narrow: no
shuffle, one pass. Memory: a slice of texts (a longer text goes by parts of a slice's size, cut before white
space), a cache of `CACHE` chunks, the ids of the longest text, and some 50 bytes a byte of the longest word.
Null text counts as empty. An empty table gives no rows. Rows are independent, so repeated rows, ties and
columns other than doc_id and text have no effect; other columns of the input are not carried, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.bpe import WordBpe, word_bpe
from quillon.llm.common import SLICE_BYTES, TwoGenerations, slices

CACHE = 300_000


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def parts(raw: bytes, most: int) -> list[bytes]:
    """A text in parts of about `most` bytes, each cut before a space or line end: no pre-token, special string or composed character goes over one."""
    if len(raw) <= most:
        return [raw]
    out, at = [], 0
    while len(raw) - at > most:
        end = max(raw.rfind(b" ", at + 1, at + most), raw.rfind(b"\n", at + 1, at + most))
        if end < 0:
            ends = [e for e in (raw.find(b" ", at + most), raw.find(b"\n", at + most)) if e >= 0]
            if not ends:
                break
            end = min(ends)
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def batched(texts: list[bytes], most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first text, one beyond the last, texts or, of one long text, a part), in order."""
    first = 0
    for i, raw in enumerate(texts):
        if len(raw) > most:
            if i > first:
                yield first, i, texts[first:i]
            first = i + 1
            for p in parts(raw, most):
                yield i, i + 1, [p]
    if first < len(texts):
        yield first, len(texts), texts[first:]


def _cut(bpe: WordBpe, texts: list[bytes]) -> tuple[list[list], set]:
    """Each text as chunks, pre-tokens and special ids; the distinct ones."""
    docs = [bpe.cut(raw.decode("utf-8", "replace")) for raw in texts]
    seen: set = set()
    for own in docs:
        seen.update(own)
    return docs, seen


def _words(bpe: WordBpe, chunks: list) -> tuple[list[str], list[list[str]]]:
    """The distinct pre-tokens of the chunks, and each chunk's own."""
    own = [list(c) if isinstance(c, tuple) else bpe.pre_tokens(c) for c in chunks]
    return list({w for ws in own for w in ws}), own


class Encoder:
    """Chunk -> (ids as little-endian uint32 bytes), by segment tree; decode() is the inverse map on ids."""

    def __init__(self, spec: str):
        self.bpe = word_bpe(spec)
        self.ids: TwoGenerations = TwoGenerations(CACHE)
        self.names = {i: s.encode() for i, s in self.bpe.names.items()}

    def learn(self, seen: set) -> None:
        absent = self.ids.missing(seen)
        chunks = [c for c in absent if not isinstance(c, int)]
        words, own = _words(self.bpe, chunks)
        got = {w: a.astype("<u4").tobytes() for w, a in zip(words, self.bpe.segment_tree_merge(words), strict=True)} if words else {}
        for c, ws in zip(chunks, own, strict=True):
            b = b"".join([got[w] for w in ws])
            self.ids[c] = (b, self.decode(np.frombuffer(b, "<u4")))
        for c in absent:
            if isinstance(c, int):
                self.ids[c] = (np.uint32(c).astype("<u4").tobytes(), self.names[c])

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library does without a decoder: the symbols' strings, joined by spaces."""
        names = self.names
        return b" ".join([names[i] for i in ids.tolist()])

    def encode(self, texts: list[bytes], most: int = SLICE_BYTES) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text. Decoding is joined chunk by chunk: it maps each id on its own."""
        ids: list[list[bytes]] = [[] for _ in texts]
        decoded: list[list[bytes]] = [[] for _ in texts]
        for first, end, some in batched(texts, most):
            docs, seen = _cut(self.bpe, some)
            self.learn(seen)
            get = self.ids.__getitem__
            for i, own in zip(range(first, end), docs, strict=True):
                got = list(map(get, own))
                ids[i].append(b"".join([a for a, _ in got]))
                if got:
                    decoded[i].append(b" ".join([b for _, b in got]))
        return [(b"".join(a), b" ".join(b)) for a, b in zip(ids, decoded, strict=True)]


@lru_cache(1)
def encoder_of(spec: str) -> Encoder:
    """One for a Python worker: what it has learned serves the worker's later tasks too."""
    return Encoder(spec)


@lru_cache(1)
def counts_of(spec: str) -> TwoGenerations:
    return TwoGenerations(2 * CACHE)


def _encoded(spec, columns: list[str], emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for part, texts in slices(batches):
            got = emit(encoder.encode(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *got.values()], names=[*columns, *got])

    return run


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) of every text, with add_special_tokens off."""
    spec = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def emit(rows):
        ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in rows]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([b.decode("utf-8", "replace") for _, b in rows], pa.string())}

    return docs.select("doc_id", "text").mapInArrow(_encoded(spec, ["doc_id"], emit), "doc_id long, ids array<int>, decoded string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of bpe_encode's output, digested where it is made."""
    spec = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def emit(rows):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"n_tokens": pa.array([len(a) // 4 for a, _ in rows], pa.int64()), "ids_sha256": pa.array([sha(a) for a, _ in rows], pa.string()), "decoded_sha256": pa.array([sha(b) for _, b in rows], pa.string())}

    return docs.select("doc_id", "text").mapInArrow(_encoded(spec, ["doc_id"], emit), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = word_bpe(spec.value), counts_of(spec.value)
        for part, texts in slices(batches):
            n = np.zeros(len(texts), np.int64)
            for first, end, some in batched(texts, SLICE_BYTES):
                docs_, seen = _cut(bpe, some)
                absent = counts.missing(seen)
                chunks = [c for c in absent if not isinstance(c, int)]
                words, own = _words(bpe, chunks)
                got = dict(zip(words, bpe.rank_synchronous_count(words).tolist(), strict=True)) if words else {}
                counts.update((c, sum([got[w] for w in ws])) for c, ws in zip(chunks, own, strict=True))
                counts.update((c, 1) for c in absent if isinstance(c, int))
                get = counts.__getitem__
                n[first:end] += [sum(map(get, o)) for o in docs_]
            n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
