"""Removal of repeated words (20-word windows) and repeated bytes (50-byte strings).

Both judge windows on the input. Null texts count as empty; texts shorter than a window lose nothing. Repeated
rows (one doc_id and text) are one document: all stay, or lose the same. Rows of one doc_id with different
texts are, for words, different occurrences of which one stays; for bytes neither is the smaller. Rows without
doc_id lose nothing and remove nothing. An empty table gives no rows. Only doc_id and text are read, whatever
other columns are called (replace_repeated_words carries them). Memory of the longest text: some 30 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm.automaton import SHARD_WORDS, reference_spans
from quillon.llm.common import release, slices
from quillon.llm.repeats import Bytes, Words, join_spans, kept_mask, repeated_spans, span_lists, span_table, text_key


def words_unit(window: int = 20) -> Words:
    return Words(window, max(1, window * 3 // 10))


def bytes_unit(window: int = 50) -> Bytes:
    return Bytes(window, max(8, window // 3))


def _apply(docs: DataFrame, spans: DataFrame, cut, names: list[str], schema: str) -> DataFrame:
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = [cut(t, s) for t, s in zip(texts, span_lists(part.column("spans")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return join_spans(docs, spans).select("doc_id", "text", "spans").mapInArrow(run, schema)


def remaining_words(text: bytes, spans: np.ndarray | None) -> tuple[list[bytes], int]:
    words = text.split()
    keep = kept_mask(spans, len(words))
    return (words, len(words)) if keep is None else ([words[i] for i in np.flatnonzero(keep).tolist()], len(words))


def remove_repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, text: the words left, joined by one space where any was removed; other texts are unchanged (null: empty)."""

    def cut(text: bytes, spans: np.ndarray | None) -> tuple[str]:
        words, n = remaining_words(text, spans)
        return ((text if len(words) == n else b" ".join(words)).decode("utf-8", "replace"),)

    return _apply(docs, repeated_spans(docs, words_unit(window), True), cut, ["doc_id", "text"], "doc_id long, text string")


def remove_reference_words(docs: DataFrame, reference: DataFrame, window: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text: without the words under windows that stand in a text of the reference (broadcast suffix automata)."""

    def cut(text: bytes, spans: np.ndarray | None) -> tuple[str]:
        words, n = remaining_words(text, spans)
        return ((text if len(words) == n else b" ".join(words)).decode("utf-8", "replace"),)

    return _apply(docs, reference_spans(docs, reference, window, shard_words), cut, ["doc_id", "text"], "doc_id long, text string")


def repeated_words_digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (words left, joined by one space)."""

    def cut(text: bytes, spans: np.ndarray | None) -> tuple[int, int, str]:
        words, n = remaining_words(text, spans)
        return n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()

    return _apply(docs, repeated_spans(docs, words_unit(window), True), cut, ["doc_id", "n_words", "n_removed", "kept_sha256"], "doc_id long, n_words long, n_removed long, kept_sha256 string")


def replace_repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with the words left as text, in the same columns; documents that lose all their words go.

    Other columns stay beside their text; n_chars, where there is one, counts the new text where words went.
    Documents that had no word stay, and null texts stay null.
    """
    spans = repeated_spans(docs, words_unit(window), True)
    release(docs.sparkSession)
    own, names = span_table(spans), docs.columns
    rows = docs.withColumn("__key", text_key()).join(own.withColumnsRenamed({"key": "__key", "spans": "__spans"}), ["doc_id", "__key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            new, keep, cut = [], [], []
            spans_of = span_lists(part.column("__spans"))
            for t, s, ok in zip(texts, spans_of, part.column("text").is_valid().to_pylist(), strict=True):
                words, n = remaining_words(t, s) if s is not None else ([], 0)
                keep.append(s is None or len(words) > 0)
                cut.append(s is not None and len(words) < n)
                new.append(None if not ok else (b" ".join(words) if cut[-1] else t).decode("utf-8", "replace"))
            changed = {"text": pa.array(new, pa.string())}
            if "n_chars" in names:
                kind = part.schema.field("n_chars").type
                changed["n_chars"] = pc.if_else(pa.array(cut), pa.array([len(x or "") for x in new], kind), part.column("n_chars"))
            columns = [changed[c] if c in changed else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return rows.select(*names, "__spans").mapInArrow(run, docs.schema)


def remaining_bytes(text: bytes, spans: np.ndarray | None) -> tuple[bytes, int]:
    """The bytes left, and the number of maximal removed runs."""
    keep = kept_mask(spans, len(text))
    if keep is None:
        return text, 0
    gone = ~keep
    return np.frombuffer(text, np.uint8)[keep].tobytes(), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def remove_repeated_bytes(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, kept (binary): the bytes left. A character may lose some of its bytes, so this is no string."""

    def cut(text: bytes, spans: np.ndarray | None) -> tuple[bytes]:
        return (remaining_bytes(text, spans)[0],)

    return _apply(docs, repeated_spans(docs, bytes_unit(window), False), cut, ["doc_id", "kept"], "doc_id long, kept binary")


def repeated_bytes_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""

    def cut(text: bytes, spans: np.ndarray | None) -> tuple[int, int, int, str]:
        kept, runs = remaining_bytes(text, spans)
        return len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()

    return _apply(docs, repeated_spans(docs, bytes_unit(window), False), cut, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
