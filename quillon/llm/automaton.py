"""Passages of a reference collection, removed from documents by broadcast suffix automata.

The reference is cut into shards of at most SHARD_WORDS words. A shard's generalised suffix automaton is built
once, broadcast, and the documents are streamed through it: at each word it gives the length of the longest
match that ends there (the matching statistics), and words under a match of `window` words or more go. Each
shard is one pass over the documents, so memory is bounded whatever the reference's size, and passes grow with
the reference. That suits references that are small beside the corpus (licence texts, benchmarks, a blocklist);
for the corpus against itself see repeats.py.

Null texts are empty; texts shorter than a window lose nothing; an empty reference removes nothing; rows of the
reference may repeat. Only doc_id and text are read of the documents, and text of the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices
from quillon.llm.repeats import SPAN, keyed, spans_batch

#: A state takes some 300 bytes and there are at most two a word: 120 MB a shard on an executor's worker.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """Of several sequences; its states' substrings are just those of some sequence."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for the shorter substrings that p leads to."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence had this
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def matching(self, words: list[bytes]) -> np.ndarray:
        """At each word, the length of the longest substring of a sequence that ends there."""
        out = np.zeros(len(words), np.int64)
        nexts, link, length, state, n = self.next, self.link, self.length, 0, 0
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                n = length[state]
            to = nexts[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out[i] = n
        return out

    def spans(self, words: list[bytes], window: int) -> list[tuple[int, int]]:
        """Maximal spans of words under matches of at least `window` words."""
        found: list[tuple[int, int]] = []
        m = self.matching(words)
        for i in np.flatnonzero(m >= window).tolist():
            lo, hi = i + 1 - int(m[i]), i + 1
            if found and lo <= found[-1][1]:
                found[-1] = (min(lo, found[-1][0]), hi)
            else:
                found.append((lo, hi))
        return found


def shards(reference: DataFrame, most: int) -> Iterator[list[list[bytes]]]:
    """The reference's word sequences, in shards of about `most` words, read one partition at a time.

    A text of more words than a shard holds is cut into parts that overlap by a window of `most` // 2 words.
    """
    own: list[list[bytes]] = []
    size = 0
    for row in reference.select("text").where("text is not null").distinct().toLocalIterator():
        words = row["text"].encode().split()
        step = max(1, most // 2)
        for k in range(0, max(1, len(words) - step if len(words) > most else 1), step):
            part = words[k : k + most] if len(words) > most else words
            if size and size + len(part) > most:
                yield own
                own, size = [], 0
            own.append(part)
            size += len(part)
    if own:
        yield own


def reference_spans(docs: DataFrame, reference: DataFrame, window: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, key, lo, hi: spans of words that stand in the reference, for repeats.join_spans."""
    if shard_words < 2 * window:
        raise ValueError("a shard must hold two windows")
    spark = docs.sparkSession
    rows, out = keyed(docs), None
    for shard in shards(reference, shard_words):
        automaton = SuffixAutomaton()
        for words in shard:
            automaton.add(words)
        sent = spark.sparkContext.broadcast((automaton.next, automaton.link, automaton.length))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = SuffixAutomaton()
            own.next, own.link, own.length = sent.value
            for part, texts in slices(batches):
                ids, keys = part.column("doc_id").to_pylist(), part.column("key").to_pylist()
                found = [(d, k, lo, hi) for d, k, t in zip(ids, keys, texts, strict=True) for lo, hi in own.spans(t.split(), window)]
                if found:
                    yield spans_batch(*zip(*found, strict=True))

        part = rows.mapInArrow(run, SPAN)
        out = part if out is None else out.union(part)
    return rows.select("doc_id", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi")).limit(0) if out is None else out
