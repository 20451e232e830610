"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

Texts are compared in lower case with runs of white space as one space. An item of L characters may be
matched with at most k = floor(rate x L) edits, by any substring of a document. It is cut into k + 1 pieces,
of which one must occur unchanged; an automaton over all pieces finds the hits in one pass over a document,
windows around them are held against the q-gram lemma (which loses no match), and the rest are verified.

Null or empty items match nothing; null texts are empty; repeated rows, of documents and items, are reported
each; of several places the one of least distance, then the first, is reported. Empty tables, of either, give
no rows. Only doc_id, text, item_id are read, whatever other columns are called. A text of any length is
searched whole, in some ten bytes of memory a character.

The benchmark is dealt into blocks of about BROADCAST_BYTES by a hash; one block at a time comes to the driver
and is broadcast, for one pass over the documents. All benchmarks known fit one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, slices

#: Items are sent to the executors in blocks of at most so many bytes; more blocks mean more passes.
BROADCAST_BYTES = 16 << 20
Q = 5
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least distance, its first end) of a pattern of m characters over the substrings of text; anchored: over its prefixes."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    carry = 1 if anchored else 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.items, pieces = [], defaultdict(list)
        for item, raw in rows:
            text = normal(raw or "")
            if not text:
                continue
            n, k = len(text), int(rate * len(text))
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[text[a:b]].append((len(self.items), a, b))
            grams = {text[i : i + Q] for i in range(n - Q + 1)}
            self.items.append((item, text, k, masks(text), masks(text[::-1]), grams))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, where)
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item hit, merged windows of the text that hold all its matches."""
        found: dict[int, list[list[int]]] = {}
        for last, where in self.automaton.iter(text):
            for i, a, b in where:
                n, k = len(self.items[i][1]), self.items[i][2]
                begin = last + 1 - b
                lo, hi = max(0, begin - k), begin + n + k
                own = found.setdefault(i, [])
                if own and lo <= own[-1][1] and lo >= own[-1][0]:
                    own[-1][1] = max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        return found

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item that the normalised text holds within its budget."""
        out = []
        for i, spans in self.windows(text).items():
            item, pattern, k, peq, reverse, grams = self.items[i]
            n = len(pattern)
            least = len(grams) - k * Q  # distinct q-grams that k edits leave
            best = None
            for lo, hi in spans:
                window = text[lo:hi]
                if least > 0:
                    left = len(grams) - least
                    missing = 0
                    for g in grams:
                        if g not in window:
                            missing += 1
                            if missing > left:
                                break
                    if missing > left:
                        continue
                distance, end = myers(peq, n, window)
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, lo, end)
            if best:
                distance, lo, end = best
                _, back = myers(reverse, n, text[max(lo, lo + end - n - k) : lo + end][::-1], anchored=True)
                out.append((item, distance, lo + end - back, lo + end))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """doc_id, item_id, distance, start, end (characters of the normalised text): items found in documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n_blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BROADCAST_BYTES)
    out = None
    for b in range(max(1, n_blocks)):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks))) == b)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]  # some BROADCAST_BYTES
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, rate)
            for part, texts in slices(batches):
                found = []
                for d, raw in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    if not items.empty:
                        found += [(d, *m) for m in items.match(normal(raw.decode("utf-8", "replace")))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=FOUND)

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        if n_blocks > 1:  # the next block replaces this one
            part = materialize(part, "found")
            sent.destroy()
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """docs without those that hold an item; rows without doc_id stay."""
    return docs.join(contaminated(docs, benchmark, rate).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
