"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features come from its own characters and words and from those
of the lines before and after it; the field's pair weights tie neighbouring labels. A document's score is
the mean of its lines' marginal probabilities of "good" (forward-backward), weighted by their lengths.

Training: labelled documents are taken in the order of a hash of their doc_id up to `most` documents and
`most_total` lines (documented bounds; the model has some 300 weights), those of over `most_lines` lines
passed over; each line is given its document's label, and the weights maximise the penalised likelihood of
the label sequences. Scoring covers all documents, whole.

Null texts count as empty, an empty text as one empty line; labels that are null, repeated or of unknown
documents do no harm. With no labels of one of the two kinds all weights are 0. Repeated rows are scored each;
an empty table gives no rows. Only doc_id and text are read, so other columns, labels among them, have no
effect whatever their names (drop_low_quality carries them). A long text is read by blocks of lines: memory is
some 200 bytes a line and 10 a byte of the longest text; its chain is run by blocks too (`chain`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices
from quillon.llm.repeats import byte_hashes, word_edges

STEPS = np.array([0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75])
CLASSES = [
    lambda b: (b >= 65) & (b <= 90),
    lambda b: (b >= 97) & (b <= 122),
    lambda b: (b >= 128),
    lambda b: (b >= 48) & (b <= 57),
    lambda b: np.isin(b, list(b"$%&*#@^~=+<>{}[]\\_")),
    lambda b: b == ord("|"),
    lambda b: b == ord("!"),
    lambda b: np.isin(b, list(b".,;:?")),
]
MASKS = [c(np.arange(256)) for c in CLASSES]


#: Features of a line by itself.
OWN = len(STEPS) * (len(CLASSES) + 7) + 7
#: Bytes and lines of texts that are made into features at once; a text of more lines is run by `chain`.
BLOCK_BYTES, BLOCK_LINES = 1 << 20, 1 << 14


@dataclass
class Lines:
    """The lines of some texts: where each is in `data`, and which occur again in their own text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    per_text: np.ndarray
    again: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Lines:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        per_text = np.diff(np.searchsorted(ends, text_ends), prepend=0)
        hashes = byte_hashes(data, starts, ends - starts)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), per_text)
        by = np.lexsort((hashes, text))
        equal = (hashes[by][1:] == hashes[by][:-1]) & (text[by][1:] == text[by][:-1])
        again = np.zeros(len(ends), bool)
        again[by[1:]] |= equal
        again[by[:-1]] |= equal
        return Lines(data, starts, ends, per_text, again & (ends > starts))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a line is the first, and the last, of its text."""
        first, last = np.zeros(len(self.ends), bool), np.zeros(len(self.ends), bool)
        edge = np.cumsum(self.per_text)
        first[edge - self.per_text], last[edge - 1] = True, True
        return first, last

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of lines of at most BLOCK_LINES lines and about BLOCK_BYTES bytes, one line at least."""
        i = 0
        while i < len(self.ends):
            j = int(np.searchsorted(self.ends, self.starts[i] + BLOCK_BYTES))
            j = min(max(j, i + 1), i + BLOCK_LINES, len(self.ends))
            yield i, j
            i = j

    def own(self, i: int, j: int) -> np.ndarray:
        """Features of lines i .. j - 1 by themselves: (j - i, OWN), 0 or 1."""
        data = self.data[self.starts[i] : self.ends[j - 1] + 1]
        starts, ends = self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i]
        n = j - i
        length = ends - starts
        size = np.maximum(length, 1)
        word_starts, _, words = word_edges(data)
        line = np.searchsorted(ends, word_starts)
        n_words = np.bincount(line, minlength=n)
        per_word = np.maximum(n_words, 1)

        def same(d: int) -> np.ndarray:
            hit = (words[d:] == words[:-d]) & (line[d:] == line[:-d])
            return np.bincount(line[d:][hit], minlength=n) / per_word

        shares = []
        for m in MASKS:
            count = np.concatenate([[0], np.cumsum(m[data], dtype=np.int32)])
            shares.append((count[ends] - count[starts]) / size)
        shares += [same(1), same(2), same(3), self.again[i:j], shares[5] * size / per_word, shares[6] * size / per_word, shares[4] * size / per_word]
        steps = (np.stack(shares, 1)[:, :, None] > STEPS).reshape(n, -1)
        sizes = np.stack([length == 0, length < 20, length < 80, length < 400, n_words <= 1, size / per_word > 9, size / per_word > 14], 1)
        return np.concatenate([steps, sizes], 1).astype(np.float32)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length) of each line, and lines a text: a constant, its own, those of the lines before and after, first, last."""
    lines = Lines.of(texts)
    base = np.concatenate([lines.own(i, j) for i, j in lines.blocks()]) if len(lines.ends) else np.zeros((0, OWN), np.float32)
    first, last = lines.edges()
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(base), 1), np.float32), base, before, after, first[:, None], last[:, None]], 1), lines.ends - lines.starts, lines.per_text


def chain(node: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward messages of one long chain, each normalised: a[0] = node[0], a[t] = (a[t - 1] @ move) * node[t].

    By blocks of about the square root of its length: the product of each block's steps, all blocks at once; the
    message into each block, one by one; then all blocks' messages at once.
    """
    n = len(node)
    size = max(1, int(np.ceil(np.sqrt(n))))
    m = -(-n // size)
    wide = np.ones((m * size, 2))
    wide[:n] = node
    wide = wide.reshape(m, size, 2)

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / np.maximum(x.sum(axes, keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(2), (m, 2, 2)).copy()
    for s in range(size):
        product = scaled((product @ move) * wide[:, s, None, :], (1, 2))
    into = np.ones((m, 2))
    first = scaled(wide[0, 0], 0)
    a = first
    for s in range(1, size):
        a = scaled((a @ move) * wide[0, s], 0)
    for b in range(1, m):
        into[b] = a
        a = scaled(a @ product[b], 0)
    out = np.empty_like(wide)
    a = into
    for s in range(size):
        a = scaled((a @ move) * wide[:, s], 1)
        if not s:
            a[0] = first
        out[:, s] = a
    return out.reshape(-1, 2)[:n]


@dataclass
class Field:
    weights: np.ndarray  # of good against bad
    pairs: np.ndarray  # [label, next label]

    def potentials(self, lines: Lines) -> np.ndarray:
        """x @ weights for the features x of lines, made block by block."""
        w = self.weights
        sides = np.ascontiguousarray(w[1 : 1 + 3 * OWN].reshape(3, OWN).T)
        parts = [lines.own(i, j) @ sides for i, j in lines.blocks()]
        own = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, 3))
        first, last = lines.edges()
        u = w[0] + own[:, 0] + w[-2] * first + w[-1] * last
        u[1:] += np.where(first[1:], 0, own[:-1, 1])
        u[:-1] += np.where(last[:-1], 0, own[1:, 2])
        return u

    def marginals(self, x: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected pair counts over all texts."""
        return self.forward_backward((x @ self.weights).astype(np.float64), per_text)

    def long_chain(self, u: np.ndarray) -> np.ndarray:
        """P(good) of each line of one text, by `chain` in both directions."""
        good = 0.5 * (1 + np.tanh(u / 2))
        node = np.stack([1 - good, good], 1)
        move = np.exp(self.pairs - self.pairs.max())
        p = chain(node, move)
        p[:-1] *= chain(node[::-1], move.T)[::-1][1:] @ move.T
        return p[:, 1] / np.maximum(p.sum(1), 1e-300)

    def forward_backward(self, u: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = 0.5 * (1 + np.tanh(u / 2))
        node = np.stack([1 - good, good], 1)
        move = np.exp(self.pairs - self.pairs.max())
        order = np.argsort(-per_text, kind="stable")
        starts = (np.cumsum(per_text) - per_text)[order]
        lens = per_text[order]
        live = np.searchsorted(-lens, -np.arange(int(lens.max(initial=0))), "left")  # texts of more than t lines
        alpha, beta = np.ones((len(u), 2)), np.ones((len(u), 2))
        counts = np.zeros((2, 2))
        for t, m in enumerate(live):
            at = starts[:m] + t
            a = node[at] if not t else (alpha[at - 1] @ move) * node[at]
            alpha[at] = a / np.maximum(a.sum(1, keepdims=True), 1e-300)
        for t in range(len(live) - 1, 0, -1):
            at = starts[: live[t]] + t
            ahead = beta[at] * node[at]
            joint = alpha[at - 1][:, :, None] * move * ahead[:, None, :]
            counts += (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)
            b = ahead @ move.T
            beta[at - 1] = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
        p = alpha * beta
        return p[:, 1] / np.maximum(p.sum(1), 1e-300), counts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text; some texts at a time, a text of many lines alone."""
        out = []
        for group in by_lines(texts):
            lines = Lines.of(group)
            u = self.potentials(lines)
            p = self.long_chain(u) if len(u) > BLOCK_LINES and len(group) == 1 else self.forward_backward(u, lines.per_text)[0]
            weight = lines.ends - lines.starts + 1e-6  # a text of empty lines only: their plain mean
            at = np.cumsum(lines.per_text) - lines.per_text
            out.append(np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 0, 1))
        return np.concatenate(out) if out else np.zeros(0)


def by_lines(texts: list[bytes], most: int | None = None) -> Iterator[list[bytes]]:
    """texts in groups of at most `most` (BLOCK_LINES) lines, one text at least."""
    group: list[bytes] = []
    size, most = 0, most or BLOCK_LINES
    for t in texts:
        n = t.count(b"\n") + 1
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


def fit(x: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximise the penalised likelihood by Adam on the whole sample."""
    field = Field(np.zeros(x.shape[1], np.float32), np.zeros((2, 2)))
    if not len(labels) or labels.min() == labels.max():
        return field
    line = np.repeat(labels, per_text).astype(np.float64)
    seen = np.zeros((2, 2))
    for y in (0, 1):
        seen[y, y] = (per_text[labels == y] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    first, second, n = np.zeros_like(theta), np.zeros_like(theta), len(labels)
    for k in range(1, steps + 1):
        p, counts = field.marginals(x, per_text)
        slope = np.concatenate([x.T @ (line - p).astype(np.float32), (seen - counts).ravel()]) / n - penalty * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        field = Field(theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2))
    return field


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 5, is 0 (false for no doc_id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, most_lines: int = 400, most_total: int = 100_000) -> Field:
    """A field fitted to at most `most` labelled documents that are not held out, and `most_total` lines.

    What comes to the driver is at most most x most_lines lines of 43 bytes.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded sample, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
            body: list = [None] * len(texts)
            few = np.flatnonzero(per_text <= most_lines).tolist()
            at = 0
            for group in by_lines([texts[i] for i in few]):
                x, _, sizes = line_features(group)
                packed = np.packbits(x.astype(bool), axis=1)
                for i, own in zip(few[at : at + len(group)], np.split(packed, np.cumsum(sizes)[:-1]), strict=True):
                    body[i] = own.tobytes()
                at += len(group)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(per_text), pa.array(body, pa.binary())], names=["doc_id", "quality", "n", "x"])

    found = rows.mapInArrow(extract, "doc_id long, quality int, n long, x binary").where("x is not null").toPandas()
    found["at"] = [zlib.crc32(str(d).encode()) for d in found.doc_id]
    found = found.sort_values(["at", "doc_id", "n", "quality"], kind="stable")
    found = found[found.n.cumsum() <= most_total]
    width = line_features([b""])[0].shape[1]
    raw = np.frombuffer(b"".join(map(bytes, found.x)), np.uint8).reshape(-1, -(-width // 8))
    x = np.unpackbits(raw, axis=1, count=width).astype(np.float32)
    return fit(x, found.n.to_numpy(np.int64), found.quality.to_numpy(np.int64))


def score(docs: DataFrame, field: Field, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= cut, else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            s = field.scores(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, labelled: DataFrame | None = None) -> DataFrame:
    """docs whose score is at least cut, scored and filtered in one pass, with the columns of docs. labelled: the labels' texts."""
    field = train(docs if labelled is None else labelled, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield part.filter(pa.array(field.scores(texts) >= cut))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["Field", "drop_low_quality", "fit", "line_features", "score", "train"]
