"""Repeated windows of a corpus, found exactly from sampled anchors.

A window is T consecutive symbols of one document (words, or bytes). An anchor is a K-symbol run whose hash
is least (leftmost of equals) among the runs of some window. Equal windows have the same anchor at the same
place, and every window has one, so it is enough to look at windows around anchors that occur twice; anchors
are some 2 / (T - K + 2) of all positions.

1. `survey`: each anchor stands for the windows whose least run it is, a range of starts. It is sent with a
   hash of its context (the text of those windows), by the anchor's hash. An anchor whose context occurs
   earlier is covered with its whole context. Copies within a batch of documents are settled there, and only
   the first goes on, so a passage in a third of all documents costs one row a batch. The windows of a first
   context fall into CLASSES by their anchor's place in them; those of a class share a core, and are only
   asked for if that core occurs at that anchor in other contexts too.
2. `settle`: of those, the windows themselves are compared: dealt by the window's digits, ordered by
   most-significant-digit radix passes to depth T; equal groups are the repeated windows.
3. `join_spans`: spans meet their documents, by doc_id and a hash of the text, as repeated doc_ids may hold
   different texts.

Results of 1 and 2 are written to the shared folder. No task holds all rows of a hot anchor or window: rows
that are not the first of theirs go out whenever MEET of them are held, by map tasks before the shuffle too.
Where more than that remain (an anchor in distinct contexts everywhere), the anchors' windows are all asked
for, which is more work for step 2 and the same result. Besides, memory is some 30 bytes a byte of the longest
text, a batch of anchors and the distinct windows of a shuffle partition, whose number follows the input.

What decides equality: bytes of windows, compared whole; words by 64-bit hashes (one to one for words of up to 8
bytes of one length), 20-word windows by 128 bits of those; contexts within a bucket by 96 bits. These hashes
aren't linear in the text, so no pattern of letters cancels out; by chance, 100 TB would hold some 1e-9 false
contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions_for, slices

U = np.uint64
LOW24 = U((1 << 24) - 1)
#: Positions searched for anchors at once, and anchors held before they are sent.
BLOCK, HOLD = 1 << 18, 1_000_000
#: Rows that a task holds before it lets go those that are not the first of theirs; windows that a map task holds.
MEET, HOLD_WINDOWS = 3_000_000, 400_000
#: A window's anchor is in one of so many ranges of places.
CLASSES = 4
CLASS_SHIFT = 20
SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
SPAN = "doc_id long, key long, lo int, hi int"
_rng = np.random.default_rng(20_240_607)
TABLE = _rng.integers(1, 1 << 64, 256, dtype=U)
ODD = _rng.integers(0, 1 << 63, 512, dtype=U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
#: By the number of bytes that belong to a run, the mask of a little-endian digit.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Runs of up to so many bytes are hashed together; longer ones one by one.
SHORT = 24
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


class Unit:
    """Symbols of a slice of texts, T zeros around each; symbol 0 is never compared as text, since lengths are."""

    passes = 1

    def __init__(self, threshold: int, anchor: int):
        self.T, self.K = threshold, anchor

    def lay(self, values: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """values with T zeros before each text and after the last; each text's start."""
        starts = np.cumsum(lens + self.T) - lens
        out = np.zeros(int((lens + self.T).sum()) + 2 * self.T + 8, values.dtype)
        ends = np.cumsum(lens).tolist()
        for at, n, end in zip(starts.tolist(), lens.tolist(), ends, strict=True):
            out[at : at + n] = values[end - n : end]
        return out, starts


class Bytes(Unit):
    passes, step, share = 2, 8, 5 << 20  # what is sent is some three times the text

    def digit(self, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The next `step` symbols from each place as one number, those beyond `size` as 0."""
        view = np.lib.stride_tricks.as_strided(symbols, (len(symbols) - 7, 8), (1, 1))
        return np.ascontiguousarray(view[at]).view("<u8").ravel() & KEEP[np.clip(size, 0, 8)]

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        return *self.lay(np.frombuffer(b"".join(texts), np.uint8), lens), lens

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return TABLE[symbols]

    def digits(self, symbols: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
        """The `length` bytes from each place, as big-endian 8-byte digits, most significant first (the last may overlap)."""
        view = np.lib.stride_tricks.as_strided(symbols, (len(symbols) - 7, 8), (1, 1))
        steps = sorted({*range(0, length - 7, 8), max(0, length - 8)})
        return [np.ascontiguousarray(view[at + s]).view(">u8").ravel().astype(U) for s in steps]


class Words(Unit):
    step, share = 1, 16 << 20

    def digit(self, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, symbols[at], U(0))

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, lens = word_hashes(texts)
        return *self.lay(hashes, lens), lens

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return symbols

    def digits(self, symbols: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
        """Two hashes of the `length` words from each place; a word is a 64-bit hash already."""
        a, b = np.zeros(len(at), U), np.zeros(len(at), U)
        for s in range(length):
            x = symbols[at + s]
            a += x * ODD[s]
            b += mix(x) * ODD[511 - s]
        return [mix(a), mix(b)]


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and nonzero 64-bit hashes of the words (maximal runs of bytes other than 0x20, 0x09-0x0D); data ends in a gap."""
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, byte_hashes(data, starts, ends - starts) | U(1)


def chain(h: np.ndarray, digit: np.ndarray, odd: np.uint64) -> np.ndarray:
    """One to one in each argument, and not linear in either."""
    h = (h ^ digit) * odd
    return h ^ (h >> U(29))


def byte_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes."""
    wide = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(wide, (len(wide) - 7, 8), (1, 1))
    out = sizes.astype(U) * BASE
    for k in range(SHORT // 8):
        rows = np.flatnonzero(sizes > 8 * k)
        digit = np.ascontiguousarray(view[starts[rows] + 8 * k]).view("<u8").ravel() & KEEP[np.minimum(sizes[rows] - 8 * k, 8)]
        out[rows] = chain(out[rows], digit, ODD[k])
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return mix(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and words a text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts, _, words = word_edges(data)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def run_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of the runs of `length` values from each place, by doubling."""
    n = len(x) - length + 1
    out, done, run, width, base = None, 0, x, 1, BASE
    while True:
        if length & width:
            # what is done already, then the next `width` values
            out = run[:n] if out is None else out * base + run[done : done + n]
            done += width
        if 2 * width > length:
            return mix(out)
        run = run[:-width] * base + run[width:]
        base, width = U(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * width


def anchors(unit: Unit, symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in `symbols`, ascending, their hashes, and the first and last start of the windows of each."""
    T, K = unit.T, unit.K
    own = lens >= T
    change = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(change, starts[own], 1)
    np.add.at(change, (starts + lens - T + 1)[own], -1)
    valid = np.cumsum(change[:-1]) > 0  # a window starts here
    parts: list[list[np.ndarray]] = [[], [], [], []]
    w = T - K + 1
    for b in range(0, len(symbols), BLOCK):
        ok = valid[b : b + BLOCK]
        if not ok.any():
            continue
        h = run_hashes(unit.values(symbols[b : b + BLOCK + T]), K)
        key = (h & ~LOW24) | np.arange(len(h), dtype=U)
        low, width = key, 1
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if w > width:
            low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
        window = np.flatnonzero(ok[: len(low)])
        at = (low[window] & LOW24).astype(np.int64)
        first = edges(at)  # leftmost minima never go back
        last = np.append(first[1:], len(at)) - 1
        for part, x in zip(parts, (at[first] + b, h[at[first]], window[first] + b, window[last] + b), strict=True):
            part.append(x)
    if not parts[0]:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U), none, none
    at, h, first, last = (np.concatenate(x) for x in parts)
    rows = edges(at)  # one that two blocks share
    return at[rows], h[rows], first[rows], last[np.append(rows[1:], len(at)) - 1]


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def range_hashes(unit: Unit, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, longest: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ranges of at most `longest` symbols."""
    sizes = end - begin
    out = mix(sizes.astype(U) + U((seed + 1) * int(BASE) & (1 << 64) - 1))
    for k in range(0, longest, unit.step):
        digit = unit.digit(symbols, np.minimum(begin + k, len(symbols) - 8), sizes - k)
        out = chain(out, digit, ODD[256 * seed + k // unit.step])
    return mix(out)


def radix_groups(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by their digits, most significant first, going on only within groups that are still equal.

    Returns (order, group): rows in order, stable within a group, and the number of each one's group. Groups
    are equal in all digits; a row alone in its group needs no further pass.
    """
    n = len(digits[0])
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in `order` that are still in groups of two or more
    for d in digits:
        if not len(open_):
            break
        rows = order[open_]
        by = np.lexsort((d[rows], group[open_])) if group[open_[0]] != group[open_[-1]] else np.argsort(d[rows], kind="stable")
        order[open_] = rows = rows[by]
        g, v = group[open_][by], d[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        first = np.flatnonzero(new)
        group[open_] = open_[first[np.cumsum(new) - 1]]
        size = np.diff(np.append(first, len(rows)))
        open_ = open_[np.repeat(size, size) > 1]
    return order, group


def text_key():
    """31 bits of the text's hash (null: of the empty text)."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), text (null: empty)."""
    return docs.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by (doc, lo), their ends ascending too, with those that touch made one."""
    if not len(doc):
        return doc, lo, hi
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], hi[last]


def spans_batch(doc_ids, keys, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], schema=SPANS)


def later(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, row: np.ndarray, first: np.ndarray, within: bool) -> np.ndarray:
    """Whether a row comes after its group's first: in a larger document or, if within, anywhere else.

    Repeated rows, of one doc_id, text and place, are one occurrence.
    """
    larger = ids[row] > ids[first]
    return larger | (places[row] != places[first]) | (keys[row] != keys[first]) if within else larger


def repeated(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, context: np.ndarray, more: np.ndarray, within: bool) -> np.ndarray:
    """Which rows (by doc_id, place) come after another of the same context and `more`."""
    order = np.argsort(context, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (more[order][1:] != more[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(order), bool)
    out[order] = later(ids, keys, places, order, first, within)
    return out


def firsts(group: np.ndarray) -> np.ndarray:
    """For sorted group numbers, the index of each row's group's first row."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


ROUTED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), *SPANS])


def survey(docs: DataFrame, unit: Unit, within: bool, n: int) -> DataFrame:
    """Spans that anchors settle, and (hi negative) windows from lo on that are to be compared: -hi is their number, with their class above CLASS_SHIFT bits."""

    rest = unit.T - unit.K
    small = np.uint8 if rest < 256 else np.uint16
    # places of the anchor in the windows of each class, from and to
    limits = [c * (rest + 1) // CLASSES for c in range(CLASSES + 1)]
    classes = [(x, y - 1) for x, y in zip(limits, limits[1:], strict=False) if x < y]

    def send(held: list, ids: list, keys: list) -> Iterator[pa.RecordBatch]:
        """One batch of documents: settle copies within it, pack the rest by bucket."""
        doc, place, reach, h, context, sides = (np.concatenate(c) for c in zip(*held, strict=True))
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        rank = np.argsort(ids, kind="stable")
        ids, keys = ids[rank], keys[rank]
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank))
        doc = back[doc]
        by = np.argsort(doc, kind="stable")
        doc, place, reach, h, context, sides = (c[by] for c in (doc, place, reach, h, context, sides))
        settled = repeated(ids[doc], keys[doc], place, context, sides[:, 0], within)
        d, lo, hi = merged(doc[settled], place[settled], place[settled] + reach[settled, 0].astype(np.int32) + unit.T)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d % n, pa.int32()), pa.nulls(len(d), pa.binary()), *spans_batch(ids[d], keys[d], lo, hi).columns], schema=ROUTED)
        doc, place, reach, h, context, sides = (c[~settled] for c in (doc, place, reach, h, context, sides))
        bucket = h.astype(np.int64) % n
        by = np.argsort(bucket, kind="stable")
        cuts = np.append(edges(bucket[by]), len(by)) if len(by) else np.zeros(1, np.int64)
        bodies = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            own = by[a:b]
            used, at = np.unique(doc[own], return_inverse=True)
            body = [np.array([len(own), len(used)], np.int64), np.diff(ids[used], prepend=0), keys[used].astype(np.uint32), at.astype(np.uint32 if len(used) > 65_535 else np.uint16), place[own].astype(np.uint32), reach[own], sides[own], context[own]]
            bodies.append(b"".join([x.tobytes() for x in body]))
        if bodies:
            buckets = bucket[by][cuts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary()), *(pa.nulls(len(bodies), f.type) for f in SPANS)], schema=ROUTED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, keys, n_docs, size = [], [], [], 0, 0
        for part, texts in slices(batches):
            symbols, starts, lens = unit.symbols(texts)
            at, h, first, last = anchors(unit, symbols, starts, lens)
            doc = np.searchsorted(starts, at, "right") - 1
            context, more = (range_hashes(unit, symbols, first, last + unit.T, unit.T + rest, seed) for seed in (0, 1))
            sides = [more]
            for x, y in classes:
                # a class without windows here matches nothing
                own = np.flatnonzero((first <= at - x) & (last >= at - y))
                side = context ^ U(x + 1)
                side[own] = range_hashes(unit, symbols, at[own] - x, at[own] - y + unit.T, unit.T)
                sides.append(side)
            reach = np.stack([last - first, at - first], 1)
            held.append(((doc + n_docs).astype(np.int32), (first - starts[doc]).astype(np.int32), reach.astype(small), (h >> U(32)).astype(np.uint32), context, np.stack([(x >> U(32)).astype(np.uint32) for x in sides], 1)))
            ids.append(part.column("doc_id").to_numpy())
            keys.append(part.column("key").to_numpy())
            n_docs, size = n_docs + len(texts), size + len(at)
            if size >= HOLD:
                yield from send(held, ids, keys)
                held, ids, keys, n_docs, size = [], [], [], 0, 0
        if size:
            yield from send(held, ids, keys)

    def unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
        """doc_id, key, place, reach, sides, context of a payload's anchors."""
        m, u = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        kind = np.dtype(np.uint32 if u > 65_535 else np.uint16)
        shapes = [(np.int64, u, ()), (np.uint32, u, ()), (kind, m, ()), (np.uint32, m, ()), (small, m, (2,)), (np.uint32, m, (len(classes) + 1,)), (U, m, ())]
        at, parts = 16, []
        for dtype, length, shape in shapes:
            count = length * int(np.prod(shape, dtype=np.int64))
            parts.append(np.frombuffer(raw, dtype, count, at).reshape(length, *shape))
            at += count * np.dtype(dtype).itemsize
        gaps, keys, own, place, reach, sides, context = parts
        return np.cumsum(gaps)[own], keys.astype(np.int64)[own], place, reach, sides, context

    def windows_of(rows: list[np.ndarray], ask: np.ndarray, side: int) -> pa.RecordBatch:
        """The class's windows of the anchors `ask`, as starts relative to the first."""
        doc, key, place, reach, _, _ = rows
        x, y = classes[side]
        far, own = reach[ask, 0].astype(np.int64), reach[ask, 1].astype(np.int64)
        begin, end = np.maximum(own - y, 0), np.minimum(own - x, far)
        some = begin <= end
        ask, begin, end = ask[some], begin[some], end[some]
        return spans_batch(doc[ask], key[ask], place[ask] + begin, begin - end - 1 - (side << CLASS_SHIFT))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, full = 0, False

        def let_go() -> pa.RecordBatch:
            """Sort what is held, and leave only firsts."""
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            by = np.lexsort((rows[1], rows[2], rows[0]))
            rows = [c[by] for c in rows]
            doc, key, place, reach, sides, context = rows
            settled = repeated(doc, key, place, context, sides[:, 0], within)
            held.append(tuple(c[~settled] for c in rows))
            lo = place[settled].astype(np.int64)
            return spans_batch(doc[settled], key[settled], lo, lo + reach[settled, 0] + unit.T)

        for batch in batches:
            through = batch.filter(batch.column("doc_id").is_valid())
            if through.num_rows:
                yield through.select(SPANS.names)
            for raw in batch.column("payload").drop_null().to_pylist():
                held.append(unpacked(raw))
                size += len(held[-1][0])
                if size < MEET:
                    continue
                yield let_go()
                size = len(held[0][0])
                if size > MEET // 2:
                    for side in range(len(classes)):
                        yield windows_of(held[0], np.arange(size), side)
                    held.clear()
                    size, full = 0, True
        if not held:
            return
        yield let_go()
        doc, key, place, reach, sides, context = held[0]
        for side in range(len(classes)):
            if full:
                ask = np.arange(len(doc))
            else:
                own = sides[:, side + 1]
                by = np.argsort(own, kind="stable")
                start = firsts(own[by])
                several = np.zeros(len(by), bool)
                np.logical_or.at(several, start, context[by] != context[by[start]])
                ask = np.sort(by[several[start]])
            yield windows_of(held[0], ask, side)

    rows = docs.where("doc_id is not null").mapInArrow(scan, "bucket int, payload binary, " + SPAN)
    return rows.repartitionById(n, F.col("bucket")).mapInArrow(meet, SPAN)


def settle(docs: DataFrame, asked: DataFrame, unit: Unit, within: bool, n: int) -> DataFrame:
    """Spans of the windows around the asked anchors that occur earlier."""
    T = unit.T
    probe = unit.digits(np.zeros(4 * T + 8, np.uint8 if isinstance(unit, Bytes) else U), np.array([T]), T)
    names = [f"d{i}" for i in range(len(probe))]
    schema = pa.schema([*((d, pa.int64()) for d in names), *SPANS])

    def only_firsts(c: dict[str, np.ndarray]) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
        """Spans of the windows that come after another of the same text, and the rest."""
        by = np.lexsort((c["key"], c["lo"], c["doc_id"]))
        c = {k: v[by] for k, v in c.items()}
        order, group = radix_groups([c[d].view(U) for d in names])
        gone = np.zeros(len(by), bool)
        gone[order] = later(c["doc_id"], c["key"], c["lo"], order, order[firsts(group)], within)
        lo = c["lo"][gone]
        return spans_batch(c["doc_id"][gone], c["key"][gone], lo, lo + T), {k: v[~gone] for k, v in c.items()}

    def all_of(held: list[dict]) -> dict[str, np.ndarray]:
        return {k: np.concatenate([c[k] for c in held]) for k in held[0]}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found, c = only_firsts(all_of(held))
            held.clear()
            none = [pa.nulls(found.num_rows, pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([*none, *found.columns], schema=schema)
            spans = spans_batch(c["doc_id"], c["key"], c["lo"], np.full(len(c["lo"]), -1, np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[d]) for d in names), *spans.columns], schema=schema)

        for part, texts in slices(batches):
            symbols, starts, _ = unit.symbols(texts)
            asked_of = part.column("places")
            doc = np.repeat(np.arange(len(texts)), np.diff(asked_of.offsets.to_numpy()))
            flat = asked_of.flatten()
            begin, n_own = starts[doc] + flat.field("lo").to_numpy(), -flat.field("hi").to_numpy().astype(np.int64) & (1 << CLASS_SHIFT) - 1
            at = np.repeat(begin - np.cumsum(n_own) + n_own, n_own) + np.arange(n_own.sum())
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, "right") - 1
            digits = {d: x.view(np.int64) for d, x in zip(names, unit.digits(symbols, at, T), strict=True)}
            held.append({**digits, "doc_id": part.column("doc_id").to_numpy()[doc], "key": part.column("key").to_numpy()[doc], "lo": (at - starts[doc]).astype(np.int32)})
            size += len(at)
            if size >= HOLD_WINDOWS:
                yield from send()
                size = 0
        if held:
            yield from send()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, MEET // 2
        columns = [*names, "doc_id", "key", "lo"]
        for batch in batches:
            through = batch.filter(pc.greater_equal(batch.column("hi"), 0))
            if through.num_rows:
                yield through.select(SPANS.names)
            own = batch.filter(pc.less(batch.column("hi"), 0))
            held.append({k: own.column(k).to_numpy() for k in columns})
            size += own.num_rows
            if size >= most:
                found, rest = only_firsts(all_of(held))
                yield found
                held, size = [rest], len(rest["lo"])
                most = max(MEET // 2, 2 * size)  # distinct windows stay
        if size:
            yield only_firsts(all_of(held))[0]

    places = asked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    rows = docs.join(places, ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    rows = rows.mapInArrow(windows, ", ".join(f"{d} long" for d in names) + ", " + SPAN)
    salt = F.when(F.col("hi") >= 0, F.xxhash64("doc_id", "lo"))
    return rows.repartition(n, *names, salt).mapInArrow(compare, SPAN)


def repeated_spans(docs: DataFrame, unit: Unit, within: bool) -> DataFrame:
    """doc_id, key, lo, hi: in symbols, spans whose every symbol lies in a window that occurs earlier.

    Earlier is in a document of smaller doc_id or, if within, also in the same document further left.
    Documents without doc_id have no order: nothing is removed from them and they remove nothing.
    """
    n = partitions_for(docs, unit.share)
    docs = keyed(docs)
    found = materialize(survey(docs, unit, within, n), "survey", large=True)
    spans = found.where("hi >= 0")
    # equal windows are of one class, so classes may be compared in turn, each pass with its own shuffle
    for p in range(unit.passes):
        own = F.expr(f"hi < 0 and shiftright(-hi, {CLASS_SHIFT}) % {unit.passes} = {p}")
        spans = spans.union(materialize(settle(docs, found.where(own), unit, within, n), "windows", large=True))
    return spans


def span_table(spans: DataFrame) -> DataFrame:
    """doc_id, key, spans: an array of struct lo, hi."""
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def join_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed(docs) with spans, null where there are none."""
    return keyed(docs).join(span_table(spans), ["doc_id", "key"], "left")


def kept_mask(spans: np.ndarray | None, n: int) -> np.ndarray | None:
    """True for each of n symbols outside all spans; None if there are no spans."""
    if spans is None or not len(spans):
        return None
    change = np.zeros(n + 1, np.int32)
    edges = np.asarray(spans, np.int64).clip(0, n)
    np.add.at(change, edges[:, 0], 1)
    np.add.at(change, edges[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def span_lists(column: pa.Array) -> list[np.ndarray | None]:
    """The spans column as (m, 2) arrays, without Python objects for each span."""
    offsets, flat, valid = column.offsets.to_numpy(), column.values, column.is_valid().to_numpy(zero_copy_only=False)
    both = np.stack([flat.field("lo").to_numpy(zero_copy_only=False), flat.field("hi").to_numpy(zero_copy_only=False)], 1) if len(flat) else np.zeros((0, 2), np.int32)
    return [both[a:b] if v else None for a, b, v in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]
