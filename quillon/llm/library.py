"""The tokenizers library over a large corpus: each distinct chunk in a bounded cache's reach is asked for once.

Texts of a byte-level vocabulary are cut only where its pattern always ends a pre-token, so chunks encode
alike alone. Cutting, looking up and putting ids together are numpy passes over a block of text; the library
sees the chunks that the cache lacks, many joined in one string.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text turned into arrays at once, and bytes of a chunk that the cache can hold.
BLOCK, SHORT = 1 << 20, 24
#: Chunks joined to one string for the library.
JOIN = 100
ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
#: By the number of bytes that belong to a chunk, the mask of a little-endian digit.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)

_byte = np.arange(256)
LETTER = (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122)
GRAPHIC = (_byte > 32) & (_byte < 127)
STOP = np.isin(_byte, list(b",.;:!?"))
#: Lead bytes of U+00C0-U+07FF, and of other ranges that have no white space, by the length of their characters.
LEAD2 = (_byte >= 0xC3) & (_byte <= 0xDF)
LEAD3 = (_byte == 0xE0) | (_byte >= 0xE4) & (_byte <= 0xEF)
LEAD4 = (_byte >= 0xF0) & (_byte <= 0xF4)
#: Bytes of characters that are no white space.
INNER = GRAPHIC | LEAD2 | LEAD3 | LEAD4 | (_byte >= 0x80) & (_byte <= 0xBF)
#: Lead bytes of U+00C0-U+027F, all letters but the signs of multiplication and division.
LATIN = (_byte >= 0xC3) & (_byte <= 0xC9)


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a chunk may start at each byte of UTF-8 text; false where in doubt.

    Before a single space between two characters that are no white space; around a single line end between
    such; between a letter and one of `,.;:!?`, in either order. A pre-token never goes over such a place.
    """
    n = len(data)
    d = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(2, np.uint8)])
    at = slice(4, 4 + n)

    def back(table: np.ndarray, k: int) -> np.ndarray:
        return table[d[4 - k : 4 - k + n]]

    sign = (data == 0x97) | (data == 0xB7)  # second byte of the two signs, after 0xC3
    latin_end = back(LATIN, 1) & ~(sign & (d[3 : 3 + n] == 0xC3))  # a Latin letter's second byte is here
    latin_start = LATIN[data] & ~((data == 0xC3) & ((d[5 : 5 + n] == 0x97) | (d[5 : 5 + n] == 0xB7)))
    ends_solid = GRAPHIC[data] | back(LEAD2, 1) | back(LEAD3, 2) | back(LEAD4, 3)
    starts_solid = GRAPHIC[data] | LEAD2[data] | LEAD3[data] | LEAD4[data]
    ends_letter, starts_letter = LETTER[data] | latin_end, LETTER[data] | latin_start

    def before(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[False], x[:-1]])

    def after(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[1:], [False]])

    lone = before(ends_solid) & after(starts_solid) & ((data == 32) | (data == 10))
    out = lone | before(lone & (data == 10))
    out |= before(ends_letter) & STOP[data]
    out |= before(STOP[data]) & starts_letter
    return out


class LibraryEncoder:
    """Ids by the tokenizers library for a byte-level BPE file without normaliser; special strings as its default."""

    def __init__(self, spec: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        names = self.library.get_vocab()
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)  # a name has a character for each byte
        for name, i in names.items():
            self.bytes_of[i] = len(name)
        self.most, self.bits = most, int(2 * most - 1).bit_length()
        self._empty()

    # the cache: an open-addressing table over chunks of at most SHORT bytes, compared whole

    def _empty(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.digits = [np.zeros(1 << 12, U) for _ in ODD]
        self.size, self.first, self.count, self.hits = (np.zeros(1 << 12, k) for k in (np.uint8, np.int64, np.int32, np.uint16))
        self.n = 0
        self.pool, self.used = np.zeros(1 << 14, self.kind), 0

    @staticmethod
    def _hash(digits: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        h = size.astype(U)
        for x, odd in zip(digits, ODD, strict=True):
            h = (h ^ x) * odd
            h ^= h >> U(29)
        return h * ODD[0]

    def _slot(self, digits: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        return (self._hash(digits, size) >> U(64 - self.bits)).astype(np.int64)

    def find(self, digits: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The entry of each chunk, or -1."""
        slot = self._slot(digits, size)
        out = np.full(len(size), -1, np.int64)
        open_ = np.arange(len(size))
        while len(open_):
            e = self.slots[slot]
            some = e >= 0
            open_, slot, e = open_[some], slot[some], e[some]
            same = self.size[e] == size[open_]
            for own, x in zip(self.digits, digits, strict=True):
                same &= own[e] == x[open_]
            out[open_[same]] = e[same]
            open_, slot = open_[~same], slot[~same] + 1 & len(self.slots) - 1
        return out

    def put(self, digits: list[np.ndarray], size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Enter distinct chunks that are not there yet; their entries."""
        if self.n + len(size) > self.most:
            self._forget(len(size))
        e = np.arange(self.n, self.n + len(size))
        self._grow(self.n + len(size), self.used + len(ids))
        for own, x in zip(self.digits, digits, strict=True):
            own[e] = x
        self.size[e], self.count[e], self.hits[e] = size, count, 0
        self.first[e] = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(size), self.used + len(ids)
        slot, left = self._slot(digits, size), e
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several for one slot, the last stays
            out = self.slots[slot] != left
            left, slot = left[out], slot[out] + 1 & len(self.slots) - 1
        return e

    def _grow(self, n: int, ids: int) -> None:
        def wide(x: np.ndarray, n: int) -> np.ndarray:
            return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

        self.digits = [wide(x, n) for x in self.digits]
        self.size, self.first, self.count, self.hits = (wide(x, n) for x in (self.size, self.first, self.count, self.hits))
        self.pool = wide(self.pool, ids)

    def _forget(self, more: int) -> None:
        """Keep the half that was met in most blocks since, if at all; counts are halved."""
        hits = self.hits[: self.n]
        keep = np.argsort(hits, kind="stable")[max(0, self.n - max(0, self.most // 2 - more)) :]
        keep = np.sort(keep[hits[keep] > 0])
        digits, size, count, hits = [x[keep] for x in self.digits], self.size[keep], self.count[keep], hits[keep]
        ids = self.pool[ragged(self.first[keep], count)]
        self._empty()
        if len(keep):
            self.hits[self.put(digits, size, ids, count)] = hits >> 1

    # encoding

    def ask(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids of the chunks data[starts : starts + size]: (ids of all, first and number of each)."""
        batch = self.library.encode_batch_fast
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        parts, used = [], 0
        # chunks of one space and then no white space at all stay apart when joined
        other = np.concatenate([[0], np.cumsum(~INNER[data], dtype=np.int64)])
        joins = (data[starts] == 32) & (size > 1) & (other[starts + size] - other[np.minimum(starts + 1, len(data))] == 0)
        plain, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        for k in range(0, len(plain), 64 * JOIN):
            own = plain[k : k + 64 * JOIN]
            raw = data[ragged(starts[own], size[own])].tobytes()
            ends = np.cumsum(size[own])
            if any(s in raw for s in self.special):  # made by joining
                rest = np.concatenate([rest, own])
                continue
            at = [0, *ends[JOIN - 1 :: JOIN].tolist()]
            if at[-1] < len(raw):
                at.append(len(raw))
            got = batch([raw[i:j].decode() for i, j in zip(at, at[1:], strict=False)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.kind) for e in got])
            upto = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(upto, ends)
            if last[-1] >= len(ids) or not np.array_equal(upto[last], ends):
                raise ValueError("the vocabulary is not byte-level with a cut at each space")
            count[own] = np.diff(last, prepend=-1)
            first[own] = used + last + 1 - count[own]
            parts.append(ids)
            used += len(ids)
        for k in range(0, len(rest), 4096):
            own = rest[k : k + 4096]
            texts = [data[a : a + m].tobytes().decode() for a, m in zip(starts[own].tolist(), size[own].tolist(), strict=True)]
            got = [np.array(e.ids, self.kind) for e in batch(texts, add_special_tokens=False)]
            count[own] = [len(x) for x in got]
            first[own] = used + np.cumsum(count[own]) - count[own]
            parts += got
            used += int(count[own].sum())
        return np.concatenate(parts) if parts else np.zeros(0, self.kind), first, count

    def block(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the block, number of its ids before each of `begins`): chunks start at `begins`, among others."""
        cut = cuts(data)
        cut[begins[begins < len(data)]] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(data)))
        wide = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
        view = np.lib.stride_tricks.as_strided(wide, (len(data) + SHORT, 8), (1, 1))
        digits = [np.ascontiguousarray(view[starts + 8 * k]).view("<u8").ravel() & KEEP[np.clip(size - 8 * k, 0, 8)] for k in range(len(ODD))]
        entry = self.find(digits, size)
        known = np.flatnonzero(entry >= 0)
        firsts, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        own = entry[known]
        self.hits[own] += self.hits[own] < 60_000
        firsts[known], counts[known] = self.first[own], self.count[own]
        pool = self.pool[: self.used]
        lacking = np.flatnonzero(entry < 0)
        if len(lacking):
            # each distinct one once; long ones, and others of one hash, may be asked for again
            lacking = lacking[np.argsort(self._hash([x[lacking] for x in digits], size[lacking]), kind="stable")]
            new = (size[lacking] > SHORT) | (np.diff(size[lacking], prepend=-1) != 0)
            for x in digits:
                new[1:] |= x[lacking][1:] != x[lacking][:-1]
            rows = lacking[new]
            ids, first, count = self.ask(data, starts[rows], size[rows])
            of = np.cumsum(new) - 1
            firsts[lacking], counts[lacking] = self.used + first[of], count[of]
            pool = np.concatenate([pool, ids])
            fits = np.flatnonzero(size[rows] <= SHORT)
            if len(fits) <= self.most // 2:
                self.put([x[rows[fits]] for x in digits], size[rows[fits]], ids[ragged(first[fits], count[fits])], count[fits])
        before = np.concatenate([[0], np.cumsum(counts)])
        return pool[ragged(firsts, counts)], before[np.searchsorted(starts, begins)]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Memory is bounded by the largest text's ids and some BLOCK bytes."""
        held: list[bytes] = []
        size = 0
        for raw in texts:
            raw = clean(raw)
            special = any(s in raw for s in self.special)
            if held and (special or size + len(raw) > BLOCK):
                yield from self._several(held)
                held, size = [], 0
            if special:  # matched in the whole text
                yield np.array(self.library.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, self.kind)
            elif len(raw) > BLOCK:
                yield self._long(raw)
            else:
                held.append(raw)
                size += len(raw)
        if held:
            yield from self._several(held)

    def _several(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lens)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            yield from (np.zeros(0, self.kind) for _ in texts)
            return
        ids, before = self.block(data, begins)
        yield from np.split(ids, before[1:-1])

    def _long(self, raw: bytes) -> np.ndarray:
        """One text, cut into blocks where chunks may start."""
        data = np.frombuffer(raw, np.uint8)
        out, at = [], 0
        while at < len(data):
            end = at + BLOCK
            while end < len(data):
                low = max(at + 1, end - 4096)
                found = np.flatnonzero(cuts(data[low - 4 if low >= 4 else 0 : end + 4])[4 if low >= 4 else low : -4])
                if len(found):
                    end = low + int(found[-1])
                    break
                end += BLOCK
            end = min(end, len(data))
            out.append(self.block(data[at:end], np.array([0]))[0])
            at = end
        return np.concatenate(out)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + count[0] - 1, first[1] .., and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def clean(raw: bytes) -> bytes:
    """UTF-8, with the replacement character for what is not."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
