"""Word-end byte-pair encoding of a `tokenizers` JSON file, without the library.

Text is cut at the file's special strings, normalised (NFC, lower case), cut at white space and then by
the file's pattern into pre-tokens; each pre-token's bytes are merged by rank. Two merge engines give the
same result: `segment_tree_merge` (the root of a tree over adjacent pair ranks is the next merge) and
`rank_synchronous_count` (ragged arrays; every sequence applies its lowest-rank pair at once).

Python's and the regex package's Unicode tables are of other versions than the library's. Texts of the SAFE
characters only, long assigned and alike in all tables, are cut here; any other text is normalised and cut by
the library's own normaliser and pre-tokeniser, and merged here like the rest.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

INF = np.int64(1) << 60
#: Pre-tokens of more symbols than this are merged by the scalar tree; numpy's overhead is per level, not per word.
SCALAR_FROM = 256
#: Counted words of more symbols than this are merged by the scalar tree.
TREE_FROM = 1 << 14
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.compile(f"[{SPACES}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: First and last of the ranges: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, extended Latin and Greek,
#: punctuation and signs, kana, Han, Hangul, full-width forms, emoji.
SAFE_RANGES = [(0x0, 0x557), (0x559, 0x587), (0x591, 0x5C7), (0x5D0, 0x5EA), (0x600, 0x6FF), (0x900, 0x97F), (0xE01, 0xE5B), (0x1E00, 0x1FFE), (0x2000, 0x2064), (0x2070, 0x208E), (0x20A0, 0x20BF), (0x2100, 0x218B), (0x2190, 0x23FE), (0x2460, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FD5), (0xAC00, 0xD7A3), (0xFF01, 0xFFEE), (0xFFFD, 0xFFFD), (0x1F300, 0x1F64F), (0x1F680, 0x1F6C5), (0x1F910, 0x1F93E)]
SAFE = np.zeros(0x110000, bool)
for _low, _high in SAFE_RANGES:
    SAFE[_low : _high + 1] = True


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        kinds = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or j["decoder"] or j["post_processor"]:
            raise ValueError("not a word-end BPE file of the supported form")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]"))
        self.spec, self._library = spec, None
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        chars = byte_characters()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.made = ids[:, 2].copy()
        self.made_list = self.made.tolist()
        n = max(self.names) + 1
        first = np.full(n, len(ids), np.int64)  # the lowest rank of a merge that a symbol takes part in
        for side in (0, 1):
            np.minimum.at(first, ids[:, side], np.arange(len(ids)))
        #: Merging all places of such a pair at once could pass over a pair of lower rank that the first merge makes.
        self.one_by_one = first[self.made] < np.arange(len(ids))
        self._hash_pairs(ids)

    # pair ranks: an open-addressing hash table in numpy

    def _hash_pairs(self, ids: np.ndarray) -> None:
        self.bits = max(4, int(len(ids)).bit_length() + 2)
        self.mask = (1 << self.bits) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, INF, np.int64)
        keys = ids[:, 0] << 32 | ids[:, 1]
        self.rank_of = {}
        for r, (k, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] not in (-1, k):
                at = at + 1 & self.mask
            self.keys[at], self.ranks[at] = k, r
            self.rank_of[k] = r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, INF where it isn't a merge. Negative symbols take part in none."""
        keys = a << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], INF)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        at = at[open_]
        while len(open_):
            at = at + 1 & self.mask
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (got != -1)
            open_, at = open_[more], at[more]
        return out

    # text to pre-tokens

    def cut(self, text: str) -> list[str | tuple[str] | int]:
        """Chunks without white space, special ids and, as tuples, pre-tokens of texts that the library cuts."""
        parts = self.split_special.split(text) if self.split_special else [text]
        out: list = []
        for i, p in enumerate(parts):
            if i % 2:
                out.append(self.special[p])
            elif p.isascii() or SAFE[np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)].all():
                out += self.chunks(normalise(p))
            else:
                out += self.by_library(p)
        return out

    def by_library(self, piece: str) -> list[tuple[str]]:
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece))
        return [(bytes([self.byte_of[c] for c in word]).decode(),) for word, _ in found]

    @staticmethod
    def chunks(piece: str) -> list[str]:
        """Maximal runs without white space; a pre-token never goes beyond one."""
        return [c for c in WHITE.split(piece) if c] if ODD_SPACE.search(piece) else piece.split()

    def pre_tokens(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' byte symbols in one array, and each word's count."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = self.inner[data]
        ends = np.cumsum(lens) - 1
        out[ends] = self.last[data[ends]]
        return out, lens

    # merge engines

    def segment_tree_merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each (non-empty) word."""
        flat, lens = self.symbols(words)
        starts = np.cumsum(lens) - lens
        out: list = [None] * len(words)
        for width in sorted({1 << int(n - 1).bit_length() for n in np.unique(lens)}):
            own = np.flatnonzero((lens <= width) & (lens > width // 2))
            if width > SCALAR_FROM:
                for i in own:
                    out[i] = self._scalar_tree(flat[starts[i] : starts[i] + lens[i]])
                continue
            step = max(1, (1 << 21) // width)
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                for i, ids in zip(rows.tolist(), self._trees(flat, starts[rows], lens[rows], width), strict=True):
                    out[i] = ids
        return out

    def _trees(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> list[np.ndarray]:
        """One segment tree a word, all of `width` leaves, in lockstep. A node holds rank * width + place of its best pair."""
        n, shift = len(starts), int(width).bit_length() - 1
        place = np.arange(width)
        sym = np.where(place < lens[:, None], flat[np.minimum(starts[:, None] + place, len(flat) - 1)], -1)
        nxt = np.broadcast_to(place + 1, (n, width)).copy()
        prv = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), INF, np.int64)
        if width > 1:
            ranks = self.pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
            tree[:, width:-1] = np.where(ranks < INF, ranks << shift | place[:-1], INF)
            h = width // 2
            while h:
                tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
                h //= 2
        S, N, P, T = sym.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[:, 1] < INF)
        while len(rows):
            root = T[rows * 2 * width + 1]
            base, top = rows * width, rows * 2 * width
            i = root & (width - 1)
            made = self.made[root >> shift]
            j = N[base + i]
            k = N[base + j]
            S[base + i] = made
            S[base + j] = -1
            N[base + i] = k
            inside = k < width
            P[(base + k)[inside]] = i[inside]
            right = np.where(inside, S[base + np.minimum(k, width - 1)], -1)
            before = P[base + i]
            has = before >= 0
            left = np.where(has, S[base + np.maximum(before, 0)], -1)
            with_right, with_left = self.pair_ranks(made, right), self.pair_ranks(left, made)
            T[top + width + j] = INF
            T[top + width + i] = np.where(with_right < INF, with_right << shift | i, INF)
            T[(top + width + before)[has]] = np.where(with_left < INF, with_left << shift | before, INF)[has]
            for leaf in (j, i, np.maximum(before, 0)):
                at = width + leaf >> 1
                for _ in range(shift):
                    node = top + at
                    child = top + 2 * at
                    T[node] = np.minimum(T[child], T[child + 1])
                    at = at >> 1
            rows = rows[T[top + 1] < INF]
        keep = sym >= 0
        return np.split(sym[keep], np.cumsum(keep.sum(1))[:-1])

    def _scalar_tree(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word; some 50 bytes a symbol."""
        n = len(symbols)
        shift = (n - 1).bit_length()
        width, place = 1 << shift, (1 << shift) - 1
        none = 1 << 60
        levels = np.full(2 * width, none, np.int64)
        ranks = self.pair_ranks(symbols[:-1], symbols[1:])
        levels[width : width + n - 1] = np.where(ranks < INF, ranks << shift | np.arange(n - 1), none)
        h = width // 2
        while h:
            levels[h : 2 * h] = np.minimum(levels[2 * h : 4 * h : 2], levels[2 * h + 1 : 4 * h : 2])
            h //= 2
        tree, sym = array("q", levels.tobytes()), array("i", symbols.astype(np.int32).tobytes())
        del levels, ranks
        nxt, prv = (array("i", np.arange(k, n + k, dtype=np.int32).tobytes()) for k in (1, -1))
        rank_of, made_of = self.rank_of, self.made_list

        def put(i: int, a: int, b: int) -> None:
            r = rank_of.get(a << 32 | b) if a >= 0 and b >= 0 else None
            v, i = none if r is None else r << shift | i, width + i
            if tree[i] == v:
                return
            tree[i] = v
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                best = a if a < b else b
                if tree[i] == best:
                    return
                tree[i] = best
                i >>= 1

        while (root := tree[1]) < none:
            r, i = root >> shift, root & place
            j = nxt[i]
            k, p = nxt[j], prv[i]
            sym[i], sym[j], nxt[i] = made_of[r], -1, k
            if k < n:
                prv[k] = i
            put(j, -1, -1)
            put(i, sym[i], sym[k] if k < n else -1)
            if p >= 0:
                put(p, sym[p], sym[i])
        out = np.array(sym, np.int64)
        return out[out >= 0]

    def rank_synchronous_count(self, words: list[str]) -> np.ndarray:
        """The number of symbols that each (non-empty) word keeps.

        Rounds go over all symbols left, so words of over TREE_FROM symbols, of many rounds, are merged by the tree.
        """
        sym, lens = self.symbols(words)
        counts = lens.copy()
        seq = np.arange(len(words))  # of the sequences still merging
        if lens.max(initial=0) > TREE_FROM:
            ends = np.cumsum(lens)
            for i in np.flatnonzero(lens > TREE_FROM).tolist():
                counts[i] = len(self._scalar_tree(sym[ends[i] - lens[i] : ends[i]]))
            seq = np.flatnonzero(lens <= TREE_FROM)
            sym = sym[np.repeat(lens <= TREE_FROM, lens)]
            lens = lens[seq]
        while len(seq):
            ends = np.cumsum(lens)
            starts = ends - lens
            nxt = np.empty_like(sym)
            nxt[:-1] = sym[1:]
            nxt[ends - 1] = -1
            ranks = self.pair_ranks(sym, nxt)
            low = np.minimum.reduceat(ranks, starts)
            live = low < INF
            counts[seq[~live]] = lens[~live]
            of = np.repeat(np.arange(len(seq)), lens)
            hit = np.flatnonzero((ranks == low[of]) & live[of])
            if len(hit):
                # of a run of touching places (the pair x x), every other one; where merges must go one by one, the first
                run = np.ones(len(hit), bool)
                run[1:] = hit[1:] != hit[:-1] + 1
                at = np.flatnonzero(run)
                odd = (np.arange(len(hit)) - np.repeat(at, np.diff(np.append(at, len(hit))))) & 1
                owner = of[hit]
                first = np.ones(len(hit), bool)
                first[1:] = owner[1:] != owner[:-1]
                hit = hit[np.where(self.one_by_one[low[owner]], first, odd == 0)]
                sym[hit] = self.made[ranks[hit]]
            keep = live[of]
            keep[hit + 1] = False
            lens = np.add.reduceat(keep, starts, dtype=np.int64)[live]
            sym, seq = sym[keep], seq[live]
        return counts


def normalise(text: str) -> str:
    """NFC, then each character's own lower case (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(2)
def word_bpe(spec: str) -> WordBpe:
    return WordBpe(spec)
