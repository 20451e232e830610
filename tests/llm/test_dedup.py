import hashlib
import random

import numpy as np
import pytest

from quillon.llm import dedup, repeats


def brute_words(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[d] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone, own = bytearray(len(raw)), []
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            own.append(w)
            if w in seen:
                gone[i : i + window] = b"\1" * window
        seen.update(own)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "naïve", "日本"]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(5, 70))) for _ in range(12)]
    texts = [None, "", " ", "a " * 200, "ab" * 300, "x" * 49, "x" * 50, "x" * 51, "\n".join(["same line of words here"] * 30), "license line of forty bytes or so it is\nthen other text"]
    while len(texts) < n:
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(rnd.randint(1, 6))]
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[-1], texts[-5], texts[20][7:], texts[21] + "!"]
    ids = rnd.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 0, 0) for d, t in rows], "doc_id long, text string, key string, spans int, n_words int").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup.repeated_words_digest(frame(spark, rows), 20).collect()}
    assert got == brute_words(rows, 20)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup.repeated_bytes_digest(frame(spark, rows), 50).collect()}
    assert got == brute_bytes(rows, 50)


def test_small_slices_blocks_and_batches_give_the_same(spark, monkeypatch):
    rows = corpus(7, 40)
    texts = [(t or "").encode() for _, t in rows]
    unit = dedup.bytes_unit(50)
    symbols, starts, lens = unit.symbols(texts)
    whole = repeats.anchors(unit, symbols, starts, lens)
    monkeypatch.setattr(repeats, "BLOCK", 97)
    small = repeats.anchors(unit, symbols, starts, lens)
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    # every window belongs to one anchor inside it
    owned = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[2], whole[3], strict=True)])
    assert owned.tolist() == [s + i for s, n in zip(starts, lens, strict=True) for i in range(max(0, n - 49))]
    assert (whole[2] <= whole[0]).all() and (whole[0] + unit.K <= whole[3] + 50).all() and (whole[0] - whole[2] <= 50 - unit.K).all()


def test_texts_left_and_odd_tables(spark):
    rows = [(1, " ".join(map(str, range(50)))), (2, "pre " + " ".join(map(str, range(50))) + "  post\n"), (3, "a  b"), (4, None)]
    got = {r.doc_id: r.text for r in dedup.remove_repeated_words(frame(spark, rows), 20).collect()}
    assert got == {1: rows[0][1], 2: "pre post", 3: "a  b", 4: ""}
    assert dedup.repeated_words_digest(frame(spark, []), 20).count() == 0
    assert dedup.repeated_bytes_digest(frame(spark, []), 50).count() == 0
    long = "z" * 60
    same = spark.createDataFrame([(5, long), (5, long), (None, long), (6, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in dedup.repeated_bytes_digest(same, 50).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (6, 60)]
    text = " ".join(f"n{i}" for i in range(30))
    same = spark.createDataFrame([(5, text), (5, text), (5, "x " + text), (6, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in dedup.repeated_words_digest(same.coalesce(1), 20).collect())
    assert got == [(0, 30, 0), (5, 30, 0), (5, 30, 0), (5, 31, 30), (6, 30, 30)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_fool_linear_hashes_are_told_apart(spark):
    x = thue_morse(4096)
    y = x.translate(str.maketrans("ab", "ba"))
    same = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*same, x])), (2, " ".join([*same, y])), (3, " ".join([*same, x]))]
    got = {r.doc_id: r.n_removed for r in dedup.repeated_words_digest(frame(spark, rows), 20).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    rows = [(1, x), (2, y)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup.repeated_bytes_digest(frame(spark, rows), 50).collect()}
    assert got == brute_bytes(rows, 50)


def hot_corpus(n=150, seed=5):
    """One boilerplate line with other words around it in every document, and copies."""
    rnd = random.Random(seed)
    line = "all rights of this publication are reserved by the holder of the rights and no part of it may be used in any form whatsoever"
    rows = [(i, f"x{rnd.random()} y{rnd.random()} " + line + f" z{rnd.random()} " + " ".join(rnd.choices("abcdef", k=rnd.randint(0, 30)))) for i in range(n)]
    return rows + [(1000 + i, t) for i, t in rows[:20]]


@pytest.mark.parametrize("limits", [{"MEET": 40}, {"MEET": 40, "HOLD": 30, "HOLD_WINDOWS": 25}, {}])
def test_a_hot_anchor_gives_the_same_whatever_a_task_may_hold(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    for rows in (hot_corpus(), corpus(12)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup.repeated_words_digest(frame(spark, rows), 20).collect()}
        assert got == brute_words(rows, 20)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup.repeated_bytes_digest(frame(spark, rows), 50).collect()}
        assert got == brute_bytes(rows, 50)


def test_very_long_texts(spark):
    rnd = random.Random(6)
    some = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(300_000))
    rows = [(1, some), (2, "\n" * 2_000_000), (3, "q" * 2_000_000), (4, "start " + some[1000:-1000] + " end")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup.repeated_words_digest(frame(spark, rows), 20).collect()}
    shared = len(some[1000:-1000].split())
    assert got[1] == (300_000, 0) and got[2] == (0, 0) and got[3] == (1, 0)
    assert got[4][0] == shared + 2 and got[4][0] - got[4][1] in (2, 3, 4), "all but the two own words and words cut in half"
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup.repeated_bytes_digest(frame(spark, rows), 50).collect()}
    assert got[1] == (0, 0) and got[2] == (0, 0) and got[3] == (0, 0), "a string that recurs in its own document stays"
    assert got[4] == (len(some) - 2000, 1)
