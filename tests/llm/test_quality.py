import random

import numpy as np

from quillon.llm import quality
from quillon.llm.quality import CLASSES, OWN, STEPS, Field, by_lines, chain, line_features

GAPS = b" \t\n\x0b\x0c\r"


def brute_own(line: bytes, again: bool) -> list[float]:
    """A line's own features, one by one."""
    n = max(1, len(line))
    words = line.split()
    per_word = max(1, len(words))
    shares = [sum(bool(c(np.array([b]))[0]) for b in line) / n for c in CLASSES]
    shares += [sum(a == b for a, b in zip(words, words[d:])) / per_word for d in (1, 2, 3)]
    shares += [float(again and len(line) > 0)]
    shares += [shares[k] * n / per_word for k in (5, 6, 4)]
    steps = [float(s > t) for s in shares for t in STEPS]
    return steps + [float(x) for x in (len(line) == 0, len(line) < 20, len(line) < 80, len(line) < 400, len(words) <= 1, n / per_word > 9, n / per_word > 14)]


def brute_features(texts: list[bytes]) -> np.ndarray:
    out = []
    for t in texts:
        lines = t.split(b"\n")
        own = [brute_own(x, lines.count(x) > 1) for x in lines]
        none = [0.0] * OWN
        for i in range(len(lines)):
            out.append([1.0, *own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(lines) else none), float(i == 0), float(i + 1 == len(lines))])
    return np.array(out, np.float32)


def texts_of(seed: int, n: int = 40) -> list[bytes]:
    rnd = random.Random(seed)
    words = ["the", "the", "a", "Buy!!", "100%", "|", "café", "日本", "x" * 30, "end.", "$$$"]
    lines = [" ".join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(30)] + ["", " ", "\t"]
    return [b"", b"\n", b"one line"] + ["\n".join(rnd.choices(lines, k=rnd.randint(1, 15))).encode() for _ in range(n)]


def random_field(seed: int) -> Field:
    rng = np.random.default_rng(seed)
    return Field(rng.standard_normal(3 + 3 * OWN).astype(np.float32) * 0.2, rng.standard_normal((2, 2)))


def test_line_features_match_brute_force():
    texts = texts_of(1)
    x, length, per_text = line_features(texts)
    assert (x == brute_features(texts)).all()
    assert per_text.tolist() == [t.count(b"\n") + 1 for t in texts]
    assert length.tolist() == [len(y) for t in texts for y in t.split(b"\n")]


def brute_score(field: Field, text: bytes) -> float:
    """Marginals by the plain recursions, line by line, and their mean weighted by length."""
    u = brute_features([text]) @ field.weights
    node = np.stack([1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))], 1).astype(np.float64)
    move = np.exp(field.pairs)
    a, b = node.copy(), np.ones_like(node)
    for t in range(1, len(u)):
        a[t] = (a[t - 1] @ move) * node[t]
        a[t] /= a[t].sum()
    for t in range(len(u) - 1, 0, -1):
        b[t - 1] = move @ (b[t] * node[t])
        b[t - 1] /= b[t - 1].sum()
    p = a * b
    p = p[:, 1] / p.sum(1)
    weight = np.array([len(x) + 1e-6 for x in text.split(b"\n")])
    return float((p * weight).sum() / weight.sum())


def test_scores_match_brute_force_whatever_the_blocks(monkeypatch):
    field, texts = random_field(2), texts_of(3)
    want = [brute_score(field, t) for t in texts]
    assert np.allclose(field.scores(texts), want, atol=1e-5)
    for lines, size in ((1, 50), (4, 1 << 20), (7, 20)):
        monkeypatch.setattr(quality, "BLOCK_LINES", lines)
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        assert np.allclose(field.scores(texts), want, atol=1e-5)


def test_a_long_chain_by_blocks_is_the_plain_recursion():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 101, 1000):
        node, move = rng.random((n, 2)) + 1e-3, np.exp(rng.standard_normal((2, 2)))
        a = node[0] / node[0].sum()
        got = chain(node, move)
        assert np.allclose(got[0], a)
        for t in range(1, n):
            a = (a @ move) * node[t]
            a /= a.sum()
            assert np.allclose(got[t], a)


def test_groups_by_lines():
    texts = [b"a\nb", b"", b"\n" * 9, b"c", b"d\n"]
    assert list(by_lines(texts, 3)) == [[b"a\nb", b""], [b"\n" * 9], [b"c", b"d\n"]]
    assert list(by_lines([], 3)) == []


def test_very_long_texts(spark):
    field = random_field(5)
    rows = [(1, "\n" * 5_000_000, "x"), (2, "word " * 1_000_000, "y"), (3, "a line\nanother one\n" * 60_000, None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in quality.score(docs, field).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 4
    assert abs(got[1] - brute_score(field, b"\n" * 2000)) < 1e-2, "the ends count little"
    assert abs(got[4] - brute_score(field, b"")) < 1e-5
