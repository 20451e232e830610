import random

import pytest

from quillon.llm import dedup
from quillon.llm.automaton import SuffixAutomaton


def longest(words, sequences):
    out = []
    for i in range(len(words)):
        n = 0
        while n <= i and any(words[i - n : i + 1] == s[k : k + n + 1] for s in sequences for k in range(len(s) - n)):
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rnd = random.Random(seed)
    draw = lambda n: [rnd.choice([b"a", b"b", b"c"]) for _ in range(n)]
    sequences = [draw(rnd.randint(0, 25)) for _ in range(5)]
    sequences.append(sequences[0])
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    assert len(automaton.next) <= 2 * sum(map(len, sequences)) + 1
    for _ in range(5):
        words = draw(40) + rnd.choice(sequences) + [b"x"]
        assert automaton.matching(words).tolist() == longest(words, sequences)


@pytest.mark.parametrize("shard_words", [12, 40, 100_000])
def test_reference_passages_go(spark, shard_words):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(8)]
    reference = [" ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(6)] + [None, ""]
    docs = [(i, " ".join(rnd.choices(words, k=10) + rnd.choice(reference[:6]).split() + rnd.choices(words, k=10))) for i in range(30)] + [(100, None), (101, ""), (102, "short")]
    known = {tuple(r.split()[i : i + 6]) for r in reference if r for i in range(len(r.split()) - 5)}
    want = {}
    for d, t in docs:
        own = (t or "").split()
        gone = {i + o for i in range(len(own) - 5) if tuple(own[i : i + 6]) in known for o in range(6)}
        want[d] = " ".join(w for i, w in enumerate(own) if i not in gone)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, key int")
    refs = spark.createDataFrame([(r,) for r in reference], "text string")
    got = {r.doc_id: r.text for r in dedup.remove_reference_words(df, refs, 6, shard_words).collect()}
    assert got == want
    assert {r.doc_id: r.text for r in dedup.remove_reference_words(df, refs.limit(0), 6).collect()} == {d: t or "" for d, t in docs}
