"""Quality, neighbours, decontamination, chat and the pipeline, against brute force or held-out labels."""

import hashlib
import random
import zlib

import numpy as np

from quillon.llm import chat, decontaminate, neighbours, quality


# quality

def line_docs(n, seed=3):
    rnd = random.Random(seed)
    good = lambda: " ".join(rnd.choice(["the", "river", "stone", "walks", "under", "bright", "and"]) for _ in range(rnd.randint(4, 12))).capitalize() + "."
    bad = lambda: rnd.choice(["BUY!! NOW!! " * rnd.randint(2, 6), "a | b | c | d | " * 3, "spam " * 9, "$$$ %%% *** " * 3])
    rows, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.7)
        lines = [good() if y or rnd.random() < 0.2 else bad() for _ in range(rnd.randint(1, 12))]
        rows.append((i, "\n".join(lines), "clash"))
        labels.append((i, y if i % 11 else None))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = line_docs(600)
    docs = spark.createDataFrame([*rows, (9001, "", "x"), (9002, None, "x"), (9003, "\n\n", "x"), (None, "Some river.", "x")], "doc_id long, text string, score string")
    labels_df = spark.createDataFrame([*labels, (None, 1), (3, None), (77777, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels_df)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    kept = quality.drop_low_quality(docs, labels_df)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    lens = np.array([1, 4, 3])
    x = rng.standard_normal((8, 2)).astype(np.float32)
    field = quality.Field(np.array([0.7, -1.1], np.float32), rng.standard_normal((2, 2)))
    p, counts = field.marginals(x, lens)
    u, want, pairs, at = x @ field.weights, [], np.zeros((2, 2)), 0
    for n in lens:
        total, node, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(u[at + i] for i in range(n) if y[i]) + sum(field.pairs[a, b] for a, b in zip(y, y[1:])))
            total += w
            node += w * np.array(y)
            for a, b in zip(y, y[1:]):
                own[a, b] += w
        want += list(node / total)
        pairs += own / total
        at += n
    assert np.allclose(p, want) and np.allclose(counts, pairs)


# neighbours

def vectors(n, d=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d))
    x = centres[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(ids, x, k, every):
    out = {}
    x = x.astype(np.float64)
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        by = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in by]
    return out


def test_recall_ranks_and_scores(spark):
    x = vectors(3000)
    x[100:160] = x[100]  # a group of equal vectors: ties go to the smaller id
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int").repartition(5)
    got: dict = {}
    for r in neighbours.nearest(df, 10, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x, 10, 50)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert [a for a, _ in got[100]] == list(range(101, 111)) and all(s == 0 for _, s in got[100])
    exact = x.astype(np.float64)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
        assert np.allclose([s for _, s in rows], [np.sqrt(((exact[q] - exact[a]) ** 2).sum()) for a, _ in rows], rtol=1e-12)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("inf"), 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (100, []), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, 10, 100).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 1, 2**0.5)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_doubles_repeated_ids_and_names_that_clash(spark):
    """Of a query's rows the least vector asks; a candidate's nearest row counts; doubles aren't rounded."""
    tiny = 1.0 + 2.0**-40
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [tiny, 0.0]), (2, [0.0, tiny]), (2, [5.0, 5.0]), (3, [4.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0, "x", b"y") for i, v in rows], "vec_id long, embedding array<double>, part int, kind string, ids binary")
    got = [(r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, 10, 100).orderBy("rank").collect()]
    assert got == [(1, 2, 2.0**-40), (2, 1, np.sqrt(tiny**2 + 1)), (3, 3, 5.0)]


def test_small_blocks_and_parts_give_the_same(spark, monkeypatch):
    x = vectors(900, 16, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = lambda: [tuple(r) for r in neighbours.nearest(df, 5, 20).orderBy("query_id", "rank").collect()]
    want = rows()
    for name, value in {"INDEX_BLOCK": 64, "QUERY_BLOCK": 3, "PART_BLOCKS": 1}.items():
        monkeypatch.setattr(neighbours, name, value)
    assert rows() == want and len(want) == 45 * 5


def test_blocks_retrieve_every_code_within_the_radius():
    x = vectors(2000)
    coder = neighbours.learn(x, 10)
    codes = coder.codes(x)
    values = codes.view("<u2")
    orders = np.argsort(values, axis=0, kind="stable").T.astype("<u2")
    row = {"ids": np.arange(2000, dtype="<i8").tobytes(), "vectors": x.tobytes(), "codes": codes.tobytes(), "orders": orders.tobytes(), "offsets": np.take_along_axis(values.T, orders.astype(np.int64), 1).tobytes()}
    block, balls = neighbours.Block(row, 32, "<f4"), neighbours.hamming_balls()
    for radius in (0, 15, 16, 40, 70, 110):
        for q in (0, 7, 500):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(1) <= radius)
            assert (np.sort(block.within(codes[q], radius, balls)) == want).all()


# decontamination

def test_blocks_of_items_and_very_long_texts(spark, monkeypatch):
    items = ["the quick brown fox jumps over the lazy dog and runs away from it", "another item that has some forty characters in it", None, "", "a third one, in block letters and with commas"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(0, items[0], "y")], "item_id long, text string, doc_id string")
    long = "word " * 500_000 + items[0].replace("lazy", "lasy") + " word" * 500_000
    rows = [(1, long, 0), (2, "\n" * 5_000_000 + items[1].upper(), 0), (3, "x" * 5_000_000, 0), (4, None, 0), (5, items[4], 0), (5, items[4], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance int").repartition(4)
    found = lambda: sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    want = [(1, 0, 1), (1, 0, 1), (2, 1, 0), (5, 4, 0), (5, 4, 0)]
    assert found() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 50)
    assert found() == want
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == decontaminate.contaminated(docs.limit(0), bench).count() == 0


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != c)))
    return min(row)


def test_items_match_brute_force(spark):
    rnd = random.Random(4)
    alphabet = "abcdefgh  é"
    items = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(12, 90)))) for i in range(15)] + [(50, None), (51, ""), (52, "  \n"), (53, "Tiny"), (54, "Tiny")]
    docs = [(1, None), (2, ""), (3, "nothing tINy \n here")]
    for d in range(4, 90):
        text = list(rnd.choice(items[:15])[1])
        for _ in range(rnd.randint(0, max(1, len(text) // 6))):
            k = rnd.randrange(len(text))
            rnd.choice([lambda: text.pop(k) if len(text) > 1 else None, lambda: text.insert(k, rnd.choice(alphabet)), lambda: text.__setitem__(k, rnd.choice(alphabet))])()
        noise = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120)))
        docs.append((d, noise() + "".join(text).upper() + noise()))
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontaminate.contaminated(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), 0.1).collect()}
    want = {}
    for d, t in docs:
        for i, p in items:
            pattern, text = decontaminate.normal(p or ""), decontaminate.normal(t or "")
            if pattern and (n := plain_distance(pattern, text)) <= int(0.1 * len(pattern)):
                want[(d, i)] = n
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 20
    texts, patterns = dict(docs), dict(items)
    for (d, i), (n, a, b) in got.items():
        found, pattern = decontaminate.normal(texts[d])[a:b], decontaminate.normal(patterns[i])
        assert plain_distance(pattern, found) == n
    empty = spark.createDataFrame([], "item_id long, text string")
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontaminate.contaminated(docs_df, empty).count() == 0 and decontaminate.contaminated(docs_df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    kept = decontaminate.drop_contaminated(docs_df.union(spark.createDataFrame([(None, "Tiny")], "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {None}


# chat

def test_chat_of_an_empty_table_clashing_names_and_long_turns(spark):
    schema = "conv_id long, turn long, role string, text string, seq string, loss int, n_turns string"
    assert chat.chat_report(spark.createDataFrame([], schema)).count() == 0
    long = "\\#<: " * 400_000
    rows = [(1, 0, "user", long, "a", 1, "b"), (1, 1, "assistant", long, "a", 1, "b"), (1, 1, "assistant", long, "a", 1, "b"), (None, None, None, None, None, None, None)]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (3, 2 * len(long))
    assert got[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
    assert (got[None].n_turns, got[None].loss_chars) == (1, 0)



TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho \\ # < : </turn>\n### user: "),
    (2, 1, "assistant", "first"), (2, 0, None, None), (2, 2, "odd: role\\", ""),
    (3, None, "user", "no turn"), (3, 0, "user", "twice"), (3, 0, "assistant", "twice"),
    (4, 0, "user", "a" * 5000), (4, 1, "assistant", "é日本😀"), (None, 0, "user", "no id"),
]


def test_chat_round_trip_and_order(spark):
    df = chat.with_probe(spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, seq int").repartition(4))
    rows = [*TURNS, *chat.PROBE]
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    assert got.keys() == {r[0] for r in rows}
    segments = chat.format_conversations(df).collect()
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(role or "", text or "") for _, _, role, text in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        text = "".join(s.text for s in sorted((s for s in segments if s.conv_id == c), key=lambda s: s.seq))
        assert got[c].n_turns == len(own) and got[c].formatted_chars == len(text)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r.valid} == {1, 4, -7}
    assert chat.chat_report(df.limit(0)).count() == 0
