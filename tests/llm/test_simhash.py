import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import links, simhash
from quillon.llm.common import spread_join


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, k=3, radius=3):
    prints = [fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
        out[d] = (f"{prints[i]:016x}", least)
    return out


def corpus(seed=5, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " ", "one", "one two", "A b C", "a B c", "\n\t", "é ü"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(3, 400))) for _ in range(20)]
    while len(texts) < n:
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    return [(1000 - 3 * i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fingerprint string, component_id int")


def test_components_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_large_buckets_are_dealt_and_give_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    codes = sorted({(0xABCDEF << 40) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(400)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = simhash.block_rows(spark.createDataFrame([(c,) for c in signed], "fingerprint long"))
    real = links.deal
    monkeypatch.setattr(links, "deal", lambda rows, **kw: real(rows, most=40, **kw))
    got = {(r.node, r.root) for r in links.components(links.exact_links(rows, 3)).collect()}
    root = {c: c for c in signed}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    linked = {c: find(c) for c in signed}
    assert got == {(c, r) for c, r in linked.items() if c != r or list(linked.values()).count(r) > 1}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_stars_and_candidates_of_a_bucket(spark):
    rows = [(1, 10, 0b0, 10), (1, 11, 0b1, 10), (1, 12, 0b11, 12), (2, 11, 0b0, 10), (2, 12, 0b0, 12), (2, 13, -1, 13), (3, 12, 0, 12)]
    frame = spark.createDataFrame(rows, "key long, node long, code long, root long")
    pairs = lambda df: sorted((r.u, r.v) for r in df.collect())
    assert pairs(links.star_links(frame.drop("root"), 1)) == [(10, 11), (11, 12)]
    assert pairs(links.candidate_links(frame, 2)) == [(10, 12), (11, 12)], "10 and 11 are of one root"


def test_a_large_group_of_near_copies_is_found_whole(spark):
    rnd = random.Random(4)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(200)]
    rows = [(7, " ".join(base))]
    for i in range(300):
        own = list(base)
        own[rnd.randrange(200)] = f"x{i}"
        rows.append((100 + i, " ".join(own)))
    rows += [(5000 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(200))) for i in range(20)]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == {d: 7 if d < 5000 else d for d, _ in rows}


def test_empty_table_and_null_and_repeated_ids(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "z y x w v")], "doc_id long, text string")
    got = simhash.simhash_components(rows).orderBy("doc_id", "component_id").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None), (None, 4), (4, 4), (4, 4)]


def test_near_duplicates_keep_the_first_of_each_group(spark):
    rnd = random.Random(9)
    rows, copies = [], set()
    for i in range(60):
        w = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 300))]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 3):
            edited = list(w)
            if k == 2:
                edited[rnd.randrange(len(w))] = "changed"
            rows.append((10 * i + k, " ".join(edited)))
            copies.add(10 * i + k)
    rows.append((9999, None))
    rows.append((None, "kept as it has no id"))
    kept = simhash.drop_near_duplicates(frame(spark, rows).withColumn("lang", F.lit("en")))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id", "lang"]
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 9999 in ids
    assert {i for i in ids if i is not None and i < 9999} == {10 * i for i in range(60)}


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {hash(tuple(words[i : i + k])) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_pairs(rows, least):
    """Brute force over all pairs: (a, b) to the Jaccard similarity of their five-word shingles, where it is at least `least`."""
    sets = [shingle_set(t) for _, t in rows]
    holders = {}
    for i, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(i)
    common = [h for h in holders.values() if len(h) > 50]
    dense = np.zeros((len(rows), len(common)), np.float32)
    for k, held in enumerate(common):
        dense[held, k] = 1
    both = dense @ dense.T
    for held in holders.values():
        if 1 < len(held) <= 50:
            both[np.ix_(held, held)] += 1
    sizes = np.array([len(x) for x in sets], np.float32)
    union = np.maximum(sizes[:, None] + sizes[None, :] - both, 1)
    i, j = np.nonzero(np.triu(both >= least * union, 1) & (both > 0))
    return {(rows[x][0], rows[y][0]): float(both[x, y] / union[x, y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)}


def template_rows(n=4000, pairs=200, seed=11):
    """Documents that share boilerplate (similarity about 0.65), `pairs` of them with a copy at about 0.87."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(10**7)}"
    shared = [word() for _ in range(190)]
    texts = [shared + [word() for _ in range(50)] for _ in range(n)]
    for i in range(pairs):
        copy = list(texts[5 * i + 3])
        for at in (20, 90, 215):
            copy[at + rnd.randrange(20)] = word()
        texts.append(copy)
    return [(d, " ".join(w)) for d, w in enumerate(texts)]


def test_pairs_within_a_template_group_match_brute_force(spark):
    rows = template_rows()
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    want = jaccard_pairs(rows, 0.8)
    found = sum(got[a] == got[b] for a, b in want)
    print(f"template group: {found} of {len(want)} pairs found, {len(set(got.values()))} groups")
    assert len(want) == 200 and found >= 0.985 * len(want)
    assert len(set(got.values())) == len(rows) - found, "documents that share only boilerplate are no copies"


def test_a_crowded_bucket_loses_no_pair_to_its_leader(spark):
    rnd = random.Random(3)
    wide = {0: rnd.getrandbits(1280)}

    def near(code, bits, lo=64):
        return code ^ sum(1 << b for b in rnd.sample(range(lo, 1280), bits))

    for i in range(1, 60):
        wide[i] = near(wide[0], 300)
    for i in range(60, 80):
        wide[i] = near(wide[i - 40], 150)
    rows = [(7, 0, n, 0, n, w.to_bytes(160, "little")) for n, w in wide.items()]
    df = spark.createDataFrame(rows, "key long, part long, node long, code long, root long, wide binary")
    met = links.candidate_links(df.select("key", "node", "code", "root"), 18).collect()
    assert {r.u for r in met if r.key == 7} == set(wide) and not [r for r in met if r.key is None]
    got = {tuple(sorted((r.u, r.v))) for r in links.crowd_links(df, 205).collect()}
    assert got == {(i - 40, i) for i in range(60, 80)}


def test_repeated_lines_neither_join_nor_part_documents(spark):
    rnd = random.Random(8)
    words = lambda n: [f"v{rnd.randrange(10**7)}" for _ in range(n)]
    footer, line, base = words(14), words(14), words(500)
    rows = [(i, " ".join(words(500) + footer * 30)) for i in (1, 2)]
    rows += [(10 + i, " ".join(base + line * n)) for i, n in enumerate((1, 10, 20))]
    want = jaccard_pairs(rows, 0.8)
    assert set(want) == {(10, 11), (10, 12), (11, 12)}
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 10: 10, 11: 10, 12: 10}


def test_recall_near_the_threshold_against_brute_force(spark):
    """Pairs of similarity 0.8 to 0.9: at least nine in ten are found, and few pairs below 0.72 are."""
    rnd = random.Random(21)
    word = lambda: f"v{rnd.randrange(10**7)}"
    rows, d = [], 0
    for _ in range(900):
        base = [word() for _ in range(rnd.randint(120, 400))]
        copy = list(base)
        for at in rnd.sample(range(len(base)), max(1, round(len(base) * rnd.uniform(0.008, 0.042)))):
            copy[at] = word()
        rows += [(d, " ".join(base)), (d + 1, " ".join(copy))]
        d += 2
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    every = jaccard_pairs(rows, 0.4)
    want = {p for p, s in every.items() if 0.8 <= s <= 0.9}
    found = sum(got[a] == got[b] for a, b in want)
    low = {p for p, s in every.items() if s < 0.72}
    wrong = sum(got[a] == got[b] for a, b in low)
    print(f"similarity 0.8 to 0.9: {found} of {len(want)}; below 0.72: {wrong} of {len(low)}")
    assert len(want) > 150 and found >= 0.93 * len(want)
    assert len(low) > 100 and wrong <= 0.03 * len(low)


def test_hot_keys_are_spread_and_join_the_same(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 7, id) as k")
    table = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    got = {(r.doc_id, r.k, r.least) for r in spread_join(rows, table, "k", "doc_id").collect()}
    assert got == {(i, 7 if i % 3 == 0 else i, 0 if i % 3 == 0 or i == 7 else i) for i in range(6000)}
