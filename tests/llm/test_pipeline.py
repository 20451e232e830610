"""Each stage of the corpus pipeline against brute force, on a small corpus with nulls, repeats, ties and clashing names."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm.test_dedup import brute_words
from tests.llm.test_simhash import jaccard_pairs
from tokenizers import Tokenizer

from quillon.llm import quality
from quillon.llm.queries import tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans int, score string, wide int, root int, __salt int, distance string"
ITEMS = ["which of the following rivers flows through the largest number of countries", "a train leaves the station at nine and travels at sixty miles an hour", "short one"]


def corpus():
    rnd = random.Random(12)
    word = lambda: rnd.choice("abcdefghijklm") + rnd.choice("aeiou") + str(rnd.randrange(10**5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [text(rnd.randint(80, 200)) for _ in range(30)]
    rows += [rows[3], rows[4] + " " + word(), rows[5].upper(), rows[6]]
    rows += [text(50) + "\n" + passage + "\n" + text(50) for _ in range(4)]
    rows += [text(40) + " " + ITEMS[0] + " " + text(40), text(40) + " " + ITEMS[1].replace("miles", "mils").upper() + " " + text(9), ITEMS[2] + " " + text(30)]
    rows += ["", None, " ", "one", text(2), "junk !!! $$$ |||\n" * 40]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(None, "kept as it has no id " + text(30)), (None, None), (7, rows[7])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{i % 3}", len(t or ""), "k", i, "x", 1, 2, 3, None) for i, (d, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Tables for the stages that read more than docs."""
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i != 46), 0) for i in range(47)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([*enumerate(ITEMS), (9, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.text is None) for r in df.select("doc_id", "text").collect())


def plain(rows):
    return sorted((d is not None, d or 0, t or "", t is None) for d, t in rows)


def test_quality(spark, docs, folder):
    labels, table = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    field = quality.train(table, labels)
    got = pipeline.quality(spark, docs, folder)
    assert got.schema == docs.schema
    assert ids(got) == plain([(d, t) for d, t in corpus() if field.scores([(t or "").encode()])[0] >= 0.3])


def test_near_duplicates(spark, docs, folder):
    rows = corpus()
    own = [(d, t) for d, t in rows if d is not None]
    least = {d: d for d, _ in own}
    empty = sorted(d for d, t in own if not (t or "").split())
    for a, b in sorted([*jaccard_pairs(own, 0.8), *((empty[0], e) for e in empty[1:])]):
        old, new = sorted((least[a], least[b]))[::-1]
        least = {d: new if x == old else x for d, x in least.items()}
    assert not [s for s in jaccard_pairs(own, 0.5).values() if s < 0.85], "the fixture has no pair near the threshold"
    got = pipeline.near_duplicates(spark, docs, folder)
    assert got.schema == docs.schema
    assert ids(got) == plain([(d, t) for d, t in rows if d is None or least[d] == d])


def test_substrings(spark, docs, folder):
    rows = corpus()
    got = pipeline.substrings(spark, docs, folder)
    assert got.schema.names == docs.schema.names
    want = brute_words([(d, t) for d, t in dict(r for r in rows if r[0] is not None).items()], 20)
    texts = {}
    for r in got.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text or "")
    for d, t in rows:
        if d is None:
            assert t in texts[None]
        elif want[d][1] == 0:
            assert t in texts[d]
        elif want[d][1] == want[d][0]:
            assert d not in texts
        else:
            assert len(texts[d][0].split()) == want[d][0] - want[d][1]


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != c)))
    return min(row)


def test_decontamination(spark, docs, folder):
    rows = corpus()
    near = lambda t: any(least_edits(i, " ".join((t or "").lower().split())) <= len(i) // 10 for i in ITEMS)
    got = pipeline.decontamination(spark, docs, folder)
    assert got.schema == docs.schema
    want = [(d, t) for d, t in rows if d is None or not near(t)]
    assert ids(got) == plain(want) and len(want) == len(rows) - 3


def test_encoding(spark, docs, folder):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), list(r.ids), r.decoded) for r in pipeline.encoding(spark, docs, folder).collect())
    want = []
    for d, t in corpus():
        own = library.encode(t or "", add_special_tokens=False).ids
        want.append(((d is not None, d or 0), own, library.decode(own, skip_special_tokens=False)))
    assert got == sorted(want)


def test_every_stage_of_an_empty_table(spark, docs, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0, name
        if name != "encoding":
            assert out.columns == docs.columns, name


def test_run_is_the_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    seen = documents
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in seen.select("doc_id").collect()}
        seen = stage(spark, seen, sf)
        assert seen.schema.names == documents.schema.names, name
        after = {r.doc_id for r in seen.select("doc_id").collect()}
        assert after <= before and after, name
    got = pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").collect()} == after
    assert got.where(F.col("ids").isNull()).count() == 0
