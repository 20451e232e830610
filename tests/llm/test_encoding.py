import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm.binary import Shard, token_file_report, unpack, pack, width_of, write_shard, write_token_files
from quillon.llm.bpe import WordBpe
from quillon.llm.encoding import bpe_digest, bpe_encode, read_file, token_counts
from quillon.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "\n\n", "Hello  there,\tyou're <|endoftext|>x", "a" * 3000, "ΣΑΣ Éé 日本 ß İ 12\x1c3", "é it's 'll", "the same", "the same", " lead", "trail ", "a \nb\n c  d e\x85f", "<|startoftext|><|endoftext|>", "x" + "́" * 300]


def fuzz(n):
    rnd = random.Random(7)
    alphabet = "aabbcdeit'sßΣÉé日本  \t\n\x1cć<|endoftext|>!!..12"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string, n_tokens int")


@pytest.fixture(scope="module")
def texts():
    return TEXTS + fuzz(200)


def test_codec_matches_the_library(spark, texts):
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe_digest(docs_of(spark, texts), WORD).collect()}
    plain = {r.doc_id: r for r in bpe_encode(docs_of(spark, texts), WORD).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert plain[i].ids == ids, t
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        text = library.decode(ids, skip_special_tokens=False)
        assert plain[i].decoded == text
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_counts_match_the_library(spark, texts):
    library = Tokenizer.from_file(WORD)
    for r in token_counts(docs_of(spark, texts), WORD, 10).collect():
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 10)


def test_both_engines_agree_on_long_and_periodic_words():
    bpe = WordBpe(read_file(WORD))
    rnd = random.Random(3)
    words = ["a" * 5000, "ab" * 20_000,  "ab" * 700, "thethethe" * 90, "".join(rnd.choice("etaoinshr") for _ in range(4000)), "x"]
    assert bpe.rank_synchronous_count(words).tolist() == [len(a) for a in bpe.segment_tree_merge(words)]


def test_token_files_match_the_library(spark, texts):
    library = Tokenizer.from_file(BYTE)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = docs_of(spark, texts).repartition(3)
    manifest = write_token_files(docs, BYTE, shard_bytes=4 << 10)
    got = {r.doc_id: r for r in token_file_report(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert len(got) == len(texts)


def test_token_files_of_an_empty_table_and_of_repeated_and_null_ids(spark):
    assert token_file_report(write_token_files(docs_of(spark, []), BYTE)).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = token_file_report(write_token_files(rows, BYTE)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (1, 3), (1, 3)]


@pytest.mark.parametrize("width", [1, 3, 13, 16, 17, 31])
def test_packing_round_trips_and_reads_at_random(width):
    rnd = np.random.default_rng(width)
    ids = rnd.integers(0, 1 << width, 50_000, dtype=np.uint64).astype(np.uint32)
    assert (unpack(pack(ids, width), width, len(ids)) == ids).all()
    lens = np.array([0, 20_000, 1, 29_999, 0])
    shard = Shard(write_shard(np.arange(5), lens, ids, width))
    ends = np.cumsum(lens)
    for i in range(5):
        assert (shard.document(i) == ids[ends[i] - lens[i] : ends[i]]).all()
    assert (shard.ids(16_380, 33_000) == ids[16_380:33_000]).all()


def test_every_code_point_is_cut_as_the_library_does():
    bpe, library = WordBpe(read_file(WORD)), Tokenizer.from_file(WORD)
    points = [c for c in [*range(0x30000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c <= 0xDFFF]
    differ = []
    for k in range(0, len(points), 4000):
        texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}" for c in points[k : k + 4000]]
        cuts = [[w for c in bpe.cut(t) for w in (c if isinstance(c, tuple) else bpe.pre_tokens(c))] for t in texts]
        words = sorted({w for ws in cuts for w in ws})
        ids = dict(zip(words, (a.tolist() for a in bpe.segment_tree_merge(words)), strict=True))
        for c, e, ws in zip(points[k : k + 4000], library.encode_batch(texts, add_special_tokens=False), cuts, strict=True):
            if e.ids != [i for w in ws for i in ids[w]]:
                differ.append(hex(c))
    assert not differ


def test_very_long_texts_and_words(spark):
    library = Tokenizer.from_file(WORD)
    rnd = random.Random(5)
    some = " ".join(rnd.choice(TEXTS[4:9]) + str(rnd.randrange(10**6)) for _ in range(60_000))
    texts = ["\n" * 5_000_000, "".join(rnd.choice("etaoinshr") for _ in range(100_000)), some, "é " * 400_000]
    assert len(some) > 1 << 20
    rows = docs_of(spark, texts)
    counts = {r.doc_id: r.n_tokens for r in token_counts(rows, WORD).collect()}
    got = {r.doc_id: r for r in bpe_digest(rows, WORD).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert counts[i] == got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_widths():
    assert [width_of(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]
