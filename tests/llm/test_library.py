import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import library
from quillon.llm.binary import token_file_report, write_token_files
from quillon.llm.library import LibraryEncoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(BYTE, encoding="utf-8").read()
ATOMS = ["the", "été", "Über", "naïve", "don't", "we'll", "a", "Z", "x×y", "÷", "12", "3.5", "½", "日本語", "नमस्ते", "Ω", "жук", "😀", "é", "́", "\x00", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "!?", ";", ":", "'", "'s", '"', "(", "-", "_", "<|endoftext|>", "<|endof", "text|>", "wörter" * 9, "q" * 40]


def made(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice(ATOMS) + rnd.choice(["", " ", " ", " ", "\n", ", ", ". "]) for _ in range(n))


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_ids_are_the_librarys(most):
    rnd = random.Random(most)
    plain = Tokenizer.from_str(SPEC)
    encoder = LibraryEncoder(SPEC, most)
    for _ in range(4):
        texts = [made(rnd, rnd.choice([0, 1, 2, 5, 40])) for _ in range(300)]
        got = list(encoder.encode([t.encode() for t in texts]))
        for t, g in zip(texts, got, strict=True):
            assert g.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(library, "BLOCK", 1000)
    rnd = random.Random(3)
    plain = Tokenizer.from_str(SPEC)
    texts = [t.replace("<|endoftext|>", "") for t in (made(rnd, 3000), "x" * 9000, "\n" * 9000, "é" * 5000 + " b" * 3000, "")]
    for t, g in zip(texts, LibraryEncoder(SPEC).encode([t.encode() for t in texts]), strict=True):
        assert g.tolist() == plain.encode(t, add_special_tokens=False).ids


def test_bytes_that_are_no_utf8_are_replaced():
    plain = Tokenizer.from_str(SPEC)
    (got,) = LibraryEncoder(SPEC).encode([b"a \xff b\xc3"])
    assert got.tolist() == plain.encode("a � b�", add_special_tokens=False).ids


def test_the_least_id_is_not_null_and_other_columns_have_no_effect(spark):
    rows = [(-(1 << 63), "a", "x"), (None, "b c", "y"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = token_file_report(write_token_files(docs, BYTE)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 3), (-(1 << 63), 2), (5, 1)]


def test_shards_end_when_full(spark):
    docs = spark.createDataFrame([(i, "many words here " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    manifest = write_token_files(docs, BYTE, shard_bytes=2000)
    assert manifest.count() > 15
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 40
    starts = [r.start for r in token_file_report(manifest).orderBy("doc_id").collect()]
    assert np.all(np.diff(starts) == starts[1])


def test_a_cluster_needs_a_shared_folder_and_discard_deletes(spark, tmp_path):
    from types import SimpleNamespace

    from quillon.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_root(cluster)
    mark = common.made()
    first, last = (common.materialize(spark.range(k), "part") for k in (3, 5))
    common.discard(spark, mark, keep=1)
    assert last.count() == 5 and common.made() == mark + 1
    with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
        first.count()
