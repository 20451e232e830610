"""SimHash fingerprints, pigeonhole block joins and near-duplicate groups.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A shingle is k
consecutive words joined by one space (a text of fewer words is one shingle, a text of none has none, and
null counts as empty). A fingerprint's bit is 1 if it is set in over half of the shingles' hashes.

Rows are grouped by fingerprint before any join, so exact copies, repeated rows and ties cost one row.
Rows without doc_id get a fingerprint and take part in no component of their own making (their component
is that of their fingerprint, null if only they have it). Only doc_id and text are read, whatever other
columns are called. An empty table gives no rows. A text of any length is one slice of its own: some 40 bytes
of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions_for, slices, spread_join
from quillon.llm.links import candidate_links, components, crowd_links, exact_links, star_links

SEED = 42
BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    words = text.lower().split()
    n = len(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - k] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each run of `lens` hashes, the 64 bits that are set in over half of it (0 for an empty run).

    Eight bits at a time are added as the bytes of one 64-bit sum, over up to 255 hashes; then the bytes.
    """
    out = np.zeros(len(lens), np.uint64)
    full = np.flatnonzero(lens > 0)
    if not len(full):
        return out
    lens = lens[full]
    starts = np.cumsum(lens) - lens
    pieces = -(-lens // 255)
    first = np.cumsum(pieces) - pieces
    step = (np.arange(pieces.sum()) - np.repeat(first, pieces)) * 255
    cuts = np.repeat(starts, pieces) + step
    got = np.zeros(len(full), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & BYTES, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        for byte in range(8):
            got |= (2 * counts[:, byte] > lens).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = got
    return out


def _runs(texts: list[bytes], k: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles, one after the other, and their numbers; distinct: a repeated shingle counts once."""
    own = [shingle_hashes(t, k) for t in texts]
    if distinct:
        own = [list(set(o)) for o in own]
    lens = np.fromiter(map(len, own), np.int64, len(own))
    return np.fromiter((h for o in own for h in o), np.uint64, int(lens.sum())), lens


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (64 bits, as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(majority(*_runs(texts, shingle)).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def block_rows(codes: DataFrame) -> DataFrame:
    """key, node, code: 16 rows for each distinct fingerprint, so that any two at most 3 bits apart share a key.

    Pigeonhole twice: of four 16-bit blocks one is equal; of the other 48 bits' four 12-bit blocks one is equal too.
    """
    keys = []
    for i in range(4):
        rest = [f"(shiftrightunsigned(fingerprint, {16 * b}) & 65535)" for b in range(4) if b != i]
        tail = f"({rest[0]} | shiftleft({rest[1]}, 16) | shiftleft({rest[2]}, 32))"
        for j in range(4):
            keys.append(f"{(i * 4 + j) << 28}L | shiftleft(shiftrightunsigned(fingerprint, {16 * i}) & 65535, 12) | (shiftrightunsigned({tail}, {12 * j}) & 4095)")
    return codes.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), F.col("fingerprint").alias("node"), F.col("fingerprint").alias("code"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of at most 3 bits)."""
    if radius > 3:
        raise ValueError("the block scheme holds for at most 3 differing bits")
    n = partitions_for(docs)
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    own = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    roots = components(exact_links(block_rows(own), radius, n)).toDF("fingerprint", "root")
    own = own.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    own = materialize(own.join(least, "root").select("fingerprint", "component_id", "copies"), "fingerprint-components")
    return spread_join(prints, own, "fingerprint", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# Wide fingerprints: similarity 0.8 of five-word shingles

WORDS = 20
#: Index keys a document, and least hashes in each: texts of similarity s share a key with probability 1 - (1 - s ** DEEP) ** BANDS.
BANDS, DEEP = 20, 6
#: Bands of the first round.
FEW = 3
#: Of 1,280 bits. A Jaccard similarity s has cosine 2s / (1 + s); at 0.8 some 194 bits differ (deviation 13). More than this, three deviations, is no pair.
WIDE_RADIUS = 232
#: Least estimate of a pair: the fingerprints' similarity and the share of equal least hashes, weighted by their variances, have a deviation of 0.023.
LEAST, WEIGHT = 0.77, 0.6


def estimate(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from differing fingerprint bits and the least hashes' low bytes, which follow the fingerprint."""
    cosine = np.cos(np.pi * apart / (64 * WORDS))
    equal = (a[:, 8 * WORDS :] == b[:, 8 * WORDS :]).mean(1)
    return WEIGHT * cosine / (2 - cosine) + (1 - WEIGHT) * (equal - 1 / 256) / (1 - 1 / 256)


def alike(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return estimate(apart, a, b) >= LEAST


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, wide, bands. wide: WORDS x 64 bits, each word from its own mix of a shingle's hash, then the low byte of each least hash; bands: the index keys.

    Each distinct shingle votes once. Texts without a word have the fingerprint and the keys of the empty set.
    """
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
    orders = rng.integers(1 << 62, 1 << 63, (BANDS, DEEP), dtype=np.uint64) | np.uint64(1)

    def mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            hashes, lens = _runs(texts, shingle, distinct=True)
            words = np.zeros((len(lens), WORDS), "<u8")
            for w in range(WORDS):
                words[:, w] = majority(mixed(hashes * odd[w]), lens)
            full = np.flatnonzero(lens)
            starts = np.cumsum(lens[full]) - lens[full]
            keys, low = np.zeros((len(lens), BANDS), np.uint64), np.zeros((len(lens), BANDS * DEEP), np.uint8)
            for b in range(BANDS if len(full) else 0):
                key = np.full(len(full), b + 1, np.uint64)
                for k, o in enumerate(orders[b]):
                    least = np.minimum.reduceat(hashes * o, starts)
                    low[full, b * DEEP + k] = least.astype(np.uint8)
                    key = mixed((key ^ least) * odd[0])
                keys[full, b] = key
            wide = np.concatenate([words.view(np.uint8), low], 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in wide], pa.binary()), flat], names=["doc_id", "wide", "bands"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, wide binary, bands array<long>")


def band_rows(codes: DataFrame, most: int = BANDS) -> DataFrame:
    """key, node, code, and root if codes have it: a row for each of the first `most` bands; nothing is left to check by code."""
    others = [c for c in ("root",) if c in codes.columns]
    return codes.select(F.explode(F.slice("bands", 1, most)).alias("key"), "node", F.lit(0).cast("long").alias("code"), *others)


def near_duplicate_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, group_id: the least doc_id of the documents linked by five-word similarity of about 0.8 or more.

    Equal fingerprints are one node. Nodes that share a key of DEEP least hashes, 0.998 of the pairs of similarity
    0.8, are verified on all bits of their wide fingerprints and all least hashes (`alike`): 0.9 of the pairs at
    just 0.8 pass, 0.98 at 0.82, a fifth at 0.75, one in a thousand at 0.7. Few bands first join each node with the
    least of its bucket; then all bands give the pairs that are not joined yet, so a large group of copies costs
    a few pairs a node in place of all.

    Null and empty texts are alike (no shingle); a text of fewer words than a shingle is one shingle. Repeated
    rows are one node; rows of one doc_id with several texts are linked. Rows without doc_id are left out. An
    empty table gives no rows. Only doc_id and text are read. A very long text is one slice: some 40 bytes a word.
    """
    n = partitions_for(docs)
    prints = materialize(wide_fingerprints(docs, shingle), "wide")
    own = prints.groupBy("wide").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("copies"))
    own = materialize(own.select("wide", F.col("first.doc_id").alias("node"), F.col("first.bands").alias("bands"), "copies"), "distinct-wide")
    whole = own.select("wide", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
            apart = np.bitwise_count(a[:, : 8 * WORDS] ^ b[:, : 8 * WORDS]).sum(1, dtype=np.int64)
            yield batch.select(["u", "v"]).filter(pa.array((apart <= WIDE_RADIUS) & alike(apart, a, b)))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "candidates", large=True)
        pairs = pairs.join(whole.toDF("a", "u"), "u").join(whole.toDF("b", "v"), "v")
        return pairs.select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")

    stars = components(verified(star_links(band_rows(own, FEW), 64, n)))
    joined = materialize(own.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
    met = materialize(candidate_links(band_rows(joined), 64, n), "meetings", large=True)
    rest = stars.toDF("v", "u").select("u", "v").union(verified(met.where("key is null").select("u", "v").distinct()))
    crowds = met.where("key is not null")
    if not crowds.isEmpty():
        members = crowds.select(F.col("u").alias("node"), "key", "part").join(joined.select("node", "root", "wide"), "node")
        rest = rest.union(crowd_links(members, WIDE_RADIUS, n, WORDS, alike))
    roots = components(rest)
    own = materialize(own.join(roots, "node", "left").select("wide", F.coalesce("root", "node").alias("group_id"), "copies"), "wide-groups")
    return spread_join(prints.select("doc_id", "wide"), own, "wide", "doc_id").select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without the documents that are not the first (least doc_id) of their group; rows without doc_id stay."""
    later = near_duplicate_groups(docs, shingle).where("doc_id <> group_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)
