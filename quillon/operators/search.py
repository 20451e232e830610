"""Search over one committed view: exact totals, BM25 top-k with offset, point lookups.

The scan path evaluates the bound query as one filter and one projection over the stored token arrays.
The postings path reads only the query's terms: each postings file holds some documents, in runs by term, so a stop
word is spread over all files. Both give the same matches and scores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import DocumentNotFound, ValidationError
from quillon.functions import scoring
from quillon.functions.analyzer import analyze
from quillon.mapping import COMPRESSION, ID, SOURCE, Mapping, size_of, tokens_of
from quillon.plans.binder import Binder, statistics
from quillon.plans.parser import parse
from quillon.plans.tree import Bool, Boost, Node, Term

LIMIT, OFFSET = 10, 0
#: The ids of pages up to this limit are sent to the scan for their sources; larger pages are joined.
PAGE = 1000
#: Tokens that a task sorts at once for the postings, and postings that it hands on at once.
RUN, OUT = 4_000_000, 200_000
#: How postings' files are written: with a dictionary of up to 8 MB for a column, the ids' above all.
STORED = {"compression": COMPRESSION, "parquet.bloom.filter.enabled#term": "true", "parquet.dictionary.page.size": str(1 << 23)}


@dataclass
class Result:
    hits: DataFrame
    total: int


def matches(docs: DataFrame, mapping: Mapping, query: str) -> DataFrame:
    """docs that match, unranked; filters on typed columns reach the scan."""
    return docs.where(Binder(mapping).bind(parse(query)).match)


def scored(docs: DataFrame, mapping: Mapping, query: str) -> DataFrame:
    """_id, score of all matching documents."""
    bound = Binder(mapping).bind(parse(query))
    stats = statistics(docs, mapping, bound.terms)
    return docs.where(bound.match).select(ID, bound.score(stats).alias("score"))


def ranked(scores: DataFrame, limit: int = LIMIT, offset: int = OFFSET) -> DataFrame:
    """Best first, ties by _id; a bounded heap a task, not a sort."""
    if limit < 0 or offset < 0:
        raise ValidationError("limit and offset can't be negative")
    return scores.orderBy(F.desc("score"), F.asc(ID)).offset(offset).limit(limit)


def total(docs: DataFrame, mapping: Mapping, query: str) -> DataFrame:
    """One row: the exact number of matches, whatever the page."""
    return matches(docs, mapping, query).agg(F.count(F.lit(1)).alias("total"))


def with_source(docs: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Sources of a page of hits only: the ranking never read them, and the page's ids reach the scan as a filter."""
    if limit <= PAGE:
        page = hits.collect()  # at most `limit` rows
        hits = F.broadcast(docs.sparkSession.createDataFrame(page, f"{ID} string, score double"))
        docs = docs.where(F.col(ID).isin([r[ID] for r in page]))
    return hits.join(docs.select(ID, SOURCE), ID).select(ID, "score", SOURCE).orderBy(F.desc("score"), F.asc(ID))


def search(docs: DataFrame, mapping: Mapping, query: str = "", limit: int = LIMIT, offset: int = OFFSET) -> Result:
    """A page of hits (_id, score, _source) and the total, both of the one view that docs is."""
    count = total(docs, mapping, query).first()["total"]
    if limit == 0 or not count:
        return Result(docs.select(ID, F.lit(0.0).alias("score"), SOURCE).limit(0), count)
    return Result(with_source(docs, ranked(scored(docs, mapping, query), limit, offset), limit), count)


def get(docs: DataFrame, doc_id: str) -> DataFrame:
    """_id, _source of one document, or no row; the id reaches the scan as a filter."""
    return docs.where(F.col(ID) == doc_id).select(ID, SOURCE).limit(1)


def get_source(docs: DataFrame, doc_id: str) -> str:
    row = get(docs, doc_id).first()
    if row is None:
        raise DocumentNotFound(doc_id)
    return row[SOURCE]


def existing(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (_id) with exists: whether the committed view has them."""
    return ids.join(docs.select(ID, F.lit(True).alias("exists")), ID, "left").select(ID, F.coalesce("exists", F.lit(False)).alias("exists"))


# The postings path

POSTINGS = f"field string, term string, {ID} string, tf long, length int"
#: As the catalog stores them: a row for a term in a run, its documents as a JSON array of [_id, length].
PACKED = "field string, term string, docs string, tf array<int>"
PACKED_STORED = {"compression": COMPRESSION, "parquet.compression.codec.zstd.level": "1", "parquet.bloom.filter.enabled#term": "true"}


def postings(docs: DataFrame, mapping: Mapping) -> DataFrame:
    """field, term, _id, tf, length of every token and keyword."""
    out = None
    for f in mapping.default_fields():
        if mapping.fields[f].type == "text":
            t = F.col(f"`{tokens_of(f)}`")
            part = docs.select(ID, F.size(t).alias("length"), F.explode(t).alias("term")).groupBy(ID, "term", "length").agg(F.count(F.lit(1)).alias("tf"))
        else:
            part = docs.where(F.col(f"`{f}`").isNotNull()).select(ID, F.col(f"`{f}`").alias("term"), F.lit(1).alias("length"), F.lit(1).cast("long").alias("tf"))
        part = part.select(F.lit(f).alias("field"), "term", ID, F.col("tf").cast("long").alias("tf"), F.col("length").cast("int").alias("length"))
        out = part if out is None else out.union(part)
    if out is None:
        raise ValidationError("the mapping has no indexed text or keyword")
    return out


def write_postings(docs: DataFrame, mapping: Mapping, path: str) -> None:
    """postings() of docs of different ids, without a shuffle: a task writes the terms of its documents, in runs ordered by term.

    A term's rows lie together in each run, so statistics of pages leave a query those rows; a stop word is in every file,
    never in one. Ids repeat for each term and are few in a file: its dictionary holds them.
    """
    fields = [(f, mapping.fields[f].type == "text") for f in mapping.default_fields()]
    rows = docs.select(ID, *[F.col(f"`{tokens_of(f) if text else f}`").alias(f"f{i}") for i, (f, text) in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += sum(len(pc.list_flatten(b.column(f"f{i}"))) if text else b.num_rows for i, (_, text) in enumerate(fields))
            if size >= RUN:
                yield from _term_runs(pa.Table.from_batches(held), fields)
                held, size = [], 0
        if held:
            yield from _term_runs(pa.Table.from_batches(held), fields)

    rows.mapInArrow(run, POSTINGS).write.options(**STORED).parquet(path)


def write_packed(docs: DataFrame, mapping: Mapping, path: str) -> None:
    """write_postings() with a row for a term's postings in a run, so that a row is made for a term and not for each posting.

    docs: as segments hold them, tokens as one string. The documents of a term are one string too, whatever is in their ids.
    """
    fields = [(f, mapping.fields[f].type == "text") for f in mapping.default_fields()]
    rows = docs.select(ID, *[F.col(f"`{tokens_of(f) if text else f}`").alias(f"f{i}") for i, (f, text) in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            columns = [_words(b.column(f"f{i}")) if text else b.column(f"f{i}") for i, (_, text) in enumerate(fields)]
            held.append(pa.RecordBatch.from_arrays([b.column(ID), *columns], names=b.schema.names))
            size += sum(len(c.values) if text else b.num_rows for c, (_, text) in zip(columns, fields, strict=True))
            if size >= RUN:
                yield from _packed_runs(pa.Table.from_batches(held), fields)
                held, size = [], 0
        if held:
            yield from _packed_runs(pa.Table.from_batches(held), fields)

    rows.mapInArrow(run, PACKED).write.options(**PACKED_STORED).parquet(path)


def _words(texts: pa.Array) -> pa.Array:
    """The token lists of joined tokens; that of an empty string has none."""
    return pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")


def unpacked(rows: DataFrame) -> DataFrame:
    """field, term, _id, tf, length of packed postings; a filter on field and term reaches their scan."""
    each = F.explode(F.arrays_zip(F.from_json("docs", "array<array<string>>").alias("doc"), "tf")).alias("p")
    doc = F.col("p.doc")
    return rows.select("field", "term", each).select("field", "term", doc[0].alias(ID), F.col("p.tf").cast("long").alias("tf"), doc[1].cast("int").alias("length"))


def _packed_runs(rows: pa.Table, fields: list[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    """The packed postings of some documents, for each field by term."""
    ids = pa.array([json.dumps(d, ensure_ascii=False) for d in rows.column(ID).to_pylist()], pa.large_string())
    glue = lambda *parts: pc.binary_join_element_wise(*[p if isinstance(p, pa.Array) else pa.scalar(p, pa.large_string()) for p in (*parts, "")])
    for field, key, tf, terms, lengths in _sorted_terms(rows, fields):
        docs = glue("[", ids, ",", pa.array(lengths).cast(pa.large_string()), "]")
        for k in range(0, len(key), OUT):
            term, doc = key[k : k + OUT] // len(docs), key[k : k + OUT] % len(docs)
            at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            ends = pa.array(np.append(at, len(term)).astype(np.int32))
            own = pc.binary_join(pa.ListArray.from_arrays(ends, docs.take(pa.array(doc))), pa.scalar(",", pa.large_string()))
            columns = [pa.repeat(field, len(at)), terms.take(pa.array(term[at])), glue("[", own, "]"), pa.ListArray.from_arrays(ends, pa.array(tf[k : k + OUT].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns], names=["field", "term", "docs", "tf"])


def _term_runs(rows: pa.Table, fields: list[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    """The postings of some documents, for each field by term and document."""
    ids = pc.cast(rows.column(ID).combine_chunks(), pa.large_string())
    for field, key, tf, terms, lengths in _sorted_terms(rows, fields):
        for k in range(0, len(key), OUT):
            part = key[k : k + OUT]
            d = part % len(ids)
            columns = [pa.repeat(field, len(part)), terms.take(pa.array(part // len(ids))), ids.take(pa.array(d)), pa.array(tf[k : k + OUT]), pa.array(lengths[d].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in columns], names=["field", "term", ID, "tf", "length"])


def _sorted_terms(rows: pa.Table, fields: list[tuple[str, bool]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Of each field that has any: its name, place of the term times documents plus place of the document (ascending), tf, the terms and the documents' lengths."""
    n = rows.num_rows
    for i, (field, text) in enumerate(fields):
        lists = rows.column(f"f{i}")
        if text:
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            doc, words = np.repeat(np.arange(n), lengths), pc.list_flatten(lists)
        else:
            lengths, doc, words = np.ones(n, np.int64), np.arange(n), lists
        there = words.is_valid().to_numpy()
        if not there.any():
            continue
        coded = pc.cast(words, pa.large_string()).combine_chunks().drop_null().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = np.sort(rank[coded.indices.to_numpy()] * n + doc[there])  # term, then document
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield field, key[at], np.diff(np.append(at, len(key))), coded.dictionary.take(pa.array(order)), lengths


def field_totals(docs: DataFrame, mapping: Mapping, stored: bool = False) -> dict[str, list[int]]:
    """For each default field, the documents that have it and its tokens (1 for a keyword); one aggregation. stored: docs are as segments hold them."""
    sums, column = [], size_of if stored else tokens_of
    for i, f in enumerate(mapping.default_fields()):
        c = F.col(f"`{column(f) if mapping.fields[f].type == 'text' else f}`")
        tokens = (c if stored else F.size(c)).cast("long") if mapping.fields[f].type == "text" else F.lit(1)
        sums += [F.count(c).alias(f"n{i}"), F.sum(tokens).alias(f"t{i}")]
    row = docs.agg(*sums).first() if sums else None
    return {f: [row[f"n{i}"], int(row[f"t{i}"] or 0) if mapping.fields[f].type == "text" else row[f"n{i}"]] for i, f in enumerate(mapping.default_fields())}


def term_stats(index: DataFrame) -> DataFrame:
    """field, term, df, ttf."""
    return index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def field_stats(docs: DataFrame, mapping: Mapping) -> DataFrame:
    """field, n_docs, n_tokens, avg_length of the text fields."""
    out = None
    for f in mapping.text_fields():
        t = F.col(f"`{tokens_of(f)}`")
        part = docs.where(t.isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(t).cast("long")).alias("n_tokens"), F.avg(F.size(t)).alias("avg_length")).select(F.lit(f).alias("field"), "n_docs", "n_tokens", "avg_length")
        out = part if out is None else out.union(part)
    return out


def has_postings(mapping: Mapping, query: str) -> bool:
    """Whether the query has only terms of a single token or keyword and boolean operators."""
    try:
        leaves, _ = _term_tree(mapping, parse(query))
    except ValidationError:
        return False
    return bool(leaves)


def _term_tree(mapping: Mapping, root: Node):
    """(field, term, boost) of each leaf, and a function that gives the row's (match, score) from columns s0, s1, ..."""
    leaves: list[tuple[str, str, float]] = []

    def collect(node: Node, boost: float = 1.0):
        if isinstance(node, Boost):
            return collect(node.node, boost * node.factor)
        if isinstance(node, Term):
            fields = [node.field] if node.field is not None else mapping.default_fields()
            own = []
            for f in fields:
                spec = mapping.indexed(f)
                if spec is None or spec.type not in ("text", "keyword"):
                    raise ValidationError(f"field {f!r} has no postings")
                words = analyze(node.text) if spec.type == "text" else [node.text]
                if len(words) > 1 or node.prefix:
                    raise ValidationError("phrases take the scan path")
                for w in words:
                    leaves.append((f, w, boost))
                    own.append(len(leaves) - 1)

            def leaf():
                hit = [F.col(f"s{i}") > 0 for i in own]
                match = hit[0] if hit else F.lit(False)
                for h in hit[1:]:
                    match = match | h
                return match, sum((F.col(f"s{i}") for i in own), F.lit(0.0))

            return leaf
        if isinstance(node, Bool):
            must, must_not, should = ([collect(n, boost) for n in part] for part in (node.must, node.must_not, node.should))

            def branch():
                m, x, s = ([f() for f in part] for part in (must, must_not, should))
                match = F.lit(True) if m else F.lit(False)
                for a, _ in m:
                    match = match & a
                if not m:
                    for a, _ in s:
                        match = match | a
                for a, _ in x:
                    match = match & ~a
                return match, F.when(match, sum((b for _, b in m + s), F.lit(0.0))).otherwise(F.lit(0.0))

            return branch
        raise ValidationError("only terms and boolean operators have postings")

    return leaves, collect(root)


def postings_scored(index: DataFrame, docs: DataFrame, mapping: Mapping, query: str, totals: dict[str, list[int]] | None = None) -> DataFrame:
    """_id, score for queries of terms and boolean operators, from postings; as scored() gives them. totals: field_totals() of docs."""
    leaves, build = _term_tree(mapping, parse(query))
    totals = field_totals(docs, mapping) if totals is None else totals
    wanted = sorted({(f, w) for f, w, _ in leaves})
    rows = index.where(F.col("field").isin(sorted({f for f, _ in wanted})) & F.col("term").isin(sorted({w for _, w in wanted})))
    df = {(r["field"], r["term"]): r["df"] for r in rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the query
    sums = []
    for i, (f, w, boost) in enumerate(leaves):
        n, tokens = totals[f]
        weight = scoring.idf(n, df.get((f, w), 0))
        text = mapping.fields[f].type == "text"
        one = scoring.bm25(F.col("tf"), F.col("length"), tokens / n if n else 0.0, weight) if text else F.lit(weight)
        sums.append(F.sum(F.when((F.col("field") == f) & (F.col("term") == w), one * F.lit(boost)).otherwise(F.lit(0.0))).alias(f"s{i}"))
    match, score = build()
    flags = rows.groupBy(ID).agg(*sums)
    return flags.where(match).select(ID, score.alias("score"))


def search_postings(index: DataFrame, docs: DataFrame, mapping: Mapping, query: str, limit: int = LIMIT, offset: int = OFFSET, totals: dict[str, list[int]] | None = None) -> Result:
    """search(), by postings."""
    scores = postings_scored(index, docs, mapping, query, totals)
    count = scores.count()
    if limit == 0 or not count:
        ranked(scores, limit, offset)  # refuses what search() refuses
        return Result(docs.select(ID, F.lit(0.0).alias("score"), SOURCE).limit(0), count)
    return Result(with_source(docs, ranked(scores, limit, offset), limit), count)
