"""The registered queries of the engine's own operators and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.mapping import COMPRESSION, ID, SEQ, SOURCE, Field, Mapping, tokens_of, valid_name
from quillon.operators import commands as C
from quillon.operators import search as S
from quillon.operators.documents import collection_of, extract, with_reason
from quillon.sources.files import work_folder

DOCS = Mapping({"text": Field("text", True), "lang": Field("keyword", True), "source": Field("keyword", True), "n_chars": Field("i64", True, True)})
EVENTS = Mapping({"event_type": Field("keyword", True), "ts": Field("date", True), "value": Field("f64", True, True), "user_id": Field("i64", True)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection_of(table(spark, sf_dir, "documents"), DOCS, F.col("doc_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection_of(table(spark, sf_dir, "events"), EVENTS, F.col("event_id"))


def command_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commands on one collection: users are documents, errors delete them."""
    return as_commands(table(spark, sf_dir, "events"))


def as_commands(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    deleted = F.col("event_type") == "error"
    return rows.select(F.col("event_id").alias("seq"), F.when(deleted, "delete").otherwise("index").alias("op"), F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("id"), F.when(~deleted, F.col("props")).alias("source"), none.alias("uuid"), none.alias("mapping"))


# DuckDB views of the same

D = r"""d AS (SELECT CAST(doc_id AS VARCHAR) AS _id, text, lang, source, n_chars,
  list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: strlen(t) < 40) AS toks FROM documents)"""
PADDED = "(' ' || array_to_string(toks, '  ') || ' ')"
E = "e AS (SELECT CAST(event_id AS VARCHAR) AS _id, event_type, ts, value, user_id, props FROM events)"
CMD = "c AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op, CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error' THEN props END AS source FROM events)"


def has(term: str) -> str:
    return f"list_contains(toks, '{term}')"


def where(condition: str) -> str:
    return f"WITH {D} SELECT _id FROM d WHERE {condition}"


def bm25(terms: list[tuple[str, float]], condition: str, tail: str = "", keywords: tuple[str, ...] = ()) -> str:
    """Scores of bare terms over text and the two keyword fields."""
    df = ", ".join(f"count(*) FILTER (WHERE {has(t)}) AS f{i}, count(*) FILTER (WHERE lang = '{t}') AS l{i}, count(*) FILTER (WHERE source = '{t}') AS s{i}" for i, (t, _) in enumerate(terms))
    idf = lambda c: f"ln(1 + (n - {c} + 0.5) / ({c} + 0.5))"
    parts = []
    for i, (t, boost) in enumerate(terms):
        tf = f"len(list_filter(toks, lambda x: x = '{t}'))"
        parts.append(f"{boost} * ((CASE WHEN {has(t)} THEN {idf(f'f{i}')} * 2.2 * {tf} / ({tf} + 1.2 * (0.25 + 0.75 * len(toks) / a)) ELSE 0 END) + (CASE WHEN lang = '{t}' THEN {idf(f'l{i}')} ELSE 0 END) + (CASE WHEN source = '{t}' THEN {idf(f's{i}')} ELSE 0 END))")
    for k in keywords:
        field, value = k.split(":")
        df += f", count(*) FILTER (WHERE {field} = '{value}') AS k_{field}"
        parts.append(f"(CASE WHEN {field} = '{value}' THEN {idf(f'k_{field}')} ELSE 0 END)")
    return f"WITH {D}, st AS (SELECT count(*) AS n, avg(len(toks)) AS a, {df} FROM d), r AS (SELECT _id, {' + '.join(parts)} AS raw FROM d, st WHERE {condition}) SELECT _id, round(raw, 6) AS score FROM r {tail}"


#: name: (query, condition in SQL) over documents; the result is the matching ids.
MATCHES: dict[str, tuple[str, str]] = {
    "term_match": ("inst", f"{has('inst')} OR lang = 'inst' OR source = 'inst'"),
    "term_multi_field": ("en", f"{has('en')} OR lang = 'en' OR source = 'en'"),
    "term_case_folded": ("text:THE", has("the")),
    "field_term": ("text:and", has("and")),
    "keyword_exact": ("lang:fr", "lang = 'fr'"),
    "keyword_case_sensitive": ("source:src1 OR lang:FR", "source = 'src1' OR lang = 'FR'"),
    "bool_and": ("text:the AND lang:en AND source:src3", f"{has('the')} AND lang = 'en' AND source = 'src3'"),
    "bool_or": ("lang:es OR lang:de", "lang IN ('es', 'de')"),
    "bool_not": ("text:the AND NOT text:of", f"{has('the')} AND NOT {has('of')}"),
    "bool_precedence": ("lang:es OR lang:en AND text:idiot", f"lang = 'es' OR (lang = 'en' AND {has('idiot')})"),
    "must_mustnot_should": ("+text:the -lang:fr text:thin", f"{has('the')} AND NOT lang = 'fr'"),
    "grouped_bool": ("text:(idiot clown) AND (lang:en OR lang:fr)", f"({has('idiot')} OR {has('clown')}) AND lang IN ('en', 'fr')"),
    "phrase": ('text:"in the"', f"contains({PADDED}, ' in  the ')"),
    "phrase_hyphenated": ("text:in-the", f"contains({PADDED}, ' in  the ')"),
    "phrase_slop": ('text:"the of"~2', "EXISTS (SELECT 1 FROM (SELECT unnest(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'the')) AS p) x, (SELECT unnest(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'of')) - 1 AS q) y WHERE abs(p - q) <= 2)"),
    "phrase_prefix": ('text:"in th"*', f"contains({PADDED}, ' in  th')"),
    "keyword_phrase": ('source:"src7"', "source = 'src7'"),
    "range_inclusive": ("n_chars:[500 TO 1000]", "n_chars BETWEEN 500 AND 1000"),
    "range_exclusive": ("n_chars:{500 TO 1000}", "n_chars > 500 AND n_chars < 1000"),
    "range_mixed": ("n_chars:[500 TO 1000}", "n_chars >= 500 AND n_chars < 1000"),
    "range_open": ("n_chars:[5000 TO *]", "n_chars >= 5000"),
    "range_keyword": ("source:[src10 TO src12]", "source >= 'src10' AND source <= 'src12'"),
    "range_text": ("text:[idi TO idj]", "len(list_filter(toks, lambda t: t >= 'idi' AND t <= 'idj')) > 0"),
    "compare_ops": ("+n_chars:>=300 +n_chars:<600", "n_chars >= 300 AND n_chars < 600"),
    "compare_strict": ("+n_chars:>300 +n_chars:<=600", "n_chars > 300 AND n_chars <= 600"),
    "in_set": ("lang: IN [fr de]", "lang IN ('fr', 'de')"),
    "in_set_text": ("text: IN [idiot clown]", f"{has('idiot')} OR {has('clown')}"),
    "number_equality": ("n_chars:477", "n_chars = 477"),
    "match_all": ("*", "true"),
    "empty_query": ("", "false"),
    "field_exists": ("lang:*", "lang IS NOT NULL"),
    "escaped_term": ("source:src\\7", "source = 'src7'"),
}
EVENT_MATCHES: dict[str, tuple[str, str]] = {
    "date_range": ('ts:["2024-01-05T00:00:00Z" TO "2024-01-06T00:00:00Z"}', "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'"),
    "date_offset": ("ts:<2024-01-02T02:00:00+02:00", "ts < TIMESTAMP '2024-01-02 00:00:00'"),
    "float_range": ("value:[10 TO 10.5] AND event_type:click", "value >= 10 AND value <= 10.5 AND event_type = 'click'"),
    "float_negative_bound": ("value:[-5 TO 1]", "value >= -5 AND value <= 1"),
}
#: name: (query, limit, offset, SQL)
TOPS: dict[str, tuple[str, int, int, str]] = {
    "bm25_topk": ("the", 10, 0, bm25([("the", 1.0)], f"{has('the')} OR lang = 'the' OR source = 'the'", "ORDER BY raw DESC, _id LIMIT 10")),
    "bm25_page2": ("the", 10, 10, bm25([("the", 1.0)], f"{has('the')} OR lang = 'the' OR source = 'the'", "ORDER BY raw DESC, _id LIMIT 10 OFFSET 10")),
    "bm25_multi_field": ("en", 20, 0, bm25([("en", 1.0)], f"{has('en')} OR lang = 'en'", "ORDER BY raw DESC, _id LIMIT 20")),
    "flagship": ("text:the AND lang:en", 10, 0, ""),
}
SCORES: dict[str, tuple[str, str]] = {
    "bm25_multi_term": ("the of idiot", bm25([("the", 1.0), ("of", 1.0), ("idiot", 1.0)], f"{has('the')} OR {has('of')} OR {has('idiot')}")),
    "bm25_boost": ("the of^2.5", bm25([("the", 1.0), ("of", 2.5)], f"{has('the')} OR {has('of')}")),
    "bm25_must_should": ("+the of", bm25([("the", 1.0), ("of", 1.0)], has("the"))),
    "constant_scores": ("n_chars:[0 TO 600]^2 lang: IN [fr es]", f"WITH {D} SELECT _id, (CASE WHEN n_chars BETWEEN 0 AND 600 THEN 2.0 ELSE 0.0 END) + (CASE WHEN lang IN ('fr', 'es') THEN 1.0 ELSE 0.0 END) AS score FROM d WHERE n_chars BETWEEN 0 AND 600 OR lang IN ('fr', 'es')"),
}


def _flagship_sql() -> str:
    # the text field alone, and lang as a keyword clause
    df = f"count(*) FILTER (WHERE {has('the')}) AS f, count(*) FILTER (WHERE lang = 'en') AS l"
    tf = "len(list_filter(toks, lambda x: x = 'the'))"
    idf = lambda c: f"ln(1 + (n - {c} + 0.5) / ({c} + 0.5))"
    return f"WITH {D}, st AS (SELECT count(*) AS n, avg(len(toks)) AS a, {df} FROM d), r AS (SELECT _id, {idf('f')} * 2.2 * {tf} / ({tf} + 1.2 * (0.25 + 0.75 * len(toks) / a)) + {idf('l')} AS raw FROM d, st WHERE {has('the')} AND lang = 'en') SELECT _id, round(raw, 6) AS score FROM r ORDER BY raw DESC, _id LIMIT 10"


TOPS["flagship"] = (*TOPS["flagship"][:3], _flagship_sql())

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(scores: DataFrame) -> DataFrame:
    return scores.select(ID, F.round("score", 6).alias("score"))


for _name, (_q, _sql) in MATCHES.items():
    register(_name, where(_sql))(lambda spark, sf, q=_q: S.matches(docs(spark, sf), DOCS, q).select(ID))
for _name, (_q, _sql) in EVENT_MATCHES.items():
    register(_name, f"WITH {E} SELECT _id FROM e WHERE {_sql}")(lambda spark, sf, q=_q: S.matches(events(spark, sf), EVENTS, q).select(ID))
for _name, (_q, _k, _o, _sql) in TOPS.items():
    register(_name, _sql)(lambda spark, sf, q=_q, k=_k, o=_o: rounded(S.ranked(S.scored(docs(spark, sf), DOCS, q), k, o)))
for _name, (_q, _sql) in SCORES.items():
    register(_name, _sql)(lambda spark, sf, q=_q: rounded(S.scored(docs(spark, sf), DOCS, q)))


@register("total_count", f"WITH {D} SELECT count(*) AS total FROM d WHERE {has('the')} AND lang = 'en'")
def total_count(spark, sf):
    return S.total(docs(spark, sf), DOCS, "text:the AND lang:en")


@register("limit_zero_total", f"WITH {D} SELECT count(*) AS total, CAST(0 AS BIGINT) AS hits FROM d WHERE {has('the')}")
def limit_zero_total(spark, sf):
    found = S.search(docs(spark, sf), DOCS, "text:the", 0)
    return found.hits.agg(F.count(F.lit(1)).alias("hits")).select(F.lit(found.total).cast("long").alias("total"), "hits")


@register("hit_sources", f"WITH {D} SELECT _id, text FROM d WHERE {has('idiot')}")
def hit_sources(spark, sf):
    """Every hit of a page wide enough for all, with the text read back from its source."""
    own = docs(spark, sf)
    hits = S.scored(own, DOCS, "text:idiot")
    joined = hits.join(own.select(ID, SOURCE), ID)
    return joined.select(ID, F.get_json_object(SOURCE, "$.text").alias("text"))


@register("get_by_id", "SELECT '17' AS _id, text FROM documents WHERE doc_id = 17")
def get_by_id(spark, sf):
    return S.get(docs(spark, sf), "17").select(ID, F.get_json_object(SOURCE, "$.text").alias("text"))


@register("id_exists", "SELECT CAST(v AS VARCHAR) AS _id, v IN (SELECT doc_id FROM documents) AS exists FROM (VALUES (0), (17), (-1), (99999999)) t(v)")
def id_exists(spark, sf):
    return S.existing(docs(spark, sf), spark.createDataFrame([("0",), ("17",), ("-1",), ("99999999",)], f"{ID} string"))


@register("tokenize", f"WITH {D} SELECT _id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM d")
def tokenize(spark, sf):
    t = F.col(tokens_of("text"))
    return docs(spark, sf).select(ID, F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@register("term_stats", f"WITH {D}, x AS (SELECT _id, unnest(toks) AS term FROM d) SELECT 'text' AS field, term, count(DISTINCT _id) AS df, CAST(count(*) AS BIGINT) AS ttf FROM x GROUP BY term UNION ALL SELECT 'lang', lang, count(*), CAST(count(*) AS BIGINT) FROM d WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*), CAST(count(*) AS BIGINT) FROM d WHERE source IS NOT NULL GROUP BY source")
def term_stats(spark, sf):
    return S.term_stats(S.postings(docs(spark, sf), DOCS))


@register("field_stats", f"WITH {D} SELECT 'text' AS field, count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS n_tokens, round(avg(len(toks)), 6) AS avg_length FROM d")
def field_stats(spark, sf):
    return S.field_stats(docs(spark, sf), DOCS).withColumn("avg_length", F.round("avg_length", 6))


@register("postings_bm25", SCORES["bm25_multi_term"][1])
def postings_bm25(spark, sf):
    own, index = indexed(spark, sf)
    return rounded(S.postings_scored(index, own, DOCS, "the of idiot"))


@register("postings_bool", bm25([("the", 1.0), ("of", 1.0)], f"{has('the')} AND NOT {has('idiot')}"))
def postings_bool(spark, sf):
    own, index = indexed(spark, sf)
    return rounded(S.postings_scored(index, own, DOCS, "+the of -text:idiot"))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents as a stored collection, so texts are analysed once, and its stored postings."""
    path = work_folder(spark, "index")
    docs(spark, sf_dir).select(*DOCS.schema().names).write.option("compression", COMPRESSION).parquet(f"{path}/docs")
    own = spark.read.schema(DOCS.schema()).parquet(f"{path}/docs")
    S.write_postings(own, DOCS, f"{path}/postings")
    return own, spark.read.schema(S.POSTINGS).parquet(f"{path}/postings")


# validation and extraction: sources made from events, some of them broken

SOURCES = Mapping({"k": Field("i64", True, True), "kind": Field("keyword", True), "at": Field("date", True), "v": Field("f64", True), "note": Field("keyword")})
_CASES = """CASE event_id % 10
  WHEN 0 THEN 'not json' WHEN 1 THEN '[1]' WHEN 2 THEN '{"other": 1}' WHEN 3 THEN '{"k": 3.0}' WHEN 4 THEN '{"kind": null}'
  WHEN 5 THEN '{"at": "2024-01-01"}' WHEN 6 THEN '{"k": 1} x' WHEN 7 THEN '{"v": 3, "at": "2024-02-03T04:05:06.789Z"}'
  WHEN 8 THEN props ELSE '{"k": 9223372036854775807, "kind": "a", "v": 1.5, "note": "n"}' END"""
_REASONS = """CASE event_id % 10 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'unmapped field other' WHEN 3 THEN 'field k is no i64'
  WHEN 4 THEN 'field kind is no keyword' WHEN 5 THEN 'field at is no date' WHEN 6 THEN 'invalid JSON' ELSE '' END"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias(ID), F.expr(_CASES).alias(SOURCE))


@register("validate_docs", f"SELECT CAST(event_id AS VARCHAR) AS _id, {_REASONS} AS reason FROM events")
def validate_docs(spark, sf):
    return with_reason(sources(spark, sf), SOURCES).select(ID, F.coalesce("reason", F.lit("")).alias("reason"))


@register("extract_typed", "SELECT CAST(event_id AS VARCHAR) AS _id, CASE event_id % 10 WHEN 8 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 9 THEN 9223372036854775807 ELSE -1 END AS k, CASE event_id % 10 WHEN 9 THEN 'a' ELSE '' END AS kind, CASE event_id % 10 WHEN 7 THEN 3.0 WHEN 9 THEN 1.5 ELSE -1.0 END AS v, CASE event_id % 10 WHEN 7 THEN 1706933106789 ELSE -1 END AS at_ms FROM events WHERE event_id % 10 IN (7, 8, 9)")
def extract_typed(spark, sf):
    valid = with_reason(sources(spark, sf), SOURCES).where("reason is null")
    own = extract(valid, SOURCES)
    return own.select(ID, F.coalesce("k", F.lit(-1).cast("long")).alias("k"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("v", F.lit(-1.0)).alias("v"), F.coalesce(F.unix_millis("at"), F.lit(-1).cast("long")).alias("at_ms"))


# commands

LAST = f"WITH {CMD}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM c) "


@register("upsert_latest", LAST + "SELECT id AS _id, seq AS _seq, source AS _source FROM l WHERE rn = 1 AND op = 'index'")
def upsert_latest(spark, sf):
    return C.live(command_stream(spark, sf)).select(ID, SEQ, SOURCE)


@register("delete_tombstone", LAST + "SELECT id AS _id, seq AS _seq FROM l WHERE rn = 1 AND op = 'delete'")
def delete_tombstone(spark, sf):
    return C.latest(command_stream(spark, sf)).where("op = 'delete'").select(ID, SEQ)


@register("created_flag", f"WITH {CMD}, m AS (SELECT max(seq) // 2 AS h FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM c, m WHERE seq <= h), live AS (SELECT id FROM l WHERE rn = 1 AND op = 'index') SELECT seq, id, id NOT IN (SELECT id FROM live) AS created FROM c, m WHERE seq > h AND op = 'index'")
def created_flag(spark, sf):
    """The second half of the log against a view committed after the first."""
    log, half = _halves(spark, sf)
    view = C.live(log.where(F.col("seq") <= half))
    batch = log.where((F.col("seq") > half) & (F.col("op") == "index"))
    flags = C.created_flags(view, batch.select("id").distinct())
    return batch.select("seq", "id").join(flags, "id").select("seq", "id", "created")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    log = command_stream(spark, sf_dir)
    return log, log.agg(F.max("seq")).first()[0] // 2


@register("replay_idempotent", ORACLE_SQL["upsert_latest"])
def replay_idempotent(spark, sf):
    """Half is committed; then the whole log is replayed, twice."""
    log, half = _halves(spark, sf)
    none = spark.createDataFrame([], f"{ID} string, {SOURCE} string, {SEQ} long")
    first = C.fold(none, log.where(F.col("seq") <= half), -1)
    once = C.fold(first, log.union(log), half)
    return once.select(ID, SEQ, SOURCE)


@register("pending_not_visible", f"WITH {CMD}, m AS (SELECT max(seq) // 2 AS h FROM c), l AS (SELECT c.*, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM c, m WHERE seq <= h) SELECT id AS _id, seq AS _seq FROM l WHERE rn = 1 AND op = 'index'")
def pending_not_visible(spark, sf):
    log, half = _halves(spark, sf)
    return C.live(log.where(F.col("seq") <= half)).select(ID, SEQ)


@register("log_range", f"WITH {CMD} SELECT seq, op, id FROM c WHERE seq >= 100 AND seq < 300")
def log_range(spark, sf):
    return C.log_range(command_stream(spark, sf), 100, 300).select("seq", "op", "id")


@register("log_purge", f"WITH {CMD} SELECT seq, op, id FROM c WHERE seq > 500")
def log_purge(spark, sf):
    return C.purged(command_stream(spark, sf), 500).select("seq", "op", "id")


@register("log_truncate", f"WITH {CMD} SELECT seq, op, id FROM c WHERE seq < 300")
def log_truncate(spark, sf):
    return C.truncated(command_stream(spark, sf), 300).select("seq", "op", "id")


@register("log_sound_prefix", f"WITH {CMD} SELECT seq, op, id FROM c WHERE seq < 700")
def log_sound_prefix(spark, sf):
    """The row 700 is damaged: it and all after it are cut."""
    log = C.with_crc(command_stream(spark, sf))
    return C.sound_prefix(log.withColumn("crc", F.when(F.col("seq") == 700, F.col("crc") + 1).otherwise(F.col("crc")))).select("seq", "op", "id")


@register("min_committed_mark", "SELECT CAST(min(coalesce(m, 0)) AS BIGINT) AS min_committed FROM (SELECT max(event_id) AS m FROM events GROUP BY event_type)")
def min_committed_mark(spark, sf):
    marks = table(spark, sf, "events").groupBy("event_type").agg(F.max("event_id").alias("committed_seq"))
    return C.min_committed(marks)


def ddl(spark: SparkSession) -> DataFrame:
    rows = [(1, "create", "books", "u1", "m1"), (2, "create", "films", "u2", "m2"), (3, "create", "books", "u3", "other"), (4, "drop", "films", None, None), (5, "drop", "films", None, None), (6, "create", "films", "u4", "m4"), (7, "create", "gone", "u5", "m5"), (8, "drop", "gone", None, None)]
    return spark.createDataFrame([(s, o, c, None, None, u, m) for s, o, c, u, m in rows], C.COMMANDS)


@register("list_collections", "SELECT * FROM (VALUES ('books', 'u1', 'm1', CAST(1 AS BIGINT)), ('films', 'u4', 'm4', CAST(6 AS BIGINT))) t(collection, uuid, mapping, created_seq)")
def list_collections(spark, sf):
    return C.collections_after(ddl(spark)).orderBy("collection")


@register("describe_mapping", "SELECT * FROM (VALUES ('lang', 'keyword', true, false), ('n_chars', 'i64', true, true), ('source', 'keyword', true, false), ('text', 'text', true, false)) t(field, type, indexed, fast)")
def describe_mapping(spark, sf):
    return DOCS.describe(spark)


@register("valid_names", "SELECT source AS name, regexp_full_match(source, '[a-z0-9-][a-z0-9_-]*') AND strlen(source) <= 255 AS valid FROM documents UNION ALL SELECT lang || '_' || upper(source), false FROM documents")
def valid_names(spark, sf):
    d = table(spark, sf, "documents")
    names = d.select(F.col("source").alias("name")).union(d.select(F.concat("lang", F.lit("_"), F.upper("source"))))
    return names.select("name", valid_name(F.col("name")).alias("valid"))


@register("orphans", "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS uuid FROM events WHERE user_id % 3 <> 0")
def orphans(spark, sf):
    """Storage folders (one a user) that no live collection (every third) owns."""
    folders = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uuid"), "user_id").distinct()
    return folders.join(folders.where("user_id % 3 = 0").select("uuid"), "uuid", "left_anti").select("uuid")


@register("stream_apply", ORACLE_SQL["upsert_latest"])
def stream_apply(spark, sf):
    """The same state, folded from a stream of the events file in micro-batches."""
    from quillon.streaming.ingest import StreamedTable, ingest

    target = StreamedTable(spark, work_folder(spark, "stream"))
    ingest(as_commands(event_stream(spark, sf)), target).awaitTermination()
    return target.read("users").select(ID, SEQ, SOURCE)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


@register("stream_apply_multi", f"""WITH {CMD}, m AS (SELECT max(seq) // 2 AS h FROM c), k AS (SELECT c.*, 'g' || CAST(CAST(id AS BIGINT) % 3 AS VARCHAR) AS g FROM c),
  l AS (SELECT k.*, row_number() OVER (PARTITION BY g, id ORDER BY seq DESC) AS rn FROM k, m WHERE g = 'g0' OR g = 'g1' AND seq > h)
  SELECT g AS collection, id AS _id, seq AS _seq, source AS _source FROM l WHERE rn = 1 AND op = 'index'""")
def stream_apply_multi(spark, sf):
    """A stream of three collections: the first stands, the second is dropped half-way and made again, the third is dropped at the end."""
    from quillon.streaming.ingest import StreamedTable, ingest

    bounds = table(spark, sf, "events").agg(F.max("event_id").alias("m")).first()
    half, end = bounds["m"] // 2, bounds["m"]
    stream = as_commands(event_stream(spark, sf)).withColumn("collection", F.concat(F.lit("g"), (F.col("id").cast("long") % 3).cast("string")))
    target = StreamedTable(spark, work_folder(spark, "streams"))
    # events at ten times their number, and the commands that make and drop collections between them
    none = F.lit(None).cast("string")
    at = lambda seq, op, name: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(name).alias("collection"), none.alias("id"), none.alias("source"), F.lit(f"u{seq}").alias("uuid"), F.lit("{}").alias("mapping"))
    first = [at(k + 1, "create", f"g{k}") for k in range(3)]
    middle = [at(10 * half + 1, "drop", "g1"), at(10 * half + 2, "create", "g1")]
    last = [at(10 * end + 1, "drop", "g2")]
    own = F.struct((F.col("seq") * 10).alias("seq"), "op", "collection", "id", "source", "uuid", "mapping")
    more = F.when(F.col("seq") == end, F.array(*last)).when(F.col("seq") == half, F.array(*middle)).when(F.col("seq") == 1, F.array(*first)).otherwise(F.array().cast("array<struct<seq:bigint,op:string,collection:string,id:string,source:string,uuid:string,mapping:string>>"))
    rows = stream.select(F.explode(F.concat(F.array(own), more)).alias("c")).select("c.*")
    ingest(rows, target).awaitTermination()
    return target.read().select("collection", ID, (F.col(SEQ) / 10).cast("long").alias(SEQ), SOURCE)


@register("catalog_search", where(f"{has('the')} AND lang = 'en'"))
def catalog_search(spark, sf):
    """Through the whole store: create, bulk write, checkpoint, search the committed version."""
    return S.matches(stored(spark, sf).committed("docs"), DOCS, "text:the AND lang:en").select(ID)


# the store itself: a catalog in a folder of its own for each query

DOC_JSON = 'to_json(struct(text, lang, source, n_chars)) AS source'


def new_catalog(spark: SparkSession):
    from quillon.sources.catalog import Catalog

    return Catalog(spark, work_folder(spark, "catalog"))


def load(catalog, rows: DataFrame, name: str = "docs", doc_id=None) -> None:
    """Write rows of documents, in the order of doc_id, as one batch."""
    own = rows.select(F.col("doc_id").alias("order"), (F.col("doc_id").cast("string") if doc_id is None else doc_id).alias("id"), F.expr(DOC_JSON))
    catalog.upsert_batch(name, own)


def stored(spark: SparkSession, sf_dir: str):
    """A catalog with one committed collection of the documents."""
    catalog = new_catalog(spark)
    catalog.create("docs", DOCS)
    load(catalog, table(spark, sf_dir, "documents"))
    catalog.checkpoint()
    return catalog


@register("catalog_recovery", where(f"{has('the')} AND lang = 'en'"))
def catalog_recovery(spark, sf):
    """Logged but never committed; a second catalog on the folder recovers it from the log."""
    from quillon.sources.catalog import Catalog

    catalog = new_catalog(spark)
    catalog.create("docs", DOCS)
    load(catalog, table(spark, sf, "documents"))
    return S.matches(Catalog(spark, catalog.root).committed("docs"), DOCS, "text:the AND lang:en").select(ID)


#: Every third document is replaced by one of another source, every fifth deleted after that.
CHANGED = """x AS (SELECT CAST(doc_id AS VARCHAR) AS _id, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE source END AS source, text, lang,
  list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40) AS toks FROM documents WHERE doc_id % 5 <> 0)"""


def changed(spark: SparkSession, sf_dir: str):
    catalog, d = stored(spark, sf_dir), table(spark, sf_dir, "documents")
    load(catalog, d.where("doc_id % 3 = 0").withColumn("source", F.lit("changed")))
    catalog.checkpoint()
    ids = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("order"), F.col("doc_id").cast("string").alias("id"))
    catalog.delete_batch("docs", ids)
    catalog.checkpoint()
    return catalog


@register("catalog_deltas", f"WITH {CHANGED} SELECT _id, source FROM x")
def catalog_deltas(spark, sf):
    """Two further commits, each a segment of what is new and the ids that it takes over."""
    return changed(spark, sf).committed("docs").select(ID, "source")


@register("catalog_postings", f"WITH {CHANGED}, st AS (SELECT count(*) AS n, avg(len(toks)) AS a, count(*) FILTER (WHERE {has('the')}) AS f FROM x), r AS (SELECT _id, ln(1 + (n - f + 0.5) / (f + 0.5)) * 2.2 * len(list_filter(toks, lambda t: t = 'the')) / (len(list_filter(toks, lambda t: t = 'the')) + 1.2 * (0.25 + 0.75 * len(toks) / a)) AS raw FROM x, st WHERE {has('the')}) SELECT _id, round(raw, 6) AS score FROM r ORDER BY raw DESC, _id LIMIT 10")
def catalog_postings(spark, sf):
    """A search by the postings that each segment stores, over documents of which some are replaced or deleted."""
    found = changed(spark, sf).search("docs", "text:the")
    return rounded(found.hits)


@register("catalog_existed", "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 2 = 0 AS existed FROM documents")
def catalog_existed(spark, sf):
    """Deletions of all ids, of which every second is in the committed view."""
    catalog, d = new_catalog(spark), table(spark, sf, "documents")
    catalog.create("docs", DOCS)
    load(catalog, d.where("doc_id % 2 = 0"))
    catalog.checkpoint()
    return catalog.delete_batch("docs", d.select(F.col("doc_id").alias("order"), F.col("doc_id").cast("string").alias("id")))


@register("catalog_minted_ids", "SELECT count(*) AS documents, count(*) AS ids, true AS are_uuids FROM documents")
def catalog_minted_ids(spark, sf):
    """Documents written without ids: each gets one of its own, once."""
    catalog = new_catalog(spark)
    catalog.create("docs", DOCS)
    load(catalog, table(spark, sf, "documents"), doc_id=F.lit(None).cast("string"))
    catalog.checkpoint()
    shape = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return catalog.committed("docs").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct(ID).alias("ids"), F.every(F.col(ID).rlike(shape)).alias("are_uuids"))


def languages(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(r[0] for r in table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct().collect())


@register("catalog_list", "SELECT DISTINCT lang AS name, CAST(0 AS BIGINT) AS version FROM documents WHERE lang IS NOT NULL")
def catalog_list(spark, sf):
    """A collection for each language, listed by the catalog."""
    catalog = new_catalog(spark)
    for name in languages(spark, sf):
        catalog.create(name, DOCS)
    return catalog.as_frame().select("name", "version")


@register("catalog_drop", "SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL AND lang <> (SELECT min(lang) FROM documents)")
def catalog_drop(spark, sf):
    """The first language's collection is dropped; a second catalog on the folder agrees."""
    from quillon.sources.catalog import Catalog

    catalog, names = new_catalog(spark), languages(spark, sf)
    for name in names:
        catalog.create(name, DOCS)
    catalog.drop(names[0])
    return Catalog(spark, catalog.root).as_frame().select("name")


@register("catalog_sweep", "SELECT DISTINCT lang, true AS moved FROM documents WHERE lang IS NOT NULL")
def catalog_sweep(spark, sf):
    """A folder for each language that no collection owns: the sweep at the next opening puts them into quarantine."""
    import uuid

    from quillon.sources.catalog import Catalog

    catalog = new_catalog(spark)
    folders = {name: str(uuid.uuid5(uuid.NAMESPACE_DNS, name)) for name in languages(spark, sf)}
    for folder in folders.values():
        catalog.files.mkdirs(f"{catalog.root}/{folder}/segment-1")
    moved = {n.rpartition(".")[0] for n in Catalog(spark, catalog.root).quarantined}
    inside = {n.rpartition(".")[0] for n in catalog.files.names(f"{catalog.root}/_quarantine")}
    rows = [(name, folder in moved and folder in inside and folder not in catalog.files.names(catalog.root)) for name, folder in folders.items()]
    return spark.createDataFrame(rows, "lang string, moved boolean")


@register("catalog_snapshot", f"WITH {CHANGED} SELECT _id, source FROM x")
def catalog_snapshot(spark, sf):
    """A snapshot installed over another catalog's state."""
    source, target = changed(spark, sf), new_catalog(spark)
    target.create("other", DOCS)
    target.install(f"{source.root}/_snapshots/{source.snapshot()}")
    return target.committed("docs").select(ID, "source")


@register("catalog_snapshot_cadence", "SELECT count(*) >= 100 AS due, false AS again FROM documents")
def catalog_snapshot_cadence(spark, sf):
    """One snapshot once enough commands are logged, and none right after it."""
    catalog = stored(spark, sf)
    rows = [(catalog.snapshot_if_due(100) is not None, catalog.snapshot_if_due(100) is not None)]
    return spark.createDataFrame(rows, "due boolean, again boolean")


@register("catalog_committed_view", "SELECT CAST(doc_id AS VARCHAR) AS _id, source FROM documents")
def catalog_committed_view(spark, sf):
    """A view taken before a commit reads what it read before it."""
    catalog = stored(spark, sf)
    view = catalog.committed("docs").select(ID, "source")
    load(catalog, table(spark, sf, "documents").withColumn("source", F.lit("changed")))
    catalog.checkpoint()
    return view


@register("catalog_fresh_get", "SELECT 'old' AS committed, 'new' AS fresh")
def catalog_fresh_get(spark, sf):
    catalog = new_catalog(spark)
    catalog.create("docs", DOCS)
    catalog.upsert("docs", '{"source": "old"}', "a")
    catalog.checkpoint()
    catalog.upsert("docs", '{"source": "new"}', "a")
    rows = [(catalog.get("docs", "a"), catalog.get("docs", "a", fresh=True))]
    return spark.createDataFrame(rows, "committed string, fresh string").select(*(F.get_json_object(c, "$.source").alias(c) for c in ("committed", "fresh")))


@register("catalog_default_page", f"WITH {D} SELECT _id, CAST(count(*) OVER () AS BIGINT) AS total FROM d WHERE n_chars >= 0 ORDER BY _id LIMIT 10")
def catalog_default_page(spark, sf):
    """Without limit and offset: the first ten, equal scores by id."""
    found = stored(spark, sf).search("docs", "n_chars:>=0")
    return found.hits.select(ID, F.lit(found.total).cast("long").alias("total"))


@register("catalog_min_mark", "SELECT CAST(count(*) AS BIGINT) + 2 AS min_committed, CAST(count(*) AS BIGINT) + 2 AS applied FROM documents")
def catalog_min_mark(spark, sf):
    """Two collections, one of them empty: a checkpoint marks both at the log's end."""
    catalog = new_catalog(spark)
    catalog.create("docs", DOCS)
    catalog.create("none", DOCS)
    load(catalog, table(spark, sf, "documents"))
    catalog.checkpoint()
    return spark.createDataFrame([(catalog.min_committed(), catalog.applied_seq)], "min_committed long, applied long")


@register("log_files", f"WITH {CMD} SELECT 'range' AS part, seq, op, id FROM c WHERE seq >= 100 AND seq < 300 UNION ALL SELECT 'purged', seq, op, id FROM c WHERE seq > 500 AND seq < 800 UNION ALL SELECT 'merged', seq, op, id FROM c WHERE seq > 500 AND seq < 800")
def log_files(spark, sf):
    """The log's own files: a range, then without the segments up to 500, cut before 800, and made one segment."""
    from quillon.sources.log import CommandLog

    log, commands = CommandLog(spark, work_folder(spark, "log")), command_stream(spark, sf)
    r = commands.agg(F.min("seq"), F.max("seq")).first()
    ends = [e for e in (250, 500, 750) if r[0] <= e < r[1]] + [r[1]]
    for first, last in zip([r[0], *(e + 1 for e in ends)], ends, strict=False):
        log.append(commands.where(F.col("seq").between(first, last)), first, last)
    out = _kept(log.read(100, 300), "range")
    log.purge(500)
    log.truncate(800)
    out = out.union(_kept(log.read(501), "purged"))
    log.merge()
    return out.union(_kept(log.read(501), "merged"))


def _kept(rows: DataFrame, part: str) -> DataFrame:
    """rows written aside, as the files that they come from go."""
    spark, path = rows.sparkSession, work_folder(rows.sparkSession, "part")
    rows.select(F.lit(part).alias("part"), "seq", "op", "id").write.parquet(path)
    return spark.read.parquet(path)


# answers and refusals: what each call gives, against what it must give

def answers(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "call string, answer string")


def values(rows: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") t(call, answer)"


VERBS = {"health": "200", "create": "201", "create again": "200", "create another mapping": "409 schema_conflict", "create bad name": "400 validation", "create bad mapping": "400 mapping", "list": "200 docs", "describe": "200", "describe none": "404 collection_not_found", "post": "201 created", "put new": "201 created", "put bad": "400 validation", "put committed": "200 updated", "get": "200", "get none": "404 document_not_found", "search": "200 total 2", "search bad": "400 validation", "search none": "404 collection_not_found", "delete": "204", "drop": "204", "drop again": "404 collection_not_found"}


@register("engine_answers", values(VERBS))
def engine_answers(spark, sf):
    """The verbs, their answers' shapes and codes, and the kinds of errors."""
    from quillon.engine import Engine

    e, mapping = Engine(new_catalog(spark)), DOCS.to_json()
    out = []

    def call(name: str, answer, shown=None) -> None:
        body = answer.body or {}
        text = body["error"]["kind"] if "error" in body else shown(body) if shown else ""
        out.append((name, f"{answer.status} {text}".strip()))

    call("health", e.health())
    call("create", e.create_collection("docs", mapping))
    call("create again", e.create_collection("docs", mapping))
    call("create another mapping", e.create_collection("docs", "{}"))
    call("create bad name", e.create_collection("Docs", mapping))
    call("create bad mapping", e.create_collection("x", '{"fields": {"a": {"type": "blob"}}}'))
    call("list", e.list_collections(), lambda b: " ".join(b["collections"]))
    call("describe", e.describe_collection("docs"))
    call("describe none", e.describe_collection("none"))
    call("post", e.post_document("docs", '{"text": "some words"}'), lambda b: b["result"])
    call("put new", e.put_document("docs", "a", '{"text": "other words"}'), lambda b: b["result"])
    call("put bad", e.put_document("docs", "a", '{"nope": 1}'))
    e.catalog.checkpoint()
    call("put committed", e.put_document("docs", "a", '{"text": "more words"}'), lambda b: b["result"])
    call("get", e.get_document("docs", "a"))
    call("get none", e.get_document("docs", "b"))
    call("search", e.search_documents("docs", "words"), lambda b: f"total {b['total']}")
    call("search bad", e.search_documents("docs", '"open'))
    call("search none", e.search_documents("none", "x"))
    call("delete", e.delete_document("docs", "a"))
    call("drop", e.drop_collection("docs"))
    call("drop again", e.drop_collection("docs"))
    return answers(spark, out)


REFUSED = {"reserved name": "mapping", "fast text": "mapping", "unknown type": "mapping", "name twice": "mapping", "empty name": "mapping", "not json": "mapping", "unknown field": "validation", "unindexed field": "validation", "bad number": "validation", "bad date": "validation", "open quote": "validation", "negative clauses only": "validation", "negative limit": "validation"}


@register("refusals", values(REFUSED))
def refusals(spark, sf):
    """Mappings and queries that must be refused, and the kind of error."""
    from quillon.errors import EngineError

    spec = lambda name, **kw: '{"fields": {"%s": {"type": "%s", "fast": %s}}}' % (name, kw.get("type", "i64"), kw.get("fast", "false"))
    mapping = Mapping({"n": Field("i64", True), "at": Field("date", True), "note": Field("keyword")})
    ask = lambda q: S.matches(spark.createDataFrame([], mapping.schema()), mapping, q)
    tries = {"reserved name": lambda: Mapping.from_json(spec("_id")), "fast text": lambda: Mapping.from_json(spec("a", type="text", fast="true")), "unknown type": lambda: Mapping.from_json(spec("a", type="blob")), "name twice": lambda: Mapping.from_json('{"fields": {"a": {"type": "i64"}, "a": {"type": "i64"}}}'), "empty name": lambda: Mapping.from_json(spec("")), "not json": lambda: Mapping.from_json("{"), "unknown field": lambda: ask("x:1"), "unindexed field": lambda: ask("note:a"), "bad number": lambda: ask("n:one"), "bad date": lambda: ask("at:>2024"), "open quote": lambda: ask('"a'), "negative clauses only": lambda: ask("-n:1"), "negative limit": lambda: S.ranked(spark.createDataFrame([], f"{ID} string, score double"), -1)}
    out = []
    for name, attempt in tries.items():
        try:
            attempt()
            out.append((name, "accepted"))
        except EngineError as e:
            out.append((name, e.kind))
    return answers(spark, out)


@register("mapping_codec", "SELECT 'DOCS' AS call, true AS same, true AS order_free")
def mapping_codec(spark, sf):
    """JSON and back gives an equal mapping, whatever the order of fields."""
    turned = Mapping(dict(reversed(list(DOCS.fields.items()))))
    return spark.createDataFrame([("DOCS", Mapping.from_json(DOCS.to_json()) == DOCS, turned == DOCS and turned.to_json() == DOCS.to_json())], "call string, same boolean, order_free boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
