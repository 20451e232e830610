import pytest

from quillon.engine import Engine
from quillon.errors import CollectionNotFound, DocumentNotFound, RecoveryError, SchemaConflict, ValidationError, WriterLost
from quillon.mapping import Field, Mapping
from quillon.operators import commands as C
from quillon.operators import search as S
from quillon.sources.catalog import Catalog
from quillon.sources.log import CommandLog
from quillon.streaming.ingest import StreamedTable, ingest

BOOKS = Mapping({"title": Field("text", True), "tag": Field("keyword", True, True), "year": Field("i64", True, True)})


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/catalog"


def total(catalog, query, name="books"):
    return catalog.search(name, query, 0).total


def test_a_life(spark, root):
    c = Catalog(spark, root)
    assert c.create("books", BOOKS) and not c.create("books", BOOKS)
    with pytest.raises(SchemaConflict):
        c.create("books", Mapping({"body": Field("text", True)}))
    source = '{"title": "the  hobbit", "tag":"fruit","year":1937}'
    assert c.upsert("books", source, "b1") == ("b1", True)
    assert c.upsert("books", '{"title":"a red car"}', "b2") == ("b2", True)
    assert c.upsert("books", source, "b1") == ("b1", True), "judged on the committed view"
    assert total(c, "hobbit") == 0, "not visible before a checkpoint"
    with pytest.raises(DocumentNotFound):
        c.get("books", "b1")
    # a crash here: another catalog recovers the log
    c = Catalog(spark, root)
    assert (total(c, "hobbit"), total(c, "tag:fruit"), total(c, "*")) == (1, 1, 2)
    assert c.get("books", "b1") == source
    assert c.upsert("books", '{"title":"second"}', "b1") == ("b1", False)
    assert c.get("books", "b1") == source and c.get("books", "b1", fresh=True) == '{"title":"second"}'
    assert (total(c, "second"), total(c, "hobbit")) == (1, 0)
    assert c.delete("books", "b1") and c.delete("books", "b1")
    c.checkpoint()
    assert not c.delete("books", "b1") and total(c, "second") == 0
    with pytest.raises(ValidationError):
        c.upsert("books", '{"nope":1}', "b2")
    assert total(c, "car") == 1
    assert c.min_committed() == c.applied_seq
    c.drop("books")
    with pytest.raises(CollectionNotFound):
        c.search("books", "x")
    assert Catalog(spark, root).list() == []


def test_bulk_paging_snapshot_and_quarantine(spark, root, tmp_path):
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    rows = [(i, f"d{i}" if i % 2 else None, f'{{"title":"common word {i}","year":{i}}}' if i != 7 else "broken") for i in range(40)]
    n, bad = c.upsert_batch("books", spark.createDataFrame(rows, '`order` long, id string, source string').repartition(3))
    assert n == 39 and [r.reason for r in bad.collect()] == ["invalid JSON"]
    c.checkpoint()
    pages = [c.search("books", "common", 10, k) for k in (0, 10, 20, 30)]
    ids = [r["_id"] for p in pages for r in p.hits.collect()]
    assert {p.total for p in pages} == {39} and len(ids) == len(set(ids)) == 39
    assert total(c, "year:[3 TO 5]") == 3
    assert c.search("books", "common", 0).hits.count() == 0
    sid = c.snapshot()
    other = Catalog(spark, f"file://{tmp_path}/other")
    other.create("gone", BOOKS)
    other.upsert("gone", "{}", "x")
    other.checkpoint()
    other.install(f"{root}/_snapshots/{sid}")
    assert other.list() == ["books"] and total(other, "common") == 39 and len(other.quarantined) == 1
    assert Catalog(spark, f"file://{tmp_path}/other").list() == ["books"]
    with pytest.raises(RecoveryError):
        other.install(f"{root}/_snapshots/none")


def test_damage(spark, root, tmp_path):
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    c.upsert("books", "{}", "x")
    c.checkpoint()
    uid = c.collections["books"]["uuid"]
    c.files.move(f"{root}/{uid}", f"{root}/elsewhere")
    with pytest.raises(RecoveryError):
        Catalog(spark, root)
    (tmp_path / "catalog/_catalog.json").write_text("not json")
    (tmp_path / "catalog/._catalog.json.crc").unlink(missing_ok=True)
    with pytest.raises(RecoveryError):
        Catalog(spark, root)


def test_create_index_drop_in_the_log(spark, root):
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    c.upsert("books", "{}", "x")
    c.drop("books")
    assert Catalog(spark, root).list() == []


def test_log(spark, root):
    log = CommandLog(spark, root)
    for i in range(0, 9, 3):
        rows = [(i + k, "delete", "c", str(k), None, None, None) for k in range(3)]
        log.append(spark.createDataFrame(rows, C.COMMANDS), i, i + 2)
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([], C.COMMANDS), 11, 12)
    seqs = lambda *a: sorted(r.seq for r in log.read(*a).collect())
    assert seqs() == list(range(9)) and seqs(2, 5) == [2, 3, 4]
    log.truncate(7)
    assert seqs() == list(range(7)) and log.last_seq() == 6
    log.purge(4)
    assert seqs(5) == [5, 6]
    log.truncate(0)
    assert seqs() == [] and log.last_seq() == 0


def test_commands_fold_and_agree_with_the_window_form(spark):
    rows = [(1, "index", "c", "a", "1"), (2, "index", "c", "b", "2"), (3, "delete", "c", "a", None), (4, "index", "c", "b", "4"), (5, "index", "c", "x", None)]
    log = spark.createDataFrame([(s, o, c, i, t, None, None) for s, o, c, i, t in rows], C.COMMANDS)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(C.latest(log)) == key(C.latest_by_window(log))
    none = C.live(log.limit(0)).drop("collection")
    assert key(C.fold(none, log.union(log), 0)) == key(C.fold(C.fold(none, log, 0), log, 5)) == [("b", "4", 4), ("x", None, 5)]


def test_postings_give_what_the_scan_gives(spark, tmp_path):
    from quillon.operators.documents import collection_of

    rows = [(i, f"common word {'rare' if i % 3 == 0 else 'other'} " + "pad " * (i % 5), "k" if i % 2 else "common") for i in range(60)]
    docs = collection_of(spark.createDataFrame(rows, "id long, title string, tag string"), Mapping({"title": Field("text", True), "tag": Field("keyword", True)}), __import__("pyspark.sql.functions").sql.functions.col("id"))
    mapping = Mapping({"title": Field("text", True), "tag": Field("keyword", True)})
    S.write_postings(docs, mapping, f"file://{tmp_path}/postings")
    index = spark.read.parquet(f"file://{tmp_path}/postings")
    for q in ["common", "rare other", "+common -rare", "common AND (rare OR pad)^2", "title:common tag:k"]:
        a = {r["_id"]: round(r["score"], 9) for r in S.scored(docs, mapping, q).collect()}
        b = {r["_id"]: round(r["score"], 9) for r in S.postings_scored(index, docs, mapping, q).collect()}
        assert a == b and a, q


def test_stream_applies_each_batch_once(spark, tmp_path):
    commands = spark.createDataFrame([(i, "delete" if i % 7 == 0 else "index", "c", str(i % 5), "{}" if i % 7 else None, None, None) for i in range(1, 50)], C.COMMANDS)
    for k in range(3):
        commands.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = StreamedTable(spark, f"file://{tmp_path}/table")
    stream = lambda: spark.readStream.schema(C.COMMANDS).option("maxFilesPerTrigger", 8).parquet(f"{tmp_path}/in")
    ingest(stream(), target, BOOKS).awaitTermination()
    first = sorted(map(tuple, target.read("c").drop("collection").collect()))
    assert first == sorted(map(tuple, C.live(commands).select("_id", "_source", "_seq").collect()))
    ingest(stream(), target, BOOKS).awaitTermination()
    target.apply(commands, target.manifest()["batch"])
    assert sorted(map(tuple, target.read("c").drop("collection").collect())) == first


def test_front_end(spark, root):
    e = Engine(Catalog(spark, root))
    assert e.health().status == 200
    assert e.create_collection("books", BOOKS.to_json()).status == 201 and e.create_collection("books", BOOKS.to_json()).status == 200
    assert e.create_collection("books", "{}").status == 409 and e.create_collection("Bad", "{}").status == 400 and e.create_collection("b", "not json").status == 400
    assert e.describe_collection("books").body["fields"]["year"] == {"type": "i64", "indexed": True, "fast": True}
    posted = e.post_document("books", '{"title":"hello"}')
    assert posted.status == 201 and posted.body["result"] == "created"
    assert e.put_document("books", "b1", '{"title":"hello there"}').status == 201
    assert e.put_document("books", "b1", '{"x":1}').status == 400
    e.catalog.checkpoint()
    assert e.put_document("books", "b1", '{"title": "hello"}').body == {"id": "b1", "result": "updated"}
    assert e.get_document("books", "b1").body["source"] == {"title": "hello there"}
    found = e.search_documents("books", "hello").body
    assert found["total"] == 2 and len(found["hits"]) == 2
    assert e.search_documents("books", '"broken').status == 400 and e.search_documents("none", "x").status == 404
    assert e.search_documents("books").body == {"hits": [], "total": 0}
    assert e.delete_document("books", "b1").status == 204 and e.delete_document("books", "never").status == 204
    assert e.get_document("books", "never").status == 404
    assert e.drop_collection("books").status == 204 and e.drop_collection("books").status == 404
    assert e.list_collections().body == {"collections": []}


def test_one_writer(spark, root):
    first = Catalog(spark, root)
    first.create("books", BOOKS)
    first.upsert("books", '{"title":"kept"}', "a")
    second = Catalog(spark, root)
    with pytest.raises(WriterLost):
        first.upsert("books", '{"title":"lost"}', "b")
    with pytest.raises(WriterLost):
        first.checkpoint()
    second.checkpoint()
    reader = Catalog(spark, root, read_only=True)
    assert total(reader, "kept") == 1 and total(second, "lost") == 0
    with pytest.raises(WriterLost):
        reader.create("x", BOOKS)
    second.upsert("books", '{"title":"more"}', "c")


def test_segments_are_merged_and_agree_with_the_plain_fold(spark, root):
    import random

    rnd, c, want = random.Random(4), Catalog(spark, root), {}
    c.create("books", BOOKS)
    order = 0
    for n in (40, 6, 3, 1, 12, 2):
        rows = []
        for _ in range(n):
            i = f"d{rnd.randrange(50)}"
            want[i] = f'{{"title":"word{rnd.randrange(4)} common","year":{order}}}'
            rows.append((order, i, want[i]))
            order += 1
        c.upsert_batch("books", spark.createDataFrame(rows, "`order` long, id string, source string"))
        gone = rnd.sample(sorted(want), 2)
        for i in gone:
            assert c.delete("books", i) in (True, False)
            del want[i]
        c.checkpoint()
        assert {r["_id"]: r["_source"] for r in c.committed("books").collect()} == want
        assert len(c.collections["books"]["segments"]) <= 4
        for q in ("word1", "common -word2", "+word0 common"):
            docs, mapping = c.committed("books"), BOOKS
            plain = S.search(docs, mapping, q, 100)
            found = c.search("books", q, 100)
            assert found.total == plain.total
            assert [(r["_id"], round(r["score"], 9)) for r in found.hits.collect()] == [(r["_id"], round(r["score"], 9)) for r in plain.hits.collect()]
    folders = c.files.names(f"{root}/{c.collections['books']['uuid']}")
    assert len([f for f in folders if f.startswith("segment")]) <= 2 * len(c.collections["books"]["segments"]) + 2
    again = Catalog(spark, root, read_only=True)
    assert {r["_id"]: r["_source"] for r in again.committed("books").collect()} == want


def test_snapshot_cadence_and_a_tidy_log(spark, root, monkeypatch):
    from quillon.sources import catalog as module

    monkeypatch.setattr(module, "LOG_SEGMENTS", 3)
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    made = []
    for k in range(6):
        c.upsert("books", "{}", f"b{k}")
        made.append(c.snapshot_if_due(3, 1))
    assert [m is not None for m in made] == [False, True, False, False, True, False] and c.snapshots() == [made[4]]
    for k in range(4):
        c.upsert("books", "{}", f"c{k}")
    before = sorted(map(tuple, c.log.read().collect()))
    assert len(c.log.segments()) > 3
    c.tidy()
    assert len(c.log.segments()) == 1 and sorted(map(tuple, c.log.read().collect())) == before
    c.upsert("books", "{}", "last")
    assert Catalog(spark, root).search("books", "*", 0).total == 11


def test_a_log_merged_half_way(spark, root):
    log = CommandLog(spark, root)
    rows = lambda a, b: spark.createDataFrame([(i, "delete", "c", str(i), None, None, None) for i in range(a, b + 1)], C.COMMANDS)
    log.append(rows(1, 2), 1, 2)
    log.append(rows(3, 4), 3, 4)
    C.with_crc(rows(1, 4)).write.parquet(f"{root}/_log/segment-{1:020d}-{4:020d}")  # the merged one, before the others went
    assert [(a, b) for a, b, _ in log.segments()] == [(1, 4)]
    log.append(rows(5, 5), 5, 5)
    assert sorted(r.seq for r in log.read().collect()) == [1, 2, 3, 4, 5]


def test_a_stream_of_several_collections(spark, tmp_path):
    """Two collections with the same ids; one is dropped and made again; the stream comes in batches and twice."""
    rows = [(1, "create", "a", None, None), (2, "create", "b", None, None), (3, "index", "a", "k", "1"), (4, "index", "b", "k", "2"), (5, "drop", "a", None, None), (6, "index", "a", "lost", "3"), (7, "create", "a", None, None), (8, "index", "a", "m", "4"), (9, "delete", "b", "never", None), (10, "index", "b", "k", "5"), (11, "index", "free", "k", "6")]
    log = spark.createDataFrame([(s, o, c, i, t, f"u{s}" if o == "create" else None, "{}" if o == "create" else None) for s, o, c, i, t in rows], C.COMMANDS)
    target = StreamedTable(spark, f"file://{tmp_path}/table")
    want = {("a", "m", "4", 8), ("b", "k", "5", 10), ("free", "k", "6", 11)}
    for number, (low, high) in enumerate([(1, 3), (4, 6), (7, 8), (9, 9), (10, 11)]):
        part = log.where(f"seq between {low} and {high}")
        target.apply(part, number)
        target.apply(part, number)
        if number == 1:
            assert {r["_id"] for r in target.read("a").collect()} == set()
    assert {tuple(r) for r in target.read().collect()} == want
    target.apply(log, 9)
    assert {tuple(r) for r in target.read().collect()} == want


def test_a_snapshot_keeps_its_folders(spark, root):
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    c.upsert("books", '{"title":"first"}', "a")
    early = c.snapshot()
    for k in range(4):
        c.upsert("books", '{"title":"later"}', f"b{k}")
        c.checkpoint()
    late = c.snapshot()
    c.drop("books")
    c.checkpoint()
    c = Catalog(spark, root)
    assert c.list() == [] and c.quarantined == []
    c.install(f"{root}/_snapshots/{early}")
    assert (total(c, "first"), total(c, "later")) == (1, 0)
    c.upsert("books", '{"title":"own"}', "z")
    c.checkpoint()
    assert (total(c, "first"), total(c, "own")) == (1, 1)
    c.install(f"{root}/_snapshots/{late}")
    assert (total(c, "first"), total(c, "later"), total(c, "own")) == (1, 4, 0)
    for sid in c.snapshots():
        c.files.delete(f"{root}/_snapshots/{sid}")
    c.drop("books")
    assert not c.files.exists(f"{root}/{uuid_of(c, root)}")


def uuid_of(catalog, root):
    return next((n for n in catalog.files.names(root) if len(n) == 36), "none")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quillon.sources.files import work_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_folder(cluster, "x")


def numbered(rows):
    return [(i, f"d{i}", f'{{"title":"word {i}","year":{i}}}') for i in rows]


BATCH = "`order` long, id string, source string"


@pytest.mark.parametrize("order", [list(range(30)), [*range(20, 30), *range(10, 20), *range(10)], list(range(29, -1, -1)), [0, 5, *range(1, 5), *range(6, 30)]])
def test_a_batch_is_numbered_in_order_and_leaves_no_copy(spark, root, order):
    """In ascending runs that lie apart, whose numbers are told without a shuffle, and in others."""
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    n, bad = c.upsert_batch("books", spark.createDataFrame(numbered(order), BATCH).coalesce(2))
    assert n == 30 and bad.isEmpty() and bad.columns == ["order", "id", "source", "reason"]
    assert [(r["seq"], r["id"]) for r in c.log.read(2).orderBy("seq").collect()] == [(2 + i, f"d{i}") for i in range(30)]
    assert [f for f in c.files.names(f"{root}/_log") if f.startswith(".stage")] == []


def test_files_between_which_others_lie_are_numbered_without_a_shuffle(spark, root, monkeypatch):
    rows = spark.createDataFrame(numbered([*range(200), *range(400, 600), *range(200, 400), *range(600, 800)]), BATCH)
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    monkeypatch.setattr(c, "_in_order", None)
    assert c.upsert_batch("books", rows.coalesce(1))[0] == 800
    assert c.log.read(2).where("concat('d', seq - 2) <> id").isEmpty()


def test_starts_of_runs():
    assert C.run_starts([(1, 0, 3, 10, 12), (0, 0, 2, 20, 30), (0, 1, 4, 1, 9)]) == [(0, 1, 0), (1, 0, 4), (0, 0, 7)]
    assert C.run_starts([(0, 0, 3, 1, 5), (1, 0, 3, 4, 8)]) is None, "they overlap"
    assert C.run_starts([(0, 0, 3, 1, 5), (0, -1, 3, 7, 8)]) is None, "too many runs"
    assert C.run_starts([]) == []


def test_a_commit_that_outgrows_older_segments_writes_them_once(spark, root):
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    for k in range(2):
        c.upsert_batch("books", spark.createDataFrame([(i, d, s.replace("word", f"word{k}")) for i, d, s in numbered(range(k, 20))], BATCH))
        c.delete("books", f"d{5 + k}")
        c.checkpoint()
    assert [s["n"] for s in c.collections["books"]["segments"]] == [1, 2]
    c.upsert_batch("books", spark.createDataFrame(numbered(range(40)), BATCH))
    c.checkpoint()
    assert [s["n"] for s in c.collections["books"]["segments"]] == [3], "new documents are written in the merged segment only"
    assert {r["_id"]: r["_source"] for r in c.committed("books").collect()} == {d: s for _, d, s in numbered(range(40))}
    assert c.postings("books").groupBy("_id", "term").count().where("count > 1").isEmpty()


def test_a_commit_shuffles_sources_once_and_no_postings(spark, root, monkeypatch):
    frame = type(spark.range(1))
    seen, plain = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    c.upsert_batch("books", spark.createDataFrame(numbered(range(9)), BATCH))
    c.checkpoint()
    assert [sorted(x) for x in seen] == [["_id", "_seq", "_source"]]


def test_runs_of_postings(spark, tmp_path, monkeypatch):
    """Several runs a file, texts that are null, empty or of repeated words, and wide ids."""
    from pyspark.sql import functions as F

    from quillon.operators.documents import collection_of

    monkeypatch.setattr(S, "RUN", 50)
    monkeypatch.setattr(S, "OUT", 7)
    mapping = Mapping({"title": Field("text", True), "tag": Field("keyword", True), "body": Field("text", True)})
    words = ["the", "The", "é", "", None, "a b a", "zz " * 9, "the the cat"]
    rows = [(f"{i:036d}", words[i % 8], words[(i * 3) % 8] if i % 3 else None, None if i % 5 else "k") for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        docs = collection_of(spark.createDataFrame(rows, "id string, title string, body string, tag string"), mapping, F.col("id"))
        S.write_postings(docs, mapping, f"file://{tmp_path}/postings")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.schema(S.POSTINGS).parquet(f"file://{tmp_path}/postings")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.postings(docs, mapping).collect()))


def test_packed_postings_and_stored_documents(spark, tmp_path, monkeypatch):
    """Several runs a file, ids of any characters, texts that are null, empty or of repeated words: all come back as they were."""
    from pyspark.sql import functions as F

    from quillon.operators.documents import collection_of, from_stored, to_stored

    monkeypatch.setattr(S, "RUN", 50)
    monkeypatch.setattr(S, "OUT", 7)
    mapping = Mapping({"title": Field("text", True), "tag": Field("keyword", True), "body": Field("text", True)})
    words = ["the", "The", "é", "", None, "a b a", "zz " * 9, "the the cat"]
    odd = ['"', "\\", ",", "é\n", "[1]", " ", " ", "\x00"]
    rows = [(f"{odd[i % 8]}{i:03d}", words[i % 8], words[(i * 3) % 8] if i % 3 else None, None if i % 5 else "k") for i in range(200)]
    docs = collection_of(spark.createDataFrame(rows, "id string, title string, body string, tag string"), mapping, F.col("id"))
    to_stored(docs, mapping).write.parquet(f"file://{tmp_path}/docs")
    stored = spark.read.schema(mapping.stored_schema()).parquet(f"file://{tmp_path}/docs")
    key = lambda df: sorted(map(repr, df.select(*mapping.schema().names).collect()))
    assert key(from_stored(stored, mapping)) == key(docs)
    assert S.field_totals(stored, mapping, stored=True) == S.field_totals(docs, mapping)
    S.write_packed(stored, mapping, f"file://{tmp_path}/packed")
    got = S.unpacked(spark.read.schema(S.PACKED).parquet(f"file://{tmp_path}/packed"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.postings(docs, mapping).collect()))


def test_a_commit_writes_a_row_for_a_term_and_no_text_twice(spark, root):
    c = Catalog(spark, root)
    c.create("books", BOOKS)
    c.upsert_batch("books", spark.createDataFrame(numbered(range(60)), BATCH).coalesce(1))
    c.checkpoint()
    own = f"{root}/{c.collections['books']['uuid']}"
    folders = {n.partition("-")[0]: spark.read.parquet(f"{own}/{n}") for n in c.files.names(own)}
    stored, docs = folders.pop("segment"), c.committed("books")
    assert "title" not in stored.columns and dict(stored.dtypes)["_tokens_title"] == "string"
    assert docs.where("title = concat('word ', year) and size(_tokens_title) = 2").count() == 60
    (index,) = folders.values()
    postings, terms = c.postings("books"), S.postings(docs, BOOKS).select("field", "term").distinct().count()
    assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, S.postings(docs, BOOKS).collect()))
    assert index.count() == terms < postings.count()
    assert "In(term" in postings.where("term in ('word', 'other')")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
