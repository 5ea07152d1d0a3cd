"""Versioned tables: what readers see before, during and after commits, and an index that changes as one."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import stored_index
from sparkloom.sources.snapshots import Conflict, Replace, Store, Upsert


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def frame(spark, *rows):
    return spark.createDataFrame(rows, "name string, n int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions(spark, store):
    assert store.version() == 0
    assert store.commit({"t": Replace(frame(spark, ("a", 1), ("b", 2), (None, 3)), ("name",)), "u": Replace(frame(spark, ("x", 0)))}) == 1
    old = store.read("t")
    assert store.commit({"t": Upsert(frame(spark, ("b", 20), ("c", 30), (None, 33)), "name", frame(spark, ("a", 0)).select("name"))}) == 2
    assert rows(store.read("t")) == [("b", 20), ("c", 30), (None, 33)]
    assert rows(old) == rows(store.read("t", 1)) == [("a", 1), ("b", 2), (None, 3)]
    assert rows(store.read("u")) == [("x", 0)]
    store.commit({"t": Upsert(frame(spark, ("a", 100)), "name")})
    assert rows(store.read("t")) == [("a", 100), ("b", 20), ("c", 30), (None, 33)]
    assert store.compact("t", ("name",)) == 4
    assert rows(store.read("t")) == [("a", 100), ("b", 20), ("c", 30), (None, 33)]
    assert len(store.snapshot()["tables"]["t"]["parts"]) == 1 and not store.snapshot()["tables"]["t"]["gone"]
    assert store.vacuum(keep=1) == 0  # all folders are young
    assert store.vacuum(keep=1, older_than_ms=0) == 5
    assert rows(store.read("t")) == [("a", 100), ("b", 20), ("c", 30), (None, 33)] and rows(store.read("u")) == [("x", 0)]


def test_second_writer_fails_whole(spark, store):
    store.commit({"t": Replace(frame(spark, ("a", 1)))})
    base = store.version()
    store.commit({"t": Replace(frame(spark, ("a", 2)))}, base)
    with pytest.raises(Conflict):
        store.commit({"t": Replace(frame(spark, ("a", 3)))}, base)
    assert rows(store.read("t")) == [("a", 2)]


def test_unfinished_snapshot_is_not_seen(spark, store):
    store.commit({"t": Replace(frame(spark, ("a", 1)))})
    store._fs.create(store._path(store._snapshot(2)), False).close()
    assert store.version() == 1 and rows(store.read("t")) == [("a", 1)]
    with pytest.raises(Conflict):
        store.commit({"t": Replace(frame(spark, ("a", 2)))})
    store.repair()
    assert store.commit({"t": Replace(frame(spark, ("a", 2)))}) == 2


def test_index_changes_as_one(spark, store):
    def docs(*held):
        return spark.createDataFrame(held, "source_file string, content string")

    def chunks(df):
        return df.select("source_file", F.posexplode(F.split("content", "\n")).alias("chunk_id", "content"))

    first = docs(("f1", "payment wire transfer\nwire wire payment"), ("f2", "license payment"), ("f3", "nothing here"))
    stored_index.build(store, first, chunks(first))
    assert [(r.source_file, r.chunk_id, r.matched) for r in stored_index.lexical(store, ["wire", "payment"]).collect()] == [("f1", 1, ["payment", "wire"]), ("f1", 0, ["payment", "wire"]), ("f2", 0, ["payment"])]
    second = docs(("f1", "license only"), ("f4", "wire house"))
    stored_index.update(store, second, chunks(second), docs(("f2", "")).select("source_file"))
    hits = stored_index.lexical(store, ["wire", "license", "payment"])
    assert sorted((r.source_file, r.content, r.reasons) for r in stored_index.shown(store, hits, "content").collect()) == [("f1", "license only", "terms: license"), ("f4", "wire house", "terms: wire")]
    for table, want in (("catalog", ["f1", "f3", "f4"]), ("chunks", ["f1", "f3", "f4"]), ("embeddings", ["f1", "f3", "f4"]), ("lengths", ["f1", "f3", "f4"])):
        assert sorted(r.source_file for r in store.read(table).select("source_file").distinct().collect()) == want
    plan = hits._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]
    assert [r.source_file for r in stored_index.lexical(store, ["transfer"], version=1).collect()] == ["f1"]
