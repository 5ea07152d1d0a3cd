import pytest

from sparkloom.operators import catalog
from sparkloom.sources import readers, writers
from sparkloom.operators import graphs, structure
from sparkloom.streaming import incremental


def test_readers(spark, tmp_path):
    (tmp_path / "src/in").mkdir(parents=True)
    (tmp_path / "src/a.tal").write_bytes(b"PROC x;\xff\nEND;")
    (tmp_path / "src/in/b.c").write_text("int f() {}")
    (tmp_path / "src/blank.c").write_text(" \n")
    (tmp_path / "src/skip.py").write_text("x")
    rows = {r.source_file.rsplit("/", 1)[1]: r.content for r in readers.source_files(spark, str(tmp_path / "src")).collect()}
    assert rows == {"a.tal": "PROC x;\nEND;", "b.c": "int f() {}"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.json").write_text('{"name": "a", "full_path": "/a", "keywords": ["Red", " blue "]}')
    (tmp_path / "m/2.json").write_text('{"name": "b", "full_path": "/b", "keywords": "Green, red", "author": "me"}')
    (tmp_path / "m/3.json").write_text('{"name": "c"}')
    found = {r["name"]: (r.keywords, r.author) for r in readers.image_metadata(spark, str(tmp_path / "m")).collect()}
    assert found == {"a": (["red", "blue"], "Unknown"), "b": (["green", "red"], "me")}
    (tmp_path / "v.txt").write_text("b a b c")
    assert readers.keyword_vocabulary(spark, str(tmp_path / "v.txt"), 5) == ["a", "b", "c", "keyword1", "keyword2"]
    (tmp_path / "r.csv").write_text("A,B\n001,x\n002,\n")
    assert [(r.row_index, r.A, r.B) for r in readers.record_file(spark, str(tmp_path / "r.csv")).orderBy("row_index").collect()] == [(2, "001", "x"), (3, "002", None)]
    (tmp_path / "p.properties").write_text("# c\nminimum.score=50\n")
    assert readers.properties(spark, str(tmp_path / "p.properties")) == {"minimum.score": "50"}
    (tmp_path / "rules.json").write_text('{"transformationRules": [{"name": "n", "overrideMode": true, "cobolPatterns": ["A"]}]}')
    r = readers.rules(spark, str(tmp_path / "rules.json")).first()
    assert (r.rule, r.override, r.code_patterns, r.labels) == ("n", True, ["A"], [])


def test_corpus_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", ["x"] * 7)], "id int, name string, function_calls array<string>")
    writers.save_corpus(rows, str(tmp_path / "c"))
    assert readers.corpus(spark, str(tmp_path / "c/chunks"), {"lang": "en"}).first()["lang"] == "en"
    with pytest.warns(UserWarning, match="not 9.9"):
        readers.corpus(spark, str(tmp_path / "c/chunks"), version="9.9")
    both = readers.corpora(spark, {"c": str(tmp_path / "c/chunks"), "gone": str(tmp_path / "no")})
    assert both.select("corpus_source").first()[0] == "c"
    writers.save_results(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["function_calls"] == ["x"] * 5


def test_embedding_provider(spark):
    rows = spark.createDataFrame([(1, "the token"), (2, "")], "id int, content string")
    assert sum(catalog.embed(rows, size=8).orderBy("id").first()["embedding"]) == 2.0
    assert catalog.embed(rows, lambda texts: [[float(len(t))] for t in texts]).orderBy("id").first()["embedding"] == [9.0]


def test_stream(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo")
    incremental.index_stream(incremental.file_stream(spark, source), table, mark).awaitTermination(60)
    (tmp_path / "in/b.txt").write_text("three")
    incremental.index_stream(incremental.file_stream(spark, source), table, mark).awaitTermination(60)
    assert {(r.source_file, r.content) for r in incremental.current(spark, table).collect()} == {("a.txt", "one\ntwo"), ("b.txt", "three")}
    known = spark.createDataFrame([("a.txt", "h"), ("b.txt", "h")], "name string, hash string")
    left, _ = incremental.refreshed(spark, table, known, known.where("name = 'b.txt'"))
    assert [r.source_file for r in left.select("source_file").distinct().collect()] == ["b.txt"]


def test_index_changes(spark, tmp_path):
    """New, changed, blank and removed files; nothing to do; compaction."""
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    texts = lambda where: {r.source_file: r.content for r in incremental.current(spark, where).collect()}
    (source / "a.txt").write_text("alpha one")
    (source / "b.txt").write_text("beta")
    (source / "c.txt").write_text("gamma")
    assert incremental.index_changes(spark, str(source), table) == {"new": 3, "modified": 0, "removed": 0}
    (source / "a.txt").write_text("alpha two")
    (source / "b.txt").write_text(" ")
    (source / "c.txt").unlink()
    assert incremental.index_changes(spark, str(source), table) == {"new": 0, "modified": 2, "removed": 1}
    found = texts(table)
    assert found["a.txt"].strip() == "alpha two" and "c.txt" not in found and not found.get("b.txt", "").strip()
    assert incremental.index_changes(spark, str(source), table) == {"new": 0, "modified": 0, "removed": 0}
    incremental.compacted(spark, table, str(tmp_path / "small"))
    assert texts(str(tmp_path / "small")) == found
    assert incremental.index_changes(spark, str(source), str(tmp_path / "small")) == {"new": 0, "modified": 0, "removed": 0}


def test_longer_chains_and_deeper_copies(spark):
    edges = spark.createDataFrame([(1, f"p{k}", f"p{k + 1}") for k in range(40)] + [(2, "r", "a"), (2, "a", "b"), (2, "b", "a")], "doc_id long, caller string, target string")
    depth = {(r.doc_id, r.name): r.depth for r in graphs.longest_path(edges).collect()}
    assert depth[1, "p40"] == 40 and depth[2, "a"] >= 1
    lines = spark.createDataFrame([(1, 0, "COPY B0.")], "doc_id long, line_no int, line string")
    books = spark.createDataFrame([(f"B{k}", f"COPY B{k + 1}.") for k in range(8)] + [("B8", "DEEP")], "name string, content string")
    assert [r.line for r in structure.expand(lines, books).collect()] == ["DEEP"]
