"""Work that must not grow faster than the input, and results that stay what they were where the way to them changed."""

import random
import re
import time
import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from sparkloom.functions import checks
from sparkloom.functions import text as fx
from sparkloom.operators import catalog, graphs, learning, trees
from sparkloom.plans import corpus
from sparkloom.plans import search as search_plans
from sparkloom.plans import trees as tree_plans


def test_hashed_embedding_counts_each_word_once(spark):
    """A long text took a tokenization and a pass over its words for each of the 64 buckets."""
    rows = spark.createDataFrame([(1, "the a the b_2 é x"), (2, ""), (3, None), (4, "12 34")], "id int, content string")
    for size in (1, 7, 64):
        got = {r.id: r.embedding for r in catalog.embed(rows, size=size).collect()}
        hashed = {r.id: r.h for r in rows.select("id", F.transform(fx.words_of(F.col("content")), lambda w: F.pmod(F.xxhash64(w), F.lit(size))).alias("h")).collect()}  # noqa: B023
        assert got == {i: [None] * size if h is None else [float(h.count(b)) for b in range(size)] for i, h in hashed.items()}
    long = spark.range(1).select(F.repeat(F.lit("some words of a long text "), 100_000).alias("content"))
    began = time.monotonic()
    assert sum(catalog.embed(long).first().embedding) == 600_000
    assert time.monotonic() - began < 12


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_has_no_frame_that_is_gone_through_for_each_row(spark):
    points = spark.createDataFrame([(d, i, x) for d in (1, 2, 3) for i, x in enumerate([5.0, -1.0, 2.0, 2.5, None, 9.0])], "diagram int, id int, x double")
    anchors = spark.createDataFrame([(1, "a", 2.0, 2), (1, "b", 2.0, 1), (1, "c", 3.0, 0), (2, "d", 7.0, 0)], "diagram int, name string, ax double, ord int")
    found = graphs.nearest(points, anchors, "x", "near")
    assert "unboundedfollowing" not in plan(found)
    near = {(r.diagram, r.id): r.near for r in found.collect() if r.x is not None}
    assert near == {(1, 0): "c", (1, 1): "b", (1, 2): "b", (1, 3): "c", (1, 5): "c"} | {(2, i): "d" for i in (0, 1, 2, 3, 5)}


def test_chain_depths_of_many_documents_pass_through_python_together(spark):
    """A call of a function for each document took longer than its chains."""
    edges = spark.createDataFrame([(d, c, t) for d in range(50) for c, t in (("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "b"), (None, "d"), ("e", None))], "doc_id long, caller string, target string")
    found = graphs.longest_path(edges)
    assert "InPandas" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == sorted((d, n, k) for d in range(50) for n, k in (("a", 0), ("b", 1), ("c", 1), ("d", 2)))


def test_features_are_computed_once_for_a_distribution_and_a_similar_search(spark):
    assert plan(corpus.flow_distribution(spark, SF)).count("FileScan") == 1
    assert plan(search_plans.similar_by_flow_vector(spark, SF)).count("FileScan") == 0  # stored, then read twice


def test_texts_that_nfc_leaves_alone_do_not_go_to_python(spark):
    for c in map(chr, range(0x20D0)):
        if re.match(checks.UNCHANGED.replace(r"\z", r"\Z"), c):
            assert all(unicodedata.normalize("NFC", x + c + y) == unicodedata.normalize("NFC", x) + c + y for x in ("", "e", "́", "ᄀ") for y in ("", "e", "é"))
    texts = ["plain", "déjà – “x” €", "é", "K", "가", "a\ń", "", None, "x\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(checks.nfc(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert "RLIKE" in plan(rows)


def test_split_ranks_no_label_in_one_task(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(400) if i % 50 else None, i) for i in range(3000)] + [("one", 7, 1), ("two", 3, 1), ("two", 3, 1), ("same", 5, 9), ("same", 5, 9), ("same", 6, 1)]
    df = spark.createDataFrame(rows, "label string, o long, id long").withColumn("w", F.lit("x")).repartition(4)
    for order in (F.col("o"), (F.col("o") * 7919) % 103, None):
        place = F.percent_rank().over(Window.partitionBy("label").orderBy(F.xxhash64("id") if order is None else order, "id"))
        for share in (0.0, 0.5, 0.8, 1.0):
            train, test = learning.split(df, "label", "id", share, order)
            assert train.columns == test.columns == df.columns
            held = df.withColumn("place", place)
            assert sorted(map(str, train.collect())) == sorted(map(str, held.where(F.col("place") < share).drop("place").collect()))
            assert sorted(map(str, test.collect())) == sorted(map(str, held.where(F.col("place") >= share).drop("place").collect()))
    assert "Window" not in plan(train) and "Exchange hash" not in plan(train)


def test_lists_of_a_text_come_without_a_shuffle_and_equal_those_of_its_nodes(spark):
    r = random.Random(3)
    parts = ["(", "(", "(", ")", ")", " ", "\n", "A", "b.c", '"x y"', '"(q\\" )"', '"a\\nb\\\\"', '""', "\\", "\u00e9\u2003x", '"\\t\\', "'"]
    texts = [None, "", ")) (A", '(A "open', *("".join(r.choices(parts, k=r.choice([3, 20, 80]))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    slow, quick = trees.lists(trees.read(df)), trees.facts(df)
    assert sorted(map(str, quick.select(slow.columns).collect())) == sorted(map(str, slow.collect()))
    assert dict(quick.dtypes) == dict(slow.dtypes)
    assert "Exchange" not in plan(quick).replace("Exchange Round", "").replace("Exchange Single", "")
    assert "Window" not in plan(tree_plans.tree_statements(spark, SF))


def test_counts_of_terms_stay_where_their_text_is(spark):
    for name in ("tfidf_top_terms", "term_share", "bm25_topk", "hybrid_topk"):
        query = {**corpus.QUERIES, **search_plans.QUERIES}[name][0]
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan(query(spark, SF))), name


def test_tree_texts_move_no_node_and_a_tree_may_go_on_over_batches(spark):
    found = plan(tree_plans.tree_texts(spark, SF))
    assert found.count("Exchange hash") <= 3 and found.index("Generate inline") < found.index("Exchange hash")  # nodes come after all that is moved
    docs = {None: ["r", "x", "y"], "a": ["r"], "b": ["r", *"tuvwxyz"], "": ["r", "'", " "]}
    rows = [(d, i, min(i, 1), k, k, i > 0) for d, kinds in docs.items() for i, k in enumerate(kinds)]
    nodes = spark.createDataFrame(rows[::-1], "doc_id string, place int, level int, type string, value string, terminal boolean")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        got = {r.doc_id: r.text for r in trees.lisp(nodes.coalesce(1)).collect()}
        assert got == {None: "(r x y)", "a": "(r)", "b": "(r" + "".join(f"\n  {k}" for k in "tuvwxyz") + "\n)", "": "(r '  )"}
        assert trees.lisp(nodes.where("place < 0")).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert plan(trees.lisp(nodes)).count("Exchange hash") == 1


def test_compact_tree_texts_move_no_node(spark):
    found = plan(tree_plans.compact_tree_texts(spark, SF))
    assert found.count("Exchange hash") <= 3 and found.index("Generate inline") < found.index("Exchange hash")
    kinds = [("Identifier", 0), ("Literal", 1), ("t", 2), ("Literal", 0), ("Literal", 1), ("u", 2), ("A", 1), (None, 2)]
    nodes = spark.createDataFrame([(1, i, level, k, 'say "B"' if k == "u" else None, k in ("t", "u", None)) for i, (k, level) in enumerate(kinds)], "doc_id long, place int, level int, type string, value string, terminal boolean")
    assert [r.text for r in trees.compact_lisp(nodes.repartition(3)).collect()] == ['t(Literal "say \\"B\\"" (A ))']
    assert plan(trees.compact_lisp(nodes)).count("Exchange hash") == 1
