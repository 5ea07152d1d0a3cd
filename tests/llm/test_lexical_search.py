"""Ranked lexical search against scoring every document."""

import random

import pytest

from compare import same
from conftest import SF
from sparkloom.llm import lexical_search, registry

DOCS = "doc_id long, text string, rank int, item_id string"
ITEMS = "item_id long, text string, score string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n, words):
    r = random.Random(seed)
    docs = [(r.randrange(n), " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40])))) for _ in range(n)]
    docs += [docs[0], docs[1], (None, "alpha beta"), (None, None), (7, None), (8, "  ... "), (9, "É é ALPHA"), (10, "long " * 20_000 + "alpha")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12])))) for i in range(9)]
    items += [items[0], (1, "alpha"), (None, "beta"), (50, None), (51, "!"), (52, "missing"), (53, "Ép É")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k", [1, 4, 50])
def test_equals_brute_force(spark, monkeypatch, seed, k):
    monkeypatch.setattr(lexical_search, "DEPTH", 1 + seed)
    docs, items = corpus(seed, 120, ["alpha", "beta", "gamma", "Delta", "eps", "x1", "é", "zeta", "eta", "rare"][: 4 + 3 * seed])
    d = spark.createDataFrame([(*x, 0, "clash") for x in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    want = sorted(lexical_search.brute_force(docs, items, k), key=repr)
    assert rows(lexical_search.search(d, q, k)) == want
    assert rows(lexical_search.search(d, q, k, most_words=20)) == want  # several blocks, an index of all terms


def test_shards_and_early_stop(spark):
    """A shard's best documents, whatever the bar, and without reading what the bar rules out."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, [r.choice(words[: r.choice([3, 40])]) for _ in range(30)]) for i in range(400)]
    names = [w.encode() for w in words]
    row = lexical_search.shard_row([(d, len(w), [words.index(x) for x in w]) for d, w in docs], names, len(docs))
    held = {c: v[0] for c, v in row.items()}
    weights = {n: lexical_search.weight(400, sum(n.decode() in w for _, w in docs)) for n in names}
    shard = lexical_search.Shard(held, weights, 400, 12_000)
    everything, scores = shard.best(names[3:9], 10**6, 0)
    ranked = sorted(zip((-scores).tolist(), everything.tolist(), strict=True))
    for k in (1, 5, 60):
        found, own = shard.best(names[3:9], k, 0)
        assert sorted(zip((-own).tolist(), found.tolist(), strict=True))[:k] == ranked[:k]
    assert len(shard.best(names[3:9], 5, -ranked[0][0] + 1)[0]) == 0
    assert len(shard.best([b"nowhere"], 5, 0)[0]) == 0


def test_index_keeps_counts(spark):
    d = spark.createDataFrame([(i, "a a b " * i, 0, "") for i in range(30)], DOCS).repartition(2)
    index = lexical_search.build_index(d, shard_words=50)
    n, words, holding = lexical_search.statistics(index, {b"a", b"b", b"c"})
    assert (n, words, holding) == (29, 3 * sum(range(30)), {b"a": 29, b"b": 29})
    assert index.count() > 4


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b", 0, "")], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert lexical_search.search(d.limit(0), q).collect() == []
    assert lexical_search.search(d, q.limit(0)).collect() == []
    assert lexical_search.search(d, q).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_against_sql(spark, duck):
    assert same(registry.op11(spark, SF), duck, lexical_search.SQL) > 1000
