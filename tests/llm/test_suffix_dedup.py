"""Removal of repeated passages against counting every string."""

import random

import numpy as np
import pytest

from conftest import SF
from sparkloom.llm import common, registry, suffix_dedup

DOCS = "doc_id long, text string, shard int, n_bytes string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def noise(r, n, letters="abcdefgh é\n"):
    return "".join(r.choice(letters) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    passage, base = noise(r, 900), noise(r, 2500)
    out = [base, base, passage[:200], passage[:199], passage[1:201], "", None, "short", "a" * 700, "ab" * 300, "\x00" * 450, noise(r, 199)]
    for _ in range(12):
        a, b = sorted(r.sample(range(900), 2))
        out.append(noise(r, r.randrange(300)) + passage[a:b] + noise(r, r.randrange(300)))
    for _ in range(12):  # near copies
        t = list(base)
        for _ in range(r.choice([1, 3, 9])):
            t[r.randrange(len(t))] = r.choice("XYZ")
        out.append("".join(t)[r.randrange(50) :])
    twice = noise(r, 230)
    out += [twice + "-" + twice, noise(r, 4000), base[:1000] + noise(r, 10) + base[1000:], base[300:501] + "\x00" * 10 + base[301:502]]
    out += ["".join(r.choice(["lorem ipsum ", "dolor sit amet "]) for _ in range(120)) for _ in range(4)]
    return [(None if i == 3 else i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    data = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "clash") for x in data], DOCS).repartition(5)
    assert rows(suffix_dedup.dedupe(df)) == sorted(suffix_dedup.brute_force(data), key=repr)


@pytest.mark.parametrize("big", [0, 3, 10**6])
def test_many_shards_bins_and_split_cores(spark, monkeypatch, big):
    monkeypatch.setattr(suffix_dedup, "BIG", big)
    monkeypatch.setattr(suffix_dedup, "BIN_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BIN_CONTEXTS", 50)
    data = corpus(9)
    df = spark.createDataFrame([(*x, 1, "") for x in data], DOCS).repartition(3)


    assert rows(suffix_dedup.dedupe(df, shard_bytes=3000)) == sorted(suffix_dedup.brute_force(data), key=repr)


def test_empty(spark):
    df = spark.createDataFrame([(1, "x", 1, "")], DOCS)
    assert suffix_dedup.dedupe(df.limit(0)).collect() == []
    assert rows(suffix_dedup.dedupe(spark.createDataFrame([(1, None, 1, ""), (1, "", 2, "")], DOCS))) == suffix_dedup.brute_force([(1, None), (1, "")])


def test_pieces_of_a_long_text(monkeypatch):
    """A text longer than a piece has the anchors it has in one piece."""
    r = random.Random(4)
    data = np.frombuffer(noise(r, 60_000).encode(), np.uint8)
    ends = np.array([0, 150, 150, 20_000, 20_071, len(data)])
    whole = suffix_dedup.Anchored(data, ends)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    cut = suffix_dedup.Anchored(data, ends)
    assert all(np.array_equal(getattr(whole, c), getattr(cut, c)) for c in ("place", "low", "high"))
    assert np.diff(whole.place[whole.place > 20_071]).max() <= suffix_dedup.SPAN


def test_every_window_has_one_anchor():
    r = random.Random(8)
    texts = [noise(r, n).encode() for n in (200, 201, 333, 5000)] + [b"z" * 450]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    own = suffix_dedup.Anchored(data, ends)
    starts = suffix_dedup.repeated_starts(own, np.full(len(own.one), 2**64 - 1, np.uint64))
    want = [b + k for t, b in zip(texts, ends - [len(t) for t in texts], strict=True) for k in range(len(t) - 199)]
    assert sorted(starts.tolist()) == want


def test_query_equals_brute_force(spark):
    data = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows(registry.op13(spark, SF)) == sorted(suffix_dedup.brute_force(data), key=repr)
