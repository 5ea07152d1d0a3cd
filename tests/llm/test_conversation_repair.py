"""Conversation repair against trying all edits with their audits as text."""

import random

import pytest

from compare import same
from conftest import SF
from sparkloom.llm import common, conversation_repair as repair, registry

TURNS = "conv_id long, turn long, role string, text string, audit string, part int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n=60):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No", "Why?", "", " \n\t", "ok! ", "a.b", None, "é。", " "]
    out = []
    for conv in [*range(n), None]:
        size = r.choice([0, 1, 2, 3, 5, 9, 30])
        for k in range(size):
            turn = None if r.random() < 0.05 else k + (r.random() < 0.2)
            role = r.choice(roles) if r.random() < 0.5 else ["user", "assistant"][k % 2]
            out.append((conv, turn, role, r.choice(texts) if r.random() < 0.4 else f"line {conv} {k}."))
    return out + out[:7]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    data = made(seed)
    df = spark.createDataFrame([(*x, "clash", 3) for x in data], TURNS).repartition(4)
    want = sorted(repair.brute_force(data), key=repr)
    assert rows(repair.repair_damaged(df)) == want
    assert rows(repair.repair_damaged(df, piece=2)) == want  # all conversations in pieces of two rows


def test_all_rows_dropped_and_empty(spark):
    import zlib

    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 0)], TURNS)
    got = repair.repair_damaged(df).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]
    assert repair.repair_damaged(df.limit(0)).collect() == []


def test_one_conversation_over_all_tasks(spark):
    r = random.Random(3)
    data = [(5, k, r.choice(["user", "assistant", "system"]), r.choice(["One.", f"two {k}", f"three {k}?"]) + "x" * (k == 700) * 300_000) for k in range(1500)]
    df = spark.createDataFrame([(*x, "", 0) for x in data], TURNS).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(repair.repair_damaged(df, piece=100)) == repair.brute_force(data)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(30))
def test_ranks_are_the_order_of_audits(seed):
    """Ranks by doubled pairs order nodes as their whole audits do."""
    r = random.Random(seed)
    codes = bytes(r.randrange(4) + r.choice([0, 0, 4, 8]) for _ in range(r.randrange(12)))
    found = repair.arcs(codes, repair.costs(codes, list(repair.GOAL), True), list(repair.GOAL), True)

    def audit(node):
        steps = [(repair.LETTERS[i], int(to)) for i, to in enumerate(found[node]) if to >= 0]
        return min((letter + audit(to) for letter, to in steps), default="")

    audits = [audit(n) for n in range(len(found))]
    paths, ranks = repair.least_paths(found, [0, 1, 2, 3])
    order = {a: i for i, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == ranks.tolist()
    assert [a for a, _ in repair.solve(codes, list(repair.GOAL), True, [0, 1, 2, 3])] == audits[:4]


def test_query_equals_brute_force(spark):
    data = [tuple(r) for r in common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows(registry.op12(spark, SF)) == sorted(repair.brute_force(data), key=repr)


def test_query_against_sql(spark, duck):
    assert same(registry.op12(spark, SF), duck, repair.SQL) > 10
