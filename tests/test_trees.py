"""Tree readers and writers against recursion over random trees."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import trees

TYPES = ["A", "B", "Literal", "Identifier", "CobolWord"]
VALUES = ["x", ".", " ", None, "a b", 'q"q', "\n", "(", "it's"]


def made(r, level, most):
    """(type, value, children or None for terminals)."""
    if level and (level >= most or r.random() < 0.4):
        return "t", r.choice(VALUES), None
    return r.choice(TYPES), None, [made(r, level + 1, most) for _ in range(r.choice([0, 1, 1, 2, 4, 6]))]


def flat(tree, doc, level=0, out=None):
    out = [] if out is None else out
    kind, value, children = tree
    out.append((doc, len(out), level, kind, value, children is None))
    for c in children or []:
        flat(c, doc, level + 1, out)
    return out


def word(kind, value):
    return kind if value is None or value.strip() in trees.MEANINGLESS else value


def long_form(tree, depth=0):
    kind, value, children = tree
    if children is None:
        return word(kind, value)
    if not children:
        return f"({kind})"
    if len(children) <= 3 or kind in trees.INLINE_TYPES or (len(children) <= 5 and all(c[2] is None for c in children)):
        return f"({kind}" + "".join(" " + long_form(c) for c in children) + ")"
    pad = "  " * depth
    return f"({kind}" + "".join(f"\n{pad}  " + long_form(c, depth + 1) for c in children) + f"\n{pad})"


def short_form(tree):
    kind, value, children = tree
    if children is None:
        w = word(kind, value)
        return '"' + w.replace('"', '\\"') + '"' if w == value and any(c in w for c in " '\"") else w
    if kind in trees.WRAPPER_TYPES and len(children) == 1:
        return short_form(children[0])
    return f"({kind}" + "".join(" " + short_form(c) for c in children) + ")"


@pytest.mark.parametrize("seed", range(3))
def test_writers_equal_recursion(spark, seed):
    r = random.Random(seed)
    docs = [made(r, 0, r.choice([1, 3, 9])) for _ in range(40)]
    chain = ("A", None, [])
    for _ in range(60):  # a deep tree
        chain = ("A", None, [chain, *[("t", "x", None)] * r.choice([0, 4])])
    docs.append(chain)
    nodes = spark.createDataFrame([n for d, t in enumerate(docs) for n in flat(t, d)], "doc_id int, place int, level int, type string, value string, terminal boolean").repartition(3)
    assert {r.doc_id: r.text for r in trees.lisp(nodes).collect()} == {d: long_form(t) for d, t in enumerate(docs)}
    assert {r.doc_id: r.text for r in trees.compact_lisp(nodes).collect()} == {d: short_form(t) for d, t in enumerate(docs)}


def test_reader(spark):
    texts = spark.createDataFrame([(1, '(A "x (\\" \\\\n" (B) 3 (C (D "y")) "") ) (E'), (2, ""), (3, None), (4, 'a "open')], "doc_id int, text string")
    rows = sorted((tuple(r) for r in trees.read(texts).collect()), key=lambda r: r[:2])
    assert rows == [
        (1, 0, 1, None, 0, True, False, None), (1, 1, 2, 0, 0, False, False, "A"), (1, 2, 2, 0, 1, False, True, 'x (" \\n'), (1, 3, 2, 0, 2, True, False, None), (1, 4, 3, 3, 0, False, False, "B"),
        (1, 6, 2, 0, 3, False, False, "3"), (1, 7, 2, 0, 4, True, False, None), (1, 8, 3, 7, 0, False, False, "C"), (1, 9, 3, 7, 1, True, False, None), (1, 10, 4, 9, 0, False, False, "D"),
        (1, 11, 4, 9, 1, False, True, "y"), (1, 14, 2, 0, 5, False, True, ""), (1, 17, 1, None, 1, True, False, None), (1, 18, 2, 17, 0, False, False, "E"),
        (4, 0, 1, None, 0, False, False, "a"), (4, 1, 1, None, 1, False, True, "open"),
    ]


def test_quotes_round_trip(spark):
    texts = ["C:\\new", "a\tb\r\n", '"', "\\", '\\"', "\\\\n", "é (", "", "x\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.select(trees.unquoted(trees.quoted(F.col("t"))).alias("t")).collect()] == texts
