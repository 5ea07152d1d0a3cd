"""Ranked lexical search by the Best Position Algorithm over a stored index of impact lists.

The documents are dealt into shards of about SHARD_WORDS words; each shard is one row of a stored index: its documents
in order of doc_id, their lengths, and for each term the documents that hold it with their counts. Corpus statistics
come from the index. A search maps over the shards. In a shard every query term has an impact list (its documents by
descending local score). Lists are read from the top in step; a document met in one list is looked up in all others at
once, which gives its score and its positions there. A list's best position is the end of the run of seen positions
from its top, whether they were read or looked up; no document still unseen scores more than the sum of the impacts just behind the
best positions. The search of a shard stops where that sum is strictly below the kth score, so that equal scores of
smaller ids are never lost. A task keeps its kth scores from shard to shard and passes on k rows an item at most; these
are merged in two steps, first those of groups of tasks, then those of each item.

Queries of at most MOST_WORDS words are one block, and only their terms are indexed. More are searched in blocks of that size, each
against an index of all terms.

Defined cases: null and wordless documents have no term and are not counted; rows that share an item_id are one item with the
terms of all; a null item_id is an item of its own; items without terms have no rows; repeated document rows are documents of
their own; null doc_ids rank behind all others of equal score; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameters.
K, SHARD_WORDS, MOST_WORDS = 50, 2_000_000, 2_000_000
#: Positions of each list that the first round of a search reads; every round reads twice as many.
DEPTH = 32
#: Groups of tasks whose rows are merged first.
GROUPS = 1024

INDEX = T.StructType(
    [
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("docs", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)
SUMS = T.StructType([T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("more", T.LongType())])


def shard_row(docs: list[tuple[int | None, int, list[int] | np.ndarray]], names: list[bytes], width: int) -> dict[str, list]:
    """A row of INDEX for documents (doc_id, length, numbers of their indexed terms)."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    sizes = np.fromiter((len(d[2]) for d in docs), np.int64, len(docs))
    numbers = np.concatenate([np.asarray(d[2], np.int64) for d in docs]) if docs else np.zeros(0, np.int64)
    pairs, counts = np.unique(numbers * width + np.repeat(np.arange(len(docs)), sizes), return_counts=True)
    terms, firsts = np.unique(pairs // width, return_index=True)
    return {
        "doc_ids": [[d[0] for d in docs]],
        "lengths": [[d[1] for d in docs]],
        "terms": [[names[t] for t in terms]],
        "ends": [np.r_[firsts[1:], len(pairs)] if len(terms) else []],
        "docs": [(pairs % width).astype(np.int32).tobytes()],
        "counts": [counts.astype(np.int32).tobytes()],
    }


def build_index(docs: DataFrame, terms: set[bytes] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard, of documents with a term. terms: index these only (all where None)."""
    kinds = common.arrow_schema(INDEX)
    known = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, numbers = [], 0, dict(known or {})

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(shard_row(held, list(numbers), len(held)), schema=kinds)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not (words := common.folded_words(text)):
                    continue
                if known is None:
                    for w in words:
                        numbers.setdefault(w, len(numbers))
                    held.append((doc_id, len(words), list(map(numbers.__getitem__, words))))
                else:
                    found = np.fromiter((numbers.get(w, -1) for w in words), np.int32, len(words))
                    held.append((doc_id, len(words), found[found >= 0]))
                size += len(words) + 8
                if size >= shard_words:
                    yield row()
                    held, size, numbers = [], 0, dict(known or {})
        if held:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def statistics(index: DataFrame, terms: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and the documents that hold each of these terms, of which there are as many as a block has at most."""
    kinds = common.arrow_schema(SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, n, words = Counter(), 0, 0
        for batch in batches:
            for lengths, names, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, words = n + len(lengths), words + sum(lengths)
                for name, held in zip(names, np.diff(ends, prepend=0).tolist(), strict=True):
                    if name in terms:
                        holding[name] += held
        if n:
            yield pa.RecordBatch.from_pydict({"term": [None, *holding], "n": [n, *holding.values()], "more": [words] + [0] * len(holding)}, schema=kinds)

    sums = index.select("lengths", "terms", "ends").mapInArrow(run, SUMS).groupBy("term").agg(F.sum("n"), F.sum("more"))
    found = {None if t is None else bytes(t): (n, more) for t, n, more in sums.collect()}
    n, words = found.pop(None, (0, 0))
    return n, words, {t: v for t, (v, _) in found.items()}


def weight(n: int, holding: int) -> int:
    return math.floor(1000 * math.log((2.0 * n + 2.0) / (2.0 * holding + 1.0)))


class Shard:
    """A row of the index with the impact lists of the terms of a block of queries."""

    def __init__(self, row: dict, weights: dict[bytes, int], n: int, words: int) -> None:
        self.doc_ids, self.size = row["doc_ids"], len(row["doc_ids"])
        lengths = np.array(row["lengths"], np.int64)
        norm = 50 + (50 * lengths * n) // words
        ends = np.array(row["ends"], np.int64)
        docs, counts = np.frombuffer(row["docs"], np.int32).astype(np.int64), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        each = np.diff(ends, prepend=0)
        at = np.repeat(np.arange(len(ends)), each)
        weighed = np.array([weights.get(t, 0) for t in row["terms"]], np.int64)
        self.numbers = {t: i for i, t in enumerate(row["terms"])}
        self.begin, self.end = ends - each, ends
        self.key = at * self.size + docs  # rises: for looking a document up in a list
        self.impact = weighed[at] * ((1_000_000_000 * counts) // (1000 * counts + 20 * norm[docs]))
        self.order = np.lexsort((docs, -self.impact, at))  # the impact lists, one after the other
        self.position = np.empty_like(self.order)
        self.position[self.order] = np.arange(len(self.order))
        self.listed, self.doc = self.impact[self.order], docs[self.order]

    def best(self, terms: list[bytes], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, those of the k highest scores of the shard among them; bar: a score below which none is wanted."""
        lists = np.array([self.numbers[t] for t in terms if t in self.numbers], np.int64)
        if not len(lists):
            return lists, lists
        begin, size = self.begin[lists], self.end[lists] - self.begin[lists]
        seen = [np.zeros(n + 1, bool) for n in size]  # the position behind a list is never seen
        front, top, depth, step = np.zeros(len(lists), np.int64), self.listed[begin], 0, DEPTH
        done, docs, scores = np.zeros(self.size, bool), [], []
        while (rest := int(top.sum())) >= max(bar, 1):
            read = np.concatenate([self.doc[b + depth : b + min(depth + step, n)] for b, n in zip(begin, size, strict=True)])
            depth, step = depth + step, 2 * step
            if len(new := np.unique(read[~done[read]])):
                done[new] = True
                total = np.zeros(len(new), np.int64)
                for i, t in enumerate(lists):  # direct accesses
                    sought = t * self.size + new
                    at = begin[i] + np.searchsorted(self.key[begin[i] : begin[i] + size[i]], sought)
                    hit = self.key[np.minimum(at, len(self.key) - 1)] == sought
                    total[hit] += self.impact[at[hit]]
                    seen[i][self.position[at[hit]] - begin[i]] = True
                docs.append(new)
                scores.append(total)
                if sum(map(len, scores)) >= k:
                    bar = max(bar, int(np.partition(np.concatenate(scores), -k)[-k]))
            for i, n in enumerate(size):
                front[i] += np.argmin(seen[i][front[i] :])  # behind the best position
                top[i] = self.listed[begin[i] + front[i]] if front[i] < n else 0
            if rest == 0 or depth >= size.max():
                break
        if not docs:
            return front[:0], front[:0]
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        kept = scores >= max(bar, 1)
        return docs[kept], scores[kept]


def search_block(index: DataFrame, items: list[tuple[object, list[bytes]]], item_type: T.DataType, k: int = K) -> DataFrame:
    """The k best documents of each item. items: (item_id, terms)."""
    n, words, holding = statistics(index, {t for _, terms in items for t in terms})
    weights = {t: weight(n, df) for t, df in holding.items()}
    queries = [[t for t in terms if weights.get(t)] for _, terms in items]
    ids = [i for i, _ in items]
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]
    )
    kinds = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(batch.slice(r, 1).to_pylist()[0], weights, n, words)
                for i, terms in enumerate(queries):
                    docs, scores = shard.best(terms, k, -best[i][-1][0] if len(best[i]) >= k else 0)
                    found = [(-s, shard.doc_ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                    best[i] = sorted(best[i] + found, key=lambda x: (x[0], x[1] is None, x[1] or 0))[:k]
        rows = [(i, -s, d) for i, top in enumerate(best) for s, d in top]
        if rows:
            at, scores, docs = zip(*rows, strict=True)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part] * len(rows), "item": at, "item_id": [ids[i] for i in at], "doc_id": docs, "score": scores}, schema=kinds)

    found = index.mapInArrow(run, schema)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    group = F.pmod("part", F.lit(GROUPS))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", group).orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = K, most_words: int = MOST_WORDS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item of queries (item_id, text)."""
    common.ship(docs.sparkSession)
    items = queries.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // (2 * most_words)) or 1  # a word and its separator are two characters at least
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))

    def block(b: int) -> list[tuple[object, list[bytes]]]:
        terms: dict[object, set[bytes]] = {}
        for item, text in items.where(part == b).collect():
            terms.setdefault(item, set()).update(common.folded_words(text))
        return [(i, sorted(t)) for i, t in terms.items()]

    first = block(0)
    index = common.stored(build_index(docs, {t for _, terms in first for t in terms} if blocks == 1 else None), "lexical")
    found = search_block(index, first, items.schema["item_id"].dataType, k)
    for b in range(1, blocks):
        found = found.unionByName(search_block(index, block(b), items.schema["item_id"].dataType, k))
    return found


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], k: int = K) -> list[tuple]:
    """The same rows by scoring every document for every item, for tests."""
    bags = [(d, Counter(w)) for d, t in docs if (w := common.folded_words(t))]
    n, words = len(bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    terms: dict[object, set[bytes]] = {}
    for item, text in items:
        terms.setdefault(item, set()).update(common.folded_words(text))
    out = []
    for item, own in terms.items():
        scored = []
        for d, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // words
            s = sum(weight(n, holding[t]) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def _sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words} as w from documents),
c as (select count(*) as n, sum(len(w)) as l from d where len(w) > 0),
q as (select distinct item_id, unnest({words}) as term from benchmark),
p as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) where term in (select term from q) group by all),
i as (select term, cast(floor(1000 * ln((2.0::double * (select n from c) + 2) / (2.0::double * count(*) + 1))) as bigint) as w from p group by term),
m as (select r, doc_id, 50 + (50 * len(w)::bigint * n) // l::bigint as m from d, c where len(w) > 0),
s as (select item_id, r, sum(i.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join p using (term) join i using (term) join m using (r) group by item_id, r)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s join m using (r) where score > 0)
where rank <= {K}
"""


SQL = _sql()
