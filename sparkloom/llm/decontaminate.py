"""Benchmark decontamination over a distributed positional inverted index.

The training documents are dealt into shards of about SHARD_WORDS words. Each shard is one row: the postings of its
terms as sorted positions, and where its documents begin. The index is stored; a search maps over its shards with
no shuffle. For every window of the benchmark the lists of its terms are intersected after subtracting each term's
offset, starting from the term that is rarest in the shard, all windows of a length at once. With a tolerance the
same walk gives proximity matches: every term within `slop` words of its place.

Where the benchmark has at most MOST_WORDS words it is one block and only its terms are indexed. A larger one is
searched in blocks of that size, each against all rows of an index of all terms.

Defined cases: null and wordless documents have no words and no hits; items with no words have no window; items
that share an id count once; a null item_id counts as the empty string; repeated document rows get a row each; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameters.
WINDOW, SLOP, SHARD_WORDS, MOST_WORDS = 10, 2, 400_000, 2_000_000
#: Free positions between documents of a shard, so that no window and no tolerance reaches across.
GAP = 64
_SPAN = np.int64(1) << 40

SHARD = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("positions", T.BinaryType()),
    ]
)


def postings(shard: int, docs_of: list[tuple], known: dict[bytes, int] | None) -> dict[str, list]:
    """A row of SHARD for documents (doc_id, key, words); known: numbers of the terms to index, all where None."""
    vocabulary = dict(known) if known is not None else {}
    ids, starts, at = [], [], 0
    for _, _, words in docs_of:
        if known is None:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        ids.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words)))
        starts.append(at)
        at += len(words) + GAP
    flat = np.concatenate(ids)
    place = np.concatenate([np.arange(s, s + len(i)) for s, i in zip(starts, ids, strict=True)])
    held = flat >= 0
    flat, place = flat[held], place[held]
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    cuts = np.flatnonzero(np.diff(flat)) + 1
    ends = np.r_[cuts, len(flat)] if len(flat) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[cuts] = place[cuts]
    names = list(vocabulary)
    return {
        "shard": [shard],
        "doc_ids": [[d for d, _, _ in docs_of]],
        "keys": [[k for _, k, _ in docs_of]],
        "starts": [starts],
        "n_words": [[len(w) for _, _, w in docs_of]],
        "terms": [[names[i] for i in flat[ends - 1]]] if len(flat) else [[]],
        "ends": [ends],
        "positions": [gaps.astype(np.int32).tobytes()],
    }


def build_index(docs: DataFrame, terms: set[bytes] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard. terms: index these only (all where None). positions: int32 gaps, per term from 0."""
    kinds = common.arrow_schema(SHARD)
    known = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}

    def run(batches):
        from pyspark import TaskContext

        shard, docs_of, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = common.folded_words(text)
                docs_of.append((doc_id, key, words))
                size += len(words) + 8
                if size >= shard_words:
                    yield pa.RecordBatch.from_pydict(postings(shard, docs_of, known), schema=kinds)
                    shard, docs_of, size = shard + 1, [], 0
        if docs_of:
            yield pa.RecordBatch.from_pydict(postings(shard, docs_of, known), schema=kinds)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text).mapInArrow(run, SHARD)


class Windows:
    """The distinct windows of a block of items: by length, a matrix of term numbers, and the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [numbers.setdefault(w, len(numbers)) for w in common.folded_words(text)]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners[tuple(ids[k : k + width])].add(item or "")
        self.numbers = numbers
        by_length = defaultdict(list)
        for window in owners:
            by_length[len(window)].append(window)
        self.groups = [(n, np.array(rows, np.int64), [sorted(owners[r]) for r in rows]) for n, rows in sorted(by_length.items())]


def matches(windows: np.ndarray, count: np.ndarray, begin: np.ndarray, keys: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) pairs: a match's start, or with slop the place of its rarest term. keys: sorted term * _SPAN + position; begin, count: of each term's list in keys.

    A match is a start from which every term has an occurrence at most `slop` words from its offset.
    """
    width = windows.shape[1]
    alive = np.flatnonzero((count[windows] > 0).all(axis=1))
    if not len(alive):
        return alive, alive
    order = np.argsort(count[windows[alive]], axis=1, kind="stable")
    rarest = windows[alive, order[:, 0]]
    many = count[rarest]
    row = np.repeat(np.arange(len(alive)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    place = keys[begin[rarest][row] + nth] % _SPAN
    shifts = np.arange(-slop, slop + 1)
    row, place, shift = np.repeat(row, len(shifts)), np.repeat(place, len(shifts)), np.tile(shifts, len(row))
    start = place - order[row, 0] + shift
    for k in range(1, width):
        if not len(row):
            break
        offset = order[row, k]
        first, last = np.maximum(start + offset - slop, 0), start + offset + slop
        term = windows[alive[row], offset] * _SPAN
        found = np.searchsorted(keys, term + first)
        fits = (last >= 0) & (keys[np.minimum(found, len(keys) - 1)] <= term + last) & (found < len(keys))
        row, start, place = row[fits], start[fits], place[fits]
    return alive[row], place - (order[row, 0] if not slop else 0)


HITS = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("ord", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)


def searched(row: dict[str, list], windows: Windows, slop: int) -> dict[str, list]:
    """HITS of the documents of a row of SHARD."""
    starts, sizes = np.array(row["starts"], np.int64), np.array(row["n_words"], np.int64)
    gaps, ends = np.frombuffer(row["positions"], np.int32).astype(np.int64), np.array(row["ends"], np.int64)
    lengths = np.diff(ends, prepend=0)
    number = np.array([windows.numbers.get(t, -1) for t in row["terms"]], np.int64)
    total = np.cumsum(gaps)
    base = np.r_[0, total[ends[:-1] - 1]] if len(ends) else np.zeros(0, np.int64)
    place = total - np.repeat(base, lengths)
    keys = np.repeat(number, lengths) * _SPAN + place
    keys = np.sort(keys[np.repeat(number >= 0, lengths)])
    count, begin = np.zeros(len(windows.numbers), np.int64), np.zeros(len(windows.numbers), np.int64)
    if len(keys):
        terms, first, many = np.unique(keys // _SPAN, return_index=True, return_counts=True)
        count[terms], begin[terms] = many, first
    marks = np.zeros((int(starts[-1] + sizes[-1]) if len(starts) else 0) + GAP + 1, np.int64)
    items, near = [set() for _ in starts], [set() for _ in starts]
    for width, rows, owners in windows.groups if len(keys) else []:
        which, at = matches(rows, count, begin, keys, 0)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + width, -1)
        for w, d in set(zip(which.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True)):
            items[d].update(owners[w])
        if slop:
            which, at = matches(rows, count, begin, keys, slop)
            for w, d in set(zip(which.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True)):
                near[d].update(owners[w])
    hit = np.cumsum(marks) > 0
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
    owner = np.searchsorted(starts, edges, "right") - 1
    spans = [[] for _ in starts]
    for d, e in zip(owner.tolist(), edges.tolist(), strict=True):
        spans[d].append(e - int(starts[d]))
    n = len(starts)
    return {
        "shard": [row["shard"]] * n, "ord": list(range(n)), "doc_id": row["doc_ids"], "key": row["keys"], "n_words": row["n_words"],
        "spans": spans, "items": [sorted(x) for x in items], "near_items": [sorted(x) for x in near],
    }


def search_block(index: DataFrame, windows: Windows, slop: int = SLOP) -> DataFrame:
    """Per document of the index: merged hit spans (flat start, end pairs in words), items found exactly and nearby."""
    kinds = common.arrow_schema(HITS)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(searched(batch.slice(k, 1).to_pylist()[0], windows, slop), schema=kinds)

    return index.mapInArrow(run, HITS)


def _blocks(benchmark: DataFrame, width: int, most_words: int) -> tuple[int, Callable[[int], Windows]]:
    """How many blocks the benchmark makes, and a function that reads one of them."""
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text.alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // (2 * most_words)) or 1  # a word and its separator are two characters at least
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return blocks, lambda k: Windows([tuple(r) for r in items.where(part == k).collect()], width)


def search(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP, most_words: int = MOST_WORDS) -> DataFrame:
    """HITS rows for every document row, over the whole benchmark."""
    common.ship(docs.sparkSession)
    blocks, block = _blocks(benchmark, width, most_words)
    first = block(0)
    index = common.stored(build_index(docs, set(first.numbers) if blocks == 1 else None), "index")
    found = search_block(index, first, slop)
    if blocks == 1:
        return found
    for k in range(1, blocks):
        found = found.unionByName(search_block(index, block(k), slop))
    merged = found.groupBy("shard", "ord", "doc_id", "key", "n_words").agg(
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items"))  # a row a block at most
    )

    def union(batch):
        out = {n: batch.column(n) for n in HITS.fieldNames()}
        spans = []
        for flat in out["spans"].to_pylist():
            held: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if held and a <= held[-1]:
                    held[-1] = max(held[-1], b)
                else:
                    held += [a, b]
            spans.append(held)
        return out | {"spans": spans} | {c: [sorted(set(x)) for x in out[c].to_pylist()] for c in ("items", "near_items")}

    return common.map_rows(merged.select(HITS.fieldNames()), union, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row a document: words, words inside an occurrence of a window, items found, their digest, proximity items.

    n_near_items counts items with a window all of whose terms are within `slop` words of their places from some start.
    """
    found = search(docs, benchmark, width, slop)
    length = F.aggregate(
        F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"),
        lambda s, i: s + F.when(i % 2 == 0, -F.get("spans", i)).otherwise(F.get("spans", i)),
    )
    n_hit = F.when(F.size("spans") > 0, length).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents in which no benchmark window occurs.

    Each task indexes its documents shard by shard, searches the shard and passes on its clean documents: nothing is
    shuffled or stored, and a benchmark of several blocks is as many such maps in a row. Null and wordless texts stay;
    repeated rows stay or go together; an empty benchmark drops nothing; other columns are kept.
    """
    common.ship(docs.sparkSession)
    blocks, block = _blocks(benchmark, width, most_words)
    at = docs.columns.index("text")

    def clean(windows: Windows, shard_words: int = SHARD_WORDS):
        known = {t: i for i, t in enumerate(sorted(windows.numbers))}

        def passed(held, words):
            hits = searched({c: v[0] for c, v in postings(0, [(None, None, w) for w in words], known).items()}, windows, 0)["spans"]
            ok, k = [not x for x in hits], 0
            for batch in held:
                yield batch.filter(pa.array(ok[k : k + batch.num_rows], pa.bool_()))
                k += batch.num_rows

        def run(batches):
            held, words, size = [], [], 0
            for whole in batches:
                start = 0
                for k, text in enumerate(whole.column(at).to_pylist()):
                    words.append(common.folded_words(text))
                    size += len(words[-1]) + 8
                    if size >= shard_words:
                        yield from passed([*held, whole.slice(start, k + 1 - start)], words)
                        held, words, size, start = [], [], 0, k + 1
                if start < whole.num_rows:
                    held.append(whole.slice(start))
            if words:
                yield from passed(held, words)

        return run

    for k in range(blocks):
        docs = docs.mapInArrow(clean(block(k)), docs.schema)
    return docs


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], width: int = WINDOW) -> list[tuple]:
    """The same rows one document and one window at a time, for tests."""
    out = []
    for doc_id, text in docs:
        words = common.folded_words(text)
        hit, found = set(), set()
        for item, item_text in items:
            own = common.folded_words(item_text)
            for k in range(max(1, len(own) - width + 1) if own else 0):
                window = own[k : k + width]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def _sql() -> str:
    """The same rows as contamination() in DuckDB's SQL: exact windows by their text, nearby ones by counting terms for each start."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words('text')} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {words('text')} as w from benchmark),
iw as (select distinct item, w[i:i + {WINDOW - 1}] as g from (select item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as i from b where len(w) > 0)),
g as (select row_number() over () as k, g, len(g) as n, list(item) as items from iw group by g),
p as (select r, unnest(w) as term, unnest(range(len(w))) as i from d),
x as (select r, w, n, unnest(range(len(w) - n + 1)) as i from d, (select distinct n from g) where n <= len(w)),
h as (select r, i, k, x.n, items from (select r, i, n, array_to_string(w[i + 1:i + n], ' ') as s from x) x join (select *, array_to_string(g, ' ') as s from g) g on g.n = x.n and g.s = x.s),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from h) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, unnest(items) as item from h) group by r),
o as (select k, n, unnest(g) as term, unnest(range(n)) as j from g),
df as (select term, count(*) as f from p group by term),
rare as (select k, any_value(n) as n, arg_min(o.term, (f, j)) as term, arg_min(j, (f, j)) as j from o join df on df.term = o.term group by k having count(*) = any_value(n)),
c as (select r, k, i - j + s as start from rare join p using (term), (select unnest(range(-{SLOP}, {SLOP + 1})) as s)),
near as (select distinct r, k from (select c.r, c.k, c.start from c join o on o.k = c.k join p on p.r = c.r and p.term = o.term and p.i between c.start + o.j - {SLOP} and c.start + o.j + {SLOP}
         group by c.r, c.k, c.start having count(distinct o.j) = any_value(o.n))),
n as (select r, count(distinct item) as n_near from (select r, unnest(items) as item from near join g using (k)) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near_items
from d left join hit using (r) left join found using (r) left join n using (r)
"""


#: Of contamination().
SQL = _sql()
