"""Removal of passages that repeat, byte by byte, by prefix-free parsing.

Every byte covered by a WINDOW-byte string that also starts elsewhere goes. Texts are packed into shards, rows of a stored table bucketed by shard,
so that passes over them shuffle nothing. A rolling hash marks triggers: places where the hash of GRAM bytes is the least of SPAN places in
some run around them. Triggers cut a text into phrases of at most SPAN bytes, in the same way wherever the same bytes stand. The first
trigger that a window's bytes decide is its anchor; equal windows have equal anchors at equal places. So a window is a suffix of the phrase that ends
at its anchor, and a prefix of the text that follows; all windows of an anchor share a core of CORE bytes around it.

1. Shards send the fingerprints of their distinct cores and contexts (a context is all that an anchor's windows span). A core found once
   has no repeated window; one whose occurrences have one context has repeated windows only.
2. The distinct contexts of the other cores meet in bins, with their bytes. There the dictionary of phrase ends, read backwards from the core, and
   the parse, read forwards, are sorted: two suffix arrays. The common lengths of neighbours cut either array into classes for every length, and a window is a pair of
   classes, one of the phrase suffix and one of the text that follows: it repeats where its pair does. This is the order in which the two suffix arrays combine, taken core by core;
   an order across cores is not needed to find equal windows.
3. A core with more than BIG contexts is split: its windows are sent by their fingerprints, each to a bin of its own choice.

Answers come back to the shards as bits in the order in which the shard sent its keys, which it computes again. What a shard sends is distinct within it, so
a passage that a third of all documents hold is one key a shard. Equality rests on 128 bits of fingerprints, or on bytes.

Defined cases: null texts are empty; texts shorter than WINDOW keep all; repeated rows are texts of their own and repeat each other; very long
texts are walked in pieces of CHUNK bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 200
#: Bytes of the rolling hash; places of which a trigger is the least.
GRAM, SPAN = 8, 64
#: Bytes of an anchor's core before and after it; bytes of contexts before and after the core.
BEFORE, AFTER, EXTRA = SPAN - 1, WINDOW - 2 * SPAN + 2, SPAN - 1
CORE = BEFORE + AFTER
#: Bytes of a shard, of a piece of it, and of what is read around a piece.
SHARD, CHUNK, REACH = 4 << 20, 1 << 20, 2 * WINDOW
#: Bytes of text whose cores make a bin; contexts that make a bin; contexts of a core beyond which its windows are dealt out.
BIN_BYTES, BIN_CONTEXTS, BIG = 8 << 20, 20_000, 20_000
#: Documents of a shard.
SHARD_DOCS = 50_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LETTERS = common.mix(np.arange(1, 257, dtype=np.uint64) * _BASES[0])
_MADE: dict[int, tuple[np.ndarray, np.ndarray]] = {}

CORES = np.dtype([("core", "<u8"), ("context", "<u8"), ("n", "<u4")])
CONTEXTS = np.dtype([("core", "<u8"), ("core2", "<u8"), ("low", "u1"), ("high", "u1"), ("more", "u1"), ("left", "u1", (SPAN,)), ("right", "u1", (SPAN,))])
WINDOWS = np.dtype([("a", "<u8"), ("b", "<u8")])

SHARDS = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("bytes", T.BinaryType()),
    ]
)
SENT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bin", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("keys", T.BinaryType())])
ANSWERED = T.StructType([*SENT.fields[:3], T.StructField("answer", T.BinaryType()), T.StructField("open", T.LongType())])
RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
)
DISTINCT, MIXED, SPREAD = 1, 2, 3


def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    if which not in _MADE:
        base = int(_BASES[which])
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(CHUNK + 2 * REACH + 1, b, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row))
        _MADE[which] = tuple(made)
    return _MADE[which]


def sums(values: np.ndarray, which: int) -> np.ndarray:
    """Running sums of a rolling polynomial hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which)[0][: len(values)], out=out[1:])
    return out


def hashed(total: np.ndarray, which: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from first to end."""
    return (total[end] - total[first]) * powers(which)[1][first]


def triggers(total: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of a piece whose hash is the least of SPAN places of one document. ends: of documents, in the piece."""
    n = len(total) - GRAM
    places = (total[GRAM:] - total[:-GRAM]) * powers(0)[1][:n]
    places = ((places ^ (places >> np.uint64(29))) * _BASES[1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = places
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    crossing = (ends[:, None] - np.arange(1, SPAN + GRAM - 1)).ravel()  # runs of places that leave the document
    least[crossing[(crossing >= 0) & (crossing < len(least))]] = 0
    most = np.zeros(len(least) + 2 * (SPAN - 1), np.uint32)
    most[SPAN - 1 : SPAN - 1 + len(least)] = least
    for step in (1, 2, 4, 8, 16, 32):
        most = np.maximum(most[:-step], most[step:])
    return np.flatnonzero(most == places)


def anchors(data: np.ndarray, ends: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, ...]:
    """Of the anchors from begin to stop: place, least and greatest window (by its bytes before the core), fingerprints of core, core again, and context."""
    at, to = max(0, begin - REACH), min(len(data), stop + REACH)
    if to - at < WINDOW:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(3)))
    values = _LETTERS[data[at:to]]
    one, two = sums(values, 0), sums(values, 1)
    near = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, to + SPAN + GRAM, "right")] - at
    place = triggers(one, near) + at
    doc = np.searchsorted(ends, place, "right")
    first, end = np.r_[0, ends[:-1]][doc], ends[doc]
    gap = np.full(len(place), SPAN, np.int64)
    if len(place) > 1:
        gap[1:] = np.where(doc[1:] == doc[:-1], np.diff(place), SPAN)
    low = np.maximum(0, place + WINDOW - BEFORE - end)
    high = np.minimum(np.minimum(EXTRA, gap - 1), place - BEFORE - first)
    kept = (place >= begin) & (place < stop) & (low <= high)
    place, low, high = place[kept], low[kept], high[kept]
    here = place - at
    core, again = (common.mix(hashed(t, k, here - BEFORE, here + AFTER)) for k, t in enumerate((one, two)))
    whole = hashed(two, 1, here - BEFORE - high, here + WINDOW - BEFORE - low)
    context = common.mix(whole + common.mix((low * SPAN + high + 1).astype(np.uint64))) | np.uint64(1)
    return place, low, high, core, again, context


class Anchored:
    """The anchors of a shard, grouped by core and by context."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        found = [anchors(data, ends, c, min(c + CHUNK, len(data))) for c in range(0, len(data), CHUNK)] or [anchors(data, ends, 0, 0)]
        self.data = data
        self.place, self.low, self.high, self.core, self.again, self.context = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.context, self.core))
        core, context = self.core[order], self.context[order]
        new_core = np.r_[True, core[1:] != core[:-1]][: len(core)]
        new = new_core | np.r_[True, context[1:] != context[:-1]][: len(core)]
        firsts = np.flatnonzero(new)
        self.of_anchor = np.empty(len(order), np.int64)  # its context's number
        self.of_anchor[order] = np.cumsum(new) - 1
        self.one = order[firsts]  # an anchor of each context
        self.more = np.diff(np.r_[firsts, len(order)]) > 1
        self.of_context = np.cumsum(new_core)[firsts] - 1  # its core's number
        self.cores = core[new_core]
        self.contexts = np.bincount(self.of_context, minlength=len(self.cores))

    def keys(self) -> np.ndarray:
        """CORES, a row a core; context 0 where there are several."""
        out = np.zeros(len(self.cores), CORES)
        out["core"], out["n"] = self.cores, self.contexts
        out["context"][self.of_context] = self.context[self.one]
        out["context"][self.contexts > 1] = 0
        return out

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """CONTEXTS of the contexts of these numbers; left is read backwards."""
        at = self.one[chosen]
        out = np.zeros(len(at), CONTEXTS)
        out["core"], out["core2"], out["low"], out["high"], out["more"] = self.core[at], self.again[at], self.low[at], self.high[at], self.more[chosen]
        nth = np.arange(EXTRA)
        for name, places, length in (("left", self.place[at, None] - BEFORE - 1 - nth, self.high[at]), ("right", self.place[at, None] + AFTER + nth, EXTRA - self.low[at])):
            inside = nth < length[:, None]
            out[name][:, :EXTRA] = np.where(inside, self.data[np.where(inside, places, 0)], 0)
        return out


def bins_of(keys: np.ndarray, bins: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


def by_bin(kind: int, keys: np.ndarray, field: str, bins: int, shard: int) -> Iterator[dict]:
    """Rows of SENT for keys in order of the field."""
    own, firsts = np.unique(bins_of(keys[field], bins), return_index=True)
    for b, part in zip(own.tolist(), np.split(keys, firsts[1:]) if len(keys) else [], strict=True):
        yield {"kind": kind, "bin": b, "shard": shard, "keys": part.tobytes()}


def settle_cores(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """By row 0: no other core like it, 1: one context everywhere, 2: several, 3: very many. And how many contexts are open."""
    order = np.argsort(rows["core"], kind="stable")
    core = rows["core"][order]
    new = np.r_[True, core[1:] != core[:-1]]
    firsts = np.flatnonzero(new)
    context, n = rows["context"][order], rows["n"][order].astype(np.int64)
    least, most = np.minimum.reduceat(context, firsts), np.maximum.reduceat(context, firsts)
    total, shards = np.add.reduceat(n, firsts), np.diff(np.r_[firsts, len(core)])
    code = np.where(total > BIG, 3, np.where((least != most) | (least == 0), 2, np.where(shards > 1, 1, 0))).astype(np.uint8)
    out = np.empty(len(rows), np.uint8)
    out[order] = code[np.cumsum(new) - 1]
    return out, int(total[code == 2].sum())


def classes(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted array of byte rows within groups: the order, and how many bytes each row shares with the one before it (-1 where there is none in its group)."""
    words = rows.reshape(len(rows), SPAN).view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    ordered = rows[order]
    common_bytes = np.full(len(rows), -1, np.int64)
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    common_bytes[1:] = np.where(group[order][1:] == group[order][:-1], shared, -1)
    return order, common_bytes


def settle_contexts(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """By row of CONTEXTS the windows that repeat, a bit each."""
    out = np.zeros(len(rows), np.uint64)
    group = np.unique(rows[["core", "core2"]], return_inverse=True)[1]
    (by_left, left), (by_right, right) = (classes(group, np.ascontiguousarray(rows[c])) for c in ("left", "right"))
    left_class, right_class = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for u in range(SPAN):
        some = np.flatnonzero((rows["low"] <= u) & (rows["high"] >= u))
        left_class[by_left] = np.cumsum(left < u)
        right_class[by_right] = np.cumsum(right < EXTRA - u)
        pairs = left_class[some] * (len(rows) + 1) + right_class[some]
        order = np.argsort(pairs, kind="stable")
        same = pairs[order][1:] == pairs[order][:-1]
        again = np.r_[same, False] | np.r_[False, same] if len(some) else np.zeros(0, bool)
        out[some[order[again]]] |= np.uint64(1 << u)
    out[rows["more"] > 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out, 0


def windows_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of CONTEXTS: WINDOWS, distinct and in order, and whether each is there twice already; each window's row and bit, and its number among the distinct ones."""
    keys, owner, bit = [], [], []
    weights = [np.cumprod(np.full(SPAN, b, np.uint64)) for b in _BASES]
    left, right = ([np.cumsum(_LETTERS[rows[c]] * w, axis=1) for w in weights] for c in ("left", "right"))
    for u in range(SPAN):
        some = np.flatnonzero((rows["low"] <= u) & (rows["high"] >= u))
        out = np.zeros(len(some), WINDOWS)
        for k, (name, core) in enumerate((("a", "core"), ("b", "core2"))):
            parts = [x[k][some, n - 1] if n else np.zeros(len(some), np.uint64) for x, n in ((left, u), (right, EXTRA - u))]
            out[name] = common.mix(common.mix(common.mix(rows[core][some] + np.uint64(u)) + parts[0]) + parts[1])
        keys.append(out)
        owner.append(some)
        bit.append(np.full(len(some), u))
    distinct, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    owner, bit = np.concatenate(owner), np.concatenate(bit)
    twice = count > 1
    twice[number[rows["more"][owner] > 0]] = True
    return distinct, twice, np.c_[owner, bit], number


def settle_windows(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """By row of WINDOWS whether another shard has it."""
    return (np.unique(rows, return_counts=True)[1][np.unique(rows, return_inverse=True)[1]] > 1).astype(np.uint8), 0


SETTLE: dict[int, tuple[np.dtype, Callable]] = {DISTINCT: (CORES, settle_cores), MIXED: (CONTEXTS, settle_contexts), SPREAD: (WINDOWS, settle_windows)}


def settled(sent: DataFrame) -> DataFrame:
    """The keys of a bin from all shards together, and the answers for each shard."""
    kinds = common.arrow_schema(ANSWERED)

    def answers(kind: int, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        made, settle = SETTLE[kind]
        parts = [np.frombuffer(keys, made) for _, _, keys in held]
        found, open_ = settle(np.concatenate(parts))
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pa.RecordBatch.from_pydict(
            {
                "kind": [kind] * len(held), "bin": [b for b, _, _ in held], "shard": [s for _, s, _ in held],
                "answer": [x.tobytes() for x in np.split(found, cuts)], "open": [open_] + [0] * (len(held) - 1),
            },
            schema=kinds,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for kind, b, shard, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (kind, b) != now:
                    yield answers(now[0], held)
                    held = []
                now = kind, b
                held.append((b, shard, keys))
        if held:
            yield answers(now[0], held)

    return sent.repartition("kind", "bin").sortWithinPartitions("kind", "bin").mapInArrow(run, ANSWERED)


def packed(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """SHARDS of the texts."""
    kinds = common.arrow_schema(SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (size + len(text or b"") > shard_bytes or len(ids) >= SHARD_DOCS):
                    yield row(shard, ids, texts)
                    shard, ids, texts, size = shard + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
        if ids:
            yield row(shard, ids, texts)

    def row(shard: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        return pa.RecordBatch.from_pydict({"shard": [shard], "doc_ids": [ids], "ends": [ends], "bytes": [b"".join(texts)]}, schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, SHARDS)


def bucketed(shards: DataFrame, buckets: int) -> DataFrame:
    """The shards as a table of the shared folder, bucketed by shard: joins by shard leave them where they are."""
    spark = shards.sparkSession
    path, name = common.shared_path(spark, "shards"), f"sparkloom_shards_{uuid.uuid4().hex}"
    shards.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "shard").saveAsTable(name)
    common.drop_at_end(spark, path)
    return spark.table(name)


def read_row(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["bytes"], np.uint8), np.array(row["ends"], np.int64)


def mapped(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """make(row) for every row, one at a time, its rows in one batch."""
    kinds = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if rows := list(make(batch.slice(k, 1).to_pylist()[0])):
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.mapInArrow(run, schema)


def by_shard(answers: DataFrame, name: str) -> DataFrame:
    """The answers of each shard in order of their bins: as many bytes as the shard has keys, at most."""
    return answers.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("kind", "bin", "answer"))).alias(name))


def joined_answers(rows: list[dict] | None, kind: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(r["answer"] for r in rows or () if r["kind"] == kind), dtype)


def dedupe(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """One row a document: bytes, bytes removed, maximal removed runs, digest of the rest."""
    spark = docs.sparkSession
    common.ship(spark)
    # no fewer buckets than the other side of a join has partitions, or Spark would shuffle the shards instead
    buckets = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = bucketed(packed(docs, shard_bytes), buckets)
    total = shards.select(F.sum(F.element_at("ends", -1))).first()[0] or 0
    bins = max(1, total // BIN_BYTES)

    def cores(row: dict) -> Iterator[dict]:
        yield from by_bin(DISTINCT, Anchored(*read_row(row)).keys(), "core", bins, row["shard"])

    first = common.stored(settled(mapped(shards.select("shard", "ends", "bytes"), cores, SENT)), "cores")
    more_bins = max(1, (first.agg(F.sum("open")).first()[0] or 0) // BIN_CONTEXTS)
    known = shards.join(by_shard(first, "cores"), "shard", "left")

    def contexts(row: dict) -> Iterator[dict]:
        own = Anchored(*read_row(row))
        code = joined_answers(row["cores"], DISTINCT, np.uint8)[own.of_context]
        yield from by_bin(MIXED, own.rows(np.flatnonzero(code == 2)), "core", more_bins, row["shard"])
        if (code == 3).any():
            yield from by_bin(SPREAD, windows_of(own.rows(np.flatnonzero(code == 3)))[0], "a", bins, row["shard"])

    second = common.stored(settled(mapped(known.select("shard", "ends", "bytes", "cores"), contexts, SENT)), "contexts")

    def removed(row: dict) -> Iterator[dict]:
        data, ends = read_row(row)
        own = Anchored(data, ends)
        code = joined_answers(row["cores"], DISTINCT, np.uint8)[own.of_context]
        bits = np.where((code == 1) | own.more, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        bits[code == 2] |= joined_answers(row["contexts"], MIXED, np.uint64)
        if (code == 3).any():
            big = np.flatnonzero(code == 3)
            _, twice, where, number = windows_of(own.rows(big))
            again = (twice | (joined_answers(row["contexts"], SPREAD, np.uint8) > 0))[number]
            np.bitwise_or.at(bits, big[where[again, 0]], np.uint64(1) << where[again, 1].astype(np.uint64))
        yield from results(row["doc_ids"], data, ends, repeated_starts(own, bits))

    answers = by_shard(second, "contexts")
    return mapped(known.join(answers, "shard", "left").select("shard", "doc_ids", "ends", "bytes", "cores", "contexts"), removed, RESULT)


def repeated_starts(own: Anchored, bits: np.ndarray) -> np.ndarray:
    """Where the repeated windows of a shard begin."""
    bits = bits[own.of_anchor]
    some = np.flatnonzero(bits)
    flags = np.unpackbits(bits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
    u = np.arange(SPAN)
    which, at = np.nonzero(flags & (own.low[some, None] <= u) & (u <= own.high[some, None]))
    return own.place[some][which] - BEFORE - at


def results(doc_ids: list, data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> Iterator[dict]:
    edges = np.zeros(len(data) + 1, np.int32)
    edges[starts] = 1
    run = np.cumsum(edges)
    gone = run > 0
    gone[WINDOW:] = run[WINDOW:] > run[:-WINDOW]
    begin = 0
    for doc_id, end in zip(doc_ids, ends.tolist(), strict=True):
        own = gone[begin:end]
        n_removed = int(np.count_nonzero(own))
        text = data[begin:end]
        kept = text[~own] if n_removed else text
        spans = int(own[:1].sum() + np.count_nonzero(own[1:] > own[:-1])) if n_removed else 0
        yield {"doc_id": doc_id, "n_bytes": end - begin, "n_removed": n_removed, "n_spans": spans, "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest()}
        begin = end


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same rows by counting every string, for tests."""
    from collections import Counter

    texts = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(t[k : k + WINDOW] for _, t in texts for k in range(len(t) - WINDOW + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - WINDOW + 1):
            if count[t[k : k + WINDOW]] > 1:
                gone[k : k + WINDOW] = [True] * WINDOW
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
