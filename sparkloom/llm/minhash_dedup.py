"""Near-duplicate classes by BagMinHash signatures, banding and exact verification of multiset overlap.

A document is the multiset of its five-word shingles over folded words (one shingle of all its words where it has
fewer than five). Two documents are linked when the weighted Jaccard similarity of these multisets is 0.8 or more;
classes are the connected components. Documents with equal word sequences are one node throughout, so a group of
exact copies costs one signature row whatever its size.

Signatures: weights are discretised to integers, and every shingle owns one Poisson process for each octave (0,1],
(1,2], (2,4], (4,8] ... of its weight. The first point of a process has a time, one of the m components and a place in
its interval; it counts for a document when the place lies below the shingle's weight there. What comes after that time
is split: the two halves of the interval are processes of their own, with seeds that follow from that of the whole, and
one that begins above the weight is dropped with all below it. So every document meets the same points, and only those
near its weight. The component keeps the earliest point. A process ends once its next point is later than the slowest
component. Equal components happen with probability equal to the weighted Jaccard similarity.

Defined cases: null, empty and wordless texts are each a class of their own (class_id = doc_id); repeated rows are
copies of each other; ties go to the smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameters. 20 bands of 4: a pair at similarity 0.8 is missed with probability 2.6e-5.
BANDS, ROWS, SHINGLE = 20, 4, 5
#: Similarity threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit shingle hashes, repeats kept; one shingle for fewer than width words, none for no words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += common.mix(hashes[k : n - width + 1 + k] + _MULTIPLIERS[k % 5]) * _MULTIPLIERS[(k + width) % 5]
    total = common.mix(total + np.uint64(width))
    total.sort()
    return total


def weights(sorted_shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their multiplicities."""
    starts = np.flatnonzero(np.r_[True, sorted_shingles[1:] != sorted_shingles[:-1]])
    return sorted_shingles[starts], np.diff(np.r_[starts, len(sorted_shingles)])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the multiset intersection of two (distinct, multiplicity) pairs."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def _draw(seed: np.ndarray, k: int, stream: int) -> np.ndarray:
    return common.mix(seed + np.uint64(int(_STEP) * (2 * k + stream + 1) & (2**64 - 1)))


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Signatures (documents x m, as bit patterns of times) of non-empty multisets."""
    sig = np.full((len(bags), m), np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    item, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    parts = [(doc, common.mix(item), np.ones(len(doc), np.int64), np.ones(len(doc), np.int64))]
    octave, base = 1, 1
    while (over := weight > base).any():
        doc, item, weight = doc[over], item[over], weight[over]
        parts.append((doc, common.mix(item + np.uint64(octave * int(_MULTIPLIERS[1]) & (2**64 - 1))), np.full(len(doc), base), np.minimum(weight - base, base)))
        octave, base = octave + 1, base * 2
    doc, seed, length, limit = (np.concatenate([p[i] for p in parts]) for i in range(4))
    time = np.zeros(len(doc))
    while len(doc):
        draw = _draw(seed, 0, 0)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (m * length)
        draw = _draw(seed, 0, 1)
        cell = (draw >> np.uint64(32)).astype(np.int64) & (length - 1)
        counts = cell < limit
        component = ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(sig.reshape(-1), (doc * m + component)[counts], time[counts])
        go = time < sig.max(axis=1)[doc]
        doc, seed, length, limit, time = doc[go], seed[go], length[go], limit[go], time[go]
        # An interval of length 1 goes on as it is; another gives way to its halves, the upper one only where the weight reaches it.
        half = np.maximum(length // 2, 1)
        upper = limit > half
        doc, time = np.concatenate([doc, doc[upper]]), np.concatenate([time, time[upper]])
        seed = np.concatenate([_draw(seed, 1, 0), _draw(seed[upper], 1, 1)])
        limit = np.concatenate([np.minimum(limit, half), (limit - half)[upper]])
        length = np.concatenate([half, half[upper]])
    return sig.view(np.uint64)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for r in range(rows):
        keys = common.mix(keys ^ (sig[:, r::rows][:, :bands] * _MULTIPLIERS[r % 5]))
    return keys.view(np.int64)


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ]
)


def node_of(words: list[bytes]) -> bytes | None:
    """128-bit identity of a word sequence; None without words."""
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, node (identity of its words), shingle count, band keys and its compressed words."""
    hashes = common.WordHashes()

    def make(batch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        words = [common.folded_words(t) for t in texts]
        bags = [shingles(hashes.of(w)) for w in words]
        full = [i for i, b in enumerate(bags) if len(b)]
        keys: list = [None] * len(bags)
        if full:
            made = band_keys(bag_minhash([weights(bags[i]) for i in full], bands * rows), bands, rows)
            for i, k in zip(full, made, strict=True):
                keys[i] = k
        pack = zstandard.ZstdCompressor(level=1)
        return {
            "doc_id": ids,
            "node": [node_of(w) for w in words],
            "n": [len(b) for b in bags],
            "bands": keys,
            "blob": [pack.compress(b" ".join(w)) if w else None for w in words],
        }

    return common.map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SIGNED)


def _close(a: str = "na", b: str = "nb"):
    """Necessary for similarity: the smaller multiset is large enough to overlap as needed."""
    small, total = F.least(F.col(a), F.col(b)), F.col(a) + F.col(b)
    return (NUMERATOR + DENOMINATOR) * small >= NUMERATOR * total


def elements(sorted_shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    if not len(sorted_shingles):
        return sorted_shingles
    starts = np.flatnonzero(np.r_[True, sorted_shingles[1:] != sorted_shingles[:-1]])
    nth = np.arange(len(sorted_shingles)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_shingles)]))
    out = common.mix(sorted_shingles + nth.astype(np.uint64) * _MULTIPLIERS[2])
    out.sort()
    return out


COMPARED = T.StructType(
    [
        T.StructField("a", T.BinaryType()),
        T.StructField("b", T.BinaryType()),
        T.StructField("nb", T.LongType()),
        T.StructField("inter", T.LongType()),
        T.StructField("linked", T.BooleanType()),
        T.StructField("rest", T.ArrayType(T.LongType())),
    ]
)


def _elements_of(blob: bytes, hashes: common.WordHashes) -> np.ndarray:
    return elements(shingles(hashes.of(zstandard.ZstdDecompressor().decompress(blob).split(b" "))))


#: About so many pairs of one leader are compared by one task; larger groups are split, each part with the leader's blob.
SPLIT = 256
#: Leaders of LOOK members or more: about SAMPLE of them are looked at for elements that several hold.
LOOK, SAMPLE, OFTEN = 32, 64, 6


def frequent(stars: DataFrame, blobs: DataFrame) -> DataFrame:
    """a, often, late: elements that OFTEN, and that 2 or more, of about SAMPLE members of a leader hold.

    They only speed up what follows: any choice is right.
    """
    shape = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("own", T.ArrayType(T.LongType()))])
    sizes = stars.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") >= LOOK)
    some = stars.select("a", "b").join(sizes, "a").where(F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / SAMPLE)) == 0)
    hashes = common.WordHashes()

    def make(batch):
        return {"a": batch.column(0), "own": [_elements_of(x, hashes).view(np.int64) for x in batch.column(1).to_pylist()]}

    held = common.map_rows(some.join(blobs.withColumnRenamed("node", "b"), "b").select("a", "blob"), make, shape)
    counts = held.select("a", F.explode("own").alias("e")).groupBy("a", "e").agg(F.count("*").alias("n")).where("n > 1")
    held = lambda c: F.collect_list(F.when(c, F.col("e")))
    return counts.groupBy("a").agg(held(F.col("n") >= OFTEN).alias("often"), held(F.col("n") < OFTEN).alias("late"))


def compare(pairs: DataFrame, blobs: DataFrame, around: DataFrame | None = None, least: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes: size of b, whether they are similar enough, and, given around (frequent), `inter` and `rest`.

    Let q be the elements of a and those that are frequent around it. inter: how many elements of b are in q. rest: of
    the others, those that several hold last, the first that must hold a common one with whatever is similar to b without
    owing it to q. A partner has at least m = max(0.8 |b|, least) elements, least being the smallest size among those led by a. It
    shares 4 (|b| + m) / 9 with b, at most `inter` of them in q; so it shares k = 4 (|b| + m) / 9 - inter outside, and one
    of the first |rest| - k + 1 (prefix filter). pairs is read twice, so it should be a stored table.
    """
    with_rest = around is not None
    hashes = common.WordHashes()

    def make(batch):
        kept, inter, size, linked, rest = {}, [], [], [], []
        a, b, blob_a, blob_b, often, late = (batch.column(i) for i in range(6))
        smallest = batch.column(6).to_pylist()
        for i, (x, blob_x, blob_y) in enumerate(zip(a.to_pylist(), blob_a.to_pylist(), blob_b.to_pylist(), strict=True)):
            if x not in kept:  # pairs of one leader mostly come together
                lists = [np.array(c[i].as_py() or [], np.int64).view(np.uint64) for c in (often, late)]
                kept = {x: (_elements_of(blob_x, hashes), *lists)}
            (ex, more, last), ey = kept[x], _elements_of(blob_y, hashes)
            outside = ey[~np.isin(ey, ex, assume_unique=True)]
            size.append(len(ey))
            linked.append((NUMERATOR + DENOMINATOR) * (len(ey) - len(outside)) >= NUMERATOR * (len(ex) + len(ey)))
            if with_rest:
                outside = outside[~np.isin(outside, more, assume_unique=True)]
                inter.append(len(ey) - len(outside))
                partner = max(-(-NUMERATOR * len(ey) // DENOMINATOR), smallest[i])
                k = -(-NUMERATOR * (len(ey) + partner) // (NUMERATOR + DENOMINATOR)) - inter[-1]
                held = np.isin(outside, last, assume_unique=True)
                outside = np.concatenate([outside[~held], outside[held]])
                rest.append(outside[: len(outside) - max(k, 1) + 1].view(np.int64))
        return {"a": a, "b": b, "nb": size, "linked": linked} | ({"inter": inter, "rest": rest} if with_rest else dict.fromkeys(("inter", "rest"), [None] * len(size)))

    left = blobs.select(F.col("node").alias("a"), F.col("blob").alias("blob_a"))
    nothing = {c: F.lit(None).cast("array<bigint>") for c in ("often", "late")} | {"least": F.lit(0).cast("long")}
    left = left.join(around, "a", "left").join(least, "a") if with_rest else left.withColumns(nothing)
    right = blobs.select(F.col("node").alias("b"), F.col("blob").alias("blob_b"))
    many = pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > SPLIT).select("a", F.ceil(F.col("m") / SPLIT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    pairs = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    left = left.join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = pairs.join(right, "b").join(left, ["a", "part"])
    return common.map_rows(both.select("a", "b", "blob_a", "blob_b", "often", "late", "least"), make, COMPARED)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: node, label (its smallest node), by min-label hooking and jumping."""
    both = common.stored(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).distinct(),
        "edges",
    )
    labels = common.stored(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = common.stored(
            hooked.join(up, "label", "left").select("node", F.coalesce(F.least("label", "upper"), "label").alias("label"), "was"), "labels"
        )
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels


def classes(signed: DataFrame) -> DataFrame:
    """node, label (its class), class_id (smallest doc_id of the class), class_size over signed rows that have words."""
    worded = signed.where(F.col("node").isNotNull())
    nodes = common.stored(
        worded.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.stored(rows.join(sizes, "key"), "buckets")
    # The leader of a bucket is its node that meets most others over all its buckets: the likely origin of its copies.
    central = shared.groupBy("node").agg(F.sum("size").alias("met"))
    leaders = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("lead"))
    shared = common.stored(shared.join(leaders, "key").select("key", "size", "node", "n", F.col("lead.node").alias("a"), F.col("lead.n").alias("na")), "led")
    # Blobs of the nodes that share a bucket, one row a node: copies are folded before anything is shuffled.
    copies = worded.groupBy("node").agg(F.first("blob").alias("blob"))
    blobs = common.stored(copies.join(shared.select("node").distinct(), "node", "left_semi"), "blobs")
    stars = shared.where(F.col("node") != F.col("a")).groupBy("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).agg(F.max("size").alias("size"))
    least = shared.groupBy("a").agg(F.min("n").alias("least"))
    stars = common.stored(stars.where(_close() | (F.col("size") > 2)).select("a", "b"), "pairs")
    stars = common.stored(compare(stars, blobs, frequent(stars, blobs), least), "stars")
    links = stars.where("linked").select("a", "b")
    labels = components(links)
    # What the leaders did not tell joins components, not nodes: a graph of their labels.
    missed = compare(common.stored(unled(shared, stars, labels), "unled"), blobs).where("linked").select("a", "b")
    label_of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    missed = missed.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    merged = components(missed.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b"))
    named = nodes.join(labels, "node", "left").select("node", "id", "copies", F.coalesce("label", "node").alias("label"))
    named = named.join(merged.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left").withColumn("label", F.coalesce("whole", "label")).drop("whole")
    sums = named.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    return named.join(sums, "label").select("node", "label", "class_id", "class_size")


def unled(shared: DataFrame, stars: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket, in different components so far, that may be similar; its leader's pairs are known.

    Both y and z have been compared with q, the leader's elements and the frequent ones around it. They overlap by at
    most min of what each has in q, and what they share outside it. So either they share an element of both `rest` lists, or z is so short
    that what they have in q is enough: 4 (|y| + |z|) <= 9 min(inter). No other pair of the bucket is looked at.
    """
    held = shared.where("size > 2").join(labels, "node", "left").select("key", "node", "a", F.coalesce("label", "node").alias("label"))
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    led = labels.select(F.col("node").alias("a"), F.col("label").alias("leads"))
    met = held.join(mixed.select("key"), "key", "left_semi").select("a", F.col("node").alias("b"), "label").distinct()
    met = met.join(led, "a", "left").withColumn("astray", F.col("label") != F.coalesce("leads", "a"))
    met = common.stored(met.join(stars, ["a", "b"]).select("a", "b", "label", "astray", "nb", "inter", "rest"), "mixed")
    side = lambda rows, s, *more: rows.select("a", F.col("b").alias(s), F.col("nb").alias(f"n_{s}"), F.col("label").alias(f"l_{s}"), F.col("inter").alias(f"o_{s}"), *more)
    apart = (F.col("l_y") != F.col("l_z")) & _close("n_y", "n_z")
    element = F.explode("rest").alias("e")
    by_rest = side(met.where("astray"), "y", element).join(side(met, "z", element, F.col("astray").alias("also")), ["a", "e"])
    by_rest = by_rest.where(apart & (~F.col("also") | (F.col("y") < F.col("z"))))
    # Lengths in steps of 2 %: y looks at those from 0.8 |y| to 9/4 inter - |y|, none for most.
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(1.02)))
    covered = met.where(DENOMINATOR * F.col("inter") >= NUMERATOR * F.col("nb"))
    longest = F.col("inter") * (NUMERATOR + DENOMINATOR) / NUMERATOR - F.col("nb")
    lengths = F.explode(F.sequence(step(F.col("nb") * NUMERATOR / DENOMINATOR) - 1, step(longest) + 1)).alias("step")
    short = side(covered.where("astray").where(longest >= F.col("nb") * NUMERATOR / DENOMINATOR), "y", lengths)
    by_length = short.join(side(covered, "z", step(F.col("nb")).alias("step")), ["a", "step"]).where(apart)
    by_length = by_length.where(NUMERATOR * (F.col("n_y") + F.col("n_z")) <= (NUMERATOR + DENOMINATOR) * F.least("o_y", "o_z"))
    both = by_rest.select("y", "z").unionByName(by_length.select("y", "z"))
    return both.select(F.least("y", "z").alias("a"), F.greatest("y", "z").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: doc_id, class_id, class_size, representative (it is the class's smallest doc_id)."""
    common.ship(docs.sparkSession)
    signed = common.stored(sign(docs, bands, rows), "signed")
    found = classes(signed)
    out = signed.select("doc_id", "node").join(found, "node", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select(
        "doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("representative"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each class the rows of its smallest doc_id stay, once."""
    common.ship(docs.sparkSession)
    signed = common.stored(sign(docs), "signed")
    found = classes(signed).withColumnsRenamed({"node": "__node", "label": "__label", "class_id": "__class", "class_size": "__size"})
    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.BinaryType())])
    names, at = docs.columns, docs.columns.index("text")

    def make(batch):
        out = {name: batch.column(i) for i, name in enumerate(names)}
        return out | {"__node": [node_of(common.folded_words(t)) for t in batch.column(at).to_pylist()]}

    # Wordless rows match no class and stay. The texts are shuffled once, or not at all where the classes are few.
    marked = common.map_rows(docs, make, schema).join(found, "__node", "left")
    kept = marked.where("__label is null or doc_id <=> __class")
    named = signed.select("doc_id", F.col("node").alias("__node")).join(found, "__node").where("doc_id <=> __class")
    if named.groupBy("__label").count().where("count > 1").isEmpty():
        return kept.select(names)
    # Only with repeated rows: several are of the class's smallest doc_id, and one of them stays.
    return kept.where("__label is not null").dropDuplicates(["__label"]).unionByName(kept.where("__label is null")).select(names)
