"""Best-fit packing of token sequences by bin completion.

Documents are encoded, each ends with id 0. One longer than the capacity is cut into full pieces, of which the first
takes the remainder. Piece lengths are at most the capacity, so the whole corpus is summed up by a histogram of that
many rows; the plan is made on that histogram and its size does not grow with the input. Bin completion: around the
largest length left, undominated fillings of the room beside it are enumerated, fullest first, and applied once or as
often as the histogram allows; a branch is left when its waste or lower bound exceeds what a better solution than the incumbent
may have. Incumbents are best fit decreasing and the way down that always takes the fullest filling of the longest pieces. Pieces take their places in the plan by their rank among
pieces of equal length, which comes from counts of each partition and so needs no global sort.

Defined cases: null texts are empty; an empty text is one piece, id 0; repeated rows are packed each; no documents
give no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameters.
CAPACITY, NODES, WIDTH = 2048, 2_000, 32


class Encoder:
    """Token ids as the tokenizer file gives them without added special tokens.

    The byte-level vocabulary and its merge ranks are read from the tokenizer's own JSON; tiktoken applies them about
    four times as fast as tokenizers does, with equal ids (tested). Where it can't take a text, tokenizers does.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.path, self.slow = path, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except BaseException as e:  # its panics aren't Exceptions
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if self.split is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = [np.array([self.special[p]], np.uint32) if p in self.special else self.plain(p) for p in self.split.split(text) if p]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    rest = n % capacity if n > capacity else n
    edges = [0, *range(rest or capacity, n + 1, capacity)]
    return list(zip(edges[:-1], np.diff(edges).tolist(), strict=True))


PIECES = T.StructType(
    [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("place", T.LongType()))]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their partition and their place among its pieces of equal length."""
    kinds = common.arrow_schema(PIECES)

    def run(batches):
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(encode.ids(text or ""), np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(PIECES.fieldNames(), zip(*rows, strict=True), strict=True)), schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _reach(room: int, sizes: list[int], counts: list[int], early: bool) -> list[int]:
    """For each number of leading sizes, the sums up to the room that they allow, as bits. early: no further than the room itself."""
    mask, full = (1 << (room + 1)) - 1, 1 << room
    sums, out = 1, [1]
    for size, count in zip(sizes, counts, strict=True):
        count, step = min(count, room // size), 1
        while count > 0:
            take = min(step, count)
            sums |= (sums << (size * take)) & mask
            count, step = count - take, 2 * step
        out.append(sums)
        if early and sums & full:
            break
    return out


def _sizes(room: int, left: np.ndarray) -> tuple[list[int], list[int]]:
    sizes = np.flatnonzero(left[: room + 1])[::-1]
    return sizes.tolist(), left[sizes].tolist()


def fullest(room: int, left: np.ndarray) -> tuple[int, ...]:
    """A filling of the largest sum whose smallest piece is as large as can be: short pieces, which fit anywhere, are kept for last."""
    sizes, counts = _sizes(room, left)
    reach = _reach(room, sizes, counts, True)
    rest, i, out = reach[-1].bit_length() - 1, len(reach) - 1, []
    while rest:
        while reach[i - 1] >> rest & 1:
            i -= 1
        size = sizes[i - 1]
        while not reach[i - 1] >> rest & 1:
            out.append(size)
            rest -= size
        i -= 1
    return tuple(out)


def dominated(by: tuple[int, ...], filling: tuple[int, ...]) -> bool:
    """Whether the pieces of a filling go into those of another, several into one: then the other is never worse (Martello and Toth)."""
    if sum(filling) > sum(by) or len(filling) > 8:
        return False

    def place(k: int, rooms: tuple[int, ...]) -> bool:
        return k == len(filling) or any(r >= filling[k] and place(k + 1, (*rooms[:j], r - filling[k], *rooms[j + 1 :])) for j, r in enumerate(rooms) if r not in rooms[:j])

    return place(0, by)


def fillings(room: int, left: np.ndarray, width: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of the room from the lengths left (counts by length), fullest first, and whether more than `width` were met."""
    if room <= 0 or not left[: room + 1].any():
        return [()], False
    if left[room]:
        return [(room,)], False  # one piece that takes all the room dominates any other filling
    sizes, counts = _sizes(room, left)
    sizes, counts = sizes[::-1], counts[::-1]  # from the shortest, so that each walk takes the longest first
    reach = _reach(room, sizes, counts, False)
    out: list[tuple[int, ...]] = []
    sums = reach[-1]
    while sums > 1:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        walk: list[tuple[int, int, tuple[int, ...]]] = [(len(sizes), total, ())]
        while walk:
            i, rest, made = walk.pop()
            if not rest:
                used = dict.fromkeys(made, 0)
                for x in made:
                    used[x] += 1
                shortest = next((x for x, n in zip(sizes, counts, strict=True) if n > used.get(x, 0)), room + 1)
                if shortest > room - total and not any(dominated(f, made) for f in out):
                    if len(out) == width:
                        return out, True
                    out.append(made)
                continue
            while i and not (sizes[i - 1] <= rest and reach[i] >> rest & 1):
                if not reach[i] >> rest & 1:
                    i = 0
                    break
                i -= 1
            if i:
                size = sizes[i - 1]
                walk += [(i - 1, rest - m * size, (*made, *(size,) * m)) for m in range(min(counts[i - 1], rest // size) + 1) if reach[i - 1] >> (rest - m * size) & 1]
    return out, False


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over all thresholds."""
    size = np.arange(capacity + 1)
    total, mass = np.cumsum(left), np.cumsum(size * left)
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    big, middle = total[capacity] - total[capacity - k], total[capacity - k] - total[half]
    spare = middle * capacity - (mass[capacity - k] - mass[half])
    small = mass[half] - np.where(k > 0, mass[k - 1], 0)
    return int(max(-(-mass[-1] // capacity), (big + middle + np.maximum(0, -(-(small - spare) // capacity))).max()))


def _apply(pattern: tuple[int, ...], left: np.ndarray, times: int | None = None) -> int:
    """Takes the pattern from the counts, as often as they allow unless told how often."""
    sizes, many = np.unique(pattern, return_counts=True)
    times = int((left[sizes] // many).min()) if times is None else times
    left[sizes] -= times * many
    return times


Plan = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(left: np.ndarray, capacity: int) -> Plan:
    """Each largest length left, topped up greedily with the largest that fits: the first incumbent."""
    left, plan = left.copy(), []
    while len(sizes := np.flatnonzero(left)):
        spare, pattern = left.copy(), [int(sizes[-1])]
        spare[pattern[0]] -= 1
        room = capacity - pattern[0]
        while room > 0 and len(fit := np.flatnonzero(spare[: room + 1])):
            pattern.append(int(fit[-1]))
            spare[fit[-1]] -= 1
            room -= int(fit[-1])
        plan.append((tuple(pattern), _apply(tuple(pattern), left)))
    return plan


def fullest_decreasing(left: np.ndarray, capacity: int) -> Plan:
    """Around each largest length left, the fullest filling, as often as the counts allow: the first way down the search, and an incumbent."""
    left, plan = left.copy(), []
    while len(sizes := np.flatnonzero(left)):
        size = int(sizes[-1])
        left[size] -= 1
        pattern = (size, *fullest(capacity - size, left))
        left[size] += 1
        plan.append((pattern, _apply(pattern, left)))
    return plan


def make_plan(left: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> tuple[Plan, bool]:
    """(lengths of a sequence, how often) covering the histogram, and whether no plan of fewer sequences exists.

    left: counts by length, index 0 unused. Depth first: a node takes a filling around the largest length left, first as
    often as the counts allow, then once, so that every number of times can be reached; it is left when its waste is more
    than a plan of fewer sequences than the incumbent's may have, or by the lower bound of what it leaves over. The
    search ends at the lower bound, or after `nodes` nodes; no branch is dropped otherwise but fillings beyond `width`.
    """
    total, bound = int((np.arange(capacity + 1) * left).sum()), lower_bound(left, capacity)
    used = lambda plan: sum(t for _, t in plan)
    incumbent = min((best_fit_decreasing(left, capacity), fullest_decreasing(left, capacity)), key=used)
    count, cut, now, path = used(incumbent), False, left.copy(), []

    def choices() -> list[tuple[tuple[int, ...], int]]:
        nonlocal cut
        size = int(np.flatnonzero(now)[-1])
        now[size] -= 1
        found, more = fillings(capacity - size, now, width)
        now[size] += 1
        cut |= more
        out = []
        for pattern in ((size, *f) for f in found):
            sizes, many = np.unique(pattern, return_counts=True)
            most = int((now[sizes] // many).min())
            out += [(pattern, t) for t in ((most, 1) if most > 1 else (1,))]
        return out[::-1]

    # A level of the walk: the choices not tried yet, and what was taken to come to it with its waste.
    levels: list[tuple[list, tuple[int, ...], int, int, int]] = [(choices() if left.any() else [], (), 0, 0, 0)]
    while levels and count > bound:
        todo, _, _, waste, taken = levels[-1]
        if not todo:
            _, pattern, times, _, _ = levels.pop()
            if times:
                _apply(pattern, now, -times)
                path.pop()
            continue
        if nodes <= 0:
            return incumbent, False
        nodes -= 1
        pattern, times = todo.pop()
        wasted, made = waste + times * (capacity - sum(pattern)), taken + times
        _apply(pattern, now, times)
        path.append((pattern, times))
        if not now.any():
            if made < count:
                incumbent, count = list(path), made
            further = []
        elif wasted > (count - 1) * capacity - total or made + lower_bound(now, capacity) >= count:
            further = []
        else:
            further = choices()
        levels.append((further, pattern, times, wasted, made))
    return incumbent, count <= bound or not cut


PACKED = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece with its sequence and its offset there."""
    common.ship(docs.sparkSession)
    held = common.stored(pieces(docs, tokenizer, capacity), "pieces")
    parts = common.stored(held.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        left[length] = n
    # By length and rank: where each stretch of equal slots begins, its first sequence and its offset.
    taken, stretches, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, times in make_plan(left, capacity)[0]:
        offset = 0
        for size in pattern:
            stretches.append((size, int(taken[size]), sequence, offset))
            taken[size] += times
            offset += size
        sequence += times
    stretches.sort()
    slots = np.array(stretches, np.int64).reshape(-1, 4)
    keys = slots[:, 0] * (1 << 40) + slots[:, 1]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = held.join(parts.select("length", "part", before.alias("before")), ["length", "part"])

    def make(batch):
        out = {n: batch.column(n) for n in PACKED.fieldNames()[:5]}
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        length = out["length"].to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
        return out | {"sequence_id": pa.array(slots[at, 2] + rank - slots[at, 1]), "offset": pa.array(slots[at, 3])}

    return common.map_rows(ranked.select(*PACKED.fieldNames()[:5], (F.col("before") + F.col("place")).alias("rank")), make, PACKED)
