"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`, by prefix-doubling path ranking.

A conversation is a line of rows. A node is a place between rows together with what has been put out so far: nothing, a system turn,
a user turn that wants an answer, or an answer. Arcs are edits: Keep, Rerole and Delete pass a row, Insert passes none. The cost
dynamic program gives each node its cheapest way to the end; arcs on such ways are optimal. The grammar leaves one role open after
each node, so a node has at most one optimal arc of a letter, and equal letters from a node lead to equal nodes. So nodes can be ranked by the first
1, 2, 4, ... letters of their least audit: the rank of 2L letters is that of the pair of ranks of L letters, here and at the end of the
pointer over L steps. The ranks order the arcs of a node, the pointers doubled with them walk the least path.

Rows are dealt over tasks by ranges of conversation and turn, so a long conversation lies on many. A conversation inside
one task is finished there. Others are cut into pieces of PIECE rows: each gives the matrix of its cheapest ways between the four states, these are
composed backwards for the costs behind each piece; then all pieces find their paths side by side, and their ends are followed
forwards. Texts stay with their pieces; only the digest is taken in order. Rows that are equal in conversation, turn, role and text are
folded before anything is sorted, and whether a turn repeats an earlier one is told by the first turn of its role and text.

Defined cases: null roles and texts are one space; in the damage a null conv_id or turn is one space too; a null conv_id is a conversation; rows of a
turn are ordered by role, then text; an empty role has no legal initial; very long texts are hashed piece by piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows and characters of a piece of a conversation that one task can't finish alone.
PIECE, PIECE_CHARS = 65_536, 8_000_000
#: Costs of the edits and of a truncated row that stays.
RENAME, DELETE, INSERT, STAYS = 3, 4, 3, 3
#: Letters of an audit in the order of ties.
LETTERS = "DIKR"
NOTHING, SYSTEM, USER, ANSWER = range(4)
FAR = 1 << 50
#: A row as a byte: its role's initial, and flags.
INITIALS = {"s": 1, "u": 2, "a": 3}
MUST_GO, CUT = 4, 8
#: The state after a rename or an insertion, which the grammar leaves open in one way, and the role put out on the way there.
AFTER = (USER, USER, ANSWER, USER)
ROLES = ("user", "user", "assistant", "user")
#: By the state and the initial: the state after a kept row.
KEPT = {(NOTHING, 1): SYSTEM, (NOTHING, 2): USER, (SYSTEM, 2): USER, (ANSWER, 2): USER, (USER, 3): ANSWER}
#: Costs at the end of a conversation.
GOAL = (0, FAR, FAR, 0)
BLANK = "[^\\x20\\x09-\\x0D]"
CLOSED = "[.!?][\\x20\\x09-\\x0D]*\\z"
LEGAL = {(1, 2), (2, 3), (3, 2)}


def with_insertions(costs: list[int]) -> list[int]:
    """Costs of a place's nodes where insertions may come first; no cheapest way inserts three in a row."""
    nothing, system, user, answer = costs
    open_user = min(user, INSERT + answer)
    return [min(nothing, INSERT + open_user), min(system, INSERT + open_user), open_user, min(answer, INSERT + user)]


def passed(code: int, state: int, after: list[int]) -> tuple[int, int, int]:
    """Costs of deleting, keeping and renaming a row in a state, given the costs behind it."""
    if code & MUST_GO:
        return DELETE + after[state], FAR, FAR
    extra, kept = STAYS if code & CUT else 0, KEPT.get((state, code & 3))
    return DELETE + after[state], FAR if kept is None else extra + after[kept], RENAME + extra + after[AFTER[state]]


def costs(codes: bytes, end: list[int], last: bool) -> list[list[int]]:
    """By place and state the cost of the cheapest way on. end: that behind the rows; last: whether the conversation ends there."""
    out = [with_insertions(end) if last else list(end)]
    for code in reversed(codes):
        out.append(with_insertions([min(passed(code, s, out[-1])) for s in range(4)]))
    return out[::-1]


def arcs(codes: bytes, togo: list[list[int]], end: list[int], last: bool) -> np.ndarray:
    """The node that each node's optimal arc of each letter leads to, -1 where there is none. Node: 4 * place + state."""
    out = np.full((4 * len(togo), 4), -1, np.int64)
    for place, here in enumerate(togo):
        inside = place < len(codes)
        for state, cost in enumerate(here):
            node = 4 * place + state
            if inside:
                code, after = codes[place], togo[place + 1]
                deleted, kept, renamed = passed(code, state, after)
                if deleted == cost:
                    out[node, 0] = node + 4
                if kept == cost < FAR:
                    out[node, 2] = 4 * place + 4 + KEPT[state, code & 3]
                if renamed == cost:
                    out[node, 3] = 4 * place + 4 + AFTER[state]
            if (inside or last) and cost < FAR and INSERT + here[AFTER[state]] == cost:
                out[node, 1] = 4 * place + AFTER[state]
            if not inside and cost == end[state]:
                out[node] = -1
    return out


def least_paths(found: np.ndarray, starts: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The nodes on the way of the least audit from each start, and the ranks of all nodes by their least audits."""
    count = len(found)
    step = np.argmax(found >= 0, axis=1)  # the least letter; it has one arc
    end = (found < 0).all(axis=1)
    pointer = np.where(end, np.arange(count), found[np.arange(count), step])
    rank = np.where(end, 0, step + 1)
    paths = [np.array([s]) for s in starts]
    while True:
        paths = [np.r_[p, pointer[p]] for p in paths]
        rank, all_end, pointer = _dense(rank, rank[pointer]), end[pointer].all(), pointer[pointer]
        if all_end:
            return [p[: int(np.argmax(end[p])) + 1] for p in paths], rank


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def solve(codes: bytes, end: list[int], last: bool, entries: list[int]) -> list[tuple[str, int]]:
    """For each state before the rows: the least cheapest audit through them, and the state behind them."""
    found = arcs(codes, costs(codes, end, last), end, last)
    paths, ranks = least_paths(found, entries)
    out = []
    for path in paths:
        at, ahead = path[:-1], found[path[:-1]]
        keys = np.where(ahead >= 0, np.arange(4) * (len(ranks) + 1) + ranks[ahead], np.iinfo(np.int64).max)
        out.append(("".join(LETTERS[i] for i in np.argmin(keys, axis=1)) if len(at) else "", int(path[-1] % 4)))
    return out


@functools.lru_cache(maxsize=100_000)
def least_audit(codes: bytes) -> str:
    """The audit of a whole conversation. Short ones are remembered: few patterns of roles and faults make up most of them."""
    return solve(codes, list(GOAL), True, [NOTHING])[0][0]


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The rows put out, `role:text`."""
    out, row = [], 0
    for letter in audit:
        if letter in "IR":
            out.append(ROLES[state] + ":" + (texts[row] if letter == "R" else ""))
            state = AFTER[state]
        elif letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = KEPT[state, INITIALS[roles[row][0]]]
        row += letter != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, equal ones folded: conv_id, turn, role, text, copies. A row without role or copies stands for each conversation's dropped rows."""
    turn, role, text = F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20

    def kept(value: Column) -> Column:
        return F.when(kind != 0, value)

    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(
        "conv_id", kept(turn).alias("turn"), kept(F.when(kind == 4, "user").otherwise(role)).alias("role"), kept(changed).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text and copies with the code of their first copy."""
    order = F.struct(F.col("turn").isNotNull(), "turn")
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    first = keyed.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    a, b = keyed.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.role").eqNullSafe(F.col("b.role")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    blank = ~F.col("text").rlike(BLANK)
    again = F.col("b.first") != F.struct(F.col("a.turn").isNotNull(), F.col("a.turn"))
    initial = F.substring("a.role", 1, 1)
    code = F.lit(0)
    for letter, number in INITIALS.items():
        code = F.when(initial == letter, number).otherwise(code)
    return a.join(b, same).select(
        "a.conv_id", "a.turn", "a.role", "a.text", "a.copies", code.cast("int").alias("initial"), F.coalesce(blank, F.lit(False)).alias("blank"),
        again.alias("again"), (~F.col("text").rlike(CLOSED)).alias("cut"),
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Piece:
    """Rows of one conversation that follow each other."""

    def __init__(self) -> None:
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.n = dict.fromkeys(COUNTS, 0)
        self.turns = self.low = self.high = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, initial: int, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.codes and (self.codes[-1] & 3, initial) not in LEGAL:
            self.n["illegal"] += 1
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            self.n[fault] += 1
        self.codes.append(initial | (MUST_GO if blank or again else CUT if cut else 0))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def counts(self) -> dict[str, object]:
        return self.n | {"low": self.low, "high": self.high, "distinct": self.distinct}


def finished(conv_id: object, n: dict, audit: str, cost: int, digest: str) -> dict[str, object]:
    gaps = n["high"] - n["low"] + 1 - n["distinct"] if n["low"] is not None else 0
    return {"conv_id": conv_id, "gaps": gaps} | {c: n[c] for c in COUNTS} | {"cost": cost, "audit": audit, "repaired_sha256": digest}


def cost_of(audit: str, codes: bytes) -> int:
    row = total = 0
    for letter in audit:
        total += {"D": DELETE, "I": INSERT, "K": 0, "R": RENAME}[letter]
        if letter in "KR":
            total += STAYS if codes[row] & CUT else 0
        row += letter != "I"
    return total


def _results(kind: T.DataType) -> list[T.StructField]:
    return [T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in ("gaps", *COUNTS, "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]


STATE = [T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType())]
COUNTED = [T.StructField(c, T.LongType()) for c in ("low", "high", "distinct")]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batched(rows: Iterator[dict], kinds: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t) for t in row.get("texts") or ())
        if len(held) >= most or size >= PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kinds)


def pieces(rows: DataFrame, size: int) -> DataFrame:
    """Results of the conversations that lie inside a task and a piece; the pieces of the others, with their matrices, counts and rows."""
    schema = T.StructType(
        [
            *_results(rows.schema["conv_id"].dataType), *STATE, *COUNTED, T.StructField("codes", T.BinaryType()), T.StructField("ways", T.ArrayType(T.LongType())),
            T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )
    kinds = common.arrow_schema(schema)

    def split(conv_id: object, part: int, no: int, piece: Piece) -> dict:
        codes = bytes(piece.codes)
        ways = [costs(codes, [0 if s == t else FAR for s in range(4)], False)[0] for t in range(4)]
        return {"conv_id": conv_id, "part": part, "no": no, "codes": codes, "ways": sum(ways, []), "roles": piece.roles, "texts": piece.texts} | piece.counts()

    def alone(conv_id: object, piece: Piece) -> dict:
        codes = bytes(piece.codes)
        audit = least_audit(codes) if len(codes) <= 64 else least_audit.__wrapped__(codes)
        text = "\n".join(repaired(audit, NOTHING, piece.roles, piece.texts))
        return finished(conv_id, piece.counts(), audit, cost_of(audit, codes), hashlib.sha256(text.encode()).hexdigest())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, no, first, conv, piece, cut = TaskContext.get().partitionId(), 0, True, None, None, False
        for conv_id, turn, role, text, copies, initial, blank, again, short in rows_of(batches):
            if piece is None or conv_id != conv:
                if piece is not None:
                    if first or cut:  # the first conversation of a task may have begun in another
                        yield split(conv, part, no, piece)
                        no += 1
                    else:
                        yield alone(conv, piece)
                    first = False
                conv, piece, cut = conv_id, Piece(), False
            for copy in range(copies):
                if len(piece.codes) >= size or piece.chars > PIECE_CHARS:
                    yield split(conv, part, no, piece)
                    no, cut, piece = no + 1, True, Piece()
                piece.add(turn, role, text, initial, blank, again or copy > 0, short)
        if piece is not None:  # and the last one may go on
            yield split(conv, part, no, piece)

    names = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(lambda batches: batched(made(batches), kinds), schema)


def walked(df: DataFrame, make, schema: T.StructType, down: bool = False) -> DataFrame:
    """make(conversation, rows) over the pieces of each conversation in order, or the other way down."""
    kinds = common.arrow_schema(schema)
    order = [F.desc("part"), F.desc("no")] if down else ["part", "no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            held, begun, step = None, False, None
            for conv_id, *row in rows_of(batches):
                if not begun or conv_id != held:
                    if begun:
                        yield from step.close_rows()
                    held, begun, step = conv_id, True, make(conv_id)
                yield from step.add(*row)
            if begun:
                yield from step.close_rows()

        yield from batched(made(), kinds)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


class Behind:
    """Backwards over pieces: the costs behind each."""

    def __init__(self, conv_id: object) -> None:
        self.end, self.last = list(GOAL), True

    def add(self, part: int, no: int, ways: list[int]) -> Iterator[dict]:
        yield {"part": part, "no": no, "end": self.end, "last": self.last}
        behind = with_insertions(self.end) if self.last else self.end
        self.end = [min(FAR, *(ways[4 * t + s] + behind[t] for t in range(4))) for s in range(4)]
        self.last = False

    def close_rows(self) -> Iterator[dict]:
        return iter(())


class Entered:
    """Forwards over pieces: the state before each."""

    def __init__(self, conv_id: object) -> None:
        self.state = NOTHING

    def add(self, part: int, no: int, exits: list[int]) -> Iterator[dict]:
        yield {"part": part, "no": no, "state": self.state}
        self.state = exits[self.state]

    def close_rows(self) -> Iterator[dict]:
        return iter(())


class Joined:
    """Forwards over solved pieces: the conversation's result."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.audit, self.digest, self.some = conv_id, [], hashlib.sha256(), False
        self.n, self.initial, self.cost = dict.fromkeys((*COUNTS, "distinct"), 0) | {"low": None, "high": None}, None, 0

    def add(self, part, no, blank, duplicate, truncated, illegal, low, high, distinct, first, last, cost, audit, text) -> Iterator[dict]:
        n = self.n
        for c, v in zip((*COUNTS, "distinct"), (blank, duplicate, truncated, illegal, distinct), strict=True):
            n[c] += v
        if low is not None:
            n["distinct"] -= low == n["high"]
            n["low"], n["high"] = low if n["low"] is None else n["low"], high
        if first is not None:
            n["illegal"] += self.initial is not None and (self.initial, first) not in LEGAL
            self.initial = last
        self.cost += cost
        self.audit.append(audit)
        if text is not None:
            self.digest.update((("\n" if self.some else "") + text).encode())
            self.some = True
        return iter(())

    def close_rows(self) -> Iterator[dict]:
        yield finished(self.conv_id, self.n, "".join(self.audit), self.cost, self.digest.hexdigest())


def assembled(cut: DataFrame) -> DataFrame:
    """Results of the conversations in pieces."""
    longs = T.ArrayType(T.LongType())
    behind = walked(cut.select("conv_id", "part", "no", "ways"), Behind, T.StructType([*STATE, T.StructField("end", longs), T.StructField("last", T.BooleanType())]), down=True)
    known = common.stored(cut.select("conv_id", "part", "no", "codes").join(behind, ["part", "no"]), "behind")

    def exits(batch: pa.RecordBatch) -> dict:
        codes, ends, lasts = (batch.column(c).to_pylist() for c in ("codes", "end", "last"))
        found = [[s for _, s in solve(c, e, l, list(range(4)))] for c, e, l in zip(codes, ends, lasts, strict=True)]
        return {c: batch.column(c) for c in ("conv_id", "part", "no")} | {"exits": found}

    left = common.map_rows(known, exits, T.StructType([cut.schema["conv_id"], *STATE, T.StructField("exits", longs)]))
    entered = walked(left, Entered, T.StructType([*STATE, T.StructField("state", T.IntegerType())]))
    longs_of = [T.StructField(c, T.LongType()) for c in (*COUNTS, "low", "high", "distinct", "first", "final", "cost")]
    solved = T.StructType([cut.schema["conv_id"], *STATE, *longs_of, T.StructField("audit", T.StringType()), T.StructField("text", T.StringType())])
    whole = cut.join(known.select("part", "no", "end", "last"), ["part", "no"]).join(entered, ["part", "no"])

    def paths(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in ("conv_id", "part", "no", *COUNTS, "low", "high", "distinct")} | {c: [] for c in ("first", "final", "cost", "audit", "text")}
        for codes, end, last, state, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("codes", "end", "last", "state", "roles", "texts")), strict=True):
            ((audit, _),) = solve(codes, end, last, [state])
            rows = repaired(audit, state, roles, texts)
            out["first"].append(codes[0] & 3 if codes else None)
            out["final"].append(codes[-1] & 3 if codes else None)
            out["cost"].append(cost_of(audit, codes))
            out["audit"].append(audit)
            out["text"].append("\n".join(rows) if rows else None)
        return out

    return walked(common.map_rows(whole, paths, solved), Joined, T.StructType(_results(cut.schema["conv_id"].dataType)))


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row a conversation: its faults, the cost and the audit of its repair, the digest of the repaired rows. rows: as damaged() gives them."""
    common.ship(rows.sparkSession)
    found = common.stored(pieces(judged(rows), piece), "repair")
    names = [f.name for f in _results(T.LongType())]
    return found.where(F.col("part").isNull()).select(names).unionByName(assembled(found.where(F.col("part").isNotNull())))


def repair_damaged(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    return repair(damaged(conversations), piece)


def brute_force(conversations: list[tuple]) -> list[tuple]:
    """The same rows for (conv_id, turn, role, text), trying the edits in turn with their audits as text, for tests."""
    import re

    space, held = lambda v: " " if v is None else v, {}
    for conv, turn, role, text in conversations:
        kind, own = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, held.setdefault(conv, [])
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            marks = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", ())}  # the last initial put out: the least cost, audit and rows

        def wider(states):
            for _ in range(2):
                for state, (c, audit, put) in list(states.items()):
                    role = "assistant" if state == "u" else "user"
                    new = (c + 3, audit + "I", (*put, role + ":"))
                    states[role[0]] = min(states.get(role[0], new), new)
            return states

        for (_, _, role, text), fault in zip(rows, faults, strict=True):
            ahead = {}

            def reach(state, new, ahead=ahead):
                ahead[state] = min(ahead.get(state, new), new)

            for state, (c, audit, put) in wider(dict(best)).items():
                reach(state, (c + 4, audit + "D", put))
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                    if role and role[0] in legal:
                        reach(role[0], (c + extra, audit + "K", (*put, f"{role}:{text}")))
                    other = "assistant" if state == "u" else "user"
                    reach(other[0], (c + 3 + extra, audit + "R", (*put, f"{other}:{text}")))
            best = ahead
        cost, audit, put = min(v for s, v in wider(dict(best)).items() if s in ("", "a"))
        turns = [t for known, t, _, _ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(put).encode()).hexdigest()))
    return out


def _sql() -> str:
    """The same rows in DuckDB's SQL: by state the cost, audit and repaired rows of the cheapest way on, as one text whose order is theirs, from the last row to the first."""
    rest = lambda k: f"substr({k}, strpos({k}, chr(1)) + 1)"

    def onwards(k: str, cost: str, letter: str, row: str | None = None) -> str:
        put = rest(k) if row is None else f"{row} || case when {rest(k)} = '' then '' else chr(10) || {rest(k)} end"
        return f"lpad(cast(cast(substr({k}, 1, 12) as bigint) + {cost} as varchar), 12, '0') || '{letter}' || substr({k}, 13, strpos({k}, chr(1)) - 12) || {put}"

    none = "lpad('500000000000', 12, '0') || chr(1)"
    insert = lambda k, role: onwards(k, str(INSERT), "I", f"'{role}:'")
    user, answer = "'user:' || text", "'assistant:' || text"

    def row_arcs(state: str, kept: str, after: str, renamed: str) -> str:
        return f"least({onwards(state, str(DELETE), 'D')}, case when must then {none} else least({kept}, {onwards(after, f'{RENAME} + extra', 'R', renamed)}) end)"

    keep = lambda initial, k: f"case when s = '{initial}' then {onwards(k, 'extra', 'K', 'role || chr(58) || text')} else {none} end"
    closed = f"""select conv_id, i, least(n, {insert('u2', 'user')}) as n, least(y, {insert('u2', 'user')}) as y, u2 as u, least(a, {insert('u', 'user')}) as a
        from (select *, least(u, {insert('a', 'assistant')}) as u2 from"""
    bits = "list_reduce(list_prepend(xor(c, b), list_value(1, 2, 3, 4, 5, 6, 7, 8)::bigint[]), lambda x, k: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({key}, ''), lambda x: ascii(x)::bigint)), lambda c, b: {bits}), 4294967295::bigint)"
    return f"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as kind from conversations),
d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from c),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
f as (select *, substr(role, 1, 1) as s, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
        not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut, lag(substr(role, 1, 1)) over (partition by conv_id order by i) || substr(role, 1, 1) as pair from o),
r as (select *, blank or again as must, case when cut then {STAYS} else 0 end as extra from f),
dp as ({closed} (select conv_id, max(i) as i, repeat('0', 12) || chr(1) as n, {none} as y, {none} as u, repeat('0', 12) || chr(1) as a from r group by conv_id))
    union all
    {closed} (select r.conv_id, r.i - 1 as i, {row_arcs('n', f"least({keep('s', 'y')}, {keep('u', 'u')})", 'u', user)} as n, {row_arcs('y', keep('u', 'u'), 'u', user)} as y,
        {row_arcs('u', keep('a', 'a'), 'a', answer)} as u, {row_arcs('a', keep('u', 'u'), 'u', user)} as a from dp join r on r.i = dp.i and r.conv_id is not distinct from dp.conv_id))),
t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
        count(*) filter (cut and not again and not blank) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select p.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(cast(substr(n, 1, 12) as bigint), 0) as cost, coalesce(substr(n, 13, strpos(n, chr(1)) - 13), '') as audit, sha256(coalesce({rest('n')}, '')) as repaired_sha256
from (select distinct conv_id from conversations) p left join t on t.conv_id is not distinct from p.conv_id left join (select * from dp where i = 0) e on e.conv_id is not distinct from p.conv_id
"""


SQL = _sql()
