"""Secret scans: fixed patterns, and an assignment-aware lexer for source and configuration text.

The lexer cuts a text into tokens once, from left to right, and walks over its operators. It reads name-literal pairs:
`name = "x"`, `name: x`, `"name": "x"`, `export NAME=x`, `name => x`, `<name>x</name>`, `name: type = "x"`,
`name["key"] = "x"`, names with dots and dashes, and literals with a prefix letter. A literal in quotes may stand on the
next line, an unquoted one too where it is indented and alone there. Literals joined by +, . or nothing are one value. A
value that has a value itself is a type or a name, and the literal belongs to all names before it. A bare identifier on the
right takes the literal that was assigned to it before in the text (constant propagation, through any number of steps),
and the span is then that literal's; one that no assignment explains is a literal itself unless it is called, subscripted
or names a type. A literal scores by its target name and its looks; it is reported from a score of MIN_SCORE.

Every step looks at a character a bounded number of times, so the time grows in proportion to the text, whatever it is.

Spans are code points, end exclusive: the whole match for patterns, the literal without quotes for the lexer.
Defined cases: null and empty texts have no spans; repeated rows get a row each; very long texts are scanned whole; other
columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The base patterns, and the least length of what they catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more: a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more, for the same reason
KINDS = ["assign", "access", "hex", "lexed"]
# Parts of names that hold secrets and their scores, of names that do not, and stand-in values.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "accesskey": 3, "privatekey": 3, "credential": 2, "auth": 1, "bearer": 2, "signingkey": 3, "encryptionkey": 3}
HARMLESS = ("url", "uri", "path", "file", "name", "policy", "length", "expiry", "expires", "type", "hint", "field", "regex", "pattern")
STAND_INS = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|nil|undefined|change_?me|example|placeholder|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")
#: Production parameter.
MIN_SCORE = 3

_HINT = re.compile(r"passw|passphrase|pwd|secret|token|api[_.-]?key|access[_.-]?key|private[_.-]?key|credential|auth|bearer|signing[_.-]?key|encryption[_.-]?key", re.ASCII | re.IGNORECASE)
#: Parts of which a text that the lexer or the first pattern may match has one at least, in lower case.
_HINT_PARTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
_ASSIGN_PARTS = ("passw", "secret", "token", "api")

# One token at each place, none of which can start again inside another: unfinished quotes and tags are single marks.
_TOKEN = re.compile(
    r"""<(?P<tag>[A-Za-z_][A-Za-z0-9_.\-]*+)>(?P<inner>[^<>\n]++)</(?P=tag)>"""
    r"""|(?P<string>"(?:[^"\\\n]++|\\(?:\r?\n|.))*+"|'(?:[^'\\\n]++|\\(?:\r?\n|.))*+'|`[^`\n]*+`)"""
    r"""|(?P<run>[A-Za-z0-9_+/.\-~!@^&*$%\#]++)"""
    r"""|(?P<skip>={2,}+>?|::++|://|[\x20\t\r]++|\\(?:\r?\n|.))"""
    r"""|(?P<op>:=|=>|=|:)"""
    r"""|(?P<line>(?:\n[\x20\t\r]*+)++)"""
    r"""|(?P<other>[^A-Za-z0-9_+/.\-~!@^&*$%\#"'`=:\s\\<]++|.)"""
)
_NAMES = ["inner", "string", "run", "skip", "op", "line", "other"]
_KINDS = {name: k for k, name in enumerate(_NAMES)}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
_NO_NAME = "+/~!@^&*$%#"
_ENDS_TYPE = frozenset(",;(){}")
#: Words that stand where a value would but name a type.
TYPES = frozenset("string integer boolean number object float double bytes unknown symbol optional varchar bytearray securestring".split())


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def name_score(name: str) -> int:
    """How far a target name suggests a secret; names that point elsewhere (a path, a policy) score 0."""
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    if any(flat.endswith(h) for h in HARMLESS):
        return 0
    return max((s for part, s in SENSITIVE.items() if part in flat), default=0)


def looks(value: str) -> int | None:
    """-1 to 2 by how far a value looks made by a machine; None for short ones and stand-ins, which are no secrets."""
    if len(value) < 6 or STAND_INS.match(value) or " " in value.strip():
        return None
    mixed, bits = any(c.isdigit() for c in value) and any(c.isalpha() for c in value), entropy(value)
    return (bits >= 3.0) + mixed - (not mixed and bits < 2.5)


def literal_score(name: str, value: str) -> int:
    """name_score and looks together; 0 where either says no."""
    base = name_score(name)
    return 0 if not base or (seen := looks(value)) is None else base + seen


Span = tuple[int, int]


class Lexer:
    """Walks over the tokens of one text; pairs holds (names, spans of one value) in order."""

    def __init__(self, text: str) -> None:
        self.text = text
        # Kinds and bounds of the tokens, in arrays: a token takes 17 bytes.
        self.kinds, self.starts, self.ends = bytearray(), array("q"), array("q")
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip" or text[m.start()] in "=:":
                self.kinds.append(_KINDS[m.lastgroup])
                self.starts.append(m.start())
                self.ends.append(m.end())
        self.known: dict[str, list[Span]] = {}
        self.pairs: list[tuple[list[str], list[Span]]] = []
        # An unquoted value that may turn out to be a type or a name: its names, span, token, and whether ':' led to it.
        self.held: tuple[list[str], Span, int, bool] | None = None
        self.walk()

    def kind(self, i: int) -> str:
        return _NAMES[self.kinds[i]] if 0 <= i < len(self.kinds) else ""

    def of(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]] if 0 <= i < len(self.kinds) else ""

    def emit(self, names: list[str], spans: list[Span]) -> None:
        spans = [s for s in spans if s[1] > s[0]]
        if names and spans:
            self.known |= dict.fromkeys(names, spans)
            self.pairs.append((names, spans))

    def settle(self) -> None:
        """The unquoted value held is one: a constant's name, a word, or another literal."""
        if self.held is None:
            return
        (names, (start, end), _, _), self.held = self.held, None
        after = self.text[end : end + 1]
        while end > start and self.text[end - 1] == ".":
            end -= 1
        value = self.text[start:end]
        plain = _IDENTIFIER.fullmatch(value)
        if plain and value in self.known:
            self.emit(names, self.known[value])
        elif plain and not any(c.isdigit() for c in value):
            if after not in ("(", "[") and value.lower() not in TYPES and value != re.split(r"[.\-]", names[0])[-1]:
                self.emit(names, [(start, end)])
        elif after not in ("(", "["):
            self.emit(names, [(start, end)])

    def key(self, i: int) -> tuple[str, int, int]:
        """What the operator i gives a value to: name, token, and where in the text the name starts; an empty name for nothing."""
        j = i - 1
        if self.kind(j) == "line" and self.of(i) in ("=", ":="):
            j -= 1
        if self.kind(j) == "string":
            return self.text[self.starts[j] + 1 : self.ends[j] - 1], j, self.starts[j]
        if self.kind(j) == "run":
            start, end = self.starts[j], self.ends[j]
            cut = max(self.text.rfind(c, start, end) for c in _NO_NAME)
            name = self.text[max(start, cut + 1) : end].lstrip("0123456789.-")
            return name, j, end - len(name)
        if self.of(j) == "]" and self.kind(j - 1) == "string" and self.of(j - 2) == "[" and self.kind(j - 3) == "run":
            return f"{self.of(j - 3)}.{self.of(j - 1)[1:-1]}", j, self.starts[j - 3]
        return "", -1, -1

    def string(self, i: int) -> int:
        """The token of the literal in quotes that starts at token i, perhaps with a prefix; -1 for none."""
        if self.kind(i) == "run" and self.kind(i + 1) == "string" and self.ends[i] - self.starts[i] <= 2 and self.ends[i] == self.starts[i + 1]:
            i += 1
        return i if self.kind(i) == "string" else -1

    def joined(self, i: int, inside: bool) -> tuple[list[Span], int]:
        """Spans of the literals joined from token i on, and the token after them. inside: within parentheses lines don't end it."""
        spans = []
        while True:
            spans.append((self.starts[i] + 1, self.ends[i] - 1))
            after = following = i + 1
            if self.of(following) in ("+", ".", ".."):
                following += 1
                following += self.kind(following) == "line"
            elif self.kind(following) == "line" and (inside or self.of(following + 1) in ("+", ".", "..")):
                following += 1
                following += self.of(following) in ("+", ".", "..")
            i = self.string(following)
            if i < 0 or self.kind(i + 1) == "op":
                return spans, after

    def walk(self) -> None:
        i = 0
        while i < len(self.kinds):
            kind = _NAMES[self.kinds[i]]
            if kind == "op":
                i = self.operator(i)
                continue
            if kind == "inner":
                self.settle()
                tag = self.of(i)[1:].split(">", 1)[0]
                self.emit([tag], [(self.starts[i] + len(tag) + 2, self.ends[i] - len(tag) - 3)])
            elif self.held is not None and i != self.held[2]:
                typed = self.held[3]
                if kind in ("line", "string") or not typed or (kind == "run" and self.kind(i - 1) == "run" and self.of(i - 1) not in ("mut", "const", "&mut", "unsigned")):
                    self.settle()
                elif kind == "other" and not _ENDS_TYPE.isdisjoint(self.of(i)):
                    self.settle()
            i += 1
        self.settle()

    def operator(self, i: int) -> int:
        """Reads the pair of the operator i; returns the token to go on with."""
        op, start, end = self.of(i), self.starts[i], self.ends[i]
        name, at, begins = self.key(i)
        names, value_from = [], None
        if self.held is not None:
            held_names, (a, b), token, typed = self.held
            if token == at and op == "=" and b == start and (self.kind(i + 1) in ("", "line") or self.starts[i + 1] == end and self.kind(i + 1) in ("other", "skip")):
                self.held = (held_names, (a, end), i, typed)  # the = that fills up base64
                return i + 1
            if token == at and begins > self.starts[at] and self.text[begins - 1] == "&" and begins - 1 > a and b > begins:
                self.held = (held_names, (a, begins - 1), token, typed)  # a query's next part
                self.settle()
            elif token == at or typed and op in ("=", ":="):
                names, self.held = held_names, None
                if op == "=" and b == start and not typed:
                    value_from = a
            else:
                self.settle()
        if name:
            names.append(name)
        if not names:
            return i + 1
        j = i + 1
        crossed = self.kind(j) == "line"
        j += crossed
        inside = self.of(j) == "("
        if (literal := self.string(j + inside + (inside and self.kind(j + 1) == "line"))) >= 0:
            spans, after = self.joined(literal, inside)
            if self.kind(literal + 1) == "op" and (crossed or self.of(literal + 1) == ":"):
                return literal + 1  # the literal is a key itself
            self.emit(names, spans)
            return after
        alone = crossed and op == ":" and self.text[self.ends[j - 1] - 1] in " \t" and self.kind(j + 1) in ("", "line")
        if self.kind(j) == "run" and (not crossed or alone):
            a, b = self.starts[j], self.ends[j]
            self.held = (names, (value_from if value_from is not None and a == end else a, b), j, op == ":")
            return j
        return j


def base_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by the fixed patterns."""
    lowered = text.lower() if lowered is None else lowered
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(p in lowered for p in _ASSIGN_PARTS) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)], key=lambda s: (s[0], s[2]))


def lexed_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, 3) of the literals that score enough. A joined value is scored as a whole, and its parts reported."""
    lowered = text.lower() if lowered is None else lowered
    if not any(p in lowered for p in _HINT_PARTS) or not any(c in text for c in ("=", ":", "</")) or not _HINT.search(text):
        return []
    by_name: dict[str, int] = {}
    by_value: dict[tuple[Span, ...], int | None] = {}
    found = set()
    for names, spans in Lexer(text).pairs:
        base = 0
        for name in names:
            if name not in by_name:
                by_name[name] = name_score(name)
            base = max(base, by_name[name])
        if not base:
            continue
        whole = tuple(spans)
        if whole not in by_value:
            by_value[whole] = looks("".join(text[a:b] for a, b in spans))
        if by_value[whole] is not None and base + by_value[whole] >= MIN_SCORE:
            found.update((a, b, 3) for a, b in spans)
    return sorted(found)


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans by the patterns and by the lexer."""
    lowered = (text or "").lower()
    return (base_spans(text, lowered), lexed_spans(text, lowered)) if text else ([], [])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCANNED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_lexed")]
    + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts by kind, digest of the base spans, all spans."""
    common.ship(docs.sparkSession)

    def make(batch):
        rows = []
        for text in batch.column(1).to_pylist():
            base, more = spans_of(text)
            kinds = Counter(k for _, _, k in base + more)
            every = written(sorted(base + more, key=lambda s: (s[0], s[2], s[1])))
            rows.append([*(kinds[k] for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), every])
        return {"doc_id": batch.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(SCANNED.fieldNames()[1:])}

    return common.map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCANNED)


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[at:a], by]
        end = at = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked and n_chars, where there is one, recounted; null texts stay null."""
    common.ship(docs.sparkSession)
    kinds = common.arrow_schema(docs.schema)
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), {}
            for i, text in enumerate(texts):
                if spans := sum(spans_of(text), []):
                    texts[i] = changed[i] = mask(text, spans)
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array(texts, kinds.field(at).type)
                if n_at >= 0:
                    counts = columns[n_at].to_pylist()
                    columns[n_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(counts)], kinds.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return docs.mapInArrow(run, docs.schema)


def _sql() -> str:
    """The base columns in DuckDB's SQL: where matches lie follows from the lengths of the pieces between them."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api"))) + "_?" + either("key")
    assign = rf"""({names})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, "len(m.g) >= 6"), ("access", "AKIA[A-Z0-9]+", "len(m.x) >= 20"), ("hex", "[0-9a-f]+", "len(m.x) >= 24")]
    found = " union all ".join(
        f"""select r, {k} as k, '{kind}' as kind, a, a + len(m.x) as z from (select r, m, sum(len(m.before)) over w + coalesce(sum(len(m.x)) over (w rows between unbounded preceding and 1 preceding), 0) as a
        from (select r, unnest(list_transform(range(1, len(xs) + 1), lambda i: struct_pack(i := i, x := xs[i], before := cuts[i], g := gs[i]))) as m
        from (select r, regexp_extract_all(t, '{p}') as xs, regexp_extract_all(t, '{p}', {2 if kind == 'assign' else 0}) as gs, string_split_regex(t, '{p}') as cuts from t)) window w as (partition by r order by m.i)) where {ok}"""
        for k, (kind, p, ok) in enumerate(kinds)
    )
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), s as ({found})
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256
from t left join (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
                         string_agg(kind || ':' || cast(a as bigint) || ':' || cast(z as bigint), ',' order by a, k) as base from s group by r) s using (r)
"""


#: Of the base columns of scan().
BASE_SQL = _sql()
BASE = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
