"""Quality rules: base counts of a text, and how far it diverges from its language.

Divergence: a text's histogram of character classes and its histogram of common words are compared with those of
its language by Jensen-Shannon distance (base 2, so 0 to 1). The reference of a language is the sum of both
histograms over all documents of that language which pass the base rules, where no source counts for more words than
the language's median source, less the documents that diverge from such a sum (PASSES times); '*' is the sum over all
languages and serves texts whose language is null, unlisted or seen in too few words. Guards: a text of fewer than MIN_WORDS
words is not judged by a histogram, nor one of a language without a reference of MIN_REFERENCE words by common words;
and a distance counts only beyond what a text of that length shows by chance. The query and the pipeline's stage judge by this one rule, and its SQL states it.

Words are runs of characters other than space and \\x09-\\x0D. Defined cases: null and empty texts have no words and
fail the base rules; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Frequent function words of each language.
COMMON_WORDS = {
    "de": "auf aus das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von werden zu".split(),
    "en": "a and are as at be by for from has he in is it of on or that the this to was were with you".split(),
    "es": "a al como con de del el en es esta la las lo los no para pero por que se su sus un una y".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les ne pas pour qui que sur un une par".split(),
}
#: Production parameters.
MIN_WORDS, MIN_REFERENCE, CLASS_EXCESS, WORD_EXCESS = 50, 2_000, 0.20, 0.10
BASE_WORDS, SYMBOLS = 50, b"#*$%&|<>"
#: Passes that leave divergent documents out of the references.
PASSES = 2
#: Of a common word that n draws give L times on average: its mean part of n times the squared distance is min(PART, L / 2), its variance
#: min(SPREAD, L / 4); PART and SPREAD are those of chi-squared over 8 ln 2. Fewer than 1 text of 100 exceeds the mean by DEVIATIONS standard deviations; for short ones the sum has a long tail.
PART, SPREAD, DEVIATIONS = 0.1803, 0.0650, 4.0
#: Character classes: blank, a-z, A-Z, 0-9, sentence marks, other marks, first bytes of other characters; 7: later bytes.
CLASSES = 7
_CLASS = np.array(
    [
        0 if b == 32 or 9 <= b <= 13 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57
        else 4 if b in b".,;:?'\"()-" else 5 if b < 128 else 7 if b < 192 else 6
        for b in range(256)
    ],
    np.uint8,
)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def repeated(hashes: np.ndarray, width: int = 3) -> int:
    """Words inside windows that occur twice or more."""
    n = len(hashes)
    if n <= width:
        return 0
    keys = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        keys += common.mix(hashes[k : n - width + 1 + k] + _MIX[k]) * _MIX[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks) > 0).sum())


class Measure:
    """Counts and histograms of texts; one for each task."""

    def __init__(self, common_words: dict[str, list[str]]) -> None:
        self.hashes = common.WordHashes()
        self.lists = {k: np.sort(common.WordHashes().of([w.encode() for w in sorted(set(v))])) for k, v in common_words.items()}

    def counts(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        words = raw.split()
        hashes = self.hashes.of(words)
        classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)[:CLASSES] if raw else np.zeros(CLASSES, np.int64)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n_symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
        return [len(words), int(classes[1:].sum()), n_symbols, len(lines) - len(set(lines)), repeated(hashes)], classes, hashes

    def words(self, hashes: np.ndarray, lang: str | None) -> np.ndarray | None:
        """Counts of the language's common words, then of all others."""
        listed = self.lists.get(lang)
        if listed is None:
            return None
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        own = listed[at] == hashes
        return np.r_[np.bincount(at[own], minlength=len(listed)), len(hashes) - own.sum()]


def base_failed(counts: list[int]) -> bool:
    return counts[0] < BASE_WORDS or 100 * counts[4] > 50 * counts[0]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2; 0 where either is empty."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0.0)))


_WIDTH = CLASSES + 1 + max(len(set(v)) for v in COMMON_WORDS.values())
MEASURED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("hist", T.ArrayType(T.LongType()))]
)


def measure(docs: DataFrame) -> DataFrame:
    """Per row: base counts, and one histogram row: character classes, then common words and the rest."""
    tool: list[Measure] = []

    def make(batch):
        return _measured(batch, tool, *range(4))

    origin = F.col("source") if "source" in docs.columns else F.lit(None)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), origin.cast("string"))
    return common.map_rows(source, make, MEASURED)


def _measured(batch: pa.RecordBatch, tool: list[Measure], *at: int) -> dict[str, object]:
    """The columns of MEASURED for a batch with doc_id, text, lang and source (-1: there is none) at these places."""
    if not tool:
        tool.append(Measure(COMMON_WORDS))
    doc_id, texts, langs, source = (batch.column(i) if i >= 0 else pa.nulls(batch.num_rows) for i in at)
    langs = langs.cast(pa.string()).to_pylist()
    rows, hists = [], []
    for text, lang in zip(texts.to_pylist(), langs, strict=True):
        counts, classes, hashes = tool[0].counts(text)
        words = tool[0].words(hashes, lang)
        hist = np.zeros(_WIDTH, np.int64)
        hist[:CLASSES] = classes
        if words is not None:
            hist[CLASSES : CLASSES + len(words)] = words
        rows.append(counts)
        hists.append(hist)
    out = {c: [r[i] for r in rows] for i, c in enumerate(COUNTS)}
    lang = [x if x in COMMON_WORDS else None for x in langs]
    return out | {"doc_id": doc_id.cast(pa.int64()), "lang": lang, "source": source.cast(pa.string()), "base_failed": [base_failed(r) for r in rows], "hist": common.lists(np.array(hists))}


def capped_references(measured: DataFrame) -> dict[str | None, np.ndarray]:
    """Histogram sums over all rows that pass the base rules, for each listed language; None: of all rows. No source counts for
    more words than the median source of its language, or MIN_REFERENCE if that is more. At most five rows are collected."""
    sums = [F.sum(F.col("hist")[i]).alias(f"h{i}") for i in range(_WIDTH)]
    by_source = common.stored(measured.where("not base_failed").groupBy("lang", "source").agg(F.sum("n_words").alias("n"), *sums), "sources")
    most = {r[0]: max(r[1], MIN_REFERENCE) for r in by_source.groupBy("lang").agg(F.percentile("n", F.lit(0.5))).collect()}
    cap = F.lit(float(most.get(None, MIN_REFERENCE)))
    for lang in most.keys() - {None}:
        cap = F.when(F.col("lang") == lang, F.lit(float(most[lang]))).otherwise(cap)
    share = F.least(F.lit(1.0), cap / F.col("n"))
    return _held(by_source.groupBy("lang").agg(*(F.sum(F.round(F.col(f"h{i}") * share).cast("long")) for i in range(_WIDTH))).collect())


def _held(rows: list) -> dict[str | None, np.ndarray]:
    held = {r[0]: np.array(r[1:], np.int64) for r in rows}
    whole = sum(held.values()) if held else np.zeros(_WIDTH, np.int64)
    return {k: v for k, v in held.items() if k is not None and v[CLASSES:].sum() >= MIN_REFERENCE} | {None: whole}


def distances(hist: np.ndarray, n_words: int, lang: str | None, held: dict[str | None, np.ndarray]) -> tuple[float, float]:
    """Distances of classes and of common words; 0 where a guard holds."""
    if n_words < MIN_WORDS:
        return 0.0, 0.0
    own = held.get(lang) if lang is not None else None
    classes = js_distance(hist[:CLASSES], (own if own is not None else held[None])[:CLASSES])
    return classes, 0.0 if own is None else js_distance(hist[CLASSES:], own[CLASSES:])


def class_limit(n_words: int) -> float:
    """The distance of classes that counts: the excess beyond what n words drawn from the reference itself would show."""
    return CLASS_EXCESS + float(np.sqrt((CLASSES - 1) / (8 * np.log(2) * n_words)))


def word_limit(reference: np.ndarray, n_words: int) -> float:
    """The distance of common words that counts. Squared, it is that of WORD_EXCESS and of what all but 1 of 100 texts drawn from
    the reference show; but a text with none of the words always counts. reference: common words, then a place for all
    others behind the last one that is used."""
    p = reference / reference.sum()
    drawn = n_words * p
    chance = np.minimum(PART, drawn / 2).sum() + DEVIATIONS * np.sqrt(np.minimum(SPREAD, drawn / 4).sum())
    rest = p[-1]
    none = (np.log2(2 / (1 + rest)) + (rest * np.log2(2 * rest / (1 + rest)) if rest > 0 else 0.0) + 1 - rest) / 2
    return float(min(np.sqrt(WORD_EXCESS**2 + chance / n_words), np.sqrt(none) - 1e-9))


def rejects(hist: np.ndarray, n_words: int, lang: str | None, held: dict[str | None, np.ndarray]) -> tuple[bool, float, float]:
    """Whether a text diverges, and its distances."""
    classes, words = distances(hist, n_words, lang, held)
    if n_words < MIN_WORDS:
        return False, classes, words
    far = classes > class_limit(n_words)
    if lang is not None and lang in held:
        size = len(set(COMMON_WORDS[lang])) + 1
        far = far or words > word_limit(held[lang][CLASSES : CLASSES + size], n_words)
    return bool(far), classes, words


def robust(measured: DataFrame) -> dict[str | None, np.ndarray]:
    """References that neither one source nor the documents to be found can draw to themselves."""
    held = capped_references(measured)
    for _ in range(PASSES):

        def stay(batches, held=held):
            for batch in batches:
                rows = zip(batch.column("hist").to_pylist(), batch.column("n_words").to_pylist(), batch.column("lang").to_pylist(), strict=True)
                yield batch.filter(pa.array([not rejects(np.array(h), n, lang, held)[0] for h, n, lang in rows], pa.bool_()))

        # A language of which too little stays keeps the reference it had.
        held = held | {k: v for k, v in capped_references(measured.where("not base_failed").mapInArrow(stay, measured.schema)).items() if v.sum()}
    return held


JUDGED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    + [T.StructField(c, T.DoubleType()) for c in ("class_distance", "word_distance")]
)


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base_failed, kept and both distances."""
    common.ship(docs.sparkSession)
    measured = common.stored(measure(docs), "measured")
    held = robust(measured)

    def make(batch):
        cols = {n: batch.column(n) for n in ("doc_id", *COUNTS, "base_failed")}
        far = [
            rejects(np.array(h), n, lang, held)
            for h, n, lang in zip(batch.column("hist").to_pylist(), cols["n_words"].to_pylist(), batch.column("lang").to_pylist(), strict=True)
        ]
        kept = [not failed and not d[0] for failed, d in zip(cols["base_failed"].to_pylist(), far, strict=True)]
        return cols | {"kept": kept, "class_distance": [d[1] for d in far], "word_distance": [d[2] for d in far]}

    return common.map_rows(measured, make, JUDGED)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, whole; columns doc_id and text are needed, lang and source where there are any.

    A text is measured once; the documents are stored with what was measured, and the decision is taken on that. Null and
    empty texts fail the base rules and go; without lang all texts are held against the sum over all languages; repeated rows
    stay or go together; other columns, also those named like what is measured, are kept.
    """
    common.ship(docs.sparkSession)
    kinds, inner = common.arrow_schema(docs.schema), common.arrow_schema(MEASURED)
    at = [docs.columns.index(c) if c in docs.columns else -1 for c in ("doc_id", "text", "lang", "source")]
    both = T.StructType([*docs.schema.fields, T.StructField("__measured", MEASURED)])
    both_kinds, tool = common.arrow_schema(both), []

    def weigh(batches):
        for batch in batches:
            if batch.num_rows:
                found = _measured(batch, tool, *at)
                columns = [c if isinstance(c := found[f.name], pa.Array) else pa.array(c, f.type) for f in inner]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, fields=list(inner))], schema=both_kinds)

    held_docs = common.stored(docs.mapInArrow(weigh, both), "weighed")
    held = robust(held_docs.select("__measured.*"))

    def decide(batches):
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            hist, n_words, lang, failed = (found.field(n).to_pylist() for n in ("hist", "n_words", "lang", "base_failed"))
            kept = [not f and not rejects(np.array(h), n, la, held)[0] for h, n, la, f in zip(hist, n_words, lang, failed, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=kinds).filter(pa.array(kept, pa.bool_()))

    return held_docs.mapInArrow(decide, docs.schema)


def _sql_pass(p: int) -> str:
    """References over the documents in s<p>, and by them the documents that stay."""
    kept = f"""
    union all select o.* from r{p - 1} o where not exists (select 1 from t{p} where t{p}.lang = o.lang) and (o.lang <> '*' or not exists (select 1 from w{p} where n > 0))""" if p else ""
    js = lambda kind, lang: f"""select x.doc_id, sqrt(greatest(sum(case when x.p > 0 then x.p * log2(2 * x.p / (x.p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (x.p + q)) else 0 end) / 2, 0)) as d
    from (select h.doc_id, h.n / sum(h.n) over (partition by h.doc_id) as p, r.n / sum(r.n) over (partition by h.doc_id) as q from h join m on m.doc_id = h.doc_id and n_words >= {MIN_WORDS} join r{p} r on r.kind = h.kind and r.k = h.k and r.lang = {lang} where h.kind = '{kind}') x group by x.doc_id"""  # noqa: E731
    own = f"case when m.lang in (select lang from r{p}) then m.lang else '*' end"
    return f"""o{p} as (select lang, source, sum(n_words) as n from m join s{p} using (doc_id) group by all),
q{p} as (select lang, greatest(quantile_cont(n, 0.5), {MIN_REFERENCE}) as cap from o{p} group by lang),
w{p} as materialized (select x.lang, x.kind, x.k, sum(round(x.n * least(1, cap / o.n))) as n from (select lang, source, kind, k, sum(h.n) as n from h join s{p} using (doc_id) join m using (doc_id) group by all) x
    join o{p} o on o.lang is not distinct from x.lang and o.source is not distinct from x.source join q{p} q on q.lang is not distinct from x.lang group by all),
t{p} as (select lang, sum(n) as n from w{p} where kind = 'w' and lang is not null group by lang having sum(n) >= {MIN_REFERENCE}),
r{p} as materialized (select w.lang, kind, k, w.n from w{p} w join t{p} t on t.lang = w.lang union all select '*', kind, k, sum(n) from w{p} where kind = 'c' group by kind, k having (select sum(n) from w{p}) > 0{kept}),
l{p} as (select m.doc_id, least(sqrt({WORD_EXCESS}**2 + (sum(least({PART}, n_words * p / 2)) + {DEVIATIONS} * sqrt(sum(least({SPREAD}, n_words * p / 4)))) / any_value(n_words)),
    sqrt((max(case when k = '' then log2(2 / (1 + p)) + case when p > 0 then p * log2(2 * p / (1 + p)) else 0 end + 1 - p end)) / 2) - 1e-9) as most
    from m join (select lang, k, n / sum(n) over (partition by lang) as p from r{p} where kind = 'w') r on r.lang = m.lang where n_words >= {MIN_WORDS} group by m.doc_id),
d{p} as materialized (select m.doc_id, coalesce(c.d, 0) as cd, coalesce(j.d, 0) as wj, coalesce(c.d > {CLASS_EXCESS} + sqrt({CLASSES - 1} / (8 * ln(2) * n_words)), false) or coalesce(j.d > most, false) as far
    from m left join ({js('c', own)}) c on c.doc_id = m.doc_id left join ({js('w', 'm.lang')}) j on j.doc_id = m.doc_id left join l{p} l on l.doc_id = m.doc_id),
s{p + 1} as (select s0.doc_id from s0 join d{p} d on d.doc_id = s0.doc_id where not far)"""


def _sql() -> str:
    """The same rows in DuckDB's SQL, written out from the parameters above."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = {k: sorted(set(v)) for k, v in COMMON_WORDS.items()}
    langs = ", ".join(map(quoted, listed))
    entries = ", ".join(f"({quoted(k)}, {quoted(w)})" for k, v in listed.items() for w in v)
    classes = {0: r"[\x20\x09-\x0D]", 1: "[a-z]", 2: "[A-Z]", 3: "[0-9]", 4: r"[.,;:?''\x22()-]", 6: r"[^\x00-\x7F]"}
    hist = [f"len(regexp_extract_all(t, '{p}'))" for p in classes.values()]
    ascii_rest = "length(t) - " + " - ".join(f"c{k}" for k in classes)
    passes = ",\n".join(_sql_pass(p) for p in range(PASSES + 1))
    return rf"""
with t as (select doc_id, case when lang in ({langs}) then lang end as lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from t),
dl as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from t),
g3 as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from g),
rw as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from g3 where n > 1) group by doc_id),
c as (select doc_id, lang, source, t, w, {', '.join(f'{h} as c{k}' for k, h in zip(classes, hist, strict=True))} from t),
b as (select c.doc_id, lang, source, w, c0, c1, c2, c3, c4, {ascii_rest} as c5, c6, len(w) as n_words, length(t) - c0 as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
      coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from c left join dl on dl.doc_id = c.doc_id left join rw on rw.doc_id = c.doc_id),
m as materialized (select *, n_words < {BASE_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from b),
cw(lang, word) as (values {entries}),
wd as (select m.doc_id, m.lang, x.word, count(*) as n from (select doc_id, unnest(w) as word from m where lang is not null) x join m on m.doc_id = x.doc_id join cw on cw.lang = m.lang and cw.word = x.word group by all),
h as materialized (select doc_id, 'c' as kind, cast(u.k as varchar) as k, u.n as n from (select doc_id, unnest([{', '.join(f'struct_pack(k := {k}, n := c{k})' for k in range(CLASSES))}]) as u from m)
    union all select m.doc_id, 'w', cw.word, coalesce(wd.n, 0) from m join cw on cw.lang = m.lang left join wd on wd.doc_id = m.doc_id and wd.word = cw.word
    union all select m.doc_id, 'w', '', n_words - coalesce((select sum(n) from wd where wd.doc_id = m.doc_id), 0) from m where m.lang is not null),
s0 as (select doc_id from m where not base_failed),
{passes}
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not far as kept, round(cd, 6) as class_distance, round(wj, 6) as word_distance from m join d{PASSES} d on d.doc_id = m.doc_id
"""


SQL = _sql()
