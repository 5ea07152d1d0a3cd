"""Queries of the preprocessor over programs that both engines derive from the tables: an event is a line of its user's program, a nation a copybook."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocess
from ..sources import tables

LINES = [
    "    MOVE X-1 TO Y-2.",
    "    EXEC SQL SELECT A INTO :B",
    "      FROM T WHERE C = '(.' AND X-1 = 1",
    "    END-EXEC.",
    "    REPLACE ==X-1== BY ==Z-9 (1)== ==TO== BY ==INTO==.",
    "    REPLACE OFF.",
    "    EJECT",
    "    SKIP2.",
    "    TITLE 'PAGE, ONE'.",
    "CBL LIST,MAP",
    " AUTHOR. SOME BODY",
    "        WORKS HERE",
    "* A NOTE ON X-1",
    "*>CE AN ENTRY",
    "",
    "    COPY NATION_3 REPLACING ==A== BY B , ==DISPLAY B== BY ====.",
    "    EXEC SQL INCLUDE NATION_4 END-EXEC. DISPLAY X-1",
    "    EXEC CICS LINK PROGRAM('P')",
    "    REPLACE ==INTO",
    "      y-2== BY",
    "      ==OUT== .",
    "    DISPLAY 'X-1' \"TO\" X-1 TO, Y-2.",
    "    MOVE X-1",
    "      TO Y-2 IN X-11.",
    "    COPY NOWHERE.",
    " PARA-1.",
]


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def lines(spark, sf):
    events = tables.read(spark, sf, "events")
    at = (F.col("event_id") * F.col("event_id") + 11 * F.col("user_id")) % len(LINES)
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.get(F.array(*map(F.lit, LINES)), at.cast("int")).alias("line"))


def books(spark, sf):
    body = F.format_string("MOVE A TO R-%d.\n\n  DISPLAY A (%d) 'A'.", "n_regionkey", "n_nationkey")
    return tables.read(spark, sf, "nation").select(F.col("n_name").alias("name"), body.alias("content"))


def preprocessed_lines(spark, sf):
    return preprocess.preprocessed(lines(spark, sf), books(spark, sf))


def replace_scope_ends(spark, sf):
    """The scopes of the REPLACE statements alone."""
    rows = preprocess.classified(preprocess.tokens(lines(spark, sf))).where("kind = 'REPLACE'")
    return preprocess.scopes(preprocess.statements(rows)).select("doc_id", "nth", F.col("level").cast("long"), "last")


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(preprocess.TOKEN)})"


_PARTS = "|".join(preprocess.COMMENT_PARAGRAPHS)
_SO_FAR = "partition by doc_id order by line_no, place rows between unbounded preceding and current row"
_BY = "partition by doc_id order by line_no, place"
_SOURCE = f"""s as (select user_id as doc_id, event_id as line_no, list_value({', '.join(map(quoted, LINES))})[cast((event_id * event_id + 11 * user_id) % {len(LINES)} + 1 as int)] as line from events),
b as (select n_name as book, 'MOVE A TO R-' || n_regionkey || '.' || chr(10) || chr(10) || '  DISPLAY A (' || n_nationkey || ') ''A''.' as content from nation)"""
_ENTRIES = rf"""c0 as (select *, regexp_matches(upper(line), '^ {{0,3}}(?:{_PARTS})\b') as head, regexp_matches(line, '^ {{0,3}}[^ *]') as a, starts_with(line, '*') as comment, trim(line) = '' as blank from s),
c1 as (select *, last_value(case when head or a then head end ignore nulls) over w as inn,
    last_value(case when head then 'paragraph' when a then '' when contains(line, '*>CE') then 'mark' when not comment and not blank then 'text' end ignore nulls) over w as marked
    from c0 window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
c as (select doc_id, line_no, case when head then regexp_extract(line, '^( {{0,3}}[A-Za-z-]+\s*\.?)', 1) else line end as line from c1
    where not (comment or contains(line, '*>CE') or (coalesce(marked, '') = 'mark' and blank) or (coalesce(inn, false) and not head)))"""


def _classified(source: str) -> str:
    return f"""t0 as (select doc_id, line_no, unnest(l) as tok, unnest(range(len(l))) as place from (select doc_id, line_no, {_tokens('line')} as l from {source} where not starts_with(trim(line), '*'))),
t1 as (select *, upper(tok) as up, lead(upper(tok)) over ({_BY}) as nxt, lag(tok) over ({_BY}) as prv, first_value(upper(tok)) over l as first, nth_value(tok, 2) over l as second,
    (count(*) filter (tok = '==') over ({_SO_FAR})) % 2 = 1 or tok = '==' as inside from t0 window l as (partition by doc_id, line_no order by place rows between unbounded preceding and unbounded following)),
t2 as (select *, coalesce(last_value(case when not inside and up = 'EXEC' and nxt in ('SQL', 'CICS', 'SQLIMS') then 'EXEC_' || nxt when not inside and up = 'END-EXEC' then '' end ignore nulls) over ({_SO_FAR}), '') as ex from t1),
t3 as (select *, coalesce(lag(ex) over ({_BY}), '') as exb from t2),
t4 as (select *, ex <> '' or exb <> '' as inex, count(*) filter (ex <> '' and exb = '') over ({_SO_FAR}) as block, last_value(case when ex <> '' and exb = '' then ex end ignore nulls) over ({_SO_FAR}) as ekind from t3),
t5 as (select *, coalesce(last_value(case when inside or inex then null when up = 'REPLACE' and (place = 0 or prv = '.') then 'REPLACE' when up = 'COPY' then 'COPY' when tok = '.' then '' end ignore nulls) over ({_SO_FAR}), '') as sa from t4),
t6 as (select *, coalesce(lag(sa) over ({_BY}), '') as sab from t5),
t7 as (select *, count(*) filter (sa <> '' and sab = '') over ({_SO_FAR}) as statement, last_value(case when sa <> '' and sab = '' then sa end ignore nulls) over ({_SO_FAR}) as skind from t6),
t as (select doc_id, line_no, place, tok, up, inside, case when inex then block when sa <> '' or sab <> '' then statement else 0 end as unit, case when inex then ekind when sa <> '' or sab <> '' then skind
    when first in ('EJECT', 'SKIP1', 'SKIP2', 'SKIP3') and (place = 0 or (place = 1 and tok = '.')) then null when first = 'TITLE' and second[1] in ('''', '"') and (place < 2 or (place = 2 and tok = '.')) then null
    when first in ('CBL', 'PROCESS') then 'OPTIONS' else 'CODE' end as kind from t7)"""


_OFF = """r0 as (select doc_id, unit, coalesce((list(up order by line_no, place))[2] = 'OFF', false) as off from t where kind = 'REPLACE' group by doc_id, unit),
r1 as (select *, row_number() over (partition by doc_id order by unit) as nth, sum(case when off then -1 else 1 end) over (partition by doc_id order by unit) as total from r0),
r2 as (select *, total - least(min(total) over (partition by doc_id order by unit), 0) as depth from r1),
sc as (select p.doc_id, p.unit, p.nth, p.depth as level, (select min(q.nth) - 1 from r2 q where q.doc_id = p.doc_id and q.nth > p.nth and q.depth < p.depth) as last from r2 p where not p.off)"""
_CLAUSES = """k1 as (select *, count(*) filter (tok = '==') over u as mark, count(*) filter (not inside and up in ('REPLACE', 'REPLACING')) over u as rep from t where kind in ('REPLACE', 'COPY')
    window u as (partition by doc_id, kind, unit order by line_no, place rows between unbounded preceding and current row)),
k2 as (select *, count(*) filter (not inside or (tok = '==' and mark % 2 = 1)) over (partition by doc_id, kind, unit order by line_no, place rows between unbounded preceding and current row) as operand
    from k1 where rep > 0 and (inside or up not in ('REPLACE', 'REPLACING', 'BY', '.', ',', 'LEADING', 'TRAILING'))),
k3 as (select doc_id, kind, unit, operand, list(tok order by line_no, place) filter (tok <> '==') as toks from k2 group by all),
k4 as (select o.doc_id, o.kind, o.unit, o.operand as clause, o.toks as old, n.toks as new from k3 o left join k3 n on n.doc_id = o.doc_id and n.kind = o.kind and n.unit = o.unit and n.operand = o.operand + 1
    where o.operand % 2 = 1 and len(o.toks) > 0)"""
_QUOTED = r"regexp_replace(x, '([!-/:-@\[-^`{-~])', '\\\1', 'g')"
_RULES = f"""k as (select doc_id, kind, unit, list({{'text': '', 'old': '(?i)' || array_to_string(list_transform(old, lambda x: chr(30) || {_QUOTED} || chr(31)), ' *(?:\\n-?[0-9]+ *)*'),
    'new': array_to_string(list_transform(coalesce(new, []), lambda x: chr(30) || x || chr(31)), ' ')}} order by clause) as rules from k4 group by all)"""


def _applied(text: str, rules: str) -> str:
    return f"list_reduce(list_prepend({{'text': {text}, 'old': '', 'new': ''}}, coalesce({rules}, [])), lambda a, r: {{'text': regexp_replace(a.text, r.old, r.new, 'g'), 'old': '', 'new': ''}}).text"


def _shown(encoded: str) -> str:
    """An encoded line as text."""
    bare = f"trim(replace(regexp_replace({encoded}, '\\x1f *\\x1e', chr(31), 'g'), chr(30), ''), chr(31))"
    return f"replace(regexp_replace({bare} || chr(31), '\\x1f([.,()])', '\\1', 'g'), chr(31), ' ')"


def _sql() -> str:
    spaced = lambda k: f"rtrim({_shown(k)})"
    enc = "string_agg(chr(30) || tok || chr(31), '' order by line_no, place)"
    return f"""with {_SOURCE}, {_ENTRIES}, {_classified('c')}, {_OFF}, {_CLAUSES}, {_RULES},
g0 as (select *, kind = 'REPLACE' and coalesce(lag(unit) over (partition by doc_id, kind order by line_no, place), -1) <> unit as starts from t where kind in ('CODE', 'REPLACE')),
g1 as (select *, count(*) filter (starts) over ({_SO_FAR}) as segment from g0),
g2 as (select doc_id, segment, line_no, chr(10) || line_no || string_agg(chr(30) || tok || chr(31), '' order by place) as text from g1 where kind = 'CODE' group by doc_id, segment, line_no),
g as (select doc_id, segment, string_agg(text, '' order by line_no) as text from g2 group by all),
a as (select g.doc_id, g.segment, flatten(list(k.rules order by sc.level)) as rules from g join sc on sc.doc_id = g.doc_id and sc.nth <= g.segment and g.segment <= coalesce(sc.last, g.segment)
    join k on k.doc_id = sc.doc_id and k.unit = sc.unit and k.kind = 'REPLACE' group by all),
h as (select doc_id, segment, unnest(string_split({_applied('g.text', 'a.rules')}, chr(10))) as part from g left join a using (doc_id, segment)),
code as (select doc_id, cast(regexp_extract(part, '^-?[0-9]+') as bigint) as line_no, string_agg(regexp_replace(part, '^-?[0-9]+', ''), '' order by segment) as e from h where part <> '' group by 1, 2),
e as (select doc_id, unit, kind, min(line_no) as line_no, list(tok order by line_no, place) as toks, {enc} as e from t where starts_with(kind, 'EXEC_') group by all),
y as (select doc_id, unit, min(line_no) as line_no, upper(regexp_replace((list(tok order by line_no, place))[2], '["''.]', '', 'g')) as book from t where kind = 'COPY' group by all),
bl as (select book, unnest(range(len(m))) as i, unnest(m) as l from (select book, list_transform(string_split(content, chr(10)), lambda v: regexp_replace(v, {quoted('(' + preprocess.TOKEN + ')')}, chr(30) || '\\1' || chr(31), 'g')) as m from b)),
be as (select book, string_agg(chr(10) || i || l, '' order by i) as e from bl group by book),
z as (select y.doc_id, y.line_no, y.book, be.e as content, {_applied('be.e', 'k.rules')} as changed from y left join be using (book) left join k on k.doc_id = y.doc_id and k.unit = y.unit and k.kind = 'COPY')
select doc_id, line_no, 'CODE' as kind, {spaced('e')} as text from code where e <> ''
union all select doc_id, line_no, kind, coalesce(b.content, {spaced('e')}) from e left join b on e.kind = 'EXEC_SQL' and upper(toks[3]) = 'INCLUDE' and upper(toks[5]) = 'END-EXEC' and b.book = upper(toks[4])
union all select doc_id, line_no, 'OPTIONS', {spaced('e')} from (select doc_id, line_no, {enc} as e from t where kind = 'OPTIONS' group by all)
union all select doc_id, line_no, 'COPY', case when content is null then '* COPY ' || coalesce(book, '') || ' content not found.' else
    array_to_string(list_filter(list_transform(string_split(changed, chr(10)), lambda v: trim(replace(replace(regexp_replace(v, '^-?[0-9]+', ''), chr(30), ''), chr(31), ''))), lambda v: v <> ''), chr(10)) end from z
"""


QUERIES = {
    "preprocessed_lines": (preprocessed_lines, _sql()),
    "replace_scope_ends": (replace_scope_ends, f"with {_SOURCE}, {_classified('s')}, {_OFF} select doc_id, nth, cast(level as bigint) as level, last from sc"),
}
