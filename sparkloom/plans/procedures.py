"""Queries over paragraphs of programs that both engines derive from the tables: an event is a line of its user's program."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import programs
from ..sources import tables
from .preprocess import quoted

LINES = [
    "STEP-A.", "  MOVE 1 TO X", "", "step-b. CONTINUE", "  ADD 1 TO X.", "", "OTHER LINE.", "* calls STEP-C here", "  PERFORM STEP-C", "STEP-D. STOP RUN.", "  GO TO STEP-D", "",
    "  step-a. not a start by itself", "Step-e is named.", "*", "  IF X > 1",
]
NAMES = ["Step-A", "STEP-B", "step-d", "STEP-C", "STEP-E", "NOWHERE"]
SOURCE = f"s as (select user_id as doc_id, event_id as line_no, list_value({', '.join(map(quoted, LINES))})[cast((event_id * event_id + 5 * user_id + event_id // 100) % {len(LINES)} + 1 as int)] as line from events)"


def lines(spark, sf):
    at = (F.col("event_id") * F.col("event_id") + 5 * F.col("user_id") + F.floor(F.col("event_id") / 100)) % len(LINES)
    return tables.read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.get(F.array(*map(F.lit, LINES)), at.cast("int")).alias("line"))


def names(spark, sf, chosen):
    users = tables.read(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return users.select("doc_id", F.explode(F.array(*map(F.lit, chosen))).alias("name"))


def paragraph_codes(spark, sf):
    return programs.procedure_code(lines(spark, sf), names(spark, sf, NAMES)).select("doc_id", "name", F.md5("code").alias("digest"))


CODES = f"""with {SOURCE}, m as (select *, (trim(line) = '' and coalesce(lag(trim(line) = '') over (partition by doc_id order by line_no), false)) or regexp_matches(trim(line), '^[A-Za-z].*\\.$') as stops from s),
st as (select doc_id, n.name, line_no as first from m, (select unnest({NAMES!r}) as name) n where starts_with(lower(trim(line)), lower(n.name) || '.')),
e as (select st.*, (select min(line_no) from m where m.doc_id = st.doc_id and m.line_no > st.first and m.stops) as stop from st),
c as (select e.doc_id, e.name, e.first, string_agg(m.line, chr(10) order by m.line_no) as code from e join m on m.doc_id = e.doc_id and m.line_no >= e.first and (e.stop is null or m.line_no < e.stop) group by all)
select doc_id, name, md5(string_agg(code, chr(10) order by first)) as digest from c group by doc_id, name"""


def recovered_paragraphs(spark, sf):
    return programs.recovered(lines(spark, sf), names(spark, sf, ["step-a"]), names(spark, sf, NAMES))


RECOVERED = f"""with {SOURCE}, n as (select unnest({NAMES[1:]!r}) as name), c as (select *, lower(trim(line)) as word, starts_with(trim(line), '*') as comment from s),
h as (select doc_id, name, line_no from c, n where not comment and starts_with(word, lower(name)) and contains(word, '.')),
k as (select a.doc_id, name, b.line_no from c a join n on a.comment and contains(a.word, lower(name)) join c b on b.doc_id = a.doc_id and b.line_no > a.line_no and b.line_no < a.line_no + 10
    and not b.comment and b.word <> '' and contains(b.word, lower(name)))
select doc_id, name, min(line_no) as line_no from (select * from h union all select * from k) group by doc_id, name"""

QUERIES = {"paragraph_codes": (paragraph_codes, CODES), "recovered_paragraphs": (recovered_paragraphs, RECOVERED)}
