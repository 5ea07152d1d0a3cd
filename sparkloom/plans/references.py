"""Queries of references to data items: an event is a line of its user's program, of data items first, then of statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import programs, prompts, structure, weights
from ..sources import tables
from .preprocess import quoted

ITEMS = [(1, "REC"), (5, "CUST"), (10, "NAME"), (10, "CUST-NAME"), (5, "TOTALS"), (10, "name"), (77, "I"), (88, "IS-OPEN"), (1, "OTHER"), (3, "CUST"), (49, "T-1")]
STATEMENTS = [
    ("MOVE", "MOVE NAME OF CUST TO NAME IN TOTALS OF REC."), ("ADD", "ADD 1 TO T-1 (I), CUST-NAME ( 1 )."), ("DISPLAY", "DISPLAY 'NAME OF REC' Cust-Name."), ("IF", 'IF IS-OPEN OR NAME = "I" THEN'),
    ("MOVE", "MOVE CUST IN OTHER (I) TO CUST."), ("SET", "SET X-NAME NAME-X TO SPACES"), ("MOVE", "MOVE NAME OF OTHER TO I I."), ("CALL", "CALL 'P' USING REC OF OF TOTALS"),
]


def _pick(values, at):
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def items(spark, sf):
    """Two thirds of a user's first lines."""
    e = tables.read(spark, sf, "events").where("event_id % 5 = 0")
    at = (F.col("event_id") / 5 + F.col("user_id")).cast("long") % len(ITEMS)
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), _pick([k for k, _ in ITEMS], at).alias("level"), _pick([n for _, n in ITEMS], at).alias("name"))


def statements(spark, sf):
    e = tables.read(spark, sf, "events").where("event_id % 5 <> 0")
    at = (F.col("event_id") * F.col("event_id") + F.col("user_id")) % len(STATEMENTS)
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), _pick([k for k, _ in STATEMENTS], at).alias("type"), _pick([c for _, c in STATEMENTS], at).alias("content"))


def item_groups(spark, sf):
    rows = structure.groups_around(items(spark, sf))
    return rows.select("doc_id", "line_no", "level", "name", F.array_join("groups", ",").alias("groups"))


def data_references(spark, sf):
    return structure.data_references(statements(spark, sf), structure.groups_around(items(spark, sf)))


def _at(values, index):
    return f"list_value({', '.join(quoted(v) if isinstance(v, str) else str(v) for v in values)})[cast({index} as int) + 1]"


_ITEM, _STATEMENT = f"(event_id // 5 + user_id) % {len(ITEMS)}", f"(event_id * event_id + user_id) % {len(STATEMENTS)}"
_WITH = f"""i as (select user_id as doc_id, event_id as line_no, {_at([k for k, _ in ITEMS], _ITEM)} as level, {_at([n for _, n in ITEMS], _ITEM)} as name from events where event_id % 5 = 0),
d as (select *, case level when 77 then 1 when 88 then 50 else level end as depth from i),
p as (select c.doc_id, c.line_no, g.depth, upper(g.name) as name from d c join d g on g.doc_id = c.doc_id and g.line_no < c.line_no and g.depth < c.depth
    and not exists (select 1 from d x where x.doc_id = c.doc_id and x.line_no > g.line_no and x.line_no < c.line_no and x.depth <= g.depth)),
g as (select d.doc_id, d.line_no, d.level, d.name, list(p.name order by p.depth) filter (p.name is not null) as groups from d left join p on p.doc_id = d.doc_id and p.line_no = d.line_no group by all)"""
GROUPS = f"with {_WITH} select doc_id, line_no, level, name, coalesce(array_to_string(groups, ','), '') as groups from g"
_WORD = "[A-Z0-9_][A-Z0-9_-]*"
REFERENCES = f"""with {_WITH},
s as (select user_id as doc_id, event_id as line_no, {_at([k for k, _ in STATEMENTS], _STATEMENT)} as type, upper({_at([c for _, c in STATEMENTS], _STATEMENT)}) as content from events where event_id % 5 <> 0),
c as (select doc_id, line_no, type, unnest(regexp_extract_all(regexp_replace(content, '''[^'']*''|"[^"]*"', '#', 'g'), '\\b{_WORD}(?:\\s+(?:OF|IN)\\s+{_WORD})*(?:\\s*\\()?')) as chain from s),
q as (select doc_id, line_no, type, ends_with(chain, '(') as subscripted, list_filter(regexp_split_to_array(trim(rtrim(chain, '(')), '\\s+'), lambda x, k: k % 2 = 1) as names from c),
r as (select *, names[1] as item, names[2:] as qualifiers from q)
select r.doc_id, r.line_no, r.type, r.item, array_to_string(qualifiers, ',') as qualifiers, subscripted, g.line_no as item_line, count(*) as n from r join g on g.doc_id = r.doc_id and upper(g.name) = r.item
where len(list_filter(qualifiers, lambda x: not list_contains(coalesce(g.groups, []), x))) = 0 group by all"""

def sectioned(spark, sf):
    return items(spark, sf).withColumn("section", F.when(F.col("line_no") % 3 == 0, "LINKAGE").otherwise("WORKING-STORAGE"))


def item_counts(spark, sf):
    return programs.item_counts(sectioned(spark, sf)).select("doc_id", "section", F.col("level").cast("long").alias("level"), "n")


def item_lists(spark, sf):
    """Items as JSON, by their digest."""
    return prompts.items_json(sectioned(spark, sf), "section").select("doc_id", F.md5("text").alias("digest"))


VOCABULARY = ["error", "click", "view", "purchase", "login"]


def query_keywords(spark, sf):
    """Which words of a query (an event's type and properties) a vocabulary has."""
    said = F.concat_ws(" ", F.upper("event_type"), F.regexp_replace("props", "[^a-z0-9]+", " "), F.lit("view"))
    rows = tables.read(spark, sf, "events").select("event_id", weights.query_keywords(said, VOCABULARY).alias("k"))
    return rows.select("event_id", F.array_join("k.matched", ",").alias("matched"), F.array_join("k.unmatched", ",").alias("unmatched"))


_SECTION = "j as (select *, case when line_no % 3 = 0 then 'LINKAGE' else 'WORKING-STORAGE' end as section from i)"
_WORDS = f"""q as (select event_id, list_filter(regexp_split_to_array(lower(trim(concat_ws(' ', upper(event_type), regexp_replace(props, '[^a-z0-9]+', ' ', 'g'), 'view'))), '\\s+'), lambda w: w <> '') as w, [{', '.join(map(quoted, VOCABULARY))}] as v from events)"""

QUERIES = {
    "item_counts": (item_counts, f"with {_WITH}, {_SECTION} select doc_id, section, cast(level as bigint) as level, count(*) as n from j group by grouping sets ((doc_id, section, level), (doc_id, section), (doc_id))"),
    "item_lists": (item_lists, f"""with {_WITH}, {_SECTION} select doc_id, md5('[' || string_agg('{{"level":' || level || ',"name":"' || name || '","section":"' || section || '"}}', ',' order by line_no) || ']') as digest from j group by doc_id"""),
    "query_keywords": (query_keywords, f"with {_WORDS} select event_id, array_to_string(list_filter(v, lambda x: list_contains(w, x)), ',') as matched, array_to_string(list_filter(w, lambda x: not list_contains(v, x)), ',') as unmatched from q"),
    "item_groups": (item_groups, GROUPS),
    "data_references": (data_references, REFERENCES),
}
