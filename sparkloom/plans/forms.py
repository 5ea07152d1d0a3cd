"""Queries of line forms, parameters, chains, sizes and diagram texts over what both engines derive from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import graphs, programs, weights
from ..sources import tables
from . import corpus, lines
from .preprocess import quoted

FORMS = [
    "000100 IDENTIFICATION DIVISION.                                         NOTE0001", "000200*A COMMENT", "short", "000300     IF A > B MOVE 1 TO C. ADD 2 TO D. 05 E PIC X. END-IF.", "      -    MOVE SPACES TO A.",
    "000400     PERFORM X.COMPUTE Y = 1.", "", "      *", "       77 Z PIC 9.MOVE Z TO Y",
]
KINDS = list(fx.BLOCK_COLOURS) + ["other"]
USING = [
    "PROCEDURE DIVISION USING A BY VALUE B C BY REFERENCE D.", "CALL 'USING' USING BY CONTENT X Y BY VALUE Z RETURNING R", "ENTRY 'E' USING OPTIONAL P, Q.", "MOVE A TO B.", "call prog using by content one", "CALL P.", "PROCEDURE DIVISION.",
]


def _chosen(spark, sf, values, multiplier):
    at = (F.col("event_id") * F.col("event_id") + multiplier * F.col("user_id")) % len(values)
    return tables.read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.get(F.array(*map(F.lit, values)), at.cast("int")).alias("line"))


def _source(values, multiplier):
    return f"s as (select user_id as doc_id, event_id as line_no, list_value({', '.join(map(quoted, values))})[cast((event_id * event_id + {multiplier} * user_id) % {len(values)} + 1 as int)] as line from events)"


def line_forms(spark, sf):
    area, line = fx.source_areas(F.col("line")), F.col("line")
    shown = F.array_join(fx.split_statements(fx.fixed_columns(line)), "|")
    return _chosen(spark, sf, FORMS, 3).select("doc_id", "line_no", fx.fixed_columns(line).alias("code"), area["sequence"].alias("sequence"), area["indicator"].alias("indicator"), area["area_a"].alias("area_a"), area["comment"].alias("comment"), shown.alias("statements"))


LINE_FORMS = rf"""with {_source(FORMS, 3)}, c as (select *, case when length(line) >= 7 and line[7] <> '*' then substr(line, 8, 65) end as code from s)
select doc_id, line_no, code, line[1:6] as sequence, line[7:7] as indicator, line[8:11] as area_a, substr(line, 73) as comment,
array_to_string(list_filter(list_transform(string_split(regexp_replace(code, '\.\s*((?:0[1-9]|[1-4][0-9]|77|88)\s|[A-Z][A-Z0-9-]*\s)', '.' || chr(10) || '\1', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), '|') as statements from c"""


def using_parameters(spark, sf):
    return programs.using_modes(_chosen(spark, sf, USING, 5)).select("doc_id", "line_no", F.col("ord").cast("long").alias("ord"), "name", "mode")


PARAMETERS = rf"""with {_source(USING, 5)}, p as (select doc_id, line_no, regexp_extract(regexp_replace(upper(line), '''[^'']*''', ' ', 'g'), '\b(?:PROCEDURE\s+DIVISION|ENTRY|CALL)\b.*?\bUSING\b([^.]*)', 1) as tail from s),
w as (select doc_id, line_no, unnest(l) as name, unnest(range(len(l))) as i from (select doc_id, line_no, regexp_extract_all(regexp_replace(tail, '\bRETURNING\b.*', ''), '[A-Z0-9][A-Z0-9-]*') as l from p)),
m as (select *, coalesce(last_value(case when name in ('VALUE', 'CONTENT', 'REFERENCE') then name end ignore nulls) over (partition by doc_id, line_no order by i rows between unbounded preceding and current row), 'REFERENCE') as mode from w)
select doc_id, line_no, row_number() over (partition by doc_id, line_no order by i) as ord, name, mode from m where name not in ('VALUE', 'CONTENT', 'REFERENCE', 'BY', 'OPTIONAL')"""


def _calls(spark, sf):
    """Calls from each name to later ones: a chain per customer without cycles."""
    o = tables.read(spark, sf, "orders")
    name = lambda c: F.format_string("N%02d", c)
    first = F.col("o_orderkey") % 20
    return o.select(F.col("o_custkey").alias("doc_id"), name(first).alias("caller"), name(first + 1 + F.col("o_orderkey") % 3).alias("target"))


_CALLS = "e as (select distinct o_custkey as doc_id, 'N' || lpad(cast(o_orderkey % 20 as varchar), 2, '0') as caller, 'N' || lpad(cast(o_orderkey % 20 + 1 + o_orderkey % 3 as varchar), 2, '0') as target from orders)"


def chain_depths(spark, sf):
    return graphs.longest_path(_calls(spark, sf)).select("doc_id", "name", F.col("depth").cast("long").alias("depth"))


DEPTHS = f"""with recursive {_CALLS}, n as (select doc_id, caller as name from e union select doc_id, target from e),
w as (select doc_id, name, 0 as depth from n where not exists (select 1 from e where e.doc_id = n.doc_id and e.target = n.name)
      union select w.doc_id, e.target, w.depth + 1 from w join e on e.doc_id = w.doc_id and e.caller = w.name)
select doc_id, name, cast(max(depth) as bigint) as depth from w group by doc_id, name"""


def call_diagrams(spark, sf):
    return graphs.mermaid_graph(_calls(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def block_colours(spark, sf):
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS)).cast("int"))
    return tables.read(spark, sf, "events").select(kind.alias("kind")).groupBy("kind", fx.block_colour(F.col("kind")).alias("colour")).agg(F.count("*").alias("n"))


COLOURS = f"""select kind, case kind {' '.join(f"when {quoted(k)} then {quoted(v)}" for k, v in fx.BLOCK_COLOURS.items())} else '#CFD8DC' end as colour, count(*) as n
from (select list_value({', '.join(map(quoted, KINDS))})[event_id % {len(KINDS)} + 1] as kind from events) group by all"""


def scaled_sizes(spark, sf):
    return lines.nodes(spark, sf).select("doc_id", "id", F.round(graphs.scaled("statements"), 6).alias("size"))


SIZES = f"""with {lines.NODES_SQL}, b as (select *, min(statements) over (partition by doc_id) as lo, max(statements) over (partition by doc_id) as hi from k)
select doc_id, id, round(30 + 40 * case when hi = lo then 0.5 else (statements - lo) / (hi - lo) end, 6) as size from b"""


def hybrid_decisions(spark, sf):
    """By supplier: parts found among those expected, and whether the fallback is wanted."""
    rows = lines.edges(spark, sf).groupBy("doc_id").agg(F.countDistinct("target").alias("found"), F.countDistinct("caller").alias("some"))
    return rows.select("doc_id", programs.hybrid(F.col("found"), 2 * F.col("some") + F.col("doc_id") % 3 - 1).alias("wanted"))


HYBRID = f"with {lines.EDGES_SQL} select doc_id, 2 * count(distinct caller) + doc_id % 3 - 1 > 0 and count(distinct target) / (2 * count(distinct caller) + doc_id % 3 - 1) < 0.8 as wanted from e group by doc_id"


def stem_counts(spark, sf):
    """The most frequent stems of the documents."""
    found = weights.stemmed(corpus.counts(spark, sf)).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return found.orderBy(F.desc("n"), "term").limit(500)


QUERIES = {
    "line_forms": (line_forms, LINE_FORMS),
    "using_parameters": (using_parameters, PARAMETERS),
    "chain_depths": (chain_depths, DEPTHS),
    "call_diagrams": (call_diagrams, f"with {_CALLS} select doc_id, md5('graph TD' || chr(10) || string_agg('    ' || caller || ' --> ' || target, chr(10) order by caller, target)) as digest from e group by doc_id"),
    "block_colours": (block_colours, COLOURS),
    "scaled_sizes": (scaled_sizes, SIZES),
    "hybrid_decisions": (hybrid_decisions, HYBRID),
    "stem_counts": (stem_counts, None),
}
