"""Program-level queries on the small program of the structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, programs, structure
from .structure import DATA_ITEMS, PARAGRAPHS, PERFORMS, PROGRAM, STATEMENTS, TAL, lines_of, quoted, sql_lines


def program_header(spark, sf):
    return programs.header(lines_of(spark, HEAD)).select("doc_id", "program", "author", F.array_join("files", ",").alias("files"))


HEAD = ["IDENTIFICATION DIVISION.", "PROGRAM-ID. PAYRUN.", "AUTHOR.", "    OPS TEAM.", "SELECT PAYFILE ASSIGN TO DISK.", "SELECT OPTIONAL LOGFILE.", "FD  PAYFILE.", "FD  REPORT-FILE.", *PROGRAM[2:]]
_VALUE = r"case when regexp_matches(up, '^{0}\b') then coalesce(nullif(trim(regexp_replace(regexp_extract(up, '^{0}\s*\.?\s*(.*)$', 1), '\.$', '')), ''), regexp_replace(after, '\.$', '')) end"
HEADER = rf"""with {sql_lines(HEAD)}, u as (select doc_id, line_no, upper(trim(line)) as up, lead(upper(trim(line))) over (partition by doc_id order by line_no) as after from lines),
v as (select *, {_VALUE.format('PROGRAM-ID')} as program, {_VALUE.format('AUTHOR')} as author, coalesce(nullif(regexp_extract(up, '^FD\s+([A-Z0-9-]+)', 1), ''),
nullif(regexp_extract(up, '^SELECT\s+(?:OPTIONAL\s+)?([A-Z0-9-]+)(?:\s+ASSIGN\b.*|\s*\.?)$', 1), '')) as file from u)
select doc_id, arg_min(program, line_no) filter (program is not null) as program, arg_min(author, line_no) filter (author is not null) as author, string_agg(distinct file, ',' order by file) as files from v group by doc_id"""


def cleaned_lines(spark, sf):
    return programs.cleaned(lines_of(spark, PROGRAM))


CLEAN = rf"""with {sql_lines(PROGRAM)}, c as (select doc_id, line_no, case when regexp_matches(line, '^[0-9 ]{{6}}[ *\-/dD]') then line[7:7] || substr(line, 8, 65) else ' ' || line end as line from lines)
select doc_id, line_no, rtrim(substr(line, 2)) as line from c where line[1:1] not in ('*', '/') and not starts_with(trim(substr(line, 2)), '*') and trim(substr(line, 2)) <> ''"""


def data_metrics(spark, sf):
    return programs.data_metrics(structure.data_items(lines_of(spark, PROGRAM)))


METRICS = f"""with {DATA_ITEMS}, m as (select doc_id, count(*) as items, count(*) filter (level = 1) as records, count(*) filter (kind = 'GROUP') as groups, count(*) filter (level = 88) as conditions, count(picture) as pictures, count(value) as with_value,
count(redefines) as redefined, count(occurs) as arrays, count(*) filter (type in ('NUMERIC_INTEGER', 'NUMERIC_DECIMAL')) as numeric, count(*) filter (type = 'ALPHANUMERIC') as alphanumeric from items group by doc_id),
k as (select *, {' + '.join(f"cast({c} > {x} as int)" for c, limits in (("records", (5, 10, 20)), ("groups", (20, 50, 100)), ("conditions", (15, 30)), ("redefined", (0, 5)), ("arrays", (0, 10))) for x in limits)} as score from m)
select * exclude (score), case when score >= 8 then 'VERY COMPLEX' when score >= 5 then 'COMPLEX' when score >= 3 then 'MODERATE' else 'SIMPLE' end as band from k"""


def included_items(spark, sf):
    return programs.included(structure.data_items(lines_of(spark, PROGRAM))).select("name", "level", "section")


INCLUDED = f"""with {DATA_ITEMS}, f as (select *, upper(name) = 'FILLER' as filler, level in (1, 77) as top from items where name is not null)
select name, level, section from f where not (filler and value is null) and case when section = 'LINKAGE' then top or (level <> 88 and not filler) else top or level in (66, 88) or not filler or value is not null end"""


def linkage_parameters(spark, sf):
    return programs.linkage(structure.data_items(lines_of(spark, PROGRAM)), lines_of(spark, PROGRAM))


def perform_statistics(spark, sf):
    lines = lines_of(spark, PROGRAM)
    return programs.perform_statistics(graphs.resolved(structure.performs(lines), structure.procedures(lines).withColumnRenamed("paragraph", "name")))


PERFORM_STATS = f"with {PERFORMS} select doc_id, count(*) as calls, count(*) filter (target in (select pname from sec where begins)) as internal, count(*) filter (target not in (select pname from sec where begins)) as external from pf where form is not null group by doc_id".replace(r"\z", "$")


def _codes(spark):
    rows = structure.statements(lines_of(spark, PROGRAM))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("doc_id", F.col("paragraph").alias("name")).agg(code.alias("code"), F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))


def procedure_labels(spark, sf):
    lines = lines_of(spark, PROGRAM)
    refs = structure.item_references(structure.statements(lines), structure.data_items(lines)).join(structure.statements(lines).select("doc_id", "line_no", F.col("paragraph").alias("name")), ["doc_id", "line_no"])
    refs = refs.groupBy("doc_id", "name").agg(F.countDistinct("item").alias("items"))
    rows = _codes(spark).join(refs, ["doc_id", "name"], "left")
    cost = programs.statement_complexity(F.col("n"), F.col("code"), F.coalesce("items", F.lit(0)))
    return rows.select("name", programs.pattern_label(F.col("code")).alias("pattern"), cost.alias("complexity"), programs.is_main(F.col("name")).alias("is_main"))


NAMES = ["WS-TOTALS", "WS-COUNT", "WS-AMOUNT", "WS-NAME", "NAME-BLANK", "WS-TABLE", "WS-ROW", "LK-PARM"]
COUNTS = " + ".join(f"{k} * ((length(up) - length(replace(up, '{p}', ''))) // {len(p)})" for p, k in (("IF", 2), ("PERFORM", 1), ("EVALUATE", 2), ("GO TO", 1), ("CALL", 2)))
LABELS = f"""with {STATEMENTS}, p as (select paragraph as name, count(*) as n, upper(string_agg(content, chr(10) order by line_no)) as up from st group by paragraph)
select name, case when contains(up, 'VALIDATE') or contains(up, 'CHECK') then 'Input Validation Pattern' when contains(up, 'CALCULATE') or contains(up, 'COMPUTE') then 'Business Calculation Pattern' when contains(up, 'READ') and contains(up, 'WRITE') then 'Data Processing Pattern'
when contains(up, 'DISPLAY') or contains(up, 'WRITE') then 'Output Generation Pattern' when contains(up, 'PERFORM') then 'Control Flow Pattern' else 'Utility Pattern' end as pattern,
n + {COUNTS} + {' + '.join(f"cast(contains(up, '{x}') as int)" for x in NAMES)} as complexity, regexp_matches(lower(name), '{'|'.join(programs.MAIN_PARTS)}') as is_main from p"""


def quality_metrics(spark, sf):
    return programs.quality_metrics(structure.scored(lines_of(spark, PROGRAM)))


TAL_DATA = ["STRUCT rec(*);", "BEGIN", "INT id;", "STRING name[0:9];", "END;", "INT count := 0;  ! starts at 0", "INT(32) big;", "INT .ptr;", "STRING buf[0:79];", "INT count;", "REAL rate;", *TAL]


def tal_items(spark, sf):
    return programs.tal_items(lines_of(spark, TAL_DATA))


def _tal_items_sql():
    case = lambda what: "case " + " ".join(f"when regexp_matches(t, {quoted(p)}) then {what(k, p)}" for k, p in programs.TAL_ITEMS.items()) + " end"
    kinds = "case " + " ".join(f"when contains(upper(t), {quoted(x)}) then {quoted(x)}" for x in structure.TAL_TYPES) + " else 'UNKNOWN' end"
    return f"""with {sql_lines(TAL_DATA)}, b as (select doc_id, line_no, trim(regexp_replace(line, '!.*$', '')) as t from lines),
    k as (select *, {case(lambda k, p: quoted(k))} as kind, {case(lambda k, p: f"regexp_extract(t, {quoted(p)}, 1)")} as name, {kinds} as type from b),
    o as (select *, last_value(case when kind = 'STRUCT' then name when regexp_matches(upper(t), '^END\\s*;') or regexp_matches(upper(t), '\\bPROC\\b') then '' end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as struct from k),
    m as (select *, coalesce(struct, '') <> '' and kind <> 'STRUCT' as member from o where kind is not null qualify row_number() over (partition by doc_id, name order by line_no) = 1)
    select doc_id, line_no, name, case when member then 'MEMBER' else kind end as kind, type, case when member then struct end as struct from m"""


def item_references(spark, sf):
    lines = lines_of(spark, PROGRAM)
    return structure.item_references(structure.statements(lines), structure.data_items(lines))


ITEM_REFS = f"with {STATEMENTS}, i as (select unnest([{', '.join(repr(x) for x in NAMES)}]) as item) select doc_id, line_no, item from st join i on contains(upper(content), item)"


def templates(spark, sf):
    from .corpus import chunked

    rows = chunked(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("category")), "doc_id")
    return programs.templates(rows.select("category", "name", "content", (F.col("doc_id") * 100000 + F.col("chunk_id")).alias("ord")), 2).select("category", "ord", "name", F.md5("code").alias("digest"))


def _templates_sql():
    from .corpus import CHUNKS

    code = r"array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '!') and not starts_with(trim(x), '//') and length(trim(x)) >= 4), lambda x: rtrim(regexp_replace(x, '!.*$', ''))), chr(10))"
    return f"""with {CHUNKS} select d.lang as category, c.doc_id * 100000 + c.chunk_id as ord, c.name, md5({code}) as digest from c join documents d on d.doc_id = c.doc_id
    where c.name is not null and c.name <> '' and len(string_split(content, chr(10))) between 6 and 29 qualify row_number() over (partition by d.lang order by ord) <= 2"""


QUERIES = {
    "program_header": (program_header, HEADER),
    "cleaned_lines": (cleaned_lines, CLEAN),
    "data_metrics": (data_metrics, METRICS),
    "included_items": (included_items, INCLUDED),
    "linkage_parameters": (linkage_parameters, f"with {DATA_ITEMS} select doc_id, name, 'REFERENCE' as mode from items where section = 'LINKAGE' and level in (1, 77)"),
    "perform_statistics": (perform_statistics, PERFORM_STATS),
    "procedure_labels": (procedure_labels, LABELS),
    "quality_metrics": (quality_metrics, f"with {PARAGRAPHS} select doc_id, round(avg(score), 1) as mean_score, count(*) filter (score >= 65) as confident, cast(sum(n) as bigint) as statements from scores group by doc_id"),
    "tal_items": (tal_items, _tal_items_sql()),
    "item_references": (item_references, ITEM_REFS),
    "templates": (templates, _templates_sql()),
}
