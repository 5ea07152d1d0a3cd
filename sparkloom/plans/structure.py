"""Source-structure and graph queries: on a small program given in both engines, and on events and turns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as fx
from ..operators import chunking, graphs, prompts, structure

PROGRAM = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYRUN.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-TOTALS.
           05  WS-COUNT        PIC 9(5) COMP VALUE 0.
           05  WS-AMOUNT       PIC S9(7)V99.
           05  WS-NAME         PIC X(30).
               88  NAME-BLANK  VALUE SPACES.
       01  WS-TABLE.
           05  WS-ROW OCCURS 10 PIC X(4).
       LINKAGE SECTION.
       01  LK-PARM             PIC X(8).
       PROCEDURE DIVISION USING LK-PARM.
       MAINLINE.
           PERFORM INIT-RUN.
           PERFORM PROCESS-RECORD UNTIL WS-COUNT > 9.
           PERFORM CHECK-LIMIT THRU CHECK-EXIT.
           PERFORM COMMON-RTN.
           PERFORM AUDIT-PGM 3 TIMES.
           CALL 'PAYSUB' USING BY REFERENCE WS-COUNT, WS-NAME.
           CALL WS-PROG USING WS-AMOUNT.
           GOBACK.
       INIT-RUN.
           OPEN INPUT PAYFILE.
           MOVE 0 TO WS-COUNT.
           COPY PAYREC REPLACING ==OLD== BY ==NEW==.
           COPY STDPROC OF PAYLIB.
       PROCESS-RECORD.
           READ PAYFILE.
           IF WS-COUNT > 5
               MOVE SPACES TO WS-NAME
               ADD 1 TO WS-COUNT
           END-IF.
      *    a comment line
           EXEC SQL
               SELECT NAME INTO :WS-NAME FROM PAY
           END-EXEC.
           PERFORM CHECK-LIMIT.
       CHECK-LIMIT.
           EVALUATE WS-COUNT
               WHEN 1 DISPLAY 'ONE'
           END-EVALUATE.
       CHECK-EXIT.
           EXIT.""".split("\n")

TAL = """\
NAME payments;
INT total;
PROC validate_mt103 (msg);
  INT .msg;
BEGIN
  total.<0:3> := 5;      ! bits
  .msg := 7;
  name ':=' "abc";
  SCAN buffer WHILE " " -> @p;
  CALL send_wire;
  CALL $log;
  IF total THEN
    RETURN 1;
  ENDIF;
  @p := @q;
  total := total + 1;
END;
PROC send_wire;
BEGIN
  CALL helper;
  RETURN;
END;""".split("\n")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lines_of(spark, source, doc_id=1):
    return spark.createDataFrame([(doc_id, i, x) for i, x in enumerate(source)], "doc_id long, line_no int, line string")


def sql_lines(source):
    return "lines(doc_id, line_no, line) as (values " + ", ".join(f"(1, {i}, {quoted(x)})" for i, x in enumerate(source)) + ")"


VERB_NAMES = ", ".join(quoted(v.replace(" ", "-")) for v in structure.VERBS)
STATEMENT = "case " + " ".join(f"when starts_with(upper(trim(line)), '{v}') then '{v.replace(' ', '_')}'" for v in structure.VERBS) + " " + " ".join(f"when contains(upper(line), '{e}') then '{e}'" for e in structure.ENDINGS) + " else 'STATEMENT' end"
SECTIONS = rf"""{sql_lines(PROGRAM)},
dv as (select *, upper(trim(line)) as up, last_value(case when regexp_matches(upper(trim(line)), '^[A-Z-]+\s+DIVISION') then regexp_extract(upper(trim(line)), '^([A-Z-]+)\s+DIVISION', 1) end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as division from lines),
nm as (select *, regexp_extract(upper(line), '^\s*([A-Z0-9][A-Z0-9-]*)\.\s*$', 1) as pname from dv),
bg as (select *, pname <> '' and coalesce(division = 'PROCEDURE', false) and pname not in ({VERB_NAMES}) and not starts_with(pname, 'END-') as begins from nm),
sec as (select *, last_value(case when begins then pname end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as paragraph from bg)"""
STATEMENTS = f"{SECTIONS}, st as (select doc_id, line_no, paragraph, {STATEMENT} as type, trim(line) as content from sec where paragraph is not null and not begins and trim(line) <> '' and not starts_with(trim(line), '*'))"
PERFORMS = f"""{SECTIONS}, pf as (select doc_id, line_no, paragraph as caller,
case {' '.join(f"when regexp_matches(upper(line), '{p}') then regexp_extract(upper(line), '{p}', 1)" for _, p in structure.PERFORM_FORMS)} end as target,
case {' '.join(f"when regexp_matches(upper(line), '{p}') then '{n}'" for n, p in structure.PERFORM_FORMS)} end as form,
case when regexp_matches(upper(line), '{structure.PERFORM_FORMS[0][1]}') then regexp_extract(upper(line), '{structure.PERFORM_FORMS[0][1]}', 2) end as through from sec)"""


def cobol_statements(spark, sf):
    return structure.statements(lines_of(spark, PROGRAM))


def cobol_performs(spark, sf):
    return structure.performs(lines_of(spark, PROGRAM))


def cobol_calls(spark, sf):
    return structure.calls(lines_of(spark, PROGRAM)).select("doc_id", "line_no", "program", "form", F.array_join("parameters", ",").alias("parameters"))


CALLS = rf"""with {sql_lines(PROGRAM)}, c as (select doc_id, line_no, upper(line) as up,
case {' '.join("when regexp_matches(upper(line), {0}) then regexp_extract(upper(line), {0}, 1)".format(quoted(p)) for _, p in structure.CALL_FORMS)} end as program,
case {' '.join(f"when regexp_matches(upper(line), {quoted(p)}) then '{n}'" for n, p in structure.CALL_FORMS)} end as form from lines)
select doc_id, line_no, program, form, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(regexp_extract(up, 'USING(.*)$', 1), '\bBY\s+(REFERENCE|CONTENT|VALUE)\b', '', 'g')), '\s+'),
lambda w: regexp_replace(w, '[,.]', '', 'g')), lambda w: regexp_full_match(w, '[A-Z0-9-]+')), ',') as parameters from c where form is not null"""


def cobol_copies(spark, sf):
    return structure.copies(lines_of(spark, PROGRAM))


COPIES = rf"""with {sql_lines(PROGRAM)}, u as (select doc_id, line_no, upper(line) as up from lines),
c as (select *, regexp_replace(coalesce({', '.join(f"nullif(regexp_extract(up, {quoted(x)}, 1), '')" for x in structure.COPY_FORMS)}), '\.$', '') as copybook from u)
select doc_id, line_no, copybook, regexp_replace(nullif(regexp_extract(up, 'COPY\s+\S+\s+(?:OF|IN)\s+([A-Z0-9.-]+)', 1), ''), '\.$', '') as library, nullif(regexp_extract(up, '(REPLACING.*)$', 1), '') as replacing,
case when contains(copybook, 'REC') or contains(copybook, 'LAYOUT') then 'DATA_STRUCTURE' when contains(copybook, 'PROC') or contains(copybook, 'ROUTINE') or contains(up, 'PROCEDURE') then 'PROCEDURE_CODE'
when contains(copybook, 'CONST') or contains(copybook, 'CODE') or contains(copybook, 'MSG') then 'CONSTANTS' else 'UNKNOWN' end as kind from c where copybook is not null"""


def cobol_data_items(spark, sf):
    return structure.data_items(lines_of(spark, PROGRAM)).select("doc_id", "line_no", "section", "level", "name", "picture", F.coalesce("occurs", F.lit(0)).alias("occurs"), "usage", "type", "kind", F.coalesce(F.col("parent").cast("long"), F.lit(-1)).alias("parent"))


DATA_ITEMS = rf"""{SECTIONS}, ds as (select doc_id, line_no, trim(line) as t, last_value(case when regexp_matches(up, '^[A-Z-]+\s+SECTION') then regexp_extract(up, '^([A-Z-]+)\s+SECTION', 1) end ignore nulls)
over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from sec where division = 'DATA'),
di as (select doc_id, line_no, section, try_cast(regexp_extract(t, '^(\d{{1,2}})\s', 1) as int) as level, nullif(regexp_extract(t, '^\d{{1,2}}\s+([A-Za-z0-9-]+)', 1), '') as name,
regexp_replace(nullif(regexp_extract(t, '(?i)\sPIC(?:TURE)?\s+(?:IS\s+)?(\S+)', 1), ''), '\.$', '') as picture, regexp_replace(nullif(regexp_extract(t, '(?i)\sVALUE\s+(?:IS\s+)?(\S+)', 1), ''), '\.$', '') as value,
try_cast(regexp_extract(t, '(?i)\sOCCURS\s+(\d+)', 1) as int) as occurs, nullif(regexp_extract(t, '(?i)\sREDEFINES\s+([A-Za-z0-9-]+)', 1), '') as redefines,
upper(nullif(regexp_extract(t, '(?i)\s(?:USAGE\s+(?:IS\s+)?)?(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|DISPLAY|PACKED-DECIMAL|INDEX|POINTER)\b', 1), '')) as usage from ds),
dk as (select *, case when level = 88 then 'CONDITION' when picture is not null then 'ELEMENTARY' else 'GROUP' end as kind from di where level is not null),
items as (select *, case when kind <> 'ELEMENTARY' then null when contains(upper(picture), 'X') then 'ALPHANUMERIC' when contains(upper(picture), '9') and contains(upper(picture), 'V') then 'NUMERIC_DECIMAL' when contains(upper(picture), '9') then 'NUMERIC_INTEGER'
when contains(upper(picture), 'A') then 'ALPHABETIC' else 'UNKNOWN' end as type, (select max(p.line_no) from dk p where p.doc_id = dk.doc_id and p.line_no < dk.line_no and p.level < dk.level and (p.level < 50 or p.level = 77)) as parent from dk)"""
ITEMS = f"with {DATA_ITEMS} select doc_id, line_no, section, level, name, picture, coalesce(occurs, 0) as occurs, usage, type, kind, coalesce(cast(parent as bigint), -1) as parent from items"


def external_calls(spark, sf):
    lines = lines_of(spark, PROGRAM)
    edges = graphs.resolved(structure.performs(lines), structure.procedures(lines).withColumnRenamed("paragraph", "name"))
    return edges.select("line_no", "target", "is_external", F.when(F.col("is_external"), structure.external_category(F.col("target"), F.lit(False))).alias("category"))


CATEGORY = f"""case when regexp_full_match(target, '[0-9]+') or length(target) < 3 then 'LIKELY_ERROR' when regexp_matches(target, '{'|'.join(structure.COPYBOOK_NAMES).replace(chr(92) + 'z', '$')}') then 'LIKELY_COPYBOOK'
when regexp_matches(target, '{'|'.join(structure.PROGRAM_NAMES).replace(chr(92) + 'z', '$')}') then 'LIKELY_EXTERNAL_PROGRAM' else 'UNKNOWN' end"""
EXTERNAL = f"with {PERFORMS}, e as (select line_no, target, target not in (select pname from sec where begins) as is_external from pf where form is not null) select *, case when is_external then {CATEGORY} end as category from e"


def reference_coverage(spark, sf):
    lines = lines_of(spark, PROGRAM)
    return graphs.coverage(structure.performs(lines), structure.procedures(lines).withColumnRenamed("paragraph", "name"))


COVERAGE = f"with {PERFORMS}, e as (select distinct doc_id, target, target in (select pname from sec where begins) as known from pf where form is not null) select doc_id, count(*) as targets, count(*) filter (known) as found, round(100.0 * count(*) filter (known) / count(*), 2) as coverage from e group by doc_id"


def program_classes(spark, sf):
    rows = structure.mix(structure.statements(lines_of(spark, PROGRAM)))
    return rows.select("paragraph", "sql", "data", "file", "control", "statements", "class")


MIX = """case when sql + data + file + control = 0 then 'execution' when sql / (sql + data + file + control) > 0.4 then 'sql' when {main} then 'main' when file / (sql + data + file + control) > 0.4 then 'file'
when data / (sql + data + file + control) > 0.6 then 'data' when control / (sql + data + file + control) > 0.4 then 'control' else 'mixed' end"""
CLASSES = f"""with {STATEMENTS}, m as (select paragraph, count(*) filter (type in ('EXEC_SQL', 'END-EXEC')) as sql, count(*) filter (type in ('MOVE', 'SET', 'INITIALIZE')) as data, count(*) filter (type in ('READ', 'WRITE', 'OPEN', 'CLOSE')) as file,
count(*) filter (type in ('IF', 'PERFORM', 'EVALUATE')) as control, count(*) as statements from st group by paragraph) select *, {MIX.format(main="contains(lower(paragraph), 'main')")} as class from m"""


def procedure_scores(spark, sf):
    return structure.scored(lines_of(spark, PROGRAM)).select("paragraph", "start_line", "end_line", "statements", "refs", "score")


def statement_blocks(spark, sf):
    rows = structure.statements(lines_of(spark, PROGRAM)).withColumn("proc", F.concat_ws("/", "doc_id", "paragraph"))
    return chunking.blocks(rows.withColumn("line", F.col("line_no"))).select("proc", "block", "kind", "start_line", "end_line", "n_statements")


BLOCKS = f"""with recursive {STATEMENTS}, o as (select '1/' || paragraph as proc, line_no, type, row_number() over (partition by paragraph order by line_no) as k from st),
w as (select proc, k, line_no, type, cast(null as varchar) as inside, {{closer}} as closer from o where k = 1
union all select o.proc, o.k, o.line_no, o.type, w.closer, case when w.closer is not null then nullif(w.closer, o.type) else {{closer}} end from w join o on o.proc = w.proc and o.k = w.k + 1),
b as (select *, sum(cast(inside is null and type not in ({', '.join(map(quoted, chunking.SKIPPED))}) as int)) over (partition by proc order by k) - 1 as block from w where inside is not null or type not in ({', '.join(map(quoted, chunking.SKIPPED))}))
select proc, cast(block as int) as block, case arg_min(type, k) {' '.join(f"when {quoted(t)} then {quoted(n)}" for t, (n, _) in chunking.BLOCKS.items())} else arg_min(type, k) end as kind,
cast(min(line_no) as bigint) as start_line, cast(coalesce(max(line_no) filter (inside is not null and type = inside), min(line_no)) as bigint) as end_line, count(*) as n_statements from b group by proc, block"""
BLOCKS = BLOCKS.replace("{closer}", "case o.type " + " ".join(f"when {quoted(t)} then {quoted(c)}" for t, (_, c) in chunking.BLOCKS.items()) + " end")


def tal_statements(spark, sf):
    return structure.tal_statements(lines_of(spark, TAL))


def sql_tal(p):
    return quoted(p.replace(r"\z", "$"))


TAL_SQL = f"""{sql_lines(TAL)}, b as (select doc_id, line_no, trim(regexp_replace(line, '!.*$', '')) as t from lines),
k as (select doc_id, line_no, case {' '.join(f"when regexp_matches(t, {sql_tal(p)}) then '{n}'" for n, p in structure.TAL_FORMS)} else 'OTHER' end as type,
trim(case {' '.join(f"when regexp_matches(t, {sql_tal(p)}) then regexp_extract(t, {sql_tal(p)}, 1)" for _, p in structure.TAL_FORMS)} else '' end) as name from b where t <> ''),
tp as (select *, last_value(case when type = 'PROC' then upper(name) end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as procedure from k),
tal as (select doc_id, line_no, procedure, type, name from tp where procedure is not null and type <> 'PROC')"""


def tal_scores(spark, sf):
    return structure.tal_scores(structure.tal_statements(lines_of(spark, TAL)))


TAL_SCORES = f"""with {TAL_SQL}, r as (select doc_id, upper(name) as procedure, count(*) as refs from tal where type = 'CALL' group by all),
s as (select doc_id, procedure, min(line_no) as line_no, count(*) as statements, 50 + 15 * count(*) filter (type = 'BIT_FIELD_ASSIGNMENT') + 10 * count(*) filter (type in ('POINTER_DEREFERENCE', 'POINTER_ASSIGNMENT')) + 8 * count(*) filter (type = 'STRING_MOVE')
+ 12 * count(*) filter (type in ('SCAN', 'RSCAN')) + 5 * count(*) filter (type in ('CALL', 'SYSTEM_CALL')) as raw from tal group by all)
select s.doc_id, s.procedure, line_no, statements, cast(least(raw + case when statements > 10 then 10 else 0 end + 5 * coalesce(refs, 0), 100) as int) as score from s left join r on r.doc_id = s.doc_id and r.procedure = s.procedure"""


# Events of a user as calls from one type to the next.
def event_edges(spark, sf):
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf}/events.parquet")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("doc_id"), F.lag("event_type").over(by).alias("caller"), F.col("event_type").alias("target"))
    return rows.where("caller is not null")


EDGES = "e as (select user_id as doc_id, lag(event_type) over (partition by user_id order by ts, event_id) as caller, event_type as target from events), edges as (select * from e where caller is not null)"
NODES = f"{EDGES}, nodes as (select coalesce(n.doc_id, c.doc_id) as doc_id, coalesce(n.name, c.name) as name, coalesce(c.calls, 0) as calls from (select distinct doc_id, caller as name from edges) n full join (select doc_id, target as name, count(*) as calls from edges group by all) c on c.doc_id = n.doc_id and c.name = n.name)"


def event_nodes(spark, sf):
    edges = event_edges(spark, sf)
    return graphs.nodes(edges, edges.select("doc_id", F.col("caller").alias("name")))


def call_graph_nodes(spark, sf):
    return event_nodes(spark, sf)


def graph_callers(spark, sf):
    return graphs.callers(event_edges(spark, sf)).select("doc_id", "target", F.array_join("callers", ",").alias("callers"), "n")


def graph_classes(spark, sf):
    return graphs.execution_order(graphs.classified(event_nodes(spark, sf)))


def sql_has(*parts):
    return "(" + " or ".join(f"contains(low, '{p}')" for p in parts) + ")"


GRAPH = f"""with {NODES}, m as (select *, lower(name) as low, min(calls) over w as least_calls, max(calls) over w as most, avg(calls) over w as mean from nodes window w as (partition by doc_id)),
k as (select doc_id, name, calls, case when calls = least_calls and least_calls <= 1 and ({sql_has('main', 'start', 'begin')} or calls = 0) then 'entry'
when {sql_has('init', 'setup', 'open', 'start', 'begin', 'load')} or (contains(low, 'read') and contains(low, 'parm')) or (calls <= greatest(2, mean * 0.3) and length(name) > 4) then 'init'
when {sql_has('term', 'cleanup', 'close', 'end', 'finish', 'stop', 'exit')} or (calls <= greatest(2, mean * 0.3) and contains(low, 'final')) then 'cleanup' when calls >= floor(greatest(mean, most * 0.6)) then 'core' else 'support' end as kind from m)
select *, row_number() over (partition by doc_id order by case kind when 'entry' then 0 when 'init' then 1 when 'core' then 2 when 'support' then 3 else 4 end, name) as position from k"""


def call_patterns(spark, sf):
    edges = event_edges(spark, sf)
    return graphs.call_pattern(event_nodes(spark, sf), edges)


def reference_counts(spark, sf):
    return graphs.reference_counts(event_edges(spark, sf))


def fill_forward_sections(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = chunking.fill_forward(turns, F.when(F.col("role") == "user", F.col("turn")), "asked", "conv_id", "turn")
    return chunking.end_lines(rows.where("role = 'user'").select("conv_id", "turn", "asked"), F.lit(1000), "conv_id", "turn").select("conv_id", "turn", "asked", F.col("end_line").cast("long").alias("end_line"))


def statement_mix_class(spark, sf):
    kinds = spark.read.parquet(f"{sf}/events.parquet")
    n = lambda *t: F.count_if(F.col("event_type").isin(*t))
    rows = kinds.groupBy("user_id").agg(n("purchase").alias("sql"), n("view", "scroll").alias("data"), n("login", "logout", "error").alias("file"), n("click", "signup").alias("control"))
    return rows.withColumn("class", structure.mix_class(F.col("sql"), F.col("data"), F.col("file"), F.col("control"), F.col("user_id") % 10 == 0))


EVENT_MIX = f"""with m as (select user_id, count(*) filter (event_type in ('purchase')) as sql, count(*) filter (event_type in ('view', 'scroll')) as data, count(*) filter (event_type in ('login', 'logout', 'error')) as file,
count(*) filter (event_type in ('click', 'signup')) as control from events group by user_id) select *, {MIX.format(main='user_id % 10 = 0')} as class from m"""


def nearest_assignment(spark, sf):
    points = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("diagram"), "c_custkey", "c_acctbal")
    anchors = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("diagram"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("ax"), F.col("s_suppkey").alias("ord"))
    return graphs.nearest(points, anchors, "c_acctbal", "nearest").select("c_custkey", "nearest")


RULES = [("files", 0, False, ["FILE_PROCESSING"], [".*READ.*", ".*FILE.*"], ["READ\\s+\\w+"]), ("dispatch", 1, True, [], [".*HANDLE.*"], ["EVALUATE\\s+\\w+"]), ("any", 2, False, [], [], ["MOVE\\s+"])]


def rule_matches(spark, sf):
    rows = structure.statements(lines_of(spark, PROGRAM))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n")
    procs = rows.groupBy("doc_id", F.col("paragraph").alias("name")).agg(code.alias("code"))
    procs = procs.withColumn("label", fx.architecture_label(F.col("name"), F.col("code")))
    rules = spark.createDataFrame(RULES, "rule string, ord int, override boolean, labels array<string>, name_patterns array<string>, code_patterns array<string>")
    return graphs.rule_matches(procs, rules)


def procedure_texts(spark, sf):
    rows = structure.statements(lines_of(spark, PROGRAM))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n")
    procs = rows.groupBy("doc_id", F.col("paragraph").alias("name")).agg(code.alias("code"))
    return procs.select("name", fx.logic_summary(F.col("code")).alias("logic"), fx.architecture_label(F.col("name"), F.col("code")).alias("label"), fx.camel(F.col("name")).alias("method"), fx.pascal(F.col("name")).alias("class"))


LABEL = """case when contains(n, 'valid') or (contains(c, 'if ') and contains(c, 'set ')) then 'VALIDATION' when contains(n, 'read') or contains(n, 'file') or contains(c, 'read ') then 'FILE_PROCESSING' when contains(c, 'exec sql') or contains(c, 'select ') then 'DATABASE_ACCESS'
when contains(n, 'process') and (contains(c, 'move ') or contains(c, 'initialize')) then 'DATA_TRANSFORMATION' when contains(n, 'init') or contains(n, 'open') then 'INITIALIZATION' when contains(n, 'term') or contains(n, 'close') then 'CLEANUP' else 'BUSINESS_LOGIC' end"""
LOGIC = f"""with {STATEMENTS}, p as (select paragraph as name, string_agg(content, chr(10) order by line_no) as code from st group by paragraph), u as (select *, upper(code) as up, lower(name) as n, lower(code) as c from p)
select name, coalesce(nullif(concat_ws(', ', {', '.join("case when " + ' or '.join(f"contains(up, '{v}')" for v in verbs) + f" then '{label}' end" for label, verbs in fx.LOGIC_GROUPS)}), ''), 'General Processing') as logic,
{LABEL} as label,
n_parts[1] || array_to_string(list_transform(n_parts[2:], lambda w: upper(w[1:1]) || w[2:]), '') as method, array_to_string(list_transform(n_parts, lambda w: upper(w[1:1]) || w[2:]), '') as class from (select *, string_split(n, '-') as n_parts from u)"""


def sql_rule(rule, ord, override, labels, names, codes):
    """The procedures that a rule matches."""
    found = [f"regexp_full_match(name, {quoted(x)}, 'i')" for x in names] + [f"regexp_matches(code, {quoted(x)}, 'i')" for x in codes]
    where = " or ".join(found) or "true"
    if labels:
        where = f"label in ({', '.join(map(quoted, labels))}) and ({where})"
    return f"select doc_id, name, {quoted(rule)} as rule, {ord} as ord, {override} as override from l where {where}"


MATCHES = f"""with {STATEMENTS}, p as (select doc_id, paragraph as name, string_agg(content, chr(10) order by line_no) as code from st group by all), u as (select *, lower(name) as n, lower(code) as c from p),
l as (select *, {LABEL} as label from u), m as ({' union all '.join(sql_rule(*r) for r in RULES)})
select doc_id, name, rule, ord from (select *, coalesce(max(case when override then ord end) over (partition by doc_id, name), -1) as cut from m) where ord >= cut"""
PARAGRAPHS = f"""{STATEMENTS}, {PERFORMS[len(SECTIONS) + 2 :]}, last as (select doc_id, max(line_no) as last from lines group by doc_id),
pr as (select doc_id, pname as name, line_no as start_line, coalesce(lead(line_no) over (partition by doc_id order by line_no) - 1, last) as end_line from sec join last using (doc_id) where begins),
sf as (select doc_id, paragraph as name, count(*) as n, list(distinct type) as types, arg_min(content, line_no) as code from st group by all), rf as (select doc_id, target as name, count(*) as refs from pf where form is not null group by all),
sp as (select pr.*, coalesce(n, 0) as n, coalesce(types, []) as types, coalesce(code, '') as code, coalesce(refs, 0) as refs, upper(name) as up, lower(name) as low from pr left join sf using (doc_id, name) left join rf using (doc_id, name)),
sc as (select *, cast(greatest(0, 55 + {' + '.join(f"case when {' or '.join(f'contains(low, {quoted(x)})' for x in parts)} then {points} else 0 end" for points, parts in structure.NAME_GROUPS)}
+ case when n > 0 then 10 else 0 end + {' + '.join(f"case when n >= {k} then 5 else 0 end" for k in (1, 3, 5, 10, 20, 50))} - case when n = 1 then 5 else 0 end + case when n between 5 and 30 then 10 else 0 end
+ case when refs = 0 then 0 when refs = 1 then 8 when refs <= 3 then 15 else 20 end + {' + '.join(f"case when list_contains(types, {quoted(t)}) then {v} else 0 end" for t, v in structure.STATEMENT_BONUS.items())} + case when len(types) > 0 then 2 else 0 end
+ case when length(name) between 3 and 30 then 5 else 0 end + case when regexp_matches(name, '^[A-Za-z]') then 5 else 0 end + case when regexp_full_match(name, '[A-Za-z0-9_-]+') then 5 else 0 end
+ case when regexp_matches(name, '[a-z][A-Z]') or contains(name, '-') then 3 else 0 end + case when length(name) > 5 and not (name = up and regexp_matches(name, '[A-Z]')) then 2 else 0 end
- ({' + '.join(f"case when contains(up, {quoted(h)}) then 30 else 0 end" for h in structure.HEADERS)}) - case when regexp_matches(up, '^(WS|LS|FD|SD)[A-Z]') then 20 else 0 end - case when length(name) <= 2 then 10 else 0 end - case when n = 0 then 15 else 0 end
- case when n = 1 and starts_with(trim(code), '*') then 10 else 0 end - case when starts_with(up, 'END-') then 25 else 0 end - case when up in ({VERB_NAMES}) then 20 else 0 end) as int) as score from sp),
scores as (select * from sc where score >= 35 and not regexp_full_match(up, '[0-9]+') and not ({' or '.join(f"contains(up, {quoted(w)})" for w in checks.FALSE_NAMES)}) and not starts_with(up, 'END-') and not regexp_matches(up, '[0-9][0-9]'))""".replace(r"\z", "$")


def _budget_sql():
    from .corpus import CHUNKS

    points = " ".join(f"when {' or '.join(f'contains(upper(name), {quoted(x)})' for x in parts)} then {v}" for v, parts in prompts.IMPORTANCE)
    return f"""with recursive {CHUNKS}, pk as (select doc_id, printf('%06d %s', chunk_id, coalesce(name, '-')) as name, end_line - start_line + 1 as n from c),
    po as (select *, row_number() over (partition by doc_id order by case {points} else 20 end + least(n, 50) desc, name, n) as k from pk),
    pw as (select doc_id, k, case when n <= 15 then 40 - n else 40 end as room, n <= 15 as taken from po where k = 1
    union all select po.doc_id, po.k, case when po.n <= 15 and po.n <= pw.room then pw.room - po.n else pw.room end, po.n <= 15 and po.n <= pw.room from pw join po on po.doc_id = pw.doc_id and po.k = pw.k + 1)
    select doc_id, count(*) as procedures, count(*) filter (taken) as taken from pw group by doc_id"""


def statement_chain(spark, sf):
    rows = structure.statements(lines_of(spark, PROGRAM)).withColumn("proc", F.concat_ws("/", "doc_id", "paragraph"))
    return chunking.block_chain(chunking.blocks(rows.withColumn("line", F.col("line_no"))))


def joined_statements(spark, sf):
    """Statements of several lines: one ends at a period."""
    return chunking.statement_groups(lines_of(spark, PROGRAM), F.lit(False), F.rtrim("line").endswith("."))


JOINED = f"""with {sql_lines(PROGRAM)}, b as (select *, coalesce(lag(ends_with(rtrim(line), '.')) over (partition by doc_id order by line_no), true) as begins from lines),
g as (select *, sum(cast(begins as int)) over (partition by doc_id order by line_no) as statement from b)
select doc_id, cast(statement as bigint) as statement, min(line_no) as start_line, max(line_no) as end_line, string_agg(trim(line), ' ' order by line_no) as content from g group by all"""


def linked_events(spark, sf):
    """Edges to node ids by name in any case; of several nodes with one name the last counts."""
    edges = event_edges(spark, sf)
    nodes = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.upper("event_type").alias("name"))
    return graphs.linked(edges, nodes).groupBy("doc_id", "target", "callee_id").agg(F.count("*").alias("n"))


def variant_counts(spark, sf):
    edges = event_edges(spark, sf).withColumn("target", F.when(F.col("doc_id") % 2 == 0, F.upper("target")).otherwise(F.col("target")))
    counts = edges.groupBy("doc_id", F.col("target").alias("name")).agg(F.count("*").alias("refs"))
    return graphs.best_variant_count(edges.select("doc_id", F.lower("target").alias("name")).distinct(), counts)


def merged_procedures(spark, sf):
    """First and second half of the events as two lists of procedures."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    side = lambda odd, up: events.where(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").alias("doc_id"), up("event_type").alias("name")).agg(F.count("*").alias("statements"), F.floor(F.max("value")).alias("score"))
    return graphs.merged(side(0, F.lower), side(1, F.upper))


SIDE = "select user_id as doc_id, {0}(event_type) as name, count(*) as statements, cast(floor(max(value)) as bigint) as score from events where event_id % 2 = {1} group by all"


def added_procedures(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    names = lambda rows: rows.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name")).distinct()
    return graphs.added(names(events.where("event_id % 2 = 0")), names(events))


def budget_packing(spark, sf):
    from .corpus import chunked

    rows = chunked(spark, sf).select("doc_id", F.format_string("%06d %s", "chunk_id", F.coalesce("name", F.lit("-"))).alias("name"), (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
    return prompts.packed(rows.withColumn("importance", prompts.importance(F.col("name"), F.col("n_lines"))), 40, 15).groupBy("doc_id").agg(F.count("*").alias("procedures"), F.count_if("taken").alias("taken"))


QUERIES = {
    "cobol_statements": (cobol_statements, f"with {STATEMENTS} select * from st"),
    "cobol_performs": (cobol_performs, f"with {PERFORMS} select * from pf where form is not null".replace(r"\z", "$")),
    "cobol_calls": (cobol_calls, CALLS),
    "cobol_copies": (cobol_copies, COPIES),
    "cobol_data_items": (cobol_data_items, ITEMS),
    "external_calls": (external_calls, EXTERNAL.replace(r"\z", "$")),
    "reference_coverage": (reference_coverage, COVERAGE.replace(r"\z", "$")),
    "program_classes": (program_classes, CLASSES),
    "procedure_scores": (procedure_scores, f"with {PARAGRAPHS} select name as paragraph, start_line, end_line, n as statements, refs, score from scores"),
    "statement_blocks": (statement_blocks, BLOCKS),
    "procedure_texts": (procedure_texts, LOGIC),
    "tal_statements": (tal_statements, f"with {TAL_SQL} select * from tal"),
    "tal_scores": (tal_scores, TAL_SCORES),
    "call_graph_nodes": (call_graph_nodes, f"with {NODES} select * from nodes"),
    "graph_callers": (graph_callers, f"with {EDGES} select doc_id, target, string_agg(distinct caller, ',' order by caller) as callers, count(*) as n from edges group by all"),
    "graph_classes": (graph_classes, GRAPH),
    "call_patterns": (call_patterns, f"with {NODES} select n.doc_id, n.name, n.calls, case when n.calls = 0 then 'Entry Points' when exists (select 1 from edges e where e.doc_id = n.doc_id and e.caller = n.name) then 'Business Logic' else 'Utility' end as \"group\" from nodes n"),
    "reference_counts": (reference_counts, f"with {EDGES} select doc_id, upper(target) as name, count(*) as refs from edges group by all"),
    "fill_forward_sections": (fill_forward_sections, "select conv_id, turn, turn as asked, coalesce(lead(turn) over (partition by conv_id order by turn) - 1, 1000) as end_line from conversations where role = 'user'"),
    "statement_mix_class": (statement_mix_class, EVENT_MIX),
    "nearest_assignment": (nearest_assignment, "select c_custkey, s_name as nearest from customer join supplier on c_nationkey = s_nationkey qualify row_number() over (partition by c_custkey order by abs(c_acctbal - s_acctbal), s_suppkey) = 1"),
    "rule_matches": (rule_matches, MATCHES),
    "budget_packing": (budget_packing, _budget_sql()),
    "statement_chain": (statement_chain, f"with recursive b as ({BLOCKS}) select proc, block, next from (select proc, block, lead(block) over (partition by proc order by block) as next from b) where next is not null"),
    "joined_statements": (joined_statements, JOINED),
    "linked_events": (linked_events, f"with {EDGES}, n as (select user_id as doc_id, lower(event_type) as key, max(event_id) as callee_id from events group by all) select e.doc_id, target, callee_id, count(*) as n from edges e join n on n.doc_id = e.doc_id and n.key = lower(target) group by all"),
    "edge_variant_counts": (variant_counts, f"with {EDGES} select doc_id, lower(target) as name, count(*) as refs from edges group by all"),
    "event_merged_procedures": (merged_procedures, f"with a as ({SIDE.format('lower', 0)}), b as ({SIDE.format('upper', 1)}) select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.name, b.name) as name, coalesce(b.statements, a.statements) as statements, greatest(a.score, b.score) as score from a full join b on a.doc_id = b.doc_id and upper(a.name) = upper(b.name)"),
    "event_added_procedures": (added_procedures, "select distinct user_id as doc_id, event_type as name from events"),
}
