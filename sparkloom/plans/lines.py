"""Queries over source lines, names, values and edges that both engines derive from the driver's tables, and round trips of the sinks.

The tables hold no source code. So an event is a line of the program of its user, in the order of event ids, its text
chosen from LINES; parts and orders give names, values and edges.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as fx
from ..operators import catalog, chunking, graphs, lexicons, prompts, structure, weights
from ..sources import readers, storage, tables, writers
from .checks import quoted
from .corpus import WORDS, docs

LINES = [
    "MOVE A-1 TO B-2.", "IF A-1 > 1", "END-IF.", "EXEC SQL", "END-EXEC.", "PERFORM STEP-A.", "READ FILE-1.", "* a note", "  ", "// more", "ADD 1 TO A-1", "CONTINUE", 'DISPLAY "A \\ B".', "OPEN INPUT F.", "SET A-1 TO 1.",
]
SOURCE_SQL = f"s as (select user_id as doc_id, event_id as line_no, 'PARA-' || chr(cast(65 + (event_id // 1000) % 7 as int)) as paragraph, list_value({', '.join(map(quoted, LINES))})[cast((event_id * event_id + 7 * user_id) % {len(LINES)} + 1 as int)] as line from events)"


def source(spark, sf):
    events = tables.read(spark, sf, "events")
    at = (F.col("event_id") * F.col("event_id") + 7 * F.col("user_id")) % len(LINES)
    paragraph = F.concat(F.lit("PARA-"), F.chr(65 + F.floor(F.col("event_id") / 1000) % 7))
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), paragraph.alias("paragraph"), F.get(F.array(*map(F.lit, LINES)), at.cast("int")).alias("line"))


def typed(spark, sf):
    rows = source(spark, sf)
    return rows.select("doc_id", "line_no", "paragraph", structure.statement_type(F.col("line")).alias("type"), F.trim("line").alias("content"))


_UP = "upper(trim(line))"
TYPE = "case " + " ".join(f"when starts_with({_UP}, '{v}') then '{v.replace(' ', '_')}'" for v in structure.VERBS) + " " + " ".join(f"when contains({_UP}, '{e}') then '{e}'" for e in structure.ENDINGS) + " else 'STATEMENT' end"
TYPED = f"{SOURCE_SQL}, t as (select doc_id, line_no, paragraph, {TYPE} as type, trim(line) as content from s)"
COUNTED = f"{TYPED}, n as (select doc_id, paragraph, type, count(*) as n from t group by all)"


def statement_type_counts(spark, sf):
    return structure.type_counts(typed(spark, sf), "doc_id", "paragraph")


def dominant_statement_types(spark, sf):
    return structure.dominant_types(statement_type_counts(spark, sf), "doc_id", "paragraph")


def procedure_class_counts(spark, sf):
    return structure.class_counts(structure.mix(typed(spark, sf)))


def _n(*types):
    return f"count(*) filter (type in ({', '.join(map(quoted, types))}))"


CLASSES = f"""with {TYPED}, m as (select doc_id, paragraph, {_n('EXEC_SQL', 'END-EXEC')} as a, {_n('MOVE', 'SET', 'INITIALIZE')} as d, {_n('READ', 'WRITE', 'OPEN', 'CLOSE')} as f, {_n('IF', 'PERFORM', 'EVALUATE')} as c from t group by all)
select class, count(*) as n from (select case when a + d + f + c = 0 then 'execution' when a / (a + d + f + c) > 0.4 then 'sql' when contains(lower(paragraph), 'main') then 'main' when f / (a + d + f + c) > 0.4 then 'file'
when d / (a + d + f + c) > 0.6 then 'data' when c / (a + d + f + c) > 0.4 then 'control' else 'mixed' end as class from m) group by class"""


def configured_types(spark, sf):
    return source(spark, sf).select("doc_id", "line_no", structure.configured_type(F.col("line")).alias("type"))


CONFIGURED = f"""with {SOURCE_SQL} select doc_id, line_no, case {' '.join(rf"when regexp_full_match({_UP}, '{p}') then '{k}'" for k, p in (("EXEC_SQL", "EXEC\\s+SQL.*"), *((v, rf"{v}\s+.*") for v in ("PERFORM", "MOVE", "IF", "SET", "EVALUATE", "INITIALIZE", "ADD")), ("CONTINUE", "CONTINUE\\s*"), ("END_CLAUSE", ".*(END-[A-Z]+|WHEN|ELSE|THEN|UNTIL).*")))}
else 'STATEMENT' end as type from s"""


def kept_lines(spark, sf):
    return source(spark, sf).where(~checks.skipped_line(F.col("line"))).select("doc_id", "line_no", "line")


def joined_lines(spark, sf):
    rows = source(spark, sf)
    found = chunking.statement_groups(rows, F.col("line").rlike("^(IF|EXEC SQL)"), F.col("line").endswith("."))
    return found.select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


GROUPED = f"""with {SOURCE_SQL}, b as (select *, case when starts_with(line, 'IF') or starts_with(line, 'EXEC SQL') or coalesce(lag(ends_with(line, '.')) over (partition by doc_id order by line_no), true) then 1 else 0 end as begins from s),
g as (select *, sum(begins) over (partition by doc_id order by line_no) as g from b) select doc_id, min(line_no) as start_line, max(line_no) as end_line, md5(string_agg(trim(line), ' ' order by line_no)) as digest from g group by doc_id, g.g"""


def line_chain(spark, sf):
    rows = source(spark, sf).where(F.col("line").startswith("EXEC SQL"))
    return chunking.block_chain(rows.select(F.col("doc_id").alias("proc"), F.col("line_no").alias("block")))


def block_ends(spark, sf):
    rows = source(spark, sf)
    return chunking.depth_end(rows, F.col("line").startswith("IF"), F.col("line").startswith("END-IF"), ["doc_id", "paragraph"])


ENDS = f"""with {SOURCE_SQL}, d as (select *, starts_with(line, 'END-IF') as closes, sum(cast(starts_with(line, 'IF') as int) - cast(starts_with(line, 'END-IF') as int)) over (partition by doc_id, paragraph order by line_no) as depth from s)
select doc_id, paragraph, coalesce(min(line_no) filter (depth <= 0 and closes), min(line_no) + 50) as end_line from d group by all"""


def analysis(spark, sf):
    """Statement texts as S-expressions and their procedures; scores are those of the statement counts."""
    rows = typed(spark, sf)
    procs = rows.groupBy("doc_id", "paragraph").agg(F.count("*").cast("int").alias("score"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return prompts.s_expression(procs, rows)


def analysis_statements(spark, sf):
    return prompts.parse_s_expression(analysis(spark, sf))


def analysis_procedures(spark, sf):
    texts = analysis(spark, sf).select("doc_id", F.regexp_replace("text", r"\((SCORE|START-LINE|STATEMENTS)", "\n($1").alias("text"))
    return prompts.parse_procedures(readers.lines(texts, "doc_id", "text"))


# Names from parts, in five shapes, and values from orders.
NAMES_SQL = """n as (select p_partkey, case p_partkey % 6 when 0 then 'END-' || p_brand when 1 then 'ws' || p_type when 2 then p_name[1:2] when 3 then upper(replace(p_name, ' ', '-')) || '-OF-TYPE-' || p_type when 4 then 'Spaces' else replace(p_name, ' ', '_') end as name,
case p_partkey % 6 when 0 then cast(p_partkey as varchar) when 1 then '''' || p_name when 2 then 'High-Values' when 3 then p_name when 4 then ' .5' else '' end as item from part)"""


def part_names(spark, sf):
    k, up = F.col("p_partkey") % 6, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))
    name = F.when(k == 0, F.concat(F.lit("END-"), "p_brand")).when(k == 1, F.concat(F.lit("ws"), "p_type")).when(k == 2, F.substring("p_name", 1, 2)).when(k == 3, F.concat(up, F.lit("-OF-TYPE-"), "p_type"))
    item = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, F.concat(F.lit("'"), "p_name")).when(k == 2, "High-Values").when(k == 3, F.col("p_name")).when(k == 4, " .5").otherwise("")
    return tables.read(spark, sf, "part").select("p_partkey", name.when(k == 4, "Spaces").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), item.alias("item"))


def name_rules(spark, sf):
    name = F.col("name")
    return part_names(spark, sf).select(
        "p_partkey", checks.excluded_name(name).alias("excluded"), checks.false_paragraph(name).alias("false_name"), checks.procedure_name(name).alias("valid"), checks.referenced_item(F.col("item")).alias("referenced"),
        fx.identifier(name).alias("identifier"), fx.display_name(name).alias("shown"), fx.pascal(name).alias("pascal"), fx.camel(name).alias("camel"),
    )


def _isin(c, words):
    return f"{c} in ({', '.join(map(quoted, words))})"


_PARTS = "list_filter(regexp_split_to_array(lower(name), '[-_ ]+'), lambda p: p <> '')"
NAME_RULES = f"""with {NAMES_SQL} select p_partkey, trim(name) = '' or {_isin('upper(name)', checks.EXCLUDED_NAMES)} or starts_with(upper(name), 'END-') or regexp_matches(upper(name), '^(WS|LS|FD|SD)[A-Z]') or length(name) <= 2 or (upper(name) = name and length(name) > 25) as excluded,
regexp_full_match(name, '[0-9]+') or {' or '.join(f"contains(upper(name), '{w}')" for w in checks.FALSE_NAMES)} or starts_with(upper(name), 'END-') or regexp_matches(name, '[0-9][0-9]') as false_name,
length(name) between 3 and 30 and regexp_full_match(name, '[A-Za-z][A-Za-z0-9_-]*') and not {_isin('upper(name)', checks.FALSE_NAMES)} as valid,
trim(item) <> '' and not regexp_full_match(trim(item), '[0-9]*\\.?[0-9]+') and trim(item)[1] not in ('''', '"') and not {_isin('upper(trim(item))', checks.FIGURATIVE)} as referenced,
regexp_replace(name, '[^A-Za-z0-9_-]', '', 'g') as identifier, case when length(name) > 12 then name[1:9] || '...' else name end as shown, array_to_string(list_transform({_PARTS}, lambda p: upper(p[1]) || p[2:]), '') as pascal,
array_to_string(list_transform({_PARTS}, lambda p, i: case when i = 1 then p else upper(p[1]) || p[2:] end), '') as camel from n"""


def value_rules(spark, sf):
    orders = tables.read(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    word = F.get(F.split("o_orderpriority", "[- ]"), F.lit(1))
    return orders.select(
        "o_orderkey", checks.listed(word, "Priority2Code").alias("listed"), checks.listed(word, "NoSuchCode").alias("unknown"), checks.code_length(word, "ExternalServiceLevel1Code").alias("short"),
        checks.decimal_digits(price, 7, 2).alias("digits"), checks.matches(F.col("o_orderpriority"), "Max15NumericText").alias("numeric"), checks.allowed_file(F.concat(F.lit("a."), "o_orderpriority", F.lit(".Txt"))).alias("text_file"), checks.allowed_file(F.col("o_orderpriority")).alias("other_file"),
    )


VALUE_RULES = """with v as (select o_orderkey, o_orderpriority, regexp_split_to_array(o_orderpriority, '[- ]')[2] as word, cast(cast(o_totalprice as decimal(18,2)) as varchar) as price from orders)
select o_orderkey, word in ('HIGH', 'NORM') as listed, true as unknown, length(word) between 1 and 4 as short, regexp_full_match(price, '[0-9]+(\\.[0-9]*)?') and length(replace(price, '.', '')) <= 7 and length(coalesce(string_split(price, '.')[2], '')) <= 2 as digits,
regexp_full_match(o_orderpriority, '[0-9]{1,15}') as numeric, true as text_file, false as other_file from v"""


def diagram_roles(spark, sf):
    return graphs.with_role(tables.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("color")), {"F": "Closed", "O": "Open"})


# Edges from line items, nodes from parts: a supplier is a document.
EDGES_SQL = "e as (select l_suppkey as doc_id, 'P_' || (l_partkey % 9) as caller, case when l_partkey % 2 = 0 then 'p-' else 'P_' end || (l_orderkey % 12) as target from lineitem)"
NODES_SQL = "k as (select p_partkey % 100 + 1 as doc_id, p_partkey as id, 'p_' || (p_size % 15) as name, cast(p_size as bigint) as statements, cast(p_partkey % 50 as bigint) as score from part)"


def edges(spark, sf):
    text = lambda c, m: (F.col(c) % m).cast("string")
    head = F.when(F.col("l_partkey") % 2 == 0, "p-").otherwise("P_")
    return tables.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("P_"), text("l_partkey", 9)).alias("caller"), F.concat(head, text("l_orderkey", 12)).alias("target"))


def nodes(spark, sf):
    name = F.concat(F.lit("p_"), (F.col("p_size") % 15).cast("string"))
    return tables.read(spark, sf, "part").select((F.col("p_partkey") % 100 + 1).alias("doc_id"), F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").cast("long").alias("statements"), (F.col("p_partkey") % 50).alias("score"))


def linked_calls(spark, sf):
    return graphs.linked(edges(spark, sf).distinct(), nodes(spark, sf))


LINKED = f"with {EDGES_SQL}, {NODES_SQL}, l as (select doc_id, lower(name) as key, max(id) as callee_id from k group by all) select d.doc_id, d.caller, d.target, l.callee_id from (select distinct * from e) d join l on l.doc_id = d.doc_id and l.key = lower(d.target)"


def _two(spark, sf):
    rows = nodes(spark, sf).groupBy("doc_id", "name").agg(F.sum("statements").alias("statements"), F.max("score").alias("score"))
    part = lambda c: rows.where(c)
    return part("score % 3 <> 0"), part("score % 3 <> 1").withColumn("name", F.upper("name")).withColumn("score", F.col("score") + 1)


TWO = f"{NODES_SQL}, g as (select doc_id, name, cast(sum(statements) as bigint) as statements, max(score) as score from k group by all), a as (select * from g where score % 3 <> 0), b as (select doc_id, upper(name) as name, statements, score + 1 as score from g where score % 3 <> 1)"


def merged_procedures(spark, sf):
    return graphs.merged(*_two(spark, sf))


def added_procedures(spark, sf):
    return graphs.added(*_two(spark, sf), any_case=True)


def variant_counts(spark, sf):
    names = nodes(spark, sf).select("doc_id", "name").distinct()
    return graphs.best_variant_count(names, graphs.reference_counts(edges(spark, sf)))


VARIANTS = f"""with {EDGES_SQL}, {NODES_SQL}, c as (select doc_id, upper(target) as name, count(*) as refs from e group by all), d as (select distinct doc_id, name from k),
x as (select distinct doc_id, name, unnest([name, upper(name), lower(name), replace(name, '_', '-'), regexp_replace(name, '[-_]', '', 'g')]) as key from d)
select x.doc_id, x.name, coalesce(max(c.refs), 0) as refs from x left join c on c.doc_id = x.doc_id and c.name = x.key group by all"""


# Text functions over documents; `the ` stands for a type keyword.
DOMAIN, STOP = ["license", "of", "token", "que"], ["the", "and", "les"]


def text_functions(spark, sf):
    text, words = F.col("text"), fx.words_of(F.col("text"))
    join = lambda c: F.md5(F.array_join(c, ","))
    return docs(spark, sf).select(
        "doc_id", join(fx.query_words(words, DOMAIN, STOP)).alias("query_words"), join(fx.domain_first(words, DOMAIN, 40)).alias("domain_first"), F.array_join(fx.declared_variables(F.replace(text, F.lit("the "), F.lit("int "))), ",").alias("variables"),
        F.array_join(fx.tags(text, fx.TRANSACTION_PATTERNS), ",").alias("kinds"), F.md5(fx.clean_code(text)).alias("clean"), F.md5(fx.escaped(fx.shortened(text, 150))).alias("escaped"), fx.block_colour(F.upper("lang")).alias("colour"),
        F.md5(fx.in_context(F.col("source"), F.array(F.lit("a"), F.col("lang")), F.lit("s"), text)).alias("context"), F.array_join(fx.secondary_labels(text), ",").alias("labels"),
    )


def _list(words):
    return "[" + ", ".join(map(quoted, words)) + "]"


_ALL_WORDS = WORDS.replace("length(w) >= 3 and ", "")
_LINE = "trim(x)"
TEXTS = rf"""with w as (select *, {_ALL_WORDS} as words from documents), d as (select *, list_filter(words, lambda x: list_contains({_list(DOMAIN)}, x)) as own from w)
select doc_id, md5(array_to_string(list_filter(words, lambda x: list_contains({_list(DOMAIN)}, x) or (not list_contains({_list(STOP)}, x) and length(x) >= 3)), ',')) as query_words,
md5(array_to_string((own[1:15] || list_filter(words, lambda x: not list_contains({_list(DOMAIN)}, x)))[1:40], ',')) as domain_first,
array_to_string(list_sort(list_distinct(regexp_extract_all(replace(text, 'the ', 'int '), '(?i)(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])(?:int|string|char)\s+([a-z_][a-z0-9_]*)', 1))), ',') as variables,
array_to_string(list_filter([{', '.join(f"case when regexp_matches(lower(text), '{p}') then '{k}' end" for k, p in fx.TRANSACTION_PATTERNS.items())}], lambda x: x is not null), ',') as kinds,
md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: {_LINE} <> '' and not starts_with({_LINE}, '!') and not starts_with({_LINE}, '//')), lambda x: rtrim(regexp_replace(x, '!.*$', ''))), chr(10))) as clean,
md5(replace(replace(replace(replace(replace(case when length(text) > 150 then text[1:147] || '...' else text end, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) as escaped, '#CFD8DC' as colour,
md5('Document: ' || source || chr(10) || 'Keywords: a, ' || lang || chr(10) || 'Summary: s' || chr(10) || 'Content: ' || text) as context,
concat_ws(',', case when contains(lower(text), 'if ') or contains(lower(text), 'evaluate') then 'ERROR_HANDLING' end, case when contains(lower(text), 'perform ') then 'ORCHESTRATION' end) as labels from d"""


def chunk_keywords(spark, sf):
    words = F.array_sort(F.array_distinct(fx.kept_words(fx.words_of(F.col("text")))))
    found = lexicons.keywords(words, fx.called_functions(F.col("text")), F.col("source"), F.array_intersect(words, F.array(*map(F.lit, DOMAIN))))
    return docs(spark, sf).select("doc_id", F.array_join(found, ",").alias("keywords"))


KEYWORDS = rf"""with w as (select *, list_sort(list_distinct({WORDS})) as words, list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1))) as calls from documents),
a as (select doc_id, words[1:8] || calls[1:3] || [source] || list_sort(list_filter(words, lambda x: list_contains({_list(DOMAIN)}, x)))[1:3] as parts from w), u as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from a),
f as (select doc_id, part, min(i) as i from u group by doc_id, part), k as (select * from f qualify row_number() over (partition by doc_id order by i) <= 10) select doc_id, string_agg(part, ',' order by i) as keywords from k group by doc_id"""


# Round trips: written to the folder for intermediate tables and read again.
def stored_corpus(spark, sf):
    path = storage.place(spark, "corpus")
    writers.save_corpus(docs(spark, sf).withColumn("name", F.col("source")), path, writers.FLOW_VERSION, "lang")
    rows = readers.corpus(spark, f"{path}/chunks", {"category": "general"})
    return rows.groupBy("lang", "corpus_version", "category").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.md5(F.array_join(F.array_sort(F.collect_set(F.md5("text"))), ",")).alias("digest"))


STORED = f"select lang, '{writers.FLOW_VERSION}' as corpus_version, 'general' as category, count(*) as n, cast(sum(length(text)) as bigint) as chars, md5(string_agg(distinct md5(text), ',' order by md5(text))) as digest from documents group by lang"


def corpus_summary(spark, sf):
    path = storage.place(spark, "corpus")
    writers.save_corpus(docs(spark, sf).withColumn("name", F.col("source")), path, writers.WIRE_VERSION)
    return spark.read.json(f"{path}/summary").select("version", "total_chunks", F.array_join("sample_names", ",").alias("names"))


SUMMARY = f"select '{writers.WIRE_VERSION}' as version, count(*) as total_chunks, array_to_string(list_sort(list_distinct(list(source)))[1:15], ',') as names from documents"


def stored_results(spark, sf):
    path = storage.place(spark, "results")
    writers.save_results(tables.read(spark, sf, "pages").select("page_id", fx.called_functions(F.col("html")).alias("function_calls")), path)
    return spark.read.schema("page_id long, function_calls array<string>").json(path).select("page_id", F.array_join("function_calls", ",").alias("calls"))


RESULTS = r"select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?:^|[^A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1)))[1:5], ',') as calls from pages"


def stored_catalog(spark, sf):
    """One document of each source is indexed again over the stored catalog."""
    path = storage.place(spark, "catalog")
    rows = docs(spark, sf).select(F.col("doc_id").cast("string").alias("name"), "text", "source")
    writers.save_catalog(catalog.fingerprint(rows, "name", "text"), path)
    new = rows.withColumn("first", F.min(F.col("name").cast("long")).over(Window.partitionBy("source"))).where("cast(name as long) = first").withColumn("text", F.concat(F.lit("new"), "text"))
    return catalog.upsert_one(spark.read.parquet(path), catalog.fingerprint(new, "name", "text")).select("name", "hash")


CATALOG = "select cast(doc_id as varchar) as name, case when doc_id = min(doc_id) over (partition by source) then md5('new' || text) else md5(text) end as hash from documents"


def stored_graph(spark, sf):
    path = storage.place(spark, "graph")
    writers.graph_json(nodes(spark, sf), edges(spark, sf), path)
    found = spark.read.schema("doc_id long, caller string, target string").json(f"{path}/edges")
    return found.groupBy("doc_id", "caller", "target").agg(F.count("*").alias("n"))


def stored_images(spark, sf):
    """Documents as images with their words as keywords, through the vector sink."""
    path = storage.place(spark, "images")
    words = F.slice(F.array_distinct(fx.kept_words(fx.words_of(F.col("text")))), 1, 12)
    rows = docs(spark, sf).select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("full_path"), words.alias("keywords"))
    writers.save_images(rows.where("size(keywords) > 0"), path, DOMAIN)
    return spark.read.parquet(f"{path}/images").select("name", "full_path", "vector_type", F.array_join(F.transform("keyword_vector", lambda x: x.cast("string")), "").alias("vector"))


IMAGES = f"""with w as (select *, {WORDS} as words from documents), u as (select doc_id, source, unnest(words) as w, generate_subscripts(words, 1) as i from w), f as (select doc_id, source, w, min(i) as i from u group by all),
k as (select doc_id, source, w from f qualify row_number() over (partition by doc_id order by i) <= 12)
select cast(doc_id as varchar) as name, any_value(source) as full_path, 'binary' as vector_type, {' || '.join(f"cast(cast(bool_or(w = '{d}') as int) as varchar)" for d in DOMAIN)} as vector from k group by doc_id"""

QUERIES = {
    "statement_type_counts": (statement_type_counts, f"with {COUNTED} select * from n"),
    "dominant_statement_types": (dominant_statement_types, f"with {COUNTED} select doc_id, paragraph, first(type order by n desc, type) as type, max(n) as n, cast(sum(n) as bigint) as statements from n group by all"),
    "procedure_class_counts": (procedure_class_counts, CLASSES),
    "configured_types": (configured_types, CONFIGURED),
    "kept_lines": (kept_lines, f"with {SOURCE_SQL} select doc_id, line_no, line from s where trim(line) <> '' and not starts_with(trim(line), '*') and not starts_with(trim(line), '//')"),
    "joined_lines": (joined_lines, GROUPED),
    "line_chain": (line_chain, f"with {SOURCE_SQL} select doc_id as proc, line_no as block, lead(line_no) over (partition by doc_id order by line_no) as next from s where starts_with(line, 'EXEC SQL') qualify next is not null"),
    "block_ends": (block_ends, ENDS),
    "analysis_statements": (analysis_statements, f"with {TYPED} select doc_id, paragraph, type, content, cast(line_no as int) as line_no from t"),
    "analysis_procedures": (analysis_procedures, f"with {TYPED} select doc_id, paragraph, cast(count(*) as double) as score, cast(min(line_no) as int) as start_line, cast(max(line_no) as int) as end_line from t group by all"),
    "name_rules": (name_rules, NAME_RULES),
    "value_rules": (value_rules, VALUE_RULES),
    "diagram_roles": (diagram_roles, """select o_orderkey, o_orderstatus as color, case o_orderstatus when 'F' then 'Closed' when 'O' then 'Open' else 'Unknown' end as "group" from orders"""),
    "linked_calls": (linked_calls, LINKED),
    "merged_procedures": (merged_procedures, f"with {TWO} select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.name, b.name) as name, coalesce(b.statements, a.statements) as statements, greatest(a.score, b.score) as score from a full join b on a.doc_id = b.doc_id and upper(a.name) = b.name"),
    "added_procedures": (added_procedures, f"with {TWO} select * from a union all select * from b where not exists (select 1 from a where a.doc_id = b.doc_id and upper(a.name) = b.name)"),
    "variant_counts": (variant_counts, VARIANTS),
    "text_functions": (text_functions, TEXTS),
    "chunk_keywords": (chunk_keywords, KEYWORDS),
    "stored_corpus": (stored_corpus, STORED),
    "corpus_summary": (corpus_summary, SUMMARY),
    "stored_results": (stored_results, RESULTS),
    "stored_catalog": (stored_catalog, CATALOG),
    "stored_graph": (stored_graph, f"with {EDGES_SQL} select doc_id, caller, target, count(*) as n from e group by all"),
    "stored_images": (stored_images, IMAGES),
}
