"""Queries of tree readers and writers over trees that both engines derive from the tables: a customer with orders, their lines, and words; and a user's program."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import trees
from ..sources import tables
from . import lines
from .preprocess import quoted

ORDER_TYPES, LINE_TYPES = ["Identifier", "Statement", "QualifiedDataName", "Clause"], ["Literal", "Item", "CobolWord"]
VALUES = ["A", ".", "x y", "it's", "", 'say "B"']
#: Texts with all that needs an escape.
TRICKY = ["C:\\new", "a\tb", 'DISPLAY "X" (1) ; (', "two\nlines\r\n", "\\", '"', "plain", "x" * 149 + "\\\\"]


def customer_trees(spark, sf):
    """The nodes of a tree for each customer, as trees.sorted_by() leaves them: orders are moved with their lines' numbers, and become nodes where they then are."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    node = lambda level, kind, value=F.lit(None).cast("string"): F.struct(F.lit(level).alias("level"), kind.alias("type"), value.alias("value"))
    none = F.array().cast("array<bigint>")
    orders = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"))
    numbers = tables.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("l")).groupBy("o").agg(F.collect_set("l").alias("ls"))
    rows = trees.sorted_by(orders.join(numbers, "o", "left"), "o")
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("doc_id").orderBy("o")) == 1)
    word = lambda j: node(3, F.concat(F.lit("Tok"), j.cast("string")), pick(VALUES, (F.col("o") + j) % 6))
    words = lambda x: F.transform(F.when(x % 7 > 0, F.sequence(F.lit(1).cast("long"), x % 7)).otherwise(none), word)
    own = F.transform(F.sort_array(F.coalesce("ls", none)), lambda x: F.concat(F.array(node(2, pick(LINE_TYPES, x % 3))), words(x)))
    order = F.concat(F.array(node(1, pick(ORDER_TYPES, F.col("o") % 4))), F.flatten(own))
    nodes = F.when(F.col("first"), F.concat(F.array(node(0, F.lit("Program"))), order)).otherwise(order)
    return rows.select("doc_id", F.inline(nodes)).withColumn("terminal", F.col("level") == 3)


def tree_texts(spark, sf):
    return trees.lisp(customer_trees(spark, sf), in_order=True).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def compact_tree_texts(spark, sf):
    return trees.compact_lisp(customer_trees(spark, sf), in_order=True).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _pick(values, at):
    return f"list_value({', '.join(map(quoted, values))})[cast({at} as int) + 1]"


_NODES = f"""o as (select o_custkey as doc_id, o_orderkey as o, {_pick(ORDER_TYPES, 'o_orderkey % 4')} as type from orders),
l as (select o.doc_id, o.o, l, {_pick(LINE_TYPES, 'l % 3')} as type, l % 7 as k from o join (select distinct l_orderkey as o, l_linenumber as l from lineitem) using (o)),
w as (select doc_id, o, l, j, {_pick(VALUES, '(o + j) % 6')} as value from (select *, unnest(range(1, k + 1)) as j from l))"""
_SHORT = "type in ('CobolWord', 'DataName', 'ProgramName', 'Literal', 'IntegerLiteral', 'QualifiedDataName', 'Identifier')"
TREES = f"""with {_NODES},
c0 as (select doc_id, count(*) <= 3 as inline from o group by doc_id),
o0 as (select o.*, n, coalesce(n, 0) <= 3 or {_SHORT} as inline, c0.inline as up, case when c0.inline then 0 else 1 end as d from o join c0 using (doc_id) left join (select o, count(*) as n from l group by o) using (o)),
l0 as (select l.*, k <= 5 or l.{_SHORT} as inline, o0.inline as up, case when o0.inline then 0 else o0.d + 1 end as d from l join o0 using (o)),
w0 as (select w.o, w.l, string_agg(case when l0.inline then ' ' else chr(10) || repeat('  ', l0.d + 1) end || case when value in ('', '.') then 'Tok' || j else value end, '' order by j) as body from w join l0 on l0.o = w.o and l0.l = w.l group by all),
l1 as (select l0.o, l0.l, case when up then ' ' else chr(10) || repeat('  ', d) end || '(' || type || coalesce(body, '') || case when inline or k = 0 then ')' else chr(10) || repeat('  ', d) || ')' end as t from l0 left join w0 using (o, l)),
l2 as (select o, string_agg(t, '' order by l) as body from l1 group by o),
o1 as (select doc_id, o, case when up then ' ' else chr(10) || repeat('  ', d) end || '(' || type || coalesce(body, '') || case when inline or n is null then ')' else chr(10) || repeat('  ', d) || ')' end as t from o0 left join l2 using (o)),
r as (select doc_id, '(Program' || string_agg(t, '' order by o) || case when any_value(inline) then ')' else chr(10) || ')' end as text from o1 join c0 using (doc_id) group by doc_id)
select doc_id, length(text) as n_chars, md5(text) as digest from r"""
COMPACT = f"""with {_NODES},
w0 as (select o, l, string_agg(case when value in ('', '.') then 'Tok' || j when regexp_matches(value, '[ ''"]') then '"' || replace(value, '"', '\\"') || '"' else value end, ' ' order by j) as body from w group by all),
l1 as (select l.o, l.l, case when k = 1 and type in ('CobolWord', 'Literal') then body else '(' || type || coalesce(' ' || body, '') || ')' end as t from l left join w0 using (o, l)),
l2 as (select o, count(*) as n, string_agg(t, ' ' order by l) as body from l1 group by o),
r as (select doc_id, '(Program ' || string_agg(case when n = 1 and type in ('Identifier', 'QualifiedDataName') then body else '(' || type || coalesce(' ' || body, '') || ')' end, ' ' order by o) || ')' as text from o left join l2 using (o) group by doc_id)
select doc_id, length(text) as n_chars, md5(text) as digest from r"""


def statements_of(spark, sf):
    """The lines of lines.source, every eighth with a text full of escapes."""
    tricky = F.get(F.array(*map(F.lit, TRICKY)), (F.col("line_no") % len(TRICKY)).cast("int"))
    name = F.when(F.col("line_no") % 3 == 0, F.concat("paragraph", F.lit(' "Q\\'))).otherwise(F.col("paragraph"))
    rows = lines.typed(spark, sf)
    return rows.select("doc_id", name.alias("paragraph"), "line_no", "type", F.when(F.col("line_no") % 2 == 0, tricky).otherwise(F.col("content")).alias("content"))


def analysis_texts(spark, sf):
    rows = statements_of(spark, sf)
    procs = rows.groupBy("doc_id", "paragraph").agg(F.round(F.count("*") / 4, 2).alias("score"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.concat(F.lit('of "'), F.max("type"), F.lit('"')).alias("reasoning"))
    performs = rows.where("type = 'PERFORM'").groupBy("doc_id", F.col("paragraph").alias("name")).agg(F.count("*").alias("n"))
    metadata = rows.groupBy("doc_id").agg(F.lit("PAYROLL").alias("name"), F.lit("BY (TABLES)").alias("analysis_type"), F.countDistinct("paragraph").alias("procedures_count"), F.count("*").alias("total_statements"))
    return trees.analysis(procs, rows, performs, metadata)


def _facts(spark, sf):
    return trees.facts(analysis_texts(spark, sf))


def tree_statements(spark, sf):
    return trees.statements(_facts(spark, sf))


def tree_distribution(spark, sf):
    return trees.distribution(_facts(spark, sf))


def tree_procedures(spark, sf):
    return trees.procedures(_facts(spark, sf))


def tree_perform_graph(spark, sf):
    return trees.perform_graph(_facts(spark, sf))


def tree_metadata(spark, sf):
    return trees.program_facts(_facts(spark, sf))


def _chars(text):
    return "|| ".join(f"chr({ord(c)})" for c in text) if any(ord(c) < 32 for c in text) else quoted(text)


_READ = f"""{lines.TYPED}, q as (select doc_id, case when line_no % 3 = 0 then paragraph || ' "Q\\' else paragraph end as paragraph, line_no, type,
case when line_no % 2 = 0 then list_value({', '.join(map(_chars, TRICKY))})[cast(line_no % {len(TRICKY)} + 1 as int)] else content end as content from t)"""

QUERIES = {
    "tree_texts": (tree_texts, TREES),
    "compact_tree_texts": (compact_tree_texts, COMPACT),
    "tree_statements": (tree_statements, f"with {_READ} select doc_id, paragraph, type, case when length(content) > 150 then content[1:147] || '...' else content end as content, cast(line_no as int) as line_no from q"),
    "tree_distribution": (tree_distribution, f"with {_READ} select doc_id, paragraph, type, count(*) as n from q group by all union all select doc_id, null, type, count(*) from q group by doc_id, type"),
    "tree_procedures": (
        tree_procedures,
        f"""with {_READ} select doc_id, paragraph, round(count(*) / 4, 2) as score, cast(min(line_no) as int) as start_line, cast(max(line_no) as int) as end_line, 'of "' || max(type) || '"' as reasoning,
        count(*) filter (type = 'PERFORM') as perform_references from q group by doc_id, paragraph""",
    ),
    "tree_perform_graph": (tree_perform_graph, f"with {_READ} select doc_id, paragraph as name, count(*) as n from q where type = 'PERFORM' group by all"),
    "tree_metadata": (
        tree_metadata,
        f"""with {_READ}, m as (select doc_id, count(distinct paragraph) as p, count(*) as n from q group by doc_id) select doc_id, 'name' as key, 'PAYROLL' as value from m union all select doc_id, 'analysis_type', 'BY (TABLES)' from m
        union all select doc_id, 'procedures_count', cast(p as varchar) from m union all select doc_id, 'total_statements', cast(n as varchar) from m""",
    ),
}
