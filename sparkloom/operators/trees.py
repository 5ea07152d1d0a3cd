"""Trees as texts: a reader of S-expressions of any depth and writers of syntax trees, both over brackets in order.

A tree is a line of brackets. In the reader, depth is a running sum, and what a bracket belongs to is the last open bracket of the depth
above: a window over the brackets of one document and depth. The writers get a tree's nodes in order and go through them with the open lists held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx

# Node types that stay on one line, those that a compact text leaves out around an only child, and values without meaning.
INLINE_TYPES = ["CobolWord", "DataName", "ProgramName", "Literal", "IntegerLiteral", "QualifiedDataName", "Identifier"]
WRAPPER_TYPES = ["CobolWord", "QualifiedDataName", "QualifiedDataNameFormat1", "Identifier", "MoveToSendingArea", "Literal", "IntegerLiteral"]
MEANINGLESS = ["", ".", "(", ")", ","]
MOST_CHILDREN, MOST_TERMINALS = 3, 5
ATOM = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"?|[()]|[^\s()"]+'
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
_TOKEN, _ESCAPE, _QUOTE = re.compile(ATOM, re.ASCII), re.compile(r'\\([\s\S]?)|"'), re.compile("[ '\"]")
MOST_ROWS = 20_000


def quoted(text: Column) -> Column:
    """A text in quotes with its escapes."""
    return F.concat(F.lit('"'), fx.escaped(text), F.lit('"'))


def unquoted(text: Column) -> Column:
    """The text that quoted() was given: escapes are undone in one pass, each with what follows it."""
    pieces = F.regexp_extract_all(text, F.lit(r'\\[\s\S]?|"|[^"\\]+'), F.lit(0))

    def undo(p: Column) -> Column:
        known = F.substring(p, 2, 1)
        for letter, meant in ESCAPES.items():
            known = F.when(F.substring(p, 2, 1) == letter, meant).otherwise(known)
        return F.when(p == '"', "").when(p.startswith("\\"), known).otherwise(p)

    return F.array_join(F.transform(pieces, undo), "")


def under(rows: DataFrame, depth: Column, opens: Column, place: str = "place") -> DataFrame:
    """Rows with parent: the last row at or before them that opens at depth - 1 (null: none). Rows need doc_id, place; depth: of the row itself."""
    held = rows.withColumns({"__depth": depth, "__opens": opens})
    child = held.withColumns({"__level": F.col("__depth") - 1, "__open": F.lit(None).cast("long"), "__self": F.lit(True)})
    parent = held.where("__opens").select("doc_id", F.col(place), F.col("__depth").alias("__level"), F.col(place).cast("long").alias("__open"), F.lit(False).alias("__self"))
    by = Window.partitionBy("doc_id", "__level").orderBy(place, F.col("__self").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = child.unionByName(parent, allowMissingColumns=True)
    return both.withColumn("parent", F.last("__open", ignorenulls=True).over(by)).where("__self").drop("__depth", "__opens", "__level", "__open", "__self")


def read(texts: DataFrame) -> DataFrame:
    """Nodes of the S-expressions in doc_id, text: doc_id, place (in order), depth (1: outermost), parent (place of the list around), nth (from
    0 in it), is_list, is_text (quoted), value (of an atom). Brackets and quotes inside quoted texts are text; missing closing brackets close at the end."""
    rows = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ATOM), F.lit(0))).alias("place", "tok"))
    by = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    rows = rows.withColumn("sum", F.sum(step).over(by))
    rows = rows.withColumn("sum", F.col("sum") - F.least(F.min("sum").over(by), F.lit(0))).where("tok <> ')'")  # a closing bracket too many is nothing
    is_list, is_text = F.col("tok") == "(", F.col("tok").startswith('"')
    rows = rows.withColumn("depth", F.col("sum") + F.when(is_list, 0).otherwise(1))
    found = under(rows, F.col("depth"), is_list)
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("place")) - 1
    value = F.when(is_text, unquoted(F.col("tok"))).when(~is_list, F.col("tok"))
    return found.select("doc_id", "place", "depth", "parent", nth.alias("nth"), is_list.alias("is_list"), is_text.alias("is_text"), value.alias("value"))


def lists(nodes: DataFrame) -> DataFrame:
    """doc_id, place, parent, head, atoms (the atoms' values in order, head included), with the heads, atoms and places of the two lists around: up_head, up, up_atoms, top_head, top, top_atoms."""
    atom = F.when(~F.col("is_list"), F.struct("nth", "value"))
    body = nodes.where("parent is not null").groupBy("doc_id", F.col("parent").alias("place")).agg(F.array_sort(F.collect_list(atom)).alias("a"))
    values = F.transform("a", lambda x: x["value"])
    own = nodes.where("is_list").select("doc_id", "place", "parent").join(body, ["doc_id", "place"], "left")
    own = own.select("doc_id", "place", "parent", F.coalesce(values, F.array().cast("array<string>")).alias("atoms")).withColumn("head", F.get("atoms", F.lit(0)))
    up = own.select("doc_id", F.col("place").alias("parent"), F.col("head").alias("up_head"), F.col("atoms").alias("up_atoms"), F.col("parent").alias("top"))
    top = own.select("doc_id", F.col("place").alias("top"), F.col("head").alias("top_head"), F.col("atoms").alias("top_atoms"))
    return own.join(up, ["doc_id", "parent"], "left").join(top, ["doc_id", "top"], "left").withColumnRenamed("parent", "up")


def facts(texts: DataFrame) -> DataFrame:
    """lists(read(texts)), text by text: a text is one row already, so its lists leave it whole, with what is around them, and nothing is
    shuffled. Python holds one text's lists and a batch of texts."""
    atoms, string = T.ArrayType(T.StringType()), T.StringType()
    kinds = [("top", T.LongType()), ("up", T.LongType()), ("place", T.IntegerType()), ("atoms", atoms), ("head", string), ("up_head", string), ("up_atoms", atoms), ("top_head", string), ("top_atoms", atoms)]
    made = T.StructType([texts.schema["doc_id"], *[T.StructField(n, t) for n, t in kinds]])
    arrow = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]

    def batch_of(docs: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]], [f.name for f in made])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, rows = batch.column("doc_id"), [], []
            for k, text in enumerate(batch.column("text")):
                for row in lists_of(text.as_py() or ""):
                    at.append(k)
                    rows.append(row)
                    if len(rows) == MOST_ROWS:
                        yield batch_of(docs, at, rows)
                        at, rows = [], []
            yield batch_of(docs, at, rows)

    return texts.select("doc_id", "text").mapInArrow(found, made)


def lists_of(text: str) -> Iterator[tuple]:
    """(top, up, place, atoms, head, up_head, up_atoms, top_head, top_atoms) of each list of one text, in order."""
    held, open_ = [], []
    for place, found in enumerate(_TOKEN.finditer(text)):
        tok = found[0]
        if tok == "(":
            held.append((place, open_[-1] if open_ else None, []))
            open_.append(len(held) - 1)
        elif tok == ")":
            if open_:
                open_.pop()
        elif open_:
            held[open_[-1]][2].append(_ESCAPE.sub(lambda m: "" if m[1] is None else ESCAPES.get(m[1], m[1]), tok) if tok[0] == '"' else tok)
    for place, up, atoms in held:
        up_place, top, up_atoms = held[up] if up is not None else (None, None, None)
        top_place, _, top_atoms = held[top] if top is not None else (None, None, None)
        yield top_place, up_place, place, atoms, *(x[0] if x else None for x in (atoms, up_atoms)), up_atoms, top_atoms[0] if top_atoms else None, top_atoms


def program_facts(found: DataFrame) -> DataFrame:
    """doc_id, key, value: the program's name and the metadata. found: of lists()."""
    name = found.where("head = 'ENHANCED-COBOL-ANALYSIS'").select("doc_id", F.lit("name").alias("key"), F.get("atoms", F.lit(1)).alias("value"))
    key = F.lower(F.replace("head", F.lit("-"), F.lit("_")))
    return name.unionByName(found.where("up_head = 'METADATA'").select("doc_id", key.alias("key"), F.get("atoms", F.lit(1)).alias("value")))


def distribution(found: DataFrame) -> DataFrame:
    """doc_id, paragraph (null: the program's), type, n."""
    held = found.where("up_head = 'STATEMENT-DISTRIBUTION' and top_head in ('PROCEDURE', 'STATEMENT-ANALYSIS')")
    paragraph = F.when(F.col("top_head") == "PROCEDURE", F.get("top_atoms", F.lit(1)))
    return held.select("doc_id", paragraph.alias("paragraph"), F.col("head").alias("type"), F.get("atoms", F.lit(1)).try_cast("long").alias("n"))


def procedures(found: DataFrame) -> DataFrame:
    """doc_id, paragraph, score, start_line, end_line, reasoning, perform_references."""
    value = lambda k: F.max(F.when(F.col("head") == k, F.get("atoms", F.lit(1))))
    kinds = [("SCORE", "score", "double"), ("START-LINE", "start_line", "int"), ("END-LINE", "end_line", "int"), ("REASONING", "reasoning", "string"), ("PERFORM-REFERENCES", "perform_references", "long")]
    fields = found.where("up_head = 'PROCEDURE'").groupBy("doc_id", F.col("up").alias("place")).agg(*[value(k).try_cast(t).alias(c) for k, c, t in kinds])
    return found.where("head = 'PROCEDURE'").select("doc_id", "place", F.get("atoms", F.lit(1)).alias("paragraph")).join(fields, ["doc_id", "place"], "left").drop("place")


def statements(found: DataFrame) -> DataFrame:
    """doc_id, paragraph, type, content, line_no."""
    held = found.where("up_head = 'STATEMENTS' and top_head = 'PROCEDURE'")
    part = lambda i: F.get("atoms", F.lit(i))
    return held.select("doc_id", F.get("top_atoms", F.lit(1)).alias("paragraph"), part(0).alias("type"), part(1).alias("content"), part(2).try_cast("int").alias("line_no"))


def perform_graph(found: DataFrame) -> DataFrame:
    """doc_id, name, n."""
    return found.where("up_head = 'PERFORM-GRAPH'").select("doc_id", F.col("head").alias("name"), F.get("atoms", F.lit(1)).try_cast("long").alias("n"))


def _joined(order: list[Column | str], text: Column, between: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"]), between)


def analysis(procs: DataFrame, stmts: DataFrame, performs: DataFrame, metadata: DataFrame) -> DataFrame:
    """doc_id, text: a program's analysis, one list a line, statement texts cut at 150.

    procs: doc_id, paragraph, score, start_line, end_line, reasoning; stmts: doc_id, paragraph, line_no, type, content; performs: doc_id,
    name, n; metadata: doc_id, name and one column for each fact (a text is quoted)."""
    line = F.format_string("        (%s %s %d)", "type", quoted(fx.shortened(F.coalesce("content", F.lit("")), 150)), "line_no")
    body = stmts.groupBy("doc_id", "paragraph").agg(_joined(["line_no"], line).alias("body"))
    kinds = stmts.groupBy("doc_id", "paragraph", "type").agg(F.count("*").alias("n"))
    by_kind = kinds.groupBy("doc_id", "paragraph").agg(_joined([(-F.col("n")).alias("k"), "type"], F.format_string("        (%s %d)", "type", "n")).alias("kinds"))
    refs = performs.select("doc_id", F.col("name").alias("paragraph"), F.col("n").alias("refs"))
    rows = procs.join(body, ["doc_id", "paragraph"], "left").join(by_kind, ["doc_id", "paragraph"], "left").join(refs, ["doc_id", "paragraph"], "left")
    block = lambda name, column: F.concat(F.lit(f"      ({name}"), F.coalesce(F.concat(F.lit("\n"), column, F.lit("\n      )")), F.lit(")")))
    one = F.concat_ws(
        "\n", F.concat(F.lit("    (PROCEDURE "), quoted(F.col("paragraph"))), F.format_string("      (SCORE %s)", F.col("score").cast("string")),
        F.format_string("      (START-LINE %d)", "start_line"), F.format_string("      (END-LINE %d)", "end_line"), F.format_string("      (REASONING %s)", quoted(F.coalesce("reasoning", F.lit("")))),
        F.format_string("      (PERFORM-REFERENCES %d)", F.coalesce("refs", F.lit(0)).cast("long")), block("STATEMENT-DISTRIBUTION", F.col("kinds")), block("STATEMENTS", F.col("body")), F.lit("    )"),
    )
    told = rows.groupBy("doc_id").agg(_joined(["start_line", "paragraph"], one).alias("procedures"))
    total = kinds.groupBy("doc_id", "type").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(_joined([(-F.col("n")).alias("k"), "type"], F.format_string("      (%s %d)", "type", "n")).alias("total"))
    graph = performs.groupBy("doc_id").agg(_joined([(-F.col("n")).alias("k"), "name"], F.format_string("    (%s %d)", quoted(F.col("name")), "n")).alias("graph"))
    facts = [
        F.concat(F.lit(f"    ({c.upper().replace('_', '-')} "), quoted(F.col(c)) if kind == "string" else F.col(c).cast("string"), F.lit(")")) for c, kind in metadata.dtypes if c not in ("doc_id", "name")
    ]
    head = metadata.select("doc_id", F.concat(F.lit("(ENHANCED-COBOL-ANALYSIS "), quoted(F.coalesce("name", F.lit("UNKNOWN")))).alias("head"), F.concat_ws("\n", *facts).alias("facts"))
    both = head.join(told, "doc_id", "left").join(total, "doc_id", "left").join(graph, "doc_id", "left")
    some = lambda c: F.coalesce(F.concat(F.lit("\n"), F.nullif(F.col(c), F.lit(""))), F.lit(""))
    text = F.concat(
        "head", F.lit("\n  (METADATA"), some("facts"), F.lit("\n  )\n  (PROCEDURES"), some("procedures"), F.lit("\n  )\n  (STATEMENT-ANALYSIS\n    (STATEMENT-DISTRIBUTION"), some("total"),
        F.lit("\n    )\n  )\n  (PERFORM-GRAPH"), some("graph"), F.lit("\n  )\n)"),
    )
    return both.select("doc_id", text.alias("text"))


def sorted_by(rows: DataFrame, *order: str) -> DataFrame:
    """Rows moved once, so that a document's are in one task and in order."""
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *order)


def _cells(column: pa.Array) -> list:
    """column.to_pylist(), by way of numpy where that is quicker and the same."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def written(nodes: DataFrame, text_of: Callable[..., str]) -> DataFrame:
    """doc_id, text: text_of(levels, types, values, terminals) of each tree. nodes: a tree's in one task, next to each other and in
    preorder. Python holds one tree and a batch of nodes; a tree may go on over many batches."""
    made = T.StructType([nodes.schema["doc_id"], T.StructField("text", T.StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, kind = None, None, None
        for batch in batches:
            docs, columns = batch.column(0), [_cells(c) for c in batch.columns[1:]]
            kind, start, done = docs.type, 0, []
            for end in pc.run_end_encode(docs).run_ends.to_pylist():
                one, part = docs[start].as_py(), [c[start:end] for c in columns]
                start = end
                if held is not None and one == doc:
                    for h, c in zip(held, part, strict=True):
                        h.extend(c)
                    continue
                if held is not None:
                    done.append((doc, text_of(*held)))
                doc, held = one, part
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], kind), pa.array([t for _, t in done], pa.string())], made.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc], kind), pa.array([text_of(*held)], pa.string())], made.names)

    return nodes.select("doc_id", "level", "type", "value", "terminal").mapInArrow(found, made)


def _children(levels: list[int], terminals: list[bool]) -> tuple[list[int], list[int]]:
    """How many children each node has, and how many of them are terminals: those of its level + 1 up to the next node of its level."""
    children, leaves = [0] * len(levels), [0] * len(levels)
    some, ends = [0] * (max(levels) + 2), [0] * (max(levels) + 2)
    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        below = level + 1
        if some[below]:
            children[i], leaves[i] = some[below], ends[below]
            some[below] = ends[below] = 0
        some[level] += 1
        if terminals[i]:
            ends[level] += 1
    return children, leaves


def _has_meaning(value: str | None) -> bool:
    return value is not None and (value.isalnum() or (value.strip(" ") not in MEANINGLESS and value.replace("\n", "").strip(" ") not in MEANINGLESS))


def long_text(levels: list[int], types: list[str], values: list[str], terminals: list[bool]) -> str:
    """The text of lisp() of one tree. An unknown type is an empty one."""
    pieces, around = [], []  # around: level, what its children begin with, their indent, closing of each open list
    for level, kind, value, terminal, n, leaves in zip(levels, types, values, terminals, *_children(levels, terminals), strict=True):
        while around and around[-1][0] >= level:
            pieces.append(around.pop()[3])
        _, before, depth, _ = around[-1] if around else (-1, "", 0, "")
        if terminal:
            pieces += (before, value if _has_meaning(value) else kind or "")
            continue
        pieces += (before, "(", kind or "")
        if n <= MOST_CHILDREN or n == leaves <= MOST_TERMINALS or kind in INLINE_TYPES:
            around.append((level, " ", 0, ")"))
        else:
            around.append((level, "\n" + "  " * (depth + 1), depth + 1, "\n" + "  " * depth + ")"))
    return "".join(pieces + [closing for *_, closing in reversed(around)])


def lisp(nodes: DataFrame, in_order: bool = False) -> DataFrame:
    """doc_id, text: trees as nested lists. A list stays on one line with up to three children, up to five where all are
    terminals, or by its type; a child of such a list is indented anew from the left. Else each child has a line of its own.
    nodes: doc_id, place, level, type, value, terminal, in preorder; trees of any depth. in_order: they come as sorted_by() leaves them, without place."""
    return written(nodes if in_order else sorted_by(nodes, "place"), long_text)


def compact_text(levels: list[int], types: list[str], values: list[str], terminals: list[bool]) -> str:
    """The text of compact_lisp() of one tree. An unknown type is an empty one."""
    pieces, around, between = [], [], ""  # around: level, closing of each open list; an only child follows its wrapper without a space
    for level, kind, value, terminal, n in zip(levels, types, values, terminals, _children(levels, terminals)[0], strict=True):
        while around and around[-1][0] >= level:
            pieces.append(around.pop()[1])
            between = " "
        before, between = between if around else "", " "
        if terminal:
            word = (kind or "") if not _has_meaning(value) else '"' + value.replace('"', '\\"') + '"' if _QUOTE.search(value) else value
            pieces += (before, word)
        elif n == 1 and kind in WRAPPER_TYPES:
            pieces.append(before)
            between = ""
            around.append((level, ""))
        else:
            pieces += (before, "(", kind or "")
            around.append((level, ")"))
    return "".join(pieces + [closing for _, closing in reversed(around)])


def compact_lisp(nodes: DataFrame, in_order: bool = False) -> DataFrame:
    """doc_id, text: trees as nested lists on one line; wrappers around an only child are left out, values with spaces or quotes are quoted. nodes, in_order: as of lisp()."""
    return written(nodes if in_order else sorted_by(nodes, "place"), compact_text)
