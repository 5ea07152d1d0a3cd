"""Program-level facts of COBOL and TAL sources: headers, cleaning, recovery, metrics, labels and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import chunking, structure

# Fixed values.
MAIN_PARTS = ["main", "mainline", "start", "begin", "initialization", "init", "setup", "control", "driver", "master"]
TAL_ITEMS = {
    "STRUCT": r"(?i)^\s*STRUCT\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(\*\)\s*;",
    "ARRAY": r"(?i)^\s*(?:INT|STRING|CHAR|BYTE|BOOL|REAL|FIXED)(?:\s*\(\d+\))?\s+([A-Za-z_][A-Za-z0-9_]*)\[\d+:\d+\]",
    "VAR": r"(?i)^\s*(?:INT|STRING|CHAR|BYTE|BOOL|REAL|FIXED)(?:\s*\(\d+\))?\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?::=\s*[^;]+)?;",
    "POINTER": r"(?i)^\s*[A-Za-z_][A-Za-z0-9_]*\s+(\.[A-Za-z_][A-Za-z0-9_]*)(?:\[\d+:\d+\])?\s*;",
}


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines without sequence numbers and comments (* or / in column 7, or *> anywhere), from column 8; the CE entries of
    `*>CE` comments go with them; blank lines go."""
    plain = F.when(F.col("line").rlike(r"^[0-9 ]{6}[ *\-/dD]"), F.concat(F.substring("line", 7, 1), F.substring("line", 8, 65))).otherwise(F.concat(F.lit(" "), "line"))
    rows = lines.withColumn("line", plain).where(~F.substring("line", 1, 1).isin("*", "/") & ~F.trim(F.substr("line", F.lit(2))).startswith("*"))
    return rows.withColumn("line", F.rtrim(F.regexp_replace(F.substr("line", F.lit(2)), r"\*>.*$", ""))).where(F.trim("line") != "")


def completed(lines: DataFrame) -> DataFrame:
    """Programs that lack a division header get it in front: identification with a program name, then procedure. Returns
    doc_id, place, line in order of place."""
    up = F.upper("line")
    have = lines.groupBy("doc_id").agg(*[F.max(F.contains(up, F.lit(f"{d} DIVISION"))).alias(d) for d in ("IDENTIFICATION", "PROCEDURE")])
    head = F.array(F.lit("       IDENTIFICATION DIVISION."), F.format_string("       PROGRAM-ID. PROG%s.", F.col("doc_id").cast("string")))
    extra = F.concat(F.when(~F.col("IDENTIFICATION"), head).otherwise(F.array().cast("array<string>")), F.when(~F.col("PROCEDURE"), F.array(F.lit("       PROCEDURE DIVISION."))).otherwise(F.array().cast("array<string>")))
    front = have.select("doc_id", F.posexplode(extra).alias("i", "line")).select("doc_id", (F.col("i") - 10).alias("place"), "line")
    return front.unionByName(lines.select("doc_id", F.col("line_no").alias("place"), "line"))


def header(lines: DataFrame) -> DataFrame:
    """One row a document: program, author, files (FD or SELECT names, sorted); a value may be on the line after its key."""
    up, after = F.upper(F.trim("line")), F.lead(F.upper(F.trim("line"))).over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines.withColumns({"up": up, "after": after})
    value = lambda key: F.when(
        F.col("up").rlike(rf"^{key}\b"),
        F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_extract("up", rf"^{key}\s*\.?\s*(.*)$", 1), r"\.\z", "")), F.lit("")), F.regexp_replace("after", r"\.\z", "")),
    )
    name = F.coalesce(F.nullif(F.regexp_extract("up", r"^FD\s+([A-Z0-9-]+)", 1), F.lit("")), F.nullif(F.regexp_extract("up", r"^SELECT\s+(?:OPTIONAL\s+)?([A-Z0-9-]+)(?:\s+ASSIGN\b.*|\s*\.?)\z", 1), F.lit("")))
    return rows.groupBy("doc_id").agg(
        F.min_by(value("PROGRAM-ID"), F.when(value("PROGRAM-ID").isNotNull(), F.col("line_no"))).alias("program"),
        F.min_by(value("AUTHOR"), F.when(value("AUTHOR").isNotNull(), F.col("line_no"))).alias("author"),
        F.array_sort(F.collect_set(name)).alias("files"),
    )


def procedure_code(lines: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, name, code: from the line `name.` to the second blank line in a row or the next line that begins with a
    letter and ends with a period. Such lines cut a document into runs; a start's code is the rest of its run, so starts
    meet lines by the name before the first period and by their run, never line by line."""
    word = F.trim("line")
    by = Window.partitionBy("doc_id").orderBy("line_no")
    stop = ((word == "") & (F.lag(word == "", 1, False).over(by))) | (word.rlike(r"^[A-Za-z].*\.\z"))
    runs = lines.withColumn("stops", stop).withColumn("run", F.count_if("stops").over(by))
    head = F.when(F.contains(word, F.lit(".")), F.lower(F.substring_index(word, ".", 1)))
    starts = runs.select("doc_id", "run", F.col("line_no").alias("first"), head.alias("head")).where("head is not null")
    starts = starts.join(names.select("doc_id", "name", F.lower("name").alias("head")), ["doc_id", "head"])
    text = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("body"))
    rest = F.array_join(F.transform(F.filter("body", lambda x: x["line_no"] >= F.col("first")), lambda x: x["line"]), "\n")
    found = starts.join(text, ["doc_id", "run"]).select("doc_id", "name", "first", rest.alias("code"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]), "\n")
    return found.groupBy("doc_id", "name").agg(code.alias("code"))


def recovered(lines: DataFrame, found: DataFrame, expected: DataFrame, reach: int = 10) -> DataFrame:
    """Expected procedures that were not found: at a line that begins with the name and has a period, or within `reach`
    lines after a comment with the name. found, expected: doc_id, name. Returns doc_id, name, line_no (the first).

    A document's missing names travel as one array, so that a line is one row until a name is in it; the last comment with a name
    is carried forward by a window over the lines with the name."""
    missing = expected.withColumn("key", F.lower("name")).join(found.select("doc_id", F.lower("name").alias("key")), ["doc_id", "key"], "left_anti")
    wanted = missing.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("name", "key"))).alias("wanted"))
    rows = lines.select("doc_id", "line_no", F.lower(F.trim("line")).alias("word"), F.trim("line").startswith("*").alias("comment")).join(wanted, "doc_id")
    hits = F.filter("wanted", lambda w: F.contains(F.col("word"), w["key"]))
    told = rows.where("word <> ''").select("doc_id", "line_no", "word", "comment", F.explode(hits).alias("w")).select("doc_id", "line_no", "word", "comment", "w.*")
    by = Window.partitionBy("doc_id", "name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    said = F.max(F.when(F.col("comment"), F.col("line_no"))).over(by)
    near = told.withColumn("said", said).where(~F.col("comment") & ((F.startswith("word", "key") & F.contains("word", F.lit("."))) | (F.col("line_no") - F.col("said") < reach)))
    return near.groupBy("doc_id", "name").agg(F.min("line_no").alias("line_no"))


def tal_items(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, name, kind, type, struct: data items; items inside BEGIN-END of a STRUCT are its members; the first of a name counts."""
    line = F.trim(F.regexp_replace("line", "!.*$", ""))
    kind, name = F.lit(None).cast("string"), F.lit("")
    for k, p in reversed(TAL_ITEMS.items()):
        kind, name = F.when(line.rlike(p), k).otherwise(kind), F.when(line.rlike(p), F.regexp_extract(line, p, 1)).otherwise(name)
    rows = lines.select("doc_id", "line_no", kind.alias("kind"), name.alias("name"), structure.tal_type(line).alias("type"), F.upper(line).alias("up"))
    opens = F.when(F.col("kind") == "STRUCT", F.col("name")).when(F.col("up").rlike(r"^END\s*;") | F.col("up").rlike(r"\bPROC\b"), F.lit(""))
    rows = chunking.fill_forward(rows, opens, "struct").where("kind is not null")
    member = (F.col("struct") != "") & (F.col("kind") != "STRUCT")
    first = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("line_no"))
    rows = rows.withColumn("n", first).where("n = 1")
    return rows.select("doc_id", "line_no", "name", F.when(member, "MEMBER").otherwise(F.col("kind")).alias("kind"), "type", F.when(member, F.col("struct")).alias("struct"))


def included(items: DataFrame) -> DataFrame:
    """Data items that are kept by section and level: FILLER only with a value; in linkage no conditions."""
    filler = F.coalesce(F.upper("name") == "FILLER", F.lit(True))
    top = F.col("level").isin(1, 77)
    keep = F.when(F.col("section") == "LINKAGE", top | ((F.col("level") != 88) & ~filler)).otherwise(top | F.col("level").isin(66, 88) | ~filler | F.col("value").isNotNull())
    return items.where(F.col("name").isNotNull() & ~(filler & F.col("value").isNull()) & keep)


def using_modes(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, ord, name, mode of the names behind USING in headers of procedure divisions, entries and calls: VALUE,
    CONTENT or REFERENCE by the last BY before the name, REFERENCE without one."""
    up = F.upper(F.regexp_replace("line", r"'[^']*'|\"[^\"]*\"", " "))
    words = F.regexp_extract_all(F.regexp_extract(up, r"\b(?:PROCEDURE\s+DIVISION|ENTRY|CALL)\b.*?\bUSING\b(.*?)(?:\bRETURNING\b|\bGIVING\b|\bON\b|\.|\z)", 1), F.lit(r"[A-Z0-9][A-Z0-9-]*"), F.lit(0))
    rows = lines.select("doc_id", "line_no", F.posexplode(words).alias("ord", "name"))
    modes = F.col("name").isin("VALUE", "CONTENT", "REFERENCE")
    by = Window.partitionBy("doc_id", "line_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mode", F.coalesce(F.last(F.when(modes, F.col("name")), ignorenulls=True).over(by), F.lit("REFERENCE")))
    kept = rows.where(~modes & ~F.col("name").isin("BY", "OPTIONAL"))
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("ord")))


def linkage(items: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, name, mode of top-level linkage items: how the header of the procedure division takes them, by reference where it doesn't say."""
    held = items.where("section = 'LINKAGE' and level in (1, 77)").select("doc_id", "name")
    if lines is None:
        return held.withColumn("mode", F.lit("REFERENCE"))
    header = using_modes(lines.where(F.upper("line").rlike(r"\bPROCEDURE\s+DIVISION\b")))
    said = header.groupBy("doc_id", F.col("name").alias("key")).agg(F.min_by("mode", F.struct("line_no", "ord")).alias("mode"))
    return held.withColumn("key", F.upper("name")).join(said, ["doc_id", "key"], "left").select("doc_id", "name", F.coalesce("mode", F.lit("REFERENCE")).alias("mode"))


def complexity_band(records: Column, groups: Column, conditions: Column, redefines: Column, arrays: Column) -> Column:
    step = lambda c, *limits: sum((F.when(c > x, 1).otherwise(0) for x in limits), F.lit(0))
    score = step(records, 5, 10, 20) + step(groups, 20, 50, 100) + step(conditions, 15, 30) + step(redefines, 0, 5) + step(arrays, 0, 10)
    return F.when(score >= 8, "VERY COMPLEX").when(score >= 5, "COMPLEX").when(score >= 3, "MODERATE").otherwise("SIMPLE")


def item_counts(items: DataFrame) -> DataFrame:
    """doc_id, section, level, n: data items by section and level, with a row of all levels (level null) for each section and one of all sections (both null)."""
    return items.groupingSets([["doc_id", "section", "level"], ["doc_id", "section"], ["doc_id"]], "doc_id", "section", "level").agg(F.count("*").alias("n"))


def data_metrics(items: DataFrame) -> DataFrame:
    """One row a document: counts by kind of item and the complexity band."""
    n = F.count_if
    rows = items.groupBy("doc_id").agg(
        F.count("*").alias("items"), n(F.col("level") == 1).alias("records"), n(F.col("kind") == "GROUP").alias("groups"), n(F.col("level") == 88).alias("conditions"), n(F.col("picture").isNotNull()).alias("pictures"),
        n(F.col("value").isNotNull()).alias("with_value"), n(F.col("redefines").isNotNull()).alias("redefined"), n(F.col("occurs").isNotNull()).alias("arrays"),
        n(F.col("type").isin("NUMERIC_INTEGER", "NUMERIC_DECIMAL")).alias("numeric"), n(F.col("type") == "ALPHANUMERIC").alias("alphanumeric"),
    )
    return rows.withColumn("band", complexity_band(F.col("records"), F.col("groups"), F.col("conditions"), F.col("redefined"), F.col("arrays")))


def quality_metrics(procs: DataFrame, least: int = 35) -> DataFrame:
    """One row a document: mean score, procedures of `least` + 30 or more, statements."""
    return procs.groupBy("doc_id").agg(F.round(F.avg("score"), 1).alias("mean_score"), F.count_if(F.col("score") >= least + 30).alias("confident"), F.sum("statements").alias("statements"))


def statement_complexity(n: Column, code: Column, n_items: Column) -> Column:
    """Statements, 2 for each IF, EVALUATE and CALL, 1 for each PERFORM and GO TO, and the data items referred to."""
    up = F.upper(code)
    return n + 2 * fx.occurrences(up, "IF") + fx.occurrences(up, "PERFORM") + 2 * fx.occurrences(up, "EVALUATE") + fx.occurrences(up, "GO TO") + 2 * fx.occurrences(up, "CALL") + n_items


def perform_statistics(edges: DataFrame) -> DataFrame:
    """One row a document: calls in all, internal, external. edges: with is_external."""
    return edges.groupBy("doc_id").agg(F.count("*").alias("calls"), F.count_if(~F.col("is_external")).alias("internal"), F.count_if("is_external").alias("external"))


def is_main(name: Column) -> Column:
    return fx.any_of(F.lower(name), MAIN_PARTS)


def reasoning(name: Column, in_division: Column, refs: Column, n: Column, types: Column) -> Column:
    """What speaks for a procedure, in words."""
    points = structure.naming_score(name)
    has = lambda *t: F.arrays_overlap(types, F.array(*map(F.lit, t)))
    return F.concat_ws(
        ", ", F.lit("enhanced scoring v2.0"), F.when(in_division, F.lit("in PROCEDURE DIVISION")), F.when(points > 0, F.format_string("business logic naming (+%.1f)", points.cast("double"))),
        F.when(refs > 0, F.format_string("%d PERFORM refs", refs)), F.when(n > 0, F.format_string("%d stmts, %d types", n, F.size(F.array_distinct(types)))),
        F.when(has("EXEC_SQL"), F.lit("SQL operations")), F.when(has("READ", "WRITE"), F.lit("file I/O")), F.when(has("IF", "EVALUATE"), F.lit("control logic")), F.when(is_main(name), F.lit("main procedure pattern")),
    )


def pattern_label(code: Column) -> Column:
    has = lambda *p: fx.any_of(F.upper(code), p)
    return (
        F.when(has("VALIDATE", "CHECK"), "Input Validation Pattern").when(has("CALCULATE", "COMPUTE"), "Business Calculation Pattern").when(has("READ") & has("WRITE"), "Data Processing Pattern")
        .when(has("DISPLAY", "WRITE"), "Output Generation Pattern").when(has("PERFORM"), "Control Flow Pattern").otherwise("Utility Pattern")
    )


def hybrid(n_found: Column, n_expected: Column, threshold: float = 0.8) -> Column:
    """Whether the fallback is added: something is expected and less than the threshold of it was found."""
    return (n_expected > 0) & (n_found / n_expected < threshold)


def templates(rows: DataFrame, most: int = 1) -> DataFrame:
    """Snippets by category: named chunks of 6 to 29 lines, cleaned; the first `most` of each. rows: category, name, content, ord."""
    n = F.size(F.split("content", "\n"))
    kept = rows.where(F.col("name").isNotNull() & (F.col("name") != "") & (n > 5) & (n < 30))
    first = F.slice(F.array_sort(F.collect_list(F.struct("ord", "name", fx.reusable_code(F.col("content")).alias("code")))), 1, most)
    return kept.groupBy("category").agg(first.alias("t")).select("category", F.explode("t").alias("t")).select("category", "t.ord", "t.name", "t.code")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """${name} in a template replaced by values."""
    for k, v in values.items():
        template = F.replace(template, F.lit("${" + k + "}"), v)
    return template


def lisp(nodes: DataFrame) -> DataFrame:
    """doc_id, text: nodes (doc_id, line_no, level, value) as nested lists, a closing parenthesis for each level left."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    closes = F.col("level") - F.coalesce(F.lead("level").over(by), F.lit(0)) + 1
    held = nodes.withColumn("closes", F.greatest(closes, F.lit(0)))
    part = F.concat(F.lit("("), F.col("value"), F.repeat(F.lit(")"), F.col("closes")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", part.alias("t"))))
    return held.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))
