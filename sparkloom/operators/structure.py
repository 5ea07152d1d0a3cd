"""Structure of COBOL and TAL sources, line by line: statements, calls, copybooks, data items, scores.

Line tables have doc_id, line_no and line. Sequential state (division, section, paragraph) is filled forward within a
document, so every step is a projection or a window of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as fx
from ..sources import storage
from . import chunking, preprocess

# Statement types by prefix, in order, and endings by content.
VERBS = [
    "PERFORM", "MOVE", "IF", "EXEC SQL", "INITIALIZE", "OPEN", "CLOSE", "READ", "WRITE", "EVALUATE", "ADD", "SUBTRACT", "MULTIPLY",
    "DIVIDE", "COMPUTE", "DISPLAY", "ACCEPT", "SET", "INSPECT", "UNSTRING", "STRING", "CALL", "GOBACK", "STOP", "EXIT",
]
ENDINGS = ["END-IF", "END-EXEC", "END-EVALUATE", "END-READ"]
# Call forms, in order.
PERFORM_FORMS = [
    ("THROUGH", r"PERFORM\s+([A-Z0-9-]+)\s+THRU\s+([A-Z0-9-]+)"),
    ("TIMES", r"PERFORM\s+([A-Z0-9-]+)\s+(\d+)\s+TIMES"),
    ("UNTIL", r"PERFORM\s+([A-Z0-9-]+)\s+UNTIL\s+()"),
    ("VARYING", r"PERFORM\s+([A-Z0-9-]+)\s+VARYING\s+()"),
    ("SIMPLE", r"PERFORM\s+([A-Z0-9-]+)(?:\s|\z|\.)()"),
]
CALL_FORMS = [("STATIC_CALL", r"CALL\s+'([^']+)'"), ("DYNAMIC_CALL", r"CALL\s+([A-Z0-9-]+)"), ("CICS_CALL", r"EXEC\s+CICS\s+LINK\s+PROGRAM\s*\(\s*'([^']+)'\s*\)")]
COPY_FORMS = [r"COPY\s+([A-Z0-9.-]+)", r"COPY\s+'([^']+)'"]
COPYBOOK_NAMES = [r"-RTN\z", r"-ROUTINE\z", r"-PROC\z", r"-PROCESS\z", r"^COMMON-", r"^UTIL-", r"^STD-", r"^STANDARD-"]
PROGRAM_NAMES = [r"^CALL-", r"^EXEC-", r"^RUN-", r"^START-", r"-PGM\z", r"-PROGRAM\z", r"-MODULE\z"]
# Score groups of procedure names (points, parts) and of statements.
NAME_GROUPS = [
    (20, ["process", "validate", "calculate", "transform", "convert", "initialize", "termination", "cleanup", "setup", "mainline"]),
    (15, ["read", "write", "open", "close", "file", "input", "output", "load", "save", "fetch", "get", "put"]),
    (15, ["sql", "select", "insert", "update", "delete", "database", "table", "record", "data", "entity"]),
    (10, ["customer", "order", "product", "account", "transaction", "header", "detail", "trailer", "summary", "report"]),
    (15, ["main", "start", "begin", "end", "finish", "complete", "check", "verify", "control", "manage"]),
]
STATEMENT_BONUS = (
    {"EXEC_SQL": 15, "EVALUATE": 8, "DISPLAY": 2}
    | dict.fromkeys(["OPEN", "CLOSE", "READ", "WRITE"], 10)
    | dict.fromkeys(["IF", "PERFORM", "COMPUTE", "INITIALIZE"], 5)
    | dict.fromkeys(["MOVE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "STRING", "UNSTRING", "INSPECT", "ACCEPT"], 3)
)
HEADERS = [
    "IDENTIFICATION", "ENVIRONMENT", "DATA DIVISION", "PROCEDURE DIVISION", "WORKING-STORAGE", "LINKAGE", "FILE SECTION",
    "CONFIGURATION", "INPUT-OUTPUT", "LOCAL-STORAGE",
]
# TAL statements by pattern, in order; the first group is the name concerned.
TAL_FORMS = [
    ("PROC", r"(?i)^\s*(?:INT|REAL|STRING|FIXED|UNSIGNED)?\s*PROC\s+([A-Za-z_][A-Za-z0-9_^]*)"),
    ("END", r"(?i)^\s*()END;\s*\z"),
    ("BIT_FIELD_ASSIGNMENT", r"(?i)^\s*([A-Za-z_][A-Za-z0-9_]*)\.<\d+(?::\d+)?>\s*:="),
    ("POINTER_DEREFERENCE", r"^\s*(\.[A-Za-z_][A-Za-z0-9_]*)\s*:="),
    ("STRING_MOVE", r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*':='"),
    ("SCAN", r"(?i)^\s*SCAN\s+([A-Za-z_][A-Za-z0-9_.]*)\s+WHILE\b"),
    ("RSCAN", r"(?i)^\s*RSCAN\s+([A-Za-z_][A-Za-z0-9_.]*)\s+WHILE\b"),
    ("SYSTEM_CALL", r"(?i)^\s*CALL\s+(\$[A-Za-z_][A-Za-z0-9_]*)"),
    ("CALL", r"(?i)^\s*CALL\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("IF", r"(?i)^\s*IF\s+(\S+)"),
    ("ENDIF", r"(?i)^\s*()ENDIF\b"),
    ("RETURN", r"(?i)^\s*RETURN\s*([^;]*);?"),
    ("POINTER_ASSIGNMENT", r"^\s*(@[A-Za-z_][A-Za-z0-9_]*)\s*:="),
    ("ASSIGNMENT", r"^\s*([A-Za-z_][A-Za-z0-9_.\[\]]*)\s*:="),
]
TAL_TYPES = ["INT(64)", "INT(32)", "INT(16)", "INT", "REAL(64)", "REAL(32)", "REAL", "FIXED", "STRING", "UNSIGNED", "BYTE", "CHAR", "STRUCT", "EXTADDR", "SGADDR", "TIMESTAMP"]


def statement_type(line: Column) -> Column:
    """First matching prefix of the trimmed upper-case line, then endings anywhere, else STATEMENT."""
    up, out = F.upper(F.trim(line)), F.lit("STATEMENT")
    for e in reversed(ENDINGS):
        out = F.when(F.contains(up, F.lit(e)), e).otherwise(out)
    for v in reversed(VERBS):
        out = F.when(up.startswith(v), v.replace(" ", "_")).otherwise(out)
    return out


def configured_type(line: Column, patterns: dict[str, str] | None = None) -> Column:
    """By configured patterns over the trimmed upper-case line, then verbs, then END_CLAUSE, else STATEMENT."""
    up = F.upper(F.trim(line))
    rules = dict(patterns or {}) or {"EXEC_SQL": r"^EXEC\s+SQL.*", **{v: rf"^{v}\s+.*" for v in ("PERFORM", "MOVE", "IF", "SET", "EVALUATE")}}
    rules |= {v: rf"^{v}\s+.*" for v in ("INITIALIZE", "ADD")} | {"CONTINUE": r"^CONTINUE\s*", "END_CLAUSE": r".*(END-[A-Z]+|WHEN|ELSE|THEN|UNTIL).*"}
    out = F.lit("STATEMENT")
    for name, p in reversed(rules.items()):
        out = F.when(up.rlike(rf"^(?:{p})\z"), name).otherwise(out)
    return out


def sections(lines: DataFrame) -> DataFrame:
    """Adds division and paragraph, each filled forward; a paragraph is a name and a period alone on a line."""
    up = F.upper(F.trim("line"))
    held = chunking.fill_forward(lines, F.when(up.rlike(r"^[A-Z-]+\s+DIVISION"), F.regexp_extract(up, r"^([A-Z-]+)\s+DIVISION", 1)), "division")
    name = F.regexp_extract(F.upper("line"), r"^\s*([A-Z0-9][A-Z0-9-]*)\.\s*\z", 1)
    begins = (name != "") & (F.col("division") == "PROCEDURE") & ~name.isin(*[v.replace(" ", "-") for v in VERBS]) & ~name.startswith("END-")
    held = held.withColumn("begins", F.coalesce(begins, F.lit(False)))
    return chunking.fill_forward(held, F.when(F.col("begins"), name), "paragraph")


def statements(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, paragraph, type, content of each line of a paragraph that isn't blank, a comment or its name."""
    held = sections(lines).where("paragraph is not null and not begins")
    held = held.where((F.trim("line") != "") & ~F.trim("line").startswith("*"))
    return held.select("doc_id", "line_no", "paragraph", statement_type(F.col("line")).alias("type"), F.trim("line").alias("content"))


def procedures(lines: DataFrame) -> DataFrame:
    """doc_id, paragraph, start_line, end_line."""
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    held = sections(lines).withColumn("last", last).where("begins")
    return chunking.end_lines(held.select("doc_id", "line_no", "paragraph", "last"), F.col("last")).select("doc_id", "paragraph", F.col("line_no").alias("start_line"), "end_line")


def performs(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, caller, target, form, through: the first matching form of each line."""
    up = F.upper("line")
    form = F.lit(None).cast("string")
    target, through = F.lit(""), F.lit("")
    for name, p in reversed(PERFORM_FORMS):
        hit = up.rlike(p)
        form, target = F.when(hit, name).otherwise(form), F.when(hit, F.regexp_extract(up, p, 1)).otherwise(target)
        through = F.when(hit, F.regexp_extract(up, p, 2) if name == "THROUGH" else F.lit("")).otherwise(through)
    rows = sections(lines).select("doc_id", "line_no", F.col("paragraph").alias("caller"), target.alias("target"), form.alias("form"), F.nullif(through, F.lit("")).alias("through"))
    return rows.where("form is not null")


def calls(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, program, form, parameters."""
    up = F.upper("line")
    form, program = F.lit(None).cast("string"), F.lit("")
    for name, p in reversed(CALL_FORMS):
        hit = up.rlike(p)
        form, program = F.when(hit, name).otherwise(form), F.when(hit, F.regexp_extract(up, p, 1)).otherwise(program)
    using = F.regexp_replace(F.regexp_extract(up, r"USING(.*)\z", 1), r"\bBY\s+(REFERENCE|CONTENT|VALUE)\b", "")
    names = F.transform(F.split(F.trim(using), r"\s+"), lambda w: F.regexp_replace(w, "[,.]", ""))
    kept = F.filter(names, lambda w: w.rlike(r"^[A-Z0-9-]+\z"))
    return lines.select("doc_id", "line_no", program.alias("program"), form.alias("form"), kept.alias("parameters")).where("form is not null")


def copies(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, copybook, library, replacing, kind."""
    up = F.upper("line")
    found = [F.nullif(F.regexp_extract(up, p, 1), F.lit("")) for p in COPY_FORMS]
    name = F.regexp_replace(F.coalesce(*found), r"\.\z", "")
    part = lambda p: F.nullif(F.regexp_extract(up, p, 1), F.lit(""))
    kind = (
        F.when(fx.any_of(name, ["REC", "RECORD", "LAYOUT"]), "DATA_STRUCTURE")
        .when(fx.any_of(name, ["PROC", "ROUTINE"]) | F.contains(up, F.lit("PROCEDURE")), "PROCEDURE_CODE")
        .when(fx.any_of(name, ["CONST", "CODE", "MSG"]), "CONSTANTS")
        .otherwise("UNKNOWN")
    )
    rows = lines.select("doc_id", "line_no", name.alias("copybook"), F.regexp_replace(part(r"COPY\s+\S+\s+(?:OF|IN)\s+([A-Z0-9.-]+)"), r"\.\z", "").alias("library"), part(r"(REPLACING.*)\z").alias("replacing"), kind.alias("kind"))
    return rows.where("copybook is not null")


def expand(lines: DataFrame, books: DataFrame) -> DataFrame:
    """COPY lines replaced by their copybooks' lines to any depth; a book inside itself and unknown books become comments.
    books: name, content. Returns doc_id, path (place in the expansion), line."""
    place = F.array(F.col("line_no").cast("int"))
    now = lines.select("doc_id", place.alias("path"), "line", F.array().cast("array<string>").alias("seen"))
    book = books.select(F.upper("name").alias("book"), F.split("content", "\n").alias("body"))
    name = F.regexp_replace(F.coalesce(*[F.nullif(F.regexp_extract(F.upper("line"), p, 1), F.lit("")) for p in COPY_FORMS]), r"\.\z", "")
    while True:
        marked = storage.cut(now).withColumn("book", F.when(~F.trim("line").startswith("*"), name)).join(book, "book", "left")
        fits = F.col("body").isNotNull() & ~F.array_contains("seen", F.coalesce("book", F.lit("")))
        stay = marked.where(~fits).select("doc_id", "path", F.when(F.col("book").isNotNull(), F.concat(F.lit("* "), F.trim("line"))).otherwise(F.col("line")).alias("line"), "seen")
        into = marked.where(fits).select("doc_id", "path", "seen", "book", F.posexplode("body").alias("i", "text"))
        if into.isEmpty():  # at the latest once every book is inside itself
            return stay.select("doc_id", "path", "line")
        now = stay.unionByName(into.select("doc_id", F.concat("path", F.array("i")).alias("path"), F.col("text").alias("line"), F.concat("seen", F.array("book")).alias("seen")))


def data_items(lines: DataFrame) -> DataFrame:
    """Data items of the data division: section, level, name, clauses, type, parent line, kind (88 is a condition)."""
    held = sections(lines).where("division = 'DATA'")
    up = F.upper(F.trim("line"))
    held = chunking.fill_forward(held, F.when(up.rlike(r"^[A-Z-]+\s+SECTION"), F.regexp_extract(up, r"^([A-Z-]+)\s+SECTION", 1)), "section")
    rows = held.select("doc_id", "line_no", "section", fx.picture_clauses(F.col("line")).alias("c")).select("doc_id", "line_no", "section", "c.*").where("level is not null")
    kind = F.when(F.col("level") == 88, "CONDITION").when(F.col("picture").isNotNull(), "ELEMENTARY").otherwise("GROUP")
    rows = rows.withColumn("type", F.when(kind == "ELEMENTARY", fx.picture_type(F.col("picture")))).withColumn("kind", kind)
    return chunking.parents(rows, [*range(1, 50), 77])


def external_category(target: Column, has_procedure_book: Column) -> Column:
    hit = lambda ps: target.rlike("|".join(ps))
    return (
        F.when(target.rlike(r"^\d+\z") | (F.length(target) < 3), "LIKELY_ERROR")
        .when(has_procedure_book | hit(COPYBOOK_NAMES), "LIKELY_COPYBOOK")
        .when(hit(PROGRAM_NAMES), "LIKELY_EXTERNAL_PROGRAM")
        .otherwise("UNKNOWN")
    )


def mix_class(sql: Column, data: Column, file: Column, control: Column, is_main: Column) -> Column:
    """sql > 0.4, main, file > 0.4, data > 0.6, control > 0.4, else mixed; execution without such statements."""
    total = sql + data + file + control
    over = lambda c, limit: c / total > limit
    return (
        F.when(total == 0, "execution").when(over(sql, 0.4), "sql").when(is_main, "main").when(over(file, 0.4), "file")
        .when(over(data, 0.6), "data").when(over(control, 0.4), "control").otherwise("mixed")
    )


def mix(rows: DataFrame, key: str = "paragraph") -> DataFrame:
    """Procedure class by statement types."""
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    counted = rows.groupBy("doc_id", key).agg(
        n("EXEC_SQL", "END-EXEC").alias("sql"), n("MOVE", "SET", "INITIALIZE").alias("data"), n("READ", "WRITE", "OPEN", "CLOSE").alias("file"),
        n("IF", "PERFORM", "EVALUATE").alias("control"), F.count("*").alias("statements"),
    )
    return counted.withColumn("class", mix_class(F.col("sql"), F.col("data"), F.col("file"), F.col("control"), F.contains(F.lower(key), F.lit("main"))))


def type_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """n of each statement type: over all rows, or for each of the keys."""
    return rows.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def dominant_types(counts: DataFrame, *keys: str) -> DataFrame:
    """Of each key the type of the most statements, ties by name, its n and all statements. counts: from type_counts."""
    best = F.min(F.struct((-F.col("n")).alias("k"), "type"))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("statements")).select(*keys, F.col("b.type").alias("type"), (-F.col("b.k")).alias("n"), "statements")


def class_counts(mixed: DataFrame) -> DataFrame:
    """class, n: how many procedures of mix() are of each class."""
    return mixed.groupBy("class").agg(F.count("*").alias("n"))


def naming_score(name: Column) -> Column:
    low, out = F.lower(name), F.lit(0)
    for points, parts in NAME_GROUPS:
        out = out + F.when(fx.any_of(low, parts), points).otherwise(0)
    return out


def procedure_score(name: Column, n: Column, types: Column, performed: Column, in_procedure_division: Column, code: Column) -> Column:
    """Score of a COBOL procedure: base, division, name, statements, references, kinds of statements, convention, penalties."""
    up = F.upper(name)
    steps = sum((F.when(n >= k, 5).otherwise(0) for k in (1, 3, 5, 10, 20, 50)), F.lit(0))
    counted = F.when(n > 0, 10).otherwise(0) + steps - F.when(n == 1, 5).otherwise(0) + F.when(n.between(5, 30), 10).otherwise(0)
    referred = F.when(performed == 0, 0).when(performed == 1, 8).when(performed <= 3, 15).otherwise(20)
    special = sum((F.when(F.array_contains(types, t), p).otherwise(0) for t, p in STATEMENT_BONUS.items()), F.lit(0))
    diverse = F.when(F.size(F.array_distinct(types)) > 0, 2).otherwise(0)
    all_caps = (name == up) & name.rlike("[A-Z]")
    style = (
        F.when(F.length(name).between(3, 30), 5).otherwise(0) + F.when(name.rlike("^[A-Za-z]"), 5).otherwise(0) + F.when(name.rlike(r"^[A-Za-z0-9_-]+\z"), 5).otherwise(0)
        + F.when(name.rlike("[a-z][A-Z]") | F.contains(name, F.lit("-")), 3).otherwise(0) + F.when((F.length(name) > 5) & ~all_caps, 2).otherwise(0)
    )
    headers = sum((F.when(F.contains(up, F.lit(h)), 30).otherwise(0) for h in HEADERS), F.lit(0))
    penalty = (
        headers + F.when(up.rlike("^(WS|LS|FD|SD)[A-Z]"), 20).otherwise(0) + F.when(F.length(name) <= 2, 10).otherwise(0) + F.when(n == 0, 15).otherwise(0)
        + F.when((n == 1) & F.trim(code).startswith("*"), 10).otherwise(0) + F.when(up.startswith("END-"), 25).otherwise(0)
        + F.when(up.isin(*[v.replace(" ", "-") for v in VERBS]), 20).otherwise(0)
    )
    total = F.lit(30) + F.when(in_procedure_division, 25).otherwise(0) + naming_score(name) + counted + referred + special + diverse + style - penalty
    return F.greatest(total, F.lit(0)).cast("int")


def scored(lines: DataFrame, least: int = 35) -> DataFrame:
    """Procedures with scores of at least `least` that aren't false positives, highest first."""
    found = statements(lines).groupBy("doc_id", "paragraph").agg(F.count("*").alias("n"), F.collect_set("type").alias("types"), F.min_by("content", "line_no").alias("code"))
    refs = performs(lines).groupBy("doc_id", F.col("target").alias("paragraph")).agg(F.count("*").alias("refs"))
    rows = procedures(lines).join(found, ["doc_id", "paragraph"], "left").join(refs, ["doc_id", "paragraph"], "left")
    types = F.coalesce("types", F.array().cast("array<string>"))
    score = procedure_score(F.col("paragraph"), F.coalesce("n", F.lit(0)), types, F.coalesce("refs", F.lit(0)), F.lit(True), F.coalesce("code", F.lit("")))
    rows = rows.select("doc_id", "paragraph", "start_line", "end_line", F.coalesce("n", F.lit(0)).alias("statements"), F.coalesce("refs", F.lit(0)).alias("refs"), score.alias("score"))
    return rows.where((F.col("score") >= least) & ~checks.false_paragraph(F.col("paragraph"))).orderBy(F.desc("score"), "doc_id", "start_line")


def tal_statements(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, procedure, type, name: the first matching form of each line inside a procedure; ! comments and blanks go."""
    line = F.trim(F.regexp_replace("line", "!.*$", ""))
    kind, name = F.lit("OTHER"), F.lit("")
    for k, p in reversed(TAL_FORMS):
        hit = line.rlike(p)
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract(line, p, 1)).otherwise(name)
    rows = lines.where(line != "").select("doc_id", "line_no", kind.alias("type"), F.trim(name).alias("name"))
    rows = chunking.fill_forward(rows, F.when(F.col("type") == "PROC", F.upper("name")), "procedure")
    return rows.where("procedure is not null and type <> 'PROC'").select("doc_id", "line_no", "procedure", "type", "name")


def tal_scores(rows: DataFrame, least: int = 25) -> DataFrame:
    """Procedure scores from statement counts, capped at 100."""
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    refs = rows.where("type = 'CALL'").groupBy("doc_id", F.upper("name").alias("procedure")).agg(F.count("*").alias("refs"))
    raw = 50 + 15 * n("BIT_FIELD_ASSIGNMENT") + 10 * n("POINTER_DEREFERENCE", "POINTER_ASSIGNMENT") + 8 * n("STRING_MOVE") + 12 * n("SCAN", "RSCAN") + 5 * n("CALL", "SYSTEM_CALL")
    held = rows.groupBy("doc_id", "procedure").agg(F.min("line_no").alias("line_no"), raw.alias("raw"), F.count("*").alias("n"))
    held = held.join(refs, ["doc_id", "procedure"], "left")
    score = F.least(F.col("raw") + F.when(F.col("n") > 10, 10).otherwise(0) + 5 * F.coalesce("refs", F.lit(0)), F.lit(100))
    return held.select("doc_id", "procedure", "line_no", F.col("n").alias("statements"), score.cast("int").alias("score")).where(F.col("score") >= least)


def tal_type(text: Column) -> Column:
    up, out = F.upper(text), F.lit("UNKNOWN")
    for t in reversed(TAL_TYPES):
        out = F.when(F.contains(up, F.lit(t)), t).otherwise(out)
    return out


def item_references(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Statements and the names of the same document that they contain anywhere. A document's names travel as one array, so a
    statement is one row until names are found in it."""
    names = items.select("doc_id", F.upper("name").alias("item")).where("item is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("names"))
    held = F.filter("names", lambda n: F.instr(F.upper(F.col("content")), n) > 0)
    return rows.join(names, "doc_id").select("doc_id", "line_no", F.explode(held).alias("item"))


def data_references(rows: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, line_no, type, item, qualifiers, subscripted, item_line: the data items that statements refer to, by whole words outside literals.

    Each statement gives the names in it with their chains (`A OF B IN C`) and whether a subscript follows; names meet items
    by equality, never by search. A chain fits an item if all its qualifiers are among the item's groups; without a qualifier all items
    of the name fit. A qualifier is no reference of its own. rows: doc_id, line_no, type, content; items: doc_id, line_no, name, groups (names of the groups around, upper case)."""
    open_, close = preprocess.OPEN, preprocess.CLOSE
    marked = F.regexp_replace(F.upper(F.regexp_replace("content", r"[\x00-\x1f]", " ")), rf"({preprocess.TOKEN})\s*", f"{open_}$1{close}")
    word = f"{open_}[A-Z0-9_][A-Z0-9_-]*{close}"
    chain = rf"{word}(?:{open_}(?:OF|IN){close}{word})*(?:{open_}\({close})?"
    found = rows.select("doc_id", "line_no", "type", F.posexplode(F.regexp_extract_all(marked, F.lit(chain), F.lit(0))).alias("place", "chain"))
    words = preprocess.decoded(F.col("chain"))
    told = found.select("doc_id", "line_no", "type", "place", F.filter(words, lambda w, i: (i % 2 == 0) & (w != "(")).alias("names"), F.col("chain").endswith(f"({close}").alias("subscripted"))
    told = told.select("doc_id", "line_no", "type", "place", F.get("names", F.lit(0)).alias("item"), F.expr("slice(names, 2, size(names))").alias("qualifiers"), "subscripted").where(checks.referenced_item(F.col("item")))
    names = items.select("doc_id", F.upper("name").alias("item"), F.col("line_no").alias("item_line"), "groups")
    fits = told.join(names, ["doc_id", "item"]).where(F.size(F.array_except("qualifiers", "groups")) == 0)
    return fits.groupBy("doc_id", "line_no", "type", "item", F.array_join("qualifiers", ",").alias("qualifiers"), "subscripted", "item_line").agg(F.count("*").alias("n"))


def groups_around(items: DataFrame) -> DataFrame:
    """Items with groups: the names of all groups around each, by their levels in line order. items: doc_id, line_no, level, name."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    levels = [*range(1, 50)]
    depth = F.when(F.col("level").isin(77, 66), 1).when(F.col("level") == 88, 50).otherwise(F.col("level"))
    rows = items.withColumn("__depth", depth)
    # the last group of each level at or above a level that no lower one has closed since
    open_at = [F.last(F.when(F.col("__depth") == k, F.struct("line_no", F.upper("name").alias("name"))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) for k in levels]
    closed = [F.max(F.when(F.col("__depth") <= k, F.col("line_no"))).over(by.rowsBetween(Window.unboundedPreceding, -1)) for k in levels]
    around = F.array(*[F.when((F.lit(k) < F.col("__depth")) & (o["line_no"] == c), o["name"]) for k, o, c in zip(levels, open_at, closed, strict=True)])
    return rows.withColumn("groups", F.array_compact(around)).drop("__depth")
