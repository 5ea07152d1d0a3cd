"""Preprocessing of COBOL sources, token by token: EXEC blocks, directives, compiler options, comment entries, COPY and REPLACE.

Line tables have doc_id, line_no and line, without sequence numbers (`programs.cleaned`). A line becomes tokens; whether a token
lies in pseudo-text, in an EXEC block or in a statement to the preprocessor is a running state over the tokens of its
document, told by windows. REPLACE statements are a stack: their scopes are matched brackets, so a statement's scope ends where the depth next falls
below its own. Rules match runs of tokens, over line ends too (what then follows on the later line joins the earlier one), never parts of a word or of a literal.

Documents are the unit of the windows. Defined cases: null lines have no tokens; an EXEC block without END-EXEC and a statement without a period
run to the end of their document; REPLACE OFF without a REPLACE does nothing; a rule that matches nothing, or with nothing to match, changes nothing; an odd `==` opens pseudo-text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage

# Fixed values.
TOKEN = r"""'[^']*(?:''[^']*)*'?|"[^"]*(?:""[^"]*)*"?|==|[A-Za-z0-9_][A-Za-z0-9_-]*|\S"""
EXEC_KINDS = ["SQL", "CICS", "SQLIMS"]
EJECTS = ["EJECT", "SKIP1", "SKIP2", "SKIP3"]
OPTIONS = ["CBL", "PROCESS"]
COMMENT_PARAGRAPHS = ["AUTHOR", "INSTALLATION", "DATE-WRITTEN", "DATE-COMPILED", "SECURITY", "REMARKS"]

#: Around a token of an encoded text, and before the number of a line in it.
OPEN, CLOSE = "\x1e", "\x1f"
_PUNCTUATION = r"([\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E])"
_BETWEEN = r" *(?:\n-?[0-9]+ *)*"


def comment_entries(lines: DataFrame) -> DataFrame:
    """Lines without comment entries: the text behind AUTHOR. and its like up to the next word in area A (the first four
    columns), `*>CE` lines with the comments and blank lines that follow, and comments; headers of paragraphs stay."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    line = F.col("line")
    comment, blank = line.startswith("*"), F.trim("line") == ""
    head = F.upper(line).rlike(rf"^ {{0,3}}(?:{'|'.join(COMMENT_PARAGRAPHS)})\b")
    area_a = line.rlike(r"^ {0,3}[^ *]")
    state = F.when(head, "paragraph").when(area_a, "").when(line.contains("*>CE"), "mark").when(~comment & ~blank, "text")
    rows = lines.withColumns({"head": head, "a": area_a, "now": state})
    rows = rows.withColumn("in", F.last(F.when(F.col("head") | F.col("a"), F.col("head")), ignorenulls=True).over(by))
    rows = rows.withColumn("marked", F.last("now", ignorenulls=True).over(by) == "mark")
    gone = comment | line.contains("*>CE") | (F.coalesce("marked", F.lit(False)) & blank) | (F.coalesce("in", F.lit(False)) & ~F.col("head"))
    word = F.regexp_extract("line", r"^( {0,3}[A-Za-z-]+\s*\.?)", 1)
    return rows.where(~gone).select("doc_id", "line_no", F.when(F.col("head"), word).otherwise(line).alias("line"))


def tokens(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, place, tok, up; comment lines have none."""
    plain = F.regexp_replace("line", r"[\x00-\x1f]", " ")
    rows = lines.where(~F.trim("line").startswith("*")).select("doc_id", "line_no", F.posexplode(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))).alias("place", "tok"))
    return rows.withColumn("up", F.upper("tok"))


def classified(toks: DataFrame) -> DataFrame:
    """Tokens with kind (CODE, EXEC_SQL, EXEC_CICS, EXEC_SQLIMS, REPLACE, COPY, OPTIONS; directives to the listing go), unit
    (the number of the block or statement) and inside (whether it lies in pseudo-text)."""
    by = Window.partitionBy("doc_id").orderBy("line_no", "place")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("doc_id", "line_no").orderBy("place")
    of_line = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = toks.withColumns({
        "next": F.lead("up").over(by), "before": F.lag("tok").over(by), "first": F.first("up").over(of_line), "second": F.nth_value("up", 2).over(of_line),
        "inside": (F.count_if(F.col("tok") == "==").over(so_far) % 2 == 1) | (F.col("tok") == "=="),
    })
    free = ~F.col("inside")
    opens = F.when(free & (F.col("up") == "EXEC") & F.col("next").isin(EXEC_KINDS), F.concat(F.lit("EXEC_"), F.col("next")))
    shuts = F.when(free & (F.col("up") == "END-EXEC"), "")
    rows = rows.withColumn("exec", F.coalesce(F.last(F.coalesce(opens, shuts), ignorenulls=True).over(so_far), F.lit("")))
    rows = rows.withColumn("exec_before", F.coalesce(F.lag("exec").over(by), F.lit("")))
    # a second EXEC in a block is text, so the kind is that of the first
    begins = (F.col("exec") != "") & (F.col("exec_before") == "")
    rows = rows.withColumn("block", F.count_if(begins).over(so_far)).withColumn("in_exec", (F.col("exec") != "") | (F.col("exec_before") != ""))
    rows = rows.withColumn("exec_kind", F.last(F.when(begins, F.col("exec")), ignorenulls=True).over(so_far))
    free = ~F.col("inside") & ~F.col("in_exec")
    said = F.when(free & (F.col("up") == "REPLACE") & ((F.col("place") == 0) | (F.col("before") == ".")), "REPLACE").when(free & (F.col("up") == "COPY"), "COPY")
    rows = rows.withColumn("said", F.coalesce(F.last(F.coalesce(said, F.when(free & (F.col("tok") == "."), "")), ignorenulls=True).over(so_far), F.lit("")))
    rows = rows.withColumn("said_before", F.coalesce(F.lag("said").over(by), F.lit("")))
    starts = (F.col("said") != "") & (F.col("said_before") == "")
    rows = rows.withColumn("statement", F.count_if(starts).over(so_far)).withColumn("said_kind", F.last(F.when(starts, F.col("said")), ignorenulls=True).over(so_far))
    in_statement = (F.col("said") != "") | (F.col("said_before") != "")
    listing = F.col("first").isin(EJECTS) & ((F.col("place") == 0) | ((F.col("place") == 1) & (F.col("tok") == ".")))
    title = (F.col("first") == "TITLE") & F.col("second").rlike("^['\"]") & ((F.col("place") < 2) | ((F.col("place") == 2) & (F.col("tok") == ".")))
    kind = (
        F.when(F.col("in_exec"), F.col("exec_kind")).when(in_statement, F.col("said_kind")).when(listing | title, None)
        .when(F.col("first").isin(OPTIONS), "OPTIONS").otherwise("CODE")
    )
    unit = F.when(F.col("in_exec"), F.col("block")).when(in_statement, F.col("statement")).otherwise(0)
    return rows.select("doc_id", "line_no", "place", "tok", "up", "inside", kind.alias("kind"), unit.alias("unit")).where("kind is not null")


def spaced(toks: Column) -> Column:
    """Tokens (an array) as text: a space before each but the first, periods, commas and parentheses."""
    return F.replace(F.regexp_replace(F.array_join(toks, CLOSE), rf"{CLOSE}([.,()])(?={CLOSE}|\z)", "$1"), F.lit(CLOSE), F.lit(" "))


def in_order(value: Column) -> Column:
    """The values of a group in order of line and place."""
    return F.transform(F.array_sort(F.collect_list(F.struct("line_no", "place", value.alias("v")))), lambda x: x["v"])


def clauses(rows: DataFrame) -> DataFrame:
    """doc_id, unit, rules (an array of old and new tokens) of REPLACE and COPY REPLACING statements. rows: of classified()."""
    by = Window.partitionBy("doc_id", "unit").orderBy("line_no", "place").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({"mark": F.count_if(F.col("tok") == "==").over(by), "nth": F.count("*").over(by), "replacing": F.count_if(~F.col("inside") & F.col("up").isin("REPLACE", "REPLACING")).over(by)})
    told = told.where((F.col("replacing") > 0) & (F.col("inside") | ~F.col("up").isin("REPLACE", "REPLACING", "BY", ".", ",", "LEADING", "TRAILING")))
    starts = ~F.col("inside") | ((F.col("tok") == "==") & (F.col("mark") % 2 == 1))
    told = told.withColumn("operand", F.count_if(starts).over(by))
    operand = told.groupBy("doc_id", "unit", "operand").agg(F.filter(in_order(F.col("tok")), lambda t: t != "==").alias("toks"))
    rule = operand.groupBy("doc_id", "unit", F.floor((F.col("operand") + 1) / 2).alias("clause")).agg(
        F.max(F.when(F.col("operand") % 2 == 1, F.col("toks"))).alias("old"), F.max(F.when(F.col("operand") % 2 == 0, F.col("toks"))).alias("new")
    )
    ordered = F.array_sort(F.collect_list(F.struct("clause", "old", F.coalesce("new", F.array().cast("array<string>")).alias("new"))))
    return rule.groupBy("doc_id", "unit").agg(F.filter(ordered, lambda r: F.size(r["old"]) > 0).alias("rules"))


def encoded(toks: Column, between: str = "") -> Column:
    return F.array_join(F.transform(toks, lambda t: F.concat(F.lit(OPEN), t, F.lit(CLOSE))), between)


def decoded(text: Column) -> Column:
    return F.filter(F.split(text, f"[{OPEN}{CLOSE}]+"), lambda t: F.trim(t) != "")


def applied(text: Column, rules: Column) -> Column:
    """An encoded text after all rules in their order: a rule replaces runs of tokens, in any case, over line ends."""

    def step(s: Column, r: Column) -> Column:
        quoted = F.transform(r["old"], lambda t: F.concat(F.lit(OPEN), F.regexp_replace(t, _PUNCTUATION, r"\\$1"), F.lit(CLOSE)))
        new = F.regexp_replace(encoded(r["new"], " "), r"([\\$])", r"\\$1")
        return F.regexp_replace(s, F.concat(F.lit("(?i)"), F.array_join(quoted, _BETWEEN)), new)

    return F.aggregate(rules, text, step)


def statements(said: DataFrame) -> DataFrame:
    """doc_id, unit, is_off of REPLACE statements: OFF is the word behind REPLACE. said: of classified()."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "unit").orderBy("line_no", "place"))
    off = (F.col("up") == "OFF") & ~F.col("inside") & (F.col("nth") == 2)
    return said.withColumn("nth", nth).groupBy("doc_id", "unit").agg(F.max(off).alias("is_off"))


def scopes(statements: DataFrame) -> DataFrame:
    """doc_id, nth, level, last: the REPLACE statements that open a scope, numbered among the REPLACE statements of their
    document; the scope holds up to statement `last` (null: the end). statements: doc_id, unit, is_off."""
    by = Window.partitionBy("doc_id").orderBy("unit")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = statements.withColumn("nth", F.row_number().over(by)).withColumn("sum", F.sum(F.when(F.col("is_off"), -1).otherwise(1)).over(so_far))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("depth").over(by), F.lit(0)))
    rows = rows.where(~F.col("is_off") | (F.col("before") > F.col("depth"))).withColumn("level", F.when(F.col("is_off"), F.col("before")).otherwise(F.col("depth")))
    end = F.lead("nth").over(Window.partitionBy("doc_id", "level").orderBy("nth")) - 1
    return rows.withColumn("last", end).where(~F.col("is_off")).select("doc_id", "unit", "nth", "level", "last")


def replaced_lines(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, toks: code after all REPLACE scopes. rows: of classified()."""
    by = Window.partitionBy("doc_id").orderBy("line_no", "place").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("kind") == "REPLACE") & (F.coalesce(F.lag("unit").over(Window.partitionBy("doc_id", "kind").orderBy("line_no", "place")), F.lit(-1)) != F.col("unit"))
    rows = rows.where(F.col("kind").isin("CODE", "REPLACE")).withColumn("starts", starts).withColumn("segment", F.count_if("starts").over(by))
    said = rows.where("kind = 'REPLACE'")
    opened = scopes(statements(said)).join(clauses(said), ["doc_id", "unit"])
    head = F.concat(F.lit("\n"), F.col("line_no").cast("string"))
    line = rows.where("kind = 'CODE'").groupBy("doc_id", "segment", "line_no").agg(F.concat(head, encoded(in_order(F.col("tok")))).alias("text"))
    code = line.groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("text"))
    final = rows.groupBy("doc_id").agg(F.max("segment").alias("final"))
    each = opened.join(final, "doc_id").select("doc_id", "level", "rules", F.explode(F.sequence("nth", F.coalesce("last", "final").cast("int"))).alias("segment"))
    active = each.groupBy("doc_id", "segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("level", "rules"))), lambda x: x["rules"])).alias("rules"))
    changed = code.join(active, ["doc_id", "segment"], "left").withColumn("text", F.when(F.col("rules").isNotNull(), applied(F.col("text"), F.col("rules"))).otherwise(F.col("text")))
    parts = changed.select("doc_id", "segment", F.explode(F.split("text", "\n")).alias("part")).where("part <> ''")
    toks = decoded(F.regexp_replace("part", "^-?[0-9]+", ""))
    whole = parts.select("doc_id", F.regexp_extract("part", "^-?[0-9]+", 0).cast("long").alias("line_no"), "segment", toks.alias("toks"))
    joined = whole.groupBy("doc_id", "line_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", "toks"))), lambda x: x["toks"])).alias("toks"))
    return joined.where(F.size("toks") > 0)


def replace_scopes(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line: code lines after their REPLACE statements, which go."""
    return replaced_lines(classified(tokens(lines))).select("doc_id", "line_no", spaced(F.col("toks")).alias("line"))


def included(rows: DataFrame, books: DataFrame) -> DataFrame:
    """doc_id, line_no, kind, text of COPY statements: the book's lines after REPLACING with their spaces, on one row; a comment for unknown books. rows: of classified(); books: name, content."""
    said = rows.where("kind = 'COPY'")
    one = said.groupBy("doc_id", "unit").agg(F.min("line_no").alias("line_no"), in_order(F.col("tok")).alias("toks"))
    name = F.upper(F.regexp_replace(F.get("toks", F.lit(1)), "[\"'.]", ""))
    found = one.withColumn("book", name).join(books.select(F.upper("name").alias("book"), "content"), "book", "left").join(clauses(said), ["doc_id", "unit"], "left")
    body = F.transform(F.split("content", r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1f]", " "), f"({TOKEN})", f"{OPEN}$1{CLOSE}"))
    text = F.array_join(F.transform(body, lambda x, i: F.concat(F.lit("\n"), i.cast("string"), x)), "")
    changed = F.when(F.col("rules").isNotNull(), applied(text, F.col("rules"))).otherwise(text)
    lines = F.transform(F.split(changed, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^-?[0-9]+", ""), f"[{OPEN}{CLOSE}]", "")))
    shown = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    missing = F.format_string("* COPY %s content not found.", F.coalesce("book", F.lit("")))
    return found.select("doc_id", "line_no", F.lit("COPY").alias("kind"), F.coalesce(shown, missing).alias("text"))


def preprocessed(lines: DataFrame, books: DataFrame) -> DataFrame:
    """doc_id, line_no, kind, text: code lines after REPLACE, EXEC blocks and compiler options on one line each, copybooks in
    place of COPY and of EXEC SQL INCLUDE; comments, comment entries, EJECT, SKIP and TITLE are gone. books: name, content.
    Callers that want no options drop their kind."""
    rows = storage.cut(classified(tokens(comment_entries(lines))))  # four kinds are read from it
    code = replaced_lines(rows).select("doc_id", "line_no", F.lit("CODE").alias("kind"), spaced(F.col("toks")).alias("text"))
    block = rows.where(F.col("kind").startswith("EXEC_")).groupBy("doc_id", "unit", "kind").agg(F.min("line_no").alias("line_no"), in_order(F.col("tok")).alias("toks"))
    book = F.when(
        (F.col("kind") == "EXEC_SQL") & (F.upper(F.get("toks", F.lit(2))) == "INCLUDE") & (F.upper(F.get("toks", F.lit(4))) == "END-EXEC"), F.upper(F.get("toks", F.lit(3)))
    )
    blocks = block.withColumn("book", book).join(books.select(F.upper("name").alias("book"), "content"), "book", "left")
    folded = blocks.select("doc_id", "line_no", "kind", F.coalesce("content", spaced(F.col("toks"))).alias("text"))
    option = rows.where("kind = 'OPTIONS'").groupBy("doc_id", "line_no").agg(in_order(F.col("tok")).alias("toks"))
    options = option.select("doc_id", "line_no", F.lit("OPTIONS").alias("kind"), spaced(F.col("toks")).alias("text"))
    return code.unionByName(folded).unionByName(options).unionByName(included(rows, books))
