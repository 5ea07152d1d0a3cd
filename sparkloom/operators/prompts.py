"""Prompt and report texts: budget packing and rendering, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import trees

# Points of a procedure for a prompt, by parts of its name.
IMPORTANCE = [(100, ["MAIN", "INIT"]), (50, ["PROCESS", "VALIDATE", "CALC"]), (30, ["READ", "WRITE"])]


def importance(name: Column, n_lines: Column) -> Column:
    """100, 50, 30 or 20 by name, and a point for each line up to 50."""
    points = F.lit(20)
    for value, parts in reversed(IMPORTANCE):
        points = F.when(fx.any_of(F.upper(name), parts), value).otherwise(points)
    return points + F.least(n_lines, F.lit(50))


def packed(procs: DataFrame, budget: int = 500, most: int = 50, key: str = "doc_id") -> DataFrame:
    """key, name, ord, taken: in order of importance a procedure is taken if it fits what is left of the budget and is no
    longer than `most`; else it is summed up, and the next may still fit. procs: key, name, n_lines, importance."""
    row = F.struct((-F.col("importance")).alias("k"), "name", F.col("n_lines").cast("int").alias("n_lines"))
    shape = "array<struct<name:string,taken:boolean>>"

    def step(s, x):
        fits = (x["n_lines"] <= s["left"]) & (x["n_lines"] <= most)
        return F.struct(
            F.when(fits, s["left"] - x["n_lines"]).otherwise(s["left"]).alias("left"), F.concat(s["out"], F.array(F.struct(x["name"].alias("name"), fits.alias("taken")))).alias("out")
        )

    start = F.struct(F.lit(budget).alias("left"), F.array().cast(shape).alias("out"))
    made = procs.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step, lambda s: s["out"]).alias("out"))
    return made.select(key, F.posexplode("out").alias("ord", "x")).select(key, "ord", "x.name", "x.taken")


def prompt(found: DataFrame, request: str, tokens: int = 2000) -> DataFrame:
    """One prompt from ranked chunks (name, content, score, ord): the request, then chunks while they fit the budget."""
    part = F.format_string("### %s\n%s\n", F.coalesce("name", F.lit("-")), fx.truncated(F.col("content")))
    row = F.struct((-F.col("score")).alias("k"), "ord", part.alias("t"))

    def step(s, x):
        fits = ~s["full"] & (s["used"] + F.length(x["t"]) <= 4 * tokens)
        return F.struct(
            F.when(fits, F.concat(s["text"], x["t"])).otherwise(s["text"]).alias("text"), F.when(fits, s["used"] + F.length(x["t"])).otherwise(s["used"]).alias("used"), (s["full"] | ~fits).alias("full")
        )

    start = F.struct(F.lit(f"Task: {request}\n\n").alias("text"), F.lit(len(request) + 8).alias("used"), F.lit(False).alias("full"))
    return found.agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step, lambda s: s["text"]).alias("prompt"))


def procedure_prompts(procs: DataFrame) -> DataFrame:
    """doc_id, position, name, prompt: one for each procedure in execution order. procs: doc_id, position, name, kind, label, code, callers."""
    text = F.format_string(
        "Convert procedure %s (%s, %s).\nMethod: %s\nCalled by: %s\nLogic: %s\nKey lines:\n%s", "name", "kind", "label", fx.camel(F.col("name")),
        F.when(F.size("callers") > 0, F.array_join("callers", ", ")).otherwise("nothing"), fx.logic_summary(F.col("code")), F.array_join(fx.key_lines(F.col("code")), "\n"),
    )
    return procs.select("doc_id", "position", "name", text.alias("prompt"))


def rules_summary(rules: DataFrame) -> DataFrame:
    """One text over all rules, in their order."""
    line = F.struct("ord", F.format_string("%s -> %s", "rule", F.coalesce("return_type", F.lit("-"))).alias("t"))
    return rules.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))


def s_expression(procs: DataFrame, statements: DataFrame) -> DataFrame:
    """doc_id, text: (ANALYSIS (PROCEDURE "name" (SCORE n) (STATEMENTS (TYPE "text" line) ...)) ...), texts cut at 150."""
    one = F.format_string('(%s "%s" %d)', "type", fx.escaped(fx.shortened(F.col("content"), 150)), "line_no")
    body = statements.groupBy("doc_id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", one.alias("t")))), lambda x: x["t"]), " ").alias("body"))
    rows = procs.join(body, ["doc_id", "paragraph"], "left")
    proc = F.format_string('(PROCEDURE "%s" (SCORE %d) (START-LINE %d) (END-LINE %d) (STATEMENTS %s))', fx.escaped(F.col("paragraph")), "score", "start_line", "end_line", F.coalesce("body", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("start_line", proc.alias("t"))))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("(ANALYSIS "), F.array_join(F.transform(ordered, lambda x: x["t"]), " "), F.lit(")")).alias("text"))


def parse_s_expression(texts: DataFrame) -> DataFrame:
    """The statements of such texts: doc_id, paragraph, type, content, line_no."""
    return trees.statements(trees.facts(texts))


def parse_procedures(lines: DataFrame) -> DataFrame:
    """The procedures of such texts read line by line, whole or one item a line: doc_id, paragraph, score, start_line, end_line.
    lines: doc_id, line_no, line. An item belongs to the last procedure that began at or before it."""
    item = r'\((PROCEDURE|SCORE|START-LINE|END-LINE) ("(?:[^"\\]|\\.)*"|-?[0-9.]+)'
    found = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(item), F.lit(0))).alias("place", "i"))
    rows = found.select("doc_id", "line_no", "place", F.regexp_extract("i", item, 1).alias("key"), F.regexp_extract("i", item, 2).alias("value"))
    by = Window.partitionBy("doc_id").orderBy("line_no", "place")
    rows = rows.withColumn("nth", F.count_if(F.col("key") == "PROCEDURE").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("nth > 0")
    value = lambda k: F.min_by("value", F.when(F.col("key") == k, F.struct("line_no", "place")))
    held = rows.groupBy("doc_id", "nth").agg(*[value(k).alias(c) for k, c in (("PROCEDURE", "p"), ("SCORE", "score"), ("START-LINE", "start_line"), ("END-LINE", "end_line"))])
    return held.select("doc_id", trees.unquoted(F.col("p")).alias("paragraph"), F.col("score").cast("double"), F.col("start_line").cast("int"), F.col("end_line").cast("int"))


def items_json(items: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text: a document's data items as one JSON list in order of lines, each with its level, name and the given columns; empty ones are left out."""
    row = F.struct("line_no", F.struct("level", "name", *columns).alias("item"))
    return items.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["item"])).alias("text"))


def java_fields(items: DataFrame) -> DataFrame:
    """doc_id, text: a class body from elementary data items."""
    kind = F.when(F.col("type") == "NUMERIC_DECIMAL", "BigDecimal").when(F.col("type") == "NUMERIC_INTEGER", "Long").otherwise("String")
    line = F.struct("line_no", F.format_string("    private %s %s;", kind, fx.camel(F.col("name"))).alias("t"))
    rows = items.where("kind = 'ELEMENTARY' and name is not null and upper(name) <> 'FILLER'")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
