"""Lines and procedure-aware chunks, fill-forward state and blocks, as windows within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What begins a procedure, by language; the names are in the first group.
PROCEDURES = {
    "tal": r"(?i)^\s*(?:PROC|SUBPROC|PROCEDURE)\s+([A-Za-z_][A-Za-z0-9_]*)",
    "c": r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s*\{",
}


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def pinned(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that what was computed is not written out again for each use above."""
    return rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns]))))


def chunks(docs: DataFrame, boundary: Column | None = None, most_lines: int = 151, key: str = "doc_id", text: str = "text", name: Column | None = None) -> DataFrame:
    """Chunks of a document: a boundary line begins one, and every `most_lines` lines of it another; blank ones are dropped.

    boundary and name are columns over `line`. Returns key, chunk_id (dense from 0), start_line, end_line, name (of the
    boundary line; null in continuations), content. A boundary moves up to the first of the blank lines right before it.
    """
    by = Window.partitionBy(key).orderBy("line_no")
    starts = F.coalesce(boundary if boundary is not None else F.lit(False), F.lit(False))
    rows = lines(docs, key, text).withColumn("starts", starts).withColumn("called", name if name is not None else F.lit(None).cast("string"))
    blank = F.trim(F.regexp_replace("line", r"[\t\r]", "")) == ""
    rows = rows.withColumn("solid", F.when(~blank, F.struct("starts", "called")))
    after = F.first("solid", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("opens", blank & F.coalesce(after["starts"], F.lit(False))).withColumn("opens_name", after["called"])
    before_blank = F.lag(blank, 1, False).over(by)
    head = (F.col("opens") & ~before_blank) | (F.col("starts") & ~before_blank)
    rows = rows.withColumn("segment", F.sum(head.cast("int")).over(by))
    segment = Window.partitionBy(key, "segment")
    rows = rows.withColumn("part", F.floor((F.col("line_no") - F.min("line_no").over(segment)) / most_lines).cast("int"))
    out = rows.groupBy(key, "segment", "part").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.max(F.when(F.col("starts") & (F.col("part") == 0), F.col("called"))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    out = out.where(F.trim(F.regexp_replace("content", r"[\s]", "")) != "")
    number = (F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1).cast("int")
    return out.select(key, number.alias("chunk_id"), "start_line", "end_line", "name", "content")


def fill_forward(rows: DataFrame, marker: Column, into: str, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The last marker that isn't null, at or before each row."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(marker, ignorenulls=True).over(by))


def end_lines(starts: DataFrame, last_line: Column, key: str = "doc_id", line: str = "line_no") -> DataFrame:
    """end_line: the line before the next start of the document, or its last line."""
    by = Window.partitionBy(key).orderBy(line)
    return starts.withColumn("end_line", F.coalesce(F.lead(line).over(by) - 1, last_line))


def depth_end(rows: DataFrame, opens: Column, closes: Column, key: list[str], line: str = "line_no", fallback: int = 50) -> DataFrame:
    """For each key the first line at which as many blocks have closed as opened, else first line + fallback."""
    by = Window.partitionBy(*key).orderBy(line)
    depth = F.sum(opens.cast("int") - closes.cast("int")).over(by)
    held = rows.select(*key, line, depth.alias("depth"), closes.alias("closes"))
    done = F.min(F.when((F.col("depth") <= 0) & F.col("closes"), F.col(line)))
    return held.groupBy(*key).agg(F.coalesce(done, F.min(line) + fallback).alias("end_line"))


def parents(items: DataFrame, levels: list[int], key: str = "doc_id", line: str = "line_no", level: str = "level", never: int = 88) -> DataFrame:
    """parent: the nearest earlier item of a smaller level; items of level `never` are no parents."""
    by = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda k: F.last(F.when(F.col(level) == k, F.col(line)), ignorenulls=True).over(by)
    best = F.greatest(F.lit(-1), *[F.coalesce(F.when(F.col(level) > k, seen(k)), F.lit(-1)) for k in sorted(levels) if k != never])
    return items.withColumn("parent", F.when(best >= 0, best))


def statement_groups(rows: DataFrame, starts: Column, ends: Column, key: str = "doc_id", line: str = "line_no") -> DataFrame:
    """Joins the lines of statements that run over several: a group begins at a start, or after an end."""
    by = Window.partitionBy(key).orderBy(line)
    begins = starts | F.coalesce(F.lag(ends).over(by), F.lit(True))
    held = rows.withColumn("begins", begins.cast("int")).withColumn("statement", F.sum("begins").over(by))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, F.trim("line").alias("t")))), lambda x: x["t"]), " ")
    return held.groupBy(key, "statement").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line"), joined.alias("content"))


#: Block kinds by the statement type that opens them, and the type that closes them.
BLOCKS = {"IF": ("IF_BLOCK", "END-IF"), "EXEC_SQL": ("SQL_BLOCK", "END-EXEC"), "EVALUATE": ("EVALUATE_BLOCK", "END-EVALUATE")}
SKIPPED = ["STATEMENT", "RECOVERED", "END_CLAUSE"]


def blocks(statements: DataFrame, key: str = "proc", order: str = "line") -> DataFrame:
    """key, block, kind, start_line, end_line, n_statements. An opener takes all up to its first closer, or to the end."""
    row = F.struct(F.col(order).cast("long").alias("line"), F.col("type"))
    shape = "array<struct<kind:string,start:bigint,end:bigint,n:bigint>>"

    def step(s, x):
        inside = s["closer"].isNotNull()
        closing = inside & (x["type"] == s["closer"])
        opens, closes = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verb, (kind, closer) in BLOCKS.items():
            opens, closes = F.when(x["type"] == verb, kind).otherwise(opens), F.when(x["type"] == verb, closer).otherwise(closes)
        current = F.struct(F.coalesce(opens, x["type"]).alias("kind"), x["line"].alias("start"), x["line"].alias("end"), F.lit(1).cast("long").alias("n"))
        grown = F.struct(s["open"]["kind"].alias("kind"), s["open"]["start"].alias("start"), F.when(closing, x["line"]).otherwise(s["open"]["end"]).alias("end"), (s["open"]["n"] + 1).alias("n"))
        skipped = ~inside & x["type"].isin(*SKIPPED)
        single = ~inside & ~skipped & opens.isNull()
        return F.struct(
            F.when(closing, F.concat(s["done"], F.array(grown))).when(single, F.concat(s["done"], F.array(current))).otherwise(s["done"]).alias("done"),
            F.when(inside, grown).when(opens.isNotNull(), current).alias("open"),
            F.when(inside & ~closing, s["closer"]).when(~inside & opens.isNotNull(), closes).alias("closer"),
        )

    start = F.struct(F.array().cast(shape).alias("done"), F.lit(None).cast("struct<kind:string,start:bigint,end:bigint,n:bigint>").alias("open"), F.lit(None).cast("string").alias("closer"))
    finish = lambda s: F.when(s["closer"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    made = statements.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step, finish).alias("made"))
    out = made.select(key, F.posexplode("made").alias("block", "b"))
    return out.select(key, "block", F.col("b.kind").alias("kind"), F.col("b.start").alias("start_line"), F.col("b.end").alias("end_line"), F.col("b.n").alias("n_statements"))


def block_chain(found: DataFrame, key: str = "proc") -> DataFrame:
    """Edges between consecutive blocks."""
    return found.select(key, "block", F.lead("block").over(Window.partitionBy(key).orderBy("block")).alias("next")).where("next is not null")
