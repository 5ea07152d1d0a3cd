"""Call graphs: resolution, reference counts, classification, execution order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fx
from ..sources import storage


def resolved(edges: DataFrame, defined: DataFrame) -> DataFrame:
    """Edges with is_external: the target is no defined name of the document. defined: doc_id, name."""
    names = defined.select("doc_id", F.col("name").alias("target"), F.lit(True).alias("known")).distinct()
    return edges.join(names, ["doc_id", "target"], "left").withColumn("is_external", F.col("known").isNull()).drop("known")


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to node ids by name in any case; of nodes with one name the last counts. nodes: doc_id, id, name."""
    last = nodes.groupBy("doc_id", F.lower("name").alias("key")).agg(F.max("id").alias("callee_id"))
    return edges.withColumn("key", F.lower("target")).join(last, ["doc_id", "key"]).drop("key")


def reference_counts(edges: DataFrame) -> DataFrame:
    """doc_id, name (upper case), refs."""
    return edges.groupBy("doc_id", F.upper("target").alias("name")).agg(F.count("*").alias("refs"))


def best_variant_count(names: DataFrame, counts: DataFrame) -> DataFrame:
    """refs of a name: the most that any of its spellings has (as is, upper, lower, - for _, none of both)."""
    n = F.col("name")
    spelt = names.select("doc_id", "name", F.explode(F.array_distinct(F.array(n, F.upper(n), F.lower(n), F.replace(n, F.lit("_"), F.lit("-")), F.regexp_replace(n, "[-_]", "")))).alias("key"))
    found = spelt.join(counts.select("doc_id", F.col("name").alias("key"), "refs"), ["doc_id", "key"], "left")
    return found.groupBy("doc_id", "name").agg(F.coalesce(F.max("refs"), F.lit(0)).alias("refs"))


def callers(edges: DataFrame) -> DataFrame:
    """doc_id, target, callers (sorted), n."""
    return edges.groupBy("doc_id", "target").agg(F.array_sort(F.collect_set("caller")).alias("callers"), F.count("*").alias("n"))


def coverage(edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row a document: distinct targets, those found, percent."""
    targets = edges.select("doc_id", F.upper("target").alias("name")).distinct()
    known = found.select("doc_id", F.upper("name").alias("name")).distinct().withColumn("known", F.lit(1))
    rows = targets.join(known, ["doc_id", "name"], "left").groupBy("doc_id").agg(F.count("*").alias("targets"), F.count("known").alias("found"))
    return rows.withColumn("coverage", F.round(100.0 * F.col("found") / F.col("targets"), 2))


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Procedures of both by upper-case name: statements of `extra` where it has them, the higher score. doc_id, name, statements, score."""
    a = base.select("doc_id", F.upper("name").alias("key"), F.col("name").alias("a_name"), F.col("statements").alias("a_n"), F.col("score").alias("a_s"))
    b = extra.select("doc_id", F.upper("name").alias("key"), F.col("name").alias("b_name"), F.col("statements").alias("b_n"), F.col("score").alias("b_s"))
    both = a.join(b, ["doc_id", "key"], "full_outer")
    return both.select("doc_id", F.coalesce("a_name", "b_name").alias("name"), F.coalesce("b_n", "a_n").alias("statements"), F.greatest("a_s", "b_s").alias("score"))


def added(base: DataFrame, extra: DataFrame, any_case: bool = False) -> DataFrame:
    """base and those of extra whose name it lacks."""
    key = F.upper("name") if any_case else F.col("name")
    more = extra.withColumn("key", key).join(base.select("doc_id", key.alias("key")), ["doc_id", "key"], "left_anti").drop("key")
    return base.unionByName(more, allowMissingColumns=True)


def nodes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, name, calls (times called; 0 for procedures that nothing calls)."""
    counts = edges.groupBy("doc_id", F.col("target").alias("name")).agg(F.count("*").alias("calls"))
    return names.select("doc_id", "name").distinct().join(counts, ["doc_id", "name"], "full_outer").select("doc_id", "name", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


def classified(graph: DataFrame) -> DataFrame:
    """kind: entry, init, cleanup, core or support, by name and by calls against the document's least, most and mean."""
    by = Window.partitionBy("doc_id")
    low, calls = F.lower("name"), F.col("calls")
    least, most, mean = F.min("calls").over(by), F.max("calls").over(by), F.avg("calls").over(by)
    has = lambda *p: fx.any_of(low, p)
    seldom = calls <= F.greatest(F.lit(2.0), mean * 0.3)
    core = F.floor(F.greatest(mean, most * 0.6))
    entry = (calls == least) & (least <= 1) & (has("main", "start", "begin") | (calls == 0))
    init = has("init", "setup", "open", "start", "begin", "load") | (has("read") & has("parm")) | (seldom & (F.length("name") > 4))
    cleanup = has("term", "cleanup", "close", "end", "finish", "stop", "exit") | (seldom & has("final"))
    kind = F.when(entry, "entry").when(init, "init").when(cleanup, "cleanup").when(calls >= core, "core").otherwise("support")
    return graph.withColumn("kind", kind)


def execution_order(rows: DataFrame) -> DataFrame:
    """position: entry, init, core, support, cleanup, by name within each."""
    rank = F.when(F.col("kind") == "entry", 0).when(F.col("kind") == "init", 1).when(F.col("kind") == "core", 2).when(F.col("kind") == "support", 3).otherwise(4)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "name")))


def call_pattern(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """group: Entry Points (never called), Business Logic (calls others), Utility."""
    calling = edges.select("doc_id", F.col("caller").alias("name"), F.lit(True).alias("calls_out")).distinct()
    rows = graph.join(calling, ["doc_id", "name"], "left")
    group = F.when(F.col("calls") == 0, "Entry Points").when(F.col("calls_out").isNotNull(), "Business Logic").otherwise("Utility")
    return rows.select("doc_id", "name", "calls", group.alias("group"))


def longest_path(edges: DataFrame) -> DataFrame:
    """doc_id, name, depth: the longest chain of calls that ends in the name, from names nothing calls. Names that reach each
    other are one link of a chain and have one depth; a cycle that nothing else calls begins chains. One job: a document's
    distinct calls are one row, which takes time in proportion to them; the rows of many documents pass through Python at once."""
    pair = F.struct("caller", "target")
    held = edges.where("caller is not null and target is not null").groupBy("doc_id").agg(F.collect_set(pair).alias("pairs"))
    made = T.StructType([edges.schema["doc_id"], T.StructField("name", T.StringType()), T.StructField("depth", T.IntegerType())])

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, pairs = batch.column("pairs").offsets.to_pylist(), batch.column("pairs").values
            callers, targets = pairs.field("caller").to_pylist(), pairs.field("target").to_pylist()
            at, names, found = [], [], []
            for k in range(batch.num_rows):
                of_doc = chain_depths(list(zip(callers[ends[k] : ends[k + 1]], targets[ends[k] : ends[k + 1]], strict=True)))
                at += [k] * len(of_doc)
                names += of_doc
                found += of_doc.values()
            docs = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array(names, pa.string()), pa.array(found, pa.int32())], ["doc_id", "name", "depth"])

    return held.mapInArrow(depths, made)


def chain_depths(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Depth of each name; components are found in one walk, callees first, so that walking them backwards meets callers first."""
    ahead: dict[str, list[str]] = {}
    for caller, target in pairs:
        ahead.setdefault(caller, []).append(target)
        ahead.setdefault(target, [])
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    part: dict[str, int] = {}
    open_: list[str] = []
    parts = 0
    for root in ahead:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        open_.append(root)
        walk = [(root, iter(ahead[root]))]
        while walk:
            name, rest = walk[-1]
            for target in rest:
                if target not in seen:
                    seen[target] = low[target] = len(seen)
                    open_.append(target)
                    walk.append((target, iter(ahead[target])))
                    break
                if target not in part:
                    low[name] = min(low[name], seen[target])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[name])
                if low[name] == seen[name]:
                    while True:
                        member = open_.pop()
                        part[member] = parts
                        if member == name:
                            break
                    parts += 1
    depth = [0] * parts
    for name in sorted(ahead, key=lambda n: -part[n]):
        for target in ahead[name]:
            if part[target] != part[name]:
                depth[part[target]] = max(depth[part[target]], depth[part[name]] + 1)
    return {name: depth[part[name]] for name in ahead}


def rule_matches(procs: DataFrame, rules: DataFrame) -> DataFrame:
    """Procedures and the rules that match them: the architecture is one of the rule's (or it has none), and the name or
    the code matches a pattern, or the rule has neither. procs: doc_id, name, code, label. rules: rule, ord, override,
    labels, name_patterns, code_patterns. A rule that overrides hides those before it."""
    p, r = procs, rules
    both = p.join(r, (F.size(r.labels) == 0) | F.array_contains(r.labels, p.label))
    find = lambda patterns, text: F.exists(patterns, lambda x: F.regexp_like(text, F.concat(F.lit("(?i)"), x)))
    neither = (F.size("name_patterns") == 0) & (F.size("code_patterns") == 0)
    both = both.where(neither | F.exists("name_patterns", lambda x: F.regexp_like("name", F.concat(F.lit("(?i)^(?:"), x, F.lit(")\\z")))) | find(F.col("code_patterns"), F.col("code")))
    last = F.coalesce(F.max(F.when(F.col("override"), F.col("ord"))).over(Window.partitionBy("doc_id", "name")), F.lit(-1))
    return both.withColumn("cut", last).where("ord >= cut").select("doc_id", "name", "rule", "ord")


def nearest(points: DataFrame, anchors: DataFrame, x: str, into: str, key: str = "diagram") -> DataFrame:
    """For each point the anchor of the diagram with the least distance in x; ties by ord. anchors: key, name, ax, ord.

    Points and anchors of a diagram are sorted together by x, so a point looks at the last anchor before it and the
    first after it, and no pairs are made. Both are running values, the latter from the far end, because a frame that
    runs to the end is gone through anew for each row. A diagram without anchors has no points in the result.
    """
    anchor = F.struct("ax", "ord", "name")
    places = anchors.groupBy(key, "ax").agg(F.min(F.struct("ord", "name")).alias("a")).select(key, "ax", "a.ord", "a.name")
    both = points.select(key, F.col(x).cast("double").alias("__x"), F.lit(1).alias("__point"), F.struct(*points.columns).alias("__row"), F.lit(None).cast(places.select(anchor.alias("a")).schema["a"].dataType).alias("__a"))
    both = both.unionByName(places.select(key, F.col("ax").cast("double").alias("__x"), F.lit(0).alias("__point"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), anchor.alias("__a")))
    last = lambda *order: F.last("__a", ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before, after = last("__x", "__point"), last(F.desc("__x"), F.desc("__point"))
    found = both.select("__row", "__x", "__point", before.alias("b"), after.alias("f")).where("__point = 1 and (b is not null or f is not null)")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("__x") - F.col(f"{c}.ax")).alias("d"), F.col(f"{c}.ord").alias("ord"), F.col(f"{c}.name").alias("name")))
    return found.select("__row.*", F.least(rank("b"), rank("f"))["name"].alias(into))


def with_role(points: DataFrame, legend: dict[str, str], colour: str = "color", into: str = "group", other: str = "Unknown") -> DataFrame:
    """The legend's role of each colour, `other` where it has none. The legend is a parameter and becomes part of the plan."""
    roles = F.create_map(*[F.lit(x) for kv in legend.items() for x in kv]) if legend else F.lit(None).cast("map<string,string>")
    return points.withColumn(into, F.coalesce(F.element_at(roles, F.col(colour)), F.lit(other)))


def mermaid_sequence(steps: DataFrame, key: str = "diagram") -> DataFrame:
    """One text a diagram from steps (key, y, source, target, message), from top to bottom."""
    row = F.struct("y", F.format_string("    %s->>%s: %s", "source", "target", "message").alias("t"))
    return steps.groupBy(key).agg(F.concat(F.lit("sequenceDiagram\n"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n")).alias("text"))


def mermaid_graph(edges: DataFrame) -> DataFrame:
    """One text a document: caller --> target lines, sorted."""
    line = F.format_string("    %s --> %s", "caller", "target")
    return edges.where("caller is not null").groupBy("doc_id").agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("text"))


def scaled(value: str, low: float = 30, span: float = 40) -> Column:
    """Min-max scaled over all rows of the document; the middle where all are equal."""
    by = Window.partitionBy("doc_id")
    lo, hi = F.min(value).over(by), F.max(value).over(by)
    return low + span * F.when(hi == lo, 0.5).otherwise((F.col(value) - lo) / (hi - lo))
