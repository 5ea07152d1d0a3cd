"""Ranked searches. Each is one lazy plan: filter, score, top k.

chunks: source_file, chunk_id, ord, content, name, words, function_calls, message_patterns, detected_networks, flows
(array of (name, score)), primary_flow, secondary_flows. Ties: `newest` orders by file and chunk descending, `corpus`
by ordinal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources import storage
from . import weights


def top(rows: DataFrame, k: int, ties: str = "newest") -> DataFrame:
    order = [F.desc("source_file"), F.desc("chunk_id")] if ties == "newest" else [F.asc("ord")]
    return rows.orderBy(F.desc("score"), *order).limit(k)


def has(text: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def flow_score(chunks_flows: Column, flow: str) -> Column:
    found = F.get(F.filter(chunks_flows, lambda x: x["name"] == flow), F.lit(0))
    return F.coalesce(found["score"].cast("double"), F.lit(0.0))


def in_flow(flow: str) -> Column:
    return F.coalesce(F.col("primary_flow") == flow, F.lit(False)) | F.array_contains("secondary_flows", flow)


def enhanced(rows: DataFrame, query: Sequence[str], category_words: Column, name_parts: Column, k: int = 15, category: Column | None = None) -> DataFrame:
    """Share of query words found, plus 0.1 for each query word in the category and in the name; with what matched, and the
    reasons of the score. category: what the category is called in them."""
    q = F.array(*map(F.lit, dict.fromkeys(query)))
    overlap, in_category, in_name = (F.size(F.array_intersect(x, q)) for x in ("words", category_words, name_parts))
    score = overlap / F.lit(float(len(set(query)))) + 0.1 * in_category + 0.1 * in_name
    reasons = [
        F.format_string("Keyword overlap: %d terms", overlap), F.when(in_category > 0, F.concat(F.lit("Semantic category: "), F.lit(None).cast("string") if category is None else category)),
        F.when(in_name > 0, F.concat(F.lit("Procedure: "), "name")),
    ]
    found = rows.where(overlap > 0).withColumns({"score": F.round(score, 6), "keyword_matches": F.array_sort(F.array_intersect("words", q)), "reasons": F.array_compact(F.array(*reasons))})
    return top(found, k, "corpus")


def ticket(rows: DataFrame, title: str, description: str, criteria: str, stop: Sequence[str], category_words: Column, name_parts: Column, k: int = 20) -> DataFrame:
    """enhanced() for a ticket's texts together."""
    import re

    words = [w for w in re.findall(r"[a-z_][a-z0-9_]*", f"{title} {description} {criteria}".lower()) if len(w) >= 3 and w not in stop]
    return enhanced(rows, words, category_words, name_parts, k)


def by_topic(rows: DataFrame, share: Column, least: float = 0.0, k: int = 15) -> DataFrame:
    return top(rows.withColumn("score", share).where(F.col("score") > least), k, "corpus")


def by_flow(rows: DataFrame, flow: str, network: str | None = None, least: float = 0.0, k: int = 10) -> DataFrame:
    kept = rows.where(in_flow(flow)).withColumn("score", flow_score(F.col("flows"), flow))
    kept = kept.where(F.array_contains("detected_networks", network)) if network else kept
    return top(kept.where(F.col("score") >= least), k)


def by_network(rows: DataFrame, network: str, flow: str | None = None, k: int = 15) -> DataFrame:
    """Unscored, in corpus order."""
    kept = rows.where(F.array_contains("detected_networks", network))
    return (kept.where(F.col("primary_flow") == flow) if flow else kept).orderBy("ord").limit(k)


def message_score(message: str) -> Column:
    low = message.lower()
    return (
        F.when(has(F.col("content"), low), 2.0).otherwise(0.0)
        + 3.0 * F.size(F.filter("message_patterns", lambda m: F.contains(F.lower(m), F.lit(low))))
        + 2.5 * F.size(F.filter("function_calls", lambda c: F.contains(F.lower(c), F.lit(low))))
        + F.when(has(F.col("name"), low), 4.0).otherwise(0.0)
    )


def by_message(rows: DataFrame, message: str, network: str | None = None, k: int = 10) -> DataFrame:
    found = F.exists("message_patterns", lambda m: F.contains(F.lower(m), F.lit(message.lower()))) | has(F.col("content"), message)
    kept = rows.where(found & F.array_contains("detected_networks", network)) if network else rows.where(found)
    return top(kept.withColumn("score", message_score(message)), k)


def name_score(name: Column, wanted: str) -> Column:
    """10 equal, 8 contains, 6 contained, else 5 times the Jaccard similarity of the parts between underscores and blanks."""
    n, w = F.lower(F.coalesce(name, F.lit(""))), wanted.lower()
    parts = F.array(*map(F.lit, dict.fromkeys(w.replace("_", " ").split())))
    own = F.array_distinct(F.filter(F.split(n, "[_ ]"), lambda p: p != ""))
    jaccard = F.size(F.array_intersect(own, parts)) / F.size(F.array_union(own, parts))
    return F.when(n == w, 10.0).when(F.contains(n, F.lit(w)), 8.0).when((n != "") & F.contains(F.lit(w), n), 6.0).otherwise(5.0 * jaccard)


def by_procedure(rows: DataFrame, wanted: str, k: int = 10) -> DataFrame:
    return top(rows.withColumn("score", F.round(name_score(F.col("name"), wanted), 6)).where("score > 0"), k)


def function_score(calls: Column, wanted: str) -> Column:
    """For each call 5 equal, 3 contains, 2 contained."""
    w = wanted.lower()
    one = lambda c: F.when(F.lower(c) == w, 5.0).when(F.contains(F.lower(c), F.lit(w)), 3.0).when(F.contains(F.lit(w), F.lower(c)), 2.0).otherwise(0.0)
    return F.aggregate(calls, F.lit(0.0), lambda s, c: s + one(c))


def by_function(rows: DataFrame, wanted: str, k: int = 10) -> DataFrame:
    return top(rows.withColumn("score", function_score(F.col("function_calls"), wanted)).where("score > 0"), k)


def keyword_score(words: Sequence[str]) -> Column:
    """For each word: 0.5 an occurrence, 1 if a call has it, 2 if the name has it."""
    score = F.lit(0.0)
    for w in words:
        low = w.lower()
        score = score + 0.5 * fx.occurrences(F.lower("content"), low)
        score = score + F.when(F.exists("function_calls", lambda c: F.contains(F.lower(c), F.lit(low))), 1.0).otherwise(0.0)  # noqa: B023
        score = score + F.when(has(F.col("name"), low), 2.0).otherwise(0.0)
    return score


def by_keywords(rows: DataFrame, words: Sequence[str], k: int = 15, ties: str = "newest") -> DataFrame:
    return top(rows.withColumn("score", keyword_score(words)).where("score > 0"), k, ties)


# Words of the two pattern searches.
VALIDATION_WORDS = ["validate", "check", "verify", "format", "mandatory", "field", "required"]
ERROR_WORDS = ["error", "exception", "reject", "repair", "return", "fail", "invalid"]


def patterns(rows: DataFrame, flow: str, words: Sequence[str], filters: Sequence[str] = (), network: str | None = None, k: int = 10, most_words: int = 5) -> DataFrame:
    """Chunks of a flow or with its words: a point for each of the first words found, 3 as primary or 1.5 as secondary
    flow, and 2 for each filter text, all of which must occur."""
    hit = F.lit(False)
    for w in words:
        hit = hit | has(F.col("content"), w)
    kept = rows.where(in_flow(flow) | hit)
    for f in filters:
        kept = kept.where(has(F.col("content"), f))
    if network:
        kept = kept.where(F.array_contains("detected_networks", network))
    score = sum((F.when(has(F.col("content"), w), 1.0).otherwise(0.0) for w in words[:most_words]), F.lit(0.0))
    score = score + F.when(F.col("primary_flow") == flow, 3.0).when(F.array_contains("secondary_flows", flow), 1.5).otherwise(0.0) + 2.0 * len(filters)
    return top(kept.withColumn("score", score), k)


def validation_patterns(rows: DataFrame, kind: str | None = None, message: str | None = None, field: str | None = None, k: int = 10) -> DataFrame:
    return patterns(rows, "validation", VALIDATION_WORDS, [x for x in (kind, message, field) if x], k=k)


def error_patterns(rows: DataFrame, kind: str | None = None, network: str | None = None, k: int = 10) -> DataFrame:
    return patterns(rows, "exception_handling", ERROR_WORDS, [kind] if kind else [], network, k)


def iso_processing(rows: DataFrame, message: str, stage: str | None = None, k: int = 10) -> DataFrame:
    """by_message over the message's family at twice k, then 2 for a call and 3 for a name with it, 1 for the stage."""
    family = "".join(message.lower().split(".")[:2])
    first = by_message(rows, family, k=2 * k)
    score = F.col("score") + F.when(F.exists("function_calls", lambda c: F.contains(F.lower(c), F.lit(family))), 2.0).otherwise(0.0) + F.when(has(F.col("name"), family), 3.0).otherwise(0.0)
    if stage:
        first = first.where(has(F.col("content"), stage))
        score = score + 1.0
    return top(first.withColumn("score", score), k)


def similar_procedures(rows: DataFrame, reference: str, vector: str, least: float = 0.1, k: int = 5) -> DataFrame:
    """Cosine of flow vectors with the first chunk whose name contains the reference; itself excluded. Rows are computed once and
    read twice, so they should have few columns."""
    rows = storage.cut(rows)
    ref = rows.where(has(F.col("name"), reference)).orderBy("ord").limit(1).select(F.col("ord").alias("ref_ord"), F.col(vector).alias("ref"))
    named = rows.where(F.coalesce("name", F.lit("")) != "").join(F.broadcast(ref), F.col("ord") != F.col("ref_ord"))  # ref is one row
    return top(named.withColumn("score", F.round(weights.cosine(F.col(vector), F.col("ref")), 6)).where(F.col("score") > least).drop("ref", "ref_ord"), k)


def embedding_top(rows: DataFrame, query: Sequence[float], k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, score: cosine with the query, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, F.round(weights.cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def bm25(counts: DataFrame, query: Sequence[str], key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of documents with a query term; counts: key, term, n."""
    lengths = counts.groupBy(key).agg(F.sum("n").alias("len"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"))
    hits = counts.where(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most a row for each query term
    rows = hits.join(lengths, key).join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Union of two top lists, by the better of the two ranks, then key. Both are k rows long at most."""
    rank = lambda rows: rows.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))
    both = rank(semantic.orderBy(F.desc("score"), key).limit(k)).unionByName(rank(lexical.orderBy(F.desc("score"), key).limit(k)))
    return both.groupBy(key).agg(F.min("rank").alias("rank")).orderBy("rank", key).limit(k)


def first_of(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """One row for each key, the first by the order."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("row")).select(*keys, "row.*")


def images(rows: DataFrame, query: Sequence[str], size: int = 100, measure: str = "cosine", least: float = 0.1, every: bool = False, k: int = 10) -> DataFrame:
    """Keyword-vector search: any or all query words, similarity at least `least`. rows: name, keywords, ord."""
    q = list(dict.fromkeys(w.lower().strip() for w in query))
    own = F.array_distinct(F.transform("keywords", lambda w: F.lower(F.trim(w))))
    found = weights.set_similarities(own, q, size)
    kept = rows.select("name", "ord", found[measure].alias("score"), found["match_share"].alias("match_share"))
    if every:
        kept = kept.where(F.col("match_share") == 1)
    return kept.where((F.col("score") >= least) & (F.col("match_share") > 0)).orderBy(F.desc("score"), "ord").limit(k)
