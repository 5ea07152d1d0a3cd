"""Search queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicons, search
from .corpus import FEATURES, FLOWS, TERMS, TOPICS, counts, features, in_list, listed, sql_overlap, TOPIC_ROWS, topic_rows

QUERY = ["license", "token", "the", "public"]
CATEGORY = {"en": ["the", "license"], "fr": ["les"], "de": ["und"], "es": ["los"]}


def shown(rows, score=True):
    return rows.select("source_file", "chunk_id", *([F.round("score", 6).alias("score")] if score else []))


NEWEST, CORPUS = "order by score desc, source_file desc, doc_id desc", "order by score desc, doc_id"
def ranked(score, where="true", kept="true", order=NEWEST, k=10):
    """SQL of a search over the feature rows."""
    rows = f"x as (select *, {score} as score from f where {where})"
    return f"with {FEATURES}, {rows} select source_file, doc_id as chunk_id, round(cast(score as double), 6) as score from x where {kept} {order} limit {k}"


def category_words():
    out = F.array().cast("array<string>")
    for lang, words in CATEGORY.items():
        out = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(out)
    return out


SQL_CATEGORY = "case lang " + " ".join(f"when '{k}' then {listed(v)}" for k, v in CATEGORY.items()) + " else [] end"


def enhanced_search(spark, sf):
    return shown(search.enhanced(features(spark, sf), QUERY, category_words(), F.split("name", "_")))


ENHANCED = f"{sql_overlap(QUERY)} / {len(QUERY)} + 0.1 * len(list_intersect({SQL_CATEGORY}, {listed(QUERY)})) + 0.1 * len(list_intersect(list_distinct(string_split(name, '_')), {listed(QUERY)}))"


def search_reasons(spark, sf):
    """What the enhanced search found, with reasons."""
    found = search.enhanced(features(spark, sf), QUERY, category_words(), F.split("name", "_"), category=F.col("lang"))
    return found.select("chunk_id", F.array_join("keyword_matches", ",").alias("matches"), F.array_join("reasons", "; ").alias("reasons"))


REASONS = f"""with {FEATURES}, x as (select *, round({ENHANCED}, 6) as score from f where {sql_overlap(QUERY)} > 0 order by score desc, doc_id limit 15)
select doc_id as chunk_id, array_to_string(list_sort(list_intersect(words, {listed(QUERY)})), ',') as matches, 'Keyword overlap: ' || {sql_overlap(QUERY)} || ' terms' || case when len(list_intersect({SQL_CATEGORY}, {listed(QUERY)})) > 0 then coalesce('; Semantic category: ' || lang, '') else '' end
|| case when len(list_intersect(list_distinct(string_split(name, '_')), {listed(QUERY)})) > 0 then '; Procedure: ' || name else '' end as reasons from x"""


def ticket_search(spark, sf):
    return shown(search.ticket(features(spark, sf), "License token", "the public terms", "with general license", ["the"], category_words(), F.split("name", "_")))


TICKET = ["license", "token", "public", "terms", "with", "general"]
TICKET_SCORE = f"{sql_overlap(TICKET)} / {len(TICKET)} + 0.1 * len(list_intersect({SQL_CATEGORY}, {listed(TICKET)})) + 0.1 * len(list_intersect(list_distinct(string_split(name, '_')), {listed(TICKET)}))"


def category_search(spark, sf):
    share = F.round(F.get(F.filter("shares", lambda x: x["topic"] == "linking"), F.lit(0))["share"], 6)
    rows = topic_rows(spark, sf).withColumns({"source_file": F.lit("documents"), "ord": F.col("chunk_id")})
    return search.by_topic(rows, share, 0.2).select("chunk_id", "score")


def keyword_search(spark, sf):
    return shown(search.by_keywords(features(spark, sf), ["license", "token", "that"]))


def sql_count(word):
    return f"((length(low) - length(replace(low, '{word}', ''))) // {len(word)})"


def sql_keyword(word):
    return f"0.5 * {sql_count(word)} + (case when len(list_filter(calls, lambda c: contains(lower(c), '{word}'))) > 0 then 1 else 0 end) + (case when contains(name, '{word}') then 2 else 0 end)"


def by_flow_search(spark, sf):
    return shown(search.by_flow(features(spark, sf), "validation", "fedwire", 0.5))


def network_search(spark, sf):
    return shown(search.by_network(features(spark, sf), "fedwire", "validation"), score=False)


def message_search(spark, sf):
    return shown(search.by_message(features(spark, sf), "license"))


def sql_message(m):
    return f"(case when contains(low, '{m}') then 2 else 0 end) + 3 * len(list_filter(tags, lambda t: contains(lower(t), '{m}'))) + 2.5 * len(list_filter(calls, lambda c: contains(lower(c), '{m}'))) + (case when contains(name, '{m}') then 4 else 0 end)"


def procedure_search(spark, sf):
    return shown(search.by_procedure(features(spark, sf), "the_and"))


SQL_NAME = """case when {n} = '{w}' then 10 when contains({n}, '{w}') then 8 when {n} <> '' and contains('{w}', {n}) then 6
 else 5 * (len(list_intersect({p}, {q})) / len(list_distinct(list_concat({p}, {q})))) end"""


def sql_name(name, wanted):
    parts = f"list_distinct(list_filter(regexp_split_to_array({name}, '[_ ]'), lambda y: y <> ''))"
    return SQL_NAME.format(n=name, w=wanted, p=parts, q=listed(list(dict.fromkeys(wanted.replace("_", " ").split()))))


def name_similarity_search(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("part").alias("source_file"), F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("name"))
    return search.by_procedure(part, "small blue ring", 20).select("chunk_id", F.round("score", 6).alias("score"))


def function_search(spark, sf):
    from ..functions import text as fx

    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("pages").alias("source_file"), F.col("page_id").alias("chunk_id"), fx.called_functions(F.col("html")).alias("function_calls"))
    return search.by_function(pages, "track", 20).select("chunk_id", "score")


FUNCTION = r"""with p as (select page_id, list_distinct(regexp_extract_all(html, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1)) as calls from pages),
s as (select page_id as chunk_id, cast(list_sum(list_transform(calls, lambda c: case when lower(c) = 'track' then 5 when contains(lower(c), 'track') then 3 when contains('track', lower(c)) then 2 else 0 end)) as double) as score from p)
select * from s where score > 0 order by score desc, chunk_id desc limit 20"""


def validation_patterns(spark, sf):
    return shown(search.patterns(features(spark, sf), "validation", ["license", "public", "general", "terms", "token"], ["the"]))


def error_patterns(spark, sf):
    return shown(search.patterns(features(spark, sf), "exception_handling", ["que", "les", "los"], network="swift"))


def sql_patterns(flow, words, filters=(), network=None):
    hits = [f"contains(low, '{w}')" for w in words]
    member = f"(coalesce(primary_flow = '{flow}', false) or list_contains(secondary, '{flow}'))"
    score = " + ".join(f"(case when {h} then 1 else 0 end)" for h in hits[:5]) + f" + (case when primary_flow = '{flow}' then 3 when list_contains(secondary, '{flow}') then 1.5 else 0 end) + {2 * len(filters)}"
    where = [f"({member} or {' or '.join(hits)})", *(f"contains(low, '{x}')" for x in filters)] + ([f"list_contains(networks, '{network}')"] if network else [])
    return ranked(score, " and ".join(where))


def iso_search(spark, sf):
    return shown(search.iso_processing(features(spark, sf), "lic.ense.001", "public", 5))


ISO = f"""with {FEATURES}, x as (select *, {sql_message('license')} as score from f where len(list_filter(tags, lambda t: contains(lower(t), 'license'))) > 0 or contains(low, 'license')),
y as (select * from x {NEWEST} limit 10),
z as (select *, score + (case when len(list_filter(calls, lambda c: contains(lower(c), 'license'))) > 0 then 2 else 0 end) + (case when contains(name, 'license') then 3 else 0 end) + 1 as total from y where contains(low, 'public'))
select source_file, doc_id as chunk_id, round(cast(total as double), 6) as score from z order by total desc, source_file desc, doc_id desc limit 5"""


def similar_by_flow_vector(spark, sf):
    rows = features(spark, sf, ("function_calls", "detected_networks"))
    rows = rows.select("source_file", "chunk_id", "ord", "name", F.transform("flows", lambda x: x["score"]).alias("vector"))
    return search.similar_procedures(rows, "the_and", "vector", 0.1, 10).select("chunk_id", "score")


SIMILAR = f"""with {FEATURES}, v as (select doc_id, source_file, name, [{', '.join(f'cast(flow_{n} as double)' for n in FLOWS)}] as v from f),
r as (select * from v where contains(name, 'the_and') order by doc_id limit 1),
s as (select v.doc_id, v.source_file, round(coalesce(case when list_sum(list_transform(v.v, lambda a: a * a)) > 0 and list_sum(list_transform(r.v, lambda a: a * a)) > 0 then list_cosine_similarity(v.v, r.v) end, 0), 6) as score from v, r where v.doc_id <> r.doc_id and v.name <> '')
select doc_id as chunk_id, score from s where score > 0.1 order by score desc, source_file desc, doc_id desc limit 10"""


IMAGE_QUERY = ["license", "the", "token"]


def binary_search(measure, least, every=False, query=IMAGE_QUERY):
    def run(spark, sf):
        vocab = sorted({w for ws in TOPICS.values() for w in ws})
        rows = features(spark, sf).select(F.col("chunk_id").alias("name"), "ord", F.array_intersect("words", F.array(*map(F.lit, vocab))).alias("keywords"))
        return search.images(rows, query, 100, measure, least, every, 20).select(F.col("name").alias("chunk_id"), "score", "match_share")

    vocab = listed(sorted({w for ws in TOPICS.values() for w in ws}))
    formula = {
        "cosine": "case when n > 0 then met / sqrt(n * {q}.0) else 0 end",
        "jaccard": "case when n + {q} - met > 0 then met / (n + {q} - met) else 0 end",
        "hamming": "(100 - (n + {q} - 2 * met)) / 100.0",
    }[measure].format(q=len(query))
    sql = f"""with {FEATURES}, k as (select doc_id, list_intersect(words, {vocab}) as own from f), m as (select doc_id, len(own) as n, len(list_intersect(own, {listed(query)})) as met from k),
    s as (select doc_id as chunk_id, round(cast({formula} as double), 4) as score, round(met / {len(query)}.0, 4) as match_share from m)
    select * from s where score >= {least} and match_share > 0 {'and match_share = 1' if every else ''} order by score desc, chunk_id limit 20"""
    return run, sql


def embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def query_vector(spark, sf):
    return embeddings(spark, sf).where("vec_id = 0").first()["embedding"]


def embedding_topk(spark, sf):
    return search.embedding_top(embeddings(spark, sf), query_vector(spark, sf), 10)


COSINE = "round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6)"
EMBEDDING = f"select e.vec_id, {COSINE} as score from embeddings e, embeddings q where q.vec_id = 0 order by score desc, e.vec_id limit 10"


def bm25_topk(spark, sf):
    return search.bm25(counts(spark, sf), QUERY).orderBy(F.desc("score"), "doc_id").limit(20)


BM25 = f"""{TERMS}, len as (select doc_id, sum(n) as len from n group by doc_id), st as (select count(*) as nn, avg(len) as mean from len),
bm as (select n.doc_id, round(sum(ln(1 + (st.nn - d.df + 0.5) / (d.df + 0.5)) * n.n * 2.2 / (n.n + 1.2 * (0.25 + 0.75 * len.len / st.mean))), 6) as score
from n join len on len.doc_id = n.doc_id join d on d.term = n.term cross join st where n.term in ({in_list(QUERY)}) group by n.doc_id)"""


def hybrid_topk(spark, sf):
    semantic = search.embedding_top(embeddings(spark, sf), query_vector(spark, sf), 10).withColumnRenamed("vec_id", "doc_id")
    return search.hybrid(semantic, search.bm25(counts(spark, sf), QUERY), 10)


HYBRID = f"""with {BM25}, a as (select doc_id, row_number() over (order by score desc, doc_id) as rank from (select e.vec_id as doc_id, {COSINE} as score from embeddings e, embeddings q where q.vec_id = 0)),
b as (select doc_id, row_number() over (order by score desc, doc_id) as rank from bm)
select doc_id, min(rank) as rank from (select * from a where rank <= 10 union all select * from b where rank <= 10) group by doc_id order by 2, 1 limit 10"""


def first_match_dedupe(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    return search.first_of(rows, ["text"], "doc_id").select(F.col("doc_id"), "source")


def last_name_wins(spark, sf):
    rows = features(spark, sf).where("name <> ''")
    return rows.groupBy("name").agg(F.max_by(F.struct(F.size("function_calls").alias("calls"), F.array_join("detected_networks", ",").alias("networks")), "chunk_id").alias("x"), F.max("chunk_id").alias("last")).select("name", "last", "x.networks")


def question_intent(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    words = {"asking": ["que", "the that", "what"], "linking": ["und", "with", "and"], "naming": ["la", "der", "the"]}
    found = lexicons.intent(F.col("text"), words)
    return turns.select("conv_id", "turn", found["category"].alias("category"), F.round(found["confidence"], 6).alias("confidence"), lexicons.action(F.col("text")).alias("action"))


INTENT = """with h as (select conv_id, turn, lower(text) as t from conversations where role = 'user'),
s as (select *, cast(contains(t, 'que') as int) + cast(contains(t, 'the that') as int) + cast(contains(t, 'what') as int) as a, cast(contains(t, 'und') as int) + cast(contains(t, 'with') as int) + cast(contains(t, 'and') as int) as b,
cast(contains(t, 'la') as int) + cast(contains(t, 'der') as int) + cast(contains(t, 'the') as int) as c from h)
select conv_id, turn, case when greatest(a, b, c) = 0 then 'general' when a >= b and a >= c then 'asking' when b >= c then 'linking' else 'naming' end as category,
round(case when greatest(a, b, c) = 0 then 0.5 else greatest(a, b, c) / 3 end, 6) as confidence,
case when regexp_matches(t, 'create|generate|build|make') then 'create' when regexp_matches(t, 'validate|check|verify') then 'validate' when regexp_matches(t, 'process|handle|execute') then 'process' when regexp_matches(t, 'screen|filter') then 'screen' else 'general' end as action from s"""

QUERIES = {
    "search_reasons": (search_reasons, REASONS),
    "enhanced_search": (enhanced_search, ranked(f"round({ENHANCED}, 6)", f"{sql_overlap(QUERY)} > 0", order=CORPUS, k=15)),
    "ticket_search": (ticket_search, ranked(f"round({TICKET_SCORE}, 6)", f"{sql_overlap(TICKET)} > 0", order=CORPUS, k=20)),
    "category_search": (category_search, f"with {TOPIC_ROWS} select doc_id as chunk_id, round(share, 6) as score from th where topic = 'linking' and round(share, 6) > 0.2 order by 2 desc, 1 limit 15"),
    "keyword_search": (keyword_search, ranked(" + ".join(sql_keyword(w) for w in ["license", "token", "that"]), kept="score > 0", k=15)),
    "by_flow_search": (by_flow_search, ranked("flow_validation", "(coalesce(primary_flow = 'validation', false) or list_contains(secondary, 'validation')) and list_contains(networks, 'fedwire')", "score >= 0.5")),
    "network_search": (network_search, f"with {FEATURES} select source_file, doc_id as chunk_id from f where list_contains(networks, 'fedwire') and primary_flow = 'validation' order by doc_id limit 15"),
    "message_search": (message_search, ranked(sql_message("license"), "len(list_filter(tags, lambda t: contains(lower(t), 'license'))) > 0 or contains(low, 'license')")),
    "procedure_search": (procedure_search, ranked(f"round({sql_name('name', 'the_and')}, 6)", kept="score > 0")),
    "name_similarity_search": (name_similarity_search, f"select p_partkey as chunk_id, score from (select p_partkey, round(cast({sql_name('lower(p_name)', 'small blue ring')} as double), 6) as score from part) where score > 0 order by score desc, p_partkey desc limit 20"),
    "function_search": (function_search, FUNCTION),
    "validation_patterns": (validation_patterns, sql_patterns("validation", ["license", "public", "general", "terms", "token"], ["the"])),
    "error_patterns": (error_patterns, sql_patterns("exception_handling", ["que", "les", "los"], network="swift")),
    "iso_search": (iso_search, ISO),
    "similar_by_flow_vector": (similar_by_flow_vector, SIMILAR),
    "binary_vector_search_cosine": binary_search("cosine", 0.1),
    "binary_vector_search_jaccard": binary_search("jaccard", 0.1),
    "binary_vector_search_hamming": binary_search("hamming", 0.5),
    "binary_vector_search_all": binary_search("cosine", 0.1, True, ["the", "with"]),
    "embedding_topk": (embedding_topk, EMBEDDING),
    "bm25_topk": (bm25_topk, f"with {BM25} select doc_id, score from bm order by score desc, doc_id limit 20"),
    "hybrid_topk": (hybrid_topk, HYBRID),
    "first_match_dedupe": (first_match_dedupe, "select doc_id, source from documents qualify row_number() over (partition by text order by doc_id) = 1"),
    "last_name_wins": (last_name_wins, f"with {FEATURES} select name, doc_id as last, array_to_string(networks, ',') as networks from f where name <> '' qualify row_number() over (partition by name order by doc_id desc) = 1"),
    "question_intent": (question_intent, INTENT),
}
