"""Corpus queries: chunks, term statistics, topics, networks and flows over the driver's tables.

Lexicons bind terms that occur in the tables; each SQL text is written out from the same lexicon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import chunking, lexicons, weights
from ..sources import tables

#: Stand-in lexicons.
TOPICS = {
    "legal": ["license", "public", "general", "terms", "warranty"],
    "access": ["token", "key", "password", "mail"],
    "linking": ["the", "that", "with", "for", "from"],
    "romance": ["que", "les", "los", "des", "del"],
    "german": ["der", "die", "und", "mit", "von"],
}
HIGH_VALUE = ["license", "token", "with", "que", "und"]
NETWORKS = {
    "fedwire": {"words": ["license", "public", "that"], "patterns": [r"gnu.*license", r"under.*terms"]},
    "swift": {"words": ["token", "with", "que"], "patterns": [r"token\s*=", r"from.*with"]},
    "chips": {"words": ["from", "and", "der"], "patterns": [r"the.*that.*for"]},
}
FLOWS = {
    "customer_transfer": {"words": ["that", "with", "from"], "patterns": [r"the.*with"], "tag": "mail"},
    "validation": {"words": ["license", "public"], "patterns": [r"gnu.*public"], "tag": "license"},
    "exception_handling": {"words": ["que", "les", "los"], "patterns": [r"que.*les"], "tag": "phone"},
    "screening": {"words": ["und", "mit"], "patterns": [r"der.*und"], "tag": None},
    "settlement": {"words": ["settlement"], "patterns": [r"clearing.*house"], "tag": None},
}
TAGS = {"license": r"public license", "mail": r"[a-z0-9.]+@[a-z0-9.]+\.example\.com", "phone": r"\+[0-9]+ \([0-9]{3}\)", "fedwire_token": r"token = "}
NETWORK_NAMES, FLOW_NAMES = [*NETWORKS, "general"], list(FLOWS)
MOST_LINES = 21


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "documents")


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunks(docs(spark, sf), F.col("line").startswith("The "), MOST_LINES, name=F.regexp_extract("line", r"^(\S+ \S+)", 1))


CHUNKS = rf"""
l as (select doc_id, generate_subscripts(p, 1) - 1 as line_no, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)),
b as (select *, trim(replace(replace(line, chr(9), ''), chr(13), '')) = '' as blank, starts_with(line, 'The ') as starts from l),
o as (select *, blank and coalesce(first_value(case when not blank then starts end ignore nulls) over (partition by doc_id order by line_no rows between current row and unbounded following), false) as opens,
      lag(blank, 1, false) over (partition by doc_id order by line_no) as after_blank from b),
s as (select *, sum(case when (opens or starts) and not after_blank then 1 else 0 end) over (partition by doc_id order by line_no) as seg from o),
q as (select *, cast(floor((line_no - min(line_no) over (partition by doc_id, seg)) / {MOST_LINES}) as int) as part from s),
g as (select doc_id, seg, part, min(line_no) as start_line, max(line_no) as end_line, string_agg(line, chr(10) order by line_no) as content,
      max(case when starts and part = 0 then regexp_extract(line, '^(\S+ \S+)', 1) end) as name from q group by all),
c as (select doc_id, cast(row_number() over (partition by doc_id order by start_line) - 1 as int) as chunk_id, cast(start_line as int) as start_line, cast(end_line as int) as end_line, name, content
      from g where regexp_replace(content, '\s', '', 'g') <> '')
"""


def chunk_documents(spark, sf):
    return chunked(spark, sf).select("doc_id", "chunk_id", "start_line", "end_line", "name", F.md5("content").alias("digest"))


def chunk_stats(spark, sf):
    n = F.length("content")
    return chunked(spark, sf).agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum(n).alias("chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.count("name").alias("named")
    )


CHUNK_STATS = f"with {CHUNKS} select count(*) as chunks, count(distinct doc_id) as documents, cast(sum(length(content)) as bigint) as chars, min(length(content)) as shortest, max(length(content)) as longest, round(avg(length(content)), 6) as mean, count(name) as named from c"

WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0), lambda w: length(w) >= 3 and regexp_full_match(w, '[a-z_][a-z0-9_]*'))"
TERMS = f"t as (select doc_id, unnest({WORDS}) as term from documents), n as (select doc_id, term, count(*) as n from t group by all), d as (select term, count(*) as df from n group by term)"
SIZE = "(select count(*) from documents)"
VOCAB = f"v as (select *, cast(row_number() over (order by df desc, term) - 1 as int) as idx from d where df >= 2 and df <= floor({SIZE} * 0.8) qualify row_number() over (order by df desc, term) <= 3000)"


def counts(spark, sf):
    return weights.terms(docs(spark, sf))


def term_doc_freq(spark, sf):
    return weights.document_frequency(counts(spark, sf)).where("df >= 2")


def vocab_topk(spark, sf):
    n = docs(spark, sf).count()
    return weights.vocabulary(weights.document_frequency(counts(spark, sf)), n).select("term", "df", "idx")


def flow_vocab(spark, sf):
    n = docs(spark, sf).count()
    return weights.vocabulary(weights.document_frequency(counts(spark, sf)), n, max(2, n // 100), 0.5, 2000).select("term", "df", "idx")


def idf(spark, sf):
    n = docs(spark, sf).count()
    return weights.inverse_frequency(weights.vocabulary(weights.document_frequency(counts(spark, sf)), n), n).select("term", F.round("idf", 6).alias("idf"))


def tfidf_top_terms(spark, sf):
    n, all_counts = docs(spark, sf).count(), counts(spark, sf)
    vocab = weights.inverse_frequency(weights.vocabulary(weights.document_frequency(all_counts), n), n)
    w = weights.tfidf(all_counts, vocab, high_value=tuple(HIGH_VALUE)).withColumn("w", F.round("w", 6))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("k"), "term"))), 1, 8)
    return w.groupBy("doc_id").agg(F.array_join(F.transform(best, lambda x: x["term"]), ",").alias("terms"), F.sum(F.col("w").cast("decimal(18,6)")).cast("double").alias("total"))


def in_list(words):
    return ", ".join(f"'{w}'" for w in words)


TFIDF = f"""with {TERMS}, {VOCAB},
x as (select n.doc_id, n.term, round(n.n / sum(n.n) over (partition by n.doc_id) * coalesce(ln({SIZE} / v.df), 0) * (case when n.term in ({in_list(HIGH_VALUE)}) then 1.5 else 1 end), 6) as w, v.term is not null as listed
      from n left join v on v.term = n.term),
r as (select *, row_number() over (partition by doc_id order by w desc, term) as k from x where listed)
select doc_id, string_agg(term, ',' order by k) filter (k <= 8) as terms, cast(sum(cast(w as decimal(18,6))) as double) as total from r group by doc_id"""


def term_share(spark, sf):
    n, all_counts = docs(spark, sf).count(), counts(spark, sf)
    vocab = weights.vocabulary(weights.document_frequency(all_counts), n, max(2, n // 100), 0.5, 2000)
    w = weights.term_share(all_counts, vocab)
    return w.groupBy("term").agg(F.count("*").alias("documents"), F.round(F.sum("w"), 4).alias("total"))


TERM_SHARE = f"""with {TERMS}, v as (select term from d where df >= greatest(2, {SIZE} // 100) and df <= floor({SIZE} * 0.5) qualify row_number() over (order by df desc, term) <= 2000),
x as (select term, n / sum(n) over (partition by doc_id) as w from n)
select term, count(*) as documents, round(sum(w), 4) as total from x where term in (select term from v) group by term"""


def tfidf_fixed_vocab_l2(spark, sf):
    n, all_counts = docs(spark, sf).count(), counts(spark, sf)
    vocab = all_counts.where(F.col("term").isin(*VOCABULARY)).groupBy("term").agg(F.count("*").alias("df"))
    return weights.smooth_l2(all_counts, F.broadcast(vocab), n)


VOCABULARY = sorted({w for ws in TOPICS.values() for w in ws})
FIXED = f"""with {TERMS}, f as (select * from d where term in ({in_list(VOCABULARY)})),
x as (select n.doc_id, n.term, n.n * (ln((1 + {SIZE}) / (1 + f.df)) + 1) as raw from n join f on f.term = n.term)
select doc_id, term, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 4) as w from x"""


def features(spark, sf, without: tuple[str, ...] = ()) -> DataFrame:
    """Documents as chunks: words, tags, scores and what follows from them; the name is the first line's first two words.

    without: columns that the caller has no use for (function_calls, detected_networks); pinned rows would have them computed all the same."""
    low = F.lower("text")
    rows = docs(spark, sf).select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"), "lang",
        F.replace(F.regexp_extract(low, r"^([a-z]+ [a-z]+)", 1), F.lit(" "), F.lit("_")).alias("name"),
        F.array_distinct(fx.kept_words(fx.words_of(F.col("text")))).alias("words"), fx.tags(F.col("text"), TAGS).alias("message_patterns"), fx.called_functions(F.col("text")).alias("function_calls"),
    )
    rows, low = chunking.pinned(rows.drop(*without)), F.lower("content")
    if "detected_networks" not in without:
        rows = rows.withColumn("network_scores", lexicons.network_scores(low, F.col("words"), F.col("message_patterns"), NETWORKS))
        rows = rows.withColumn("detected_networks", lexicons.detected(F.col("network_scores")))
    rows = rows.withColumn("flows", lexicons.flow_scores(low, F.col("words"), F.col("name"), F.col("message_patterns"), FLOWS))
    rows = chunking.pinned(rows)
    return rows.withColumn("primary_flow", lexicons.primary_flow(F.col("flows"))).withColumn("secondary_flows", lexicons.secondary_flows(F.col("flows")))


def listed(words):
    return f"[{in_list(words)}]"


def sql_overlap(words):
    return f"len(list_intersect(words, {listed(words)}))"


def sql_flow(name):
    f = FLOWS[name]
    parts = [f"5 * {sql_overlap(f['words'])}"]
    parts += [f"(case when regexp_matches(low, '{p}') then 10 else 0 end)" for p in f["patterns"]]
    parts += [f"(case when contains(name, '{w}') then 8 else 0 end)" for w in f["words"]]
    parts += [f"(case when list_contains(tags, '{f['tag']}') then 6 else 0 end)"] if f["tag"] else []
    return f"({' + '.join(parts)}) / 10"


def sql_network(name):
    parts = [f"2 * {sql_overlap(NETWORKS[name]['words'])}"]
    parts += [f"(case when regexp_matches(low, '{p}') then 3 else 0 end)" for p in NETWORKS[name]["patterns"]]
    part = {"swift": "mt", "fedwire": "fedwire"}.get(name)
    parts += [f"(case when len(list_filter(tags, lambda t: contains(t, '{part}'))) > 0 then 2 else 0 end)"] if part else []
    return " + ".join(parts)


FEATURES = rf"""
f0 as (select source as source_file, doc_id, lang, text as content, lower(text) as low, replace(regexp_extract(lower(text), '^([a-z]+ [a-z]+)', 1), ' ', '_') as name, list_distinct({WORDS}) as words,
       list_filter([{', '.join(f"case when regexp_matches(lower(text), '{p}') then '{n}' end" for n, p in TAGS.items())}], lambda x: x is not null) as tags,
       list_sort(list_distinct(regexp_extract_all(text, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1))) as calls from documents),
f1 as (select *, {', '.join(f'{sql_network(n)} as net_{n}' for n in NETWORKS)}, {', '.join(f'{sql_flow(n)} as flow_{n}' for n in FLOWS)} from f0),
f2 as (select *, list_filter([{', '.join(f"case when net_{n} > 2 then '{n}' end" for n in NETWORKS)}], lambda x: x is not null) as networks from f1),
fs as (select doc_id, u.name as flow, u.score as score, u.ord as ord from (select doc_id, unnest([{', '.join(f"struct_pack(name := '{n}', score := flow_{n}, ord := {i})" for i, n in enumerate(FLOWS))}]) as u from f2)),
fr as (select *, row_number() over (partition by doc_id order by score desc, ord) as k, max(score) over (partition by doc_id) as best from fs),
fp as (select doc_id, max(case when k = 1 and score > 0.5 then flow end) as primary_flow from fr group by doc_id),
f3 as (select fr.doc_id, fr.flow, row_number() over (partition by fr.doc_id order by fr.k) as j from fr join fp on fp.doc_id = fr.doc_id and fp.primary_flow is not null where fr.k > 1 and fr.score > 0.3 and fr.score >= 0.6 * fr.best),
f4 as (select doc_id, list(flow order by j) as secondary from f3 where j <= 2 group by doc_id),
f as (select f2.*, fp.primary_flow, coalesce(f4.secondary, []) as secondary from f2 join fp on fp.doc_id = f2.doc_id left join f4 on f4.doc_id = f2.doc_id)
"""


def topic_rows(spark, sf):
    rows = features(spark, sf).select("chunk_id", "words", "name")
    scores = lexicons.topic_scores(F.col("words"), TOPICS, F.split("name", "_"), HIGH_VALUE)
    rows = chunking.pinned(rows.withColumn("scores", scores))
    return chunking.pinned(rows.withColumn("shares", lexicons.distribution(F.col("scores"))))


def lexicon_topic_scores(spark, sf):
    rows = topic_rows(spark, sf).select("chunk_id", F.explode("scores").alias("s"))
    return rows.select(F.col("chunk_id").alias("doc_id"), F.col("s.topic").alias("topic"), F.round("s.score", 6).alias("score"))


def sql_topic(i, name):
    own = f"({sql_overlap(TOPICS[name])} + 0.4 * len(list_intersect(list_distinct(string_split(name, '_')), {listed(TOPICS[name])})))"
    return f"struct_pack(ord := {i}, topic := '{name}', score := case when {own} > 0 then {own} + 0.2 * {sql_overlap(HIGH_VALUE)} else 0 end)"


TOPIC_ROWS = f"""{FEATURES}, ts as (select doc_id, u.topic as topic, u.ord as ord, cast(u.score as double) as score from (select doc_id, unnest([{', '.join(sql_topic(i, n) for i, n in enumerate(TOPICS))}]) as u from f)),
tt as (select *, sum(score) over (partition by doc_id) as total from ts), th as (select *, case when total > 0 then score / total else 0 end as share from tt),
td as (select *, row_number() over (partition by doc_id order by round(share, 9) desc, ord) as k, count(*) filter (share > 0.15) over (partition by doc_id) as many from th)"""


def dominant_topic(spark, sf):
    rows = topic_rows(spark, sf)
    rows = rows.withColumn("shares", F.transform("shares", lambda x: F.struct(x["topic"].alias("topic"), F.round(x["share"], 9).alias("share"))))
    top = lexicons.dominant(F.col("shares"))
    return rows.select(F.col("chunk_id").alias("doc_id"), top["topic"].alias("topic"), F.round(top["share"], 6).alias("share"), lexicons.category(F.col("shares")).alias("category"))


DOMINANT = f"with {TOPIC_ROWS} select doc_id, topic, round(share, 6) as share, case when share > 0.25 then topic when many >= 2 then 'mixed' else 'general' end as category from td where k = 1"


def semantic_category_counts(spark, sf):
    return dominant_topic(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


def tag_patterns(spark, sf):
    return features(spark, sf).select(F.col("chunk_id").alias("doc_id"), F.array_join("message_patterns", ",").alias("tags")).where("tags <> ''")


def network_flow_detect(spark, sf):
    score = lambda c, n: F.get(F.filter(c, lambda x: x["name"] == n), F.lit(0))["score"]
    return features(spark, sf).select(
        F.col("chunk_id").alias("doc_id"), *[score("network_scores", n).cast("long").alias(f"net_{n}") for n in NETWORKS], *[F.round(score("flows", n), 6).alias(f"flow_{n}") for n in FLOWS], F.array_join("detected_networks", ",").alias("networks")
    )


def primary_flow(spark, sf):
    return features(spark, sf).select(F.col("chunk_id").alias("doc_id"), "primary_flow", F.array_join("secondary_flows", ",").alias("secondary"), lexicons.flow_summary(F.col("primary_flow"), F.col("secondary_flows"), F.col("detected_networks"), F.col("message_patterns")).alias("summary"))


def sql_title(x):
    return f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


PRIMARY = f"""with {FEATURES} select doc_id, primary_flow, array_to_string(secondary, ',') as secondary,
concat_ws(' | ', coalesce('Primary: ' || {sql_title('primary_flow')}, 'General processing'), case when len(secondary) > 0 then 'Also: ' || {sql_title("array_to_string(secondary, ', ')")} end,
case when len(networks) > 0 then 'Networks: ' || upper(array_to_string(networks, ', ')) end, case when len(tags) > 0 then 'Messages: ' || array_to_string(tags, ', ') end) as summary from f"""


def flow_network_matrix(spark, sf):
    return lexicons.matrix(features(spark, sf).select("primary_flow", F.col("detected_networks").alias("network")).where("primary_flow is not null"), "primary_flow", "network", FLOW_NAMES, NETWORK_NAMES)


MATRIX = f"""with {FEATURES}, a as (select unnest({listed(FLOW_NAMES)}) as primary_flow), b as (select unnest({listed(NETWORK_NAMES)}) as network),
n as (select primary_flow, unnest(networks) as network from f) select a.primary_flow, b.network, count(n.network) as n from a cross join b left join n on n.primary_flow = a.primary_flow and n.network = b.network group by all"""


def coverage_gaps(spark, sf):
    names = spark.createDataFrame([(x,) for x in FLOW_NAMES], "flow string")
    return names.join(features(spark, sf).select(F.col("primary_flow").alias("flow")), "flow", "left_anti")


def corpus_statistics(spark, sf):
    rows = features(spark, sf).select("flows", F.array_compact(F.array_append("secondary_flows", F.col("primary_flow"))).alias("own"))
    own = rows.select(F.explode(F.filter("flows", lambda x: F.array_contains("own", x["name"]))).alias("x"))
    return own.groupBy(F.col("x.name").alias("flow")).agg(F.count("*").alias("n"), F.round(F.avg("x.score"), 6).alias("mean"))


STATISTICS = f"with {FEATURES} select fs.flow, count(*) as n, round(avg(fs.score), 6) as mean from fs join f on f.doc_id = fs.doc_id and (f.primary_flow = fs.flow or list_contains(f.secondary, fs.flow)) group by fs.flow"


def top_procedures(spark, sf):
    """The 10 names with most flows above 0.3; of a name's documents the last counts; ties by name."""
    rows = features(spark, sf).where("name <> ''").groupBy("name").agg(F.max_by(F.size(F.filter("flows", lambda x: x["score"] > 0.3)), "ord").cast("long").alias("n"))
    return rows.orderBy(F.desc("n"), "name").limit(10)


TOP_PROCEDURES = f"with {FEATURES}, p as (select name, arg_max({' + '.join(f'cast(flow_{n} > 0.3 as bigint)' for n in FLOWS)}, doc_id) as n from f where name <> '' group by name) select name, n from p order by n desc, name limit 10"


def top_functions(spark, sf):
    """The 15 functions that most pages call; ties by name."""
    calls = tables.read(spark, sf, "pages").select(F.explode(fx.called_functions(F.col("html"))).alias("call"))
    return calls.groupBy("call").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "call").limit(15)


TOP_FUNCTIONS = r"select call, count(*) as n from (select unnest(list_distinct(regexp_extract_all(html, '(?:^|[^A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1))) as call from pages) group by call order by n desc, call limit 15"


def category_groups(spark, sf):
    """Members of each category, as a digest."""
    members = F.md5(F.array_join(F.array_sort(F.collect_set("doc_id")), ",")).alias("members")
    return dominant_topic(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), members)


def call_groups(spark, sf):
    """Members of each called function."""
    calls = tables.read(spark, sf, "pages").select("page_id", F.explode(fx.called_functions(F.col("html"))).alias("call"))
    return calls.groupBy("call").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))


CALL_GROUPS = r"select call, count(*) as n, min(page_id) as first, max(page_id) as last from (select page_id, unnest(list_distinct(regexp_extract_all(html, '(?:^|[^A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1))) as call from pages) group by call"


def flow_distribution(spark, sf):
    rows = features(spark, sf, ("function_calls",))
    part = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    parts = [part("flow", F.array(F.coalesce("primary_flow", F.lit("none")))), part("network", F.col("detected_networks")), part("message", F.col("message_patterns"))]
    both = rows.select(F.inline(F.concat(*[F.coalesce(p, F.array().cast("array<struct<kind:string,value:string>>")) for p in parts])))
    return both.groupBy("kind", "value").agg(F.count("*").alias("n"))


DISTRIBUTION = f"""with {FEATURES} select kind, value, count(*) as n from (select 'flow' as kind, coalesce(primary_flow, 'none') as value from f union all select 'network', unnest(networks) from f union all select 'message', unnest(tags) from f) group by all"""


def functionality_groups(spark, sf):
    rows = features(spark, sf).where("name <> ''")
    return rows.groupBy(F.get(F.split("name", "_"), F.lit(0)).alias("prefix")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.md5(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",")).alias("members"))


GROUPS = f"with {FEATURES} select string_split(name, '_')[1] as prefix, count(*) as n, min(doc_id) as first, md5(string_agg(cast(doc_id as varchar), ',' order by doc_id)) as members from f where name <> '' group by 1"


def call_targets(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select(F.explode(fx.called_functions(F.col("html"))).alias("call")).groupBy("call").agg(F.count("*").alias("pages")).where("pages > 1")


def control_flags(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(fx.control_structures(F.col("text")), ",").alias("controls")).where("controls <> ''")


CONTROL = rf"""select doc_id, array_to_string(list_filter([{', '.join(f"case when regexp_matches(lower(text), '(^|[^{{c}}]){k}($|[^{{c}}])') then '{k}' end" for k in fx.CONTROL_KEYWORDS)}], lambda x: x is not null), ',') as controls
from documents where controls <> ''""".replace("{c}", r"\p{L}\p{N}\p{M}_")


def budget_truncation(spark, sf):
    cut = fx.truncated(F.col("text"), 100, ["the", "que", "und"])
    return docs(spark, sf).select("doc_id", F.length(cut).alias("n"), F.md5(cut).alias("digest"), fx.token_estimate(F.col("text")).alias("tokens"))


TRUNCATION = r"""
with l as (select doc_id, text, generate_subscripts(p, 1) as i, unnest(p) as line from (select doc_id, text, string_split(text, chr(10)) as p from documents)),
k as (select *, contains(lower(line), 'the') or contains(lower(line), 'que') or contains(lower(line), 'und') as wanted from l),
r as (select *, sum(length(line) + 1) over (partition by doc_id, wanted order by i) as used from k),
a as (select doc_id, coalesce(max(used) filter (wanted and used <= 400), 0) as first_used from r group by doc_id),
s as (select r.*, case when wanted then used else used + first_used end as total from r join a on a.doc_id = r.doc_id),
j as (select doc_id, any_value(text) as text, coalesce(string_agg(line, chr(10) order by wanted desc, i) filter (total <= 400), '') as cut from s group by doc_id),
o as (select doc_id, text, case when length(text) + 1 <= 400 then text when length(cut) < length(text) then cut || chr(10) || '... (truncated)' else cut end as cut from j)
select doc_id, cast(length(cut) as int) as n, md5(cut) as digest, length(text) // 4 as tokens from o"""

QUERIES = {
    "chunk_documents": (chunk_documents, f"with {CHUNKS} select doc_id, chunk_id, start_line, end_line, name, md5(content) as digest from c"),
    "chunk_stats": (chunk_stats, CHUNK_STATS),
    "term_doc_freq": (term_doc_freq, f"with {TERMS} select term, df from d where df >= 2"),
    "vocab_topk": (vocab_topk, f"with {TERMS}, {VOCAB} select term, df, idx from v"),
    "flow_vocab": (flow_vocab, f"with {TERMS} select term, df, cast(row_number() over (order by df desc, term) - 1 as int) as idx from d where df >= greatest(2, {SIZE} // 100) and df <= floor({SIZE} * 0.5) qualify row_number() over (order by df desc, term) <= 2000"),
    "idf": (idf, f"with {TERMS}, {VOCAB} select term, round(ln({SIZE} / df), 6) as idf from v"),
    "tfidf_top_terms": (tfidf_top_terms, TFIDF),
    "term_share": (term_share, TERM_SHARE),
    "tfidf_fixed_vocab_l2": (tfidf_fixed_vocab_l2, FIXED),
    "lexicon_topic_scores": (lexicon_topic_scores, f"with {TOPIC_ROWS} select doc_id, topic, round(score, 6) as score from ts"),
    "dominant_topic": (dominant_topic, DOMINANT),
    "semantic_category_counts": (semantic_category_counts, f"select category, count(*) as n from ({DOMINANT}) group by category"),
    "tag_patterns": (tag_patterns, f"with {FEATURES} select doc_id, array_to_string(tags, ',') as tags from f where len(tags) > 0"),
    "network_flow_detect": (network_flow_detect, f"with {FEATURES} select doc_id, {', '.join(f'cast(net_{n} as bigint) as net_{n}' for n in NETWORKS)}, {', '.join(f'round(cast(flow_{n} as double), 6) as flow_{n}' for n in FLOWS)}, array_to_string(networks, ',') as networks from f"),
    "primary_flow": (primary_flow, PRIMARY),
    "flow_network_matrix": (flow_network_matrix, MATRIX),
    "coverage_gaps": (coverage_gaps, f"with {FEATURES} select x as flow from unnest({listed(FLOW_NAMES)}) as u(x) where x not in (select primary_flow from f where primary_flow is not null)"),
    "corpus_statistics": (corpus_statistics, STATISTICS),
    "flow_distribution": (flow_distribution, DISTRIBUTION),
    "functionality_groups": (functionality_groups, GROUPS),
    "top_procedures": (top_procedures, TOP_PROCEDURES),
    "top_functions": (top_functions, TOP_FUNCTIONS),
    "category_groups": (category_groups, f"select category, count(*) as n, min(doc_id) as first, md5(string_agg(cast(doc_id as varchar), ',' order by doc_id)) as members from ({DOMINANT}) group by category"),
    "call_groups": (call_groups, CALL_GROUPS),
    "call_targets": (call_targets, r"select call, count(*) as pages from (select page_id, unnest(list_distinct(regexp_extract_all(html, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1))) as call from pages) group by call having count(*) > 1"),
    "control_flags": (control_flags, CONTROL),
    "budget_truncation": (budget_truncation, TRUNCATION),
}
