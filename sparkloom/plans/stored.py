"""Queries that build a stored index of the documents, change it, and search what is stored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lexicons, stored_index
from ..sources import snapshots, storage, tables
from .corpus import WORDS, docs, in_list

QUERY = ["license", "token", "the", "public"]


def _chunks(rows):
    return rows.select("source_file", F.lit(0).alias("chunk_id"), "content", "lang")


def index_of(spark, sf):
    """Documents as files of one chunk; every tenth is indexed again with another text, the ones after those are removed."""
    rows = docs(spark, sf).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_file"), F.coalesce("text", F.lit("")).alias("content"), "lang", "doc_id")
    store = snapshots.Store(spark, storage.place(spark, "index"))
    stored_index.build(store, rows.select("source_file", "content"), _chunks(rows))
    again = rows.where("doc_id % 10 = 0").withColumn("content", F.concat("content", F.lit("\npublic license public token")))
    stored_index.update(store, again.select("source_file", "content"), _chunks(again), rows.where("doc_id % 10 = 1").select("source_file"))
    return store


def stored_search(spark, sf):
    """Hits with the reasons of their rank, as rows of the index."""
    store = index_of(spark, sf)
    return stored_index.shown(store, stored_index.lexical(store, QUERY, 20), "lang")


def stored_search_before(spark, sf):
    """The same search in the version before the change."""
    return stored_index.lexical(index_of(spark, sf), QUERY, 20, version=1).select("source_file", "score")


def stored_files(spark, sf):
    """The catalog after the change and a compaction of its table."""
    store = index_of(spark, sf)
    store.compact("catalog")
    return store.read("catalog")


_CHANGED = "r as (select 'f' || doc_id as source_file, lang, case when doc_id % 10 = 0 then coalesce(text, '') || chr(10) || 'public license public token' else coalesce(text, '') end as text from documents where doc_id % 10 <> 1)"
_FIRST = "r as (select 'f' || doc_id as source_file, lang, coalesce(text, '') as text from documents)"
_BM = f"""t as (select source_file, unnest({WORDS}) as term from r), n as (select source_file, term, count(*) as n from t group by all), d as (select term, count(*) as df from n group by term),
l as (select source_file, sum(n) as len from n group by source_file), st as (select count(*) as nn, avg(len) as mean from l),
b as (select n.source_file, round(sum(ln(1 + (st.nn - d.df + 0.5) / (d.df + 0.5)) * n.n * 2.2 / (n.n + 1.2 * (0.25 + 0.75 * l.len / st.mean))), 6) as score, 'terms: ' || string_agg(n.term, ', ' order by n.term) as reasons
from n join l using (source_file) join d on d.term = n.term cross join st where n.term in ({in_list(QUERY)}) group by n.source_file)"""

PHRASES = [("the", "word"), ("the that", "pair"), ("que la", "pair"), ("la", "word"), ("in the and", "triple"), ("und", "word"), ("in the", "pair"), ("der und der", "triple"), ("de", "word")]


def phrase_mentions(spark, sf):
    """Phrases of a dictionary in what users said, numbered in order."""
    turns = tables.read(spark, sf, "conversations").where("role = 'user'")
    found = lexicons.entities(turns, spark.createDataFrame(PHRASES, "phrase string, kind string"), ["conv_id", "turn"])
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("place"))
    return found.select("conv_id", "turn", nth.cast("long").alias("nth"), "phrase", "kind")


_LONGEST = sorted((p for p, _ in PHRASES), key=lambda p: -len(p.split()))
MENTIONS = f"""with s as (select conv_id, turn, regexp_extract_all(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), '  ') || ' ', ' (?:{'|'.join(p.replace(' ', '  ') for p in _LONGEST)}) ') as m from conversations where role = 'user'),
u as (select conv_id, turn, unnest(range(1, len(m) + 1)) as nth, replace(trim(unnest(m)), '  ', ' ') as phrase from s)
select conv_id, turn, nth, phrase, case len(string_split(phrase, ' ')) when 1 then 'word' when 2 then 'pair' else 'triple' end as kind from u"""


def message_questions(spark, sf):
    """Message types that events name, some with dots, some in lower case."""
    texts = F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("event_id") % len(QUESTIONS)).cast("int"))
    rows = tables.read(spark, sf, "events").select("event_id", F.concat(texts, F.lit(" "), "event_type").alias("q"))
    return rows.select("event_id", lexicons.message_entities(F.col("q")).alias("e"), lexicons.action(F.col("q")).alias("action")).select("event_id", "e.*", "action")


QUESTIONS = ["create an mt103 or MT199", "validate MT202COV", "pacs008 or camt.056?", "Type Code of PAIN.001", "typecode", "screen it", "MT299 mt202"]
_Q = f"q as (select event_id, list_value({', '.join(chr(39) + x + chr(39) for x in QUESTIONS)})[event_id % {len(QUESTIONS)} + 1] || ' ' || event_type as q, upper(q) as up, replace(upper(q), '.', '') as bare from events)"
MESSAGES = f"""with {_Q} select event_id, {' '.join(f"case when contains(up, '{x}') then '{x}' else" for x in reversed(lexicons.MESSAGE_TYPES['swift_message_type']))} null {'end ' * 5} as swift_message_type,
{' '.join(f"case when contains(bare, '{x.replace('.', '')}') then '{x}' else" for x in reversed(lexicons.MESSAGE_TYPES['iso_message_type']))} null {'end ' * 5} as iso_message_type, case when regexp_matches(up, 'TYPE ?CODE') then 'TYPE_CODE' end as fedwire_type,
case when regexp_matches(lower(q), 'create|generate|build|make') then 'create' when regexp_matches(lower(q), 'validate|check|verify') then 'validate' when regexp_matches(lower(q), 'process|handle|execute') then 'process'
when regexp_matches(lower(q), 'screen|filter') then 'screen' else 'general' end as action from q"""


QUERIES = {
    "phrase_mentions": (phrase_mentions, MENTIONS),
    "message_questions": (message_questions, MESSAGES),
    "stored_search": (stored_search, f"with {_CHANGED}, {_BM} select source_file, 0 as chunk_id, lang, score, reasons from b join r using (source_file) order by score desc, source_file limit 20"),
    "stored_search_before": (stored_search_before, f"with {_FIRST}, {_BM} select source_file, score from b order by score desc, source_file limit 20"),
    "stored_files": (stored_files, f"with {_CHANGED} select source_file, md5(text) as hash, strlen(text)::int as size, 1::bigint as chunks_count from r"),
}
