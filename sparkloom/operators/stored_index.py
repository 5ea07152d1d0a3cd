"""A stored search index: chunks, postings, lengths, embeddings and catalog as tables of one store, changed in one commit, and searches that read it.

Texts are tokenized when they are indexed, never when they are searched: a search reads the postings of its own terms (the files are ranged by term),
which carry their chunk's length, and the corpus' two sums; hits are then joined to the few chunk rows that are shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources.snapshots import Replace, Store, Upsert
from . import catalog, chunking

TERMS = ("term",)


def postings(chunks: DataFrame) -> DataFrame:
    """source_file, chunk_id, term, n, length (all terms of the chunk). chunks: source_file, chunk_id, content."""
    words = chunking.pinned(chunks.select("source_file", "chunk_id", fx.kept_words(fx.words_of(F.col("content"))).alias("words")))  # tokenized once for both uses
    each = words.select("source_file", "chunk_id", F.size("words").cast("long").alias("length"), F.explode("words").alias("term"))
    return each.groupBy("source_file", "chunk_id", "term", "length").agg(F.count("*").alias("n")).select("source_file", "chunk_id", "term", "n", "length")


def lengths(chunks: DataFrame) -> DataFrame:
    """source_file, n_chunks, n_terms: what the corpus' sums are made of, a row a file."""
    size = F.size(fx.kept_words(fx.words_of(F.col("content")))).cast("long")
    return chunking.pinned(chunks.select("source_file", size.alias("n"))).where("n > 0").groupBy("source_file").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_terms"))


def _catalog(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    held = catalog.fingerprint(documents, "source_file", "content")
    return held.join(catalog.chunk_counts(chunks, "source_file").withColumnRenamed("source_file", "name"), "name", "left").select(F.col("name").alias("source_file"), "hash", "size", F.coalesce("chunks_count", F.lit(0)).cast("long").alias("chunks_count"))


def build(store: Store, documents: DataFrame, chunks: DataFrame, provider=None) -> int:
    """The first version. documents: source_file, content; chunks: source_file, chunk_id, content and what else is to be shown."""
    return store.commit(
        {
            "chunks": Replace(chunks, ("source_file", "chunk_id")), "postings": Replace(postings(chunks), TERMS), "lengths": Replace(lengths(chunks)), "catalog": Replace(_catalog(documents, chunks)),
            "embeddings": Replace(catalog.embed(chunks, provider).select("source_file", "chunk_id", "embedding")),
        }
    )


def update(store: Store, documents: DataFrame, chunks: DataFrame, removed: DataFrame, provider=None) -> int:
    """Documents indexed again or anew with their chunks, and names removed (source_file), in all tables at once."""
    base = store.version()
    gone = documents.select("source_file").unionByName(removed.select("source_file")).distinct()

    def upsert(rows: DataFrame, *sort: str) -> Upsert:
        return Upsert(rows, "source_file", gone, sort)

    return store.commit(
        {
            "chunks": upsert(chunks, "source_file", "chunk_id"), "postings": upsert(postings(chunks), *TERMS), "lengths": upsert(lengths(chunks)), "catalog": upsert(_catalog(documents, chunks)),
            "embeddings": upsert(catalog.embed(chunks, provider).select("source_file", "chunk_id", "embedding")),
        },
        base,
    )


def lexical(store: Store, query: Sequence[str], k: int = 10, k1: float = 1.2, b: float = 0.75, version: int | None = None) -> DataFrame:
    """source_file, chunk_id, score, matched (the query's terms in the chunk): the k best chunks by BM25, ties by file and chunk.

    The scan of the postings has the query's terms pushed down; chunk count and mean length come from a row a file."""
    hits = store.read("postings", version).where(F.col("term").isin(*query))
    sums = store.read("lengths", version).agg(F.sum("n_chunks").alias("n_docs"), F.sum("n_terms").alias("n_terms"))
    stats = sums.select("n_docs", (F.col("n_terms") / F.col("n_docs")).alias("mean"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = rows.groupBy("source_file", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    return scored.orderBy(F.desc("score"), "source_file", "chunk_id").limit(k)


def shown(store: Store, hits: DataFrame, *columns: str, version: int | None = None) -> DataFrame:
    """Hits (at most the k rows of a search) as chunk rows with the reasons of their rank: `terms: a, b`."""
    rows = store.read("chunks", version).select("source_file", "chunk_id", *columns)
    reason = F.concat(F.lit("terms: "), F.array_join("matched", ", "))
    return rows.join(hits, ["source_file", "chunk_id"]).select("source_file", "chunk_id", *columns, "score", reason.alias("reasons"))
