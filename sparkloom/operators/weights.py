"""Term statistics in long form: document frequencies, vocabularies, inverse frequencies, weights, set similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stems
from ..functions import text as fx


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text", stop: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """key, term, n: kept words of each document with their counts. Texts are dealt by key, so that neither this nor what follows by key moves the counts."""
    words = docs.select(key, text).repartition(key).select(key, F.explode(fx.kept_words(fx.words_of(F.col(text)), stop, least)).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("n"))


def stemmed(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, n of stems; each distinct term is stemmed once."""
    rows = stems.with_stems(counts).groupBy(key, "stem").agg(F.sum("n").alias("n"))
    return rows.withColumnRenamed("stem", "term")


def document_frequency(counts: DataFrame) -> DataFrame:
    """term, df; counts has a row for each document and term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(df: DataFrame, n_docs: Column | int, low: Column | int = 2, high: float = 0.8, most: int = 3000) -> DataFrame:
    """The `most` terms of highest df between low and high * n_docs, with idx from 0; ties by term."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    kept = df.where((F.col("df") >= low) & (F.col("df") <= F.floor(n * high)))
    top = kept.orderBy(F.desc("df"), "term").limit(most)  # per-partition top-k first; the window then sees `most` rows
    return top.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).cast("int"))


def inverse_frequency(df: DataFrame, n_docs: int) -> DataFrame:
    return df.withColumn("idf", F.log(F.lit(n_docs) / F.col("df")))


def tfidf(counts: DataFrame, vocab: DataFrame, key: str = "doc_id", high_value: tuple[str, ...] = ()) -> DataFrame:
    """key, term, w: count / all kept words of the document * idf, times 1.5 for high-value terms. vocab: term, idf, of bounded size."""
    totals = Window.partitionBy(key)
    share = counts.withColumn("tf", F.col("n") / F.sum("n").over(totals))
    boost = F.when(F.col("term").isin(*high_value), 1.5).otherwise(1.0) if high_value else F.lit(1.0)
    return share.join(F.broadcast(vocab.select("term", "idf")), "term").select(key, "term", (F.col("tf") * F.col("idf") * boost).alias("w"))


def term_share(counts: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, w: count / all words of the document, for terms of the vocabulary, which is of bounded size."""
    share = counts.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return share.join(F.broadcast(vocab.select("term")), "term", "left_semi").select(key, "term", "w")


def smooth_l2(counts: DataFrame, vocab: DataFrame, n_docs: int, key: str = "doc_id") -> DataFrame:
    """Weights count * (ln((1 + n) / (1 + df)) + 1) over a fixed vocabulary (term, df), L2-normalised, rounded to 4."""
    raw = counts.join(vocab, "term").withColumn("raw", F.col("n") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", F.round(F.col("raw") / norm, 4).alias("w"))


def binary_vector(words: Column, vocab: list[str]) -> Column:
    """0/1 by vocabulary position."""
    return F.transform(F.array(*map(F.lit, vocab)), lambda v: F.array_contains(words, v).cast("int"))


def query_keywords(query: Column, vocab: list[str]) -> Column:
    """(matched, unmatched): the query's lower-cased words in the vocabulary, in its order, and those that are not, in theirs, with repeats."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    known = F.array(*map(F.lit, vocab)) if vocab else F.array().cast("array<string>")
    return F.struct(F.filter(known, lambda v: F.array_contains(words, v)).alias("matched"), F.filter(words, lambda w: ~F.array_contains(known, w)).alias("unmatched"))


def set_similarities(words: Column, query: list[str], size: int) -> dict[str, Column]:
    """cosine, jaccard and hamming of 0/1 vectors of `size` terms, from set sizes."""
    q = F.array(*map(F.lit, query))
    own = F.array_distinct(words)
    both, either, n = F.size(F.array_intersect(own, q)), F.size(F.array_union(own, q)), F.size(own)
    cosine = F.when((n > 0) & F.lit(len(query) > 0), both / F.sqrt(n * F.lit(float(len(query))))).otherwise(0.0)
    return {
        "cosine": F.round(cosine, 4),
        "jaccard": F.round(F.when(either > 0, both / either).otherwise(0.0), 4),
        "hamming": F.round((F.lit(size) - (either - both)) / F.lit(float(size)), 4),
        "match_share": F.round(both / F.lit(float(max(1, len(query)))), 4),
    }


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; 0 where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
