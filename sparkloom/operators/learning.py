"""Hand features, a category classifier and nearest examples, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources import storage
from . import chunking

# Keyword families and pattern counts.
FAMILIES = {
    "iso20022": ["iso20022", "pacs", "pain", "camt", "pacs008", "pacs009", "xml"],
    "swift": ["swift", "mt103", "mt202", "gpi", "uetr", "bic", "fin"],
    "fedwire": ["fedwire", "imad", "omad", "federal", "reserve", "typecode"],
    "chips": ["chips", "uid", "netting", "clearing", "house"],
    "compliance": ["ofac", "sanctions", "aml", "kyc", "screening", "compliance"],
    "exception": ["exception", "error", "repair", "investigation", "return"],
}
PATTERNS = {
    "validation": r"(?i)\b(validat|verify|check)\w*",
    "processing": r"(?i)\b(process|handle|execute)\w*",
    "screening": r"(?i)\b(screen|monitor|detect)\w*",
    "transmission": r"(?i)\b(send|transmit|forward)\w*",
}


def features(text: Column, name: Column | None = None, families: dict[str, list[str]] = FAMILIES, patterns: dict[str, str] = PATTERNS) -> dict[str, Column]:
    """Counts, procedure flags, family counts and presence, pattern counts, function, variable and control counts, density."""
    low, called = F.lower(text), F.lower(F.coalesce(name, F.lit(""))) if name is not None else F.lit("")
    words = fx.words_of(text)
    out = {"word_count": F.size(words), "char_count": F.length(text), "line_count": F.size(F.split(text, "\n")), "has_procedure": (called != "").cast("int")}
    for flag, parts in (("validate", ["validate"]), ("process", ["process"]), ("screen", ["screen"]), ("send", ["send", "transmit"])):
        out[f"proc_{flag}"] = fx.any_of(called, parts).cast("int")
    total = F.lit(0)
    for family, parts in families.items():
        count = sum((F.contains(low, F.lit(p)).cast("int") for p in parts), F.lit(0))
        total = total + count
        out[f"{family}_count"], out[f"has_{family}"] = count, (count > 0).cast("int")
    for pattern, p in patterns.items():
        out[f"{pattern}_count"] = F.regexp_count(text, F.lit(p))
    out |= {"function_count": F.size(fx.called_functions(text)), "variable_count": F.size(fx.declared_variables(text)), "control_count": F.size(fx.control_structures(text))}
    out["keyword_density"] = F.when(F.size(words) > 0, total / F.size(words)).otherwise(0.0)
    return {k: v.cast("double") for k, v in out.items()}


def with_terms(rows: DataFrame, words: Column, stop: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows with terms: words of two characters or more that are no stop words, and the pairs of neighbours among them."""
    plain = F.filter(words, lambda w: F.length(w) > 1)
    held = chunking.pinned(rows.withColumn("kept", F.filter(plain, lambda w: ~w.isin(*stop)) if stop else plain))
    last = F.greatest(F.size("kept") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("kept", 1, last), F.slice("kept", 2, last), lambda a, b: F.concat(a, F.lit(" "), b))
    return held.withColumn("terms", F.concat("kept", pairs)).drop("kept")


def vocabulary(rows: DataFrame, column: str, size: int = 500, min_docs: int = 2, max_share: float = 0.8) -> DataFrame:
    """term, n, docs, idf: of the terms in at least min_docs rows and at most that share of them, the `size` most frequent, then
    by name; idf is ln((1 + rows) / (1 + docs)) + 1. Counts are taken per row before they are summed, so a frequent term is one row a task."""
    total = rows.agg(F.count("*").alias("rows"))
    each = rows.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.explode(column).alias("term")).groupBy("__row", "term").agg(F.count("*").alias("n"))
    counted = each.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).crossJoin(F.broadcast(total))
    held = counted.where((F.col("docs") >= min_docs) & (F.col("docs") <= max_share * F.col("rows")))
    return held.withColumn("idf", F.log((1.0 + F.col("rows")) / (1.0 + F.col("docs"))) + 1.0).drop("rows").orderBy(F.desc("n"), "term").limit(size)


class TermWeights(Estimator, HasInputCol, HasOutputCol):
    """One vocabulary over words and pairs, weighted by count times idf, each row of length 1. The fitted model is a pipeline of
    Spark's own stages, which can be saved and read again. What is collected is the vocabulary, `size` terms."""

    def __init__(self, inputCol: str, outputCol: str, size: int = 500, min_docs: int = 2, max_share: float = 0.8) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.size, self.min_docs, self.max_share = size, min_docs, max_share

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        source, target = self.getInputCol(), self.getOutputCol()
        found = sorted((r.term, r.idf) for r in vocabulary(dataset, source, self.size, self.min_docs, self.max_share).collect())
        terms, idf = [t for t, _ in found] or [""], [w for _, w in found] or [0.0]
        counts = CountVectorizerModel.from_vocabulary(terms, inputCol=source, outputCol=f"{target}_n")
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=f"{target}_n", outputCol=f"{target}_w")
        return PipelineModel([counts, weighted, Normalizer(p=2.0, inputCol=f"{target}_w", outputCol=target)])


def cuts(keys: DataFrame, share: float, buckets: int = 4096) -> DataFrame:
    """label, cut: the least (o, k) of a label whose percent rank is `share` or more (no row: none is). keys: label, at (o, k).

    Rows are counted by stretches of o; only those of the one stretch in which the share is reached are ranked."""
    o = F.col("at.o").try_cast("double")
    ends = keys.groupBy("label").agg(F.min(o).alias("lo"), F.max(o).alias("hi")).withColumnRenamed("label", "__label")  # a row a label
    spot = F.floor((o - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)
    dealt = keys.join(F.broadcast(ends), keys["label"].eqNullSafe(ends["__label"])).select("label", "at", F.coalesce(F.when(F.col("hi") > F.col("lo"), spot), F.lit(-1)).alias("bucket"))
    by, n = Window.partitionBy("label").orderBy("bucket"), F.sum("m").over(Window.partitionBy("label"))
    before = F.coalesce(F.sum("m").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("label", "bucket").agg(F.count("*").alias("m"), F.min("at").alias("cut")).select("*", before.alias("c"), n.alias("n"))
    place = lambda at: F.when(F.col("n") > 1, at / (F.col("n") - 1)).otherwise(0.0)
    sizes = storage.cut(sizes)  # at most `buckets` rows a label
    within = sizes.where((place(F.col("c")) < share) & (place(F.col("c") + F.col("m") - 1) >= share)).select(F.col("label").alias("__label"), F.col("bucket").alias("__bucket"), "c", "n")
    ranked = dealt.join(F.broadcast(within), dealt["label"].eqNullSafe(within["__label"]) & (F.col("bucket") == F.col("__bucket")))
    ranked = ranked.withColumn("rank", F.rank().over(Window.partitionBy("label").orderBy("at"))).where(place(F.col("c") + F.col("rank") - 1) >= share)
    found = ranked.select("label", F.col("at").alias("cut")).unionByName(sizes.where(place(F.col("c")) >= share).select("label", "cut"))
    return storage.cut(found.groupBy("label").agg(F.min("cut").alias("cut")))


def split(rows: DataFrame, label: str, key: str, share: float = 0.8, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Stratified by label in an order of hashes (or a given one), the same each time: rows of a percent rank below the share, and the rest.

    No rows are sorted or moved; label and key are read first, so they should not be costly to compute."""
    at = F.struct((F.xxhash64(key) if order is None else order).alias("o"), F.col(key).alias("k"))
    found = cuts(rows.select(F.col(label).alias("label"), at.alias("at")), share).select(F.col("label").alias("__label"), F.col("cut").alias("__cut"))  # a row a label
    held = rows.join(F.broadcast(found), rows[label].eqNullSafe(found["__label"]), "left").withColumn("__train", F.col("__cut").isNull() | (at < F.col("__cut"))).drop("__label", "__cut")
    return held.where("__train").drop("__train"), held.where("not __train").drop("__train")


def pipeline(kind: str, label: str, numeric: list[str], terms: int = 500) -> Pipeline:
    """Words and pairs in one weighted vocabulary, with the hand features, into one of forest, logistic or bayes. Input: terms (of with_terms), features, label."""
    stages = [
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep"), TermWeights("terms", "weights", terms),
        VectorAssembler(inputCols=["weights", *numeric], outputCol="x", handleInvalid="keep"),
    ]
    model = {
        "forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=100, seed=42),
        "logistic": LogisticRegression(featuresCol="x", labelCol="y", maxIter=1000),
        "bayes": NaiveBayes(featuresCol="x", labelCol="y", smoothing=0.1),
    }[kind]
    return Pipeline(stages=[*stages, model])


def best_of(
    rows: DataFrame, label: str, key: str, numeric: list[str], kinds: tuple[str, ...] = ("forest", "logistic", "bayes"), order: Column | None = None
) -> tuple[PipelineModel, str, float]:
    """The model of highest held-out accuracy, of equal ones the first, with its kind and accuracy. Save it with model.save(path)."""
    train, test = split(storage.cut(rows), label, key, order=order)  # read by every kind
    judge, best = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), None
    for kind in kinds:
        model = pipeline(kind, label, numeric).fit(train)
        score = judge.evaluate(model.transform(test))
        if best is None or score > best[2]:
            best = (model, kind, score)
    return best


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with predicted (a label) and confidence (the highest probability)."""
    labels = next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels
    name = F.get(F.array(*map(F.lit, labels)), F.col("prediction").cast("int"))
    said = model.transform(rows).withColumns({"predicted": name, "confidence": F.array_max(vector_to_array("probability"))})
    return said.select(*rows.columns, "predicted", "confidence")


def confusion(rows: DataFrame, label: str = "y", predicted: str = "prediction") -> DataFrame:
    """label, precision, recall, f1, support."""
    hit = F.col(label) == F.col(predicted)
    truth = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("support"), F.count_if(hit).alias("hits"))
    said = rows.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    both = truth.join(said, "label", "full_outer").na.fill(0)
    p, r = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return both.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def nearest_example(weights: DataFrame, query: DataFrame, least: float = 0.1, key: str = "doc_id") -> DataFrame:
    """For each query the document of the highest cosine over shared terms, if above the bound. weights: key, term, w; query: qid, term, w."""
    norm = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qnorm = query.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"))
    dot = weights.join(query.withColumnRenamed("w", "qw"), "term").groupBy("qid", key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dot.join(norm, key).join(qnorm, "qid").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6)).where(F.col("score") > least)
    best = scored.groupBy("qid").agg(F.max(F.struct("score", (-F.col(key)).alias("k"))).alias("b"))
    return best.select("qid", (-F.col("b.k")).alias(key), F.col("b.score").alias("score"))
