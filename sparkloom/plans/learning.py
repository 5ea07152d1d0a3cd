"""Feature and classifier queries on labelled documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import learning
from ..sources import tables
from .corpus import TERMS, TOPICS, counts, docs, in_list

FAMILIES = {k: TOPICS[k] for k in ("legal", "access", "linking")}
PATTERNS = {"validation": r"licen[a-z]*", "processing": r"tok[a-z]*"}


def ml_features(spark, sf):
    made = learning.features(F.col("text"), None, FAMILIES, PATTERNS)
    shown = ["word_count", "char_count", "line_count", *[f"{k}_count" for k in FAMILIES], *[f"has_{k}" for k in FAMILIES], *[f"{k}_count" for k in PATTERNS], "keyword_density"]
    return docs(spark, sf).select("doc_id", *[F.round(made[c], 6).alias(c) for c in shown])


def _hits(words):
    return " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in words)


ML = f"""with b as (select doc_id, text, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0), lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]*'))) as words, {', '.join(f'{_hits(v)} as n_{k}' for k, v in FAMILIES.items())} from documents)
select doc_id, cast(words as double) as word_count, cast(length(text) as double) as char_count, cast(len(string_split(text, chr(10))) as double) as line_count, {', '.join(f'cast(n_{k} as double) as {k}_count, cast(n_{k} > 0 as double) as has_{k}' for k in FAMILIES)},
{', '.join(f"cast(len(regexp_extract_all(text, '{p}')) as double) as {k}_count" for k, p in PATTERNS.items())}, case when words > 0 then round(({' + '.join(f'n_{k}' for k in FAMILIES)}) / words, 6) else 0 end as keyword_density from b"""


STOP = ["the", "and", "of", "to", "que", "der"]


def order():
    return (F.col("doc_id") * 7919) % 1000003



def labels(spark, sf):
    said = tables.read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return docs(spark, sf).select("doc_id", "text").join(said, "doc_id")


def termed(rows):
    return learning.with_terms(rows, fx.words_of(F.col("text")), STOP)


def labelled(spark, sf):
    return termed(labels(spark, sf))


def ml_predict(spark, sf):
    """Quality of held-out labelled documents, by the best of forest, logistic regression and bayes on words, pairs and hand features."""
    made = learning.features(F.col("text"), None, FAMILIES, PATTERNS)
    featured = lambda rows: termed(rows).select("doc_id", "label", "terms", *[v.alias(k) for k, v in made.items()])
    rows = labels(spark, sf)
    model, kind, accuracy = learning.best_of(featured(rows), "label", "doc_id", list(made))
    _, test = learning.split(rows, "label", "doc_id")
    return learning.predicted(model, featured(test)).select("doc_id", "label", "predicted", "confidence", F.lit(kind).alias("kind"), F.lit(accuracy).alias("accuracy"))


def bayes_predict(spark, sf):
    """Quality of held-out labelled documents by bayes on words and pairs alone, which SQL can follow to the last step."""
    train, test = (termed(x).select("doc_id", "label", "terms") for x in learning.split(labels(spark, sf), "label", "doc_id", order=order()))
    model = learning.pipeline("bayes", "label", []).fit(train)
    return learning.predicted(model, test).select("doc_id", "label", "predicted", F.round("confidence", 4).alias("confidence"))


def classifier_vocabulary(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "label", "terms")
    return learning.vocabulary(rows, "terms").select("term", "n", "docs", F.round("idf", 6).alias("idf"))


def classifier_weights(spark, sf):
    """The weights of every labelled document, a row a term."""
    rows = labelled(spark, sf).select("doc_id", "label", "terms")
    model = learning.TermWeights("terms", "weights").fit(rows)
    found = model.transform(rows).select("doc_id", F.posexplode(vector_to_array("weights")).alias("i", "w")).where("w > 0")
    names = F.array(*map(F.lit, model.stages[0].vocabulary))
    return found.select("doc_id", F.get(names, F.col("i")).alias("term"), F.round("w", 6).alias("w"))


_TERMS = f"""b as (select doc_id, cast(quality as varchar) as label, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0), lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]*') and length(w) > 1 and w not in ({in_list(STOP)})) as words
    from documents join labels using (doc_id)),
x as (select doc_id, label, words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) as terms from b)"""


def _vocabulary(source):
    return f"""e as (select doc_id, unnest(terms) as term from {source}), f as (select doc_id, term, count(*) as tf from e group by all),
v as (select term, cast(sum(tf) as bigint) as n, count(*) as docs, ln((1 + (select count(*) from {source})) / (1.0 + count(*))) + 1 as idf from f group by term
    having count(*) >= 2 and count(*) <= 0.8 * (select count(*) from {source}) order by sum(tf) desc, term limit 500)"""


_WEIGHTS = "w as (select g.doc_id, g.term, tf * idf / sqrt(sum(tf * tf * idf * idf) over (partition by g.doc_id)) as w from g join v on v.term = g.term)"
BAYES = f"""with {_TERMS}, s as (select *, percent_rank() over (partition by label order by (doc_id * 7919) % 1000003, doc_id) < 0.8 as train from x), tr as (select * from s where train), {_vocabulary('tr')},
g as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from s) group by all), {_WEIGHTS},
c as (select label, count(*) as n from tr group by label),
t as (select c.label, v.term, coalesce(sum(w.w), 0) as s from c cross join v left join tr on tr.label = c.label left join w on w.doc_id = tr.doc_id and w.term = v.term group by all),
th as (select label, term, ln(s + 0.1) - ln(sum(s) over (partition by label) + 0.1 * (select count(*) from v)) as theta from t),
pi as (select label, ln(n + 0.1) - ln((select sum(n) from c) + 0.1 * (select count(*) from c)) as p from c),
sc as (select s.doc_id, s.label, pi.label as said, any_value(p) + coalesce(sum(w.w * theta), 0) as score from s cross join pi left join w on w.doc_id = s.doc_id left join th on th.label = pi.label and th.term = w.term where not s.train group by all),
k as (select *, 1 / sum(exp(score - m)) over (partition by doc_id) as top from (select *, max(score) over (partition by doc_id) as m from sc))
select doc_id, label, said as predicted, round(top, 4) as confidence from k where score = m"""


def nearest_example(spark, sf):
    all_counts = counts(spark, sf)
    share = all_counts.where(F.col("term").isin(*sorted({w for ws in TOPICS.values() for w in ws}))).select("doc_id", "term", F.col("n").cast("double").alias("w"))
    query = spark.createDataFrame([(1, "license", 2.0), (1, "public", 1.0), (2, "token", 1.0), (2, "with", 0.5), (3, "warranty", 1.0)], "qid int, term string, w double")
    return learning.nearest_example(share, query)


NEAREST = f"""with {TERMS}, w as (select doc_id, term, n as w from n where term in ({in_list(sorted({w for ws in TOPICS.values() for w in ws}))})), q(qid, term, w) as (values (1, 'license', 2.0), (1, 'public', 1.0), (2, 'token', 1.0), (2, 'with', 0.5), (3, 'warranty', 1.0)),
s as (select q.qid, w.doc_id, round(sum(w.w * q.w) / (any_value(wn.norm) * any_value(qn.norm)), 6) as score from w join q on q.term = w.term join (select doc_id, sqrt(sum(w * w)) as norm from w group by 1) wn on wn.doc_id = w.doc_id join (select qid, sqrt(sum(w * w)) as norm from q group by 1) qn on qn.qid = q.qid group by q.qid, w.doc_id)
select qid, doc_id, score from s where score > 0.1 qualify row_number() over (partition by qid order by score desc, doc_id) = 1"""

QUERIES = {"ml_features": (ml_features, ML), "ml_predict": (ml_predict, None), "bayes_predict": (bayes_predict, BAYES), "classifier_vocabulary": (classifier_vocabulary, f"with {_TERMS}, {_vocabulary('x')} select term, n, docs, round(idf, 6) as idf from v"),
    "classifier_weights": (classifier_weights, f"with {_TERMS}, {_vocabulary('x')}, g as (select * from f), {_WEIGHTS} select doc_id, term, round(w, 6) as w from w"), "nearest_example": (nearest_example, NEAREST)}
