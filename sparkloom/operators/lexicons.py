"""Topic, network and flow detection by lexicons, which are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking

# Topic seeds in tie-break order, and terms of high value.
TOPICS = {
    "wire_transfer_core": ["wire", "transfer", "payment", "funds", "fedwire", "chips", "swift", "rtgs", "originator", "beneficiary", "debtor", "creditor", "debit", "credit", "settlement"],
    "iso20022_messages": ["iso20022", "pacs", "pain", "camt", "remt", "pacs008", "pacs009", "pacs002", "pacs004", "pacs007", "pain001", "camt056", "camt029", "camt110", "camt111"],
    "swift_processing": ["swift", "mt103", "mt202", "mt202cov", "gpi", "uetr", "bic", "tracker", "fin", "cbpr", "mystandards", "alliance", "score", "cover"],
    "fedwire_operations": ["fedwire", "imad", "omad", "fedline", "advantage", "fedpayments", "manager", "fedtransaction", "analyzer", "drawdown", "participant", "cutoff", "typecode", "bfc"],
    "chips_processing": ["chips", "uid", "sequence", "prefunded", "balance", "netting", "finality", "clearing", "house", "interbank", "realtime", "gross"],
    "investigation_exceptions": ["investigation", "exception", "repair", "return", "reversal", "refund", "nondelivery", "recall", "cancellation", "inquiry", "resolution", "reject"],
    "compliance_screening": ["ofac", "sanctions", "aml", "kyc", "compliance", "screening", "fraud", "monitoring", "suspicious", "detection", "regulatory", "reporting"],
    "correspondent_banking": ["correspondent", "intermediary", "nostro", "vostro", "cover", "instructing", "agent", "ultimate", "routing", "chain", "relationship"],
    "message_validation": ["validation", "authenticate", "verify", "mandatory", "optional", "format", "structured", "address", "lei", "remittance", "purpose", "charge", "bearer"],
    "crossborder_currency": ["crossborder", "currency", "exchange", "rate", "multicurrency", "sepa", "euro", "international", "domestic", "foreign"],
    "system_infrastructure": ["queue", "batch", "realtime", "stp", "straightthrough", "processing", "automated", "manual", "intervention", "priority", "high", "normal"],
    "data_operations": ["database", "table", "record", "insert", "update", "select", "query", "file", "read", "write", "open", "close", "copy", "delete", "archive"],
}
HIGH_VALUE = (
    "iso20022 pacs008 pacs009 mt103 mt202 swift fedwire chips uetr gpi ofac sanctions aml kyc stp correspondent nostro vostro "
    "originator beneficiary investigation exception repair reversal return"
).split()
# Networks and flows with keywords, patterns and transaction tags, in order.
NETWORKS = {
    "fedwire": {"words": ["fedwire", "imad", "omad", "federal_reserve", "type_code"], "patterns": [r"fedwire.*process", r"type.*code.*\d{4}", r"imad.*generate"]},
    "swift": {"words": ["swift", "mt103", "mt202", "bic", "gpi", "uetr"], "patterns": [r"swift.*process", r"mt\d{3}", r"gpi.*track"]},
    "chips": {"words": ["chips", "uid", "netting", "clearing_house"], "patterns": [r"chips.*process", r"uid.*generat", r"clearing.*house"]},
}
FLOWS = {
    "customer_transfer": {"words": ["customer", "transfer", "originator", "beneficiary", "individual"], "patterns": [r"customer.*transfer", r"originator.*beneficiary", r"type.?code.?1000"], "tag": "customer_transfer"},
    "validation": {"words": ["validat", "verify", "check", "format", "mandatory"], "patterns": [r"validat.*process", r"check.*format", r"verify.*field"], "tag": "validation"},
    "exception_handling": {"words": ["exception", "error", "reject", "repair", "fail"], "patterns": [r"exception.*handl", r"error.*process", r"reject.*payment"], "tag": "error_handling"},
    "screening": {"words": ["ofac", "sanctions", "aml", "compliance", "screening"], "patterns": [r"ofac.*screen", r"sanctions.*check", r"aml.*monitor"], "tag": "screening"},
    "settlement": {"words": ["settlement", "clearing", "netting", "rtgs"], "patterns": [r"settlement.*process", r"clearing.*house", r"net.*position"], "tag": None},
}


def _array(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def topic_scores(words: Column, topics: dict[str, list[str]], name_parts: Column | None = None, high_value: list[str] = HIGH_VALUE, technical: dict[str, Column] | None = None) -> Column:
    """(topic, score) of every topic: distinct seed words, 0.4 for each name part, 0.2 for each high-value word, and technical bonuses."""
    parts = name_parts if name_parts is not None else F.array().cast("array<string>")
    bonus = 0.2 * F.size(F.array_intersect(words, _array(high_value)))
    rows = []
    for name, seeds in topics.items():
        score = F.size(F.array_intersect(words, _array(seeds))) + 0.4 * F.size(F.array_intersect(parts, _array(seeds)))
        hit = score > 0
        score = score + (technical or {}).get(name, F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("topic"), F.when(hit, score + bonus).otherwise(score).cast("double").alias("score")))
    return F.array(*rows)


def distribution(scores: Column) -> Column:
    """Scores as shares of their sum (all 0 where nothing scored)."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x["score"])
    return F.transform(scores, lambda x: F.struct(x["topic"].alias("topic"), F.when(total > 0, x["score"] / total).otherwise(0.0).alias("share")))


def dominant(shares: Column) -> Column:
    """The first topic of the largest share."""
    best = F.array_max(F.transform(shares, lambda x: x["share"]))
    return F.get(F.filter(shares, lambda x: x["share"] == best), F.lit(0))


def category(shares: Column, sure: float = 0.25, some: float = 0.15, mixed: str = "mixed", general: str = "general") -> Column:
    """The dominant topic above `sure`; mixed where two topics or more are above `some`; else general."""
    top = dominant(shares)
    many = F.size(F.filter(shares, lambda x: x["share"] > some)) >= 2
    return F.when(top["share"] > sure, top["topic"]).when(many, mixed).otherwise(general)


def network_scores(low: Column, words: Column, tags: Column, networks: dict = NETWORKS) -> Column:
    """(name, score): 2 a keyword, 3 a pattern, and 2 for swift with a tag with mt, for fedwire with a tag with fedwire."""
    rows = []
    for name, n in networks.items():
        score = 2 * F.size(F.array_intersect(words, _array(n["words"])))
        for p in n["patterns"]:
            score = score + F.when(low.rlike(p), 3).otherwise(0)
        part = {"swift": "mt", "fedwire": "fedwire"}.get(name)
        if part:
            score = score + F.when(F.exists(tags, lambda t: F.contains(t, F.lit(part))), 2).otherwise(0)  # noqa: B023
        rows.append(F.struct(F.lit(name).alias("name"), score.cast("int").alias("score")))
    return F.array(*rows)


def detected(scores: Column, above: float = 2) -> Column:
    """Names of scores above the bound, in order."""
    return F.transform(F.filter(scores, lambda x: x["score"] > above), lambda x: x["name"])


def flow_scores(low: Column, words: Column, name: Column, tags: Column, flows: dict = FLOWS) -> Column:
    """(name, score): 0.5 a keyword, 1 a pattern, 0.8 a keyword in the procedure name, 0.6 for the flow's transaction tag."""
    called, rows = F.lower(F.coalesce(name, F.lit(""))), []
    for flow, f in flows.items():
        tenths = 5 * F.size(F.array_intersect(words, _array(f["words"])))
        for p in f["patterns"]:
            tenths = tenths + F.when(low.rlike(p), 10).otherwise(0)
        for w in f["words"]:
            tenths = tenths + F.when(F.contains(called, F.lit(w)), 8).otherwise(0)
        if f.get("tag"):
            tenths = tenths + F.when(F.array_contains(tags, f["tag"]), 6).otherwise(0)
        rows.append(F.struct(F.lit(flow).alias("name"), (tenths / 10).alias("score")))
    return F.array(*rows)


def ranked(scores: Column) -> Column:
    """Scores from high to low, ties in their order."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x["score"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def primary_flow(scores: Column, above: float = 0.5) -> Column:
    top = F.get(ranked(scores), F.lit(0))
    return F.when(top["score"] > above, top["name"])


def secondary_flows(scores: Column, above: float = 0.3, share: float = 0.6, most: int = 2) -> Column:
    """Up to `most` others above the bound and at least that share of the top score; none without a primary flow."""
    order = ranked(scores)
    top = F.get(order, F.lit(0))
    rest = F.filter(F.slice(order, 2, 1000), lambda x: (x["score"] > above) & (x["score"] >= share * top["score"]))
    return F.when(primary_flow(scores).isNotNull(), F.transform(F.slice(rest, 1, most), lambda x: x["name"])).otherwise(F.array().cast("array<string>"))


def flow_summary(primary: Column, secondary: Column, networks: Column, tags: Column) -> Column:
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat_ws(
        " | ",
        F.coalesce(F.concat(F.lit("Primary: "), title(primary)), F.lit("General processing")),
        F.when(F.size(secondary) > 0, F.concat(F.lit("Also: "), title(F.array_join(secondary, ", ")))),
        F.when(F.size(networks) > 0, F.concat(F.lit("Networks: "), F.upper(F.array_join(networks, ", ")))),
        F.when(F.size(tags) > 0, F.concat(F.lit("Messages: "), F.array_join(tags, ", "))),
    )


def keywords(by_weight: Column, calls: Column, name: Column, domain: Column, most: int = 10) -> Column:
    """The top 8 terms, 3 calls, the procedure's name and 3 domain words, each once, the first `most`."""
    all_of = F.concat(F.slice(by_weight, 1, 8), F.slice(calls, 1, 3), F.array_compact(F.array(F.nullif(name, F.lit("")))), F.slice(F.array_sort(domain), 1, 3))
    return F.slice(F.array_distinct(all_of), 1, most)


# Question intents in tie-break order.
INTENTS = {
    "validation": ["validate", "check", "verify", "format"],
    "swift_processing": ["swift", "mt103", "mt202", "bic", "gpi"],
    "fedwire_processing": ["fedwire", "imad", "omad", "federal reserve"],
    "ofac_screening": ["ofac", "sanctions", "aml", "screening", "watchlist"],
    "error_handling": ["error", "exception", "handle", "catch", "recover"],
    "iso20022_processing": ["iso20022", "pacs", "pain", "camt", "xml"],
}
ACTIONS = [
    ("create", ["create", "generate", "build", "make"]),
    ("validate", ["validate", "check", "verify"]),
    ("process", ["process", "handle", "execute"]),
    ("screen", ["screen", "filter"]),
]


def intent(question: Column, intents: dict[str, list[str]] = INTENTS) -> Column:
    """(category, confidence): most keyword hits, over the category's keywords; general at 0.5 without any."""
    low, rows = F.lower(question), []
    for i, (name, words) in enumerate(intents.items()):
        hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        rows.append(F.struct(hits.alias("hits"), F.lit(-i).alias("ord"), F.lit(name).alias("category"), (hits / len(words)).alias("confidence")))
    best = F.array_max(F.array(*rows))
    plain = F.struct(F.lit("general").alias("category"), F.lit(0.5).alias("confidence"))
    return F.when(best["hits"] > 0, F.struct(best["category"].alias("category"), best["confidence"].alias("confidence"))).otherwise(plain)


def action(question: Column) -> Column:
    low, out = F.lower(question), F.lit("general")
    for name, words in reversed(ACTIONS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


# Message types by kind, in the order in which a later one counts.
MESSAGE_TYPES = {
    "swift_message_type": ["MT103", "MT202", "MT202COV", "MT199", "MT299"],
    "iso_message_type": ["PACS.008", "PACS.009", "PAIN.001", "CAMT.056", "CAMT.029"],
}


def message_entities(question: Column) -> Column:
    """(swift_message_type, iso_message_type, fedwire_type) named in a question, in any case, dots of ISO types or none; of several the last listed; null without any."""
    up = F.upper(question)
    swift = iso = F.lit(None).cast("string")
    for name in MESSAGE_TYPES["swift_message_type"]:
        swift = F.when(F.contains(up, F.lit(name)), name).otherwise(swift)
    for name in MESSAGE_TYPES["iso_message_type"]:
        iso = F.when(F.contains(F.replace(up, F.lit("."), F.lit("")), F.lit(name.replace(".", ""))), name).otherwise(iso)
    code = F.when(F.contains(up, F.lit("TYPE CODE")) | F.contains(up, F.lit("TYPECODE")), "TYPE_CODE")
    return F.struct(swift.alias("swift_message_type"), iso.alias("iso_message_type"), code.alias("fedwire_type"))


def entities(rows: DataFrame, dictionary: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, place (of its first word, from 0), phrase, kind: the phrases of a dictionary in texts, by whole words in any case, leftmost, then longest, none
    inside another. dictionary: phrase, kind.

    Words meet phrases by their first word, an equality join; the rest of a phrase is compared in place, so that all phrases are sought in one pass."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    known = dictionary.select("phrase", "kind", split(F.col("phrase")).alias("parts")).where(F.size("parts") > 0).withColumn("word", F.get("parts", F.lit(0)))
    held = chunking.pinned(rows.select(*key, split(F.col(text)).alias("words")))
    words = held.select(*key, "words", F.posexplode("words").alias("place", "word"))
    found = words.join(known, "word").where(F.slice("words", F.col("place") + 1, F.size("parts")) == F.col("parts"))
    hit = F.struct("place", (-F.size("parts")).alias("length"), "phrase", "kind")
    ordered = found.groupBy(*key).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.filter("hits", lambda x: F.lit(False)).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = x["place"] >= s["end"]
        return F.struct(F.when(fits, x["place"] - x["length"]).otherwise(s["end"]).alias("end"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    kept = ordered.select(*key, F.explode(F.aggregate("hits", start, step, lambda s: s["kept"])).alias("x"))
    return kept.select(*key, "x.place", "x.phrase", "x.kind")


def matrix(rows: DataFrame, a: str, b: str, a_names: list[str], b_names: list[str]) -> DataFrame:
    """Counts for every pair of names of two dimensions, zeros included; a is a value and b an array of names."""
    spark = rows.sparkSession
    dims = spark.createDataFrame([(x, y) for x in a_names for y in b_names], f"{a} string, {b} string")
    counts = rows.select(a, F.explode(b).alias(b)).groupBy(a, b).agg(F.count("*").alias("n"))
    return dims.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))
