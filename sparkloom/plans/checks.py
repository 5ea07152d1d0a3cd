"""Catalog and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import catalog, validation
from .corpus import CHUNKS, chunked, docs

# Catalog: the table as it stands against a catalog in which every tenth document is missing, every seventh has an old
# text, and ids beyond the table were indexed once; the difference is the operator's subject.
OLD = "doc_id % 10 <> 0"
CURRENT_SQL = "c as (select cast(doc_id as varchar) as name, md5(text) as hash, octet_length(encode(text)) as size from documents)"
OLD_SQL = f"""o as (select cast(doc_id as varchar) as name, case when doc_id % 7 = 0 then md5('old' || text) else md5(text) end as hash from documents where {OLD}
union all select 'gone-' || cast(doc_id as varchar), md5(text) from documents where doc_id % 25 = 0)"""


def current(spark, sf):
    return catalog.fingerprint(docs(spark, sf).withColumn("name", F.col("doc_id").cast("string")), "name", "text")


def old(spark, sf):
    rows = docs(spark, sf)
    held = rows.where(OLD).select(F.col("doc_id").cast("string").alias("name"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old"), "text")).otherwise(F.col("text"))).alias("hash"))
    return held.unionByName(rows.where("doc_id % 25 = 0").select(F.concat(F.lit("gone-"), F.col("doc_id").cast("string")).alias("name"), F.md5("text").alias("hash")))


def catalog_diff(spark, sf):
    return catalog.diff(old(spark, sf), current(spark, sf))


DIFF = f"with {CURRENT_SQL}, {OLD_SQL} select coalesce(o.name, c.name) as name, case when o.name is null then 'new' when c.name is null then 'removed' when o.hash <> c.hash then 'modified' else 'same' end as status from o full join c on o.name = c.name"


def catalog_upsert(spark, sf):
    changes = catalog_diff(spark, sf)
    fresh = current(spark, sf).drop("size").join(changes.where("status in ('new', 'modified')").select("name"), "name", "left_semi")
    return catalog.upsert(old(spark, sf), fresh, changes)


def catalog_status(spark, sf):
    return catalog.status(catalog_diff(spark, sf))


def catalog_chunk_counts(spark, sf):
    return catalog.chunk_counts(chunked(spark, sf).select(F.col("doc_id").alias("name")))


def multi_corpus_stats(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), F.lit("web").alias("category"), F.col("html").alias("content"))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("role").alias("category"), F.col("text").alias("content"))
    texts = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("text").alias("content"))
    both = catalog.corpora({"documents": texts, "pages": pages, "conversations": turns})
    return both.groupBy("corpus_source", "corpus_index", "category").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


MULTI = """select corpus_source, corpus_index, category, count(*) as n, cast(sum(length(content)) as bigint) as chars from (
select 'documents' as corpus_source, 0 as corpus_index, lang as category, text as content from documents union all select 'pages', 1, 'web', html from pages
union all select 'conversations', 2, role, text from conversations) group by all"""

CHARS = ["text", "source", "absent"]


def charset_invalid_counts(spark, sf):
    return validation.character_counts(docs(spark, sf), CHARS)


def quoted(x):
    return "'" + x.replace("'", "''") + "'" if x not in "\t\n\r" else f"chr({ord(x)})"


DESCRIBE = "case ch " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in checks.CHARACTER_NAMES.items()) + " else 'Unknown special character (U+' || lpad(upper(to_hex(ord(ch))), 4, '0') || ')' end"
CELLS = f"""cells as (select doc_id, 'text' as col, text as v from documents union all select doc_id, 'source', source from documents),
marks as (select doc_id, col, ch from (select doc_id, col, unnest(string_split(nfc_normalize(v), '')) as ch from cells) where ch <> '' and not regexp_full_match(ch, '{checks.VALID_CHARACTERS.replace("'", "''")}'))"""


def charset_row_flags(spark, sf):
    return validation.character_flags(docs(spark, sf), "doc_id", CHARS)


def charset_positions(spark, sf):
    """Over benchmark texts, and three values that NFC changes."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(-1, "A&B_1"), (-2, "e\u0301x\u212a&"), (-3, None)], "item_id long, text string")
    return validation.character_positions(rows.unionByName(odd), "item_id", ["text", "absent"])


POSITIONS = """with v as (select item_id, nfc_normalize(text) as v from (select item_id, text from benchmark union all select * from (values (-1, 'A&B_1'), (-2, 'e' || chr(769) || 'x' || chr(8490) || '&'), (-3, null))) t),
marks as (select item_id, unnest(range(length(v))) as position, v from v), c as (select item_id, cast(position as int) as position, v[position + 1] as ch from marks)"""


def name_characters(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet").select("c_name", "c_mktsegment")
    return validation.character_counts(customer, ["c_name", "c_mktsegment"])


# Rules over orders, standing in for the payment fields.
STATUS, PRIORITIES = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def validated_orders(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    price = F.col("o_totalprice")
    errors = [
        F.when(~F.coalesce(F.col("o_orderstatus").isin("F", "O"), F.lit(False)), F.concat(F.lit("STATUS: Invalid value "), F.coalesce("o_orderstatus", F.lit("none")))),
        F.when(~F.coalesce(F.col("o_orderpriority").rlike(r"^[1-5]-[A-Z ]+\z"), F.lit(False)), F.lit("PRIORITY: wrong format")),
        F.when(~F.coalesce(price.between(1000, 400000), F.lit(False)), F.lit("PRICE: out of range")),
    ]
    warnings = [
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")), F.lit("STATUS: late orders are open")),
        F.when((F.substring("o_orderpriority", 1, 1) == "1") & (price < 50000), F.lit("PRIORITY: urgent and small")),
    ]
    return validation.validated(orders, errors, warnings)


ORDERS = r"""r as (select o_orderkey, list_filter([
case when not coalesce(o_orderstatus in ('F', 'O'), false) then 'STATUS: Invalid value ' || coalesce(o_orderstatus, 'none') end,
case when not coalesce(regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+'), false) then 'PRIORITY: wrong format' end,
case when not coalesce(o_totalprice between 1000 and 400000, false) then 'PRICE: out of range' end], lambda x: x is not null) as errors, list_filter([
case when o_orderstatus = 'F' and o_orderdate >= timestamp '1998-01-01' then 'STATUS: late orders are open' end,
case when o_orderpriority[1:1] = '1' and o_totalprice < 50000 then 'PRIORITY: urgent and small' end], lambda x: x is not null) as warnings from orders)"""


def row_validation(spark, sf):
    rows = validated_orders(spark, sf)
    return rows.select("o_orderkey", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "is_valid").where("not is_valid or warnings <> ''")


def error_frequency(spark, sf):
    rows = validated_orders(spark, sf)
    kinds = [validation.frequency(rows, c).withColumn("list", F.lit(c)) for c in ("errors", "warnings")]
    return kinds[0].unionByName(kinds[1])


def validation_summary(spark, sf):
    return validation.summary(validated_orders(spark, sf))


# Payment rows, in both engines the same values.
IMAD, OK16 = "20240115ABCD123456", "ABCDEFGH12345678"
FIELDS = [*validation.REQUIRED, "COUNTRY_CODE"]
GOOD = ["FED", "FED", "FTR", "FWI", IMAD, IMAD, OK16, OK16, "US"]
PAYMENTS = [
    ("valid", GOOD),
    ("bad date", [*GOOD[:4], "20240230ABCD123456", *GOOD[5:]]),
    ("short ISN", [*GOOD[:6], "ABC", *GOOD[7:]]),
    ("bad enum", ["XYZ", *GOOD[1:]]),
    ("cross-field", [*GOOD[:3], "BOOK", *GOOD[4:]]),
    ("optional", [*GOOD[:8], "USA"]),
    ("lower case", ["fed", *GOOD[1:]]),
    ("null source", [None, *GOOD[1:]]),
    ("leap day", [*GOOD[:4], "20240229ABCD123456", *GOOD[5:]]),
]


def payment_validation(spark, sf):
    rows = spark.createDataFrame([(c, *v) for c, v in PAYMENTS], ", ".join(f"`{c}` string" for c in ["case", *FIELDS]))
    found = validation.validate_payments(rows)
    return found.select("case", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"), "is_valid")


def sql_fed(c, kind):
    v = f"upper(trim(coalesce({c}, '')))"
    if kind in ("FED_ISN", "FED_OSN"):
        return f"(not regexp_full_match({v}, '[A-Z0-9]{{16}}'))"
    return f"(not regexp_full_match({v}, '[0-9]{{8}}[0-9A-Z]{{4}}[0-9]{{6}}') or try_strptime({v}[1:8], '%Y%m%d') is null)"


def sql_in(c, values):
    return f"coalesce(upper(trim({c})) in ({', '.join(map(quoted, values))}), false)"


PAYMENT_SQL = "with p(" + ", ".join(f'"{c}"' for c in ["case", *FIELDS]) + ") as (values " + ", ".join("(" + ", ".join("null" if x is None else quoted(x) for x in (c, *v)) + ")" for c, v in PAYMENTS) + "), r as (select \"case\", " + " + ".join(
    [f"cast(not {sql_in(c, v)} as int)" for c, v in validation.CODED.items()] + [f"cast({sql_fed(c, c)} as int)" for c in validation.REFERENCES]
) + """ as errors, cast(coalesce(upper(SOURCE_CD) = 'FED' and upper(WIRE_TYPE) not in ('FWI', 'FEDWIRE'), false) as int) + cast(coalesce(upper(SOURCE_CD) = 'FED' and upper(TRAN_TYPE) <> 'FTR', false) as int)
+ cast(coalesce(upper(TRAN_TYPE) = 'FTR' and upper(SOURCE_CD) <> 'FED', false) as int) + cast(coalesce(upper(WIRE_TYPE) = 'FWI' and upper(SOURCE_CD) <> 'FED', false) as int)
+ cast(not regexp_full_match(COUNTRY_CODE, '[A-Z]{2}') as int) as warnings from p) select *, errors = 0 as is_valid from r"""

QUERIES = {
    "catalog_diff": (catalog_diff, DIFF),
    "catalog_upsert": (catalog_upsert, f"with {CURRENT_SQL}, {OLD_SQL} select name, hash from c"),
    "catalog_status": (catalog_status, f"select count(*) filter (status = 'new') as n_new, count(*) filter (status = 'modified') as n_modified, count(*) filter (status = 'removed') as n_removed, count(*) filter (status = 'same') as n_same, count(*) filter (status <> 'same') > 0 as needs_update from ({DIFF})"),
    "multi_corpus_stats": (multi_corpus_stats, MULTI),
    "charset_invalid_counts": (charset_invalid_counts, f'with {CELLS} select col as "column", {DESCRIBE} as description, count(*) as n from marks group by all'),
    "charset_row_flags": (charset_row_flags, f"with {CELLS} select doc_id, string_agg(distinct col, ',' order by col desc) as columns, count(*) as n from marks group by doc_id"),
    "charset_positions": (charset_positions, f"""{POSITIONS} select item_id, 'text' as "column", position, ch as char, {DESCRIBE} as description from c where not regexp_full_match(ch, '{checks.VALID_CHARACTERS.replace("'", "''")}')"""),
    "name_characters": (name_characters, f"""with marks as (select col, ch from (select 'c_name' as col, unnest(string_split(c_name, '')) as ch from customer union all select 'c_mktsegment', unnest(string_split(c_mktsegment, '')) from customer) where ch <> '' and not regexp_full_match(ch, '{checks.VALID_CHARACTERS.replace("'", "''")}')) select col as "column", {DESCRIBE} as description, count(*) as n from marks group by all"""),
    "row_validation": (row_validation, f"with {ORDERS} select o_orderkey, array_to_string(errors, ';') as errors, array_to_string(warnings, ';') as warnings, len(errors) = 0 as is_valid from r where len(errors) > 0 or len(warnings) > 0"),
    "error_frequency": (error_frequency, f"with {ORDERS} select string_split(m, ':')[1] as kind, count(*) as n, list from (select unnest(errors) as m, 'errors' as list from r union all select unnest(warnings), 'warnings' from r) group by all"),
    "validation_summary": (validation_summary, f"with {ORDERS} select count(*) as total_rows, count(*) filter (len(errors) = 0) as valid_rows, count(*) filter (len(errors) > 0) as invalid_rows, round(100.0 * count(*) filter (len(errors) = 0) / count(*), 2) as rate from r"),
    "payment_validation": (payment_validation, PAYMENT_SQL),
    "catalog_chunk_counts": (catalog_chunk_counts, f"with {CHUNKS} select doc_id as name, count(*) as chunks_count from c group by doc_id"),
}
