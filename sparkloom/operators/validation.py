"""Row validation with errors and warnings, and frequency reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import checks

# Fields of a payment row.
CODED = {
    "SOURCE_CD": ["FED", "ACH", "WIRE", "BOOK", "SWIFT"],
    "INSTR_ADV_TYPE": ["FED", "SWIFT", "TELEX", "PHONE", "EMAIL"],
    "TRAN_TYPE": ["FTR", "CHK", "TRF", "ACH", "WIRE"],
    "WIRE_TYPE": ["FWI", "COVER", "BOOK", "FEDWIRE"],
}
REFERENCES = ["FED_IMAD", "FED_OMAD", "FED_ISN", "FED_OSN"]
OPTIONAL = {
    "CURRENCY_CODE": ("pattern", "ActiveCurrencyCode"),
    "AMOUNT": ("decimal", ""),
    "BIC_CODE": ("pattern", "BICFIDec2014Identifier"),
    "IBAN": ("pattern", "IBAN2007Identifier"),
    "COUNTRY_CODE": ("pattern", "CountryCode"),
    "CHARGE_BEARER": ("enum", "ChargeBearerType1Code"),
    "CLEARING_CHANNEL": ("enum", "ClearingChannel2Code"),
    "SETTLEMENT_METHOD": ("enum", "SettlementMethod1Code"),
    "PRIORITY": ("enum", "Priority3Code"),
}
REQUIRED = [*CODED, *REFERENCES]


def _clean(name: str) -> Column:
    return F.upper(F.trim(F.col(name)))


def payment_errors() -> list[Column]:
    out = []
    for name, allowed in CODED.items():
        v = _clean(name)
        said = F.concat(F.lit(f"{name}: Invalid value '"), F.coalesce(v, F.lit("")), F.lit(f"', valid are {', '.join(sorted(allowed))}"))
        out.append(F.when(~F.coalesce(v.isin(*allowed), F.lit(False)), said))
    for name in REFERENCES:
        out.append(F.when(checks.fed_reference(F.col(name), name).isNotNull(), F.concat(F.lit(f"{name}: "), checks.fed_reference(F.col(name), name))))
    return out


def payment_warnings(columns: Sequence[str]) -> list[Column]:
    source, tran, wire = _clean("SOURCE_CD"), _clean("TRAN_TYPE"), _clean("WIRE_TYPE")
    out = [
        F.when((source == "FED") & ~wire.isin("FWI", "FEDWIRE"), F.lit("WIRE_TYPE: FED source needs FWI or FEDWIRE")),
        F.when((source == "FED") & (tran != "FTR"), F.lit("TRAN_TYPE: FED source needs FTR")),
        F.when((tran == "FTR") & (source != "FED"), F.lit("SOURCE_CD: FTR needs FED source")),
        F.when((wire == "FWI") & (source != "FED"), F.lit("SOURCE_CD: FWI needs FED source")),
    ]
    for name, (kind, rule) in OPTIONAL.items():
        if name in columns:
            v = F.trim(F.col(name))
            fine = checks.decimal_digits(v) if kind == "decimal" else checks.matches(v, rule) if kind == "pattern" else checks.listed(v, rule)
            out.append(F.when((v != "") & ~fine, F.lit(f"{name}: invalid format")))
    return out


def validated(rows: DataFrame, errors: Sequence[Column], warnings: Sequence[Column]) -> DataFrame:
    """The rows with errors, warnings (arrays of those that aren't null) and is_valid."""
    kept = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull()) if cols else F.array().cast("array<string>")
    return rows.withColumn("errors", kept(errors)).withColumn("warnings", kept(warnings)).withColumn("is_valid", F.size("errors") == 0)


def validate_payments(rows: DataFrame) -> DataFrame:
    """Validates payment rows; a missing required column is the only error of every row."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        return validated(rows, [F.lit(f"Missing required columns: {', '.join(missing)}")], [])
    return validated(rows, payment_errors(), payment_warnings(rows.columns))


def frequency(rows: DataFrame, column: str = "errors") -> DataFrame:
    """kind, n: messages by their text before the first colon."""
    return rows.select(F.explode(column).alias("m")).groupBy(F.substring_index("m", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals and the share of valid rows in percent (0 without rows)."""
    n, ok = F.count("*"), F.count_if("is_valid")
    return rows.agg(n.alias("total_rows"), ok.alias("valid_rows"), (n - ok).alias("invalid_rows"), F.round(F.when(n > 0, 100.0 * ok / n).otherwise(0.0), 2).alias("rate"))


def character_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, description, n of characters outside the permitted set; columns that the table lacks are left out."""
    there = [c for c in columns if c in rows.columns]
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in there])).alias("cell")).select("cell.column", checks.nfc(F.col("cell.value")).alias("value"))
    marks = cells.where(checks.has_invalid_characters(F.col("value"))).select("column", F.explode(checks.invalid_characters(F.col("value"))).alias("x"))
    return marks.groupBy("column", F.col("x.description").alias("description")).agg(F.count("*").alias("n"))


def character_flags(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key and, for rows with any, the columns that hold characters outside the set and how many."""
    there = [c for c in columns if c in rows.columns]
    rows = rows.select(key, *(checks.nfc(F.col(c).cast("string")).alias(c) for c in there if c != key))
    n = sum((F.size(checks.invalid_characters(F.col(c))) for c in there), F.lit(0))
    names = F.array_compact(F.array(*[F.when(checks.has_invalid_characters(F.col(c)), F.lit(c)) for c in there]))
    return rows.select(key, F.array_join(names, ",").alias("columns"), n.cast("long").alias("n")).where("n > 0")


def character_positions(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, column, position (from 0, in NFC), char, description of each character outside the permitted set."""
    there = [c for c in columns if c in rows.columns]
    cells = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in there])).alias("cell"))
    cells = cells.select(key, "cell.column", checks.nfc(F.col("cell.value")).alias("value"))
    marks = cells.where(checks.has_invalid_characters(F.col("value"))).select(key, "column", F.explode(checks.invalid_characters(F.col("value"))).alias("x"))
    return marks.select(key, "column", "x.position", "x.char", "x.description")


def report(rows: DataFrame, samples: int = 50) -> str:
    """The text report: totals, frequencies (only with invalid rows), the first invalid rows, a recommendation."""
    one: Row = summary(rows).first()
    out = [f"Total rows: {one.total_rows}", f"Valid rows: {one.valid_rows}", f"Invalid rows: {one.invalid_rows}", f"Rate: {one.rate:.2f}%"]
    if one.invalid_rows:
        for title, column in (("Errors", "errors"), ("Warnings", "warnings")):
            held = frequency(rows, column).orderBy(F.desc("n"), "kind").collect()  # a row a rule
            out += ["", title, *(f"  {r.kind}: {r.n}" for r in held)]
        shown = rows.where("not is_valid").select("row_index", "errors").orderBy("row_index").limit(samples).collect()
        out += ["", "Invalid rows", *(f"  Row {r.row_index}: {'; '.join(r.errors)}" for r in shown)]
    said = "all rows are valid" if one.rate == 100 else "a few rows need correction" if one.rate >= 95 else "many rows need correction" if one.rate >= 80 else "check the source of the data"
    return "\n".join([*out, "", f"Recommendation: {said}"])
