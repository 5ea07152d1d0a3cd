"""Column predicates of the payment and character-set rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, enumerations, length limits and character names of the message standard.
PATTERNS = {
    "Max35Text": r".{1,35}",
    "Max140Text": r".{1,140}",
    "Max15NumericText": r"[0-9]{1,15}",
    "IBAN2007Identifier": r"[A-Z]{2,2}[0-9]{2,2}[a-zA-Z0-9]{1,30}",
    "BICFIDec2014Identifier": r"[A-Z0-9]{4,4}[A-Z]{2,2}[A-Z0-9]{2,2}([A-Z0-9]{3,3}){0,1}",
    "ActiveCurrencyCode": r"[A-Z]{3,3}",
    "CountryCode": r"[A-Z]{2,2}",
    "LEIIdentifier": r"[A-Z0-9]{18,18}[0-9]{2,2}",
    "UUIDv4Identifier": r"[a-f0-9]{8}-[a-f0-9]{4}-4[a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}",
}
ENUMS = {
    "ChargeBearerType1Code": ["DEBT", "CRED", "SHAR", "SLEV"],
    "ClearingChannel2Code": ["RTGS", "RTNS", "MPNS", "BOOK"],
    "SettlementMethod1Code": ["INDA", "INGA", "COVE", "CLRG"],
    "Priority2Code": ["HIGH", "NORM"],
    "Priority3Code": ["URGT", "HIGH", "NORM"],
    "CreditDebitCode": ["CRDT", "DBIT"],
    "AddressType2Code": ["ADDR", "PBOX", "HOME", "BIZZ", "MLTO", "DLVY"],
    "Instruction4Code": ["PHOA", "TELA"],
    "NamePrefix2Code": ["DOCT", "MADM", "MISS", "MIST", "MIKS"],
    "PreferredContactMethod1Code": ["LETT", "MAIL", "PHON", "FAXX", "CELL"],
    "RegulatoryReportingType1Code": ["CRED", "DEBT", "BOTH"],
    "RemittanceLocationMethod2Code": ["FAXI", "EDIC", "URID", "EMAL", "POST", "SMSM"],
    "DocumentType3Code": ["RADM", "RPIN", "FXDR", "DISP", "PUOR", "SCOR"],
    "DocumentType6Code": ["MSIN", "CNFA", "DNFA", "CINV", "CREN", "DEBN", "HIRI", "SBIN", "CMCN", "SOAC", "DISP", "BOLD", "VCHR", "AROI", "TSUT", "PUOR"],
    "MandateClassification1Code": ["FIXE", "USGB", "VARI"],
    "Frequency6Code": ["YEAR", "MNTH", "QURT", "MIAN", "WEEK", "DAIL", "ADHO", "INDA", "FRTN"],
    "TaxRecordPeriod1Code": ["MM01", "MM02", "MM03", "MM04", "MM05", "MM06", "MM07", "MM08", "MM09", "MM10", "MM11", "MM12", "QTR1", "QTR2", "QTR3", "QTR4", "HLF1", "HLF2"],
}
CODE_LENGTHS = {
    "ExternalAccountIdentification1Code": (1, 4),
    "ExternalCashAccountType1Code": (1, 4),
    "ExternalCashClearingSystem1Code": (1, 3),
    "ExternalCategoryPurpose1Code": (1, 4),
    "ExternalClearingSystemIdentification1Code": (1, 5),
    "ExternalCreditorAgentInstruction1Code": (1, 4),
    "ExternalDiscountAmountType1Code": (1, 4),
    "ExternalDocumentLineType1Code": (1, 4),
    "ExternalFinancialInstitutionIdentification1Code": (1, 4),
    "ExternalGarnishmentType1Code": (1, 4),
    "ExternalLocalInstrument1Code": (1, 35),
    "ExternalMandateSetupReason1Code": (1, 4),
    "ExternalOrganisationIdentification1Code": (1, 4),
    "ExternalPersonIdentification1Code": (1, 4),
    "ExternalProxyAccountType1Code": (1, 4),
    "ExternalPurpose1Code": (1, 4),
    "ExternalServiceLevel1Code": (1, 4),
    "ExternalTaxAmountType1Code": (1, 4),
}
CHARACTER_NAMES = {
    '"': "Double quote", "“": "Smart double quote (left)", "”": "Smart double quote (right)", "‘": "Smart single quote (left)",
    "’": "Smart single quote (right)", "–": "En dash", "—": "Em dash", "…": "Ellipsis", "©": "Copyright symbol",
    "®": "Registered trademark", "™": "Trademark", "°": "Degree symbol", "€": "Euro symbol", "£": "Pound symbol",
    "¥": "Yen symbol", "$": "Dollar symbol", "%": "Percent symbol", "&": "Ampersand", "@": "At symbol", "#": "Hash/pound sign",
    "*": "Asterisk", "~": "Tilde", "`": "Grave accent", "^": "Caret", "_": "Underscore", "=": "Equals sign", "[": "Left square bracket",
    "]": "Right square bracket", "{": "Left curly brace", "}": "Right curly brace", "|": "Pipe/vertical bar", "\\": "Backslash",
    "<": "Less than", ">": "Greater than", ";": "Semicolon", "\t": "Tab character", "\n": "Newline character", "\r": "Carriage return",
}
VALID_CHARACTERS = r"[A-Za-z0-9 /\-?:().,'+]"


def matches(value: Column, pattern: str) -> Column:
    """Whole-value match by a named pattern; unknown names pass."""
    return value.rlike(rf"^(?:{PATTERNS[pattern]})\z") if pattern in PATTERNS else F.lit(True)


def listed(value: Column, enum: str) -> Column:
    """Case-sensitive membership of a named enumeration; unknown names pass."""
    return value.isin(*ENUMS[enum]) if enum in ENUMS else F.lit(True)


def code_length(value: Column, code: str) -> Column:
    low, high = CODE_LENGTHS.get(code, (0, 1 << 30))
    return F.length(value).between(low, high)


def decimal_digits(value: Column, total: int = 18, fraction: int = 5) -> Column:
    """Non-negative decimal text with at most so many digits in all and after the point."""
    digits = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    after = F.length(F.regexp_extract(value, r"\.([0-9]*)\z", 1))
    return F.coalesce(value.rlike(r"^[0-9]+(\.[0-9]*)?\z") & (digits <= total) & (after <= fraction), F.lit(False))


def fed_reference(value: Column, kind: str) -> Column:
    """IMAD and OMAD: date, four characters, six digits; ISN and OSN: sixteen characters. Null if fine, else what is wrong."""
    v = F.upper(F.trim(value))
    if kind in ("FED_ISN", "FED_OSN"):
        return F.when(F.coalesce(v, F.lit("")) == "", "is empty").when(~v.rlike(r"^[A-Z0-9]{16}\z"), "has a wrong format")
    return (
        F.when(F.coalesce(v, F.lit("")) == "", "is empty")
        .when(~v.rlike(r"^[0-9]{8}[0-9A-Z]{4}[0-9]{6}\z"), "has a wrong format")
        .when(F.try_to_timestamp(F.substring(v, 1, 8), F.lit("yyyyMMdd")).isNull(), "has an invalid date")
    )


def has_invalid_characters(value: Column) -> Column:
    """Outside the permitted set, for values in NFC; null and empty are fine."""
    return F.coalesce(~value.rlike(rf"^(?:{VALID_CHARACTERS})*\z"), F.lit(False))


def invalid_characters(value: Column) -> Column:
    """(char, position, description) of each character outside the permitted set, positions from 0, for values in NFC."""
    names = F.create_map(*[F.lit(x) for kv in CHARACTER_NAMES.items() for x in kv])
    chars = F.transform(F.split(value, ""), lambda c, i: F.struct(c.alias("char"), i.alias("position")))
    bad = F.filter(chars, lambda x: (x["char"] != "") & ~x["char"].rlike(rf"^{VALID_CHARACTERS}\z"))
    unknown = lambda c: F.concat(F.lit("Unknown special character (U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(")"))
    named = lambda x: F.struct(x["char"].alias("char"), x["position"].alias("position"), F.coalesce(F.element_at(names, x["char"]), unknown(x["char"])).alias("description"))
    return F.coalesce(F.transform(bad, named), F.array().cast("array<struct<char:string,position:int,description:string>>"))


#: Characters that NFC leaves alone wherever they stand: all below U+0300, and punctuation and currency signs above.
UNCHANGED = r"^[\x00-\u02FF\u2010-\u2027\u2030-\u205E\u20A0-\u20BF]*\z"


def nfc(value: Column) -> Column:
    """Normal form C; a pandas UDF, as there is no built-in. Texts that can't change don't go to Python: it gets nulls for them."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    other = ~value.rlike(UNCHANGED)
    return F.when(other, normal(F.when(other, value))).otherwise(value)


# Words that are never names of paragraphs, and endings that never begin one.
FALSE_NAMES = ["PIC", "VALUE", "SPACES", "ZERO", "ZEROS", "FILLER", "HIGH-VALUES", "LOW-VALUES"]


def false_paragraph(name: Column) -> Column:
    """Numbers, clause words, END- names, and names with two adjacent digits."""
    up, found = F.upper(name), F.lit(False)
    for word in FALSE_NAMES:
        found = found | F.contains(up, F.lit(word))
    return up.rlike(r"^[0-9]+\z") | found | up.startswith("END-") | up.rlike("[0-9][0-9]")


def procedure_name(name: Column) -> Column:
    """3 to 30 characters, a letter first, letters, digits, - and _ only, not excluded."""
    return F.length(name).between(3, 30) & name.rlike(r"^[A-Za-z][A-Za-z0-9_-]*\z") & ~F.upper(name).isin(*FALSE_NAMES)


def allowed_file(name: Column, extensions: tuple[str, ...] = ("txt", "md", "pdf", "docx")) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1)).isin(*extensions)


# Lines that parsers pass over, names that are never procedures, and constants that are no data items.
SKIPPED_LINES = [r"^\s*\*.*", r"^\s*$", r"^\s*//.*", r"^\s*\*>.*"]
EXCLUDED_NAMES = [
    "FILLER", "SPACES", "ZEROS", "LOW-VALUES", "HIGH-VALUES", "FILE-CONTROL", "WORKING-STORAGE", "LINKAGE-SECTION", "FILE-SECTION", "INPUT-OUTPUT",
    "ENVIRONMENT", "DATA", "PROCEDURE", "IDENTIFICATION", "AUTHOR", "DATE-WRITTEN", "GOBACK", "EXIT", "STOP", "CONTINUE", "WS", "LS", "FD", "SD",
]
FIGURATIVE = ["ZERO", "ZEROS", "ZEROES", "SPACE", "SPACES", "HIGH-VALUE", "HIGH-VALUES", "LOW-VALUE", "LOW-VALUES", "NULL", "NULLS"]


def skipped_line(line: Column, patterns: list[str] | None = None) -> Column:
    """Whether a configured pattern (comments and blank lines unless given) matches the trimmed line; null lines are skipped."""
    found = F.lit(False)
    for p in SKIPPED_LINES if patterns is None else patterns:
        found = found | F.trim(line).rlike(rf"^(?:{p})\z")
    return line.isNull() | F.coalesce(found, F.lit(True))


def excluded_name(name: Column, names: list[str] | None = None) -> Column:
    """Null and blank names, configured ones in any case, END- names, names like variables, up to 2 characters, over 25 in capitals."""
    up = F.upper(name)
    listed_name = up.isin(*(EXCLUDED_NAMES if names is None else names)) if names is None or names else F.lit(False)
    shape = up.startswith("END-") | up.rlike("^(WS|LS|FD|SD)[A-Z]") | (F.length(name) <= 2) | ((up == name) & (F.length(name) > 25))
    return F.coalesce((F.trim(name) == "") | listed_name | shape, F.lit(True))


def referenced_item(name: Column) -> Column:
    """A name of a data item: not blank, a number, a quoted literal or a figurative constant, in any case."""
    up = F.upper(F.trim(name))
    return F.coalesce((up != "") & ~up.rlike(r"^[0-9]*\.?[0-9]+\z") & ~up.rlike("^[\"']") & ~up.isin(*FIGURATIVE), F.lit(False))
