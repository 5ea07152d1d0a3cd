"""Column functions over source and document text. All are JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONTROL_KEYWORDS = ["if", "while", "for", "case", "switch", "begin", "end", "call", "return"]
MESSAGE_PATTERNS = {
    "pacs008": r"pacs\.?008|customer.credit.transfer",
    "pacs009": r"pacs\.?009|financial.institution.credit",
    "mt103": r"mt\.?103|single.customer.credit",
    "mt202": r"mt\.?202|financial.institution.transfer",
    "fedwire_1000": r"type.?code.?1000|customer.transfer",
    "fedwire_1200": r"type.?code.?1200|bank.transfer",
}
TRANSACTION_PATTERNS = {
    "customer_transfer": r"customer.transfer|originator.*beneficiary",
    "validation": r"validat|verify|check.*format",
    "error_handling": r"error|exception|reject|repair",
    "screening": r"ofac|sanctions|aml|compliance",
}
PRIORITY_WORDS = ["proc", "validate", "process", "if", "call", "return", "error", "transfer", "swift", "fedwire", "screen", "ofac"]
LOGIC_GROUPS = [
    ("Data Movement", ["MOVE"]),
    ("Arithmetic Operations", ["ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE"]),
    ("Conditional Logic", ["IF"]),
    ("Loop/Iteration", ["PERFORM"]),
    ("File I/O", ["READ", "WRITE", "OPEN", "CLOSE"]),
    ("Output", ["DISPLAY"]),
    ("Input", ["ACCEPT"]),
    ("Subprogram Call", ["CALL"]),
]
BLOCK_COLOURS = {"IF_BLOCK": "#FFB74D", "SQL_BLOCK": "#64B5F6", "EVALUATE_BLOCK": "#BA68C8", "PERFORM": "#81C784", "MOVE": "#E0E0E0"}


def any_of(text: Column, parts: Sequence[str]) -> Column:
    """Whether the text contains any of the literal parts."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def words_of(text: Column) -> Column:
    """Identifiers of the lower-cased text, in order: runs of letters, digits and _ that are plain ASCII names."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike(r"^[a-z_][a-z0-9_]*\z"))


def kept_words(words: Column, stop: Sequence[str] = (), least: int = 3) -> Column:
    """Words that aren't stop words, short, or digits only."""
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.rlike(r"^[0-9]+\z") & (~w.isin(*stop) if stop else F.lit(True)))


def query_words(words: Column, always: Sequence[str], stop: Sequence[str], least: int = 3) -> Column:
    """Query-side filter: listed domain words stay whatever else holds; then stop words and length."""
    keep = F.array(*map(F.lit, always)) if always else F.array().cast("array<string>")
    drop = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: F.array_contains(keep, w) | (~F.array_contains(drop, w) & (F.length(w) >= least)))


def domain_first(words: Column, domain: Sequence[str], most: int, front: int = 15) -> Column:
    """At most `front` domain words, then others, up to `most`, each part in its order."""
    listed = F.array(*map(F.lit, domain))
    return F.slice(
        F.concat(F.slice(F.filter(words, lambda w: F.array_contains(listed, w)), 1, front), F.filter(words, lambda w: ~F.array_contains(listed, w))), 1, most
    )


def called_functions(text: Column) -> Column:
    """Distinct names directly before an opening parenthesis, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1))))


def declared_variables(text: Column) -> Column:
    """Distinct names after INT, STRING or CHAR in any case, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:INT|STRING|CHAR)\s+([a-z_][a-z0-9_]*)"), F.lit(1))))


def control_structures(text: Column) -> Column:
    """Which control keywords occur as words, in the fixed order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b{k}\b"), F.lit(k)) for k in CONTROL_KEYWORDS]))


def tags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found in the lower-cased text, in the order given; . does not cross a newline."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def clean_code(text: Column, least: int = 0) -> Column:
    """Code without blank lines, comment lines (! and //) and ! comments; lines stripped shorter than `least` go."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("!") & ~F.trim(x).startswith("//") & (F.length(F.trim(x)) >= least))
    return F.array_join(F.transform(lines, lambda x: F.rtrim(F.regexp_replace(x, "!.*$", ""))), "\n")


def reusable_code(text: Column) -> Column:
    """clean_code of lines longer than three characters."""
    return clean_code(text, 4)


def truncated(text: Column, tokens: int = 500, priority: Sequence[str] = PRIORITY_WORDS, marker: str = "... (truncated)") -> Column:
    """Lines within a budget of 4 characters a token: first those with a priority word, then others; each list stops at
    the first line that does not fit. A line costs its length and one. The marker is added when anything was left out."""
    limit = F.lit(4 * tokens)
    lines = F.split(text, "\n")
    wanted = lambda x: any_of(F.lower(x), priority)

    def taken(state, x):
        cost = F.length(x) + 1
        fits = ~state["full"] & (state["used"] + cost <= limit)
        return F.struct(
            F.when(fits, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"),
            F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
            (state["full"] | ~fits).alias("full"),
        )

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    again = lambda s: F.struct(s["kept"].alias("kept"), s["used"].alias("used"), F.lit(False).alias("full"))
    first = F.aggregate(F.filter(lines, wanted), start, taken, again)
    both = F.aggregate(F.filter(lines, lambda x: ~wanted(x)), first, taken)
    joined = F.array_join(both["kept"], "\n")
    return F.when(F.length(text) + 1 <= limit, text).otherwise(F.when(F.length(joined) < F.length(text), F.concat(joined, F.lit("\n" + marker))).otherwise(joined))


def explained(procedure: Column, calls: Column, controls: Column, category: Column) -> Column:
    """A sentence for each thing known about a chunk."""
    return F.concat_ws(
        ". ",
        F.when(procedure != "", F.concat(F.lit("Procedure "), procedure)),
        F.when(F.size(calls) > 0, F.concat(F.lit("Calls "), F.array_join(F.slice(calls, 1, 3), ", "))),
        F.when(F.size(controls) > 0, F.concat(F.lit("Uses "), F.array_join(controls, ", "))),
        F.concat(F.lit("Category "), F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))),
    )


def fixed_columns(line: Column) -> Column:
    """Columns 8 to 72 of a fixed-format line; null for comments (* in column 7) and lines under seven characters."""
    return F.when((F.length(line) >= 7) & (F.substring(line, 7, 1) != "*"), F.substring(line, 8, 65))


def source_areas(line: Column, layout: str = "fixed") -> Column:
    """Sequence, indicator, area A, area B and comment area of a line; layouts fixed, variable and tandem."""
    widths = {"fixed": r"^(.{0,6})(.?)(.{0,4})(.{0,61})(.*)$", "variable": r"^(.{0,6})(.?)(.{0,4})(.*)()$", "tandem": r"^()(.?)(.{0,4})(.*)()$"}[layout]
    part = lambda i: F.regexp_extract(line, widths, i)
    return F.struct(part(1).alias("sequence"), part(2).alias("indicator"), part(3).alias("area_a"), part(4).alias("area_b"), part(5).alias("comment"))


def split_statements(text: Column) -> Column:
    """Lines of merged source: a level number or verb that follows a period begins a new one."""
    return F.filter(
        F.transform(F.split(text, r"(?<=\.)\s*(?=(?:0[1-9]|[1-4][0-9]|77|88)\s|[A-Z][A-Z0-9-]*\s)|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""
    )


def parts_of(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[-_ ]+"), lambda p: p != "")


def pascal(name: Column) -> Column:
    """COBOL-NAME to CobolName."""
    return F.array_join(F.transform(parts_of(name), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def camel(name: Column) -> Column:
    """COBOL-NAME to cobolName."""
    return F.array_join(F.transform(parts_of(name), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def escaped(text: Column) -> Column:
    """Backslashes, quotes and line breaks as escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def shortened(text: Column, most: int) -> Column:
    """Cut to `most` characters, the last three of them dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def identifier(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "")


def picture_clauses(line: Column) -> Column:
    """Level, name and PICTURE, VALUE, OCCURS, REDEFINES and USAGE clauses of a data item."""
    up = F.trim(line)
    part = lambda p: F.nullif(F.regexp_extract(up, p, 1), F.lit(""))
    return F.struct(
        part(r"^(\d{1,2})\s").cast("int").alias("level"),
        part(r"^\d{1,2}\s+([A-Za-z0-9-]+)").alias("name"),
        F.regexp_replace(part(r"(?i)\sPIC(?:TURE)?\s+(?:IS\s+)?(\S+)"), r"\.\z", "").alias("picture"),
        F.regexp_replace(part(r"(?i)\sVALUE\s+(?:IS\s+)?('[^']*'|\"[^\"]*\"|\S+)"), r"\.\z", "").alias("value"),
        part(r"(?i)\sOCCURS\s+(\d+)").cast("int").alias("occurs"),
        F.regexp_replace(part(r"(?i)\sREDEFINES\s+([A-Za-z0-9-]+)"), r"\.\z", "").alias("redefines"),
        F.upper(part(r"(?i)\s(?:USAGE\s+(?:IS\s+)?)?(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|DISPLAY|PACKED-DECIMAL|INDEX|POINTER)\b")).alias("usage"),
    )


def picture_type(picture: Column) -> Column:
    """ALPHANUMERIC, NUMERIC_DECIMAL, NUMERIC_INTEGER, ALPHABETIC or UNKNOWN."""
    up = F.upper(picture)
    return (
        F.when(F.contains(up, F.lit("X")), "ALPHANUMERIC")
        .when(F.contains(up, F.lit("9")) & F.contains(up, F.lit("V")), "NUMERIC_DECIMAL")
        .when(F.contains(up, F.lit("9")), "NUMERIC_INTEGER")
        .when(F.contains(up, F.lit("A")), "ALPHABETIC")
        .otherwise("UNKNOWN")
    )


def replaced(text: Column, rules: Column) -> Column:
    """Applies (old, new) rules in order: whole words, any case; ==x== pseudo-text is its inside."""
    bare = lambda x: F.regexp_replace(x, r"^==|==$", "")
    return F.aggregate(rules, text, lambda s, r: F.regexp_replace(s, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9-])\Q"), bare(r["old"]), F.lit(r"\E(?![A-Za-z0-9-])")), bare(r["new"])))


def logic_summary(code: Column) -> Column:
    up = F.upper(code)
    said = F.concat_ws(", ", *[F.when(any_of(up, verbs), F.lit(label)) for label, verbs in LOGIC_GROUPS])
    return F.when(said == "", "General Processing").otherwise(said)


def key_lines(code: Column, most: int = 10) -> Column:
    """The first lines with business verbs: no comments, MOVE only without SPACES."""
    up = lambda x: F.upper(F.trim(x))
    verbs = ["IF ", "COMPUTE", "PERFORM", "EVALUATE", "CALL", "READ", "WRITE", "ADD ", "SUBTRACT"]
    good = lambda x: ~up(x).startswith("*") & (any_of(up(x), verbs) | (F.contains(up(x), F.lit("MOVE")) & ~F.contains(up(x), F.lit("SPACES"))))
    return F.slice(F.filter(F.split(code, "\n"), good), 1, most)


def architecture_label(name: Column, code: Column) -> Column:
    n, c = F.lower(name), F.lower(code)
    has = lambda col, *p: any_of(col, p)
    return (
        F.when(has(n, "valid") | (has(c, "if ") & has(c, "set ")), "VALIDATION")
        .when(has(n, "read", "file") | has(c, "read "), "FILE_PROCESSING")
        .when(has(c, "exec sql", "select "), "DATABASE_ACCESS")
        .when(has(n, "process") & has(c, "move ", "initialize"), "DATA_TRANSFORMATION")
        .when(has(n, "init", "open"), "INITIALIZATION")
        .when(has(n, "term", "close"), "CLEANUP")
        .otherwise("BUSINESS_LOGIC")
    )


def secondary_labels(code: Column) -> Column:
    c = F.lower(code)
    return F.array_compact(F.array(F.when(any_of(c, ["if ", "evaluate"]), F.lit("ERROR_HANDLING")), F.when(F.contains(c, F.lit("perform ")), F.lit("ORCHESTRATION"))))


def display_name(name: Column) -> Column:
    """Names over twelve characters as their first nine and dots."""
    return F.when(F.length(name) > 12, F.concat(F.substring(name, 1, 9), F.lit("..."))).otherwise(name)


def block_colour(kind: Column) -> Column:
    out = F.lit("#CFD8DC")
    for k, v in BLOCK_COLOURS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def in_context(doc: Column, keywords: Column, summary: Column, content: Column) -> Column:
    """The text that is embedded for a chunk."""
    return F.format_string("Document: %s\nKeywords: %s\nSummary: %s\nContent: %s", doc, F.array_join(keywords, ", "), summary, content)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")
