import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import checks
from sparkloom.functions import text as fx
from sparkloom.operators import chunking, graphs, learning, lexicons, preprocess, programs as facts, prompts, search, structure, validation
from sparkloom.plans import structure as programs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def sequential_chunks(text, most):
    """The chunker as a loop."""
    lines, starts, out, name = text.split("\n"), [], [], None
    for i, x in enumerate(lines):
        if x.startswith("PROC "):
            k = i
            while k and not lines[k - 1].strip(" \t\r"):
                k -= 1
            starts.append((k, x.split()[1]))
    heads, at, size = dict((k, n) for k, n in starts), 0, 0
    current = []
    for i, x in enumerate(lines):
        if current and (i in heads or size == most):
            out.append((current[0], current[-1], name))
            current, name, size = [], None, 0
        if i in heads:
            name = heads[i]
        current.append(i)
        size += 1
    out.append((current[0], current[-1], name))
    return [(i, a, b, n) for i, (a, b, n) in enumerate((a, b, n) for a, b, n in out if "".join(lines[a : b + 1]).strip())]


def test_chunker_equals_the_loop(spark):
    r = random.Random(1)
    texts = ["\n".join(r.choice(["", "x", "y z", " ", "PROC a", "PROC b"]) for _ in range(r.randint(1, 60))) for _ in range(120)] + ["", "\n\n", "PROC a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = chunking.chunks(docs, F.col("line").startswith("PROC "), 7, name=F.regexp_extract("line", r"^PROC (\w+)", 1)).collect()
    got = {}
    for c in sorted(found, key=lambda c: (c.doc_id, c.chunk_id)):
        got.setdefault(c.doc_id, []).append((c.chunk_id, c.start_line, c.end_line, c["name"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == sequential_chunks(t, 7), repr(t)


SAMPLE = """
! SWIFT validation
PROC VALIDATE_SWIFT_MT103(message);
  INT message;
  CALL CHECK_FORMAT(message);
END;

PROC PROCESS_FEDWIRE_1000(wire);
  CALL GENERATE_IMAD(wire);
END;"""


def test_flow_sample(spark):
    docs = spark.createDataFrame([(1, SAMPLE)], "doc_id long, text string")
    pattern = chunking.PROCEDURES["tal"]
    rows = chunking.chunks(docs, F.col("line").rlike(pattern), 101, name=F.regexp_extract("line", pattern, 1)).orderBy("chunk_id").collect()
    assert [(r["name"], r.start_line) for r in rows] == [(None, 0), ("VALIDATE_SWIFT_MT103", 2), ("PROCESS_FEDWIRE_1000", 6)]
    words = fx.kept_words(fx.words_of(F.col("text")))
    assert "validate_swift_mt103" in one(spark, words, text=SAMPLE)
    assert one(spark, fx.called_functions(F.col("text")), text=SAMPLE) == ["CHECK_FORMAT", "GENERATE_IMAD", "PROCESS_FEDWIRE_1000", "VALIDATE_SWIFT_MT103"]
    assert one(spark, fx.declared_variables(F.col("text")), text=SAMPLE) == ["message"]
    assert one(spark, fx.control_structures(F.col("text")), text=SAMPLE) == ["end", "call"]
    scores = lexicons.network_scores(F.lower("text"), fx.words_of(F.col("text")), fx.tags(F.col("text"), fx.MESSAGE_PATTERNS))
    assert one(spark, lexicons.detected(scores), text=SAMPLE) == ["swift"]


def test_text_functions(spark):
    assert one(spark, fx.camel(F.col("t")), t="WS-CUST-NAME") == "wsCustName"
    assert one(spark, fx.pascal(F.col("t")), t="WS-CUST-NAME") == "WsCustName"
    assert one(spark, fx.display_name(F.col("t")), t="mainlineProcessing") == "mainlineP..."
    assert one(spark, fx.clean_code(F.col("t")), t="a ! note\n! all\n\n// c\nb") == "a\nb"
    assert one(spark, fx.truncated(F.col("t"), 3, ["key"]), t="aaaa\nkey one\nbbbb").startswith("key one")
    assert one(spark, fx.fixed_columns(F.col("t")), t="000100     MOVE A TO B.") == "    MOVE A TO B."
    assert one(spark, fx.fixed_columns(F.col("t")), t="000100* note") is None
    assert one(spark, fx.escaped(F.col("t")), t='a"b\\c\n') == 'a\\"b\\\\c\\n'
    assert one(spark, fx.occurrences(F.col("t"), "aa"), t="aaaa aa") == 3
    rules = F.array(F.struct(F.lit("==OLD==").alias("old"), F.lit("==NEW==").alias("new")))
    assert one(spark, fx.replaced(F.col("t"), rules), t="MOVE OLD TO OLD-X") == "MOVE NEW TO OLD-X"
    assert one(spark, fx.split_statements(F.col("t")), t="01 A PIC X. 05 B PIC 9.\nMOVE A TO B.") == ["01 A PIC X.", "05 B PIC 9.", "MOVE A TO B."]
    assert one(spark, fx.source_areas(F.col("t")), t="000100 01  NAME PIC X.")["area_a"] == "01  "
    assert one(spark, fx.domain_first(F.split("t", " "), ["wire"], 2), t="a wire b") == ["wire", "a"]


def test_checks(spark):
    said = lambda v, kind: one(spark, checks.fed_reference(F.col("v"), kind), v=v)
    assert said("20240229ABCD123456", "FED_IMAD") is None
    assert said("20240230ABCD123456", "FED_IMAD") == "has an invalid date"
    assert said("abcdefgh12345678", "FED_ISN") is None and said("ABC", "FED_OSN") == "has a wrong format" and said(None, "FED_ISN") == "is empty"
    assert [(x["char"], x["position"], x["description"]) for x in one(spark, checks.invalid_characters(F.col("v")), v="A&B_1")] == [("&", 1, "Ampersand"), ("_", 3, "Underscore")]
    assert one(spark, checks.invalid_characters(F.col("v")), v="né")[0]["description"] == "Unknown special character (U+00E9)"
    assert one(spark, checks.invalid_characters(F.col("v")), v="ok (1)/2+3") == [] and one(spark, checks.invalid_characters(F.col("v")), v=None) == []
    assert one(spark, checks.decimal_digits(F.col("v")), v="12.34567") and not one(spark, checks.decimal_digits(F.col("v")), v="1.234567") and not one(spark, checks.decimal_digits(F.col("v")), v="-1")
    assert one(spark, checks.nfc(F.col("v")), v="é") == "é"
    assert one(spark, checks.matches(F.col("v"), "CountryCode"), v="US") and not one(spark, checks.matches(F.col("v"), "CountryCode"), v="US\n")
    assert one(spark, checks.false_paragraph(F.col("v")), v="1000-MAIN") and not one(spark, checks.false_paragraph(F.col("v")), v="MAIN-LOOP")


def test_report(spark):
    rows = spark.createDataFrame([(2, "x"), (3, "y")], "row_index long, v string")
    found = validation.validated(rows, [F.when(F.col("v") == "y", F.lit("V: bad"))], [])
    text = validation.report(found)
    assert "Invalid rows: 1" in text and "Row 3: V: bad" in text and "many rows" not in text


def test_structure(spark):
    lines = programs.lines_of(spark, programs.PROGRAM)
    procs = structure.scored(lines)
    assert {r.paragraph for r in procs.collect()} == {"MAINLINE", "INIT-RUN", "PROCESS-RECORD", "CHECK-LIMIT", "CHECK-EXIT"}
    text = prompts.s_expression(procs, structure.statements(lines))
    back = prompts.parse_s_expression(text)
    assert sorted(map(tuple, back.select("paragraph", "line_no", "type", "content").collect())) == sorted(map(tuple, structure.statements(lines).select("paragraph", "line_no", "type", "content").collect()))
    books = spark.createDataFrame([("PAYREC", "01 REC.\n COPY INNER."), ("INNER", "05 X.\n COPY PAYREC.")], "name string, content string")
    out = structure.expand(lines.where("line_no between 25 and 28"), books).orderBy("path").collect()
    assert [r.line.strip() for r in out] == ["MOVE 0 TO WS-COUNT.", "01 REC.", "05 X.", "* COPY PAYREC.", "* COPY STDPROC OF PAYLIB.", "PROCESS-RECORD."]
    edges = structure.performs(lines)
    depth = {r.name: r.depth for r in graphs.longest_path(edges).collect()}
    assert depth["MAINLINE"] == 0 and depth["PROCESS-RECORD"] == 1 and depth["CHECK-LIMIT"] == 2
    assert "MAINLINE --> INIT-RUN" in graphs.mermaid_graph(edges).first()["text"]
    assert "private Long wsCount;" in prompts.java_fields(structure.data_items(lines)).first()["text"]


def test_graph_merges(spark):
    a = spark.createDataFrame([(1, "MAIN", None, 40), (1, "Old", 3, 50)], "doc_id int, name string, statements int, score int")
    b = spark.createDataFrame([(1, "main", 7, 35), (1, "NEW", 1, 60)], "doc_id int, name string, statements int, score int")
    assert sorted(map(tuple, graphs.merged(a, b).collect())) == [(1, "MAIN", 7, 40), (1, "NEW", 1, 60), (1, "Old", 3, 50)]
    assert graphs.added(a, b).count() == 4 and graphs.added(a, b, any_case=True).count() == 3
    counts = spark.createDataFrame([(1, "WS-MAIN", 3), (1, "ws_main", 5)], "doc_id int, name string, refs long")
    assert graphs.best_variant_count(spark.createDataFrame([(1, "WS_MAIN")], "doc_id int, name string"), counts).first()["refs"] == 5


def test_packing_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, "a", 30, 9), (1, "b", 20, 8), (1, "c", 10, 7), (1, "d", 60, 6)], "doc_id int, name string, n_lines int, importance int")
    assert [(r["name"], r.taken) for r in prompts.packed(rows, 45, 50).orderBy("ord").collect()] == [("a", True), ("b", False), ("c", True), ("d", False)]


def test_image_search(spark):
    rows = spark.createDataFrame([("i", ["b", "c", "d"], 0)], "name string, keywords array<string>, ord int")
    score = lambda m: search.images(rows, ["a", "b"], 100, m).first()["score"]
    assert (score("cosine"), score("jaccard"), score("hamming")) == (0.4082, 0.25, 0.97)
    assert search.images(rows, ["a", "b"], every=True).count() == 0


def test_confusion(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "y double, prediction double")
    assert [tuple(r) for r in learning.confusion(rows).orderBy("label").collect()] == [(0.0, 1.0, 0.5, 0.666667, 2), (1.0, 0.5, 1.0, 0.666667, 1)]


def test_program_facts(spark):
    rows = lambda text: programs.lines_of(spark, text.split("\n"))
    out = preprocess.replace_scopes(rows("MOVE A TO B.\nREPLACE ==A== BY ==C==.\nMOVE A TO AB.\nREPLACE OFF.\nMOVE A TO B.")).orderBy("line_no").collect()
    assert [r.line for r in out] == ["MOVE A TO B.", "MOVE C TO AB.", "MOVE A TO B."]
    code = facts.procedure_code(rows("First.\n  MOVE 1 TO X\n\n  ADD 1 TO X\n\n\n  GONE\nSecond.\n  STOP RUN"), spark.createDataFrame([(1, "first"), (1, "second")], "doc_id long, name string"))
    assert {r["name"]: r.code for r in code.collect()} == {"first": "First.\n  MOVE 1 TO X\n\n  ADD 1 TO X\n", "second": "Second.\n  STOP RUN"}
    expected = spark.createDataFrame([(1, "readFile"), (1, "init"), (1, "done")], "doc_id long, name string")
    found = spark.createDataFrame([(1, "INIT")], "doc_id long, name string")
    lines = rows("* readFile comes here\n* next\n  PERFORM readFile\ninit.\ndone. x")
    assert sorted(map(tuple, facts.recovered(lines, found, expected).collect())) == [(1, "done", 4), (1, "readFile", 2)]
    heads = facts.completed(rows("MOVE A TO B.")).orderBy("place").collect()
    assert [r.line.strip() for r in heads] == ["IDENTIFICATION DIVISION.", "PROGRAM-ID. PROG1.", "PROCEDURE DIVISION.", "MOVE A TO B."]
    tree = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 1, "b"), (1, 2, 2, "c"), (1, 3, 1, "d")], "doc_id int, line_no int, level int, value string")
    assert facts.lisp(tree).first()["text"] == "(a (b (c)) (d))"
    assert one(spark, facts.filled(F.col("t"), {"name": F.lit("x")}), t="call ${name};") == "call x;"
    said = facts.reasoning(F.col("t"), F.lit(True), F.lit(2), F.lit(3), F.array(F.lit("IF"), F.lit("READ")))
    assert one(spark, said, t="MAIN-READ") == "enhanced scoring v2.0, in PROCEDURE DIVISION, business logic naming (+30.0), 2 PERFORM refs, 3 stmts, 2 types, file I/O, control logic, main procedure pattern"
    assert one(spark, facts.hybrid(F.lit(3), F.lit(4)), t="") and not one(spark, facts.hybrid(F.lit(0), F.lit(0)), t="")
    struct = facts.tal_items(rows("STRUCT rec (*);\nBEGIN\n  INT a;\n  STRING b[0:9];\nEND;\nINT c;\nINT a;")).orderBy("line_no").collect()
    assert [(r["name"], r.kind, r.struct) for r in struct] == [("rec", "STRUCT", None), ("a", "MEMBER", "rec"), ("b", "MEMBER", "rec"), ("c", "VAR", None)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["IF", "END-IF", "MOVE", "STATEMENT", "EXEC_SQL", "END-EXEC", "EVALUATE", "END-EVALUATE"]), min_size=1, max_size=12))
def test_blocks_equal_the_loop(kinds):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([("p", i, k) for i, k in enumerate(kinds)], "proc string, line int, type string")
    want, i = [], 0
    closers = {"IF": ("IF_BLOCK", "END-IF"), "EXEC_SQL": ("SQL_BLOCK", "END-EXEC"), "EVALUATE": ("EVALUATE_BLOCK", "END-EVALUATE")}
    while i < len(kinds):
        if kinds[i] in closers:
            name, closer = closers[kinds[i]]
            ends = [j for j in range(i + 1, len(kinds)) if kinds[j] == closer]
            last = ends[0] if ends else len(kinds) - 1
            want.append((name, i, ends[0] if ends else i, last - i + 1))
            i = last
        elif kinds[i] != "STATEMENT":
            want.append((kinds[i], i, i, 1))
        i += 1
    got = [(r.kind, r.start_line, r.end_line, r.n_statements) for r in chunking.blocks(rows).orderBy("block").collect()]
    assert got == want


def test_line_and_name_rules(spark):
    """Skipped lines, excluded names and referenced items, with null, blank and configured values."""
    rows = spark.createDataFrame([(0, None), (1, "  "), (2, "* x"), (3, "END-IF"), (4, "WSTOTAL"), (5, "calc-pay"), (6, "12.5"), (7, "Zero"), (8, "A" * 26), (9, "'x'")], "i int, v string")
    flags = lambda c: {r.i for r in rows.where(c).collect()}
    v = F.col("v")
    assert flags(checks.skipped_line(v)) == {0, 1, 2}
    assert flags(checks.skipped_line(v, ["END-.*"])) == {0, 3} and flags(checks.skipped_line(v, [])) == {0}
    assert flags(checks.excluded_name(v)) == {0, 1, 3, 4, 8}
    assert flags(checks.excluded_name(v, ["CALC-PAY"])) == {0, 1, 3, 4, 5, 8} and flags(checks.excluded_name(v, [])) == {0, 1, 3, 4, 8}
    assert flags(checks.referenced_item(v)) == {2, 3, 4, 5, 8}


def test_counts_roles_and_procedures(spark):
    rows = spark.createDataFrame([(1, "IF"), (1, "ADD"), (1, "ADD"), (2, "MOVE"), (2, "IF")], "doc_id int, type string")
    assert {tuple(r) for r in structure.dominant_types(structure.type_counts(rows, "doc_id"), "doc_id").collect()} == {(1, "ADD", 2, 3), (2, "IF", 1, 2)}
    assert {tuple(r) for r in structure.type_counts(rows).collect()} == {("IF", 2), ("ADD", 2), ("MOVE", 1)}
    points = spark.createDataFrame([("red",), ("blue",), (None,)], "color string")
    assert [r.group for r in graphs.with_role(points, {"red": "Bank"}).collect()] == ["Bank", "Unknown", "Unknown"]
    assert [r.group for r in graphs.with_role(points, {}).collect()] == ["Unknown"] * 3
    text = ['(ANALYSIS "x" (SCORE 9)', '(PROCEDURE "A"', "(SCORE 70.5)", "(START-LINE 3) (END-LINE 8)", '(PROCEDURE "B" (SCORE 4) (START-LINE 9)', "))"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id int, line_no int, line string")
    assert [tuple(r) for r in prompts.parse_procedures(lines).orderBy("start_line").collect()] == [(1, "A", 70.5, 3, 8), (1, "B", 4.0, 9, None)]
