"""The preprocessor on sources with known results."""

import pytest

from sparkloom.operators import preprocess

BOOKS = [("BOOK1", "01 :P:-REC.\n\n  02 :P:-NAME PIC X(8)."), ("SQLCA", "01 SQLCA.\n  05 SQLCODE PIC S9(9).")]


@pytest.fixture(scope="module")
def run(spark):
    books = spark.createDataFrame(BOOKS, "name string, content string")

    def run(*programs):
        rows = [(d, i, line) for d, p in enumerate(programs) for i, line in enumerate(p)]
        lines = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
        return sorted((r.doc_id, r.line_no, r.kind, r.text) for r in preprocess.preprocessed(lines, books).collect())

    return run


def texts(rows, doc=0):
    return [(n, t) for d, n, _, t in rows if d == doc]


def test_exec_blocks_are_one_line(run):
    rows = run(
        ["    EXEC SQL SELECT A,", "      B INTO :C", "      FROM T WHERE D = 'END-EXEC' END-EXEC. MOVE A TO B.", "EXEC CICS", " LINK PROGRAM('P') END-EXEC", "exec sqlims GU end-exec"],
        ["EXEC SQL INCLUDE SQLCA END-EXEC", "EXEC SQL INCLUDE NOBOOK END-EXEC", "EXEC SQL NEVER", "ENDS. REPLACE ==A== BY ==B=="],
    )
    assert rows == [
        (0, 0, "EXEC_SQL", "EXEC SQL SELECT A, B INTO : C FROM T WHERE D = 'END-EXEC' END-EXEC"),
        (0, 2, "CODE", ". MOVE A TO B."),
        (0, 3, "EXEC_CICS", "EXEC CICS LINK PROGRAM( 'P') END-EXEC"),
        (0, 5, "EXEC_SQLIMS", "exec sqlims GU end-exec"),
        (1, 0, "EXEC_SQL", "01 SQLCA.\n  05 SQLCODE PIC S9(9)."),
        (1, 1, "EXEC_SQL", "EXEC SQL INCLUDE NOBOOK END-EXEC"),
        (1, 2, "EXEC_SQL", "EXEC SQL NEVER ENDS. REPLACE == A == BY == B =="),
    ]


def test_directives_options_and_comment_entries(run):
    rows = run(
        ["CBL LIST, MAP(X)", "    EJECT", "    SKIP2.", "    TITLE 'A. B'.", " IDENTIFICATION DIVISION.", " PROGRAM-ID. P.", " AUTHOR. SOME ONE.", "        OF A FIRM.", "", "        MORE.", " DATE-WRITTEN.", "        MONDAY.",
         " ENVIRONMENT DIVISION.", "*>CE A MARK", "", "* A COMMENT", "", "    MOVE TITLE TO A.", "", "    CONTINUE."],
    )
    assert [(k, t) for _, _, k, t in rows] == [
        ("OPTIONS", "CBL LIST, MAP( X)"), ("CODE", "IDENTIFICATION DIVISION."), ("CODE", "PROGRAM-ID. P."), ("CODE", "AUTHOR."), ("CODE", "DATE-WRITTEN."),
        ("CODE", "ENVIRONMENT DIVISION."), ("CODE", "MOVE TITLE TO A."), ("CODE", "CONTINUE."),
    ]


def test_replace_scopes_nest(run):
    rows = run(
        ["MOVE A TO B.", "REPLACE ==A== BY ==X==.", "MOVE A TO B.", "REPLACE ==B== BY ==Y== ==X== BY ==Z==.", "MOVE A TO B.", "REPLACE OFF.", "MOVE A TO B.", "REPLACE OFF.", "MOVE A TO B.", "REPLACE OFF.", "REPLACE B BY C.", "MOVE b TO B-1 'B'."],
    )
    assert texts(rows) == [(0, "MOVE A TO B."), (2, "MOVE X TO B."), (4, "MOVE Z TO Y."), (6, "MOVE X TO B."), (8, "MOVE A TO B."), (11, "MOVE C TO B-1 'B'.")]


def test_replace_matches_tokens_over_lines(run):
    rows = run(
        ["REPLACE ==MOVE", "   A== BY", "  ==ADD $1 \\ 2", "  TO A== . MOVE A TO B.", "IF A-1 > MOVE", "  A THEN AA.", "REPLACE ==(1)== BY ====.", "C(1) D( 1 ) E."],
        ["MOVE A TO B."],
    )
    assert texts(rows) == [(3, "ADD $ 1 \\ 2 TO A TO B."), (4, "IF A-1 > ADD $ 1 \\ 2 TO A THEN AA."), (7, "C D E.")]
    assert texts(rows, 1) == [(0, "MOVE A TO B.")]


def test_copy_with_replacing_over_lines(run):
    rows = run(["COPY BOOK1", "  REPLACING ==:P:== BY ==CUST==", "   NAME BY TITLE.", "COPY 'nobook'.", "01 X. COPY BOOK1. 02 Y."])
    assert rows == [
        (0, 0, "COPY", "01 CUST-REC.\n02 CUST-TITLE PIC X(8)."),
        (0, 3, "COPY", "* COPY NOBOOK content not found."),
        (0, 4, "CODE", "01 X. 02 Y."),
        (0, 4, "COPY", "01 :P:-REC.\n02 :P:-NAME PIC X(8)."),
    ]


def test_nothing(run, spark):
    assert run([None, "", "* only"], []) == []
    empty = spark.createDataFrame([], "doc_id int, line_no int, line string")
    assert preprocess.preprocessed(empty, spark.createDataFrame(BOOKS, "name string, content string")).collect() == []


def reading(program):
    """The code of a program read token by token with a stack, with rules of single tokens."""
    import re

    toks = [(n, t) for n, line in enumerate(program) for t in re.findall(preprocess.TOKEN, line)]
    stack, out, i = [], {}, 0
    while i < len(toks):
        n, t = toks[i]
        if t == "REPLACE":
            end = next(k for k in range(i, len(toks)) if toks[k][1] == ".")
            said = [x for _, x in toks[i + 1 : end] if x not in ("==", "BY")]
            stack = stack[:-1] if said == ["OFF"] else [*stack, list(zip(said[::2], said[1::2], strict=True))]
            i = end + 1
            continue
        for rules in stack:
            for old, new in rules:
                t = new if t.upper() == old.upper() else t
        out.setdefault(n, []).append(t)
        i += 1
    return [(n, re.sub(r" ([.,()])", r"\1", " ".join(x))) for n, x in sorted(out.items())]


@pytest.mark.parametrize("seed", range(3))
def test_equals_reading_token_by_token(run, seed):
    import random

    r = random.Random(seed)
    letters = "ABCDE"
    programs = []
    for _ in range(12):
        lines = []
        for _ in range(r.randrange(25)):
            pairs = " ".join(f"=={r.choice(letters)}== BY =={r.choice(letters)}==" for _ in range(r.choice([1, 1, 3])))
            lines.append(r.choice([f"REPLACE {pairs}.", "REPLACE OFF.", "MOVE A TO b.", "C D.", "e"]))
        programs.append([x if not x.startswith("REPLACE") or not lines[k - 1 : k] or lines[k - 1].endswith(".") else "C." for k, x in enumerate(lines)])
    rows = run(*programs)
    for d, program in enumerate(programs):
        assert texts(rows, d) == reading(program)
