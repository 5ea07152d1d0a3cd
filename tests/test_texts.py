"""Stems, phrases in texts and word-processor files on known cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stems
from sparkloom.operators import lexicons, weights
from sparkloom.sources import readers

# From the published description of the algorithm, ending by ending.
KNOWN = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil at at payments payment été été a1b a1b""".split()


def test_stems_of_the_published_examples():
    assert {w: stems.stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))


def test_stems_of_counts(spark):
    counts = spark.createDataFrame([(1, "motoring", 2), (1, "motors", 3), (1, None, 1), (2, "motor", 1)], "doc_id int, term string, n int")
    assert sorted((tuple(r) for r in weights.stemmed(counts).collect()), key=repr) == [(1, "motor", 5), (1, None, 1), (2, "motor", 1)]


def test_phrases_leftmost_longest(spark):
    texts = spark.createDataFrame([(1, "Pay the federal Reserve, bank: federal reserve"), (2, None), (3, "reserve bank federal"), (4, "")], "id int, text string")
    known = spark.createDataFrame([("federal reserve", "body"), ("Reserve Bank", "body"), ("federal reserve bank of", "body"), ("pay", "verb"), ("the federal", "x"), (" ", "none")], "phrase string, kind string")
    found = lexicons.entities(texts, known, ["id"]).orderBy("id", "place").collect()
    assert [tuple(r) for r in found] == [(1, 0, "pay", "verb"), (1, 1, "the federal", "x"), (1, 3, "Reserve Bank", "body"), (1, 5, "federal reserve", "body"), (3, 0, "Reserve Bank", "body")]


def test_message_entities(spark):
    df = spark.createDataFrame([("an mt202cov with Pacs009 and type code",), ("MT199 or MT103",), ("none",), (None,)], "q string")
    got = [tuple(r.e) for r in df.select(lexicons.message_entities(F.col("q")).alias("e")).collect()]
    assert got == [("MT202COV", "PACS.009", "TYPE_CODE"), ("MT199", None, None), (None, None, None), (None, None, None)]


@pytest.fixture
def folder(tmp_path):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def save(name, body, member="word/document.xml"):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(member, f'<?xml version="1.0"?><w:document {space}><w:body>{body}</w:body></w:document>')
        (tmp_path / name).write_bytes(held.getvalue())

    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    save("a.docx", f"<w:p>{run('One &amp; ')}{run('two')}<w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p><w:p/><w:p>{run('  ')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl><w:p>{run('é')}</w:p>")
    save("b.DOCX", "", "word/other.xml")
    save("long.docx", f"<w:p>{run('z' * 5000)}</w:p>")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_text("text")
    return str(tmp_path)


def test_word_documents(spark, folder):
    rows = {r.doc_name: (r.text, r.problem) for r in readers.word_documents(spark, folder, most_bytes=4000).collect()}
    assert rows.pop("a.docx") == ("One & two\tx\ny\né", None)
    assert set(rows) == {"b.DOCX", "c.docx", "long.docx"} and all(t == "" and p for t, p in rows.values())
    assert {r.doc_name: len(r.text) for r in readers.word_documents(spark, folder).collect()}["long.docx"] == 5000
