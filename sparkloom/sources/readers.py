"""Sources: source trees, documents, metadata, vocabularies, record files, stored corpora, rules and settings."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog

# Fixed values.
SOURCE_EXTENSIONS = ["tal", "TAL", "c", "h", "cpp", "hpp"]
COPYBOOK_EXTENSIONS = ["cbl", "cpy", "CBL", "CPY"]
DOCUMENT_EXTENSIONS = ["txt", "md"]
VERSION_KEY = "corpus_version"


def source_files(spark: SparkSession, path: str, extensions: Sequence[str] = SOURCE_EXTENSIONS) -> DataFrame:
    """source_file, content, hash, size, modified of the files below a folder; bytes that aren't UTF-8 are dropped, blank files too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    rows = found.select(F.col("path").alias("source_file"), text.alias("text"), F.md5("content").alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.withColumnRenamed("text", "content").where(F.trim(F.regexp_replace("content", r"\s", "")) != "")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_name, text (stripped), hash, size, modified of text files; word_documents() reads .docx, other formats need a converter and are not read."""
    rows = source_files(spark, path, DOCUMENT_EXTENSIONS)
    strip = F.regexp_replace("content", r"^\s+|\s+$", "")
    return rows.select(F.regexp_extract("source_file", r"([^/]+)\z", 1).alias("doc_name"), strip.alias("text"), "hash", "size", "modified")


def word_documents(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """doc_name, text, hash, size, modified, problem of the .docx files below a folder: paragraphs of the body with text, a line each; not those of tables.

    The member with the text is read as a stream of XML events, and every paragraph is dropped once read, so memory follows the file's
    own size, not the tree's. Files that are no such documents, or whose text has more than most_bytes, have an empty text and say why."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)
    rows = found.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("doc_name"), "content", F.md5("content").alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    read = F.udf(lambda data: _word_text(data, most_bytes), "text string, problem string")
    return rows.withColumn("read", read("content")).select("doc_name", "read.text", "hash", "size", "modified", "read.problem")


def _word_text(data: bytes, most_bytes: int) -> tuple[str, str | None]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n", f"{space}noBreakHyphen": "-"}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            member = archive.getinfo("word/document.xml")
            if member.file_size > most_bytes:
                return "", f"{member.file_size} bytes of text"
            paragraphs, now, path = [], [], []
            with archive.open(member) as stream:
                for event, element in ElementTree.iterparse(stream, ("start", "end")):
                    if event == "start":
                        path.append(element.tag)
                        continue
                    path.pop()
                    in_body = path[:3] == [f"{space}document", f"{space}body", f"{space}p"]
                    if in_body and element.tag == f"{space}t":
                        now.append(element.text or "")
                    elif in_body and element.tag in marks:
                        now.append(marks[element.tag])
                    elif element.tag == f"{space}p" and path == [f"{space}document", f"{space}body"]:
                        if (text := "".join(now)).strip():
                            paragraphs.append(text)
                        now = []
                    if not in_body:
                        element.clear()
            return "\n".join(paragraphs), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError) as e:
        return "", f"{type(e).__name__}: {e}"


def copybooks(spark: SparkSession, path: str) -> DataFrame:
    """name (without extension), content."""
    return source_files(spark, path, COPYBOOK_EXTENSIONS).select(F.regexp_extract("source_file", r"([^/]+)\.[^./]+\z", 1).alias("name"), "content")


def lines(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    return rows.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "line"))


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows with name, full_path and keywords (a list or a comma-separated text); other fields have defaults."""
    raw = spark.read.schema("name string, full_path string, keywords string, file_type string, date_created string, author string").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    rows = raw.where("name is not null and full_path is not null and keywords is not null")
    as_list = F.from_json("keywords", "array<string>")
    listed = F.when(F.col("keywords").startswith("["), as_list).otherwise(F.split("keywords", ","))
    rows = rows.withColumn("keywords", F.filter(F.transform(listed, lambda w: F.lower(F.trim(w))), lambda w: w != ""))
    return catalog.with_defaults(rows, {"file_type": "image/png", "date_created": "Unknown", "author": "Unknown"})


def harvested_keywords(rows: DataFrame) -> DataFrame:
    """keyword: distinct, sorted."""
    return rows.select(F.explode("keywords").alias("keyword")).distinct().orderBy("keyword")


def keyword_vocabulary(spark: SparkSession, path: str, size: int = 100) -> list[str]:
    """Distinct words of a vocabulary file, cut or padded with keyword1, keyword2 ... to `size` words."""
    words = spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("w")).where("w <> ''").distinct().orderBy("w").limit(size)
    held = [r.w for r in words.collect()]
    return held + [f"keyword{i}" for i in range(1, size - len(held) + 1)]


def record_file(spark: SparkSession, path: str, row_index: str = "row_index") -> DataFrame:
    """A CSV file with a header, all columns as text; row_index is the line in the file, the header being 1."""
    rows = spark.read.option("header", "true").option("inferSchema", "false").option("mode", "PERMISSIVE").csv(path)
    # Files are read in partitions of increasing ids; offsets of partitions come from their counts, so no global sort.
    held = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = held.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("before"))  # a row a partition
    place = F.col("before") + F.col("__id") - F.shiftleft(F.col("__part"), 33) + 2
    return held.join(offsets, "__part").withColumn(row_index, place.cast("long")).drop("__id", "__part", "before")


def corpus(spark: SparkSession, path: str, defaults: dict[str, object] | None = None, version: str | None = None) -> DataFrame:
    """A stored corpus; columns of older versions that are missing get defaults. version: warns of others that are stored, by a scan of that one column."""
    rows = spark.read.parquet(path)
    if version is not None:
        held = rows.select(VERSION_KEY).distinct() if VERSION_KEY in rows.columns else rows.limit(1).select(F.lit("none").alias(VERSION_KEY))
        for (other,) in held.where(~F.col(VERSION_KEY).eqNullSafe(version)).limit(10).collect():
            warnings.warn(f"{path} has rows of version {other}, not {version}", stacklevel=2)
    return catalog.with_defaults(rows, defaults or {})


def corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of stored corpora by name; a path that can't be read is left out."""
    from pyspark.errors import AnalysisException

    found = {}
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException:
            continue
    return catalog.corpora(found)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Transformation rules of a JSON file: rule, ord, override, labels, name_patterns, code_patterns, return_type, guidance."""
    schema = "transformationRules array<struct<name:string,description:string,overrideMode:boolean,cobolPatterns:array<string>,procedureNamePatterns:array<string>,architecturalPatterns:array<string>,targetJavaPatterns:array<string>,targetReturnType:string,implementationGuidance:string,codeExamples:map<string,string>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("transformationRules").alias("ord", "r"))
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("r.name").alias("rule"), "ord", F.coalesce("r.overrideMode", F.lit(False)).alias("override"), F.coalesce("r.architecturalPatterns", empty).alias("labels"),
        F.coalesce("r.procedureNamePatterns", empty).alias("name_patterns"), F.coalesce("r.cobolPatterns", empty).alias("code_patterns"), F.col("r.targetReturnType").alias("return_type"),
        F.col("r.implementationGuidance").alias("guidance"), F.col("r.codeExamples").alias("examples"),
    )


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value settings; comments and blank lines are skipped. A settings file, read to the driver."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & F.contains("value", F.lit("="))).collect()
    return {k.strip(): v.strip() for k, _, v in (r.value.partition("=") for r in rows)}


def tree_dump(rows: DataFrame) -> DataFrame:
    """Nodes of an indented RULE/TERMINAL dump (doc_id, line_no, line): level by two blanks of indent, kind, value."""
    indent = F.length(F.regexp_extract("line", r"^( *)", 1))
    return rows.where(F.trim("line") != "").select(
        "doc_id", "line_no", F.floor(indent / 2).cast("int").alias("level"), F.regexp_extract("line", r"^\s*(RULE|TERMINAL)", 1).alias("kind"), F.trim(F.regexp_extract("line", r"^\s*(?:RULE|TERMINAL):?\s*(.*)$", 1)).alias("value")
    )
