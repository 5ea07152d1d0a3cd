"""WARC archives as chunked record tables.

Writing: a payload becomes one WARC/1.1 record, or, above the segment size, a segmented record (WARC-Segment-Number,
continuation records), so that no row and no record block is longer than a segment. Spark's own text writer puts the
rows down, with the record terminator as its line separator; archives therefore go to any file system Spark has.
Files are gzip, which keeps a record and its segments in one reader, in order.

Reading: Spark's text reader cuts a file at every CRLF CRLF, and a small state machine joins the pieces again by
Content-Length. It emits rows of record identifier and chunk number, each with the SHA-1 of the payload up to there,
and holds one segment at most.

Of records with equal payloads (by SHA-1 and length) of at least `least` bytes, the one with the smallest id is the
response and the others are revisits, which carry headers only. Defined cases: a null payload is empty; rows that
repeat the smallest id are responses each; a null id counts as larger than any other, and a group of nothing but
null ids is all responses; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameter: bytes of a segment.
SEGMENT = 1 << 20
#: Groups of equal payloads, about 100 bytes each, up to which they are broadcast.
FEW_GROUPS = 200_000
END = "\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END.encode() + block


def records(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one payload, without their terminators."""
    uri = " ".join((url or "").split())
    name = f"<urn:page:{'' if row_id is None else row_id}>"
    digest = base32_sha1(hashlib.sha1(payload).digest())
    shared = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("Content-Type", "text/html; charset=utf-8")]
    if revisit:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *shared, *more, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))], b"")
        return
    count = max(1, -(-len(payload) // segment))
    for k in range(count):
        block = payload[k * segment : (k + 1) * segment]
        head = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", f"{name[:-1]}#{k}>" if k else name), *shared]
        if count > 1:
            head += [("WARC-Segment-Number", k + 1), *([("WARC-Segment-Origin-ID", name)] if k else [])]
            head += [("WARC-Segment-Total-Length", len(payload))] if k == count - 1 else []
        if not k:
            head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
        yield _record([*head, ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}")], block)


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """pages: id, url, payload (binary). Writes them to *.gz files in the folder."""
    common.ship(pages.sparkSession)
    keyed = pages.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    keyed = keyed.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    # Only digests, sizes and ids are shuffled to find the groups of two or more. They are broadcast where they are few,
    # by their count; beyond that the join shuffles, skewed where one payload is frequent, which Spark splits.
    groups = keyed.select("id", "digest", "size").groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = common.stored(groups.where((F.col("n") > 1) & (F.col("size") >= least)).select("digest", "size", "first"), "groups")
    few = groups.count() <= FEW_GROUPS
    keyed = keyed.join(F.broadcast(groups) if few else groups, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    schema = T.StructType([T.StructField("value", T.BinaryType())])
    kinds = common.arrow_schema(schema)

    def run(batches):
        def batch_of(made):
            return pa.RecordBatch.from_arrays([pa.array(made, kinds.field(0).type)], schema=kinds)

        for batch in batches:
            made, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for one in records(*row, segment):
                    made.append(one)
                    size += len(one)
                    if size > 4 << 20:
                        yield batch_of(made)
                        made, size = [], 0
            if made:
                yield batch_of(made)

    made = keyed.select("id", "url", "payload", "first", revisit.alias("revisit")).mapInArrow(run, schema)
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("digest_so_far", T.StringType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("data", T.BinaryType()),
    ]
)


class Reader:
    """Joins the pieces of archives to chunk rows; fed in file order, it holds one record block and one piece at most."""

    def __init__(self, with_data: bool) -> None:
        self.with_data, self.headers, self.need = with_data, None, 0
        self.origin, self.hash, self.done, self.chunk = {}, hashlib.sha1(), 0, 0
        self.held, self.size = [], 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """Rows completed by this piece, which ended at a CRLF CRLF; that may lie inside a block, or overlap its end."""
        self.held.append(piece)
        self.size += len(piece) + len(END)
        while self.headers is None or self.size >= self.need + len(END):
            data, self.held, self.size = END.encode().join([*self.held, b""]), [], 0
            if self.headers is None:
                head, found, data = data.lstrip(b"\r\n").partition(END.encode())
                if not found:
                    return
                self.headers, self.need = self.parsed(head), 0
                self.need = int(self.headers["Content-Length"])
            else:
                block, end, data = data[: self.need], data[self.need : self.need + len(END)], data[self.need + len(END) :]
                if end != END.encode():
                    raise ValueError("a block does not end where its Content-Length says")
                yield self.block(block)
                self.headers = None
            if data:
                self.held, self.size = [data[: -len(END)]], len(data)

    @staticmethod
    def parsed(head: bytes) -> dict[str, str]:
        first, *lines = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        return {k: v for k, _, v in (x.partition(": ") for x in lines)}

    def block(self, data: bytes) -> tuple:
        head = self.headers
        if head["WARC-Type"] != "continuation":
            self.origin, self.hash, self.done, self.chunk = head, hashlib.sha1(), 0, 0
        elif head["WARC-Segment-Origin-ID"] != self.origin["WARC-Record-ID"]:
            raise ValueError("a continuation does not follow its record")
        if "WARC-Block-Digest" in head and base32_sha1(hashlib.sha1(data).digest()) != head["WARC-Block-Digest"][5:]:
            raise ValueError("a block does not match its digest")
        start, number = self.done, self.chunk
        self.hash.update(data)
        self.done, self.chunk = start + len(data), number + 1
        revisit = self.origin["WARC-Type"] == "revisit"
        last = "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head
        so_far = base32_sha1(self.hash.copy().digest())
        size, digest = (int(self.origin["X-Payload-Length"]), self.origin["WARC-Payload-Digest"][5:]) if revisit else (self.done, so_far)
        if last and not revisit and digest != self.origin["WARC-Payload-Digest"][5:]:
            raise ValueError("a payload does not match its digest")
        return (
            self.origin["WARC-Record-ID"][1:-1].removeprefix("urn:page:"), number, self.origin["WARC-Type"], self.origin["WARC-Target-URI"],
            self.origin["WARC-Refers-To"][1:-1].removeprefix("urn:page:") if revisit else None, start, len(data), so_far, last,
            size if last else None, digest if last else None, data if self.with_data else None,
        )


def read_archives(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives in the folder. Every digest and every length is checked on the way."""
    common.ship(spark)
    kinds = common.arrow_schema(CHUNKS)

    def run(batches):
        reader = Reader(with_data)
        for batch in batches:
            rows = [row for piece in batch.column(0).to_pylist() for row in reader.feed(piece)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(CHUNKS.fieldNames(), zip(*rows, strict=True), strict=True)), schema=kinds)
        if reader.headers is not None:
            raise ValueError("an archive ends inside a record")

    lines = spark.read.schema("value string").option("lineSep", END).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


def roundtrip(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Writes the pages (page_id, url, html) to archives in the shared folder and returns what they say, a row a page."""
    spark = pages.sparkSession
    path = common.shared_path(spark, "warc")
    source = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary").alias("payload"))
    write_archives(source, path, least, segment)
    common.drop_at_end(spark, path)
    chunks = read_archives(spark, path, with_data=False).where("last")
    as_id = lambda c: F.expr(f"try_cast({c} as bigint)")
    return chunks.select(
        as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"),
        (F.col("chunk") + 1).alias("n_chunks"),
    )


# SHA-1 in hexadecimal is 8 groups of 20 bits, each 4 letters of base32.
_BASE32 = " || ".join(
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((cast('0x' || digest[{5 * g + 1}:{5 * g + 5}] as bigint) >> {s}) & 31) + 1]" for g in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest from pages),
f as (select *, min(page_id) over (partition by html) as first_id from p)
select page_id, octet_length(encode(html)) as payload_bytes, {_BASE32} as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to, cast(case when page_id = first_id then greatest(1, ceil(octet_length(encode(html)) / {SEGMENT}.0)) else 1 end as int) as n_chunks
from f
"""
