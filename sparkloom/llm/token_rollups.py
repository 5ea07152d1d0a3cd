"""Token-count rollups kept by signed deltas.

Every document is counted once, by each tokenizer version, and the counts are stored. A batch of changes is signed
rows, +1 for what a document now counts and -1 for what it counted before, summed by (source, lang, tokenizer) before
anything is shuffled far. A rollup is a folder of such sums and a list of manifests: a batch is written to a folder of
its own, and published by a manifest that names the folders to be summed and the batches they hold. The manifest
appears by a rename, so a commit that breaks off leaves nothing to sum and nothing lost. A batch that the manifest
names already is refused, so a replay changes nothing; compact() publishes one folder in place of all and keeps the
names of its batches, so they are refused afterwards too. One writer at a time, or a file system whose rename fails
where the target exists.

Tokenizer versions: PATTERNS, counted by a pattern in DataFrame operations, and tokenizer files, named by the file and
counted by the tokenizer itself in Arrow batches.

Changes: insert (+ after), delete (- before), revise (- before, + after). Defined cases: null source, language or
tokenizer are keys of their own; a null count is 0, and so is that of a null text; a batch without rows adds nothing
and is committed; groups whose documents and tokens both fall to 0 are left out of the totals; a null doc_id is the
smallest; other columns, also those named like the results, are ignored.
"""

from __future__ import annotations

import json
import uuid
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .packing import encoder

KEYS = ["source", "lang", "tokenizer"]
# Tokenizer versions that are counted by a pattern.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}
SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
COUNTED = "doc_id bigint, source string, lang string, same binary, tokenizer string, tokens bigint"


def _rows(docs: DataFrame) -> DataFrame:
    same = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), same.alias("same"), F.col("text").cast("string").alias("text"))


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """COUNTED: tokens of the whole text by a pattern's name or a tokenizer file; same: the text's identity."""
    if tokenizer in PATTERNS:
        tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(PATTERNS[tokenizer])).cast("long")
        return _rows(docs).select("doc_id", "source", "lang", "same", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"))
    common.ship(docs.sparkSession)
    version = PurePath(tokenizer).stem

    def make(batch):
        tokens = [len(encoder(tokenizer).ids(t or "")) for t in batch.column(4).to_pylist()]
        return {n: batch.column(i) for i, n in enumerate(("doc_id", "source", "lang", "same"))} | {"tokenizer": [version] * len(tokens), "tokens": tokens}

    return common.map_rows(_rows(docs), make, T._parse_datatype_string(COUNTED))


def signed(after: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Sums of a batch: insert (after), delete (before) or revise (both), each with KEYS and tokens."""
    rows = [df.select(*KEYS, F.lit(sign).cast("long").alias("sign"), (sign * F.coalesce("tokens", F.lit(0))).alias("tokens")) for df, sign in ((after, 1), (before, -1)) if df is not None]
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return both.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"))


class Rollup:
    """The committed batches in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(path).getFileSystem(settings)

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        """The latest manifest and its number; number 0 where there is none."""
        place = self._at(f"{self.path}/manifests")
        found = [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []
        number = max((int(n.removesuffix(".json")) for n in found if n.endswith(".json")), default=0)
        if not number:
            return 0, {"folders": [], "batches": []}
        return number, json.loads(self.spark.read.text(f"{self.path}/manifests/{number:010d}.json", wholetext=True).first()[0])

    def _publish(self, number: int, held: dict[str, list[str]]) -> bool:
        """Whether the manifest is now the one of that number; not where another writer was faster."""
        draft, place = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{number:010d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        return not self._files.exists(place) and self._files.rename(draft, place)

    def commit(self, batch: str, sums: DataFrame) -> bool:
        """Adds the batch's sums; False, and nothing is changed, if it is committed already."""
        folder = None
        while True:
            number, held = self._manifest()
            if batch in held["batches"]:
                return False
            if folder is None:
                folder = f"sums-{uuid.uuid4().hex}"
                sums.write.parquet(f"{self.path}/{folder}")
            if self._publish(number + 1, {"folders": [*held["folders"], folder], "batches": [*held["batches"], batch]}):
                return True

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SUMS)
        held = self.spark.read.schema(SUMS).parquet(*(f"{self.path}/{f}" for f in folders))
        sums = held.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._manifest()[1]["folders"])

    def compact(self) -> None:
        """Puts one folder of the totals in place of all; its batches stay refused."""
        while True:
            number, held = self._manifest()
            folder = f"sums-{uuid.uuid4().hex}"
            self._sums(held["folders"]).write.parquet(f"{self.path}/{folder}")
            if self._publish(number + 1, {"folders": [folder], "batches": held["batches"]}):
                return


def maintained(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Totals over the whole table after: insert by words-1; revise to the tokenizer; delete copies; compact; send the revision again.

    Of each text the row of the smallest (doc_id, source, lang) stays. The deletion is all rows before and those that
    stay after, which needs one aggregation by text and no join.
    """
    spark = docs.sparkSession
    path = common.shared_path(spark, "rollup")
    rollup = Rollup(spark, path)
    common.drop_at_end(spark, path)
    before, after = common.stored(counted(docs, "words-1"), "counted"), common.stored(counted(docs, tokenizer), "counted")
    stay = after.groupBy("same").agg(F.min(F.struct("doc_id", "source", "lang", "tokenizer", "tokens")).alias("row")).select("row.*")
    rollup.commit("1-insert", signed(after=before))
    rollup.commit("2-revise", signed(after=after, before=before))
    rollup.commit("3-delete", signed(after=stay, before=after))
    rollup.compact()
    rollup.commit("2-revise", signed(after=after, before=before))  # a replay
    return rollup.totals()


#: Of maintained(docs, "marks-2").
SQL = r"""
with counted as (
  select doc_id, source, lang, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) as tokens
  from documents
), kept as (
  select *, min(doc_id) over (partition by t) as first_id from counted
)
select source, lang, 'marks-2' as tokenizer, count(*) as n_docs, cast(sum(tokens) as bigint) as n_tokens
from kept where doc_id = first_id group by source, lang
"""
