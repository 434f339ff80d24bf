"""Token counts of whole texts through a cache of content digests (operator 4).

The key of a count is the SHA-256 of the text (null counts as empty; nothing else is changed, since any other
normalising would change counts) together with the SHA-256 of the tokenizer's file. Stored counts answer what they can;
of each distinct text that is left, one document is encoded, and its count is appended to the cache.

Cases: null and empty texts have no bytes and no tokens; equal texts are encoded once and all get the count; long texts
are encoded piece by piece; an empty table gives no rows; other columns are not read. Two jobs may append the same
digest at a time: readers take one row for each digest. Rows without id are counted like all others, also where no row
with an id has their text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import shared
from rillstone.llm.splitting import Splitter, tokenizers_class

CACHE = "digest binary, n_tokens bigint, version string"


class PieceCounts(dict):
    """Tokens in a piece, kept for short pieces until the table is full."""

    def __init__(self, tokenizer, limit: int = 500_000) -> None:  # noqa: ANN001
        self.tokenizer, self.limit = tokenizer, limit

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False))
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Token counts as the tokenizers library gives them.

    A byte-level tokenizer without normalizer treats each match of its pattern alone, so counts of pieces are added up
    and kept. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        before = self.tokenizer.pre_tokenizer
        self.by_piece = (
            self.tokenizer.normalizer is None
            and isinstance(before, pre_tokenizers.ByteLevel)
            and before.use_regex
            and not before.add_prefix_space
            and not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        )
        special = sorted((re.escape(t.content) for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(special)) if special else None
        self.splitter, self.counts = Splitter(pattern, tokenizers_class), PieceCounts(self.tokenizer)

    def count(self, text: str) -> int:
        if not self.by_piece:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        count = self.counts.__getitem__
        if len(text) <= 65_536:
            return sum(map(count, self.splitter.pieces(text)))
        found, n = self.splitter.stream(text), 0
        while part := list(islice(found, 65_536)):
            n += sum(map(count, part))
        return n


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counted(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """``digest, n_tokens`` of rows ``digest, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _COUNTERS:
            _COUNTERS[path, pattern] = Counter(path, pattern)
        counter = _COUNTERS[path, pattern]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = pa.array([counter.count(x or "") for x in part["text"].to_pylist()], pa.int64())
                yield pa.record_batch([part["digest"], n], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts in the cache for one tokenizer version, one for each digest; no rows before anything was written."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, pattern: str, cache: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; new counts are in the folder ``cache`` afterwards."""
    spark, version = docs.sparkSession, version_of(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # One document for each distinct text; row numbers would need an order, so a document is named by its id.
    distinct = rows.select("doc_id", digest).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = stored(spark, cache, version)
    distinct = shared.checkpointed(distinct.join(known, "digest", "left"))
    answers = distinct.filter("n_tokens IS NOT NULL").select("digest", "n_tokens")
    missing = distinct.filter("n_tokens IS NULL").select("digest", "doc_id")
    missing = shared.written(missing)
    # Equal ids may stand on unequal texts: the digest is part of the key, and one of equal rows is enough.
    texts = rows.select("doc_id", digest, "text")
    chosen = texts.join(missing, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    # A text that stands only in rows without id has no id to be named by: one row of each such text.
    unnamed = texts.filter("doc_id IS NULL").dropDuplicates(["digest"])
    unnamed = unnamed.join(missing.filter("doc_id IS NULL").select("digest"), "digest")
    chosen = chosen.unionByName(unnamed.select(*chosen.columns))
    fresh = shared.written(counted(chosen, path, pattern).dropDuplicates(["digest"]))
    fresh.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    answers = answers.unionByName(fresh)
    sizes = rows.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes"))
    # Every text has an answer by now; should one be missing, the query fails instead of dropping the row.
    found = F.coalesce(F.col("n_tokens"), F.raise_error(F.lit("a text without a token count")).cast("long"))
    out = sizes.join(answers, "digest", "left").withColumn("n_tokens", found)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A new, empty cache in the shared folder."""
    return f"{shared.folder(spark).rstrip('/')}/token-counts/{uuid.uuid4().hex}"
