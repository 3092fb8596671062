"""Token counts through a digest cache (operator 8).

The cache is a Parquet table in the shared folder with one row for each digest
of a normalised text and tokenizer version: (text_digest, tokenizer_digest,
n_tokens), at one place for all runs. A run digests every text, takes the digests
that the cache lacks, encodes each of them once and appends the counts; then
every row joins its digest to the cache. A run that meets no new text encodes
none. Normalising replaces null by the empty text and nothing
else, since any other change could change a count.

Copies meet only after each map task has dropped its own repeats, so a text
that is a third of all rows costs a row for each task. The last join is on
digests without texts; a hot digest is one row on the cache's side, and the
other side can be split.

Empty and null texts have 0 tokens; repeated rows come out as often as they
went in; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, text_or_empty, tidy_batches
from .words import batch_parts

CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens bigint"


@lru_cache(2)
def counter(path: str):
    """Texts to counts by the library for the file's kind; kept by the worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest this task has not met."""
    met: set[bytes] = set()
    for batch in batches:
        new = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in met:
                met.add(d)
                new.append(i)
        if new:
            yield batch.take(pa.array(new, pa.int64()))


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in _first_of_task(batches):
            for part in batch_parts(batch, 1):
                counts = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["text_digest", "tokenizer_digest", "n_tokens"])

    return tidy_batches(run)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts of this tokenizer version; none where nothing has been written yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("tokenizer_digest") == version).select("text_digest", "n_tokens")


def add_missing(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Encode the texts that the cache lacks, append their counts, and return the cache of this tokenizer version."""
    spark = docs.sparkSession
    ship(spark)
    version = version_digest(tokenizer_path)
    keyed = docs.select(F.unhex(F.sha2(text_or_empty(text), 256)).alias("text_digest"), text_or_empty(text).alias("text"))
    missing = keyed.select("text_digest").distinct().join(read_cache(spark, cache_path, version), "text_digest", "left_anti")
    # Merged whatever the size, so that all copies of a text meet in one task and are encoded once.
    texts = keyed.mapInArrow(tidy_batches(_first_of_task), keyed.schema).join(missing.hint("merge"), "text_digest", "left_semi")
    texts.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # Two runs may append one digest at the same time; either row is right.
    return read_cache(spark, cache_path, version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def shared_cache(spark: SparkSession) -> str:
    """The cache that all applications with this shared folder use."""
    return f"{shared_dir(spark)}/spanlens/token-cache"


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row; by the shared cache unless another is named."""
    counts = add_missing(docs, cache_path or shared_cache(docs.sparkSession), tokenizer_path, text)
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)),
        F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text_or_empty(text), 256)).alias("text_digest"),
    )
    joined = rows.join(counts, "text_digest", "left")
    return joined.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
