"""Token counts per source, language and tokenizer version, kept up to date by signed changes."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.frames import columns_of, small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_RANKS = 1_000_000  # a larger vocabulary is refused: it is sent to every executor
#: How texts are cut before pairs are merged; fixed value of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEYS = ("source", "lang", "tokenizer")

_encodings: dict[str, object] = {}


def tokenizer_version(path: str = TOKENIZER) -> str:
    """Name of the vocabulary file and the start of its SHA-256: another file is another version."""
    with open(path, "rb") as f:
        return f"{os.path.basename(path).rpartition('.')[0]}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def _encoding(shared, version: str):
    if version not in _encodings:
        import tiktoken

        _encodings.clear()
        _encodings[version] = tiktoken.Encoding(
            version, pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}
        )
    return _encodings[version]


def count_tokens(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """doc_id, source, lang, tokenizer (its version), n_chars and n_tokens of every text.

    Null and empty texts have 0 tokens. Null sources and languages stay null. One result row per input row,
    whatever its id; an empty table gives an empty result, other columns are ignored. Texts are encoded
    whole. No shuffle; the vocabulary (of checked size) is sent to the executors once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{tokenizer} has {len(ranks)} tokens, more than {MAX_RANKS}")
    version, shared = tokenizer_version(tokenizer), spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared, version).encode_ordinary
        for batch in batches:
            texts = [t.as_py() or "" for t in batch["text"]]
            out = [batch["doc_id"], batch["source"], batch["lang"], pa.array([version] * len(batch), pa.string())]
            out += [pa.array(np.array([f(t) for t in texts], np.int64)) for f in (len, lambda t: len(encode(t)))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *KEYS, "n_chars", "n_tokens"])

    given = columns_of(docs, doc_id=doc_id, source=source, lang=lang, text=text).select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text"
    )
    return given.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_chars long, n_tokens long")


_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add the counted documents."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take the counted documents away again."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counts: DataFrame, before: str) -> DataFrame:
    """Changes of documents whose count was ``before`` (a column) and is n_tokens now."""
    return counts.select(
        *KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("n_tokens") - F.col(before)).alias("n_tokens")
    )


class TokenRollup:
    """Totals by source, language and tokenizer version, as the sum of the batches committed to a folder.

    A batch is reduced to one signed row per group and written to a folder of its own; Spark's ``_SUCCESS``
    file in it is the commit. A batch whose id is committed already changes nothing, one whose writing broke
    off is written anew, so a batch may be sent any number of times. As sums are additive, the order of
    batches does not matter. ``compact`` writes the totals and the ids they hold as a new base, after which the
    merged folders are not read any more. One writer at a time.

    Null sources and languages are groups of their own; a null count adds nothing. Empty batches can be
    committed. Groups whose documents and tokens have gone to 0 are not shown. Changes are summed before
    they are shuffled, so a source with most of the rows is no hot group. Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        """Complete tables in a folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{n}/_SUCCESS")))

    def _base(self) -> tuple[DataFrame | None, set[str]]:
        names = self._names("base")
        if not names:
            return None, set()
        base = self.spark.read.schema(f"batch string, {_DELTA}").parquet(f"{self.path}/base/{names[-1]}")
        held = {r.batch for r in base.filter("batch IS NOT NULL").select("batch").collect()}
        return base.filter("batch IS NULL").drop("batch"), held

    def committed(self) -> set[str]:
        return self._base()[1] | {unquote(n) for n in self._names("batch")}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was new."""
        if batch_id in self.committed():
            return False
        delta = changes.groupBy(*KEYS).agg(
            F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")
        )
        delta.write.mode("overwrite").parquet(f"{self.path}/batch/{quote(batch_id, safe='')}")
        return True

    def totals(self) -> DataFrame:
        base, held = self._base()
        names = [n for n in self._names("batch") if unquote(n) not in held]
        parts = [] if base is None else [base]
        if names:
            parts.append(self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/batch/{n}" for n in names)))
        if not parts:
            return self.spark.createDataFrame([], _DELTA)
        summed = reduce(DataFrame.union, parts).groupBy(*KEYS)
        return summed.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter(
            "n_docs <> 0 OR n_tokens <> 0"
        )

    def compact(self) -> None:
        ids = [(i, None, None, None, 0, 0) for i in sorted(self.committed())]
        schema = f"batch string, {_DELTA}"
        totals = self.totals().select(F.lit(None).cast("string").alias("batch"), "*")
        number = len(self._names("base"))
        totals.union(self.spark.createDataFrame(ids, schema)).write.mode("overwrite").parquet(
            f"{self.path}/base/{number:08d}"
        )
