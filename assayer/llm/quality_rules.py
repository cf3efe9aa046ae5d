"""Quality rules with cross-document line frequency."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.frames import SMALL_ROWS, columns_of, small_batches, staged, text_key, with_row_ids

SYMBOLS = b"#*$%&|<>"  # fixed values
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    max_documents: int = 10  # of one host that may share a line
    max_lost_pct: int = 50  # of a document's words in lines above that limit


_SCHEMA = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, line array<long>, line_words array<int>, line_at array<int>"
)


def _repeated(found: h.Words, size: int) -> np.ndarray:
    """Words per document that lie in windows found twice or more in it."""
    keys, first = h.windows(found, size)
    keys = h.mix(keys ^ h.mix(found.documents()[first].astype(np.uint64)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    cover = np.zeros(len(found.hashes) + 1, np.int64)
    if len(twice):
        at = first[twice[np.searchsorted(twice, keys).clip(max=len(twice) - 1)] == keys]
        cover[at] += 1  # first words are distinct, and so are ends
        cover[at + size] -= 1
    return h.per_document(np.cumsum(cover[:-1]) > 0, found.offsets)


def _lines(data: np.ndarray, offsets: np.ndarray, found: h.Words) -> tuple[np.ndarray, ...]:
    """Of each line with a word: document, number in the document, hash of its bytes, first and end of its words."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    document = np.searchsorted(offsets, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(document, document)
    ends = np.append(starts[1:], len(data))
    first, end = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
    some = end > first
    starts, ends, first, end = starts[some], ends[some], first[some], end[some]
    document, number = document[some], number[some]
    ends = ends - ((data[ends - 1] == 10) if len(ends) else 0)
    return document, number, h.run_hashes(h._VALUES[False][data], starts, ends), first, end


def _measure(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        for a, b in h.blocks(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found = h.words(own, at, lower=False)
            solid = ~h.SPACE[own] & ((own & 0xC0) != 0x80)
            document, number, raw, first, end = _lines(own, at, found)
            lowered = h.words(own, at, lower=True)
            norm = h.run_hashes(lowered.hashes, first, end)
            key = h.mix(raw ^ h.mix(document.astype(np.uint64)))
            _, earliest = np.unique(key, return_index=True)
            again = np.ones(len(key), bool)
            again[earliest] = False
            line_offsets = pa.array(np.searchsorted(document, np.arange(b - a + 1)).astype(np.int32))
            columns = [
                batch["doc_id"].slice(a, b - a),
                batch["host"].slice(a, b - a),
                batch["text_key"].slice(a, b - a),
                pa.array(np.diff(found.offsets)),
                pa.array(h.per_document(solid, at)),
                pa.array(h.per_document(_IS_SYMBOL[own], at)),
                pa.array(np.bincount(document[again], minlength=b - a).astype(np.int64)),
                pa.array(_repeated(found, window)),
                pa.ListArray.from_arrays(line_offsets, pa.array(norm.view(np.int64))),
                pa.ListArray.from_arrays(line_offsets, pa.array((end - first).astype(np.int32))),
                pa.ListArray.from_arrays(line_offsets, pa.array(number.astype(np.int32))),
            ]
            names = [x.split()[0] for x in _SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays(columns, names)


def _judged(docs: DataFrame, rules: QualityRules, doc_id: str, text: str, host: str) -> DataFrame:
    """The rows of ``quality_rules``, with their host and ``lost``, the numbers of the lines they lose or null."""
    small_batches(docs.sparkSession)
    window = rules.window
    given = columns_of(docs, doc_id=doc_id, host=host, text=text).select(
        F.col("doc_id").cast("long"), F.col("host").cast("string"), "text", text_key("text").alias("text_key")
    )
    measured = staged(with_row_ids(given.mapInArrow(lambda batches: _measure(batches, window), _SCHEMA)), "quality")
    document = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("document")
    lines = measured.select(
        "row_id",
        "host",
        document,
        F.inline(F.arrays_zip("line", "line_words", "line_at")).alias("line", "line_words", "line_at"),
    )
    frequent = (
        lines.groupBy("host", "line")
        .agg(F.count_distinct("document").alias("documents"), F.min("document").alias("first_document"))
        .filter(F.col("documents") > rules.max_documents)
        .select(F.col("host").alias("line_host"), F.col("line").alias("frequent"), "first_document")
    )
    lost = (
        lines.join(frequent, (F.col("line") == F.col("frequent")) & F.col("host").eqNullSafe(F.col("line_host")))
        .filter(F.col("document") != F.col("first_document"))
        .groupBy(F.col("row_id").alias("lost_row"))
        .agg(F.sum("line_words").alias("lost_words"), F.collect_list("line_at").alias("lost"))
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")
    )
    return (
        measured.drop("line", "line_words", "line_at")
        .join(lost, F.col("row_id") == F.col("lost_row"), "left")
        .select(
            "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.coalesce("lost_words", F.lit(0)).cast("long").alias("lost_words"),
            failed.alias("base_failed"), "host", "lost",
        )
        .withColumn(
            "kept",
            ~F.col("base_failed") & (100 * F.col("lost_words") <= rules.max_lost_pct * F.col("n_words")),
        )
    )


def quality_rules(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Base counts and verdict of every row of ``docs``. ``keep_good`` returns the texts that the verdict leaves.

    A line is its lower-cased (A-Z) words. A line that more than ``max_documents`` distinct documents of one
    host hold is lost to all of them but the first (the smallest id), and a document that loses more than
    ``max_lost_pct`` of its words is depleted: not kept. ``base_failed`` documents, too short or too repetitive,
    are not kept either; their lines count.

    Result: one row per input row with doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lost_words, base_failed, kept.

    Null text: no words, so base_failed. Null host: a host of its own. Rows with one id, and all rows without
    an id, are one document when documents are counted; each row is judged on its own text. An empty table
    gives an empty result, other columns of ``docs`` are ignored. No cap on lines, words or text length.

    Each text is read once, in Python; one row per document with the hashes of its lines is staged. What is
    shuffled are line hashes, counted before the shuffle, so a line or host that holds most rows is no hot group.
    """
    return _judged(docs, rules, doc_id, text, host).drop("host", "lost")


def keep_good(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    n_chars: str = "n_chars",
) -> DataFrame:
    """The documents that the rules keep, with all their columns, without the lines that they lose.

    The lines that stay are as they were, lines without words included. Where a text changes, a column
    ``n_chars`` gets its new length. Rows equal in id, text and host have one verdict.

    Rejected rows and rows that lose lines are staged with the numbers of the lines; the texts are shuffled only
    if these are many.
    """
    judged = _judged(docs, rules, doc_id, text, host)
    changes = staged(
        judged.filter(~F.col("kept") | F.col("lost").isNotNull())
        .groupBy("doc_id", "text_key", "host")
        .agg(F.any_value("kept").alias("kept"), F.any_value(F.when(F.col("kept"), F.col("lost"))).alias("lost")),
        "changes",
    )
    numbers = changes.agg(F.sum(1 + F.coalesce(F.array_size("lost"), F.lit(0)))).first()[0] or 0
    changes = F.broadcast(changes) if numbers <= SMALL_ROWS else changes
    row = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("own_id"),
        text_key(text).alias("own_key"),
        F.col(f"`{host}`").cast("string").alias("own_host"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    same &= F.col("own_host").eqNullSafe(F.col("host"))
    own_text = F.col("row").getField(text)
    parts = F.split(own_text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lost"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    left = row.join(changes, same, "left").filter(F.coalesce("kept", F.lit(True)))
    left = left.select("row", F.when(F.col("lost").isNotNull(), rest).alias("rest"))
    new = {text: F.coalesce("rest", own_text)}
    if n_chars in docs.columns:
        own_chars = F.col("row").getField(n_chars)
        new[n_chars] = F.coalesce(F.length("rest").cast(docs.schema[n_chars].dataType), own_chars)
    return left.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
