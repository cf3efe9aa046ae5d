"""Passages that occur more than once, by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.frames import columns_of, if_small, small_batches, staged, text_key


@dataclass(frozen=True)
class Repeats:
    min_words: int = 50
    gram: int = 8  # words whose hash is compared to select positions
    window: int = 18  # of so many neighbouring positions, the one with the smallest hash is retained

    @property
    def reach(self) -> int:
        """Words to the left of the first retained position of a passage, at most."""
        return self.window - 1

    @property
    def common(self) -> int:
        """Words of the passage from that position on, at least; suffixes are grouped by so many."""
        return self.min_words - self.reach

    def __post_init__(self):
        if self.common < self.gram + self.reach:
            raise ValueError("min_words must be at least gram + 2 * (window - 1)")


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick over values[i:i + size], by doubling; positions without so many values are left out."""
    if len(values) < size:
        return values[:0]
    have, n = values, 1
    while 2 * n <= size:
        have, n = pick(have[:-n], have[n:]), 2 * n
    rest = size - n
    return pick(have[: len(have) - rest], have[rest:]) if rest else have


def retained(found: h.Words, options: Repeats) -> np.ndarray:
    """Positions whose gram is the smallest of some window, which the words themselves decide.

    Copies of a passage of at least gram + window - 1 words retain the same positions of it.
    """
    keys, first = h.windows(found, options.gram)
    value = np.zeros(len(found.hashes), np.uint64)  # 0 where no gram begins: such a window selects nothing
    value[first] = keys | np.uint64(1)
    least = _sliding(value, options.window, np.minimum)
    if not len(least):
        return first[:0]
    pad = np.zeros(options.window - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), options.window, np.maximum)
    return np.flatnonzero((value > 0) & (most == value))


def _suffix_keys(batches: Iterator[pa.RecordBatch], options: Repeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        for a, b in h.blocks(offsets):
            found = h.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
            at = retained(found, options)
            document = np.searchsorted(found.offsets, at, "right") - 1
            long = at + options.common <= found.offsets[document + 1]
            at, document = at[long], document[long]
            keys = h.run_hashes(found.hashes, at, at + options.common)
            split = pa.array(np.searchsorted(document, np.arange(b - a + 1)).astype(np.int32))
            place = (at - found.offsets[document]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(a, b - a),
                    batch["text_key"].slice(a, b - a),
                    pa.ListArray.from_arrays(split, pa.array(keys.view(np.int64))),
                    pa.ListArray.from_arrays(split, pa.array(place)),
                ],
                ["doc_id", "text_key", "key", "at"],
            )


def _equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those with a neighbour of the same key, and both ends of the partition."""
    held = None
    fresh = True  # the held row has no equal row before it, as far as is known
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = rows["key"].to_numpy()
        if not len(key):
            continue
        equal = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= equal
        keep[:-1] |= equal
        keep[0] |= held is None or not fresh
        last = keep[-1]
        keep[-1] = False  # decided with the next batch
        fresh = not (last or held is None and len(key) == 1)
        held = rows.slice(len(key) - 1).to_batches()[0]
        yield from rows.filter(pa.array(keep)).to_batches()
    if held is not None:
        yield held


def _contexts(batches: Iterator[pa.RecordBatch], options: Repeats) -> Iterator[pa.RecordBatch]:
    """For each listed position: its key, a second hash of the same words, and the words around them."""
    common, reach = options.common, options.reach
    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        ids, keys, places = batch["doc_id"], batch["text_key"], batch["at"]
        for i in range(len(batch)):
            own = data[offsets[i] : offsets[i + 1]]
            words = h.words(own, np.array([0, len(own)]), lower=True).hashes
            at = np.sort(places[i].values.to_numpy())
            short = (words >> np.uint64(32)).astype(">u4")
            right, left, n = short.tobytes(), short[::-1].tobytes(), len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i].as_py()] * len(at), pa.int64()),
                    pa.array([keys[i].as_py()] * len(at), pa.int64()),
                    pa.array(at.astype(np.int32)),
                    pa.array(h.run_hashes(words, at, at + common).view(np.int64)),
                    pa.array(h.run_hashes(h.mix(words), at, at + common).view(np.int64)),
                    pa.array([left[4 * (n - x) : 4 * (n - x + reach)] for x in at.tolist()], pa.binary()),
                    pa.array([right[4 * x : 4 * (x + reach)] for x in (at + common).tolist()], pa.binary()),
                ],
                ["doc_id", "text_key", "at", "key", "check", "left", "right"],
            )


def _shared_words(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (8 * n - differ.bit_length()) // 32


_EXTENT = "doc_id long, text_key long, at int, extent int, key long, check long, part int, side binary"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, check and side: how many words of side they share with a neighbour.

    A row without a neighbour of its key and check is left out. The first and the last row of the partition
    come once more, with the number of the partition and their side, to be compared across partitions.
    """
    part = TaskContext.get().partitionId()
    first = before = None
    names = [x.split()[0] for x in _EXTENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    extent = -1  # of the row before
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in ("key", "check", "side", "doc_id", "text_key", "at"))):
            if before is None:
                first = before = row
                continue
            if row == before:  # the same document, given twice
                continue
            shared = _shared_words(row[2], before[2]) if row[:2] == before[:2] else -1
            if max(extent, shared) >= 0:
                out.append((*before[3:], max(extent, shared), *before[:2], None, None))
            before, extent = row, shared
        yield batch_of(out)
    if before is not None:
        ends = [(*x[3:], -1, *x[:2], part, x[2]) for x in ([first, before] if first != before else [first])]
        yield batch_of(([(*before[3:], extent, *before[:2], None, None)] if extent >= 0 else []) + ends)


def _extents(contexts: DataFrame, side: str) -> DataFrame:
    """doc_id, text_key, at, extent, key, check: the longest overlap of each suffix with its neighbours on one side."""
    spark = contexts.sparkSession
    order = ["key", "check", "side", "doc_id", "text_key", "at"]
    rows = contexts.select("key", "check", F.col(side).alias("side"), "doc_id", "text_key", "at")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = staged(
        rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(_extend, _EXTENT), side
    )
    ends = found.filter("part IS NOT NULL").collect()  # two rows for each partition
    ends.sort(key=lambda r: (r.part, r.key, r.check, r.side))
    across = []
    for a, b in zip(ends, ends[1:]):
        if a.part != b.part and (a.key, a.check) == (b.key, b.check):
            shared = _shared_words(bytes(a.side), bytes(b.side))
            across += [(x.doc_id, x.text_key, x["at"], shared, x.key, x.check) for x in (a, b)]
    inside = found.filter("part IS NULL").select("doc_id", "text_key", "at", "extent", "key", "check")
    return inside.union(spark.createDataFrame(across, inside.schema)) if across else inside


def _verified(contexts: DataFrame, wanted: DataFrame, options: Repeats) -> DataFrame:
    """doc_id, text_key, at, before: windows of ``min_words`` words that begin ``before`` words before a position.

    ``wanted`` lists them by the words at the position (key, check); of these the ones that stand in two places are
    returned, for all places. Few groups are wanted, those of doubtful runs.
    """
    wanted = wanted.select(F.col("key").alias("of_key"), F.col("check").alias("of_check"), "before").distinct()
    groups = staged(wanted.groupBy("of_key", "of_check").agg(F.collect_set("before").alias("befores")), "borders")
    here = contexts.join(if_small(groups), (F.col("key") == F.col("of_key")) & (F.col("check") == F.col("of_check")))
    windows = here.select("doc_id", "text_key", "at", "key", "check", "left", "right", F.explode("befores").alias("before"))
    after = options.reach - F.col("before")
    windows = windows.filter((F.length("left") >= 4 * F.col("before")) & (F.length("right") >= 4 * after))
    sides = [F.col("left").substr(F.lit(1), 4 * F.col("before")), F.col("right").substr(F.lit(1), 4 * after)]
    words = [F.xxhash64(F.lit(seed), "key", "check", "before", *sides).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    windows = staged(windows.select("doc_id", "text_key", "at", "before", *words), "windows")
    place = F.struct("doc_id", "text_key", (F.col("at") - F.col("before")).alias("first"))
    twice = windows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
    return windows.join(twice.select("h1", "h2"), ["h1", "h2"], "left_semi").select("doc_id", "text_key", "at", "before")


def _merged(intervals: DataFrame, *more) -> DataFrame:
    """doc_id, text_key, first, end, and ``more`` aggregates, of intervals that touch or overlap."""
    document = Window.partitionBy("doc_id", "text_key").orderBy("first", "end")
    before = document.rowsBetween(Window.unboundedPreceding, -1)
    runs = intervals.withColumn("reached", F.max("end").over(before))
    begins = F.col("reached").isNull() | (F.col("first") > F.col("reached"))
    runs = runs.withColumn("run", F.sum(begins.cast("int")).over(document))
    return runs.groupBy("doc_id", "text_key", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), *more).drop("run")


def _passages(contexts: DataFrame, options: Repeats) -> DataFrame:
    """doc_id, text_key, first, end: runs that hold a passage of ``min_words`` words that occurs twice.

    A position whose words on one side are equal to a neighbour's as far as they are kept begins, or ends, such a
    passage. In runs without such a position the two sides may have different neighbours: their windows, which are
    few, are looked up.
    """
    reach, common, size = options.reach, options.common, options.min_words
    at, extent, whole = F.col("at"), F.col("extent"), (F.col("extent") == options.reach).alias("certain")
    left = _extents(contexts, "left").select("doc_id", "text_key", (at - extent).alias("first"), (at + common).alias("end"), whole)
    right = _extents(contexts, "right").select("doc_id", "text_key", at.alias("first"), (at + common + extent).alias("end"), whole)
    runs = _merged(left.union(right), F.bool_or("certain").alias("certain")).filter(F.col("end") - F.col("first") >= size)
    runs = staged(runs, "runs")
    sure = runs.filter("certain").drop("certain")
    doubtful = runs.filter("NOT certain").select(*(F.col(c).alias(f"of_{c}") for c in ("doc_id", "text_key", "first", "end")))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("text_key") == F.col("of_text_key"))
    inside = at.between(F.col("of_first"), F.col("of_end") - common)
    places = contexts.join(if_small(doubtful), same & inside).select("key", "check")
    wanted = places.distinct().select("key", "check", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("before"))
    first = at - F.col("before")
    found = _verified(contexts, wanted, options).select("doc_id", "text_key", first.alias("first"), (first + size).alias("end"))
    return _merged(sure.union(found.distinct()))


def repeated_passages(
    docs: DataFrame, options: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Passages of ``min_words`` or more lower-cased (A-Z) words that also stand elsewhere.

    Result: doc_id, text_key, first_word, end_word (numbers of words, from 0, the end not included), n_words.
    Every passage of ``min_words`` words that occurs twice, in two documents or within one, lies in a run, and every
    run holds such a passage. A run may go on over shorter passages that overlap it, of at least ``Repeats.common``
    words that occur twice; passages that touch or overlap are one run.

    Null and short texts have no passages. Rows equal in id and text are one document, also without an id;
    other rows with one id are documents of their own. An empty table gives an empty result, other columns
    are ignored. Texts are read whole; no cap on the number of copies.

    Suffixes begin at positions that the words select, about two in every window + 1. They are sorted by the
    hash of their first words and only those with an equal neighbour stay. Of these the words before and after
    are fetched (one shuffle of the texts), and each is compared with its neighbours in two orders: by the words
    after it and by those before it, so the longest overlap is next to it in one of them. Sorts are by range over
    whole rows, so the copies of one passage are spread over partitions; partition ends are compared last. Runs in
    which no position is equal as far as words are kept are looked up window by window, by hash.
    """
    small_batches(docs.sparkSession)
    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, text_key long, key array<long>, at array<int>"
    keyed = staged(given.mapInArrow(lambda x: _suffix_keys(x, options), schema), "suffixes")
    suffixes = keyed.select(F.inline(F.arrays_zip("key", "at")).alias("key", "at"), "doc_id", "text_key")
    order = ["key", "doc_id", "text_key", "at"]
    suffixes = suffixes.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    repeated = suffixes.mapInArrow(_equal_neighbours, "key long, at int, doc_id long, text_key long")
    wanted = repeated.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("at"))
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key"))
    texts = given.alias("d").join(wanted.alias("w"), same).select("d.doc_id", "d.text_key", "text", "at")
    contexts = staged(
        texts.mapInArrow(
            lambda x: _contexts(x, options),
            "doc_id long, text_key long, at int, key long, check long, left binary, right binary",
        ),
        "contexts",
    )
    merged = _passages(contexts, options)
    return merged.select(
        "doc_id",
        "text_key",
        F.col("first").cast("long").alias("first_word"),
        F.col("end").cast("long").alias("end_word"),
        (F.col("end") - F.col("first")).cast("long").alias("n_words"),
    )
