"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.frames import columns_of, rows_in, small_batches, staged, text_key, with_row_ids


@dataclass(frozen=True)
class EditMatch:
    error_pct: int = 8  # edits allowed per 100 characters of an item
    min_chars: int = 20  # shorter items would match by chance: they must stand there as whole words, unchanged
    block_chars: int = 1_000_000  # of items, about, that one pass over the documents searches for


def normalise(text: str) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split())


class Pattern:
    """Myers' bit vectors of one string: a column of the edit table is two integers, whatever its length."""

    def __init__(self, text: str):
        self.size, self.full, self.top = len(text), (1 << len(text)) - 1, 1 << (len(text) - 1)
        self.where: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.where[c] |= 1 << i
        self.where = dict(self.where)

    def scores(self, text: str, anchored: bool = False) -> Iterator[int]:
        """After each character, the edits to the best run of text that ends there (anchored: to all of it)."""
        up, down, score, carry = self.full, 0, self.size, int(anchored)
        for c in text:
            same = self.where.get(c, 0)
            vertical = same | down
            horizontal = (((same & up) + up) ^ up) | same
            rise = (down | ~(horizontal | up)) & self.full
            fall = up & horizontal
            if rise & self.top:
                score += 1
            elif fall & self.top:
                score -= 1
            rise, fall = ((rise << 1) | carry) & self.full, (fall << 1) & self.full
            up = (fall | ~(vertical | rise)) & self.full
            down = rise & vertical
            yield score


@dataclass
class Item:
    item_id: int | None
    text: str
    budget: int
    whole_words: bool = False

    def pieces(self) -> Iterator[tuple[int, str]]:
        """budget + 1 pieces: within the budget, at least one of them is untouched."""
        n = self.budget + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return ((a, self.text[a:b]) for a, b in zip(cuts, cuts[1:]))


def _blocks(benchmark: DataFrame, options: EditMatch) -> Iterator[list[Item]]:
    """Blocks of items of about ``block_chars`` characters; the driver holds one at a time."""
    rows = staged(with_row_ids(benchmark.filter("text IS NOT NULL")), "items")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // options.block_chars)
    for block in range(blocks):
        items = []
        for row in rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == block).select("item_id", "text").collect():
            if text := normalise(row.text):
                whole = len(text) < options.min_chars
                items.append(Item(row.item_id, text, 0 if whole else len(text) * options.error_pct // 100, whole))
        if items:
            yield items


class Searcher:
    def __init__(self, items: list[Item]):
        self.items = items
        self.forward: list[Pattern | None] = [None] * len(items)
        self.back: list[Pattern | None] = [None] * len(items)
        places = defaultdict(list)
        for i, item in enumerate(items):
            for at, piece in item.pieces():
                places[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, [(i, at + len(piece) - 1) for i, at in found])
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item, edits, start and end of the best match of each item that is within its budget."""
        begins = defaultdict(set)  # of item: where it would begin if nothing were edited before the piece
        for end, found in self.automaton.iter(text):
            for i, last in found:
                begins[i].add(end - last)
        out = []
        for i in sorted(begins):
            best = self._best(i, sorted(begins[i]), text)
            if best:
                out.append((i, *best))
        return out

    def _best(self, i: int, begins: list[int], text: str) -> tuple[int, int, int] | None:
        item, best = self.items[i], None
        k, m = item.budget, len(item.text)
        if item.whole_words:
            ends = (x + m for x in begins if text[x - 1 : x] in ("", " ") and text[x + m : x + m + 1] in ("", " "))
            end = next(ends, None)
            return None if end is None else (0, end - m, end)
        if self.forward[i] is None:
            self.forward[i], self.back[i] = Pattern(item.text), Pattern(item.text[::-1])
        spans = []
        for x in begins:
            a, b = max(0, x - k), min(len(text), x + m + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        for a, b in spans:
            for j, score in enumerate(self.forward[i].scores(text[a:b]), a + 1):
                if score <= k and (best is None or score < best[0]):
                    best = score, a, j
        if best is None:
            return None
        score, a, end = best
        for j, back in enumerate(self.back[i].scores(text[a:end][::-1], anchored=True), 1):
            if back == score:
                return score, end - j, end
        raise AssertionError("a match has a start")


_SCHEMA = "doc_id long, text_key long, item_id long, edits int, start int, end int"
_searchers: dict[str, Searcher] = {}


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    if shared.id not in _searchers:
        _searchers.clear()
        _searchers[shared.id] = Searcher(shared.value)
    searcher = _searchers[shared.id]
    for batch in batches:
        out = []
        ids, keys = batch["doc_id"].to_pylist(), batch["text_key"].to_pylist()
        for row, text in enumerate(batch["text"]):
            for i, edits, start, end in searcher.search(normalise(text.as_py() or "")):
                out.append((ids[row], keys[row], searcher.items[i].item_id, edits, start, end))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")]
        )


class _Shared:
    """A broadcast value with an id by which a worker keeps what it has built from it."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = f"{spark.sparkContext.applicationId}-{self.broadcast._jbroadcast.id()}"

    @property
    def value(self):
        return self.broadcast.value

    def __reduce__(self):
        return _restore, (self.broadcast, self.id)


def _restore(broadcast, name):
    shared = _Shared.__new__(_Shared)
    shared.broadcast, shared.id = broadcast, name
    return shared


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    options: EditMatch = EditMatch(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains within the item's edit budget.

    Both texts are lower-cased and their white space runs become one space. An item of n characters may be
    changed by ``error_pct`` * n / 100 insertions, deletions and substitutions, rounded down. Cut into one
    piece more than that, at least one piece is found unchanged; an automaton over all pieces finds those, and
    Myers' bit-parallel distance decides around them.

    Result: doc_id, text_key, item_id, edits, start and end (of the best match in the normalised text: fewest
    edits, then the earliest end, then the latest start); one row per input row and item.

    Items shorter than ``min_chars`` have no edits and must stand between spaces or ends of the text. Null or empty
    texts and items, also those of white space only, match nothing. Repeated
    documents or items give repeated rows; rows without id keep null as id. Empty tables give an empty
    result, other columns are ignored. Texts are searched whole, all items and all hits are verified.

    The items are the query set. They are divided by the hash of their row number into blocks of about
    ``block_chars`` characters; one block at a time is sent to the executors, for one pass over the documents,
    whose matches are written before the next block is read. No shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    items = columns_of(benchmark, item_id=item_id, text=item_text).withColumn("item_id", F.col("item_id").cast("long"))
    found = []
    for block in _blocks(items, options):
        shared = _Shared(spark, block)
        hits = given.mapInArrow(lambda batches, shared=shared: _search(batches, shared), _SCHEMA)
        found.append(staged(hits, "hits"))
        shared.broadcast.destroy()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, options: EditMatch = EditMatch()) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    return rows_in(docs, contaminated(docs, benchmark, options), "doc_id", "text", "left_anti")
