"""Stretches of words that repeat with a period, found as squares by a suffix automaton with link-cut access.

The automaton takes one word after the other. Its suffix links form a tree whose paths are cut into segments of
one colour, the last place where the strings of the segment end. Appending a word at place i walks from the new
state to the root, segment by segment, and gives all of it the colour i. A segment of colour c whose longest
string has length m says that the last m words also end at c: if the distance d = i - c is at most m, the last
2 * d words are a square, and the words from i + 1 - m - d on have the period d. It is the smallest period, since
a smaller one would be a later place. A run is such a stretch at its last word.

Each segment is a splay tree ordered by depth, as in link-cut trees, so n words cost O(n log n).

Before that, words that can be in no run are left out, by proof: a run has at least four periods and six words, so
each five words in it stand in it once more, at a distance of at most a quarter of its length. Stretches without
five words that stand again near enough hold no run, and no run reaches over the border of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.frames import columns_of, small_batches, text_key

_GRAM = 5  # words; more would not stand twice in every run of six words


@dataclass(frozen=True)
class Runs:
    min_words: int = 6
    min_periods: int = 4


class _Links:
    """Suffix links as a link-cut tree: left and right in a segment's splay tree, parent, colour at its root."""

    def __init__(self):
        self.left, self.right, self.up, self.colour = [0], [0], [0], [-1]

    def new(self) -> int:
        for part, value in ((self.left, 0), (self.right, 0), (self.up, 0), (self.colour, -1)):
            part.append(value)
        return len(self.left) - 1

    def splay(self, x: int) -> None:
        """Make x the root of the tree of its segment."""
        left, right, up = self.left, self.right, self.up
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                # Twice in one direction turns the upper edge first.
                self._turn(p if (left[g] == p) == (left[p] == x) else x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            left[p] = b = right[x]
            right[x] = p
        else:
            right[p] = b = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                self.colour[x] = self.colour[p]  # the root of the segment's tree has changed
        else:
            self.colour[x] = self.colour[p]

    def above(self, x: int, new: int) -> None:
        """Put ``new`` between x and its parent, into the segment of x."""
        self.splay(x)
        above = self.left[x]
        self.left[new] = above
        if above:
            self.up[above] = new
        self.left[x] = new
        self.up[new] = x


def squares(words: list[int], min_words: int, min_periods: int) -> dict[tuple[int, int], int]:
    """Last word of each run, by start and period."""
    links = _Links()
    left, right, up, colour = links.left, links.right, links.up, links.colour
    longest, link, follow = [0], [0], [{}]
    last = 0
    runs: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words):
        state = links.new()
        longest.append(longest[last] + 1)
        link.append(0)
        follow.append({})
        p = last
        while word not in follow[p]:
            follow[p][word] = state
            if not p:
                break
            p = link[p]
        else:
            q = follow[p][word]
            if longest[p] + 1 < longest[q]:
                copy = links.new()
                longest.append(longest[p] + 1)
                link.append(link[q])
                follow.append(follow[q].copy())
                links.above(q, copy)
                link[q] = copy
                while follow[p].get(word) == q:
                    follow[p][word] = copy
                    if not p:
                        break
                    p = link[p]
                q = copy
            link[state] = q
            up[state] = q
        last = state
        below, x = 0, state
        while x:
            links.splay(x)
            c = colour[x]
            if c >= 0:
                d, m = i - c, longest[x]
                if m >= d * (min_periods - 1) and m + d >= min_words:
                    runs[i + 1 - m - d, d] = i
            lower = right[x]
            if lower:
                colour[lower] = c
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
    return runs


def _near(keys: np.ndarray) -> np.ndarray:
    """Distance of each key to the nearest equal one, or a large number."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    apart = np.where(ordered[1:] == ordered[:-1], order[1:] - order[:-1], 1 << 40)
    near = np.full(len(keys), 1 << 40)
    if len(apart):
        near[order[1:]] = apart
        near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    return near


def stretches(found: h.Words, options: Runs) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches, each within one document, outside of which no run can be."""
    gram = min(_GRAM, options.min_words - 1)
    keys, first = h.windows(found, gram)
    document = found.documents()[first].astype(np.uint64)
    near = _near(h.mix(keys ^ h.mix(document)))
    first, near = first[near < 1 << 40], near[near < 1 << 40]
    while True:
        edge = np.ones(len(first), bool)
        edge[1:] = first[1:] != first[:-1] + 1
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, len(first)))
        words = size + gram - 1
        stay = near * options.min_periods <= np.repeat(words, size)
        stay &= np.repeat(words >= options.min_words, size)
        if stay.all():
            return first[begin], first[begin] + words
        first, near = first[stay], near[stay]


def runs_of(found: h.Words, options: Runs) -> list[list[tuple[int, int, int]]]:
    """Per document its runs as (start, length, period), by start and period; words are counted from 0."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in found.offsets[1:]]
    for a, b in zip(*(x.tolist() for x in stretches(found, options))):
        document = int(np.searchsorted(found.offsets, a, "right")) - 1
        base = a - int(found.offsets[document])
        _, ids = np.unique(found.hashes[a:b], return_inverse=True)
        ends = squares(ids.tolist(), options.min_words, options.min_periods)
        runs[document] += [(base + start, end + 1 - start, period) for (start, period), end in ends.items()]
    return [sorted(x, key=lambda run: (run[0], run[2])) for x in runs]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> str:
    words = text.split()
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words).decode()


def _measure(batches: Iterator[pa.RecordBatch], options: Runs) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        for a, b in h.blocks(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found = h.words(own, at, lower=False)
            runs = runs_of(found, options)
            texts = [own[x:y].tobytes() for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(a, b - a),
                    batch["text_key"].slice(a, b - a),
                    pa.array(np.diff(found.offsets)),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(_RUN)),
                    pa.array([_collapsed(t, x) for t, x in zip(texts, runs)], pa.string()),
                ],
                ["doc_id", "text_key", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, options: Runs = Runs(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, runs and the collapsed text of every row.

    A run is a stretch of words with smallest period q, of at least ``min_words`` words and ``min_periods`` times q,
    that no neighbouring word extends. ``runs`` lists them as (start, length, period), by start and period. The
    collapsed text leaves out what any run contains after its first q words; its words are joined by one space.

    Null and empty texts have no words and no runs; null ids stay null, repeated rows are measured each; an empty
    table gives an empty result, and other columns are ignored. Texts are taken whole: what a task holds grows with
    its longest text, not with the table. Words are compared by 64-bit hashes. No shuffle.
    """
    small_batches(docs.sparkSession)
    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    schema = "doc_id long, text_key long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return given.mapInArrow(lambda batches: _measure(batches, options), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of equal ones the one that starts first, then the smaller period."""

    def before(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        order = F.when(more != 0, more).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(order).cast("int")

    return F.get(F.array_sort(runs, before), F.lit(0))


def periodic(text: Column, doc_id: Column) -> Column:
    """The texts, one in ten with its words repeated from one place on, as the CRC-32 of the id says."""
    hashed = F.crc32(doc_id.cast("string"))
    turn = F.floor(hashed / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size(words).cast("long")
    first = turn % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - first) / (3 + turn % 8)).cast("long")
    turns = F.ceil((n - first) / period).cast("int")
    part = F.slice(words, (first + 1).cast("int"), period.cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(part, turns)), F.lit(1), (n - first).cast("int"))
    whole = F.concat(F.slice(words, F.lit(1), first.cast("int")), repeated)
    return F.when((hashed % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)
