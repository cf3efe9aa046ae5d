"""Toxicity from two Kneser-Ney models of byte n-grams, one per class, over shared backoff counts.

``P(byte | n-1 bytes before)`` is, for the toxic and for the ordinary documents, the discounted share of that
class's own counts, backed off to one shared model: Kneser-Ney continuation counts of all documents, labelled or
not, down to single bytes. An n-gram counts once per document, so copies within a text weigh nothing. A text is
judged by the difference of the two log-likelihoods per byte, over the whole text and over its worst few bytes;
a logistic function, fitted on held-back labelled documents, turns both into a score.

The counts of all documents are one table of Spark, keyed by the n bytes themselves. Texts are read once to count
and once to score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.frames import columns_of, if_small, small_batches, smallest_hashes, staged, text_key, with_row_ids


@dataclass(frozen=True)
class KneserNey:
    order: int = 5  # bytes; at most 7, so that an n-gram and its length of history fit a long
    window: int = 16  # bytes of the worst place
    discount: float = 2.0  # of the documents of a class that hold an n-gram; so rare ones are left to the shared counts
    held_back: int = 5  # one in so many labelled documents also serves to fit the score
    per_label: int = 2000  # of the held-back documents of each class, by smallest hash of the id
    threshold: float = 0.3
    #: Up to so many n-grams and histories (12 bytes each) the model goes to every task; beyond, n-grams of texts join it.
    small_model: int = 4_000_000


#: Counts in a task are written out when they reach so many rows.
_FLUSH = 2_000_000
_U = np.uint64


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with each run of spaces as one, with order - 1 spaces before and one after each."""
    space = h.SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True  # a space that begins a text is none of the text before
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    kept = np.where(space, 32, _lowered(data))[keep].astype(np.uint8)
    at = place[offsets]
    n = len(offsets) - 1
    out = np.full(len(kept) + n * order, 32, np.uint8)
    document = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(kept)) + (document + 1) * order - 1] = kept
    return out, at + np.arange(n + 1) * order


def ngrams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some texts as numbers, and where each text's begin."""
    padded, at = _padded(data, offsets, order)
    n = max(0, len(padded) - order + 1)
    keys = np.zeros(n, _U)
    for i in range(order):
        keys = (keys << _U(8)) | padded[i : i + n].astype(_U)
    inside = np.ones(len(padded), bool)  # an n-gram that begins here ends in the same text
    ends = at[1:, None] - 1 - np.arange(order - 1)
    inside[ends.ravel()] = False
    sizes = np.diff(at) - (order - 1)
    return keys[inside[:n]].view(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Documents per n-gram and class, summed up within the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in held])
        unique, inverse = np.unique(codes, return_inverse=True)
        return unique, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(codes >> 3), pa.array((codes & 7).astype(np.int32)), pa.array(counts)], ["gram", "kind", "n"]
        )

    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        kinds = batch["kind"].to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in h.blocks(offsets):
            keys, at = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
            codes = []
            for i in range(b - a):
                codes.append(np.unique(keys[at[i] : at[i + 1]]) << 3 | kinds[a + i])
            held.append(np.unique(np.concatenate(codes), return_counts=True))
        if sum(len(c) for c, _ in held) > _FLUSH:
            held = [summed()]
            if len(held[0][0]) > _FLUSH // 2:
                yield rows(*held.pop())
    if held:
        yield rows(*summed())


def _low(column: str, n: int):
    """The last n bytes of an n-gram."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _discount(counts: DataFrame) -> float:
    """n1 / (n1 + 2 n2), n1 and n2 being how many of the counts ``n`` are 1 and 2."""
    once, twice = counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    return min(max(once / max(1, once + 2 * twice), 0.1), 0.95)


def _history(column: str = "gram") -> Window:
    # At most 256 n-grams share a history.
    return Window.partitionBy(F.shiftright(column, 8))


def _shared(grams: DataFrame, order: int) -> DataFrame:
    """(low, shared): probability of the last byte of each n-gram's last order - 1 bytes, by continuation counts."""
    levels, current = {}, grams.select("gram")
    # Each level is written: else the plan of the last would hold all levels many times, and the driver with it.
    for k in range(order - 1, 0, -1):
        current = staged(current.groupBy(_low("gram", k).alias("gram")).agg(F.count("*").alias("n")), f"toxic-level{k}")
        levels[k] = current
        current = current.select("gram")
    whole = Window.partitionBy()  # at most 256 rows
    d = 0.75
    first = levels[1].withColumn("all", F.sum("n").over(whole)).withColumn("kinds", F.count("*").over(whole))
    share = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") / 256
    lower = first.select(F.col("gram").alias("low"), share.alias("shared"))
    for k in range(2, order):
        level = levels[k]
        d = _discount(level)
        total, kinds = F.sum("n").over(_history()), F.count("*").over(_history())
        level = level.withColumn("total", total).withColumn("kinds", kinds).join(lower, _low("gram", k - 1) == F.col("low"))
        share = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + d * F.col("kinds") / F.col("total") * F.col("shared")
        lower = staged(level.select(F.col("gram").alias("low"), share.alias("shared")), f"toxic-shared{k}")
    return lower


def _ratios(counts: DataFrame, shared: DataFrame, toxic: str, ordinary: str, options: KneserNey) -> DataFrame:
    """(gram, ratio): log-likelihood ratio per n-gram seen in either class, and, as -1 - history, where it was not."""
    d = options.discount
    seen = counts.select("gram", F.col(toxic).alias("toxic"), F.col(ordinary).alias("ordinary")).filter("toxic + ordinary > 0")
    given = seen.join(shared, _low("gram", options.order - 1) == F.col("low")).drop("low")
    likelihood, rest = {}, {}
    for c in ("toxic", "ordinary"):
        total, taken = F.sum(c).over(_history()), F.sum(F.least(F.col(c), F.lit(d))).over(_history())
        given = given.withColumn(f"{c}_total", total).withColumn(f"{c}_rest", F.when(total > 0, taken / total).otherwise(1.0))
        own = F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
        likelihood[c] = own + F.col(f"{c}_rest") * F.col("shared")
        rest[c] = F.col(f"{c}_rest")
    model = given.select("gram", F.log(likelihood["toxic"] / likelihood["ordinary"]).alias("ratio"),
                         F.log(rest["toxic"] / rest["ordinary"]).alias("unseen"))
    unseen = model.groupBy((-1 - F.shiftright("gram", 8)).alias("gram")).agg(F.any_value("unseen").alias("ratio"))
    return model.select("gram", "ratio").union(unseen)


class _Lookup:
    """Ratios by key: one key per slot of a table of powers of two, the others by binary search."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self._fill(keys[order], ratios[order].astype(np.float32))

    @classmethod
    def sorted(cls, keys: np.ndarray, ratios: np.ndarray) -> _Lookup:
        """Of keys in order."""
        self = cls.__new__(cls)
        self._fill(keys, ratios)
        return self

    def _fill(self, keys: np.ndarray, ratios: np.ndarray) -> None:
        self.keys, self.ratios = keys, ratios
        self.shift = _U(64 - max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        self.slots = np.full(1 << int(64 - int(self.shift)), -1, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratio (0 if there is none) and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        at = self.slots[self._slot(keys)]
        hit = self.keys[at] == keys
        hit &= at >= 0
        other = np.flatnonzero((at >= 0) & ~hit)  # the slot holds another key
        if len(other):
            place = np.searchsorted(self.keys, keys[other]).clip(max=len(self.keys) - 1)
            same = self.keys[place] == keys[other]
            at[other[same]] = place[same]
            hit[other[same]] = True
        return np.where(hit, self.ratios[at], np.float32(0)), hit

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Ratio of each n-gram: its own, else its history's, else 0."""
        found, hit = self.find(grams)
        missing = np.flatnonzero(~hit)
        if len(missing):
            found[missing] = self.find(-1 - (grams[missing] >> 8))[0]
        return found


class _Packed:
    """Keys in order and their ratios, as they are sent to the tasks; each process makes its slots once."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        self.keys, self.ratios, self.made = keys, ratios, None

    def lookup(self) -> _Lookup:
        if self.made is None:
            self.made = _Lookup.sorted(self.keys, self.ratios)
        return self.made


def _features(ratios: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean ratio, and the greatest mean of ``window`` neighbours (of all, if there are fewer)."""
    total = np.zeros(len(ratios) + 1)
    np.cumsum(ratios, out=total[1:])
    n = np.diff(at)
    mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
    worst = mean.copy()
    long = np.flatnonzero(n > window)
    for i in long:
        a, b = at[i], at[i + 1]
        worst[i] = (total[a + window : b + 1] - total[a : b + 1 - window]).max() / window
    return mean, worst


def _measured(docs: DataFrame, ratios: DataFrame, options: KneserNey) -> DataFrame:
    """doc_id, text_key, other given columns, mean and worst of each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    order, window = options.order, options.window
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", mean double, worst double"

    def results(batch: pa.RecordBatch, a: int, ends: np.ndarray, found: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n = len(ends) - 1
        mean, worst = (np.where(np.diff(ends) == 0, 0.0, x) for x in _features(found, at, window))
        return pa.RecordBatch.from_arrays([*(batch[c].slice(a, n) for c in names), pa.array(mean), pa.array(worst)], [*names, "mean", "worst"])

    if ratios.count() <= options.small_model:
        # Counted: at most small_model rows, of 12 bytes. The driver makes no slots.
        table = ratios.select("gram", F.col("ratio").cast("float").alias("ratio")).toArrow()
        keys = table["gram"].to_numpy()
        in_order = np.argsort(keys)
        shared = spark.sparkContext.broadcast(_Packed(keys[in_order], table["ratio"].to_numpy()[in_order]))
        del table, keys, in_order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value.lookup()
            for batch in batches:
                data, offsets = h.buffers(batch["text"])
                for a, b in h.blocks(offsets):
                    ends = offsets[a : b + 1] - offsets[a]
                    grams, at = ngrams(data[offsets[a] : offsets[b]], ends, order)
                    yield results(batch, a, ends, model.of(grams), at)

        return docs.mapInArrow(run, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = h.buffers(batch["text"])
            for i, row in enumerate(batch["row_id"].to_pylist()):
                grams, _ = ngrams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), order)
                grams = np.unique(grams)
                both = np.concatenate([grams, np.unique(-1 - (grams >> 8))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), row)), pa.array(both)], ["row_id", "own"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = h.buffers(batch["text"])
            for i, (keys, values) in enumerate(zip(batch["grams"], batch["ratios"])):
                ends = offsets[i : i + 2] - offsets[i]
                grams, at = ngrams(data[offsets[i] : offsets[i + 1]], ends, order)
                keys, values = (np.array(x.as_py() or [], kind) for x, kind in ((keys, np.int64), (values, float)))
                yield results(batch, i, ends, _Lookup(keys, values).of(grams), at)

    numbered = staged(with_row_ids(docs), "toxic-rows")
    pairs = numbered.select("row_id", "text").mapInArrow(listed, "row_id long, own long")
    found = (
        pairs.join(ratios, F.col("own") == F.col("gram"))
        .groupBy(F.col("row_id").alias("found_row"))
        .agg(F.collect_list("gram").alias("grams"), F.collect_list("ratio").alias("ratios"))
    )
    return numbered.join(found, F.col("row_id") == F.col("found_row"), "left").mapInArrow(joined, schema)


@dataclass(frozen=True)
class Model:
    ratios: DataFrame  # gram, ratio
    weights: tuple[float, float, float]  # of 1, the mean, and the worst place
    options: KneserNey


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> list[float]:
    """Weights of 1 and the columns of x by Newton's steps, slightly drawn to 0; the share alone without both classes."""
    prior = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return [prior, 0.0, 0.0]
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(x)), x / scale])
    w, pull = np.array([prior, 0.0, 0.0]), np.array([1e-6, 0.1, 0.1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (w / np.append(1.0, scale)).tolist()


def train(docs: DataFrame, labels: DataFrame, options: KneserNey = KneserNey()) -> Model:
    """Counts n-grams of all ``docs`` (doc_id, text), by class where ``labels`` (doc_id, label 0 or 1) names one.

    All labelled documents are counted. One in ``held_back`` of them is also left out once, and up to ``per_label``
    of these of each class, a bounded sample, are scored by the model without them to fit the score. Rows without
    id or label are only counted as shared; of repeated ids with two labels 1 counts. Without held-back examples
    of both classes the score is the share of label 1, half a document of 5 more.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("marked"), "label").filter("label IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.groupBy("marked").agg(F.max("label").alias("label"))
    back = F.pmod(F.xxhash64("marked", F.lit(7)), F.lit(options.held_back)) == 0
    kind = F.col("label") + 1 + F.when(back, 2).otherwise(0)
    marked = staged(marked.withColumn("kind", kind.cast("int")), "marked")
    given = columns_of(docs, doc_id="doc_id", text="text")
    known = given.join(if_small(marked), F.col("doc_id") == F.col("marked"), "left")
    order = options.order
    counted = known.select("text", F.coalesce("kind", F.lit(0)).alias("kind")).mapInArrow(
        lambda batches: _count(batches, order), "gram long, kind int, n long"
    )
    total = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    counts = staged(
        counted.groupBy("gram").agg(
            total(1, 3).alias("ordinary"), total(2, 4).alias("toxic"), total(1).alias("ordinary_part"), total(2).alias("toxic_part")
        ),
        "toxic-counts",
    )
    shared = _shared(counts, order)
    part = staged(_ratios(counts, shared, "toxic_part", "ordinary_part", options), "toxic-part")
    chosen = smallest_hashes(marked.filter("kind > 2").select("marked", "label"), "label", "marked", options.per_label)
    chosen = F.broadcast(chosen.select("marked", "label"))  # at most per_label ids for either label
    sample = given.filter("text IS NOT NULL").join(chosen, F.col("doc_id") == F.col("marked")).select("text", "label")
    fitted = _measured(staged(sample, "toxic-sample"), part, options).toPandas()
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    weights = _logistic(fitted[["mean", "worst"]].to_numpy(float), fitted["label"].to_numpy(float), (toxic + 0.5) / (n + 5))
    return Model(staged(_ratios(counts, shared, "toxic", "ordinary", options), "toxic-model"), tuple(weights), options)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, score (0 to 1, higher for label 1) and predicted (1 from the threshold on, else 0).

    Null and empty texts have only the intercept. One result row per input row, whatever its id; an empty table
    gives an empty result, other columns are ignored. Texts are scored whole. While the model is small no text is
    shuffled; else each text's n-grams are joined to it.
    """
    small_batches(docs.sparkSession)
    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    one, mean, worst = model.weights
    margin = F.lit(one) + mean * F.col("mean") + worst * F.col("worst")
    result = 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(35.0)), F.lit(-35.0))))
    measured = _measured(given, model.ratios, model.options)
    predicted = (F.col("score") >= model.options.threshold).cast("int")
    return measured.select("doc_id", "text_key", result.alias("score")).withColumn("predicted", predicted)
