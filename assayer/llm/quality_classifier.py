"""Quality scores from hashed word n-grams, by logistic regression with FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.frames import columns_of, small_batches, smallest_hashes, text_key


@dataclass(frozen=True)
class Classifier:
    bits: int = 18  # of a bucket number
    per_label: int = 4000  # labelled documents of each class that it learns from, by smallest hash of the id
    epochs: int = 3
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    scale: float = 20.0  # the n-grams of a document share this weight


#: Every byte's class for word shapes: letters of either case, digits, other bytes as they are.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _shapes(data: np.ndarray, found: h.Words) -> np.ndarray:
    """Hash of each word with its letters and digits as classes and each run of a class as one."""
    of = _CLASS[data]
    keep = np.ones(len(of), bool)
    keep[1:] = of[1:] != of[:-1]
    keep[found.starts] = True
    place = np.zeros(len(of) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return h.run_hashes(h.mix(of[keep].astype(np.uint64)), place[found.starts], place[found.ends])


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some documents, and each n-gram's document.

    The n-grams are single words and pairs of words, as written in lower case and by their shapes; a pair of
    shapes also tells whether the two words are the same.
    """
    found = h.words(data, offsets, lower=True)
    shapes = _shapes(data, found)
    document = found.documents()
    pair = document[1:] == document[:-1]
    first, second = np.flatnonzero(pair), np.flatnonzero(pair) + 1
    same = (found.hashes[first] == found.hashes[second]).astype(np.uint64)
    kinds = [
        (found.hashes, document),
        (shapes ^ np.uint64(0xA5A5), document),
        (h.mix(found.hashes[first]) ^ found.hashes[second], document[first]),
        (h.mix(shapes[first] + same) ^ shapes[second], document[first]),
    ]
    bucket = [(h.mix(key) >> np.uint64(64 - bits)).astype(np.int64) for key, _ in kinds]
    return np.concatenate(bucket), np.concatenate([d for _, d in kinds])


class Ftrl:
    """Follow-the-regularised-leader state: weights are a function of the sums z and n."""

    def __init__(self, options: Classifier):
        self.options = options
        self.z, self.n = np.zeros((2, (1 << options.bits) + 1))  # the last one is the intercept

    def weights(self, at=slice(None)) -> np.ndarray:
        o, z, n = self.options, self.z[at], self.n[at]
        return np.where(np.abs(z) <= o.l1, 0.0, -(z - np.sign(z) * o.l1) / ((o.beta + np.sqrt(n)) / o.alpha + o.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.options.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _documents(texts: list[str | None], options: Classifier) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text in texts:
        data, offsets = h.buffers(pa.array([text], pa.string()))
        bucket, _ = features(data, offsets, options.bits)
        at, count = np.unique(bucket, return_counts=True)
        x = options.scale * count / max(1, len(bucket))
        yield np.append(at, 1 << options.bits), np.append(x, 1.0)


def train(docs: DataFrame, labels: DataFrame, options: Classifier = Classifier()) -> np.ndarray:
    """Weights learned from the documents that ``labels`` (doc_id, label 0 or 1) marks.

    Learns from at most ``per_label`` documents of each class, those with the smallest hashes of their ids:
    a bounded sample, which one task goes through in the order of those hashes. Rows without id, text or
    label, and labels other than 0 and 1, teach nothing; of repeated ids one row counts. Without any
    example all weights are 0. What reaches the driver is the weights that are not 0.
    """
    marked = labels.select("doc_id", "label").filter("label IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most per_label ids for either label: small enough to send to every task.
    chosen = F.broadcast(smallest_hashes(marked, "label", "doc_id", options.per_label))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    sample = texts.join(chosen, "doc_id").groupBy("doc_id", "label", "turn")
    sample = sample.agg(F.min("text").alias("text")).withColumn("all", F.lit(1))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "doc_id"])
        model = Ftrl(options)
        examples = list(zip(_documents(rows["text"], options), rows["label"]))
        for _ in range(options.epochs):
            for (at, x), label in examples:
                model.learn(at, x, label)
        w = model.weights()
        return pd.DataFrame({"bucket": np.flatnonzero(w), "weight": w[w != 0]})

    learned = sample.groupBy("all").applyInPandas(fit, "bucket long, weight double").toPandas()
    weights = np.zeros((1 << options.bits) + 1)
    weights[learned["bucket"].to_numpy(np.int64)] = learned["weight"]
    return weights


def score(
    docs: DataFrame, weights: np.ndarray, options: Classifier = Classifier(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, text_key, score (0 to 1, higher for label 1) and predicted (1 if score >= 0.5, else 0).

    The score is the logistic function of the sparse dot product of n-gram shares and weights. Null and
    empty texts have only the intercept. One result row per input row, whatever its id; an empty table gives
    an empty result, other columns are ignored. Texts are scored whole. No shuffle.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = h.buffers(batch["text"])
            for a, b in h.blocks(offsets):
                bucket, document = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], options.bits)
                n = np.bincount(document, minlength=b - a)
                total = np.bincount(document, w[bucket], minlength=b - a)
                margin = w[-1] + options.scale * total / np.maximum(n, 1)
                result = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a),
                        batch["text_key"].slice(a, b - a),
                        pa.array(result),
                        pa.array((result >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "text_key", "score", "predicted"],
                )

    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    return given.mapInArrow(run, "doc_id long, text_key long, score double, predicted int")
