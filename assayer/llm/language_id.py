"""Language identification by unigrams of pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.frames import columns_of, small_batches, smallest_hashes, staged, text_key
from assayer.llm.sentence_pieces import PIECE_MODEL, read_vocabulary


@dataclass(frozen=True)
class LanguageId:
    model: str = PIECE_MODEL
    per_language: int = 2000  # labelled documents of each language that it learns from, by smallest hash of the id
    rounds: int = 2  # of expectation and maximisation, from equal probabilities
    smoothing: float = 0.1  # added to the expected count of every piece
    max_languages: int = 500  # more are refused: a table of pieces for each is sent to the executors


UNKNOWN = "und"
_LONG = 48  # characters; longer words are scored one by one


class Pieces:
    """Numbered pieces, and a tree of their characters as a sorted table of steps from node to node.

    The last number stands for any character that is no piece.
    """

    def __init__(self, known: list[str]):
        self.numbers = {p: i for i, p in enumerate(known)}
        self.size, self.longest = len(known) + 1, max(map(len, known))
        nodes, steps = {"": 0}, {}
        for p in known:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    steps[nodes[p[: n - 1]] << 21 | ord(p[n - 1])] = nodes[p[:n]]
        self.steps = np.array(sorted(steps), np.int64)
        self.leads_to = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.piece_at = np.full(len(nodes), -1, np.int64)
        self.piece_at[[nodes[p] for p in known]] = np.arange(len(known))


def read_pieces(model: str) -> Pieces:
    """Pieces as they occur in lower-cased words, a word being led by a space."""
    return Pieces(sorted(p for p in read_vocabulary(model).pieces if p.strip()))


@dataclass
class Lattice:
    """Every place where a piece fits: word, start and end in it, piece. Each single character has one."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    length: np.ndarray  # of each word


def lattice(words: list[str], pieces: Pieces) -> Lattice:
    """All words walk down the tree together, from each of their characters, one character at a time."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.array([len(w) for w in words])
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(length) - length, length)
    left = length[word] - place
    begin, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    for n in range(1, pieces.longest + 1):
        step = node << 21 | chars[begin + n - 1]
        at = np.searchsorted(pieces.steps, step).clip(max=len(pieces.steps) - 1)
        there = pieces.steps[at] == step
        begin, node = begin[there], pieces.leads_to[at[there]]
        piece = pieces.piece_at[node]
        hit = piece >= 0
        found.append((begin[hit], n, piece[hit]))
        if n == 1:
            other = np.ones(len(chars), bool)
            other[begin[hit]] = False
            rest = np.flatnonzero(other)
            found.append((rest, 1, np.full(len(rest), pieces.size - 1)))
        more = left[begin] > n
        begin, node = begin[more], node[more]
    begin = np.concatenate([b for b, _, _ in found])
    size = np.concatenate([np.full(len(b), n) for b, n, _ in found])
    piece = np.concatenate([x for _, _, x in found])
    return Lattice(word[begin], place[begin], place[begin] + size, piece, length)


def _sum_paths(graph: Lattice, weight: np.ndarray, backward: bool = False) -> np.ndarray:
    """Per word, position and language, the summed weight of all segmentations up to (or from) there.

    Positions are settled in order, and pieces of one length at a time, so that a word has one piece in each
    step. Words are short enough for plain products: their probabilities stay above 1e-300.
    """
    total = np.zeros((len(graph.length), int(graph.length.max()) + 1, weight.shape[1]))
    total[np.arange(len(graph.length)), graph.length if backward else 0] = 1
    source, target = (graph.end, graph.start) if backward else (graph.start, graph.end)
    step = ((total.shape[1] - target if backward else target) << 8) | (graph.end - graph.start)
    order = np.argsort(step.astype(np.int16), kind="stable")
    bounds = np.flatnonzero(np.diff(step[order], prepend=-1, append=-1))
    for a, b in zip(bounds, bounds[1:]):
        e = order[a:b]
        total[graph.word[e], target[e[0]]] += total[graph.word[e], source[e[0]]] * weight[e]
    return total


def _long_word(word: str, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """log probability of one word of any length: the same sums, scaled at every position."""
    alphas, log = [np.ones(probability.shape[1])], np.zeros(probability.shape[1])
    numbers, longest, other = pieces.numbers, pieces.longest, pieces.size - 1
    for j in range(1, len(word) + 1):
        total = np.zeros(probability.shape[1])
        for i in range(max(0, j - longest), j):
            found = numbers.get(word[i:j], other if i == j - 1 else None)
            if found is not None:
                total += alphas[i - j] * probability[found]
        log += np.log(total)
        alphas = [a / total for a in alphas[-longest:]] + [np.ones_like(total)]
    return log


def log_probabilities(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """log probability of each word, which a space leads, in each language."""
    out = np.zeros((len(words), probability.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= _LONG]
    if short:
        graph = lattice([words[i] for i in short], pieces)
        total = _sum_paths(graph, probability[graph.piece])
        out[short] = np.log(total[np.arange(len(short)), graph.length])
    for i in range(len(words)):
        if len(words[i]) > _LONG:
            out[i] = _long_word(words[i], pieces, probability)
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words, each word taken weights times."""
    counts = np.zeros(pieces.size)
    for w, n in zip(words, weights):
        if len(w) > _LONG:
            _count_long(w, n, pieces, probability, counts)
    keep = [i for i, w in enumerate(words) if len(w) <= _LONG]
    words, weights = [words[i] for i in keep], weights[keep]
    if not words:
        return counts
    graph = lattice(words, pieces)
    p = probability[graph.piece, None]
    forward, backward = _sum_paths(graph, p)[..., 0], _sum_paths(graph, p, backward=True)[..., 0]
    k = graph.word
    share = forward[k, graph.start] * p[:, 0] * backward[k, graph.end] / forward[k, graph.length[k]]
    return counts + np.bincount(graph.piece, share * weights[k], minlength=pieces.size)


def _count_long(word: str, weight: float, pieces: Pieces, probability: np.ndarray, counts: np.ndarray) -> None:
    """Add the expected counts of one word of any length, by the same sums in logarithms."""
    numbers, other, n = pieces.numbers, pieces.size - 1, len(word)
    log = np.log(probability).tolist()
    fits: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # by end: start and piece
    for start in range(n):
        for end in range(start + 1, min(n, start + pieces.longest) + 1):
            found = numbers.get(word[start:end], other if end == start + 1 else None)
            if found is not None:
                fits[end].append((start, found))
    forward, backward = [0.0] * (n + 1), [-np.inf] * n + [0.0]
    for end in range(1, n + 1):
        terms = [forward[start] + log[piece] for start, piece in fits[end]]
        most = max(terms)
        forward[end] = most + np.log(sum(np.exp(t - most) for t in terms))
    for end in range(n, 0, -1):
        for start, piece in fits[end]:
            backward[start] = float(np.logaddexp(backward[start], backward[end] + log[piece]))
            counts[piece] += weight * np.exp(forward[start] + log[piece] + backward[end] - forward[n])


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [" " + raw[a:b].lower().decode() for a, b in zip(starts.tolist(), ends.tolist())]


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # of pieces by languages
    options: LanguageId


def train(docs: DataFrame, options: LanguageId = LanguageId()) -> Model:
    """Piece probabilities of every language from ``docs`` (doc_id, text, lang).

    A bounded sample teaches: per language the ``per_language`` documents with the smallest hashes of
    their ids. Rows without id, text or lang teach nothing. The sample is staged; each round is one pass
    over it, in which every task sums expected piece counts and sends at most one row per language and piece.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = read_pieces(options.model)
    usable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    languages = [r.lang for r in usable.select("lang").distinct().limit(options.max_languages + 1).collect()]
    languages = sorted(languages)
    if len(languages) > options.max_languages:
        raise ValueError(f"more than {options.max_languages} languages")
    chosen = smallest_hashes(usable.select("doc_id", "lang").distinct(), "lang", "doc_id", options.per_language)
    chosen = chosen.select("doc_id", "lang")
    # At most per_language ids for each of the counted languages: small enough to send to every task.
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    sample = staged(sample.repartition(spark.sparkContext.defaultParallelism), "languages")
    probability = np.full((pieces.size, len(languages)), 1 / pieces.size)
    shared_pieces = spark.sparkContext.broadcast(pieces)
    for _ in range(options.rounds if languages else 0):
        shared = spark.sparkContext.broadcast(probability)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, now = shared_pieces.value, shared.value
            counts = np.zeros_like(now)
            for batch in batches:
                data, offsets = h.buffers(batch["text"])
                lang = np.searchsorted(languages, batch["lang"].to_pylist())
                for a, b in h.blocks(offsets):
                    own = data[offsets[a] : offsets[b]]
                    found = h.words(own, offsets[a : b + 1] - offsets[a], lower=True)
                    of = lang[a:b][found.documents()]
                    for k in np.unique(of):
                        mine = np.flatnonzero(of == k)
                        _, at, n = np.unique(found.hashes[mine], return_index=True, return_counts=True)
                        at = mine[at]
                        words = _texts(own, found.starts[at], found.ends[at])
                        counts[:, k] += expected_counts(words, n, known, now[:, k])
            piece, k = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int64)), pa.array(piece.astype(np.int64)), pa.array(counts[piece, k])],
                ["language", "piece", "n"],
            )

        sums = sample.mapInArrow(expect, "language long, piece long, n double").groupBy("language", "piece")
        learned = sums.agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((pieces.size, len(languages)), options.smoothing)
        counts[learned["piece"], learned["language"]] += learned["n"]
        probability = counts / counts.sum(axis=0)
    return Model(languages, np.log(probability), options)


class _Scorer:
    """Scores of words, remembered by their hashes in a sorted table."""

    MEMORY = 1_000_000

    def __init__(self, model: Model, pieces: Pieces):
        self.pieces, self.probability = pieces, np.exp(model.log_probability)
        self.hashes = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(model.languages)))

    def of(self, data: np.ndarray, found: h.Words) -> np.ndarray:
        keys, at, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == keys[inside]
        scores = np.empty((len(keys), self.scores.shape[1]))
        scores[known] = self.scores[place[known]]
        new = at[~known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            texts = _texts(data, found.starts[part], found.ends[part])
            scores[np.flatnonzero(~known)[i : i + 20_000]] = log_probabilities(texts, self.pieces, self.probability)
        if len(self.hashes) + len(new) > self.MEMORY:
            self.hashes, self.scores = keys, scores
        elif len(new):
            self.hashes = np.insert(self.hashes, place[~known], keys[~known])
            self.scores = np.insert(self.scores, place[~known], scores[~known], axis=0)
        return scores[back]


_scorers: dict[str, _Scorer] = {}


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, lang_pred and score (the language's share of the summed probabilities, 0 to 1).

    Words are lower-cased (A-Z). The probability of a word in a language is the sum, over all ways to cut it
    into pieces, of the product of the pieces' probabilities (forward algorithm); that of a text is the
    product over its words, all languages being equally likely before. Ties go to the first language name.

    Null texts and texts without a letter: ``und`` with score 0, as for every text if nothing was learned. One
    result row per input row, whatever its id; an empty table gives an empty result, other columns are
    ignored. Texts are scored whole. No shuffle; the tables of pieces are sent to the executors once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, read_pieces(model.options.model)))
    name = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = _Scorer(*shared.value)
        scorer, languages = _scorers[name], np.array([*shared.value[0].languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = h.buffers(batch["text"])
            letters = np.array([any(map(str.isalpha, t.as_py() or "")) for t in batch["text"]], bool)
            for a, b in h.blocks(offsets):
                own = data[offsets[a] : offsets[b]]
                found = h.words(own, offsets[a : b + 1] - offsets[a], lower=True)
                best, share = np.full(b - a, len(languages) - 1), np.zeros(b - a)
                if len(languages) > 1 and len(found.hashes):
                    of_word, document = scorer.of(own, found), found.documents()
                    total = np.stack([np.bincount(document, s, minlength=b - a) for s in of_word.T], axis=1)
                    likely = np.exp(total - total.max(axis=1, keepdims=True))
                    known = letters[a:b]
                    best = np.where(known, likely.argmax(axis=1), best)
                    share = np.where(known, 1 / likely.sum(axis=1), share)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a),
                        batch["text_key"].slice(a, b - a),
                        pa.array(languages[best], pa.string()),
                        pa.array(share),
                    ],
                    ["doc_id", "text_key", "lang_pred", "score"],
                )

    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    return given.mapInArrow(run, "doc_id long, text_key long, lang_pred string, score double")
