"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.frames import columns_of, small_batches, text_key

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_VOCABULARY = 1_000_000  # a larger model is refused: the vocabulary is sent to every executor
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: a character without a piece costs so much more than the worst piece

_SEGMENT = re.compile(" *[^ ]+| +$")


@dataclass
class Vocabulary:
    """Pieces with ids and scores. Pieces have a plain space for the mark, so the mark itself is any character."""

    pieces: dict[str, tuple[int, float]]
    texts: list[bytes]  # of each id, for decoding
    bytes_from: int  # id of the piece of byte 0
    longest: int = 0
    unknown: float = 0.0
    cut_at_spaces: bool = True

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - UNKNOWN_PENALTY
        # No piece goes on across a space: then every path passes the boundary before it.
        self.cut_at_spaces = not any(re.search("[^ ] ", p) for p in self.pieces)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds pieces by their ends: length, score and id. Built in each worker, not sent."""
        found = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            found.add_word(piece, (len(piece), score, i))
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_from + b for b in char.encode())


def read_vocabulary(path: str = PIECE_MODEL) -> Vocabulary:
    """The pieces of a model file with byte pieces; read on the driver."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_VOCABULARY:
        raise ValueError(f"{path} has {n} pieces, more than {MAX_VOCABULARY}")
    pieces, texts, first_byte = {}, [], None
    for i in range(n):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            first_byte = i if first_byte is None else first_byte
            texts.append(bytes([i - first_byte]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            text = text.replace(SPACE_MARK, " ")
            pieces[text] = (i, model.get_score(i))
            texts.append(text.encode())
    if first_byte is None:
        raise ValueError(f"{path} has no byte pieces, so not every text can be encoded")
    return Vocabulary(pieces, texts, first_byte)


def viterbi(chunks: Iterable[str], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of the best segmentation of a stream of characters or longer chunks, as soon as they are certain.

    The best path has the largest sum of scores; among equals the last piece is the longest one. An automaton
    names the pieces that end at each boundary, the longest first, so a boundary is settled when the next
    character comes. Only the characters of pieces still open are kept, and scores and backpointers from the last
    commit on. Later pieces start from the last ``longest`` boundaries; once so many are new, their paths are
    followed back: where they converge, everything before is committed and forgotten.
    """
    longest, unknown, automaton = vocabulary.longest, vocabulary.unknown, vocabulary.automaton
    base = at = checked = 0  # the last commit, the last boundary, and the boundary of the last look back
    score, before, last = [0.0], [0], [0]  # of the boundaries from ``base`` on; a fallback's id is ~ of its character
    tail = ""  # the characters before ``at`` with which a longer piece may begin

    def converged() -> int:
        """The last boundary that the paths of all open boundaries pass."""
        front = set(range(max(base, at - longest + 1), at + 1))
        while len(front) > 1:
            latest = max(front)
            front.discard(latest)
            front.add(before[latest - base])
        return front.pop()

    def path(to: int) -> list[int]:
        ids, p = [], to
        while p > base:
            i = last[p - base]
            ids.extend((i,) if i >= 0 else reversed(vocabulary.fallback(chr(~i))))
            p = before[p - base]
        ids.reverse()
        return ids

    def fall_back(to: int) -> None:
        """The character before boundary ``to`` has no piece: it becomes bytes, if no longer piece is better."""
        p, total, code = to - base, score[to - 1 - base] + unknown, ~ord(window[to - 1 - start])
        if p == len(score):
            score.append(total)
            before.append(to - 1)
            last.append(code)
        elif total > score[p]:
            score[p], before[p], last[p] = total, to - 1, code

    for chunk in chunks:
        window, start = tail + chunk, at - len(tail)
        done, at = at, at + len(chunk)
        here, single = done, True  # the boundary being settled, and whether a piece of one character ends there
        for end, (size, gain, piece) in automaton.iter(window):
            end += start + 1
            if end <= done:
                continue
            if end != here:
                if not single:
                    fall_back(here)
                for gap in range(here + 1, end):
                    fall_back(gap)
                here = end
                score.append(score[end - size - base] + gain)
                before.append(end - size)
                last.append(piece)
            else:
                total = score[end - size - base] + gain
                if total > score[-1]:
                    score[-1], before[-1], last[-1] = total, end - size, piece
            single = size == 1
        if not single:
            fall_back(here)
        for gap in range(here + 1, at + 1):
            fall_back(gap)
        tail = window[1 - longest :] if longest > 1 else ""

        if at - checked >= longest:
            checked, boundary = at, converged()
            if boundary > base:
                yield path(boundary)
                del score[: boundary - base], before[: boundary - base], last[: boundary - base]
                base = boundary
    if at > base:
        yield path(at)


class Encoder:
    """Encodes texts, and remembers segments between boundaries that no piece crosses.

    The memory has two generations: when the young one is full it becomes the old one, whose segments
    return if they are met again. So common segments stay, and the size is bounded.
    """

    MEMORY = 250_000  # segments of a generation
    LONGEST = 64  # characters of a segment to remember
    CHUNK = 4096  # characters given to the search at a time

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _search(self, text: str) -> bytes:
        chunks = (text[i : i + self.CHUNK] for i in range(0, len(text), self.CHUNK))
        return b"".join([array("i", part).tobytes() for part in viterbi(chunks, self.vocabulary)])

    def _segment(self, text: str) -> bytes:
        if len(text) > self.LONGEST:
            return self._search(text)
        if len(self.young) >= self.MEMORY:
            self.old, self.young = self.young, {}
        ids = self.young[text] = self.old.get(text) or self._search(text)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers. A space is put before the text, as the model does."""
        if not text:
            return b""
        text = " " + text
        if not self.vocabulary.cut_at_spaces:
            return self._search(text)
        segment = self._segment
        return b"".join([self.young.get(s) or segment(s) for s in _SEGMENT.findall(text)])

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the ids spell, without the space put before it. Bytes that are no text become U+FFFD."""
        text = b"".join(map(self.vocabulary.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def _encoder(shared, name: str) -> Encoder:
    """One for each worker process, which outlives its tasks."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(shared.value)
    return _encoders[name]


def _share(spark: SparkSession, model: str):
    shared = spark.sparkContext.broadcast(read_vocabulary(model))
    return shared, f"{spark.sparkContext.applicationId}:{model}"


def encode(docs: DataFrame, model: str = PIECE_MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Piece ids of every text: doc_id, text_key, ids (array of int), and whether they decode to the same text.

    The ids are the segmentation with the largest sum of the scores in the model file (for a model that was
    made by merging pairs, this is not the merge order). Characters without a piece become byte pieces.

    Null text: ids and exact are null. Empty text: no ids, exact. One result row per input row, whatever
    its id. An empty table gives an empty result, other columns are ignored. Texts of any length are encoded
    whole; search state is bounded by the longest piece as long as paths meet, which they do at each space.

    No shuffle; the vocabulary (of checked size) is sent to the executors once.
    """
    small_batches(docs.sparkSession)
    shared, name = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            parts, exact = [], []
            for value in batch["text"]:
                value = value.as_py()
                if value is None:
                    parts.append(None)
                    exact.append(None)
                    continue
                ids = encoder.encode(value)
                parts.append(ids)
                exact.append(encoder.decode(memoryview(ids).cast("i")) == value)
            flat = pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32))
            at = np.cumsum([0] + [len(p or b"") // 4 for p in parts]).astype(np.int32)
            offsets = pa.array(at, mask=np.array([p is None for p in parts] + [False]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.ListArray.from_arrays(offsets, flat), pa.array(exact, pa.bool_())],
                ["doc_id", "text_key", "ids", "exact"],
            )

    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    return given.mapInArrow(run, "doc_id long, text_key long, ids array<int>, exact boolean")


def decode(encoded: DataFrame, model: str = PIECE_MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text of every row of ids. Null ids give null; ids outside the vocabulary are an error."""
    small_batches(encoded.sparkSession)
    shared, name = _share(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in (v.as_py() for v in batch["ids"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    given = columns_of(encoded, doc_id=doc_id, ids=ids).withColumn("doc_id", F.col("doc_id").cast("long"))
    return given.mapInArrow(run, "doc_id long, text string")
