"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import hashing as h
from assayer.llm.components import components
from assayer.llm.frames import columns_of, if_small, rows_in, small_batches, staged, text_key, with_row_ids

PERMUTATIONS = 160
SIGNED = 128  # minima whose low bits are kept
LOW_BITS = 2
_PLANES = LOW_BITS * SIGNED // 64


@dataclass(frozen=True)
class NearDedup:
    shingle: int = 5
    similarity_pct: int = 80
    rows: int = 5  # minima in a band: 32 bands lose a pair at 0.80 with probability 3e-6, at 0.85 with 7e-9
    sigmas: float = 6.0  # how far below the threshold an estimate must lie to rule a pair out

    @property
    def least_estimate(self) -> float:
        """A pair at the threshold is estimated below this with probability 1e-9."""
        chance = 1 / 2**LOW_BITS
        p = chance + (1 - chance) * self.similarity_pct / 100
        return self.similarity_pct / 100 - self.sigmas * sqrt(p * (1 - p) / SIGNED) / (1 - chance)


_A = (h.mix(np.arange(PERMUTATIONS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (h.mix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(7919)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; one of all its words if they are fewer than ``size``."""
    found = h.words(data, offsets, lower=True)
    keys, first = h.windows(found, size)
    counts = np.diff(found.offsets)
    at = np.searchsorted(first, found.offsets)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = h.run_hashes(found.hashes, found.offsets[short], found.offsets[short + 1])
    sets = [np.unique(keys[a:b]) for a, b in zip(at, at[1:])]
    for i, key in zip(short, whole):
        sets[i] = np.array([key])
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each set under each permutation; a row per set, none of which may be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(flat * a + b, starts) for a, b in zip(_A, _B)], axis=1)


def _bands(least: np.ndarray, rows: int) -> np.ndarray:
    bands = PERMUTATIONS // rows
    key = np.broadcast_to(h.mix(np.arange(bands, dtype=np.uint64)), (len(least), bands))
    for i in range(rows):
        key = h.mix(key ^ least[:, i : bands * rows : rows].astype(np.uint64))
    return key


def _planes(least: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima: plane by plane, 64 minima to an integer."""
    low = h.mix(least[:, :SIGNED].astype(np.uint64))
    bits = np.concatenate([(low >> np.uint64(i)) & np.uint64(1) for i in range(LOW_BITS)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


_SCHEMA = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(
    f"plane{i} long" for i in range(_PLANES)
)


def _sign(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    n_bands = PERMUTATIONS // rows
    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        for a, b in h.blocks(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            keys, planes = np.zeros((b - a, n_bands), np.uint64), np.zeros((b - a, _PLANES), np.uint64)
            sums = np.zeros((2, b - a), np.uint64)
            if len(some):
                filled = [sets[i] for i in some]
                least = minima(filled)
                keys[some], planes[some] = _bands(least, rows), _planes(least)
                flat, starts = np.concatenate(filled), np.cumsum([0, *sizes[some][:-1]])
                for k in range(2):
                    sums[k, some] = np.add.reduceat(h.mix(flat ^ np.uint64(0x5851F42D4C957F2D * k)), starts)
            at = np.cumsum([0, *np.where(sizes > 0, n_bands, 0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(a, b - a),
                    batch["text_key"].slice(a, b - a),
                    pa.array(sizes),
                    *(pa.array(x.view(np.int64)) for x in sums),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel().view(np.int64))),
                    *(pa.array(np.ascontiguousarray(planes[:, i]).view(np.int64)) for i in range(_PLANES)),
                ],
                [x.split()[0] for x in _SCHEMA.split(",")],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = h.buffers(batch["text"])
        for a, b in h.blocks(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["vertex"].slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), flat)], ["vertex", "shingles"]
            )


def _estimate(a: str, b: str) -> Column:
    """Similarity from the minima whose low bits all agree, less the agreement expected by chance."""
    differ = []
    for word in range(SIGNED // 64):
        bits = None
        for bit in range(LOW_BITS):
            name = f"plane{bit * (SIGNED // 64) + word}"
            other = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
            bits = other if bits is None else bits.bitwiseOR(other)
        differ.append(F.bit_count(bits))
    agree = 1 - sum(differ[1:], differ[0]) / F.lit(SIGNED)
    chance = 1 / 2**LOW_BITS
    return (agree - chance) / (1 - chance)


def _worth_checking(a: str, b: str, options: NearDedup) -> Column:
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= options.similarity_pct * F.greatest(n, m)) & (
        _estimate(a, b) >= options.least_estimate
    )


def _links(pairs: DataFrame, sets: DataFrame, options: NearDedup) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    union = F.size("x.shingles") + F.size("y.shingles") - common
    return (
        pairs.join(sets.alias("x"), F.col("a") == F.col("x.vertex"))
        .join(sets.alias("y"), F.col("b") == F.col("y.vertex"))
        .filter(100 * common >= options.similarity_pct * union)
        .select("a", "b")
    )


def _enough(common: Column, n: Column, m: Column, options: NearDedup) -> Column:
    """Whether sets of n and m shingles are similar enough if they have so many in common."""
    return (100 + options.similarity_pct) * common >= options.similarity_pct * (n + m)


def _rare_shingles(vertices: DataFrame, sets: DataFrame, options: NearDedup) -> DataFrame:
    """For each vertex the shingles of which similar vertices share one, with ``place``.

    A vertex's shingles are put in order, those of the fewest vertices first. Sets of n shingles that are
    similar enough differ in so few that one of the first n - ceil(n * similarity) + 1 is common; and if the
    first common one has the places i and j, no more than the lesser of n - i and m - j are. Shingles that no
    other vertex has only shift the places. Both rules are exact.
    """
    each = sets.join(vertices.select("vertex"), "vertex").select("vertex", F.explode("shingles").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    common = each.join(spread, "shingle").groupBy("vertex").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common")
    )
    n, alone = F.col("n_shingles"), F.col("n_shingles") - F.size("common")
    first = n - F.ceil(options.similarity_pct * n / 100) + 1 - alone
    rare = F.slice("common", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    return (
        vertices.join(common, "vertex")
        .select(vertices.columns + [alone.alias("alone"), F.posexplode(rare).alias("place", "rare")])
        .withColumn("place", F.col("place") + F.col("alone"))
        .withColumn("shingle", F.col("rare.shingle"))
        .drop("alone", "rare")
    )


def near_duplicates(
    docs: DataFrame, options: NearDedup = NearDedup(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Groups of documents that chains of similar pairs connect, confirmed on full shingle sets.

    Words are runs of other than ASCII white space, A-Z lower-cased. A document's set holds its distinct
    shingles, or its whole word sequence if that is shorter than a shingle. Two documents are linked if
    100 * common >= similarity_pct * all of their sets.

    Result: one row per input row with doc_id, text_key, n_shingles, component_id (the smallest doc_id that
    links reach) and kept (doc_id = component_id).

    Null and empty texts have no shingles and are linked with nothing. Rows with one id are documents of
    their own that share the id; a row without id can be linked, is never the smallest, and is kept only if no
    document of its group has an id (component_id is null then). An empty table gives an empty result, other
    columns are ignored. Texts are read whole; there is no cap on buckets, pairs or groups.

    Documents with the same set are one vertex, so thousands of copies cost one row. In each bucket of equal
    band hashes every vertex is first compared with one hub, the vertex with the most company in all its buckets:
    in a large group of near copies that is the original, which is nearer to each copy than they are to each
    other, so the group is joined with few pairs. Only the vertices of buckets that then still hold several
    components are compared further: pairs across components that share a rare shingle. Within that join, an exact
    bound on common shingles and the bit counts of the packed signatures rule pairs out.
    """
    small_batches(docs.sparkSession)
    size, rows = options.shingle, options.rows
    given = columns_of(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")
    )
    signed = staged(with_row_ids(given.mapInArrow(lambda x: _sign(x, size, rows), _SCHEMA)), "signatures")
    same_set = ("set_a", "set_b", "n_shingles")
    classes = staged(
        signed.filter("n_shingles > 0")
        .groupBy(*same_set)
        .agg(F.min("row_id").alias("vertex"), F.min("doc_id").alias("first_doc")),
        "classes",
    )
    planes = [f"plane{i}" for i in range(_PLANES)]
    vertices = signed.join(classes.select("vertex"), F.col("row_id") == F.col("vertex")).select(
        "vertex", "doc_id", "text_key", "n_shingles", "bands", *planes
    )
    buckets = vertices.select("vertex", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    in_shared = staged(buckets.join(shared, "band"), "shared-buckets")
    company = in_shared.groupBy("vertex").agg(F.sum("n").alias("company"))
    ranked = in_shared.join(company, "vertex").select("band", "vertex", "company")
    centre = ranked.groupBy("band").agg(F.max("company").alias("most"))
    hubs = (
        ranked.join(centre, "band")
        .filter(F.col("company") == F.col("most"))
        .groupBy("band")
        .agg(F.min("vertex").alias("hub"))
    )
    members = staged(in_shared.select("band", "vertex").join(hubs, "band"), "members")
    candidates = staged(
        members.select("vertex").distinct().join(vertices.drop("bands"), "vertex"),
        "candidates",
    )
    wanted = given.alias("d").join(
        if_small(candidates.select("vertex", "doc_id", "text_key")).alias("c"),
        F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")),
    )
    sets = staged(
        wanted.select("vertex", "text").mapInArrow(lambda x: _sets(x, size), "vertex long, shingles array<long>")
        .dropDuplicates(["vertex"]),
        "sets",
    )
    near = candidates.select("vertex", "n_shingles", *planes)
    to_hub = members.filter("vertex <> hub").select(F.col("hub").alias("a"), F.col("vertex").alias("b")).distinct()
    checked = (
        to_hub.join(near.alias("x"), F.col("a") == F.col("x.vertex"))
        .join(near.alias("y"), F.col("b") == F.col("y.vertex"))
        .filter(_worth_checking("x", "y", options))
        .select("a", "b")
    )
    links = staged(_links(checked, sets, options), "hub-links")
    labels = components(links)

    grouped = members.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    still = grouped.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    still = still.filter("least < most").select("band")
    rest = grouped.filter("vertex <> hub").join(still, "band").select("vertex", "label").distinct()
    rare = staged(_rare_shingles(rest.join(near, "vertex"), sets, options), "rare")
    most = F.least(F.col("x.n_shingles") - F.col("x.place"), F.col("y.n_shingles") - F.col("y.place"))
    across = (
        rare.alias("x")
        .join(
            rare.alias("y"),
            (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.label") < F.col("y.label"))
            & _enough(most, F.col("x.n_shingles"), F.col("y.n_shingles"), options)
            & _worth_checking("x", "y", options),
        )
        .select(F.col("x.vertex").alias("a"), F.col("y.vertex").alias("b"))
        .distinct()
    )
    more = staged(_links(across, sets, options), "other-links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("vertex").alias("a"), F.col("label").alias("b")).union(more))

    labelled = classes.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    smallest = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"), F.min("vertex").alias("only"))
    of_class = labelled.join(smallest, "label").select(
        *(F.col(c).alias(f"of_{c}") for c in same_set),
        "component_id",
        F.when(F.col("component_id").isNull(), F.col("only")).alias("only"),
    )
    same_class = [F.col(c) == F.col(f"of_{c}") for c in same_set]
    out = signed.select("row_id", "doc_id", "text_key", *same_set).join(of_class, same_class, "left")
    lone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(lone | (F.col("doc_id") == F.col("component_id")), F.col("row_id") == F.col("only")).alias("kept"),
    ).withColumn("kept", F.coalesce("kept", F.lit(False)))


def keep_first(docs: DataFrame, options: NearDedup = NearDedup()) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    kept = near_duplicates(docs, options).filter("kept")
    return rows_in(docs, kept, "doc_id", "text", "left_semi", unique=True)
