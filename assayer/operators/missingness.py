"""Which columns go missing together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.columns import ColumnSpec
from assayer.operators.small import small_frame

_BITS = 62

#: Missing cells of a column that estimate its overlaps; columns with fewer are taken whole.
_SAMPLE = 1024
_SCHEMA = "ordinal int, other int, both bigint, any bigint, jaccard double"


def missing_patterns(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Rows per combination of missing columns, as bit masks ``m0, m1, ...`` and a count."""
    masks = []
    for w in range(0, len(specs), _BITS):
        mask = F.lit(0).cast("bigint")
        for i, s in enumerate(specs[w : w + _BITS]):
            mask = mask + F.when(s.value.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        masks.append(mask.alias(f"m{w // _BITS}"))
    flat = df.select(*masks)
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n"))


def co_missing(df: DataFrame, missing: list[tuple[ColumnSpec, int]], askers: list[int]) -> DataFrame:
    """Jaccard overlap of the missing rows of each asker with each other column.

    ``missing`` lists the columns with missing rows and how many. The scan ends in one
    row per combination of missing columns; each combination is then spread over its
    pairs of an asker and another missing column, which are summed before they are shuffled.
    The pairs stay distributed; whoever collects them filters them first.
    """
    specs = [s for s, _ in missing]
    count = {s.ordinal: n for s, n in missing}
    spark = df.sparkSession
    if not askers or len(specs) < 2:
        return spark.createDataFrame([], _SCHEMA)

    def bit(i: int):
        return (F.col(f"m{i // _BITS}").bitwiseAND(F.lit(1 << (i % _BITS)).cast("bigint"))) != 0

    at = {s.ordinal: i for i, s in enumerate(specs)}
    def hits(ordinals: list[int]):
        return F.array_compact(F.array(*[F.when(bit(at[o]), F.lit(o)) for o in ordinals]))

    patterns = missing_patterns(df, specs).select("n", hits(askers).alias("asking"), hits(list(at)).alias("others"))
    sums = (
        patterns.where(F.size("asking") > 0)
        .withColumn("ordinal", F.explode("asking"))
        .withColumn("other", F.explode("others"))
        .where(F.col("other") != F.col("ordinal"))
        .groupBy("ordinal", "other")
        .agg(F.sum("n").alias("both"))
    )
    own = F.element_at(F.create_map(*[F.lit(x) for o in count for x in (o, count[o])]), F.col("ordinal"))
    other = F.element_at(F.create_map(*[F.lit(x) for o in count for x in (o, count[o])]), F.col("other"))
    union = own + other - F.col("both")
    some = lambda ordinals: F.explode(F.array(*[F.lit(o) for o in ordinals]))
    pairs = spark.range(1).select(some(askers).alias("ordinal")).select("ordinal", some(at).alias("other"))
    pairs = pairs.where(F.col("other") != F.col("ordinal")).join(sums, ["ordinal", "other"], "left")
    return pairs.fillna(0, ["both"]).select(
        "ordinal",
        "other",
        F.col("both").cast("bigint").alias("both"),
        union.cast("bigint").alias("any"),
        (F.col("both") / union).alias("jaccard"),
    )


def _flags(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Whether each column is missing, and a hash that names the row."""
    row = F.xxhash64(F.monotonically_increasing_id()).alias("row")
    return df.select(*[s.value.isNull().alias(f"c{s.ordinal}") for s in specs], row)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, the row's hash left out."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1)


def _sampled_cells(df: DataFrame, missing: list[tuple[ColumnSpec, int]]) -> list[np.ndarray]:
    """Per column the hashes of about ``_SAMPLE`` of the rows where it is missing, those with the smallest hashes.

    All columns judge a row by one hash, so the sample of the column with fewer of its rows in it is a sample of
    the rows of every other column, too. What reaches the driver is set by the number of columns.
    """
    limits = np.array([_limit(n) if n > _SAMPLE else 2**63 - 1 for _, n in missing], np.int64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["row"].to_numpy()
            line, at = np.nonzero(_matrix(batch) & (rows[:, None] <= limits))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[line])], ["at", "row"])

    got = _flags(df, [s for s, _ in missing]).mapInArrow(sample, "at long, row long").toPandas()
    at, rows = got["at"].to_numpy(np.int64), got["row"].to_numpy(np.int64)
    order = np.lexsort((rows, at))
    return np.split(rows[order], np.searchsorted(at[order], np.arange(1, len(missing))))


def _limit(n: int) -> int:
    return -(2**63) + min(2**64 * _SAMPLE // n, 2**64 - 1)


def likely_pairs(df: DataFrame, missing: list[tuple[ColumnSpec, int]], askers: list[int], jaccard: float) -> list[tuple[int, int]]:
    """(asker, other) by ordinal, all whose overlap may reach ``jaccard``.

    The sizes alone rule out pairs, as an overlap is at most the smaller size by the larger. For the others it is
    estimated on the common sample, and kept if it is at most four standard errors too small.
    """
    cells = _sampled_cells(df, missing)
    sizes = np.array([n for _, n in missing])
    ordinals = np.array([s.ordinal for s, _ in missing])
    limits = [_limit(n) if n > _SAMPLE else 2**63 - 1 for n in sizes.tolist()]
    column = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    rows = np.concatenate(cells) if cells else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    rows, column = rows[order], column[order]
    found = []
    for a in np.flatnonzero(np.isin(ordinals, askers)):
        # The other columns that are missing in the sampled rows of this one.
        first, end = np.searchsorted(rows, cells[a], "left"), np.searchsorted(rows, cells[a], "right")
        at = np.repeat(end - np.cumsum(end - first), end - first) + np.arange((end - first).sum())
        mine, theirs = np.repeat(cells[a], end - first), column[at]
        for b in np.unique(theirs):
            if a == b or min(sizes[a], sizes[b]) < jaccard * max(sizes[a], sizes[b]):
                continue
            limit = min(limits[a], limits[b])
            both = int((mine[theirs == b] <= limit).sum())
            n = [int(np.searchsorted(cells[x], limit, "right")) for x in (a, b)]
            union = max(1, n[0] + n[1] - both)
            if both / union >= jaccard - 4 * (jaccard * (1 - jaccard) / union) ** 0.5:
                found.append((int(ordinals[a]), int(ordinals[b])))
    return found


def strong_co_missing(df: DataFrame, missing: list[tuple[ColumnSpec, int]], askers: list[int], jaccard: float) -> DataFrame:
    """The pairs of ``co_missing`` whose overlap is at least ``jaccard``, for any number of columns.

    A sample of rows names the pairs that can be strong; these alone are counted, exactly, over all rows, and only
    the columns in them are read. Columns that go missing at random are in no pair, whatever their number. Only
    whether a cell is missing goes to Python, a batch at a time; a task sends one row per pair.
    """
    pairs = likely_pairs(df, missing, askers, jaccard) if askers and len(missing) > 1 else []
    if not pairs:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    size = {s.ordinal: n for s, n in missing}
    spark = df.sparkSession
    named = {o for pair in pairs for o in pair}
    specs = [s for s, _ in missing if s.ordinal in named]

    place = {s.ordinal: i for i, s in enumerate(specs)}
    first, second = (np.array([place[pair[i]] for pair in pairs]) for i in (0, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(specs), len(specs)), np.int64)  # bounded by the schema
        for batch in batches:
            x = _matrix(batch).astype(np.float32)
            both += (x.T @ x).astype(np.int64)  # exact: a batch has fewer than 2**24 rows
        n = both[first, second]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["pair", "n"])

    counted = _flags(df, specs).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("both"))
    sizes = small_frame(
        spark, [{"at": i, "ordinal": a, "other": b, "own_size": size[a], "other_size": size[b]} for i, (a, b) in enumerate(pairs)],
        "at bigint, ordinal int, other int, own_size bigint, other_size bigint",
    )
    union = F.col("own_size") + F.col("other_size") - F.col("both")
    out = counted.join(sizes, F.col("pair") == F.col("at")).select(
        "ordinal", "other", F.col("both").cast("bigint").alias("both"), union.cast("bigint").alias("any"), (F.col("both") / union).alias("jaccard")
    )
    return out.where(F.col("jaccard") >= jaccard)
