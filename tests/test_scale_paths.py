"""The ways taken on large or skewed data, forced on small data and checked by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import Config, TableProfile
from assayer.operators.columns import column_specs
from assayer.operators.missingness import co_missing
from assayer.operators.outliers import Spread
from assayer.operators.quantiles import exact_quantiles, grouped_quantiles
from assayer.operators.remediate import segment_outliers
from assayer.plans.fixtures import dirty_orders
from assayer.sources.workspace import checkpoint_root, new_folder
from assayer.streaming.quality import (
    daily_quality,
    ingest_once,
    monitor_days,
    monitored_days,
    read_days,
    read_growing_table,
    read_ingested,
    read_monitor,
    update_days,
)

FRACTIONS = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
# So small that every quantile needs several rounds of narrowing.
TIGHT = Config(quantile_values=8, sketch_size=16)
# So small that the groups need a round of narrowing.
NARROW = Config(quantile_values=100, quantile_accuracy=1000)


def shapes(n):
    i = np.arange(n)
    rng = np.random.default_rng(3)
    return {
        "uniform": rng.permutation(i).astype(float),
        "two_values": np.where(i % 2 == 0, 1.0, 2.0),
        "hot_third": np.where(i % 3 == 0, 7.0, rng.normal(0, 1e6, n)),
        "heavy_tail": np.exp(rng.normal(0, 30, n)),
        "constant": np.full(n, 4.0),
        "signed": rng.integers(-5, 5, n).astype(float),
    }


@pytest.fixture(scope="module")
def numbers(spark):
    import pandas as pd

    frame = pd.DataFrame(shapes(5000))
    return frame, spark.createDataFrame(frame).repartition(7)


def test_narrowing_search_is_exact(numbers):
    frame, df = numbers
    names = list(frame.columns)
    got = exact_quantiles(
        df, {i: F.col(n) for i, n in enumerate(names)}, {i: len(frame) for i in range(len(names))}, FRACTIONS, TIGHT
    )
    for i, n in enumerate(names):
        assert got[i] == pytest.approx(np.quantile(frame[n], FRACTIONS).tolist(), rel=1e-12), n


@pytest.mark.parametrize("cfg", [Config(), NARROW])
def test_grouped_quantiles(spark, numbers, cfg):
    frame, df = numbers
    # One group holds a third of all rows, one is tiny, one has no key.
    key = F.when(F.col("uniform") % 3 == 0, "hot").when(F.col("uniform") < 5, "tiny").when(
        F.col("uniform") % 7 != 0, F.concat(F.lit("g"), (F.col("uniform") % 7).cast("int"))
    )
    data = df.withColumn("key", key)
    got = {r["key"]: r["quantiles"] for r in grouped_quantiles(data, ["key"], "hot_third", (0.25, 0.5, 0.9), cfg).collect()}
    local = data.select("key", "hot_third").toPandas()
    groups = {None if isinstance(k, float) else k: v for k, v in local.groupby("key", dropna=False)["hot_third"]}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, (0.25, 0.5, 0.9)).tolist(), rel=1e-12), k


def test_segment_outliers_agree_between_ways(spark, folder):
    df = dirty_orders(spark, folder)
    wide = segment_outliers(df, "channel", "amount_usd", Config()).count()
    assert wide > 0
    assert segment_outliers(df, "channel", "amount_usd", NARROW).count() == wide


def test_result_does_not_depend_on_partitions(spark, folder):
    from datetime import datetime

    base = dirty_orders(spark, folder)
    plain = Config(as_of=datetime(2001, 12, 15, 12))
    tight = Config(
        as_of=plain.as_of, quantile_values=8, sketch_size=16, aggregates_per_pass=7, duplicates="fingerprint", concurrent_scans=1
    )
    results = []
    for df, cfg in ((base.coalesce(1), plain), (base.repartition(16), plain), (base.orderBy(F.rand(5)), tight)):
        p = TableProfile(df, cfg).gather()
        results.append((p.column_profile.collect(), p.dataset_profile.collect(), p.category_clusters.collect(), sorted(p.overlaps.collect())))
    assert results[0] == results[1] == results[2]


def test_approximate_profile_is_close(spark, folder):
    p = TableProfile(dirty_orders(spark, folder), Config(quantiles="approx", distinct="approx"))
    exact = TableProfile(dirty_orders(spark, folder), Config())
    for o, s in exact.spreads.items():
        assert p.spreads[o].median == pytest.approx(s.median, rel=0.02)
    for o, n in exact.distinct.items():
        assert p.distinct[o] == pytest.approx(n, rel=0.1)


def test_stream_equals_batch(spark, folder):
    """Files in two runs, the second with late rows of days that were written before."""
    from assayer.plans.fixtures import dirty_events

    path, output = new_folder(spark, "events-in"), new_folder(spark, "days")
    events = dirty_events(spark, folder)
    spread = Spread(14.0, 35.0, 70.0)
    for late in (False, True):
        part = events.where((F.col("event_id") % 7 == 0) == late)
        part.orderBy("ts").coalesce(1).write.mode("append").option("maxRecordsPerFile", 300).parquet(path)
        days = daily_quality(read_growing_table(spark, path, events), "ts", F.col("value"), spread)
        update_days(days, output, f"{output}-progress")
        batch = daily_quality(spark.read.parquet(path), "ts", F.col("value"), spread)
        assert sorted(read_days(spark, output).collect()) == sorted(batch.collect())
    update_days(days, output, f"{output}-progress")  # nothing new
    assert sorted(read_days(spark, output).collect()) == sorted(batch.collect())


def _events_of(spark, path, days, day, rows):
    """One file with so many rows per day, some without a value or a time."""
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") % days * 86_400 + F.lit(day * 86_400) + F.col("id") * 37 % 80_000)
    df = spark.range(days * rows).select(
        F.when(F.col("id") % 31 != 0, at).alias("ts"), F.when(F.col("id") % 11 != 0, F.col("id") % 97).alias("value")
    )
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_monitor_holds_open_days_only(spark):
    """400 days in 10 files, each followed by late rows of all days so far; the last batch is done twice."""
    import os

    path, output, spread = new_folder(spark, "monitored"), new_folder(spark, "monitor"), Spread(20.0, 40.0, 60.0)

    def run():
        stream = read_growing_table(spark, path, df, files_per_batch=1)
        monitor_days(stream, "ts", F.col("value"), spread, output, f"{output}-progress", "3 days")

    for i in range(10):
        df = _events_of(spark, path, 40, 40 * i, 5)
        if i % 3 == 2:
            _events_of(spark, path, 40 * i + 38, 0, 1)
        run()
    batch = sorted(daily_quality(spark.read.parquet(path), "ts", F.col("value"), spread).collect())
    assert len(batch) > 390 and sorted(monitored_days(spark, output).collect()) == batch
    rows = read_monitor(spark, output)
    held = [r["count"] for r in rows.where("state = 'open'").groupBy("batch").count().collect()]
    assert len(held) == 13 and max(held) <= 5
    closed = rows.where("state = 'closed'")
    assert closed.count() == closed.select("day_start").distinct().count() > 390
    assert rows.where("state = 'late'").count() > 300
    last = max(int(name) for name in os.listdir(f"{output}-progress/commits") if name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if the run had failed before it was committed
        os.remove(f"{output}-progress/commits/{name}")
    run()
    assert sorted(monitored_days(spark, output).collect()) == batch


def test_monitor_without_times(spark):
    path, output = new_folder(spark, "untimed"), new_folder(spark, "monitor")
    for rows in ("(null, 1.0)", "(timestamp '2024-01-01 10:00', null)"):
        df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(ts, value)").selectExpr("CAST(ts AS timestamp) AS ts", "CAST(value AS double) AS value")
        df.coalesce(1).write.mode("append").parquet(path)
        stream = read_growing_table(spark, path, df)
        monitor_days(stream, "ts", F.col("value"), Spread(1.0, 2.0, 3.0), output, f"{output}-progress")
    assert [tuple(r)[2:] for r in monitored_days(spark, output).collect()] == [(1, 1, 0)]


def test_ingestion_reads_no_output(spark):
    """The cost of a batch does not grow with the batches before it: what was written may even be gone."""
    path, output = new_folder(spark, "arriving"), new_folder(spark, "ingested")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for i in range(4):
        df = spark.range(i * 50, i * 50 + 100).selectExpr("id % 120 AS k", "nullif(id % 2, 1) AS other", "id")
        df.coalesce(1).write.mode("append").parquet(path)
        to = f"{output}-{i}"
        ingest_once(read_growing_table(spark, path, df), ["k", "other"], to, f"{output}-progress", partitions=3)
    assert [spark.read.parquet(f"{output}-{i}").count() for i in range(4)] == [100, 20, 0, 0]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_replayed_input_is_kept_once(spark, folder):
    """Run, add new and repeated files, run again: no row twice and none missing."""
    from assayer.plans.fixtures import table

    path, output = new_folder(spark, "replay"), new_folder(spark, "kept")
    events = table(spark, folder, "events").limit(200).cache()
    for part in ("event_id % 2 = 0", "event_id % 3 = 0", "true", "false"):
        some = events.where(part)
        some.unionByName(some.where("event_id % 5 = 0")).repartition(3).write.mode("append").parquet(path)
        ingest_once(read_growing_table(spark, path, events), ["event_id"], output, f"{output}-progress")
    assert sorted(read_ingested(spark, output).collect()) == sorted(events.collect())


def test_work_folder_is_the_configured_one(spark):
    assert new_folder(spark, "x").startswith(checkpoint_root(spark))


def test_overlaps_of_many_columns(spark):
    """300 columns that go missing in groups of three: only the strong pairs reach the report."""
    n = 300
    row = lambda k: tuple(None if (k + i // 3) % 7 == 0 else k for i in range(n))
    df = spark.createDataFrame([row(k) for k in range(40)], ", ".join(f"c{i} int" for i in range(n)))
    gone = [frozenset(k for k in range(40) if row(k)[i] is None) for i in range(n)]
    expected = {(i, j) for i in range(n) for j in range(n) if i != j and len(gone[i] & gone[j]) >= 0.9 * len(gone[i] | gone[j])}
    pairs = co_missing(df, [(s, len(gone[s.ordinal])) for s in column_specs(df)], list(range(n)))
    strong = {(r["ordinal"], r["other"]) for r in pairs.where("jaccard >= 0.9").collect()}
    assert strong == expected and pairs.count() == n * (n - 1)


def test_duplicates_are_proven_where_fingerprints_collide(spark, monkeypatch):
    from assayer.operators import duplicates

    df = spark.createDataFrame([(1, "a", 0.0), (1, "a", -0.0), (2, "a", 1.0), (None, "b", None), (None, "b", None), (3, None, 1.0)], "k int, t string, x double")
    assert duplicates.duplicate_rows(df).first()[0] == 2
    assert duplicates.duplicate_rows(df, "fingerprint").first()[0] == 2
    monkeypatch.setattr(duplicates, "fingerprint", lambda names: [F.lit(1).alias("h1"), F.lit(2).alias("h2")])
    assert duplicates.duplicate_rows(df).first()[0] == 2
    assert duplicates.duplicate_rows(df, "fingerprint").first()[0] == 5


def _keyed(spark):
    """A hot key, unique keys, keys without a value, zeros of both signs, whole copies."""
    rows = [(None if i % 50 == 0 else 7.0 if i % 3 == 0 else float(i), f"k{i % 2}" if i % 3 == 0 else "k", i % 40, "x" * 50) for i in range(600)]
    rows += [(-0.0, "zero", 1, "a"), (0.0, "zero", 1, "a"), (0.0, "zero", 5, "b"), (None, None, 2, None), (None, None, 2, None)]
    return rows, spark.createDataFrame(rows, "`a key` double, k string, at int, text string").repartition(5)


@pytest.mark.parametrize("collide", [False, True])
def test_only_suspects_are_shuffled(spark, monkeypatch, collide):
    from assayer.operators import duplicates
    from assayer.operators.remediate import drop_copies, keep_latest

    if collide:  # all rows are suspects
        monkeypatch.setattr(duplicates, "fingerprint", lambda names: [F.lit(1).cast("long").alias(h) for h in ("h1", "h2")])
    rows, df = _keyed(spark)
    latest = {}
    for r in rows:
        key = r[:2]
        latest[key] = max(latest.get(key, (-1, "")), (r[2], r[3] or ""))
    kept = keep_latest(df, ["a key", "k"], "at", ["text"])
    assert {(r[0], r[1]): (r[2], r[3] or "") for r in kept.collect()} == latest and kept.count() == len(latest)
    unique = drop_copies(df)
    assert {tuple(r) for r in unique.collect()} == set(rows) and unique.count() == len(set(rows))
    if not collide:
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        alone = plan[: plan.index("Window")]
        assert "LeftAnti" in alone and "Exchange" not in alone
        assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("collide", [False, True])
def test_unique_keys_by_suspicion(spark, monkeypatch, collide):
    from assayer.operators import duplicates
    from assayer.operators.rules import unique_key

    if collide:
        monkeypatch.setattr(duplicates, "fingerprint", lambda names: [F.lit(1).cast("long").alias(h) for h in ("h1", "h2")])
    rows, df = _keyed(spark)
    for keys in (["k"], ["a key", "k"], ["at"], ["a key", "at"]):
        got = unique_key(df, keys).first()
        places = [df.columns.index(k) for k in keys]
        failed = len(rows) - len({tuple(r[p] for p in places) for r in rows})
        assert got["failed_rows"] == failed and got["failed_pct"] == pytest.approx(100 * failed / len(rows), abs=0.005)
    one_percent = spark.range(5000).selectExpr("concat('key ', if(id % 100 = 0, id + 1, id)) AS k")
    assert unique_key(one_percent, ["k"]).first()["failed_rows"] == 50
    assert tuple(unique_key(one_percent.limit(0), ["k"]).first())[2:] == (0, 0.0)


def test_copies_with_arrays(spark):
    from assayer.operators.remediate import drop_copies

    df = spark.sql("SELECT id % 2 AS a, array(id % 2) AS b FROM range(6)")
    assert sorted(drop_copies(df).collect()) == [(0, [0]), (1, [1])]
    assert drop_copies(df.limit(0)).count() == 0


def long_values(spark):
    """Values that share their first characters, and short ones with spaces at the ends."""
    start = "the same beginning of every value, " * 2
    rows = [(f"{start}{i % 40:02d}", f"v{i % 3}" if i % 50 else f" v{i % 7} ", 5 * i) for i in range(400)]
    rows += [(f"{start}07", " " + start, None), (f"{start}99 ", start + "\t", 2**40)]
    return rows, spark.createDataFrame(rows, "long string, short string, n bigint")


@pytest.mark.parametrize("few", [50_000, 0])
def test_top_values_of_long_texts(spark, monkeypatch, few):
    from assayer.operators import values

    monkeypatch.setattr(values, "_FEW", few)  # 0: candidates stay distributed
    rows, df = long_values(spark)
    p = TableProfile(df, Config())
    got = {r["ordinal"]: r for r in p.value_summary.collect()}
    for o in (0, 1):
        counts = {}
        for r in rows:
            counts[r[o]] = counts.get(r[o], 0) + 1
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [tuple(x) for x in got[o]["top_values"]] == best
        assert (got[o]["distinct"], got[o]["counted"]) == (len(counts), len(rows))
        odd = sorted(v for v in counts if v != v.strip())[:3]
        assert got[o]["format_issue_examples"] == odd
    assert p.distinct[2] == 401


def test_no_long_text_is_shuffled(spark):
    """Exchanges of the value counts and of the duplicates hold hashes and short beginnings only."""
    from assayer.operators.duplicates import duplicate_rows
    from assayer.operators.values import fingerprint_counts

    _, df = long_values(spark)
    counts = fingerprint_counts(df, column_specs(df)[:2], [])
    assert {f.name for f in counts.schema} == {"ordinal", "head", "h1", "h2", "tail", "worded", "n"}
    plan = duplicate_rows(df, "fingerprint")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h1" in plan and "hashpartitioning(c0" not in plan


def test_dense_integers_are_bits(spark):
    from assayer.operators import values

    rows = [(i % 70_000 - 35_000, i * 10**12 % (2**62), float(i % 5) * (-1 if i % 2 else 1)) for i in range(100_000)]
    p = TableProfile(spark.createDataFrame(rows, "near int, far bigint, x double"), Config())
    assert [values._dense(c) for c in p.columns] == [True, False, False]
    got = [p.distinct[i] for i in range(3)]
    assert got == [len({r[0] for r in rows}), len({r[1] for r in rows}), len({r[2] for r in rows})]


def test_strong_overlaps_of_sampled_columns(spark, monkeypatch):
    """The pairs that the sample proposes, counted over all rows, are those of brute force."""
    from assayer.operators import missingness

    monkeypatch.setattr(missingness, "_SAMPLE", 256)
    n, columns = 6000, 24
    rng = np.random.default_rng(5)
    gone = [rng.random(n) < 0.2 for _ in range(columns)]
    gone[3] = gone[2] | (rng.random(n) < 0.02)
    gone[5] = gone[4] & (rng.random(n) < 0.7)
    gone[6] = np.zeros(n, bool)
    gone[6][:40] = True
    gone[7] = gone[6].copy()
    gone[7][30:60] = True
    rows = [tuple(None if gone[c][i] else 1 for c in range(columns)) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{c} int" for c in range(columns)))
    missing = [(s, int(gone[s.ordinal].sum())) for s in column_specs(df)]
    got = {(r["ordinal"], r["other"]): (r["both"], r["any"]) for r in missingness.strong_co_missing(df, missing, list(range(columns)), 0.3).collect()}
    expected = {}
    for a in range(columns):
        for b in range(columns):
            both, union = int((gone[a] & gone[b]).sum()), int((gone[a] | gone[b]).sum())
            if a != b and both / union >= 0.3:
                expected[a, b] = (both, union)
    assert got == expected and len(expected) >= 6


def test_layouts_of_single_texts(spark):
    """Layouts that a table of dates seldom mixes, each as a column of its own."""
    from datetime import datetime

    from assayer.functions.times import layouts_of, shape

    texts = {
        "20231225": datetime(2023, 12, 25),
        "12/25/2023 10:11": datetime(2023, 12, 25, 10, 11),
        "2023-12-25 10:11:12+00:00": datetime(2023, 12, 25, 10, 11, 12),
        "2023-12-25T10:11:12+0530": datetime(2023, 12, 25, 4, 41, 12),
        "25.12.2023": datetime(2023, 12, 25),
        "1/2/2023": datetime(2023, 1, 2),
        "25-Dec-2023": datetime(2023, 12, 25),
        "Mon, 25 Dec 2023 10:11:12 GMT": datetime(2023, 12, 25, 10, 11, 12),
        "12/25/2023 12:05:00 AM": datetime(2023, 12, 25, 0, 5),
        "December 5, 2023": datetime(2023, 12, 5),
        "3rd march 2024": datetime(2024, 3, 3),
        "05/06/70": datetime(1970, 5, 6),
        "2023.1.2 3:04:05.123456789": datetime(2023, 1, 2, 3, 4, 5, 123456),
    }
    not_times = ["31.02.2023", "20231332", "12/25/2023 13:05 PM", "1.2.3.4", "on 2023-01-01", "2023-01-01 extra", "9" * 60, "", "marching 5, 2023"]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    shapes = df.select(*[shape(F.col(f"c{i}")) for i in range(len(texts))]).first()
    for i, (text, expected) in enumerate(texts.items()):
        found = df.select(*[x.time(F.col(f"c{i}")) for x in layouts_of([shapes[i]])]).first()
        assert expected in list(found), text
    for text in not_times:
        one = spark.createDataFrame([(text,)], "x string")
        kind = one.select(shape(F.col("x"))).first()[0]
        read = [] if kind is None else list(one.select(*[x.time(F.col("x")) for x in layouts_of([kind])]).first())
        assert not any(read), text


def test_profile_grows_with_the_table(spark, folder):
    """Only new files are read; the merged state equals a full profile of the files that are there."""
    import os

    from assayer.operators.profile_state import profile_from_state, update_profile_state

    path, state = new_folder(spark, "growing table"), new_folder(spark, "profile-state")
    df = dirty_orders(spark, folder)
    parts = [df.where(F.crc32(F.col("order_id").cast("string")) % 3 == i) for i in range(3)]
    parts[2] = parts[2].union(df.where("order_id IS NULL"))

    def same_as_full():
        table = spark.read.parquet(path)
        full = {r["name"]: r for r in TableProfile(table, Config()).stats().collect()}
        got = {r["name"]: r for r in profile_from_state(spark, path, state).collect()}
        assert set(got) == set(full)
        for name, f in full.items():
            g = got[name]
            assert (g["total_rows"], g["missing_count"], g["dtype"]) == (f["total_rows"], f["total_rows"] - f["present"], f["dtype"])
            if f["role"] == "categorical":
                assert g["whitespace_count"] == f["whitespace_count"]
            assert g["approx_distinct"] == pytest.approx(f["distinct_count"], rel=0.05)
            if f["raw_mean"] is not None:
                assert [g[m] for m in ("mean", "std")] == pytest.approx([f["raw_mean"], f["raw_std"]], rel=1e-9)
                assert (g["min"], g["max"], g["numeric_count"]) == (f["raw_min"], f["raw_max"], f["numeric_count"])
                x = table.select(F.col(name).try_cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").toPandas()["x"]
                for q, at in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                    value = g[f"approx_{q}"]
                    assert (x < value).mean() <= at + 0.03 and (x <= value).mean() >= at - 0.03

    for i, part in enumerate(parts):
        part.repartition(2 - i % 2).write.mode("append").parquet(path)
        assert update_profile_state(spark, path, state) == 2 - i % 2
        assert update_profile_state(spark, path, state) == 0
    same_as_full()
    gone = next(n for n in sorted(os.listdir(path)) if n.endswith(".parquet"))
    os.remove(f"{path}/{gone}")
    same_as_full()


def test_profile_state_of_new_columns(spark):
    from assayer.operators.profile_state import profile_from_state, update_profile_state

    path, state = new_folder(spark, "widening"), new_folder(spark, "profile-state")
    spark.range(10).selectExpr("id", "double('NaN') AS x").write.parquet(path)
    update_profile_state(spark, path, state)
    spark.range(5).selectExpr("id", "id * 2.5D AS x", "' a' AS t", "array(id) AS list").coalesce(1).write.mode("append").parquet(path)
    update_profile_state(spark, path, state)
    got = {r["name"]: r for r in profile_from_state(spark, path, state).collect()}
    assert [(n, got[n]["total_rows"], got[n]["missing_count"], got[n]["numeric_count"]) for n in sorted(got)] == [
        ("id", 15, 0, 15), ("list", 15, 10, 0), ("t", 15, 10, 0), ("x", 15, 10, 5)
    ]
    assert (got["t"]["whitespace_count"], got["list"]["approx_distinct"], got["x"]["mean"], got["t"]["mean"]) == (5, 5, 5.0, None)
