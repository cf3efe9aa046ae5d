"""Findings of the third round: work that grew faster than it had to."""

from datetime import datetime

from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.times import look
from assayer.operators import facts, outliers
from assayer.operators.profile import TableProfile

CFG = Config(as_of=datetime(2024, 1, 1))


def test_outliers_are_spread_over_the_columns_they_are_in(spark):
    k = F.col("id")
    numbers = [F.when(k % 50 == i, 1e9).otherwise((k % 10).cast("double")).alias(f"n{i}") for i in range(3)]
    texts = [F.when(k % 50 == i, "bad").otherwise("fine").alias(f"t{i}") for i in range(3)]
    p = TableProfile(spark.range(1000).select(*numbers, *texts), CFG)
    found = outliers.outlier_categories(p.df, p.facts, p.spreads, p.outliers, CFG)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" in plan  # the list holds hits alone, not a place for each column
    clusters = {(r["ordinal"], r["category_column"]): (r["top_value"], r["outlier_count"], r["base_count"]) for r in p.category_clusters.collect()}
    assert clusters[0, "t0"] == ("bad", 20, 20) and clusters[2, "t2"] == ("bad", 20, 20)
    assert clusters[0, "t1"] == ("fine", 20, 980)


def test_text_without_digits_is_not_matched_as_time(spark):
    texts = [("c3",), ("culprit",), ("1/2/23",), ("Tuesday, 3 January 2023 10:00 PM UTC",), ("x" * 60 + "123",)]
    found = [r[0] for r in spark.createDataFrame(texts, "c string").select(look(F.col("c"))).collect()]
    assert found == [None, None, "9/9/99", "mon, 9 jan 9999 99:99 am z", None]


def test_times_of_text_are_read_in_one_scan(spark, monkeypatch):
    calls, one_row = [], facts.one_row
    monkeypatch.setattr(facts, "one_row", lambda df, wanted, n: calls.append(list(wanted)) or one_row(df, wanted, n))
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(60).select(F.date_format(day, "M/d/yyyy").alias("short"), F.date_format(day, "yyyy-MM-dd").alias("iso"))
    short, iso = facts.gather_facts(df, CFG).columns
    assert len(calls) == 2  # rows, then all about times
    assert (short.layout.name, short.timed, short.first_time, short.last_time) == ("M/d/y", 60, datetime(2023, 1, 1), datetime(2023, 3, 1))
    assert (iso.first_time, iso.last_time, iso.ambiguous) == (datetime(2023, 1, 1), datetime(2023, 3, 1), 0)


def test_bars_and_years_that_python_lacks(spark):
    rows = [("1|2|2020||||||",), ("0000-01-01",)] + [("x",)] * 8
    (c,) = facts.gather_facts(spark.createDataFrame(rows, "c string"), CFG).columns
    assert c.like_times == 1 and c.first_time is None
