"""Threshold edges and special values with hand-computed answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer import Config, TableProfile, assess
from assayer.functions import grades
from assayer.functions.numbers import round_half_up, text_to_number
from assayer.functions.texts import has_outer_whitespace, is_off_topic, strip
from assayer.operators import inject, recommend, rules
from assayer.operators.facts import gather_facts, is_numeric, mixed_values
from assayer.operators.profile import dataset_scores, with_age
from assayer.operators.score import quality_score
from assayer.operators.small import small_frame

AS_OF = datetime(2024, 6, 1, 12)
CFG = Config(as_of=AS_OF)


def one_column(spark, values, dtype="double", name="x"):
    return small_frame(spark, [{name: v} for v in values], f"{name} {dtype}")


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_grades(spark):
    df = one_column(spark, [85.0, 84.9, 70.0, 69.9, 55.0, 54.9, 40.0, 39.9])
    assert "".join(values(df, grades.grade(F.col("x")))) == "ABBCCDDF"


def test_severities(spark):
    df = one_column(spark, [10.0, 9.99, 3.0, 2.99])
    assert values(df, grades.severity(F.col("x"))) == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


@pytest.mark.parametrize(
    ("age", "days", "flag", "score"),
    [
        (timedelta(days=30), 30, "OK", 100.0),
        (timedelta(days=30, hours=23), 30, "OK", 100.0),
        (timedelta(days=31), 31, "STALE", 99.8),
        (timedelta(days=365), 365, "STALE", 20.0),
        (timedelta(days=400), 400, "STALE", 20.0),
        (timedelta(hours=-1), -1, "OK", 100.0),
    ],
)
def test_freshness(spark, age, days, flag, score):
    row = [{"latest": AS_OF - age, "as_of": AS_OF}]
    df = with_age(small_frame(spark, row, "latest timestamp_ntz, as_of timestamp_ntz"), CFG)
    points = round_half_up(grades.freshness_score(F.col("freshness_flag"), F.col("freshness_days")), 1)
    assert df.select("freshness_days", "freshness_flag", points).first() == (days, flag, score)


def test_freshness_without_dates(spark):
    assert TableProfile(one_column(spark, [1.0]), CFG).freshness().first()["freshness_flag"] == "UNKNOWN"
    empty = one_column(spark, [None, None], "timestamp_ntz")
    assert TableProfile(empty, CFG).freshness().first()["freshness_flag"] == "UNKNOWN"


def test_ten_values(spark):
    p = TableProfile(one_column(spark, [float(i) for i in range(1, 10)] + [100.0]), CFG)
    assert (p.spreads[0].q1, p.spreads[0].q3) == (3.25, 7.75)
    assert (p.outliers.columns[0].near, p.outliers.columns[0].far) == (1, 1)


def test_fewer_than_ten_values(spark):
    p = TableProfile(one_column(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), CFG)
    assert p.outliers.columns[0].near == 0


def test_flat_column(spark):
    p = TableProfile(one_column(spark, [5.0] * 10), CFG)
    assert (p.outliers.columns[0].near, p.outliers.any_rows) == (0, 0)


def test_negative_stock(spark):
    p = TableProfile(one_column(spark, [5.0] * 9 + [-1.0, 7.0], name="stock"), CFG)
    c = p.columns[0]
    assert p.outliers.columns[0].near == 0
    assert c.negative == 1
    assert p.outlier_count(c) == 1
    assert p.outliers.any_rows == 2


def test_numeric_ratio_counts_missing_rows(spark):
    two = gather_facts(one_column(spark, [1.0] * 8 + [None] * 2), CFG).columns[0]
    one = gather_facts(one_column(spark, [1.0] * 9 + [None]), CFG).columns[0]
    assert (is_numeric(two, CFG), is_numeric(one, CFG)) == (False, True)
    assert is_numeric(two, Config(ratio_base="non_null"))


def test_mixed_values(spark):
    nine = gather_facts(one_column(spark, [None] * 2 + ["1"] * 9 + ["word"], "string"), CFG).columns[0]
    eight = gather_facts(one_column(spark, [None] * 2 + ["1"] * 8 + ["word", "text"], "string"), CFG).columns[0]
    assert (mixed_values(nine, CFG), mixed_values(eight, CFG)) == (0, 2)


@pytest.mark.parametrize("mode", ["exact", "fingerprint"])
def test_duplicates_with_missing_values(spark, mode):
    rows = [{"a": 1, "b": None}, {"a": 1, "b": None}, {"a": 1, "b": "x"}, {"a": None, "b": "1"}, {"a": None, "b": "x"}]
    df = small_frame(spark, rows, "a int, b string")
    assert TableProfile(df, Config(duplicates=mode)).duplicates == 1


def test_overlap_at_the_limit(spark):
    rows = [{"a": None if i < 3 else i, "b": None if i < 10 else i, "c": i} for i in range(100)]
    p = TableProfile(small_frame(spark, rows, "a int, b int, c int"), CFG)
    found = {(r["ordinal"], r["other"]): r["jaccard"] for r in p.overlaps.collect()}
    assert found == {(0, 1): 0.3, (1, 0): 0.3}
    linked = {r["affected_column"]: r["correlated_columns"] for r in assess(p.df, CFG).issues.collect()}
    assert linked["a"] == ["b"]


def test_overlap_of_many_columns(spark):
    # More columns than fit one bit mask.
    names = [f"c{i}" for i in range(130)]
    rows = [{n: None if (r + i) % 130 < 65 else 1 for i, n in enumerate(names)} for r in range(130)]
    p = TableProfile(small_frame(spark, rows, ", ".join(f"{n} int" for n in names)), CFG)
    got = {(r["ordinal"], r["other"]): (r["both"], r["any"]) for r in p.overlaps.collect()}
    gone = [{r for r in range(130) if (r + i) % 130 < 65} for i in range(130)]
    assert got == {(i, j): (len(gone[i] & gone[j]), len(gone[i] | gone[j])) for i in range(130) for j in range(130) if i != j}


def test_score_example(spark):
    row = {
        "completeness_score": 95.0, "consistency_score": 98.0, "duplicate_pct": 8.0, "total_outlier_pct": 6.0,
        "freshness_flag": "UNKNOWN", "freshness_days": None, "schema_issues": ["one", "two"], "missing_cell_pct": 5.0,
    }
    schema = (
        "completeness_score double, consistency_score double, duplicate_pct double, total_outlier_pct double, "
        "freshness_flag string, freshness_days double, schema_issues array<string>, missing_cell_pct double"
    )
    s = quality_score(small_frame(spark, [row], schema)).first()
    assert (s["uniqueness"], s["validity"], s["freshness"], s["schema"]) == (80.0, 82.0, 60.0, 70.0)
    assert (s["ai_readiness"], s["grade"]) == (84.6, "B")


def test_score_lift(spark):
    df = small_frame(spark, [{"h": 2, "m": 1}, {"h": 4, "m": 0}], "h int, m int")
    assert values(df, recommend.score_lift(F.col("h"), F.col("m"), F.lit(5))) == [19.0, 30.0]
    assert values(df, recommend.score_lift(F.col("h"), F.col("m"), F.lit(0))) == [0.0, 0.0]


def test_outer_whitespace(spark):
    df = one_column(spark, ["a", " a", "a\t", "a ", "a b", "", "　"], "string")
    assert values(df, has_outer_whitespace(F.col("x"))) == [False, True, True, True, False, False, True]
    assert values(df, strip(F.col("x"))) == ["a", "a", "a", "a", "a b", "", ""]


def test_nan_is_missing(spark):
    p = TableProfile(one_column(spark, [float("nan"), 1.0, None]), CFG)
    assert p.columns[0].missing == 2


def test_number_text(spark):
    df = one_column(spark, ["1d", "0x1p3", " 12 ", "1e5", "1,000", "", "1e999", "-.5", "9" * 400], "string")
    assert values(df, text_to_number(F.col("x"))) == [None, None, 12.0, 1e5, None, None, None, -0.5, None]


@pytest.mark.parametrize(("gap", "clustered"), [(timedelta(days=7, hours=23), True), (timedelta(days=8), False)])
def test_date_window(spark, gap, clustered):
    start = datetime(2023, 1, 1)
    rows = [{"amount": float(i % 20), "at": start + timedelta(days=i)} for i in range(100)]
    rows += [{"amount": 5000.0, "at": start}, {"amount": 6000.0, "at": start + gap}]
    p = TableProfile(small_frame(spark, rows, "amount double, at timestamp_ntz"), CFG)
    found = p.date_clusters.collect()
    assert [r["window_days"] for r in found] == ([7] if clustered else [])


def test_off_topic(spark):
    df = one_column(spark, ["Write me a poem", "What should I fix first?"], "string")
    assert values(df, is_off_topic(F.col("x"))) == [True, False]


def test_low_score_adds_monitoring(spark):
    rows = [{"a": None, "b": " x", "c": "1" if i % 2 else "w"} for i in range(20)]
    r = assess(small_frame(spark, rows, "a string, b string, c string"), CFG, "poor")
    assert r.score.first()["ai_readiness"] < 70
    last = r.recommendation_candidates.where("dimension = 'general'").collect()
    assert [x["issue_ref"] for x in last] == ["Overall data quality"]


def test_clean_table_has_no_issues(spark):
    df = small_frame(spark, [{"k": i, "at": AS_OF} for i in range(50)], "k int, at timestamp_ntz")
    r = assess(df, CFG, "clean")
    assert r.issues.count() == 0
    assert r.score.first()["grade"] == "A"
    assert r.plan.first()["estimated_score_lift"] == 0.0
    opening, finding, outlook = r.narrative().first()["narrative"].split("\n\n")
    assert opening.startswith("**clean** scores **100.0 of 100 (grade A)**") and "Of its 50 rows and 2 columns, 0.0%" in opening
    assert "**" not in finding and "at risk" not in finding
    assert "the 0 proposed steps" in outlook and "about 0 points" in outlook
    assert '"issues":[]' in r.document().first()["report"]
    parts = sections(r.digest().first()["digest"])
    assert parts["Issues, 0 in all"] == ["- none"] and parts["Steps to take"] == ["none"]


def sections(text):
    """Lines of the digest by the heading above them."""
    out = {}
    for block in text.split("\n\n"):
        first, *rest = block.split("\n")
        out[first] = rest
    return out


def test_narrative_and_digest_say_what_the_report_holds(spark):
    start = datetime(2023, 1, 1)
    rows = [
        {"k": i, "price": 5000.0 if i < 4 else float(i % 20), "note": None if i % 4 == 0 else " x" if i % 4 == 1 else "y", "at": start}
        for i in range(200)
    ]
    r = assess(small_frame(spark, rows, "k int, price double, note string, at timestamp_ntz"), CFG, "worn")
    score, first = r.score.first(), r.issues.where("ord = 1").first()
    columns = r.column_profile.orderBy("ordinal").collect()
    issues = r.issues.orderBy("ord").collect()
    actions = r.recommendations.orderBy("priority").collect()
    opening, finding, outlook = r.narrative().first()["narrative"].split("\n\n")
    assert f"**worn** scores **{score['ai_readiness']} of 100 (grade {score['grade']})**" in opening
    assert "200 rows and 4 columns" in opening
    assert f"**{first['title']}** ({first['severity']}, {first['affected_pct']:.1f}% of the rows). {first['possible_root_causes'][0]}" in finding
    assert f"the {len(issues)} issue(s)" in finding
    wins = [x["action"] for x in actions if x["effort"] == "Low" and x["impact"] == "High"]
    assert all(x in outlook for x in wins[:2]) and (f"{len(wins)} step(s)" in outlook or not wins)
    parts = sections(r.digest().first()["digest"])
    assert f"- overall {score['ai_readiness']}, grade {score['grade']}" in parts["Scores out of 100"]
    assert len(parts["Scores out of 100"]) == 7
    assert [x.split(", ")[0] for x in parts["Columns"]] == [f"- {c['name']}" for c in columns]
    assert all(f"{c['missing_pct']:.1f}% empty" in line for c, line in zip(columns, parts["Columns"]))
    listed = parts[f"Issues, {len(issues)} in all"]
    assert listed == [
        f"- {i['severity']}: {i['title']}, {i['affected_pct']:.1f}% of the rows. {i['possible_root_causes'][0]}" for i in issues[: len(listed)]
    ]
    assert parts["Steps to take"] == [
        f"{x['priority']}) {x['action']} (effort {x['effort']}, effect {x['impact']})" for x in actions[: len(parts["Steps to take"])]
    ]


def test_repeated_column_names(spark):
    df = spark.range(3).select(F.col("id").alias("a"), F.lit(1).alias("a"))
    p = TableProfile(df, CFG)
    assert [c.spec.name for c in p.columns] == ["a", "a.1"]
    assert p.schema_issues == ["Duplicate column names detected: ['a']"]


def test_empty_table(spark):
    with pytest.raises(ValueError, match="no rows"):
        _ = TableProfile(spark.createDataFrame([], "a int"), CFG).facts


def test_nested_binary_and_decimal_columns(spark):
    df = spark.range(4).select(
        F.array(F.col("id") % 2).alias("arr"),
        F.create_map(F.lit("k"), F.col("id") % 2).alias("map"),
        F.struct((F.col("id") % 2).alias("v")).alias("st"),
        (F.col("id") % 2).cast("string").cast("binary").alias("bin"),
        F.col("id").cast("decimal(10,2)").alias("dec"),
        F.when(F.col("id") > 0, F.current_date()).alias("day"),
    )
    p = TableProfile(df, CFG)
    got = {r["name"]: (r["unique_count"], r["missing_count"]) for r in p.column_profile.collect()}
    assert got == {"arr": (2, 0), "map": (2, 0), "st": (2, 0), "bin": (2, 0), "dec": (4, 0), "day": (1, 1)}
    assert p.duplicates == 0


def test_validate_ignores_missing_values(spark):
    df = one_column(spark, [None, -1.0, 2.0])
    got = {r["rule"]: r["failed_rows"] for r in rules.validate(df, [rules.non_negative("x"), rules.not_null("x")]).collect()}
    assert got == {"non_negative": 1, "not_null": 1}


def test_scores_of_many_tables(spark):
    schema = "total_rows bigint, total_cols int, duplicate_count bigint, missing_cells bigint, format_total bigint, total_outlier_rows bigint"
    rows = [
        {"total_rows": 100, "total_cols": 10, "duplicate_count": 8, "missing_cells": 50, "format_total": 20, "total_outlier_rows": 6},
        {"total_rows": 10, "total_cols": 1, "duplicate_count": 0, "missing_cells": 0, "format_total": 0, "total_outlier_rows": 0},
    ]
    got = dataset_scores(small_frame(spark, rows, schema)).orderBy("total_rows").collect()
    assert [r["completeness_score"] for r in got] == [100.0, 95.0]
    assert [r["consistency_score"] for r in got] == [100.0, 98.0]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.35])
def test_injected_is_detected(spark, rate):
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("v").alias("t"), (F.col("id") % 50).cast("double").alias("stock"))
    hits = base.where(inject.hit("k", rate)).count()
    missing = TableProfile(inject.missing(base, "t", inject.hit("k", rate)), CFG)
    assert missing.columns[1].missing == hits
    copies = TableProfile(inject.duplicates(base, inject.hit("k", rate)), CFG)
    assert copies.duplicates == hits
    never = F.lit(False)
    bad = inject.invalid_range(base.where("stock > 0"), "stock", inject.hit("k", rate), never, never, 0)
    assert TableProfile(bad, CFG).columns[2].negative == base.where(inject.hit("k", rate) & (F.col("stock") > 0)).count()


def test_csv_with_line_breaks_is_refused_or_read_whole(spark, tmp_path):
    from assayer.sources.tables import read_csv

    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,"say ""yes"""\n')
    with pytest.raises(ValueError, match="multi_line"):
        read_csv(spark, str(tmp_path))
    rows = read_csv(spark, str(tmp_path), multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, 'say "yes"')]


def test_csv_round_trip_keeps_times_and_long_integers(spark, tmp_path):
    from assayer.sources.tables import read_csv, write_csv

    df = spark.sql(
        "SELECT 9223372036854775807 - id AS big, timestamp_ntz'2023-12-25 10:11:12.123' + make_dt_interval(id) AS at"
        " FROM range(50)"
    )
    write_csv(df, str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert back.select("big").distinct().count() == 50 and dict(back.dtypes)["big"] == "bigint"
    profile = TableProfile(back, Config(as_of=datetime(2024, 6, 1)))
    assert profile.freshness().first()["latest"] == datetime(2024, 2, 12, 10, 11, 12, 123000)
