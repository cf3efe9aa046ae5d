"""One query per operator, over the given tables and the views derived from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions import grades as g
from assayer.functions.numbers import outside_fences, percent, round_half_up
from assayer.operators import conversations, display, inject, remediate, rules
from assayer.operators import facts as roles
from assayer.operators import recommend as rec
from assayer.operators.columns import column_specs
from assayer.operators.duplicates import duplicate_rows
from assayer.operators.facts import gather_facts, time_layouts
from assayer.operators.impact import downstream_risks, exposure, outlier_exposure
from assayer.operators.issues import correlated_columns
from assayer.operators.missingness import strong_co_missing
from assayer.operators.profile import TableProfile
from assayer.operators.profile_state import profile_from_state, update_profile_state
from assayer.operators.quantiles import QUARTILES, grouped_quantiles
from assayer.operators.score import quality_score
from assayer.operators.small import small_frame
from assayer.plans.fixtures import dirty_events, dirty_orders, table
from assayer.plans.report import QualityReport
from assayer.sources import tables as src
from assayer.sources.workspace import checkpoint_root, new_folder
from assayer.streaming import quality as stream

Query = Callable[[SparkSession, str], DataFrame]

ORDERS_AS_OF = datetime(2001, 12, 15, 12)
EVENTS_AS_OF = datetime(2024, 2, 10, 6)
ORDERS = Config(as_of=ORDERS_AS_OF)
EVENTS = Config(as_of=EVENTS_AS_OF)
ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _profile(spark: SparkSession, folder: str) -> TableProfile:
    return TableProfile(dirty_orders(spark, folder), ORDERS)


def _report(spark: SparkSession, folder: str) -> QualityReport:
    return QualityReport(dirty_orders(spark, folder), ORDERS, "dirty_orders")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- sources and sinks ---------------------------------------------------------


@query
def scan_csv(spark, folder):
    path = new_folder(spark, "orders-csv")
    src.write_csv(table(spark, folder, "orders"), path)
    return src.read_csv(spark, path)


@query
def export_csv(spark, folder):
    path = new_folder(spark, "export-csv")
    src.write_csv(dirty_orders(spark, folder), path)
    return src.read_csv(spark, path, infer=False)


@query
def normalize_missing_tokens(spark, folder):
    k = F.col("c_custkey")
    tokens = F.array(*[F.lit(t) for t in ("N/A", "null", "", "#N/A", "None", "nan")])
    raw = table(spark, folder, "customer").select(
        k,
        F.when(k % 5 == 0, F.element_at(tokens, (k % 6 + 1).cast("int"))).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return src.normalise_missing(raw)


@query
def infer_column_roles(spark, folder):
    facts = gather_facts(dirty_orders(spark, folder), ORDERS)
    rows = [
        {
            "ordinal": c.spec.ordinal,
            "name": c.spec.name,
            "role": roles.role(c, ORDERS),
            "present": c.present,
            "numeric_count": c.numeric,
        }
        for c in facts.columns
    ]
    return small_frame(spark, rows, "ordinal int, name string, role string, present bigint, numeric_count bigint")


@query
def preview_rows(spark, folder):
    return src.preview(dirty_orders(spark, folder), ["order_id"], 200)


@query
def report_json(spark, folder):
    path = new_folder(spark, "report-json")
    src.write_json(_report(spark, folder).document(), path)
    return spark.read.schema("dataset string, report string").json(path)


# -- projections, filters, predicates --------------------------------------------


@query
def numeric_coercion_ratio(spark, folder):
    facts = gather_facts(dirty_orders(spark, folder), ORDERS)
    rows = [
        {"name": c.spec.name, "present": c.present, "numeric_count": c.numeric, "total_rows": c.rows}
        for c in facts.columns
        if c.spec.kind == "text"
    ]
    out = small_frame(spark, rows, "name string, present bigint, numeric_count bigint, total_rows bigint")
    return out.withColumn("numeric_ratio", round_half_up(F.col("numeric_count") / F.col("total_rows"), 4))


def _date_texts(spark: SparkSession, folder: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        F.when(k % 10 == 0, "pending").otherwise(F.date_format(d, "yyyy-MM-dd")).alias("day_text"),
        F.date_format(F.timestamp_add("MINUTE", (k % 1440).cast("int"), d), "yyyy-MM-dd HH:mm:ss").alias("moment_text"),
        F.when(k % 3 == 0, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")).alias("mixed_text"),
        F.when(k % 4 != 0, F.date_format(d, "yyyy/MM/dd")).alias("sparse_text"),
    )


@query
def datetime_coercion_ratio(spark, folder):
    facts = gather_facts(_date_texts(spark, folder), ORDERS)
    rows = [
        {
            "name": c.spec.name,
            "layout": c.layout.name,
            "parsed_count": c.timed,
            "total_rows": c.rows,
            "is_date": roles.is_dated(c, ORDERS),
        }
        for c in facts.columns
    ]
    out = small_frame(spark, rows, "name string, layout string, parsed_count bigint, total_rows bigint, is_date boolean")
    return out.withColumn("parsed_ratio", round_half_up(F.col("parsed_count") / F.col("total_rows"), 4))


@query
def datetime_layouts(spark, folder):
    """Texts of one time in layouts that files often hold."""
    t = F.col("o_orderdate").cast("timestamp")
    df = table(spark, folder, "orders").select(
        F.date_format(t, "dd/MM/yyyy").alias("day_first"),
        F.date_format(t, "d MMM yyyy").alias("month_name"),
        F.date_format(t, "yyyy-MM-dd HH:mm").alias("minutes"),
        F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(".123")).alias("millis"),
        F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(".123456789")).alias("nanos"),
        F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("zulu"),
        F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+05:30")).alias("offset"),
    )
    rows = [
        {"name": c.spec.name, "parsed_count": c.timed, "first_time": c.first_time, "last_time": c.last_time}
        for c in gather_facts(df, ORDERS).columns
    ]
    return small_frame(spark, rows, "name string, parsed_count bigint, first_time timestamp_ntz, last_time timestamp_ntz")


def _shaped_dates(spark: SparkSession, folder: str) -> DataFrame:
    """One time per order, in the layouts of many kinds of files."""
    t = F.timestamp_add("SECOND", (F.col("o_orderkey") % 86_400).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    text = lambda layout: F.date_format(t, layout)
    noon = F.when(F.hour(t) < 12, "AM").otherwise("PM")
    weekday = F.element_at(F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), F.weekday(t) + 1)
    odd = F.col("o_orderkey") % 50 == 0
    return table(spark, folder, "orders").select(
        text("yyyyMMdd").alias("compact"),
        text("MM/dd/yyyy HH:mm").alias("us_minutes"),
        F.concat(text("yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("utc_offset"),
        F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0230")).alias("plain_offset"),
        F.when(odd, "31.02.2023").otherwise(text("dd.MM.yyyy")).alias("dotted"),
        text("M/d/yyyy").alias("short"),
        F.when(F.col("o_orderkey") % 3 == 0, F.upper(text("d-MMM-yyyy"))).otherwise(text("dd-MMM-yyyy")).alias("month_name"),
        F.concat(weekday, F.lit(", "), text("dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("mail"),
        F.concat(text("M/d/yyyy h:mm:ss"), F.lit(" "), noon).alias("half_day"),
        F.when(F.dayofmonth(t) <= 12, text("dd/MM/yy")).alias("unclear"),
        F.concat(text("MMMM d"), F.lit(", "), text("yyyy")).alias("spelled"),
        F.when(odd, "n/a").otherwise(F.concat(F.lit("on "), text("yyyy-MM-dd"))).alias("prose"),
    )


@query
def date_layouts_by_shape(spark, folder):
    """Layouts found from the shapes of texts, what they read, and what stays unread or could be another day."""
    return time_layouts(_shaped_dates(spark, folder), ORDERS)


def _long_numbers(spark, folder) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("1"), F.lpad(key, 18, "0")).alias("id19"),
        F.concat(F.lit("7"), F.lpad(key, 24, "0")).alias("id25"),
        F.when(F.col("o_orderkey") % 9 == 0, "3.7").otherwise("9007199254740993").alias("mixed"),
    )


@query
def exact_integers(spark, folder):
    """Inferred types and casts that keep every digit."""
    df = src.infer_types(_long_numbers(spark, folder))
    kinds = F.lit(", ".join(kind for _, kind in df.dtypes)).alias("kinds")
    df = remediate.standardise(df, {"mixed": "bigint"})
    return df.select("id19", F.col("id25").cast("string").alias("id25"), F.col("mixed").alias("cast_mixed"), kinds)


@query
def integer_contract(spark, folder):
    return remediate.schema_contract(
        _long_numbers(spark, folder), {"id19": "int", "id25": "bigint", "mixed": "bigint"}
    )


@query
def inject_any_key(spark, folder):
    """Defects hit by negative and very large keys."""
    k = F.col("o_orderkey")
    key = F.when(k % 2 == 0, -k).otherwise(k + 9_000_000_000_000_000_000).alias("key")
    return inject.missing(table(spark, folder, "orders").select(key, "o_orderstatus"), "o_orderstatus", inject.hit("key", 0.2, 3))


@query
def outlier_rows_15(spark, folder):
    df = dirty_events(spark, folder)
    s = remediate.spread_of(df, "value", EVENTS)
    return df.where(outside_fences(F.nanvl("value", F.lit(None)), s.q1, s.q3, 1.5)).select(
        "event_id", "ts", "event_type", "value"
    )


@query
def outlier_rows_30(spark, folder):
    df = dirty_orders(spark, folder)
    s = remediate.spread_of(df, "amount_usd", ORDERS)
    return df.where(outside_fences(F.col("amount_usd"), s.q1, s.q3, 3.0)).select(
        "order_id", "order_ts", "channel", "amount_usd"
    )


@query
def negative_values(spark, folder):
    stats = _profile(spark, folder).stats(outliers=False, distinct=False)
    return stats.where(F.col("role") == "numeric").select("name", "negative_count")


@query
def whitespace_anomalies(spark, folder):
    stats = _profile(spark, folder).stats(outliers=False, distinct=False)
    return stats.where(F.col("dtype") == "string").select("name", "whitespace_count")


@query
def mixed_type_values(spark, folder):
    stats = _profile(spark, folder).stats(outliers=False, distinct=False)
    return stats.where(F.col("dtype") == "string").select("name", "mixed_count")


@query
def recs_filtered(spark, folder):
    kept = rec.with_effort_and_impact(_report(spark, folder).recommendations, ["Low"], ["Medium", "High"])
    return kept.drop("detail")


@query
def quick_wins(spark, folder):
    return rec.quick_wins(_report(spark, folder).recommendations).drop("detail")


@query
def email_format_violations(spark, folder):
    k, name = F.col("c_custkey"), F.lower(F.regexp_replace("c_name", "#", "."))
    mail = F.concat(name, F.lit("@shop-"), (k % 9).cast("string"), F.lit(".com"))
    df = table(spark, folder, "customer").select(
        k,
        F.when(k % 12 == 0, F.regexp_replace(mail, "@", " at "))
        .when(k % 12 == 5, F.concat(mail, F.lit(".")))
        .when(k % 12 != 7, mail)
        .alias("email"),
    )
    return rules.broken_rows(df, [rules.email("email")]).select("c_custkey", "email")


@query
def phone_format_violations(spark, folder):
    k = F.col("c_custkey")
    df = inject.phone_formats(table(spark, folder, "customer").select("c_custkey"), "c_custkey")
    df = df.withColumn(
        "phone",
        F.when(k % 11 == 0, F.substring("phone", 1, 6)).when(k % 11 == 4, F.concat("phone", F.lit(" x12"))).otherwise(F.col("phone")),
    )
    return rules.broken_rows(df, [rules.phone("phone")]).select("c_custkey", "phone")


@query
def phone_passages(spark, folder):
    """Runs of digits in the documents that are laid out like phone numbers but are none."""
    runs = F.regexp_extract_all("text", F.lit("([+(]?[0-9][0-9 ()-]{5,}[0-9])"), F.lit(1))
    df = table(spark, folder, "documents").select("doc_id", F.posexplode(runs).alias("place", "phone"))
    return rules.broken_rows(df, [rules.phone("phone")]).select("doc_id", "place", "phone")


@query
def offtopic_messages(spark, folder):
    return conversations.off_topic(table(spark, folder, "conversations"))


# -- profile ---------------------------------------------------------------------


@query
def dataset_shape(spark, folder):
    parts = []
    for name in ALL_TABLES:
        df = table(spark, folder, name)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("total_rows")).select(
                F.lit(name).alias("table_name"), "total_rows", F.lit(len(df.columns)).alias("total_cols")
            )
        )
    return _union(parts)


@query
def duplicate_rows_query(spark, folder):
    parts = []
    for name, df in (("dirty_orders", dirty_orders(spark, folder)), ("dirty_events", dirty_events(spark, folder))):
        parts.append(duplicate_rows(df).select(F.lit(name).alias("table_name"), "duplicate_count"))
    return _union(parts)


QUERIES["duplicate_rows"] = QUERIES.pop("duplicate_rows_query")


def _missing(df: DataFrame, name: str) -> DataFrame:
    out = roles.missing_counts(df)
    return out.withColumn("missing_pct", percent(F.col("missing_count"), F.col("total_rows"))).withColumn(
        "table_name", F.lit(name)
    )


def _missing_both(spark: SparkSession, folder: str) -> DataFrame:
    return _missing(dirty_orders(spark, folder), "dirty_orders").unionByName(
        _missing(dirty_events(spark, folder), "dirty_events")
    )


@query
def column_missing(spark, folder):
    return _missing_both(spark, folder).select("table_name", "ordinal", "name", "missing_count", "missing_pct")


@query
def missing_cells(spark, folder):
    cells = F.sum("total_rows").alias("total_cells")
    return (
        _missing_both(spark, folder)
        .groupBy("table_name")
        .agg(F.sum("missing_count").alias("missing_cells"), cells)
        .withColumn("missing_cell_pct", percent(F.col("missing_cells"), F.col("total_cells")))
    )


@query
def completeness_score(spark, folder):
    return missing_cells(spark, folder).select(
        "table_name", round_half_up(100.0 - F.col("missing_cell_pct"), 2).alias("completeness_score")
    )


@query
def column_distinct(spark, folder):
    stats = _profile(spark, folder).stats(outliers=False)
    return stats.select(
        "ordinal",
        "name",
        F.col("distinct_count").alias("unique_count"),
        percent(F.col("distinct_count"), F.col("total_rows")).alias("unique_pct"),
    )


@query
def column_distinct_approx(spark, folder):
    cfg = Config(as_of=ORDERS_AS_OF, distinct="approx")
    stats = TableProfile(dirty_orders(spark, folder), cfg).stats(outliers=False)
    return stats.select("ordinal", "name", F.col("distinct_count").alias("unique_count"))


def _numbers(spark: SparkSession, folder: str, cfg: Config = ORDERS) -> TableProfile:
    return TableProfile(table(spark, folder, "lineitem"), cfg)


@query
def numeric_moments(spark, folder):
    stats = _numbers(spark, folder).stats(outliers=False, distinct=False).where(F.col("role") == "numeric")
    return stats.select("name", *[round_half_up(F.col(f"raw_{m}"), 4).alias(m) for m in ("mean", "std", "min", "max")])


def _quartiles(p: TableProfile) -> DataFrame:
    rows = [
        {"name": c.spec.name, "q1": s.q1, "median": s.median, "q3": s.q3}
        for c in p.numeric
        for s in (p.spreads[c.spec.ordinal],)
    ]
    out = small_frame(p.spark, rows, "name string, q1 double, median double, q3 double")
    return out.select("name", *[round_half_up(F.col(q), 4).alias(q) for q in ("q1", "median", "q3")])


@query
def numeric_quartiles(spark, folder):
    return _quartiles(_numbers(spark, folder))


@query
def numeric_quartiles_approx(spark, folder):
    return _quartiles(_numbers(spark, folder, Config(as_of=ORDERS_AS_OF, quantiles="approx")))


@query
def quartiles_search(spark, folder):
    """The quartiles again, narrowed down in several rounds."""
    narrow = Config(as_of=ORDERS_AS_OF, quantile_values=50, sketch_size=64)
    return _quartiles(_numbers(spark, folder, narrow))


@query
def segment_quartiles_search(spark, folder):
    """Quartiles of each event type, narrowed down in several rounds."""
    df = dirty_events(spark, folder).select("event_type", F.nanvl("value", F.lit(None).cast("double")).alias("x"))
    narrow = Config(quantile_values=50, quantile_accuracy=100)
    found = grouped_quantiles(df, ["event_type"], "x", QUARTILES, narrow)
    at = F.col("quantiles")
    return found.select("event_type", "n", *[round_half_up(at[i], 4).alias(q) for i, q in enumerate(("q1", "median", "q3"))])


@query
def outlier_count(spark, folder):
    parts = []
    for name, df in (("lineitem", table(spark, folder, "lineitem")), ("dirty_events", dirty_events(spark, folder))):
        stats = TableProfile(df, ORDERS).stats(distinct=False).where(F.col("role") == "numeric")
        parts.append(
            stats.select(
                F.lit(name).alias("table_name"),
                "name",
                F.col("near_count").alias("outlier_count"),
                percent(F.col("near_count"), F.col("total_rows")).alias("outlier_pct"),
            )
        )
    return _union(parts)


@query
def outlier_count_with_negatives(spark, folder):
    stats = _profile(spark, folder).stats(distinct=False).where(F.col("role") == "numeric")
    return stats.select(
        "name", "near_count", "negative_count", "outlier_count",
        percent(F.col("outlier_count"), F.col("total_rows")).alias("outlier_pct"),
    )


@query
def outlier_rows_any_column(spark, folder):
    p = _profile(spark, folder)
    row = [{"total_outlier_rows": p.outliers.any_rows, "total_rows": p.facts.rows}]
    out = small_frame(spark, row, "total_outlier_rows bigint, total_rows bigint")
    return out.withColumn("total_outlier_pct", percent(F.col("total_outlier_rows"), F.col("total_rows")))


@query
def format_issue_count(spark, folder):
    stats = _profile(spark, folder).stats(outliers=False, distinct=False)
    return stats.where(F.col("dtype") == "string").select(
        "name", (F.col("whitespace_count") + F.col("mixed_count")).alias("format_issues")
    )


@query
def format_issue_examples(spark, folder):
    p = _profile(spark, folder)
    names = p.stats(outliers=False, distinct=False).select("ordinal", "name")
    return (
        p.value_summary.join(names, "ordinal")
        .select("name", F.posexplode("format_issue_examples").alias("place", "example"))
    )


@query
def top_values(spark, folder):
    p = _profile(spark, folder)
    names = p.stats(outliers=False, distinct=False).select("ordinal", "name")
    return (
        p.value_summary.join(names, "ordinal")
        .select("name", F.posexplode("top_values").alias("place", "v"))
        .select("name", "place", F.col("v.value").alias("value"), F.col("v.count").alias("value_count"))
    )


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("text", "lang", "source", "n_chars")


@query
def top_values_documents(spark, folder):
    """Most frequent values of columns with long texts, of which copies are many."""
    p = TableProfile(_documents(spark, folder), ORDERS)
    names = p.stats(outliers=False, distinct=False).select("ordinal", "name")
    return (
        p.value_summary.join(names, "ordinal")
        .select("name", F.posexplode("top_values").alias("place", "v"))
        .select("name", "place", F.col("v.value").alias("value"), F.col("v.count").alias("value_count"))
    )


@query
def column_distinct_documents(spark, folder):
    parts = []
    for name in ("documents", "pages", "lineitem"):
        stats = TableProfile(table(spark, folder, name), ORDERS).stats(outliers=False)
        parts.append(stats.select(F.lit(name).alias("table_name"), "name", F.col("distinct_count").alias("unique_count")))
    return _union(parts)


@query
def profile_state_grown(spark, folder):
    """Moments from the merged state of a table that has grown once; the second update reads the new files only."""
    lines, grown, state = table(spark, folder, "lineitem"), new_folder(spark, "grown"), new_folder(spark, "profile-state")
    late = F.coalesce(F.col("l_orderkey") % 5 == 0, F.lit(False))
    for part in (lines.where(~late), lines.where(late)):
        part.write.mode("append").parquet(grown)
        update_profile_state(spark, grown, state)
    measures = [round_half_up(F.col(m), 4).alias(m) for m in ("mean", "std", "min", "max")]
    merged = profile_from_state(spark, grown, state).where("numeric_count > 0")
    return merged.select("name", "total_rows", "missing_count", *measures)


@query
def duplicate_rows_documents(spark, folder):
    """Copies of whole rows with long texts: fingerprints find the suspects, their rows prove it."""
    return duplicate_rows(_documents(spark, folder))


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder).gather().dataset_profile


@query
def consistency_score(spark, folder):
    return _dataset(spark, folder).select("consistency_score")


@query
def validity_score_raw(spark, folder):
    return _dataset(spark, folder).select("total_outlier_rows", "validity_score")


@query
def uniqueness_score_raw(spark, folder):
    return _dataset(spark, folder).select("duplicate_pct", "uniqueness_score")


def _ages(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, cfg in (("orders", ORDERS), ("lineitem", ORDERS), ("events", EVENTS), ("customer", EVENTS)):
        parts.append(TableProfile(table(spark, folder, name), cfg).freshness().withColumn("table_name", F.lit(name)))
    parts.append(TableProfile(_date_texts(spark, folder), ORDERS).freshness().withColumn("table_name", F.lit("date_texts")))
    return _union(parts)


@query
def freshness(spark, folder):
    return _ages(spark, folder).select("table_name", "latest", "freshness_days", "freshness_flag")


@query
def schema_mixed_type(spark, folder):
    stats = _profile(spark, folder).stats(outliers=False, distinct=False)
    return stats.where("mixed_flag").select(
        "name", percent(F.col("numeric_count"), F.col("total_rows")).alias("numeric_pct")
    )


@query
def schema_empty_columns(spark, folder):
    return roles.missing_counts(dirty_orders(spark, folder)).where("missing_count = total_rows").select("name")


@query
def column_profile(spark, folder):
    return _profile(spark, folder).gather().column_profile.drop("top_values", "format_issue_examples", "total_rows")


@query
def dataset_profile(spark, folder):
    return _dataset(spark, folder).withColumn("schema_issues", F.size("schema_issues"))


# -- scores ------------------------------------------------------------------------


@query
def score_uniqueness(spark, folder):
    return _dataset(spark, folder).select(round_half_up(g.uniqueness_score(F.col("duplicate_pct")), 1).alias("uniqueness"))


@query
def score_validity(spark, folder):
    return _dataset(spark, folder).select(round_half_up(g.validity_score(F.col("total_outlier_pct")), 1).alias("validity"))


@query
def score_freshness(spark, folder):
    score = g.freshness_score(F.col("freshness_flag"), F.col("freshness_days"))
    return _ages(spark, folder).select("table_name", "freshness_flag", round_half_up(score, 1).alias("freshness"))


@query
def score_schema(spark, folder):
    n = F.size("schema_issues")
    return _dataset(spark, folder).select(n.alias("issue_count"), g.schema_score(n.cast("double")).alias("schema_score"))


def _score(spark: SparkSession, folder: str) -> DataFrame:
    return quality_score(_dataset(spark, folder))


@query
def ai_readiness(spark, folder):
    return _score(spark, folder).select("ai_readiness")


@query
def grade(spark, folder):
    return _score(spark, folder).select("ai_readiness", "grade", "verdict")


@query
def quality_score_query(spark, folder):
    return _score(spark, folder)


QUERIES["quality_score"] = QUERIES.pop("quality_score_query")


# -- root cause ----------------------------------------------------------------------


@query
def severity_bands(spark, folder):
    return column_missing(spark, folder).select("table_name", "name", "missing_pct", g.severity(F.col("missing_pct")).alias("severity"))


def _names(p: TableProfile) -> DataFrame:
    rows = [{"ordinal": s.ordinal, "name": s.name} for s in column_specs(p.df)]
    return small_frame(p.spark, rows, "ordinal int, name string")


@query
def missingness_jaccard(spark, folder):
    p = _profile(spark, folder)
    other = _names(p).select(F.col("ordinal").alias("other"), F.col("name").alias("other_name"))
    return (
        p.overlaps.join(_names(p), "ordinal")
        .join(other, "other")
        .select(
            "name",
            "other_name",
            F.col("both").alias("both_missing"),
            F.col("any").alias("any_missing"),
            round_half_up(F.col("jaccard"), 4).alias("jaccard"),
        )
    )


@query
def correlated_missingness(spark, folder):
    p = _profile(spark, folder)
    found = correlated_columns(p.overlaps, _names(p), ORDERS).join(_names(p), "ordinal")
    return found.select("name", F.explode("correlated").alias("correlated_with"))


@query
def category_outlier_concentration(spark, folder):
    p = _profile(spark, folder)
    return p.category_clusters.join(_names(p), "ordinal").drop("ordinal", "category_ordinal")


WIDE_GAPS = 150  # columns of the query below


@query
def missing_together_wide(spark, folder):
    """Many columns with gaps: most at random, some together with others."""
    k = F.col("o_orderkey")
    columns = []
    for c in range(WIDE_GAPS):
        base = c - c % 50 if c % 50 < 3 else c
        gap = (k * (2 * base + 1) + base * base) % 101 < 5
        if c % 50 == 1:
            gap = gap | (k % 10 == 3)
        columns.append(F.when(~gap, F.lit(1)).alias(f"c{c}"))
    df = table(spark, folder, "orders").select(*columns)
    specs = column_specs(df)
    counts = {r["ordinal"]: r["missing_count"] for r in roles.missing_counts(df).collect()}
    missing = [(s, counts[s.ordinal]) for s in specs if counts[s.ordinal]]
    found = strong_co_missing(df, missing, [s.ordinal for s, _ in missing], ORDERS.jaccard)
    return found.select("ordinal", "other", "both", "any", round_half_up(F.col("jaccard"), 4).alias("jaccard"))


@query
def category_outlier_many(spark, folder):
    """Sixty number and sixty text columns; the outliers of each number gather in one value of one text."""
    k = F.col("o_orderkey")
    numbers = [F.when(k % 211 == i, F.lit(1e9)).otherwise((k % 100).cast("double")).alias(f"n{i}") for i in range(60)]
    texts = [
        F.when(k % 211 % 60 == i, "culprit").otherwise(F.concat(F.lit("c"), (k % 7).cast("string"))).alias(f"t{i}") for i in range(60)
    ]
    p = TableProfile(table(spark, folder, "orders").select(*numbers, *texts), ORDERS)
    found = p.category_clusters.join(_names(p), "ordinal")
    return found.select("name", "category_column", "top_value", "outlier_count", "concentration_pct", "base_count")


@query
def category_outlier_wide(spark, folder):
    """The culprit is the sixth text column, and the outliers' dates are in the third date column, of 1995."""
    k = F.col("o_orderkey")
    bad = k % 97 < 4
    plain = [F.concat(F.lit(f"t{i}-"), (k * 7 + i).cast("string")).alias(f"text_{i}") for i in range(5)]
    old = F.date_add(F.lit("1995-01-01").cast("date"), (k % 3000).cast("int"))
    df = table(spark, folder, "orders").select(
        *plain,
        F.when(bad, "culprit").otherwise(F.concat(F.lit("fine "), (k % 5).cast("string"))).alias("text_5"),
        F.when(bad, F.col("o_totalprice") + 5000000).otherwise(F.col("o_totalprice")).alias("amount"),
        old.alias("day_0"),
        old.cast("string").alias("day_1"),
        F.when(bad, "1995-06-01").otherwise(old.cast("string")).alias("day_2"),
    )
    p = TableProfile(df, ORDERS)
    category = p.category_clusters.select("ordinal", F.col("category_column").alias("found"), "top_value", "outlier_count")
    date = p.date_clusters.select(
        "ordinal", F.col("date_column").alias("found"), F.col("from_date").cast("string"), "outlier_count_in_window"
    )
    return category.union(date).join(_names(p), "ordinal").drop("ordinal")


@query
def date_outlier_cluster(spark, folder):
    p = _profile(spark, folder)
    return p.date_clusters.join(_names(p), "ordinal").drop("ordinal", "date_ordinal")


_ISSUE = ("dimension", "severity", "title", "affected_column", "affected_rows", "affected_pct")


def _issues(dimension: str) -> Query:
    def run(spark, folder):
        return _report(spark, folder).issues.where(F.col("dimension") == dimension).select(*_ISSUE)

    return run


for _name, _dimension in {
    "issues_missing": "completeness",
    "issues_outlier": "validity",
    "issues_format": "consistency",
    "issues_duplicate": "uniqueness",
    "issues_schema": "schema",
    "issues_freshness": "freshness",
}.items():
    QUERIES[_name] = _issues(_dimension)


@query
def issue_evidence(spark, folder):
    """Evidence and correlated columns of each issue, with lists as texts."""
    e, share = F.col("evidence"), lambda c: F.round(c["concentration_pct"] * 10).cast("bigint")
    category = lambda c: F.concat_ws("/", c["column"], c["top_value"], c["outlier_count"], share(c), c["base_count"])
    window = lambda d: F.concat_ws("/", d["column"], d["window_days"], d["from"], d["to"], d["outlier_count_in_window"])
    return _report(spark, folder).issues.select(
        "ord", "dimension", "affected_column",
        *[e[c].alias(c) for c in ("missing_count", "missing_pct", "outlier_count", "outlier_pct", "min", "max", "q1", "q3", "mean")],
        F.array_join(F.transform(e["category_clusters"], category), ";").alias("category_clusters"),
        F.array_join(F.transform(e["date_clusters"], window), ";").alias("date_clusters"),
        F.array_join("correlated_columns", ",").alias("correlated_columns"),
        "evidence.format_issue_count", F.array_join(e["examples"], "|").alias("examples"),
        "evidence.duplicate_count", "evidence.duplicate_pct", F.size(e["schema_issues"]).alias("schema_issue_count"),
        "evidence.freshness_days", "evidence.freshness_flag",
    )


@query
def issues_ranked(spark, folder):
    return _report(spark, folder).issues.select("ord", *_ISSUE)


@query
def issue_summary(spark, folder):
    return _report(spark, folder).issue_summary.drop("summary")


# -- impact -----------------------------------------------------------------------------


@query
def value_column(spark, folder):
    parts = [(n, table(spark, folder, n)) for n in ("lineitem", "orders", "part", "events", "customer", "supplier")]
    parts.append(("dirty_orders", dirty_orders(spark, folder)))
    rows = []
    for name, df in parts:
        v = TableProfile(df, ORDERS).value_column
        rows.append({"table_name": name, "value_column": v.name if v else None, "currency": v.currency if v else "$"})
    return small_frame(spark, rows, "table_name string, value_column string, currency string")


@query
def exposure_outliers(spark, folder):
    v = _profile(spark, folder).value_column
    row = {"value_column": v.name, "outliers": v.far_count, "raw": outlier_exposure(v)}
    out = small_frame(spark, [row], "value_column string, outliers bigint, raw double")
    return out.withColumn("exposure", round_half_up(F.col("raw"), 2)).drop("raw")


@query
def exposure_duplicates(spark, folder):
    p = _profile(spark, folder)
    out = small_frame(spark, [{"affected_rows": p.duplicates}], "affected_rows bigint")
    return out.withColumn("exposure", exposure(F.lit("uniqueness"), F.col("affected_rows"), p.value_column))


@query
def exposure_missing(spark, folder):
    p = _profile(spark, folder)
    stats = p.stats(outliers=False, distinct=False).withColumn("affected_rows", F.col("total_rows") - F.col("present"))
    return stats.where(F.col("affected_rows") > 0).select(
        "name", "affected_rows", exposure(F.lit("completeness"), F.col("affected_rows"), p.value_column).alias("exposure")
    )


@query
def exposure_generic(spark, folder):
    p = _profile(spark, folder)
    stats = p.stats(outliers=False, distinct=False)
    stats = stats.withColumn("affected_rows", F.col("whitespace_count") + F.col("mixed_count"))
    return stats.where(F.col("affected_rows") > 0).select(
        "name", "affected_rows", exposure(F.lit("consistency"), F.col("affected_rows"), p.value_column).alias("exposure")
    )


@query
def downstream_risks_query(spark, folder):
    found = _report(spark, folder).issues.select("dimension").distinct()
    return found.select("dimension", F.posexplode(downstream_risks(F.col("dimension"))).alias("place", "risk"))


QUERIES["downstream_risks"] = QUERIES.pop("downstream_risks_query")


@query
def impact_estimates(spark, folder):
    return _report(spark, folder).impact.select(
        "ord", "issue_title", "dimension", "severity", "affected_rows", "affected_pct", "monetary_impact",
        "currency_symbol", F.size("downstream_risks").alias("risk_count"), "risk_level",
    )


@query
def summary_texts(spark, folder):
    """Sentences of the report, whole: both summaries, and of each issue its records and its money."""
    report = _report(spark, folder)
    one = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), F.lit(0).alias("ord"), F.col(text).alias("text"))
    parts = [one(report.impact_summary, "impact", "executive_summary"), one(report.issue_summary, "issues", "summary")]
    for kind, text in (("records", "record_impact_description"), ("money", "monetary_note")):
        parts.append(report.impact.select(F.lit(kind).alias("kind"), "ord", F.col(text).alias("text")))
    return _union(parts)


@query
def impact_summary(spark, folder):
    return _report(spark, folder).impact_summary.drop("executive_summary")


@query
def issue_impact_join(spark, folder):
    r = _report(spark, folder)
    return rec.issue_impact(r.issues, r.impact).select("ord", "title", "affected_rows", "monetary_impact", "risk_level")


# -- recommendations ---------------------------------------------------------------------


@query
def recommendation_candidates(spark, folder):
    return _report(spark, folder).recommendation_candidates.drop("detail")


@query
def recommendations_ranked(spark, folder):
    return _report(spark, folder).recommendations.drop("detail")


@query
def remediation_plan(spark, folder):
    return _report(spark, folder).plan


@query
def score_lift(spark, folder):
    return _report(spark, folder).plan.select("estimated_score_lift")


@query
def quality_report(spark, folder):
    return _report(spark, folder).summary_rows()


# -- narrative, digest, conversations ------------------------------------------------------


@query
def narrative_text(spark, folder):
    return _report(spark, folder).narrative()


@query
def analysis_digest(spark, folder):
    return _report(spark, folder).digest()


@query
def recent_turns(spark, folder):
    return conversations.recent_turns(table(spark, folder, "conversations"))


# -- display metrics ------------------------------------------------------------------------


@query
def column_health(spark, folder):
    return display.column_health(_profile(spark, folder).gather().column_profile)


@query
def metric_bands(spark, folder):
    p = _profile(spark, folder).gather()
    return display.metric_bands(p.column_profile, p.dataset_profile)


@query
def boxplot_positions(spark, folder):
    return display.boxplot_positions(_numbers(spark, folder).gather().column_profile)


@query
def category_bars(spark, folder):
    bars = display.category_bars(_profile(spark, folder).gather().column_profile)
    return bars.withColumnRenamed("count", "value_count").withColumnRenamed("rank", "place")


@query
def dimension_breakdown(spark, folder):
    return display.dimension_breakdown(_score(spark, folder)).drop("note")


# -- validation rules --------------------------------------------------------------------------


@query
def rule_upper_bound(spark, folder):
    return rules.validate(
        table(spark, folder, "lineitem"), [rules.upper_bound("l_quantity", 45), rules.upper_bound("l_discount", 0.08)]
    )


@query
def rule_non_negative(spark, folder):
    orders = rules.validate(dirty_orders(spark, folder), [rules.non_negative("quantity"), rules.non_negative("amount_usd")])
    return orders.unionByName(rules.validate(table(spark, folder, "customer"), [rules.non_negative("c_acctbal")]))


@query
def rule_non_zero(spark, folder):
    return rules.validate(table(spark, folder, "lineitem"), [rules.non_zero("l_discount"), rules.non_zero("l_tax")])


@query
def rule_denied_values(spark, folder):
    return rules.validate(
        table(spark, folder, "orders"),
        [
            rules.denied_values("o_orderpriority", ["5-LOW", "4-NOT SPECIFIED"]),
            rules.allowed_values("o_orderstatus", ["O", "F"]),
        ],
    )


@query
def rule_column_order(spark, folder):
    return rules.validate(table(spark, folder, "lineitem"), [rules.column_order("l_discount", "l_tax")])


@query
def rule_unique_key(spark, folder):
    return _union(
        [
            rules.unique_key(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]),
            rules.unique_key(table(spark, folder, "orders"), ["o_orderkey"]),
            rules.unique_key(dirty_orders(spark, folder), ["order_id"]),
        ]
    )


@query
def rule_stale_rows(spark, folder):
    return rules.validate(
        table(spark, folder, "lineitem"),
        [rules.max_age("l_shipdate", ORDERS_AS_OF, 180), rules.max_age("l_shipdate", ORDERS_AS_OF, 720)],
    )


@query
def rule_not_null(spark, folder):
    return rules.validate(dirty_orders(spark, folder), [rules.not_null(c) for c in ("status", "priority", "legacy_code", "note")])


@query
def rule_pattern(spark, folder):
    return rules.validate(dirty_orders(spark, folder), [rules.digits("order_ref"), rules.digits("code_mix")])


# -- defect injection -----------------------------------------------------------------------------


@query
def inject_missing(spark, folder):
    df = table(spark, folder, "customer")
    return inject.missing(df, "c_mktsegment", inject.hit("c_custkey", 0.12))


@query
def inject_duplicates(spark, folder):
    return inject.duplicates(table(spark, folder, "orders"), inject.hit("o_orderkey", 0.08))


@query
def inject_outliers(spark, folder):
    big = 900_000.0 + F.col("o_orderkey") % 1000
    return inject.outliers(table(spark, folder, "orders"), "o_totalprice", inject.hit("o_orderkey", 0.05, 1), big)


@query
def inject_date_cluster(spark, folder):
    k = F.col("o_orderkey")
    return inject.date_cluster(
        table(spark, folder, "orders"), "o_totalprice", "o_orderdate", inject.hit("o_orderkey", 0.075, 2),
        2_000_000.0 + k % 1000, datetime(2001, 3, 12), k % 48,
    )


@query
def inject_unit_bug(spark, folder):
    where = (F.col("p_type") == "ECONOMY") & inject.hit("p_partkey", 0.2, 3)
    return inject.unit_bug(table(spark, folder, "part"), "p_retailprice", where, 100.0)


@query
def inject_mixed_type(spark, folder):
    df = table(spark, folder, "orders").withColumn("order_ref", F.col("o_orderkey"))
    return inject.mixed_type(df, "order_ref", inject.hit("o_orderkey", 0.12, 4), "ORD-")


@query
def inject_invalid_range(spark, folder):
    key = "l_orderkey"
    return inject.invalid_range(
        table(spark, folder, "lineitem"), "l_quantity", inject.hit(key, 0.04, 5), inject.hit(key, 0.035, 6),
        inject.hit(key, 0.025, 7), 1000,
    )


@query
def inject_casing(spark, folder):
    k = F.col("c_custkey")
    return inject.casing(table(spark, folder, "customer"), "c_mktsegment", k % 10 < 2, k % 10 == 5)


@query
def inject_invalid_category(spark, folder):
    bad = ["AB++", "O+-", "B++", "XY", "N/A"]
    return inject.invalid_category(
        table(spark, folder, "orders"), "o_orderstatus", inject.hit("o_orderkey", 0.04, 8), bad, F.col("o_orderkey")
    )


@query
def inject_empty_column(spark, folder):
    return inject.empty_column(table(spark, folder, "customer"), "claim_id")


@query
def inject_stale_dates(spark, folder):
    return inject.stale_dates(table(spark, folder, "orders"), "o_orderdate", inject.hit("o_orderkey", 0.3, 9), 400)


@query
def inject_duplicate_keys(spark, folder):
    return inject.duplicate_keys(table(spark, folder, "part"), "p_partkey", inject.hit("p_partkey", 0.05, 10))


@query
def inject_phone_formats(spark, folder):
    return inject.phone_formats(table(spark, folder, "customer"), "c_custkey")


@query
def inject_fractional(spark, folder):
    return inject.fractional(table(spark, folder, "part"), "p_size", inject.hit("p_partkey", 0.06, 11))


@query
def inject_column_order(spark, folder):
    df = table(spark, folder, "part").withColumn("mrp", F.col("p_retailprice") * 1.5)
    return inject.column_order(df, "mrp", "p_retailprice", inject.hit("p_partkey", 0.03, 12), 0.8)


# -- remediation --------------------------------------------------------------------------------------


@query
def quarantine_missing(spark, folder):
    return remediate.quarantine(dirty_events(spark, folder), ["value"]).select("event_id", "ts", "event_type")


@query
def clean_rows(spark, folder):
    return remediate.clean(dirty_events(spark, folder), ["value"])


@query
def impute_median(spark, folder):
    return remediate.impute_median(dirty_events(spark, folder), "value", EVENTS)


@query
def impute_mode(spark, folder):
    return remediate.impute_mode(dirty_orders(spark, folder), "status").select("order_id", "status", "status_imputed")


@query
def range_rule_violations(spark, folder):
    return remediate.range_violations(table(spark, folder, "events"), "value", EVENTS)


@query
def kpi_recalculated(spark, folder):
    kpi = remediate.recalculated_kpi(dirty_orders(spark, folder), "amount_usd", ORDERS)
    return kpi.select(
        "rows_all", "rows_kept", *[round_half_up(F.col(c), 2).alias(c) for c in ("sum_all", "sum_kept", "mean_all", "mean_kept")]
    )


@query
def standardize_format(spark, folder):
    df = remediate.standardise(dirty_orders(spark, folder), {"note": None, "code_mix": "bigint", "order_ref": "double"}, ["note"])
    return df.select("order_id", "note", "code_mix", "order_ref")


@query
def dedup_latest(spark, folder):
    return remediate.keep_latest(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate",
        ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
    )


@query
def dedup_exact(spark, folder):
    return remediate.drop_copies(dirty_orders(spark, folder))


@query
def schema_contract(spark, folder):
    return remediate.schema_contract(
        dirty_orders(spark, folder),
        {"order_id": "bigint", "order_ref": "bigint", "code_mix": "double", "amount_usd": "double", "batch_id": "string"},
    )


@query
def freshness_sla(spark, folder):
    late = remediate.freshness_sla(table(spark, folder, "events"), "ts", EVENTS_AS_OF)
    fresh = remediate.freshness_sla(table(spark, folder, "events"), "ts", datetime(2024, 1, 30, 12))
    return late.withColumn("checked_at", F.lit("late")).unionByName(fresh.withColumn("checked_at", F.lit("soon")))


@query
def segment_outliers(spark, folder):
    df = remediate.segment_outliers(dirty_events(spark, folder), "event_type", "value", EVENTS)
    return df.select("event_id", "ts", "event_type", "value")


# -- streams --------------------------------------------------------------------------------------------


def _value() -> Column:
    return F.col("value")


@query
def daily_quality(spark, folder):
    df = dirty_events(spark, folder)
    return stream.daily_quality(df, "ts", _value(), remediate.spread_of(df, "value", EVENTS))


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stream.read_growing_table(spark, folder, table(spark, folder, "events"), "events.parquet")


@query
def daily_quality_stream(spark, folder):
    history = remediate.spread_of(table(spark, folder, "events"), "value", EVENTS)
    days = stream.daily_quality(_event_stream(spark, folder), "ts", _value(), history)
    output = new_folder(spark, "daily-quality")
    stream.update_days(days, output, f"{output}-progress")
    return stream.read_days(spark, output)


@query
def daily_quality_watermark(spark, folder):
    """Events that arrive in the order of their times, but each seventh after all others."""
    events = table(spark, folder, "events")
    history = remediate.spread_of(events, "value", EVENTS)
    arrivals, output = new_folder(spark, "arrivals"), new_folder(spark, "monitor")
    late = F.coalesce(F.col("event_id") % 7 == 0, F.lit(False))
    events.where(~late).repartitionByRange(6, "ts").write.parquet(arrivals)
    events.where(late).write.mode("append").parquet(arrivals)
    arriving = stream.read_growing_table(spark, arrivals, events, files_per_batch=2)
    stream.monitor_days(arriving, "ts", _value(), history, output, f"{output}-progress")
    return stream.monitored_days(spark, output)


@query
def idempotent_ingest_stream(spark, folder):
    events = _event_stream(spark, folder)
    replayed = events.unionByName(events.where(F.col("event_id") % 41 < 2))
    output = new_folder(spark, "first-arrivals")
    stream.ingest_once(replayed, ["event_id"], output, f"{output}-progress")
    return stream.read_ingested(spark, output)


def prepare(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder before the first query needs one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
