"""Independent SQL answer per query, for DuckDB."""

from __future__ import annotations

from assayer.oracle.parts import (
    ACTIONS,
    CLUSTERS,
    DIRTY_EVENTS,
    DIRTY_ORDERS,
    EVENTS_AS_OF,
    IMPACT,
    ISSUES,
    ORDER_COLUMNS,
    ORDER_DATASET,
    ORDER_PROFILE,
    ORDER_TEXTS,
    ORDERS_AS_OF,
    PAIRS,
    long_numbers,
    number,
    number_stats,
    pct,
    rounded,
    severity,
    union,
)
from assayer.oracle.values import MISSING_TOKENS, OFF_TOPIC_PHRASES, RISKS, VALUE_WORDS, VERDICTS

LINEITEM_NUMBERS = [
    (i, n, f"{n}::DOUBLE")
    for i, n in enumerate(
        ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
]
EVENT_NUMBERS = [(0, "event_id", "event_id::DOUBLE"), (2, "user_id", "user_id::DOUBLE"), (4, "value", "value")]
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")
ALL_TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _hit(key: str, rate: int, salt: int = 0) -> str:
    return f"({key}*7919 + {salt}*104729) % 1000 < {rate}"


DATE_TEXTS = """
date_texts AS (
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_text,
    strftime(o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER), '%Y-%m-%d %H:%M:%S') AS moment_text,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS mixed_text,
    CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y/%m/%d') END AS sparse_text
  FROM orders)"""

LAYOUTS = (
    ("day_text", "yyyy-MM-dd", "%Y-%m-%d"),
    ("moment_text", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("mixed_text", "MM/dd/yyyy", "%m/%d/%Y"),
    ("sparse_text", "yyyy/MM/dd", "%Y/%m/%d"),
)


def _missing(table: str, columns) -> str:
    def test(c):
        return f"{c} IS NULL OR isnan({c})" if c == "value" else f"{c} IS NULL"

    return union(
        f"SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS name, "
        f"count(*) FILTER (WHERE {test(c)})::BIGINT AS missing_count, count(*)::BIGINT AS total_rows FROM {table}"
        for i, c in enumerate(columns)
    )


MISSING = f"""WITH {DIRTY_ORDERS}, {DIRTY_EVENTS},
missing AS ({_missing("dirty_orders", [n for _, n, *_ in ORDER_COLUMNS])} UNION ALL {_missing("dirty_events", EVENT_COLUMNS)}),
cells AS (SELECT table_name, sum(missing_count)::BIGINT AS missing_cells, sum(total_rows)::BIGINT AS total_cells
  FROM missing GROUP BY table_name)"""

AGES = f"""WITH {DATE_TEXTS},
latest AS (
  SELECT 'orders' AS table_name, max(o_orderdate) AS latest, {ORDERS_AS_OF} AS as_of FROM orders
  UNION ALL SELECT 'lineitem', max(l_shipdate), {ORDERS_AS_OF} FROM lineitem
  UNION ALL SELECT 'events', max(ts), {EVENTS_AS_OF} FROM events
  UNION ALL SELECT 'customer', NULL, {EVENTS_AS_OF}
  UNION ALL SELECT 'date_texts', greatest(max(try_strptime(day_text, '%Y-%m-%d')),
    max(try_strptime(moment_text, '%Y-%m-%d %H:%M:%S'))), {ORDERS_AS_OF} FROM date_texts),
aged AS (SELECT *, floor((epoch_us(as_of) - epoch_us(latest))/86400000000::DOUBLE)::DOUBLE AS freshness_days FROM latest),
ages AS (SELECT *, CASE WHEN freshness_days IS NULL THEN 'UNKNOWN' WHEN freshness_days <= 30 THEN 'OK' ELSE 'STALE' END
  AS freshness_flag FROM aged)"""

_EVENT_QUARTILES = f"""WITH {DIRTY_EVENTS},
vals AS (SELECT value AS x FROM dirty_events WHERE value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM vals)"""


def _fence(x: str, factor: str) -> str:
    return f"({x} < q1 - {factor}::DOUBLE*(q3-q1) OR {x} > q3 + {factor}::DOUBLE*(q3-q1))"


def _rule(name: str, column: str, table: str, test: str) -> str:
    n = f"count(*) FILTER (WHERE {test})"
    return (
        f"SELECT '{name}' AS rule, '{column}' AS \"column\", {n}::BIGINT AS failed_rows, {pct(n, 'count(*)')} AS failed_pct FROM {table}"
    )


def _unique(table: str, keys: str) -> str:
    return (
        f"SELECT 'unique_key' AS rule, '{keys}' AS \"column\", sum(n - 1)::BIGINT AS failed_rows, {pct('sum(n - 1)', 'sum(n)')} AS failed_pct "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"
    )


_MAIL = "lower(replace(c_name, '#', '.')) || '@shop-' || (c_custkey % 9)::VARCHAR || '.com'"
_PHONE_NUMBER = "(6000000000 + c_custkey*7919 % 3999999999)::VARCHAR"
_PHONE = f"""CASE c_custkey % 4
  WHEN 0 THEN '+91-' || substr({_PHONE_NUMBER}, 1, 5) || '-' || substr({_PHONE_NUMBER}, 6, 5)
  WHEN 1 THEN {_PHONE_NUMBER} WHEN 2 THEN '91' || {_PHONE_NUMBER}
  ELSE '(' || substr({_PHONE_NUMBER}, 1, 3) || ') ' || substr({_PHONE_NUMBER}, 4, 5) || '-' || substr({_PHONE_NUMBER}, 9, 2) END"""

_STATS_ROUNDED = ", ".join(
    f"{rounded(c, 4)} AS {a}"
    for c, a in (("mean", "mean"), ("std", "std"), ("lo", "min"), ("hi", "max"), ("q1", "q1"), ("med", "median"), ("q3", "q3"))
)

_VALUE_TABLES = {
    "lineitem": [n for _, n, _ in LINEITEM_NUMBERS],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "events": ["event_id", "user_id", "value"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "dirty_orders": ["order_id", "amount_usd", "quantity"],
}
_VALUE_MEDIANS = union(
    f"SELECT '{t}' AS table_name, {i} AS pos, '{c}' AS name, median({c}::DOUBLE) AS med FROM {t}"
    for t, cols in _VALUE_TABLES.items()
    for i, c in enumerate(cols)
)

_CATEGORIES = [n for _, n, _, role, _ in ORDER_COLUMNS if role == "categorical"]
_ORDER_VALUE_COUNTS = union(
    f"SELECT {o} AS ordinal, '{n}' AS name, {n}::VARCHAR AS value, count(*)::BIGINT AS n FROM dirty_orders WHERE {n} IS NOT NULL GROUP BY {n}"
    for o, n, _, role, _ in ORDER_COLUMNS
    if role == "categorical"
)
TOP_VALUES = f"""WITH {DIRTY_ORDERS}, vc AS ({_ORDER_VALUE_COUNTS}),
top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM vc QUALIFY place <= 5)"""

_PLAN_ACTIONS = "string_agg(action, '; ' ORDER BY priority)"

_LATEST_ORDER = ", ".join(
    f"{c} DESC"
    for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
)


def _contract(column: str, expected: str, actual: str, failed: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", '{expected}' AS expected, '{actual}' AS actual, ({failed})::BIGINT AS failed_rows, "
        f"{pct(failed, 'count(*)')} AS failed_pct FROM dirty_orders"
    )


_BANDS = (("missing", 10, 3), ("duplicates", 5, 1), ("column_missing", 20, 5), ("column_outliers", 10, 2), ("numeric_outliers", 5, 1))


def _band(metric: str, subject: str, value: str, source: str) -> str:
    bad, warn = next((b, w) for m, b, w in _BANDS if m == metric)
    return (
        f"SELECT '{metric}' AS metric, {subject} AS subject, {value} AS pct, CASE WHEN {value} > {bad} THEN 'bad' "
        f"WHEN {value} > {warn} THEN 'warn' ELSE 'ok' END AS band FROM {source}"
    )


def _place(c: str, flat: int) -> str:
    return rounded(f"CASE WHEN max = min THEN {flat}::DOUBLE ELSE least(100::DOUBLE, greatest(0::DOUBLE, ({c} - min)/(max - min)*100::DOUBLE)) END", 1)


_ISSUE = "dimension, severity, title, affected_column, affected_rows, affected_pct"

_DAILY = """SELECT date_trunc('day', ts) AS day_start, date_trunc('day', ts) + INTERVAL 1 DAY AS day_end,
  count(*)::BIGINT AS row_count, count(*) FILTER (WHERE value IS NULL OR isnan(value))::BIGINT AS missing_count,
  count(*) FILTER (WHERE NOT isnan(value) AND {fence})::BIGINT AS outlier_count
  FROM {source} CROSS JOIN q GROUP BY ALL"""

ANSWERS: dict[str, str] = {
    # sources and sinks
    "scan_csv": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "export_csv": f"WITH {DIRTY_ORDERS} SELECT order_id::VARCHAR AS order_id, strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts, status, priority, priority_group, channel, amount_usd::VARCHAR AS amount_usd, quantity::VARCHAR AS quantity, order_ref, code_mix, note, is_returned::VARCHAR AS is_returned, legacy_code FROM dirty_orders",
    "normalize_missing_tokens": f"""WITH raw AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN
        ['N/A', 'null', '', '#N/A', 'None', 'nan'][(c_custkey % 6 + 1)::INTEGER] ELSE c_mktsegment END AS segment FROM customer)
        SELECT c_custkey, CASE WHEN segment IN ({_quoted(MISSING_TOKENS)}) THEN NULL ELSE segment END AS segment FROM raw""",
    "infer_column_roles": f"WITH {DIRTY_ORDERS} " + union(
        f"SELECT {o} AS ordinal, '{n}' AS name, '{r}' AS role, count({n})::BIGINT AS present, "
        f"count({n if d in ('bigint', 'double') else number(n) if d == 'string' else 'NULL'})::BIGINT AS numeric_count FROM dirty_orders"
        for o, n, d, r, _ in ORDER_COLUMNS
    ),
    "preview_rows": f"WITH {DIRTY_ORDERS} SELECT " + ", ".join(f"coalesce({n}::VARCHAR, '') AS {n}" for _, n, *_ in ORDER_COLUMNS)
    + " FROM (SELECT * FROM dirty_orders ORDER BY order_id LIMIT 200)",
    # predicates
    "numeric_coercion_ratio": f"WITH {DIRTY_ORDERS} " + union(
        f"SELECT '{n}' AS name, count({n})::BIGINT AS present, count({number(n)})::BIGINT AS numeric_count, count(*)::BIGINT AS total_rows, "
        f"{rounded(f'count({number(n)})/count(*)::DOUBLE', 4)} AS numeric_ratio FROM dirty_orders"
        for _, n, _ in ORDER_TEXTS
    ),
    "datetime_coercion_ratio": f"WITH {DATE_TEXTS} " + union(
        f"SELECT '{c}' AS name, '{layout}' AS layout, count(try_strptime({c}, '{f}'))::BIGINT AS parsed_count, count(*)::BIGINT AS total_rows, "
        f"count(try_strptime({c}, '{f}'))/count(*)::DOUBLE > 0.8 AS is_date, "
        f"{rounded(f'''count(try_strptime({c}, '{f}'))/count(*)::DOUBLE''', 4)} AS parsed_ratio FROM date_texts"
        for c, layout, f in LAYOUTS
    ),
    "outlier_rows_15": f"{_EVENT_QUARTILES} SELECT event_id, ts, event_type, value FROM dirty_events CROSS JOIN q WHERE NOT isnan(value) AND {_fence('value', '1.5')}",
    "outlier_rows_30": f"WITH {DIRTY_ORDERS}, q AS (SELECT quantile_cont(amount_usd, 0.25) AS q1, quantile_cont(amount_usd, 0.75) AS q3 FROM dirty_orders) SELECT order_id, order_ts, channel, amount_usd FROM dirty_orders CROSS JOIN q WHERE {_fence('amount_usd', '3')}",
    "negative_values": f"WITH {ORDER_PROFILE} SELECT name, negative AS negative_count FROM outl",
    "whitespace_anomalies": f"WITH {ORDER_PROFILE} SELECT name, whitespace_count FROM texts",
    "mixed_type_values": f"WITH {ORDER_PROFILE} SELECT name, mixed_count FROM texts",
    "recs_filtered": f"WITH {ACTIONS} SELECT * FROM recs WHERE effort = 'Low' AND impact IN ('Medium', 'High')",
    "quick_wins": f"WITH {ACTIONS} SELECT * FROM recs WHERE effort = 'Low' AND impact = 'High'",
    "email_format_violations": f"""WITH mails AS (SELECT c_custkey, CASE WHEN c_custkey % 12 = 0 THEN replace({_MAIL}, '@', ' at ')
        WHEN c_custkey % 12 = 5 THEN {_MAIL} || '.' WHEN c_custkey % 12 = 7 THEN NULL ELSE {_MAIL} END AS email FROM customer)
        SELECT * FROM mails WHERE NOT regexp_full_match(email, '[\\w\\.\\+\\-]+@[\\w\\-]+\\.[a-zA-Z]{{2,}}')""",
    "phone_format_violations": f"""WITH phones AS (SELECT c_custkey, {_PHONE} AS p FROM customer),
        dirty AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN substr(p, 1, 6) WHEN c_custkey % 11 = 4 THEN p || ' x12' ELSE p END AS phone FROM phones)
        SELECT * FROM dirty WHERE NOT regexp_full_match(phone, '[\\+\\d\\s\\-\\(\\)]{{7,15}}')""",
    "offtopic_messages": "SELECT * FROM conversations WHERE " + " OR ".join(f"contains(lower(text), '{p}')" for p in OFF_TOPIC_PHRASES),
    # profile
    "dataset_shape": union(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS total_rows, {n} AS total_cols FROM {t}" for t, n in ALL_TABLES.items()),
    "duplicate_rows": f"""WITH {DIRTY_ORDERS}, {DIRTY_EVENTS}
        SELECT 'dirty_orders' AS table_name, sum(c - 1)::BIGINT AS duplicate_count FROM (SELECT count(*) AS c FROM dirty_orders GROUP BY {", ".join(n for _, n, *_ in ORDER_COLUMNS)})
        UNION ALL SELECT 'dirty_events', sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM
          (SELECT * REPLACE (CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM dirty_events) GROUP BY {", ".join(EVENT_COLUMNS)})""",
    "column_missing": f"{MISSING} SELECT table_name, ordinal, name, missing_count, {pct('missing_count', 'total_rows')} AS missing_pct FROM missing",
    "missing_cells": f"{MISSING} SELECT table_name, missing_cells, total_cells, {pct('missing_cells', 'total_cells')} AS missing_cell_pct FROM cells",
    "completeness_score": f"{MISSING} SELECT table_name, {rounded('100::DOUBLE - ' + pct('missing_cells', 'total_cells'), 2)} AS completeness_score FROM cells",
    "column_distinct": f"WITH {ORDER_PROFILE} SELECT ordinal, name, unique_count, unique_pct FROM cols",
    "numeric_moments": f"WITH nums AS ({long_numbers('lineitem', LINEITEM_NUMBERS)}) SELECT name, {rounded('avg(x)', 4)} AS mean, {rounded('stddev_samp(x)', 4)} AS std, {rounded('min(x)', 4)} AS min, {rounded('max(x)', 4)} AS max FROM nums GROUP BY name",
    "numeric_quartiles": f"WITH nums AS ({long_numbers('lineitem', LINEITEM_NUMBERS)}) SELECT name, {rounded('quantile_cont(x, 0.25)', 4)} AS q1, {rounded('quantile_cont(x, 0.5)', 4)} AS median, {rounded('quantile_cont(x, 0.75)', 4)} AS q3 FROM nums GROUP BY name",
    "segment_quartiles_search": f"""WITH {DIRTY_EVENTS}
        SELECT event_type, count(*) AS n, {rounded('quantile_cont(value, 0.25)', 4)} AS q1, {rounded('quantile_cont(value, 0.5)', 4)} AS median,
          {rounded('quantile_cont(value, 0.75)', 4)} AS q3 FROM dirty_events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""",
    "category_outlier_wide": """SELECT 'amount' AS name, found, top_value, count(*) AS outlier_count FROM orders,
          (VALUES (0, 'text_5', 'culprit'), (1, 'day_2', '1995-06-01'), (2, 'day_2', '1995-06-01')) AS v(kind, found, top_value)
          WHERE o_orderkey % 97 < 4 GROUP BY kind, found, top_value""",
    "outlier_count": f"""WITH {DIRTY_EVENTS}, ln AS ({long_numbers('lineitem', LINEITEM_NUMBERS)}), {number_stats('ln', 'l')},
        en AS ({long_numbers('dirty_events', EVENT_NUMBERS)}), {number_stats('en', 'e')}
        SELECT 'lineitem' AS table_name, name, near AS outlier_count, {pct('near', '(SELECT count(*) FROM lineitem)')} AS outlier_pct FROM l_o
        UNION ALL SELECT 'dirty_events', name, near, {pct('near', '(SELECT count(*) FROM dirty_events)')} FROM e_o""",
    "outlier_count_with_negatives": f"WITH {ORDER_PROFILE} SELECT name, near AS near_count, negative AS negative_count, outlier_count, outlier_pct FROM cols WHERE role = 'numeric'",
    "outlier_rows_any_column": f"WITH {ORDER_DATASET} SELECT total_outlier_rows, total_rows, total_outlier_pct FROM dataset",
    "format_issue_count": f"WITH {ORDER_PROFILE} SELECT name, whitespace_count + mixed_count AS format_issues FROM texts",
    "format_issue_examples": f"""WITH {DIRTY_ORDERS}, vc AS ({_ORDER_VALUE_COUNTS}),
        bad AS (SELECT name, value, 'w' AS kind FROM vc WHERE regexp_matches(value, '^\\s|\\s$')
          UNION ALL SELECT name, value, 'n' FROM vc WHERE name = 'code_mix' AND {number('value')} IS NULL),
        few AS (SELECT DISTINCT name, value FROM (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY name, kind ORDER BY value) <= 3))
        SELECT name, (row_number() OVER (PARTITION BY name ORDER BY value) - 1)::INTEGER AS place, value AS example FROM few QUALIFY place < 5""",
    "top_values": f"{TOP_VALUES} SELECT name, (place - 1)::INTEGER AS place, value, n AS value_count FROM top",
    "consistency_score": f"WITH {ORDER_DATASET} SELECT consistency_score FROM dataset2",
    "validity_score_raw": f"WITH {ORDER_DATASET} SELECT total_outlier_rows, validity_score FROM dataset2",
    "uniqueness_score_raw": f"WITH {ORDER_DATASET} SELECT duplicate_pct, uniqueness_score FROM dataset2",
    "freshness": f"{AGES} SELECT table_name, latest, freshness_days, freshness_flag FROM ages",
    "schema_mixed_type": f"WITH {ORDER_PROFILE} SELECT name, {pct('numeric_count', 'n_rows')} AS numeric_pct FROM texts CROSS JOIN total WHERE numeric_count/n_rows::DOUBLE > 0.1 AND numeric_count/n_rows::DOUBLE < 0.9",
    "schema_empty_columns": f"WITH {ORDER_PROFILE} SELECT name FROM cols WHERE missing_count = n_rows",
    "column_profile": f"WITH {ORDER_PROFILE} SELECT ordinal, name, dtype, role, missing_count, missing_pct, unique_count, unique_pct, {_STATS_ROUNDED}, outlier_count, outlier_pct, format_issues FROM cols",
    "dataset_profile": f"""WITH {ORDER_DATASET} SELECT total_rows, total_cols, duplicate_count, duplicate_pct, completeness_score, consistency_score,
        uniqueness_score, validity_score, freshness_days, freshness_flag, total_outlier_rows, total_outlier_pct, schema_issues::INTEGER AS schema_issues,
        missing_cells, missing_cell_pct FROM dataset2""",
    # scores
    "score_uniqueness": f"WITH {ORDER_DATASET} SELECT {rounded('u', 1)} AS uniqueness FROM raw_score",
    "score_validity": f"WITH {ORDER_DATASET} SELECT {rounded('v', 1)} AS validity FROM raw_score",
    "score_freshness": f"""{AGES} SELECT table_name, freshness_flag, {rounded('''CASE freshness_flag WHEN 'OK' THEN 100::DOUBLE WHEN 'STALE'
        THEN greatest(20::DOUBLE, 100::DOUBLE - (freshness_days - 30::DOUBLE)*(80::DOUBLE/335::DOUBLE)) ELSE 60::DOUBLE END''', 1)} AS freshness FROM ages""",
    "score_schema": f"WITH {ORDER_DATASET} SELECT schema_issues::INTEGER AS issue_count, s AS schema_score FROM raw_score",
    "ai_readiness": f"WITH {ORDER_DATASET} SELECT ai_readiness FROM graded",
    "grade": f"WITH {ORDER_DATASET} SELECT ai_readiness, grade, CASE grade " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICTS.items()) + " END AS verdict FROM graded",
    "quality_score": f"""WITH {ORDER_DATASET} SELECT ai_readiness, {rounded('completeness_score', 1)} AS completeness, {rounded('consistency_score', 1)} AS consistency,
        {rounded('u', 1)} AS uniqueness, {rounded('v', 1)} AS validity, {rounded('f', 1)} AS freshness, {rounded('s', 1)} AS schema, grade,
        CASE grade {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICTS.items())} END AS verdict, missing_cell_pct AS missing_pct, duplicate_pct,
        total_outlier_pct AS outlier_pct, schema_issues::INTEGER AS schema_issue_count, freshness_days, freshness_flag FROM graded""",
    # root cause
    "severity_bands": f"{MISSING}, pcts AS (SELECT *, {pct('missing_count', 'total_rows')} AS missing_pct FROM missing) SELECT table_name, name, missing_pct, {severity('missing_pct')} AS severity FROM pcts",
    "missingness_jaccard": f"WITH {ORDER_PROFILE}, {PAIRS} SELECT name, other_name, both_missing, any_missing, {rounded('jaccard', 4)} AS jaccard FROM pairs",
    "correlated_missingness": f"WITH {ORDER_PROFILE}, {PAIRS} SELECT name, other_name AS correlated_with FROM pairs WHERE jaccard >= 0.3",
    "category_outlier_concentration": f"WITH {ORDER_PROFILE}, {CLUSTERS} SELECT name, category_column, top_value, outlier_count, concentration_pct, base_count FROM category_clusters",
    "date_outlier_cluster": f"WITH {ORDER_PROFILE}, {CLUSTERS} SELECT name, date_column, window_days, from_date, to_date, outlier_count_in_window FROM date_clusters",
    **{
        q: f"WITH {ISSUES} SELECT {_ISSUE} FROM issues WHERE dimension = '{d}'"
        for q, d in {
            "issues_missing": "completeness",
            "issues_outlier": "validity",
            "issues_format": "consistency",
            "issues_duplicate": "uniqueness",
            "issues_schema": "schema",
            "issues_freshness": "freshness",
        }.items()
    },
    "issues_ranked": f"WITH {ISSUES} SELECT ord, {_ISSUE} FROM issues",
    "issue_summary": f"""WITH {ISSUES} SELECT count(*)::BIGINT AS total_issues, count(*) FILTER (WHERE severity = 'HIGH')::BIGINT AS high_severity,
        count(*) FILTER (WHERE severity = 'MEDIUM')::BIGINT AS medium_severity, count(*) FILTER (WHERE severity = 'LOW')::BIGINT AS low_severity,
        min_by(title, ord) AS first_title FROM issues""",
    # impact
    "value_column": f"""WITH {DIRTY_ORDERS}, meds AS ({_VALUE_MEDIANS}),
        hits AS (SELECT *, len(list_filter([{_quoted(VALUE_WORDS)}], lambda w: contains(replace(lower(name), '_', ' '), w))) AS h FROM meds),
        best AS (SELECT table_name, name, row_number() OVER (PARTITION BY table_name ORDER BY h*10 + least(med/1000, 50) DESC, pos) AS r FROM hits WHERE h > 0),
        tabs AS (SELECT DISTINCT table_name FROM meds)
        SELECT t.table_name, b.name AS value_column, CASE WHEN contains(coalesce(b.name, ''), 'inr') OR contains(coalesce(b.name, ''), 'rupee')
          OR contains(coalesce(b.name, ''), 'rs') THEN '₹' ELSE '$' END AS currency
        FROM tabs t LEFT JOIN best b ON t.table_name = b.table_name AND b.r = 1""",
    "exposure_outliers": f"WITH {IMPACT} SELECT 'amount_usd' AS value_column, far AS outliers, {rounded('outlier_exposure', 2)} AS exposure FROM val",
    "exposure_duplicates": f"WITH {IMPACT} SELECT duplicate_count AS affected_rows, {rounded('duplicate_count::DOUBLE*mean', 2)} AS exposure FROM dups CROSS JOIN val",
    "exposure_missing": f"WITH {IMPACT} SELECT name, missing_count AS affected_rows, {rounded('missing_count::DOUBLE*val.mean', 2)} AS exposure FROM cols CROSS JOIN val WHERE missing_count > 0",
    "exposure_generic": f"WITH {IMPACT} SELECT name, format_issues AS affected_rows, {rounded('format_issues::DOUBLE*val.mean*0.1::DOUBLE', 2)} AS exposure FROM cols CROSS JOIN val WHERE format_issues > 0",
    "downstream_risks": f"WITH {ISSUES}, risks(dimension, place, risk) AS (VALUES "
    + ", ".join(f"('{d}', {i}, {_quoted([r])})" for d, rs in RISKS.items() for i, r in enumerate(rs))
    + ") SELECT dimension, place::INTEGER AS place, risk FROM risks WHERE dimension IN (SELECT dimension FROM issues)",
    "impact_estimates": f"""WITH {IMPACT} SELECT ord, title AS issue_title, dimension, severity, affected_rows, affected_pct, monetary_impact,
        '$' AS currency_symbol, CASE WHEN dimension IN ('completeness', 'validity') THEN 3 ELSE 2 END AS risk_count, severity AS risk_level FROM impact""",
    "impact_summary": f"WITH {IMPACT} SELECT * FROM impact_total",
    "issue_impact_join": f"WITH {IMPACT} SELECT ord, title, affected_rows, monetary_impact, severity AS risk_level FROM impact",
    # recommendations
    "recommendation_candidates": f"WITH {ACTIONS} SELECT * FROM actions",
    "recommendations_ranked": f"WITH {ACTIONS} SELECT * FROM recs",
    "remediation_plan": f"""WITH {ACTIONS}, wins AS (SELECT * FROM recs WHERE effort = 'Low' AND impact = 'High'), mids AS (SELECT * FROM recs WHERE effort = 'Medium'),
        n AS (SELECT (SELECT count(*) FROM recs) AS a, (SELECT count(*) FROM wins) AS w, (SELECT count(*) FROM mids) AS m,
          (SELECT count(*) FROM issues WHERE severity = 'HIGH') AS h, (SELECT count(*) FROM issues WHERE severity = 'MEDIUM') AS d)
        SELECT a::INTEGER AS actions, w::INTEGER AS quick_wins, m::INTEGER AS medium_effort,
          'Immediate actions (' || w || ' quick wins): ' || (SELECT {_PLAN_ACTIONS} FROM (SELECT * FROM wins ORDER BY priority LIMIT 3))
          || CASE WHEN w <= 3 THEN '.' ELSE ' and ' || (w - 3) || ' more.' END || ' → Medium-term fixes (' || m || ' items): '
          || (SELECT {_PLAN_ACTIONS} FROM (SELECT * FROM mids ORDER BY priority LIMIT 3)) || '.' AS remediation_plan,
          least(30::DOUBLE, h*8::DOUBLE + d*3::DOUBLE) AS estimated_score_lift FROM n""",
    "score_lift": f"WITH {ISSUES} SELECT least(30::DOUBLE, count(*) FILTER (WHERE severity = 'HIGH')*8::DOUBLE + count(*) FILTER (WHERE severity = 'MEDIUM')*3::DOUBLE) AS estimated_score_lift FROM issues",
    "quality_report": f"""WITH {ACTIONS} SELECT r.priority, r.action, r.dimension, r.effort, r.impact, r.issue_ref, i.severity, i.affected_column,
        i.affected_rows, i.affected_pct, i.monetary_impact, g.ai_readiness, g.grade
        FROM recs r LEFT JOIN impact i ON r.issue_ref = i.title CROSS JOIN graded g""",
    "recent_turns": "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
    # display
    "column_health": f"""WITH {ORDER_PROFILE} SELECT ordinal, name, missing_pct, outlier_pct, format_issues, CASE WHEN missing_pct > 20 OR outlier_pct > 10 THEN 'bad'
        WHEN missing_pct > 5 OR outlier_pct > 2 OR format_issues > 0 THEN 'warn' ELSE 'ok' END AS status FROM cols""",
    "metric_bands": f"WITH {ORDER_DATASET} " + union(
        [
            _band("missing", "'__dataset__'", "missing_cell_pct", "dataset"),
            _band("duplicates", "'__dataset__'", "duplicate_pct", "dataset"),
            _band("column_missing", "name", "missing_pct", "cols"),
            _band("column_outliers", "name", "outlier_pct", "cols"),
            _band("numeric_outliers", "name", "outlier_pct", "cols WHERE mean IS NOT NULL"),
        ]
    ),
    "boxplot_positions": f"""WITH nums AS ({long_numbers('lineitem', LINEITEM_NUMBERS)}),
        s AS (SELECT ordinal, name, {rounded('min(x)', 4)} AS min, {rounded('max(x)', 4)} AS max, {rounded('quantile_cont(x, 0.25)', 4)} AS q1,
          {rounded('quantile_cont(x, 0.5)', 4)} AS med, {rounded('quantile_cont(x, 0.75)', 4)} AS q3 FROM nums GROUP BY ordinal, name),
        b AS (SELECT ordinal, name, {_place('q1', 25)} AS q1_pos, {_place('med', 50)} AS median_pos, {_place('q3', 75)} AS q3_pos FROM s)
        SELECT *, {rounded('greatest(0::DOUBLE, q3_pos - q1_pos)', 1)} AS width FROM b""",
    "category_bars": f"""{TOP_VALUES}, first AS (SELECT DISTINCT ordinal FROM top ORDER BY ordinal LIMIT 6)
        SELECT ordinal, name, place::INTEGER AS place, value, n AS value_count, {rounded('n/(max(n) OVER (PARTITION BY ordinal))::DOUBLE*100::DOUBLE', 1)} AS bar_pct
        FROM top WHERE ordinal IN (SELECT ordinal FROM first)""",
    "dimension_breakdown": f"WITH {ORDER_DATASET} " + union(
        f"SELECT '{d}' AS dimension, {rounded(c, 1)} AS score, {w}::DOUBLE AS weight, {rounded(rounded(c, 1) + f'*{w}::DOUBLE', 2)} AS contribution FROM graded"
        for d, c, w in (
            ("completeness", "completeness_score", 0.3), ("consistency", "consistency_score", 0.15), ("uniqueness", "u", 0.15),
            ("validity", "v", 0.2), ("freshness", "f", 0.1), ("schema", "s", 0.1),
        )
    ),
    # rules
    "rule_upper_bound": union([_rule("upper_bound", "l_quantity", "lineitem", "l_quantity > 45"), _rule("upper_bound", "l_discount", "lineitem", "l_discount > 0.08::DOUBLE")]),
    "rule_non_negative": f"WITH {DIRTY_ORDERS} " + union(
        [_rule("non_negative", "quantity", "dirty_orders", "quantity < 0"), _rule("non_negative", "amount_usd", "dirty_orders", "amount_usd < 0"), _rule("non_negative", "c_acctbal", "customer", "c_acctbal < 0")]
    ),
    "rule_non_zero": union([_rule("non_zero", "l_discount", "lineitem", "l_discount = 0"), _rule("non_zero", "l_tax", "lineitem", "l_tax = 0")]),
    "rule_denied_values": union(
        [_rule("denied_values", "o_orderpriority", "orders", "o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')"), _rule("allowed_values", "o_orderstatus", "orders", "o_orderstatus NOT IN ('O', 'F')")]
    ),
    "rule_column_order": _rule("column_order", "l_tax<l_discount", "lineitem", "l_tax < l_discount"),
    "rule_unique_key": f"WITH {DIRTY_ORDERS} " + union([_unique("lineitem", "l_orderkey,l_linenumber"), _unique("orders", "o_orderkey"), _unique("dirty_orders", "order_id")]),
    "rule_stale_rows": union([_rule("stale_rows", "l_shipdate", "lineitem", f"l_shipdate < {ORDERS_AS_OF} - INTERVAL {d} DAY") for d in (180, 720)]),
    "rule_not_null": f"WITH {DIRTY_ORDERS} " + union(_rule("not_null", c, "dirty_orders", f"{c} IS NULL") for c in ("status", "priority", "legacy_code", "note")),
    "rule_pattern": f"WITH {DIRTY_ORDERS} " + union(_rule("pattern", c, "dirty_orders", f"NOT regexp_matches({c}, '^[0-9]+$')") for c in ("order_ref", "code_mix")),
    # injection
    "inject_missing": f"SELECT * REPLACE (CASE WHEN {_hit('c_custkey', 120)} THEN NULL ELSE c_mktsegment END AS c_mktsegment) FROM customer",
    "inject_duplicates": f"SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE {_hit('o_orderkey', 80)}",
    "inject_outliers": f"SELECT * REPLACE (CASE WHEN {_hit('o_orderkey', 50, 1)} THEN 900000::DOUBLE + o_orderkey % 1000 ELSE o_totalprice END AS o_totalprice) FROM orders",
    "inject_date_cluster": f"""SELECT * REPLACE (CASE WHEN {_hit('o_orderkey', 75, 2)} THEN TIMESTAMP '2001-03-12 00:00:00' + to_hours((o_orderkey % 48)::INTEGER) ELSE o_orderdate END AS o_orderdate,
        CASE WHEN {_hit('o_orderkey', 75, 2)} THEN 2000000::DOUBLE + o_orderkey % 1000 ELSE o_totalprice END AS o_totalprice) FROM orders""",
    "inject_unit_bug": f"SELECT * REPLACE (CASE WHEN p_type = 'ECONOMY' AND {_hit('p_partkey', 200, 3)} THEN p_retailprice*100::DOUBLE ELSE p_retailprice END AS p_retailprice) FROM part",
    "inject_mixed_type": f"SELECT *, CASE WHEN {_hit('o_orderkey', 120, 4)} THEN 'ORD-' || o_orderkey::VARCHAR ELSE o_orderkey::VARCHAR END AS order_ref FROM orders",
    "inject_invalid_range": f"""SELECT * REPLACE (CASE WHEN {_hit('l_orderkey', 40, 5)} THEN -abs(l_quantity) WHEN {_hit('l_orderkey', 35, 6)} THEN 0::DOUBLE
        WHEN {_hit('l_orderkey', 25, 7)} THEN abs(l_quantity) + 1000::DOUBLE ELSE l_quantity END AS l_quantity) FROM lineitem""",
    "inject_casing": "SELECT * REPLACE (CASE WHEN c_custkey % 10 < 2 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 5 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment) FROM customer",
    "inject_invalid_category": f"SELECT * REPLACE (CASE WHEN {_hit('o_orderkey', 40, 8)} THEN ['AB++', 'O+-', 'B++', 'XY', 'N/A'][(o_orderkey % 5 + 1)::INTEGER] ELSE o_orderstatus END AS o_orderstatus) FROM orders",
    "inject_empty_column": "SELECT *, NULL::VARCHAR AS claim_id FROM customer",
    "inject_stale_dates": f"SELECT * REPLACE (CASE WHEN {_hit('o_orderkey', 300, 9)} THEN o_orderdate - INTERVAL 400 DAY ELSE o_orderdate END AS o_orderdate) FROM orders",
    "inject_duplicate_keys": f"SELECT * REPLACE (CASE WHEN {_hit('p_partkey', 50, 10)} AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS p_partkey) FROM part",
    "inject_phone_formats": f"SELECT *, {_PHONE} AS phone FROM customer",
    "inject_fractional": f"SELECT * REPLACE (CASE WHEN {_hit('p_partkey', 60, 11)} THEN p_size::DOUBLE/1000::DOUBLE ELSE p_size::DOUBLE END AS p_size) FROM part",
    "inject_column_order": f"SELECT *, CASE WHEN {_hit('p_partkey', 30, 12)} THEN p_retailprice*0.8::DOUBLE ELSE p_retailprice*1.5::DOUBLE END AS mrp FROM part",
    # remediation
    "quarantine_missing": f"WITH {DIRTY_EVENTS} SELECT event_id, ts, event_type FROM dirty_events WHERE value IS NULL OR isnan(value)",
    "clean_rows": f"WITH {DIRTY_EVENTS} SELECT * FROM dirty_events WHERE value IS NOT NULL AND NOT isnan(value)",
    "impute_median": f"{_EVENT_QUARTILES} SELECT event_id, ts, user_id, event_type, CASE WHEN value IS NULL OR isnan(value) THEN med ELSE value END AS value, (value IS NULL OR isnan(value)) AS value_imputed FROM dirty_events CROSS JOIN q",
    "impute_mode": f"WITH {DIRTY_ORDERS}, top AS (SELECT status AS m FROM dirty_orders WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1) SELECT order_id, coalesce(status, m) AS status, status IS NULL AS status_imputed FROM dirty_orders CROSS JOIN top",
    "range_rule_violations": f"WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT events.* FROM events CROSS JOIN q WHERE {_fence('value', '3')}",
    "kpi_recalculated": f"""WITH {DIRTY_ORDERS}, q AS (SELECT quantile_cont(amount_usd, 0.25) AS q1, quantile_cont(amount_usd, 0.75) AS q3 FROM dirty_orders),
        f AS (SELECT amount_usd AS x, {_fence('amount_usd', '3')} AS far FROM dirty_orders CROSS JOIN q)
        SELECT count(x)::BIGINT AS rows_all, count(x) FILTER (WHERE NOT far)::BIGINT AS rows_kept, {rounded('sum(x)', 2)} AS sum_all,
          {rounded('sum(x) FILTER (WHERE NOT far)', 2)} AS sum_kept, {rounded('avg(x)', 2)} AS mean_all, {rounded('avg(x) FILTER (WHERE NOT far)', 2)} AS mean_kept FROM f""",
    "standardize_format": f"WITH {DIRTY_ORDERS} SELECT order_id, lower(regexp_replace(note, '^\\s+|\\s+$', '', 'g')) AS note, try_cast({number('code_mix')} AS BIGINT) AS code_mix, {number('order_ref')} AS order_ref FROM dirty_orders",
    "dedup_latest": f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LATEST_ORDER}) = 1",
    "dedup_exact": f"WITH {DIRTY_ORDERS} SELECT DISTINCT * FROM dirty_orders",
    "schema_contract": f"WITH {DIRTY_ORDERS} " + union(
        [
            _contract("order_id", "bigint", "bigint", "count(*) - count(*)"),
            _contract("order_ref", "bigint", "string", f"count(order_ref) - count({number('order_ref')})"),
            _contract("code_mix", "double", "string", f"count(code_mix) - count({number('code_mix')})"),
            _contract("amount_usd", "double", "double", "count(*) - count(*)"),
            _contract("batch_id", "string", "absent", "count(*)"),
        ]
    ),
    "freshness_sla": union(
        f"SELECT '{label}' AS checked_at, max(ts) AS latest, floor(date_diff('second', max(ts), {t})/3600::DOUBLE)::BIGINT AS age_hours, "
        f"floor((epoch_us({t}) - epoch_us(max(ts)))/86400000000::DOUBLE)::BIGINT AS age_days, epoch_us({t}) - epoch_us(max(ts)) >= 86401000000 AS violated FROM events"
        for label, t in (("late", EVENTS_AS_OF), ("soon", "TIMESTAMP '2024-01-30 12:00:00'"))
    ),
    "segment_outliers": f"""WITH {DIRTY_EVENTS}, q AS (SELECT event_type AS seg, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM dirty_events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type)
        SELECT event_id, ts, event_type, value FROM dirty_events JOIN q ON event_type = seg WHERE NOT isnan(value) AND {_fence('value', '1.5')}""",
    # streams
    "daily_quality": _EVENT_QUARTILES + " " + _DAILY.format(fence=_fence("value", "1.5"), source="dirty_events"),
    "daily_quality_stream": "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), days AS ("
    + _DAILY.format(fence=_fence("value", "1.5"), source="events")
    + ") SELECT * FROM days",
    "idempotent_ingest_stream": "SELECT * FROM events",
}
_of = lambda detector, **values: ", ".join(f"CASE WHEN detector = {detector} THEN {v} END AS {k}" for k, v in values.items())
ANSWERS["issue_evidence"] = f"""WITH {ISSUES},
    evc AS ({_ORDER_VALUE_COUNTS}),
    bad AS (SELECT name, value, 'w' AS kind FROM evc WHERE regexp_matches(value, '^\\s|\\s$')
      UNION ALL SELECT name, value, 'n' FROM evc WHERE name = 'code_mix' AND {number('value')} IS NULL),
    few AS (SELECT DISTINCT name, value FROM (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY name, kind ORDER BY value) <= 3)),
    few5 AS (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY name ORDER BY value) <= 5),
    shown AS (SELECT name, string_agg(value, '|' ORDER BY value) AS examples FROM few5 GROUP BY name),
    categories AS (SELECT ordinal, string_agg(category_column, ',' ORDER BY category_ordinal) AS columns, string_agg(category_column || '/' || top_value || '/'
      || outlier_count || '/' || round(concentration_pct * 10)::BIGINT || '/' || base_count, ';' ORDER BY category_ordinal) AS list FROM category_clusters GROUP BY ordinal),
    windows AS (SELECT ordinal, date_column || '/' || window_days || '/' || from_date || '/' || to_date || '/' || outlier_count_in_window AS list FROM date_clusters),
    partners AS (SELECT ordinal, string_agg(other_name, ',' ORDER BY other) AS columns FROM pairs WHERE jaccard >= 0.3 GROUP BY ordinal)
    SELECT ord, dimension, affected_column,
      {_of(1, missing_count="c.missing_count", missing_pct="c.missing_pct")},
      {_of(2, outlier_count="c.outlier_count", outlier_pct="c.outlier_pct", min=rounded("c.lo", 4), max=rounded("c.hi", 4), q1=rounded("c.q1", 4),
           q3=rounded("c.q3", 4), mean=rounded("c.mean", 4), category_clusters="coalesce(k.list, '')", date_clusters="coalesce(d.list, '')")},
      CASE detector WHEN 1 THEN coalesce(p.columns, '') WHEN 2 THEN coalesce(k.columns, '') ELSE '' END AS correlated_columns,
      {_of(3, format_issue_count="c.format_issues", examples="s.examples")},
      {_of(4, duplicate_count="t.duplicate_count", duplicate_pct="t.duplicate_pct")},
      {_of(5, schema_issue_count="t.schema_issues::INTEGER")},
      {_of(6, freshness_days="t.freshness_days", freshness_flag="t.freshness_flag")}
    FROM issues i CROSS JOIN dataset2 t LEFT JOIN cols c ON c.ordinal = i.ordinal LEFT JOIN categories k ON k.ordinal = i.ordinal
      LEFT JOIN windows d ON d.ordinal = i.ordinal LEFT JOIN partners p ON p.ordinal = i.ordinal LEFT JOIN shown s ON s.name = c.name"""
_tenths = lambda x: f"round(({x})::DECIMAL(18, 2), 1)::DECIMAL(18, 1)"
ANSWERS["summary_texts"] = f"""WITH {IMPACT}, severities AS (SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'HIGH') AS high,
      count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM issues)
    SELECT 'impact' AS kind, 0 AS ord, estimate_count || ' issue(s) may distort results, ' || high_risk || ' of them severe; $'
      || format('{{:,}}', round(total_monetary_exposure)::BIGINT) || ' at stake. Counted over all issues, ' || {_tenths("summed_affected_pct")}
      || '% of the rows are concerned.' AS text FROM impact_total
    UNION ALL SELECT 'issues', 0, 'Issues: ' || n || ', of which ' || high || ' high, ' || medium || ' medium and ' || low || ' low. Foremost: '
      || title || ' (' || {_tenths("affected_pct")} || '% of rows). Likely reason: '
      || 'Most rows have no value: the column may be recent, or its source optional.' FROM severities CROSS JOIN issues WHERE ord = 1
    UNION ALL SELECT 'records', ord, 'It concerns ' || format('{{:,}}', affected_rows) || ' records (' || {_tenths("affected_pct")}
      || '% of the table); whatever is computed from this column can be off.' FROM impact
    UNION ALL SELECT 'money', ord, CASE WHEN affected_rows = 0 THEN 'It concerns no rows.'
      WHEN dimension = 'validity' AND far > 0 THEN 'What the far values of amount_usd add up to, less the same number of medians.'
      WHEN dimension = 'uniqueness' THEN 'amount_usd counted more than once: ' || affected_rows || ' repeated rows at the mean amount_usd.'
      WHEN dimension = 'completeness' THEN 'Value that may be lacking: ' || affected_rows || ' rows at the mean amount_usd.'
      ELSE 'A tenth of what the rows hold in ''amount_usd'', as a low estimate.' END FROM impact CROSS JOIN val"""
ANSWERS["profile_state_grown"] = (
    f"WITH nums AS ({long_numbers('lineitem', LINEITEM_NUMBERS)}), sizes AS (SELECT count(*) AS total_rows FROM lineitem) "
    f"SELECT name, any_value(total_rows) AS total_rows, any_value(total_rows) - count(x) AS missing_count, {rounded('avg(x)', 4)} AS mean, "
    f"{rounded('stddev_samp(x)', 4)} AS std, {rounded('min(x)', 4)} AS min, {rounded('max(x)', 4)} AS max FROM nums, sizes GROUP BY name"
)
ANSWERS["daily_quality_watermark"] = ANSWERS["daily_quality_stream"]
ANSWERS["quartiles_search"] = ANSWERS["numeric_quartiles"]
ANSWERS["datetime_layouts"] = union(
    f"SELECT '{name}' AS name, count(*) AS parsed_count, min(t) AS first_time, max(t) AS last_time FROM (SELECT {t} AS t FROM orders)"
    for name, t in (
        ("day_first", "date_trunc('day', o_orderdate)"),
        ("month_name", "date_trunc('day', o_orderdate)"),
        ("minutes", "date_trunc('minute', o_orderdate)"),
        ("millis", "date_trunc('second', o_orderdate) + INTERVAL 123 MILLISECOND"),
        ("nanos", "date_trunc('second', o_orderdate) + INTERVAL 123456 MICROSECOND"),
        ("zulu", "date_trunc('second', o_orderdate)"),
        ("offset", "date_trunc('millisecond', o_orderdate) - INTERVAL 330 MINUTE"),
    )
)
ANSWERS["top_values_documents"] = union(
    f"SELECT '{c}' AS name, (row_number() OVER (ORDER BY n DESC, value) - 1)::INTEGER AS place, value, n AS value_count "
    f"FROM (SELECT {c} AS value, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) QUALIFY place < 5"
    for c in ("text", "lang", "source")
)
_WIDE = {
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
ANSWERS["column_distinct_documents"] = union(
    f"SELECT '{t}' AS table_name, '{c}' AS name, count(DISTINCT {c}) AS unique_count FROM {t}" for t, names in _WIDE.items() for c in names.split()
)
ANSWERS["duplicate_rows_documents"] = (
    "SELECT sum(n - 1)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)"
)
WIDE_GAPS = 150
ANSWERS["missing_together_wide"] = f"""
WITH c AS (SELECT range::INTEGER AS c, (CASE WHEN range % 50 < 3 THEN range - range % 50 ELSE range END)::BIGINT AS base FROM range({WIDE_GAPS})),
  cells AS (
    SELECT c, o_orderkey AS k FROM orders, c
    WHERE (o_orderkey * (2 * base + 1) + base * base) % 101 < 5 OR (c % 50 = 1 AND o_orderkey % 10 = 3)
  ), sizes AS (SELECT c, count(*) AS n FROM cells GROUP BY c),
  pairs AS (SELECT a.c AS a, b.c AS b, count(*) AS both_n FROM cells a JOIN cells b ON a.k = b.k AND a.c <> b.c GROUP BY 1, 2),
  found AS (SELECT p.*, x.n + y.n - p.both_n AS any_n FROM pairs p JOIN sizes x ON x.c = a JOIN sizes y ON y.c = b)
SELECT a AS ordinal, b AS other, both_n AS "both", any_n::BIGINT AS "any", {rounded('both_n / any_n', 4)} AS jaccard FROM found WHERE both_n / any_n >= 0.3"""
ANSWERS["category_outlier_many"] = """WITH i AS (SELECT range AS i FROM range(60)), k AS (SELECT o_orderkey AS k FROM orders)
SELECT 'n' || i AS name, 't' || i AS category_column, 'culprit' AS top_value, count(*) FILTER (WHERE k % 211 = i) AS outlier_count,
  100.0::DOUBLE AS concentration_pct, count(*) FILTER (WHERE k % 211 % 60 = i) AS base_count
FROM k, i GROUP BY i HAVING count(*) FILTER (WHERE k % 211 = i) > 0"""
_EITHER = "count(*) FILTER (WHERE day(t) <= 12 AND day(t) <> month(t))"
_MOMENT = "(date_trunc('day', o_orderdate) + to_seconds((o_orderkey % 86400)::INTEGER))"
ANSWERS["date_layouts_by_shape"] = f"WITH o AS (SELECT o_orderkey AS k, {_MOMENT} AS t FROM orders), " + """
  d AS (SELECT *, date_trunc('day', t) AS day FROM o)
""" + union(
    f"SELECT {i}::INTEGER AS ordinal, '{name}' AS name, '{layout}' AS layout, count({t}) AS parsed_count, {unread}::BIGINT AS unread_count, "
    f"{either}::BIGINT AS ambiguous_count, count({t}) > 0.8 * count(*) AS is_date, "
    f"CASE WHEN count({t}) > 0.8 * count(*) THEN min({t}) END AS first_time, CASE WHEN count({t}) > 0.8 * count(*) THEN max({t}) END AS last_time FROM d"
    for i, name, layout, t, unread, either in (
        (0, "compact", "yyyyMMdd", "day", "0", "0"),
        (1, "us_minutes", "M/d/y", "date_trunc('minute', t)", "0", _EITHER),
        (2, "utc_offset", "y-M-d", "t", "0", "0"),
        (3, "plain_offset", "y-M-d", "t + INTERVAL 150 MINUTE", "0", "0"),
        (4, "dotted", "d.M.y", "CASE WHEN k % 50 <> 0 THEN day END", "count(*) FILTER (WHERE k % 50 = 0)", _EITHER.replace("WHERE ", "WHERE k % 50 <> 0 AND ")),
        (5, "short", "M/d/y", "day", "0", _EITHER),
        (6, "month_name", "d MMM y", "day", "0", "0"),
        (7, "mail", "d MMM y", "t", "0", "0"),
        (8, "half_day", "M/d/y", "t", "0", _EITHER),
        (9, "unclear", "M/d/y", "CASE WHEN day(t) <= 12 THEN make_timestamp(year(t), day(t), month(t), 0, 0, 0) END", "0", _EITHER),
        (10, "spelled", "MMM d y", "day", "0", "0"),
    )
)
ANSWERS["exact_integers"] = """SELECT 1000000000000000000 + o_orderkey AS id19, '7' || lpad(o_orderkey::VARCHAR, 24, '0') AS id25,
  CASE WHEN o_orderkey % 9 <> 0 THEN 9007199254740993 END AS cast_mixed, 'bigint, decimal(38,0), string' AS kinds FROM orders"""
ANSWERS["integer_contract"] = union(
    f"SELECT '{c}' AS column, '{t}' AS expected, 'string' AS actual, ({n})::BIGINT AS failed_rows, {pct(n, 'count(*)')} AS failed_pct FROM orders"
    for c, t, n in (
        ("id19", "int", "count(*)"),
        ("id25", "bigint", "count(*)"),
        ("mixed", "bigint", "count(*) FILTER (WHERE o_orderkey % 9 = 0)"),
    )
)
ANSWERS["inject_any_key"] = """WITH k AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey + 9000000000000000000 END AS key, o_orderstatus FROM orders)
  SELECT key, CASE WHEN (((key % 1000 + 1000) % 1000) * 7919 + 3 * 104729) % 1000 >= 200 THEN o_orderstatus END AS o_orderstatus FROM k"""
ANSWERS["phone_passages"] = """SELECT * FROM (
    SELECT doc_id, unnest(runs) AS phone, generate_subscripts(runs, 1)::INTEGER - 1 AS place
    FROM (SELECT doc_id, regexp_extract_all(text, '[+(]?[0-9][0-9 ()-]{5,}[0-9]') AS runs FROM documents)
  ) WHERE NOT regexp_full_match(phone, '[\\+\\d\\s\\-\\(\\)]{7,15}')"""
