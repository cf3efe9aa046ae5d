"""SQL building blocks: the derived views and the statistics that several answers share."""

from __future__ import annotations

from assayer.oracle.values import NUMBER_PATTERN

ORDERS_AS_OF = "TIMESTAMP '2001-12-15 12:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-02-10 06:00:00'"


def rounded(x: str, digits: int) -> str:
    k = f"1e{digits}"
    return f"(floor(({x})*{k}+0.5::DOUBLE)/{k})"


def pct(part: str, whole: str, digits: int = 2) -> str:
    share = f"({part})::DOUBLE/nullif(({whole})::DOUBLE,0)*100::DOUBLE"
    return f"coalesce({rounded(share, digits)}, 0::DOUBLE)"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER_PATTERN}') THEN try_cast(trim({c}) AS DOUBLE) END"


DIRTY_ORDERS = """
base_orders AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 97 < 4 THEN
      CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2001-03-12 06:00:00' ELSE TIMESTAMP '2001-03-13 18:00:00' END
    ELSE o_orderdate END AS order_ts,
    CASE WHEN o_orderkey % 89 < 16 THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 83 < 10 THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 83 < 12 THEN NULL ELSE 'G' || substr(o_orderpriority, 1, 1) END AS priority_group,
    CASE WHEN o_orderkey % 97 < 3 THEN 'Partner'
      ELSE CASE o_orderkey % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'Retail' WHEN 2 THEN 'Partner' ELSE 'Direct' END
    END AS channel,
    CASE WHEN o_orderkey % 97 < 4 THEN o_totalprice + 5000000 ELSE o_totalprice END AS amount_usd,
    CASE WHEN o_orderkey % 79 < 2 THEN -(o_orderkey % 50 + 1) ELSE o_orderkey % 50 + 1 END AS quantity,
    CASE WHEN o_orderkey % 25 < 3 THEN 'ORD-' || o_orderkey::VARCHAR ELSE o_orderkey::VARCHAR END AS order_ref,
    CASE WHEN o_orderkey % 73 < 30 THEN (o_orderkey % 500)::VARCHAR ELSE 'C' || (o_orderkey % 500)::VARCHAR END AS code_mix,
    CASE WHEN o_orderkey % 71 < 2 THEN ' ' || o_orderpriority
      WHEN o_orderkey % 71 = 2 THEN o_orderpriority || chr(9) ELSE o_orderpriority END AS note,
    o_orderkey % 13 = 0 AS is_returned,
    NULL::VARCHAR AS legacy_code
  FROM orders),
dirty_orders AS (SELECT * FROM base_orders UNION ALL SELECT * FROM base_orders WHERE order_id % 61 < 5)"""

DIRTY_EVENTS = """
base_events AS (
  SELECT event_id, ts, user_id,
    CASE WHEN event_id % 7 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
    CASE WHEN event_id % 59 = 0 THEN 'nan'::DOUBLE WHEN event_id % 53 < 3 THEN NULL ELSE value END AS value
  FROM events),
dirty_events AS (SELECT * FROM base_events UNION ALL SELECT * FROM base_events WHERE event_id % 41 < 2)"""

# (ordinal, name, dtype, role, numeric expression) of dirty_orders.
ORDER_COLUMNS = (
    (0, "order_id", "bigint", "numeric", "order_id::DOUBLE"),
    (1, "order_ts", "timestamp_ntz", "temporal", None),
    (2, "status", "string", "categorical", None),
    (3, "priority", "string", "categorical", None),
    (4, "priority_group", "string", "categorical", None),
    (5, "channel", "string", "categorical", None),
    (6, "amount_usd", "double", "numeric", "amount_usd"),
    (7, "quantity", "bigint", "numeric", "quantity::DOUBLE"),
    (8, "order_ref", "string", "numeric", number("order_ref")),
    (9, "code_mix", "string", "categorical", None),
    (10, "note", "string", "categorical", None),
    (11, "is_returned", "boolean", "categorical", None),
    (12, "legacy_code", "string", "empty", None),
)
NON_NEGATIVE = {"amount_usd", "quantity"}
ORDER_TEXTS = [(o, n, role) for o, n, d, role, _ in ORDER_COLUMNS if d == "string"]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def long_numbers(table: str, columns: list[tuple[int, str, str]]) -> str:
    """CTE body (ordinal, name, x) of the non-missing numbers of a table."""
    return union(
        f"SELECT {o} AS ordinal, '{n}' AS name, x FROM (SELECT {e} AS x FROM {table}) WHERE x IS NOT NULL AND NOT isnan(x)"
        for o, n, e in columns
    )


def number_stats(source: str, prefix: str) -> str:
    """CTEs ``<prefix>_q`` (moments and quartiles) and ``<prefix>_o`` (outlier counts) over long numbers."""
    return f"""
{prefix}_q AS (
  SELECT ordinal, name, count(x)::BIGINT AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi,
    quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
  FROM {source} GROUP BY ordinal, name),
{prefix}_o AS (
  SELECT l.ordinal, l.name,
    CASE WHEN any_value(q.n) >= 10 AND any_value(q.q3) <> any_value(q.q1) THEN
      count(*) FILTER (WHERE x < q1 - 1.5::DOUBLE*(q3-q1) OR x > q3 + 1.5::DOUBLE*(q3-q1)) ELSE 0 END::BIGINT AS near,
    count(*) FILTER (WHERE x < q1 - 3::DOUBLE*(q3-q1) OR x > q3 + 3::DOUBLE*(q3-q1))::BIGINT AS far,
    sum(x) FILTER (WHERE x < q1 - 3::DOUBLE*(q3-q1) OR x > q3 + 3::DOUBLE*(q3-q1)) AS far_sum,
    count(*) FILTER (WHERE x < 0)::BIGINT AS below_zero
  FROM {source} l JOIN {prefix}_q q ON l.ordinal = q.ordinal GROUP BY l.ordinal, l.name)"""


def _order_profile() -> str:
    numbers = [(o, n, e) for o, n, _, _, e in ORDER_COLUMNS if e]
    missing = union(
        f"SELECT {o} AS ordinal, '{n}' AS name, '{d}' AS dtype, '{r}' AS role, "
        f"count(*) FILTER (WHERE {n} IS NULL)::BIGINT AS missing_count, count(DISTINCT {n})::BIGINT AS unique_count "
        "FROM dirty_orders"
        for o, n, d, r, _ in ORDER_COLUMNS
    )
    texts = []
    for o, n, role in ORDER_TEXTS:
        ws = f"count(*) FILTER (WHERE regexp_matches({n}, '^\\s|\\s$'))"
        num = f"count({number(n)})"
        mixed = f"CASE WHEN {num} > 0 AND {num} < count({n}) * 0.9::DOUBLE THEN count({n}) - {num} ELSE 0 END"
        if role == "numeric":
            ws = mixed = "0"
        texts.append(
            f"SELECT {o} AS ordinal, '{n}' AS name, ({ws})::BIGINT AS whitespace_count, ({mixed})::BIGINT AS mixed_count, "
            f"({num})::BIGINT AS numeric_count, count({n})::BIGINT AS present FROM dirty_orders"
        )
    negative = ", ".join(f"'{n}'" for n in sorted(NON_NEGATIVE))
    return f"""{DIRTY_ORDERS},
total AS (SELECT count(*)::BIGINT AS n_rows FROM dirty_orders),
nums AS ({long_numbers("dirty_orders", numbers)}),
{number_stats("nums", "num")},
outl AS (
  SELECT ordinal, name, near, far, far_sum, CASE WHEN name IN ({negative}) THEN below_zero ELSE 0 END::BIGINT AS negative
  FROM num_o),
present AS ({missing}),
texts AS ({union(texts)}),
cols AS (
  SELECT p.*, n_rows, {pct("p.missing_count", "n_rows")} AS missing_pct, {pct("p.unique_count", "n_rows")} AS unique_pct,
    q.mean, q.std, q.lo, q.hi, q.q1, q.med, q.q3, coalesce(o.near, 0) AS near, coalesce(o.far, 0) AS far,
    coalesce(o.negative, 0) AS negative, coalesce(greatest(o.near, o.negative), 0)::BIGINT AS outlier_count,
    {pct("coalesce(greatest(o.near, o.negative), 0)", "n_rows")} AS outlier_pct,
    coalesce(t.whitespace_count + t.mixed_count, 0)::BIGINT AS format_issues
  FROM present p CROSS JOIN total LEFT JOIN num_q q ON p.ordinal = q.ordinal
  LEFT JOIN outl o ON p.ordinal = o.ordinal LEFT JOIN texts t ON p.ordinal = t.ordinal)"""


ORDER_PROFILE = _order_profile()


def _any_outlier() -> str:
    tests = []
    for o, n, _, _, e in ORDER_COLUMNS:
        if not e:
            continue
        q = f"(SELECT near > 0 OR negative > 0 FROM outl WHERE ordinal = {o})"
        low = f"(SELECT q1 - 1.5::DOUBLE*(q3-q1) FROM num_q WHERE ordinal = {o})"
        high = f"(SELECT q3 + 1.5::DOUBLE*(q3-q1) FROM num_q WHERE ordinal = {o})"
        tests.append(f"({q} AND (({e}) < {low} OR ({e}) > {high}))")
        if n in NON_NEGATIVE:
            tests.append(f"({e}) < 0")
    return f"SELECT count(*)::BIGINT FROM dirty_orders WHERE {' OR '.join(f'coalesce({t}, false)' for t in tests)}"


ORDER_DATASET = f"""{ORDER_PROFILE},
dups AS (SELECT sum(c - 1)::BIGINT AS duplicate_count FROM (SELECT count(*) AS c FROM dirty_orders GROUP BY ALL {{}})),
counts AS (
  SELECT n_rows AS total_rows, 13 AS total_cols, duplicate_count,
    (SELECT sum(missing_count) FROM cols)::BIGINT AS missing_cells,
    (SELECT sum(format_issues) FROM cols)::BIGINT AS format_total,
    ({_any_outlier()}) AS total_outlier_rows,
    (SELECT max(order_ts) FROM dirty_orders) AS latest
  FROM total CROSS JOIN dups),
dataset AS (
  SELECT *, {pct("duplicate_count", "total_rows")} AS duplicate_pct,
    {pct("missing_cells", "total_rows*total_cols")} AS missing_cell_pct,
    {pct("total_outlier_rows", "total_rows")} AS total_outlier_pct,
    {rounded("greatest(0::DOUBLE, 100::DOUBLE - format_total/(total_rows*total_cols)::DOUBLE*100::DOUBLE)", 2)}
      AS consistency_score,
    {rounded("(1::DOUBLE - total_outlier_rows/total_rows::DOUBLE)*100::DOUBLE", 2)} AS validity_score,
    floor((epoch_us({ORDERS_AS_OF}) - epoch_us(latest))/86400000000::DOUBLE)::DOUBLE AS freshness_days,
    (SELECT count(*) FILTER (WHERE numeric_count/n_rows::DOUBLE > 0.1 AND numeric_count/n_rows::DOUBLE < 0.9)
       FROM texts CROSS JOIN total)
    + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM cols WHERE missing_count = n_rows) AS schema_issues
  FROM counts),
dataset2 AS (
  SELECT *, {rounded("100::DOUBLE - missing_cell_pct", 2)} AS completeness_score,
    {rounded("100::DOUBLE - duplicate_pct", 2)} AS uniqueness_score,
    CASE WHEN freshness_days <= 30 THEN 'OK' ELSE 'STALE' END AS freshness_flag
  FROM dataset),
raw_score AS (
  SELECT *, greatest(0::DOUBLE, 100::DOUBLE - duplicate_pct*2.5::DOUBLE) AS u,
    greatest(0::DOUBLE, 100::DOUBLE - total_outlier_pct*3::DOUBLE) AS v,
    CASE freshness_flag WHEN 'OK' THEN 100::DOUBLE
      ELSE greatest(20::DOUBLE, 100::DOUBLE - (freshness_days - 30::DOUBLE)*(80::DOUBLE/335::DOUBLE)) END AS f,
    greatest(0::DOUBLE, 100::DOUBLE - schema_issues::DOUBLE*15::DOUBLE) AS s
  FROM dataset2),
scored AS (
  SELECT *, {rounded("least(100::DOUBLE, greatest(0::DOUBLE, 0.30::DOUBLE*completeness_score + 0.15::DOUBLE*consistency_score + 0.15::DOUBLE*u + 0.20::DOUBLE*v + 0.10::DOUBLE*f + 0.10::DOUBLE*s))", 1)}
    AS ai_readiness FROM raw_score),
graded AS (
  SELECT *, CASE WHEN ai_readiness >= 85 THEN 'A' WHEN ai_readiness >= 70 THEN 'B' WHEN ai_readiness >= 55 THEN 'C'
    WHEN ai_readiness >= 40 THEN 'D' ELSE 'F' END AS grade FROM scored)""".replace("GROUP BY ALL {}", "GROUP BY " + ", ".join(n for _, n, *_ in ORDER_COLUMNS))


def severity(p: str) -> str:
    return f"CASE WHEN {p} >= 10 THEN 'HIGH' WHEN {p} >= 3 THEN 'MEDIUM' ELSE 'LOW' END"


def _pair_counts() -> str:
    parts = []
    names = [(o, n) for o, n, *_ in ORDER_COLUMNS]
    for o, n in names:
        for p, m in names:
            if o != p:
                parts.append(
                    f"SELECT {o} AS ordinal, '{n}' AS name, {p} AS other, '{m}' AS other_name, "
                    f"count(*) FILTER (WHERE {n} IS NULL AND {m} IS NULL)::BIGINT AS both_missing, "
                    f"count(*) FILTER (WHERE {n} IS NULL OR {m} IS NULL)::BIGINT AS any_missing FROM dirty_orders"
                )
    return union(parts)


PAIRS = f"""
all_pairs AS ({_pair_counts()}),
pairs AS (
  SELECT a.*, both_missing/any_missing::DOUBLE AS jaccard FROM all_pairs a JOIN cols c ON a.ordinal = c.ordinal
  JOIN cols d ON a.other = d.ordinal
  WHERE c.missing_pct >= 1.0 AND d.missing_count > 0)"""

# Far outliers of the numeric columns of dirty_orders, with the columns they are placed on.
CLUSTERS = f"""
far_rows AS ({union(
    f"SELECT {o} AS ordinal, '{n}' AS name, d.* FROM dirty_orders d, num_q q WHERE q.ordinal = {o} AND "
    f"(({e}) < q1 - 3::DOUBLE*(q3-q1) OR ({e}) > q3 + 3::DOUBLE*(q3-q1))"
    for o, n, _, _, e in ORDER_COLUMNS if e)}),
date_clusters AS (
  SELECT f.ordinal, f.name, 'order_ts' AS date_column,
    floor((epoch_us(max(order_ts)) - epoch_us(min(order_ts)))/86400000000::DOUBLE)::BIGINT AS window_days,
    min(order_ts)::DATE AS from_date, max(order_ts)::DATE AS to_date, count(*)::BIGINT AS outlier_count_in_window
  FROM far_rows f JOIN cols c ON f.ordinal = c.ordinal WHERE c.outlier_count > 0 GROUP BY f.ordinal, f.name
  HAVING floor((epoch_us(max(order_ts)) - epoch_us(min(order_ts)))/86400000000::DOUBLE) <= 7),
cat_cells AS ({union(
    f"SELECT ordinal, name, {p} AS category_ordinal, '{m}' AS category_column, {m} AS v FROM far_rows WHERE ordinal <> {p}"
    for p, m, _ in ORDER_TEXTS)}),
cat_counts AS (SELECT ordinal, name, category_ordinal, category_column, v, count(*)::BIGINT AS n FROM cat_cells
  WHERE v IS NOT NULL GROUP BY ALL),
cat_top AS (SELECT * FROM cat_counts QUALIFY row_number() OVER (PARTITION BY ordinal, category_ordinal ORDER BY n DESC, v) = 1),
cat_base AS ({union(
    f"SELECT {p} AS category_ordinal, {m} AS v, count(*)::BIGINT AS base_count FROM dirty_orders GROUP BY {m}"
    for p, m, _ in ORDER_TEXTS)}),
category_clusters AS (
  SELECT t.ordinal, t.name, t.category_ordinal, t.category_column, t.v AS top_value, t.n AS outlier_count,
    {rounded("t.n/c.outlier_count::DOUBLE*100::DOUBLE", 1)} AS concentration_pct, b.base_count
  FROM cat_top t JOIN cols c ON t.ordinal = c.ordinal
  JOIN cat_base b ON b.category_ordinal = t.category_ordinal AND b.v = t.v
  WHERE c.outlier_count > 0 AND t.n/c.outlier_count::DOUBLE >= 0.4)"""

ISSUES = f"""{ORDER_DATASET},
{PAIRS},
{CLUSTERS},
linked AS (
  SELECT ordinal, '[' || string_agg('''' || other_name || '''', ', ' ORDER BY other) || ']' AS together
  FROM pairs WHERE jaccard >= 0.3 GROUP BY ordinal),
raw_issues AS (
  SELECT 1 AS detector, ordinal, 'completeness' AS dimension, {severity("missing_pct")} AS severity,
    'Missing values in ''' || name || '''' AS title, name AS affected_column, missing_count AS affected_rows,
    missing_pct AS affected_pct FROM cols WHERE missing_pct >= 1.0
  UNION ALL SELECT 2, ordinal, 'validity', {severity("outlier_pct")}, 'Anomalous values in ''' || name || '''', name,
    outlier_count, outlier_pct FROM cols WHERE outlier_count > 0
  UNION ALL SELECT 3, ordinal, 'consistency', {severity(pct("format_issues", "n_rows"))},
    'Format inconsistencies in ''' || name || '''', name, format_issues, {pct("format_issues", "n_rows")}
    FROM cols WHERE format_issues > 0
  UNION ALL SELECT 4, -1, 'uniqueness', {severity("duplicate_pct")}, 'Duplicate rows detected', '__dataset__',
    duplicate_count, duplicate_pct FROM dataset WHERE duplicate_count > 0
  UNION ALL SELECT 5, -1, 'schema', CASE WHEN schema_issues >= 3 THEN 'HIGH' ELSE 'MEDIUM' END,
    schema_issues::VARCHAR || ' schema issue(s) detected', '__dataset__', 0, 0::DOUBLE FROM dataset WHERE schema_issues > 0
  UNION ALL SELECT 6, -1, 'freshness', CASE WHEN freshness_days > 90 THEN 'HIGH' ELSE 'MEDIUM' END,
    'Data is stale (' || freshness_days::BIGINT::VARCHAR || ' days since last record)', '__dataset__', 0, 0::DOUBLE
    FROM dataset2 WHERE freshness_flag = 'STALE'),
issues AS (
  SELECT row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END,
    affected_pct DESC, detector, ordinal)::INTEGER AS ord, * FROM raw_issues)"""

# The value column of dirty_orders is amount_usd: name and content allow no other.
IMPACT = f"""{ISSUES},
val AS (
  SELECT q.mean, q.med, o.far, o.far_sum, abs(o.far_sum - q.med*o.far) AS outlier_exposure
  FROM num_q q JOIN num_o o ON q.ordinal = o.ordinal WHERE q.name = 'amount_usd'),
impact AS (
  SELECT i.*, CASE WHEN affected_rows > 0 THEN {rounded('''
    CASE WHEN dimension = 'validity' AND far > 0 THEN outlier_exposure
      WHEN dimension IN ('uniqueness', 'completeness') THEN affected_rows::DOUBLE*mean
      ELSE affected_rows::DOUBLE*mean*0.1::DOUBLE END''', 2)} END AS monetary_impact
  FROM issues i CROSS JOIN val),
impact_total AS (
  SELECT count(*)::BIGINT AS estimate_count, count(*) FILTER (WHERE severity = 'HIGH')::BIGINT AS high_risk,
    {rounded("sum(monetary_impact ORDER BY ord)", 2)} AS total_monetary_exposure, '$' AS currency_symbol,
    sum(affected_rows)::BIGINT AS total_affected_rows,
    {rounded("least(sum(affected_rows)::DOUBLE/(SELECT n_rows FROM total)::DOUBLE*100::DOUBLE, 100::DOUBLE)", 1)}
      AS summed_affected_pct
  FROM impact)"""

ACTIONS = f"""{IMPACT},
raw_actions AS (
  SELECT i.ord AS issue_ord, 0 AS template, 'Quarantine rows with missing ''' || affected_column || ''' for manual review' AS action,
    dimension, 'Low' AS effort, CASE WHEN affected_pct >= 10 THEN 'High' ELSE 'Medium' END AS impact, title AS issue_ref
    FROM impact i WHERE dimension = 'completeness'
  UNION ALL SELECT i.ord, 1, CASE WHEN l.together IS NOT NULL THEN 'Investigate upstream source for columns ' || l.together
      ELSE 'Add a NOT NULL validation rule on ''' || affected_column || ''' in the pipeline' END, dimension,
    CASE WHEN l.together IS NOT NULL THEN 'Medium' ELSE 'Low' END, CASE WHEN l.together IS NOT NULL THEN 'High' ELSE 'Medium' END, title
    FROM impact i LEFT JOIN linked l ON i.ordinal = l.ordinal WHERE dimension = 'completeness'
  UNION ALL SELECT ord, 2, 'Impute missing ''' || affected_column || ''' values using median/mode strategy', dimension, 'Low', 'Medium', title
    FROM impact WHERE dimension = 'completeness' AND affected_pct < 20
  UNION ALL SELECT i.ord, 10, 'Validate source-system records for ' || d.from_date::VARCHAR || ' → ' || d.to_date::VARCHAR, dimension,
    'Medium', 'High', title FROM impact i JOIN date_clusters d ON i.ordinal = d.ordinal WHERE dimension = 'validity'
  UNION ALL SELECT i.ord, 20 + c.category_ordinal, 'Audit ''' || c.category_column || ''' = ''' || c.top_value ||
    ''' for data-entry or source-config issues', dimension, 'Medium', 'High', title
    FROM impact i JOIN category_clusters c ON i.ordinal = c.ordinal WHERE dimension = 'validity'
  UNION ALL SELECT ord, 100, 'Add an automated range-validation rule for ''' || affected_column || '''', dimension, 'Low', 'High', title
    FROM impact WHERE dimension = 'validity'
  UNION ALL SELECT ord, 101, 'Recalculate affected KPIs after quarantining anomalous records', dimension, 'Low', 'High', title
    FROM impact WHERE dimension = 'validity' AND coalesce(monetary_impact, 0) <> 0
  UNION ALL SELECT ord, 0, 'Standardise formatting in ''' || affected_column || '''', dimension, 'Low', 'Medium', title
    FROM impact WHERE dimension = 'consistency'
  UNION ALL SELECT ord, 0, 'Add deduplication logic to the ingestion pipeline', dimension, 'Medium', 'High', title
    FROM impact WHERE dimension = 'uniqueness'
  UNION ALL SELECT ord, 1, 'Audit pipeline idempotency — re-runs should not double-load records', dimension, 'Medium', 'Medium', title
    FROM impact WHERE dimension = 'uniqueness'
  UNION ALL SELECT ord, 0, 'Enforce schema contracts at the pipeline boundary', dimension, 'Medium', 'High', title
    FROM impact WHERE dimension = 'schema'
  UNION ALL SELECT ord, 0, 'Investigate and restart the stale data pipeline', dimension, 'Low', 'High', title
    FROM impact WHERE dimension = 'freshness'
  UNION ALL SELECT 2147483647, 0, 'Establish a continuous data-quality monitoring process', 'general', 'Medium', 'High',
    'Overall data quality' FROM graded WHERE ai_readiness < 70),
actions AS (
  SELECT issue_ord, (row_number() OVER (PARTITION BY issue_ord ORDER BY template) - 1)::INTEGER AS position, action, dimension,
    effort, impact, issue_ref FROM raw_actions),
recs AS (
  SELECT row_number() OVER (ORDER BY CASE impact WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END,
    CASE effort WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, issue_ord, position)::INTEGER AS priority,
    action, dimension, effort, impact, issue_ref FROM actions)"""
