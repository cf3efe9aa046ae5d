"""Actions for each issue, ranked by benefit and effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.numbers import plain_number, round_half_up
from assayer.functions.texts import listed
from assayer.operators import wording as w

# Size of the estimated score lift.
LIFT_HIGH, LIFT_MEDIUM, LIFT_MOST = 8.0, 3.0, 30.0
MONITOR_BELOW = 70


def _action(words: tuple[str, str], head: list, detail: list, effort: str, impact: Column | str) -> Column:
    impact = F.lit(impact) if isinstance(impact, str) else impact
    return F.struct(
        (F.format_string(words[0], *head) if head else F.lit(words[0])).alias("action"),
        (F.format_string(words[1], *detail) if detail else F.lit(words[1])).alias("detail"),
        F.lit(effort).alias("effort"),
        impact.alias("impact"),
    )


def issue_impact(issues: DataFrame, estimates: DataFrame) -> DataFrame:
    """Issues with the money estimate of each; titles are unique."""
    money = estimates.select(
        F.col("issue_title").alias("title"), "monetary_impact", "currency_symbol", "risk_level"
    )
    return issues.join(money, "title", "left")


def candidates(issues: DataFrame, estimates: DataFrame, score: DataFrame) -> DataFrame:
    """All actions in issue order: (issue_ord, position, action, detail, dimension, ...)."""
    name, rows, pct = F.col("affected_column"), F.col("affected_rows"), F.col("affected_pct")
    ev, dim = F.col("evidence"), F.col("dimension")
    together = listed(F.col("correlated_columns"))
    money = F.coalesce(F.col("monetary_impact"), F.lit(0.0))

    missing = F.array(
        _action(w.QUARANTINE, [name], [rows, name], "Low", F.when(pct >= 10, "High").otherwise("Medium")),
        F.when(F.size("correlated_columns") > 0, _action(w.UPSTREAM, [together], [name, together], "Medium", "High"))
        .otherwise(_action(w.NOT_NULL, [name], [name], "Low", "Medium")),
        F.when(pct < 20, _action(w.IMPUTE, [name], [pct], "Low", "Medium")),
    )
    windows = F.transform(
        ev["date_clusters"],
        lambda d: _action(
            w.CHECK_WINDOW, [d["from"], d["to"]], [name, d["window_days"], d["column"]], "Medium", "High"
        ),
    )
    categories = F.transform(
        ev["category_clusters"],
        lambda c: _action(
            w.AUDIT_CATEGORY,
            [c["column"], c["top_value"]],
            [plain_number(c["concentration_pct"]), name, c["top_value"], c["column"]],
            "Medium",
            "High",
        ),
    )
    always = F.array(
        _action(w.RANGE_RULE, [name], [name, plain_number(ev["q1"]), plain_number(ev["q3"])], "Low", "High"),
        F.when(money != 0, _action(w.RECALCULATE, [], [F.col("currency_symbol"), money, rows], "Low", "High")),
    )
    actions = (
        F.when(dim == "completeness", missing)
        .when(dim == "validity", F.concat(windows, categories, always))
        .when(dim == "consistency", F.array(_action(w.STANDARDISE, [name], [listed(ev["examples"])], "Low", "Medium")))
        .when(
            dim == "uniqueness",
            F.array(
                _action(w.DEDUPLICATE, [], [rows, pct], "Medium", "High"),
                _action(w.IDEMPOTENCY, [], [], "Medium", "Medium"),
            ),
        )
        .when(dim == "schema", F.array(_action(w.CONTRACT, [], [listed(ev["schema_issues"])], "Medium", "High")))
        .when(
            dim == "freshness",
            F.array(_action(w.RESTART, [], [plain_number(ev["freshness_days"])], "Low", "High")),
        )
    )
    per_issue = (
        issue_impact(issues, estimates)
        .select(
            F.col("ord").alias("issue_ord"),
            "dimension",
            F.col("title").alias("issue_ref"),
            F.posexplode(F.array_compact(actions)).alias("position", "a"),
        )
        .select("issue_ord", "position", "a.action", "a.detail", "dimension", "a.effort", "a.impact", "issue_ref")
    )
    monitor = score.where(F.col("ai_readiness") < MONITOR_BELOW).select(
        F.lit(2**31 - 1).alias("issue_ord"),
        F.lit(0).alias("position"),
        F.lit(w.MONITOR[0]).alias("action"),
        F.lit(w.MONITOR[1]).alias("detail"),
        F.lit("general").alias("dimension"),
        F.lit("Medium").alias("effort"),
        F.lit("High").alias("impact"),
        F.lit(w.MONITOR_REF).alias("issue_ref"),
    )
    return per_issue.unionByName(monitor)


def ranked(actions: DataFrame) -> DataFrame:
    """Number actions: high impact first, then low effort, then issue order."""
    impact = F.when(F.col("impact") == "High", 0).when(F.col("impact") == "Medium", 1).otherwise(2)
    effort = F.when(F.col("effort") == "Low", 0).when(F.col("effort") == "Medium", 1).otherwise(2)
    order = W.orderBy(impact, effort, "issue_ord", "position")  # a few rows per issue
    return actions.select(
        F.row_number().over(order).alias("priority"),
        "action",
        "detail",
        "dimension",
        "effort",
        "impact",
        "issue_ref",
    )


def quick_wins(recommendations: DataFrame) -> DataFrame:
    return recommendations.where((F.col("effort") == "Low") & (F.col("impact") == "High"))


def with_effort_and_impact(recommendations: DataFrame, efforts: list[str], impacts: list[str]) -> DataFrame:
    return recommendations.where(F.col("effort").isin(efforts) & F.col("impact").isin(impacts))


def score_lift(high: Column, medium: Column, actions: Column) -> Column:
    lift = F.least(F.lit(LIFT_MOST), high * F.lit(LIFT_HIGH) + medium * F.lit(LIFT_MEDIUM))
    return F.when(actions == 0, 0.0).otherwise(round_half_up(lift, 1))


def remediation_plan(recommendations: DataFrame, high: int, medium: int) -> DataFrame:
    """One row: plan text, counts and estimated score lift."""
    listed_actions = F.array_sort(F.collect_list(F.struct("priority", "action", "effort", "impact")))
    df = recommendations.agg(listed_actions.alias("all"))
    part = {
        "quick": F.filter("all", lambda r: (r["effort"] == "Low") & (r["impact"] == "High")),
        "medium": F.filter("all", lambda r: r["effort"] == "Medium"),
        "long": F.filter("all", lambda r: r["effort"] == "High"),
    }
    for name, c in part.items():
        df = df.withColumn(name, c)

    def sentence(name: str, words: str, shown: int) -> Column:
        head = F.array_join(F.transform(F.slice(name, 1, shown), lambda r: r["action"]), "; ")
        n = F.size(name)
        end = F.when(n <= shown, ".").otherwise(F.format_string(" and %d more.", n - shown)) if name == "quick" else F.lit(".")
        return F.when(n > 0, F.concat(F.format_string(words, n), head, end))

    parts = F.array_compact(
        F.array(
            sentence("quick", w.PLAN_QUICK, 3),
            sentence("medium", w.PLAN_MEDIUM, 3),
            sentence("long", w.PLAN_LONG, 2),
        )
    )
    n = F.size("all")
    return df.select(
        n.alias("actions"),
        F.size("quick").alias("quick_wins"),
        F.size("medium").alias("medium_effort"),
        F.when(n == 0, w.NO_ACTIONS)
        .when(F.size(parts) == 0, w.ALL_ACTIONS)
        .otherwise(F.array_join(parts, " → "))
        .alias("remediation_plan"),
        score_lift(F.lit(high), F.lit(medium), n).alias("estimated_score_lift"),
    )


