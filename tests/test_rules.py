from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.rules import (
    Rule,
    balance_rules,
    baseline_rules,
    rule_catalog,
    score_events,
)

SCHEMA = (
    "id int, amount decimal(19,2), location string, event_time timestamp, "
    "window_count long, window_sum decimal(29,2), degraded_in boolean, event_time_text string"
)
DAY, NIGHT = datetime(2026, 1, 1, 10), datetime(2026, 1, 1, 2)
# amount, location, time, count, sum, degraded -> score, level, decision, matched
GOLDEN = [
    (10_000, "SEOUL", DAY, 0, 0, False, 0, "LOW", "APPROVE", ""),
    (1_000_000, "SEOUL", DAY, 0, 0, False, 50, "MEDIUM", "REVIEW", "AMOUNT_THRESHOLD"),
    (10_000, "SEOUL", NIGHT, 0, 0, False, 20, "LOW", "APPROVE", "NIGHT_TIME_TRANSACTION"),
    (10_000, "HIGH_RISK", DAY, 0, 0, False, 30, "MEDIUM", "REVIEW", "SUSPICIOUS_LOCATION"),
    (10_000, " foreign ", DAY, 0, 0, False, 30, "MEDIUM", "REVIEW", "SUSPICIOUS_LOCATION"),
    (10_000, None, DAY, 0, 0, False, 0, "LOW", "APPROVE", ""),
    (
        1_500_000,
        "HIGH_RISK",
        DAY,
        0,
        0,
        False,
        80,
        "HIGH",
        "BLOCK",
        "AMOUNT_THRESHOLD,SUSPICIOUS_LOCATION",
    ),
    (
        1_500_000,
        "HIGH_RISK",
        NIGHT,
        0,
        0,
        False,
        100,
        "HIGH",
        "BLOCK",
        "AMOUNT_THRESHOLD,NIGHT_TIME_TRANSACTION,SUSPICIOUS_LOCATION",
    ),
    (10_000, "SEOUL", DAY, 5, 100_000, False, 30, "MEDIUM", "REVIEW", "RAPID_TRANSACTION_COUNT"),
    (10_000, "SEOUL", DAY, 2, 3_000_000, False, 40, "MEDIUM", "REVIEW", "WINDOW_AMOUNT_SUM"),
    (
        1_500_000,
        "HIGH_RISK",
        DAY,
        5,
        3_500_000,
        False,
        100,
        "HIGH",
        "BLOCK",
        "AMOUNT_THRESHOLD,SUSPICIOUS_LOCATION,RAPID_TRANSACTION_COUNT,WINDOW_AMOUNT_SUM",
    ),
    (10_000, "SEOUL", DAY, 9, 9_000_000, True, 0, "LOW", "APPROVE", ""),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (i, Decimal(a), loc, t, c, Decimal(s), d, "2026-01-01T02:00:00+09:00")
        for i, (a, loc, t, c, s, d, *_) in enumerate(GOLDEN)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = score_events(df, degraded=F.col("degraded_in"))
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_scores(scored, i):
    *_, score, level, decision, matched = GOLDEN[i]
    row = scored[i]
    assert (row["risk_score"], row["risk_level"], row["decision"]) == (score, level, decision)
    assert ",".join(row["matched_rules"]) == matched
    assert row["rule_version"] == "rule-v2-baseline-v1"


def test_degraded_row(scored):
    row = scored[len(GOLDEN) - 1]
    assert row["skipped_rules"] == ["RAPID_TRANSACTION_COUNT", "WINDOW_AMOUNT_SUM"]
    assert row["degraded"] and row["reason"].startswith("No fraud rule matched; Redis degraded")
    assert scored[0]["skipped_rules"] == [] and scored[0]["reason"] == "No fraud rule matched"


def test_night_hour_zone_and_offset(spark):
    row = [(0, Decimal(1), None, datetime(2026, 1, 1, 17), 0, Decimal(0), False,
            "2026-01-02T02:00:00+09:00")]
    df = spark.createDataFrame(row, SCHEMA)
    for zone, score in (("UTC", 0), ("Asia/Seoul", 20), ("offset", 20)):
        assert score_events(df, baseline_rules(zone)).first()["risk_score"] == score


def test_added_rule_and_catalog(spark):
    extra = Rule("NEW_DEVICE", 25, "device is new", lambda: F.col("new_device"))
    rules = baseline_rules().with_rule(extra)
    codes = [r["rule_code"] for r in rule_catalog(spark, rules).orderBy("position").collect()]
    assert codes == [
        "AMOUNT_THRESHOLD",
        "NEW_DEVICE",
        "NIGHT_TIME_TRANSACTION",
        "SUSPICIOUS_LOCATION",
        "RAPID_TRANSACTION_COUNT",
        "WINDOW_AMOUNT_SUM",
    ]


def test_balance_rules(spark):
    rows = [
        (1, "TRANSFER", "800000", "1000000", "200000"),  # drain + pattern
        (2, "TRANSFER", "1000000", "1000000", "0"),  # everything, capped
        (3, "PAYMENT", "79", "100", "0"),  # just below the drain ratio, wrong type
        (4, "CASH_OUT", "5", "0", "0"),  # no money before: no rule
        (5, "CASH_OUT", "10", "100", "0"),  # zero after cash-out
    ]
    df = spark.createDataFrame(
        [(i, t, Decimal(a), Decimal(o), Decimal(n)) for i, t, a, o, n in rows],
        "id int, native_type string, amount decimal(19,2), old_balance decimal(19,2), "
        "new_balance decimal(19,2)",
    )
    got = {r["id"]: r for r in score_events(df, balance_rules()).collect()}
    assert [got[i]["risk_score"] for i in range(1, 6)] == [65, 100, 0, 0, 35]
    assert [got[i]["risk_level"] for i in range(1, 6)] == [
        "HIGH",
        "CRITICAL",
        "LOW",
        "LOW",
        "MEDIUM",
    ]


def test_scoring_stays_in_generated_code(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = score_events(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "BatchEval" not in plan


def test_filters_on_results_do_not_copy_the_scoring(spark):
    """The planner may copy lookups in the bits, but neither predicates nor their inputs."""
    from checks.tables import prepared
    from ledgerwatch.operators.quality import check_rule_version
    from ledgerwatch.plans.simulation import score_prepared

    scored = score_prepared(prepared(spark, "/root/testdata/sf0.001").events)

    def plan_size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString())

    whole = plan_size(scored)
    level = F.col("riskLevel")
    kept = scored.filter(level.isin("LOW", "HIGH") & (F.col("riskScore") > 10))
    assert plan_size(kept) < whole + 5_000
    rewritten = scored.withColumn(
        "ruleVersion", F.when(level == "LOW", "").when(level == "HIGH", "old").otherwise("new")
    )
    again = rewritten.withColumn("ruleVersion", F.when(level != "MEDIUM", F.col("ruleVersion")))
    assert plan_size(check_rule_version(again)) < whole + 10_000
    inputs = scored.filter(F.col("eventId") > "paysim-000000100")
    plan = inputs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("000000100")
