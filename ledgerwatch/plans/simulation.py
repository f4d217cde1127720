"""Simulation data, end to end: prepare, check, score, evaluate, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import LOCAL_SALT
from ledgerwatch.operators.evaluation import EvaluationOptions, evaluate
from ledgerwatch.operators.paysim import (
    Prepared,
    normalize_paysim,
    scoring_columns,
)
from ledgerwatch.operators.replay import validate_replay
from ledgerwatch.operators.rules import RuleSet, balance_rules, score_events


def prepare(raw: DataFrame, salt: str = LOCAL_SALT) -> Prepared:
    return Prepared(normalize_paysim(raw), salt=salt)


def score_prepared(events: DataFrame, rule_set: RuleSet | None = None) -> DataFrame:
    """Detection results in the evaluator's form, straight from prepared events."""
    scored = score_events(scoring_columns(events), rule_set or balance_rules())
    return scored.select(
        F.col("event_id").alias("eventId"),
        F.col("risk_level").alias("riskLevel"),
        F.col("risk_score").cast("double").alias("riskScore"),
        F.col("rule_version").alias("ruleVersion"),
        F.col("matched_rules").alias("ruleCodes"),
    )


def prepare_and_evaluate(
    raw: DataFrame,
    salt: str = LOCAL_SALT,
    options: EvaluationOptions | None = None,
) -> DataFrame:
    """Raw rows to evaluation report without leaving Spark."""
    prepared = prepare(raw, salt)
    checked = validate_replay(prepared.events)
    rejects = checked.filter("replay_reason IS NOT NULL").select(
        "eventId", F.col("replay_reason").alias("reason")
    )
    sent = checked.filter("replay_reason IS NULL")
    return evaluate(prepared.labels, score_prepared(sent), rejects, options)
