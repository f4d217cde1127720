"""Batch detection, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import WINDOW_MS
from ledgerwatch.operators.arrival import arrival_window
from ledgerwatch.operators.intake import (
    is_future,
    to_transaction_event,
    with_violations,
)
from ledgerwatch.operators.rules import RuleSet, baseline_rules, score_events
from ledgerwatch.operators.windows import first_wins, trailing_window

FUTURE = "eventTime must not be more than 5 minutes in the future"


@dataclass(frozen=True)
class Intake:
    accepted: DataFrame
    rejected: DataFrame


def take_in(requests: DataFrame) -> Intake:
    """Validate, bound event time, stamp. Both outputs come from one projection."""
    checked = with_violations(requests).withColumn(
        "violations",
        F.when(F.col("violations") != "", F.col("violations"))
        .when(is_future(), F.lit(FUTURE))
        .otherwise(F.lit("")),
    )
    accepted = checked.filter("violations = ''").drop("violations")
    return Intake(to_transaction_event(accepted), checked.filter("violations <> ''"))


def detect_batch(
    deliveries: DataFrame,
    rule_set: RuleSet | None = None,
    window_ms: int = WINDOW_MS,
    order: str = "event_time",
) -> DataFrame:
    """Results of accepted deliveries, one per event.

    ``order="event_time"`` counts windows by event time and is pure SQL operators;
    ``order="arrival"`` gives exactly what the stream would have answered.
    """
    once = first_wins(deliveries, ["event_id"], ["partition_no", "offset_no"])
    if order == "event_time":
        windowed = trailing_window(once, window_ms)
    elif order == "arrival":
        windowed = arrival_window(once, window_ms)
    else:
        raise ValueError(f"unknown window order: {order}")
    return score_events(windowed, rule_set or baseline_rules())
