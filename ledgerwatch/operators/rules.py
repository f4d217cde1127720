"""Scoring rules as Column predicates, and the projection that applies them.

A rule is data: a code, a score, a reason and a function that builds its predicate. Adding a
rule adds a Column to one projection; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.config import (
    DEGRADED_REASON,
    RAPID_COUNT,
    RULE_VERSION,
    SUSPICIOUS_LOCATIONS,
    WINDOW_AMOUNT,
)
from ledgerwatch.functions.text import joined, list_text, strip
from ledgerwatch.functions.times import hour_in, hour_of_iso_text

NO_MATCH = "No fraud rule matched"


@dataclass(frozen=True)
class Rule:
    code: str
    score: int
    reason: str
    predicate: Callable[[], Column]
    stateful: bool = False

    def matched(self) -> Column:
        """Predicate with NULL read as no match."""
        return F.coalesce(self.predicate(), F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    """Rules in evaluation order, level bands ``(highest score, level)``, level decisions."""

    rules: tuple[Rule, ...]
    bands: tuple[tuple[int, str], ...]
    decisions: tuple[tuple[str, str], ...]
    version: str = RULE_VERSION
    max_score: int = 100

    def active(self, stateful: bool) -> tuple[Rule, ...]:
        """Stateless rules first, in code order; then the stateful ones as declared."""
        stateless = sorted(
            (r for r in self.rules if not r.stateful), key=lambda r: r.code
        )
        return tuple(stateless) + tuple(
            r for r in self.rules if r.stateful and stateful
        )

    def skippable(self) -> tuple[str, ...]:
        return tuple(r.code for r in self.rules if r.stateful)

    def with_rule(self, rule: Rule) -> RuleSet:
        return replace(self, rules=self.rules + (rule,))


def amount_threshold(threshold: int = 1_000_000) -> Rule:
    return Rule(
        "AMOUNT_THRESHOLD",
        50,
        f"amount >= {threshold} KRW",
        lambda: F.col("amount") >= F.lit(threshold),
    )


def night_time(night_hour_tz: str = "UTC") -> Rule:
    """``night_hour_tz`` is a zone name, or ``offset`` to read the hour from the event's own
    ISO text in ``event_time_text`` (a timestamp column no longer knows its offset)."""

    def predicate() -> Column:
        if night_hour_tz == "offset":
            hour = hour_of_iso_text(F.col("event_time_text"))
        else:
            hour = hour_in(F.col("event_time"), night_hour_tz)
        return hour.between(0, 5)

    return Rule(
        "NIGHT_TIME_TRANSACTION", 20, "eventTime hour between 0 and 5", predicate
    )


def suspicious_location() -> Rule:
    return Rule(
        "SUSPICIOUS_LOCATION",
        30,
        "location is UNKNOWN, FOREIGN, or HIGH_RISK",
        lambda: F.upper(strip(F.col("location"))).isin(*SUSPICIOUS_LOCATIONS),
    )


def rapid_count(minimum: int = RAPID_COUNT) -> Rule:
    return Rule(
        "RAPID_TRANSACTION_COUNT",
        30,
        f"transaction count in sliding window >= {minimum}",
        lambda: F.col("window_count") >= F.lit(minimum),
        stateful=True,
    )


def window_amount(threshold: int = WINDOW_AMOUNT) -> Rule:
    return Rule(
        "WINDOW_AMOUNT_SUM",
        40,
        f"amount sum in sliding window >= {threshold}",
        lambda: F.col("window_sum") >= F.lit(threshold),
        stateful=True,
    )


def baseline_rules(
    night_hour_tz: str = "UTC",
    rapid_minimum: int = RAPID_COUNT,
    window_threshold: int = WINDOW_AMOUNT,
) -> RuleSet:
    """The running rule set: three stateless and two sliding-window rules."""
    return RuleSet(
        rules=(
            amount_threshold(),
            night_time(night_hour_tz),
            suspicious_location(),
            rapid_count(rapid_minimum),
            window_amount(window_threshold),
        ),
        bands=((29, "LOW"), (69, "MEDIUM"), (100, "HIGH")),
        decisions=(("LOW", "APPROVE"), ("MEDIUM", "REVIEW"), ("HIGH", "BLOCK")),
    )


def balance_rules(
    pattern_threshold: int = 200_000, high_amount: int = 1_000_000
) -> RuleSet:
    """Second-generation rules on account balances.

    Inputs: ``amount``, ``native_type``, ``old_balance``, ``new_balance`` (decimals). Labels
    are not inputs. The 0.8 ratio is tested as ``amount * 10 >= old * 8``, exact in decimals.
    """

    def out_flow() -> Column:
        return F.col("native_type").isin("TRANSFER", "CASH_OUT")

    def had_money() -> Column:
        return F.col("old_balance") > 0

    return RuleSet(
        rules=(
            Rule(
                "BALANCE_DRAIN",
                40,
                "amount / oldBalanceOrig >= 0.8",
                lambda: (
                    had_money()
                    & (F.col("amount") > 0)
                    & (F.try_multiply("amount", F.lit(10)) >= F.try_multiply("old_balance", F.lit(8)))
                ),
            ),
            Rule(
                "HIGH_AMOUNT",
                30,
                f"amount >= {high_amount} KRW",
                lambda: F.col("amount") >= F.lit(high_amount),
            ),
            Rule(
                "TRANSFER_CASHOUT_PATTERN",
                25,
                f"transfer or cash-out with amount >= {pattern_threshold}",
                lambda: out_flow() & (F.col("amount") >= F.lit(pattern_threshold)),
            ),
            Rule(
                "ZERO_BALANCE_AFTER_TRANSFER",
                35,
                "balance is zero after transfer or cash-out",
                lambda: out_flow() & had_money() & (F.col("new_balance") == 0),
            ),
        ),
        bands=((29, "LOW"), (59, "MEDIUM"), (79, "HIGH"), (100, "CRITICAL")),
        decisions=(
            ("LOW", "APPROVE"),
            ("MEDIUM", "REVIEW"),
            ("HIGH", "HOLD_CANDIDATE"),
            ("CRITICAL", "BLOCK_CANDIDATE"),
        ),
    )


def risk_level(score: Column, bands: tuple[tuple[int, str], ...]) -> Column:
    """Level of the first band that reaches up to the score, looked up by how many do not."""
    below = [(score > F.lit(highest)).cast("int") for highest, _ in bands[:-1]]
    levels = F.array(*[F.lit(level) for _, level in bands])
    return F.get(levels, reduce(lambda a, b: a + b, below, F.lit(0)))


def decision(level: Column, decisions: tuple[tuple[str, str], ...]) -> Column:
    known = F.array(*[F.lit(name) for name, _ in decisions])
    # Position 0, of an unknown level, has no decision.
    values = F.array(F.lit(None).cast("string"), *[F.lit(value) for _, value in decisions])
    return F.get(values, F.array_position(known, level).cast("int"))


def score_events(
    df: DataFrame,
    rule_set: RuleSet | None = None,
    stateful: bool = True,
    degraded_reason: str = DEGRADED_REASON,
    degraded: Column | None = None,
) -> DataFrame:
    """Add risk_score, risk_level, decision, matched_rules, skipped_rules, degraded, reason
    and rule_version.

    ``stateful=False`` means there is no window state at all: the stateful rules are skipped
    for every row and the rows are marked degraded. A ``degraded`` column says so per row.

    The predicates are evaluated once per row, into one number with a bit for each rule. The
    number passes through a one-element explode: filters on what is derived from it stop
    there, while filters on the input go on to the scan. Without that stop the planner would
    write the predicates, and whatever made their inputs, out again for every mention of a
    level or score in a filter. Everything after it reads bits, in one projection.
    """
    rule_set = rule_set or baseline_rules()
    rules = rule_set.active(stateful)
    skipped = rule_set.skippable()
    if not skipped:
        is_degraded = F.lit(False)
    elif not stateful:
        is_degraded = F.lit(True)
    else:
        is_degraded = (
            F.lit(False) if degraded is None else F.coalesce(degraded, F.lit(False))
        )

    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        hit = rule.matched()
        hit = hit & ~is_degraded if rule.stateful else hit
        bits = bits + F.when(hit, F.lit(1 << place)).otherwise(F.lit(0)).cast("long")
    inputs = [c for c in df.columns if c != "degraded"]
    marked = df.select(*inputs, is_degraded.alias("degraded"), bits.alias("__bits"))
    marked = marked.select(
        *inputs, "degraded", F.explode_outer(F.array("__bits")).alias("__hits")
    )

    hits = [
        (F.col("__hits").bitwiseAND(F.lit(1 << place)) != 0, rule)
        for place, rule in enumerate(rules)
    ]
    total = reduce(
        lambda a, b: a + b,
        [F.when(hit, F.lit(r.score)).otherwise(F.lit(0)) for hit, r in hits],
        F.lit(0),
    )
    score = F.least(F.lit(rule_set.max_score), total)
    level = risk_level(score, rule_set.bands)
    codes = joined(",", [(hit, r.code) for hit, r in hits])
    reasons = joined("; ", [(hit, r.reason) for hit, r in hits])
    none = F.array().cast("array<string>")
    return marked.select(
        *inputs,
        score.alias("risk_score"),
        level.alias("risk_level"),
        decision(level, rule_set.decisions).alias("decision"),
        list_text(codes).alias("matched_rules"),
        F.when(F.col("degraded"), F.array(*[F.lit(c) for c in skipped]).cast("array<string>"))
        .otherwise(none)
        .alias("skipped_rules"),
        "degraded",
        F.concat(
            F.when(F.col("__hits") == 0, F.lit(NO_MATCH)).otherwise(reasons),
            F.when(
                F.col("degraded"), F.lit(f"; Redis degraded mode: {degraded_reason}")
            ).otherwise(F.lit("")),
        ).alias("reason"),
        F.lit(rule_set.version).alias("rule_version"),
    )


def rule_catalog(spark: SparkSession, rule_set: RuleSet | None = None) -> DataFrame:
    """What the engine runs, from the same objects that score events."""
    rows = [
        (i, r.code, True, r.score, r.reason, r.stateful)
        for i, r in enumerate((rule_set or baseline_rules()).active(True))
    ]
    return spark.createDataFrame(
        rows,
        "position int, rule_code string, enabled boolean, score int, "
        "condition string, requires_state boolean",
    )
