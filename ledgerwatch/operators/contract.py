"""The evaluation report as its contract has it, and the checks of that contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import THRESHOLD_POLICIES, ThresholdPolicy, threshold_policy
from ledgerwatch.functions.numbers import ratio
from ledgerwatch.operators.evaluation import EvaluationOptions
from ledgerwatch.operators.leaks import holds_raw_id

# Versions and texts of the report contract.
SCRIPT_VERSION = "paysim-evaluation-v1"
REPORT_SCHEMA_VERSION = "2026-06-v2-phase12"
FAIL_FAST = "fail_fast_before_report_generation"
MISSING_EXCLUDED = "missing_results_excluded_from_denominator"
MISSING_INCLUDED = "fraud_missing_as_FN_non_fraud_missing_as_TN"
COVERAGE_SCOPE = "evaluated_results_only"
RULE_VERSION_SOURCE = "per_result_when_present_otherwise_contract_level"
WORKLOAD_NOTE = (
    "candidate workload summary for evaluation evidence; not a production staffing guarantee"
)
TYPE_SCOPE = "split_replay_input_and_evaluation_denominator"
REPLAY_SCOPE = "replay_report_input_scope"
FORBIDDEN_TEXT = (
    "requestBody",
    "responseBody",
    "token",
    "authToken",
    "authorization",
    "nameOrig",
    "nameDest",
)
REQUIRED_FIELDS = (
    "scriptVersion",
    "reportSchemaVersion",
    "evaluationContractVersion",
    "evaluationPolicyVersion",
    "ruleVersion",
    "thresholdVersion",
    "thresholdPolicy",
    "recordFailurePolicy",
    "pipelineFailureCountingPolicy",
    "invalidRecordCountingPolicy",
    "totalEvents",
    "totalFraudLabels",
    "totalNonFraudLabels",
    "fraudLabeledEvents",
    "evaluatedFraudLabeledEvents",
    "detectedFraudEvents",
    "missedFraudEvents",
    "evaluatedMissedFraudEvents",
    "falsePositiveEvents",
    "truePositiveEvents",
    "trueNegativeEvents",
    "missingFraudLabels",
    "missingNonFraudLabels",
    "misclassifiedEvents",
    "unmatchedResultEvents",
    "reviewCandidateEvents",
    "reviewCandidateRate",
    "blockedCandidateEvents",
    "blockedCandidateRate",
    "actionDecisionDistribution",
    "operatorWorkloadSummary",
    "riskScoreCoverage",
    "ruleVersionCoverage",
    "ruleVersionReadiness",
    "ruleVersionDistribution",
    "requirePerResultRuleVersion",
    "thresholdRegressionReliability",
    "evaluationExcludedRecords",
    "failedRecords",
    "invalidRecords",
    "missingResultTreatment",
    "confusionMatrix",
    "metrics",
    "riskLevelCounts",
    "ruleCodeCounts",
    "warnings",
)
METRICS = (
    "precision",
    "recall",
    "f1Score",
    "falsePositiveRate",
    "falseNegativeRate",
    "accuracy",
)
MATRIX = ("truePositive", "falsePositive", "trueNegative", "falseNegative")
# Rates of a report may differ from their counts by rounding only.
CLOSE = 1e-9


def _policy_texts(policy: ThresholdPolicy) -> dict[str, str]:
    """The policy in words, as the report states it."""
    review, block = "/".join(policy.review_levels), "/".join(policy.block_levels)
    return {
        "fraudPredictionPolicy": "riskScore >= mediumRiskThreshold when riskScore is present; "
        f"otherwise riskLevel >= {policy.positive_level}",
        "reviewCandidatePolicy": f"riskScore >= mediumRiskThreshold or riskLevel in {review}",
        "blockedCandidatePolicy": f"riskScore >= highRiskThreshold or riskLevel in {block}",
    }


def _struct(**fields: Column | str | float | int | bool) -> Column:
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]
    )


def _by_policy(make) -> Column:
    """A value of the row's threshold policy; the policies are few and fixed."""
    versions = sorted(THRESHOLD_POLICIES)
    tests = [(F.col("thresholdVersion") == v, make(threshold_policy(v))) for v in versions]
    return reduce(lambda chain, t: chain.when(*t), tests[1:], F.when(*tests[0]))


def _policy_struct(policy: ThresholdPolicy) -> Column:
    levels = [F.array(*[F.lit(x) for x in own]) for own in (policy.review_levels, policy.block_levels)]
    return _struct(
        thresholdVersion=policy.version,
        mediumRiskThreshold=policy.medium,
        highRiskThreshold=policy.high,
        positiveRiskLevelFallback=policy.positive_level,
        reviewRiskLevelsFallback=levels[0],
        blockRiskLevelsFallback=levels[1],
        **_policy_texts(policy),
        operatorWorkloadBudget=_budget(policy),
    )


def _budget(policy: ThresholdPolicy) -> Column:
    return _struct(
        maxReviewCandidateRateCandidate=policy.max_review_rate,
        maxBlockedCandidateRateCandidate=policy.max_block_rate,
    )


def contract_report(
    report: DataFrame,
    options: EvaluationOptions | None = None,
    replay: DataFrame | None = None,
) -> DataFrame:
    """Every field of the report contract for each row of ``evaluate``'s report.

    ``replay`` is a replay report row, whose distributions describe what was sent; without it
    they are empty and ``replayReportUsed`` is false. Times and paths of a run are not facts
    of the data; add them where the run is known.
    """
    options = options or EvaluationOptions()
    empty = F.create_map().cast("map<string,bigint>")
    sent = {
        "nativeTypeDistribution": "inputNativeTypeDistribution",
        "normalizedTypeDistribution": "inputNormalizedTypeDistribution",
        "typeSupportLevelDistribution": "inputTypeSupportLevelDistribution",
        "excludedByType": "excludedByType",
        "mappingPolicyVersions": "mappingPolicyVersions",
    }
    rows = report.withColumn("__one", F.lit(1))
    if replay is None:
        rows = rows.withColumns({f"__{n}": empty for n in sent})
        rows = rows.withColumns(
            {
                "__rejected": F.lit(None).cast("bigint"),
                "__unmapped": F.lit(0).cast("bigint"),
                "__mapping": F.lit(None).cast("string"),
            }
        )
    else:
        one = replay.select(
            F.lit(1).alias("__one"),
            *[F.coalesce(F.col(have), empty).alias(f"__{name}") for name, have in sent.items()],
            F.col("payloadRejected").alias("__rejected"),
            F.col("missingMappingMetadata").alias("__unmapped"),
            F.col("mappingPolicyVersion").alias("__mapping"),
        )
        # One row of the replay for one row per policy.
        rows = rows.join(one, "__one", "left")
    tp, fp, tn, fn = (F.col(name) for name in MATRIX)
    none = F.lit(0).cast("bigint")
    treatment = MISSING_INCLUDED if options.include_missing_results else MISSING_EXCLUDED
    complete = F.col("__rejected") <= F.col("excludedReplayRejected")
    if not options.exclude_replay_rejected:
        complete = F.lit(None).cast("boolean")
    fields = {
        "scriptVersion": F.lit(SCRIPT_VERSION),
        "reportSchemaVersion": F.lit(REPORT_SCHEMA_VERSION),
        "evaluationContractVersion": F.col("evaluationContractVersion"),
        "evaluationPolicyVersion": F.col("evaluationPolicyVersion"),
        "ruleVersion": F.col("ruleVersion"),
        "thresholdVersion": F.col("thresholdVersion"),
        "thresholdPolicy": _by_policy(_policy_struct),
        "highRiskThreshold": _by_policy(lambda p: F.lit(p.high)),
        "mediumRiskThreshold": _by_policy(lambda p: F.lit(p.medium)),
        "decisionPolicy": _by_policy(
            lambda p: _struct(
                reviewCandidate=_policy_texts(p)["reviewCandidatePolicy"],
                blockedCandidate=_policy_texts(p)["blockedCandidatePolicy"],
            )
        ),
        "replayReportUsed": F.lit(replay is not None),
        "positiveRiskLevel": _by_policy(lambda p: F.lit(p.positive_level)),
        "eventIdPrefix": F.col("eventIdPrefix"),
        "excludeReplayRejected": F.lit(options.exclude_replay_rejected),
        "includeMissingResults": F.lit(options.include_missing_results),
        "requirePerResultRuleVersion": F.lit(options.require_rule_version),
        "missingResultTreatment": F.lit(treatment),
        "recordFailurePolicy": F.lit(FAIL_FAST),
        "pipelineFailureCountingPolicy": F.lit(FAIL_FAST),
        "invalidRecordCountingPolicy": F.lit(FAIL_FAST),
        **{
            n: F.col(n)
            for n in (
                "totalLabels",
                "totalFraudLabels",
                "totalNonFraudLabels",
                "totalResults",
                "matchedResults",
                "unmatchedResults",
                "evaluatedEvents",
                "excludedReplayRejected",
                "missingResults",
                "missingFraudLabels",
                "missingNonFraudLabels",
            )
        },
        "replayPayloadRejected": F.col("__rejected"),
        "mappingPolicyVersion": F.col("__mapping"),
        "replayMissingMappingMetadata": F.col("__unmapped"),
        "replayRejectedEventIdsAvailable": F.col("excludedReplayRejected"),
        "replayRejectedExclusionComplete": complete,
        "typeDistributionScope": F.lit(TYPE_SCOPE),
        "nativeTypeDistributionSource": F.lit(REPLAY_SCOPE),
        "normalizedTypeDistributionSource": F.lit(REPLAY_SCOPE),
        "typeSupportLevelDistributionSource": F.lit(REPLAY_SCOPE),
        "evaluationDenominatorTypeDistributionAvailable": F.lit(True),
        **{n: F.col(f"__{n}") for n in sent},
        "evaluatedNativeTypeDistribution": F.col("evaluatedNativeTypeDistribution"),
        "evaluatedNormalizedTypeDistribution": F.col("evaluatedNormalizedTypeDistribution"),
        "denominatorExcludedNativeTypeDistribution": F.col(
            "denominatorExcludedNativeTypeDistribution"
        ),
        "totalEvents": F.col("evaluatedEvents"),
        "fraudLabeledEvents": tp + fn,
        "evaluatedFraudLabeledEvents": tp + fn,
        "detectedFraudEvents": tp + fp,
        "missedFraudEvents": fn,
        "evaluatedMissedFraudEvents": fn,
        "falsePositiveEvents": fp,
        "truePositiveEvents": tp,
        "trueNegativeEvents": tn,
        "misclassifiedEvents": fp + fn,
        "unmatchedResultEvents": F.col("unmatchedResults"),
        "reviewCandidateEvents": F.col("reviewCandidateEvents"),
        "reviewCandidateRate": F.col("reviewCandidateRate"),
        "blockedCandidateEvents": F.col("blockedCandidateEvents"),
        "blockedCandidateRate": F.col("blockedCandidateRate"),
        "actionDecisionDistribution": F.col("actionDecisionDistribution"),
        "riskScoreCoverage": _struct(
            resultsWithRiskScore=F.col("resultsWithRiskScore"),
            resultsWithoutRiskScore=F.col("resultsWithoutRiskScore"),
            coverageRate=F.col("riskScoreCoverageRate"),
            coverageScope=COVERAGE_SCOPE,
        ),
        "ruleVersionCoverage": _struct(
            resultsWithRuleVersion=F.col("resultsWithRuleVersion"),
            resultsWithoutRuleVersion=F.col("resultsWithoutRuleVersion"),
            coverageRate=F.col("ruleVersionCoverageRate"),
            coverageScope=COVERAGE_SCOPE,
            ruleVersionSource=RULE_VERSION_SOURCE,
        ),
        "ruleVersionReadiness": F.col("ruleVersionReadiness"),
        "ruleVersionDistribution": F.col("ruleVersionDistribution"),
        "thresholdRegressionReliability": F.col("thresholdRegressionReliability"),
        "operatorWorkloadSummary": _struct(
            reviewCandidateEvents=F.col("reviewCandidateEvents"),
            reviewCandidateRate=F.col("reviewCandidateRate"),
            blockedCandidateEvents=F.col("blockedCandidateEvents"),
            blockedCandidateRate=F.col("blockedCandidateRate"),
            workloadBudget=_by_policy(_budget),
            budgetStatus=_struct(
                reviewCandidateRateWithinBudget=F.col("reviewRateWithinBudget"),
                blockedCandidateRateWithinBudget=F.col("blockedRateWithinBudget"),
            ),
            interpretation=WORKLOAD_NOTE,
        ),
        "evaluationExcludedRecords": F.col("excludedReplayRejected"),
        # The job fails on records that break the contract, so a report counts none.
        "failedRecords": none,
        "invalidRecords": none,
        "confusionMatrix": F.struct(*MATRIX),
        "metrics": F.struct(*METRICS),
        "riskLevelCounts": F.col("riskLevelCounts"),
        "fraudByRiskLevel": F.col("fraudByRiskLevel"),
        "nonFraudByRiskLevel": F.col("nonFraudByRiskLevel"),
        "ruleCodeCounts": F.col("ruleCodeCounts"),
        "warnings": F.col("warnings"),
        "sampleEventIds": F.col("sampleEventIds"),
    }
    return rows.select(*[value.alias(name) for name, value in fields.items()])


def report_violations(report: DataFrame) -> DataFrame:
    """(thresholdVersion, problem) for everything a report says against its contract: fields
    that are missing, matrix and derived counts that do not add up, rates that are not those
    of their counts, other versions or policies, and text that must not leave. No rows is
    good. Takes any table of reports; a column it lacks is a missing field."""
    have = set(report.columns)
    missing = [f"MISSING_FIELD:{n}" for n in REQUIRED_FIELDS if n not in have]
    for name, wanted in (("metrics", METRICS), ("confusionMatrix", MATRIX)):
        inner = set(report.schema[name].dataType.names) if name in have else set()
        missing += [f"MISSING_FIELD:{name}.{n}" for n in wanted if name in have and n not in inner]
    version = F.col("thresholdVersion") if "thresholdVersion" in have else F.lit(None).cast("string")
    if missing:
        problems = F.array(*[F.lit(m) for m in missing])
        return report.select(version.alias("thresholdVersion"), F.explode(problems).alias("problem"))
    matrix, metric = F.col("confusionMatrix"), F.col("metrics")
    tp, fp, tn, fn = (matrix[n] for n in MATRIX)
    total = F.col("totalEvents")

    def equal(name: str, value: Column) -> tuple[Column, str]:
        return ~F.col(name).eqNullSafe(value), f"COUNT:{name}"

    def rate(name: str, found: Column, over: Column, under: Column) -> tuple[Column, str]:
        wanted = ratio(over, under)
        same = F.coalesce(F.abs(found - wanted) <= CLOSE, found.isNull() & wanted.isNull())
        return ~same, f"RATE:{name}"

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / both)
    score, rule = F.col("riskScoreCoverage"), F.col("ruleVersionCoverage")
    work = F.col("operatorWorkloadSummary")
    with_score, no_score = score["resultsWithRiskScore"], score["resultsWithoutRiskScore"]
    with_rule, no_rule = rule["resultsWithRuleVersion"], rule["resultsWithoutRuleVersion"]
    full = F.when(no_score == 0, "full_risk_score_coverage").otherwise(
        "partial_without_full_risk_score_coverage"
    )
    treatment = F.when(F.col("includeMissingResults"), MISSING_INCLUDED).otherwise(MISSING_EXCLUDED)
    if "includeMissingResults" not in have:
        treatment = F.lit(MISSING_EXCLUDED)

    def budget(part: str, most: str) -> tuple[Column, str]:
        held = work["budgetStatus"][f"{part}CandidateRateWithinBudget"]
        within = F.coalesce(work[f"{part}CandidateRate"] <= work["workloadBudget"][most], F.lit(True))
        return ~held.eqNullSafe(within), f"BUDGET:{part}"

    text = F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})
    checks = [
        *[(F.col(n) != FAIL_FAST, f"POLICY:{n}") for n in (
            "recordFailurePolicy", "pipelineFailureCountingPolicy", "invalidRecordCountingPolicy"
        )],
        (F.col("scriptVersion") != SCRIPT_VERSION, "VERSION:scriptVersion"),
        (F.col("reportSchemaVersion") != REPORT_SCHEMA_VERSION, "VERSION:reportSchemaVersion"),
        (F.col("thresholdPolicy")["thresholdVersion"] != version, "VERSION:thresholdPolicy"),
        (F.col("missingResultTreatment") != treatment, "POLICY:missingResultTreatment"),
        (~total.eqNullSafe(tp + fp + tn + fn), "COUNT:confusionMatrix"),
        equal("truePositiveEvents", tp),
        equal("falsePositiveEvents", fp),
        equal("trueNegativeEvents", tn),
        equal("missedFraudEvents", fn),
        equal("evaluatedMissedFraudEvents", fn),
        equal("fraudLabeledEvents", tp + fn),
        equal("evaluatedFraudLabeledEvents", tp + fn),
        equal("detectedFraudEvents", tp + fp),
        equal("misclassifiedEvents", fp + fn),
        equal("failedRecords", F.lit(0).cast("bigint")),
        equal("invalidRecords", F.lit(0).cast("bigint")),
        rate("precision", metric["precision"], tp, tp + fp),
        rate("recall", metric["recall"], tp, tp + fn),
        rate("falsePositiveRate", metric["falsePositiveRate"], fp, fp + tn),
        rate("falseNegativeRate", metric["falseNegativeRate"], fn, fn + tp),
        rate("accuracy", metric["accuracy"], tp + tn, total),
        (~F.coalesce(F.abs(metric["f1Score"] - f1) <= CLOSE, metric["f1Score"].isNull() & f1.isNull()), "RATE:f1Score"),
        rate("reviewCandidateRate", F.col("reviewCandidateRate"), F.col("reviewCandidateEvents"), total),
        rate("blockedCandidateRate", F.col("blockedCandidateRate"), F.col("blockedCandidateEvents"), total),
        rate("riskScoreCoverage", score["coverageRate"], with_score, with_score + no_score),
        rate("ruleVersionCoverage", rule["coverageRate"], with_rule, with_rule + no_rule),
        (with_score + no_score != with_rule + no_rule, "COUNT:coverage"),
        (F.col("thresholdRegressionReliability") != full, "POLICY:thresholdRegressionReliability"),
        budget("review", "maxReviewCandidateRateCandidate"),
        budget("blocked", "maxBlockedCandidateRateCandidate"),
        *[(text.contains(word), f"FORBIDDEN_TEXT:{word}") for word in FORBIDDEN_TEXT],
        (holds_raw_id(text), "RAW_IDENTIFIER"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks]))
    found = report.select(version.alias("thresholdVersion"), F.explode_outer(found).alias("problem"))
    return found.filter("problem IS NOT NULL")
