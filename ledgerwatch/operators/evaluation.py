"""Compare scored results with labels.

``join_labels_results`` brings labels, results and pre-send rejects together in one co-keyed
join. ``evaluation_cube`` reduces that to counts per combination of the few categorical facts
the report needs; every metric and distribution is then a tiny aggregate of the cube, so all
numbers of all threshold policies come from one join. ``evaluate`` reads its input twice more,
for the checks of its contract and for the ids given as evidence, so it has what made that
input computed once before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.config import (
    DEFAULT_THRESHOLD_VERSION,
    EVALUATION_CONTRACT_VERSION,
    EVALUATION_POLICY_VERSION,
    EVIDENCE_IDS,
    REPLAY_REJECT_PREFIXES,
    RISK_LEVELS,
    RULE_VERSION,
    ThresholdPolicy,
    threshold_policy,
)
from ledgerwatch.functions.numbers import ratio
from ledgerwatch.functions.text import csv_to_array, starts_with_any
from ledgerwatch.operators.quality import (
    check_results,
    check_rule_version,
    duplicate_keys,
    label_violations,
)
from ledgerwatch.operators.replay import strip_event_id_prefix
from ledgerwatch.operators.typemap import map_native_type
from ledgerwatch.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class EvaluationOptions:
    threshold_versions: tuple[str, ...] = (DEFAULT_THRESHOLD_VERSION,)
    rule_version: str = RULE_VERSION
    event_id_prefix: str | None = None
    exclude_replay_rejected: bool = True
    include_missing_results: bool = False
    require_rule_version: bool = False
    # Refuse labels and results that break the input contract, see ``input_violations``.
    check_inputs: bool = True
    # Write labels and results to the checkpoint folder first. They are read for the join, the
    # checks and the evidence; leave it out where both are stored tables already.
    materialize: bool = True


# ---------------------------------------------------------------- results


def normalize_rule_codes(df: DataFrame) -> DataFrame:
    """Add ``rule_codes``: the first of ruleCodes, matchedRules, matchedRuleCodes that the
    table has and that is set, as an array; text is split at commas, blanks dropped."""
    forms = []
    types = dict(df.dtypes)
    for name in ("ruleCodes", "matchedRules", "matchedRuleCodes"):
        if name not in types:
            continue
        column = F.col(name)
        if types[name] == "string":
            value = csv_to_array(column)
        else:
            value = F.filter(column.cast("array<string>"), lambda item: item != "")
        forms.append(F.when(column.isNotNull(), value))
    none = F.array().cast("array<string>")
    return df.withColumn("rule_codes", F.coalesce(*forms, none))


def normalize_results(results: DataFrame, prefix: str | None = None) -> DataFrame:
    """(event_id, risk_level, risk_score, rule_version, rule_codes), replay prefix removed."""
    coded = normalize_rule_codes(results)
    return coded.select(
        strip_event_id_prefix(F.col("eventId"), prefix).alias("event_id"),
        F.col("riskLevel").alias("risk_level"),
        F.col("riskScore").cast("double").alias("risk_score"),
        F.col("ruleVersion").alias("rule_version"),
        "rule_codes",
    )


def replay_rejected_ids(rejects: DataFrame, prefix: str | None = None) -> DataFrame:
    """Distinct ids that failed before sending (reason starts with a known prefix)."""
    return (
        rejects.filter(starts_with_any(F.col("reason"), REPLAY_REJECT_PREFIXES))
        .filter(F.col("eventId").isNotNull())
        .select(strip_event_id_prefix(F.col("eventId"), prefix).alias("event_id"))
        .distinct()
    )


def exclude_replay_rejected(
    labels: DataFrame, rejects: DataFrame, prefix: str | None = None
) -> DataFrame:
    """Labels that stay in the denominator."""
    ids = replay_rejected_ids(rejects, prefix).withColumnRenamed("event_id", "eventId")
    return labels.join(ids, "eventId", "left_anti")


def matched_results(labels: DataFrame, results: DataFrame) -> DataFrame:
    ids = labels.select(F.col("eventId").alias("event_id"))
    return results.join(ids, "event_id", "left_semi")


def unmatched_results(labels: DataFrame, results: DataFrame) -> DataFrame:
    ids = labels.select(F.col("eventId").alias("event_id"))
    return results.join(ids, "event_id", "left_anti")


def join_labels_results(
    labels: DataFrame, results: DataFrame, rejected_ids: DataFrame | None = None
) -> DataFrame:
    """Full join on the event id, so labels without a result and results without a label are
    both kept: has_label, has_result, excluded, is_fraud, source_type and the result columns.
    ``results`` comes from ``normalize_results``."""
    left = labels.select(
        F.col("eventId").alias("event_id"),
        F.col("isFraud").alias("is_fraud"),
        F.col("sourceType").alias("source_type"),
        F.lit(True).alias("has_label"),
    )
    joined = left.join(results.withColumn("has_result", F.lit(True)), "event_id", "full")
    if rejected_ids is None:
        joined = joined.withColumn("excluded", F.lit(False))
    else:
        marks = rejected_ids.select("event_id", F.lit(True).alias("excluded"))
        joined = joined.join(marks, "event_id", "left")
    no = F.lit(False)
    return joined.withColumns(
        {
            "has_label": F.coalesce("has_label", no),
            "has_result": F.coalesce("has_result", no),
            "excluded": F.coalesce("excluded", no) & F.coalesce("has_label", no),
        }
    )


# ---------------------------------------------------------------- decisions


def policies_column(versions: tuple[str, ...]) -> Column:
    """The asked threshold policies as an array literal, to explode in place of a join."""

    def one(p: ThresholdPolicy) -> Column:
        return F.struct(
            F.lit(p.version).alias("version"),
            F.lit(p.medium).alias("medium"),
            F.lit(p.high).alias("high"),
            F.lit(p.positive_level).alias("positive_level"),
            F.array(*[F.lit(v) for v in p.review_levels]).alias("review_levels"),
            F.array(*[F.lit(v) for v in p.block_levels]).alias("block_levels"),
            F.lit(p.max_review_rate).alias("max_review_rate"),
            F.lit(p.max_block_rate).alias("max_block_rate"),
        )

    return F.array(*[one(threshold_policy(v)) for v in versions])


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in RISK_LEVELS]), level)


def predict_positive(policy: Column) -> Column:
    """Score at or above the medium threshold; without a score, level at or above the
    policy's fallback level."""
    by_score = F.col("risk_score") >= policy["medium"]
    by_level = level_rank(F.col("risk_level")) >= level_rank(policy["positive_level"])
    return F.when(F.col("risk_score").isNotNull(), by_score).otherwise(by_level)


def action_decision(policy: Column) -> Column:
    score, level = F.col("risk_score"), F.col("risk_level")
    by_score = (
        F.when(score >= policy["high"], F.lit("BLOCK"))
        .when(score >= policy["medium"], F.lit("REVIEW"))
        .otherwise(F.lit("ALLOW"))
    )
    by_level = (
        F.when(F.array_contains(policy["block_levels"], level), F.lit("BLOCK"))
        .when(F.array_contains(policy["review_levels"], level), F.lit("REVIEW"))
        .otherwise(F.lit("ALLOW"))
    )
    return F.when(score.isNotNull(), by_score).otherwise(by_level)


def with_decisions(joined: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """One row per joined row and policy, with ``predicted`` and ``action`` (NULL where
    there is no result)."""
    policy = F.col("policy")
    return joined.withColumn("policy", F.explode(policies_column(versions))).withColumns(
        {
            "predicted": F.when(F.col("has_result"), predict_positive(policy)),
            "action": F.when(F.col("has_result"), action_decision(policy)),
        }
    )


def evaluation_cube(joined: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Counts per combination of categorical facts. Its size depends on the number of
    versions, types, levels and rule combinations, not on the number of events."""
    decided = with_decisions(joined, versions)
    cube = decided.groupBy(
        F.col("policy.version").alias("threshold_version"),
        "has_label",
        "has_result",
        "excluded",
        "is_fraud",
        "source_type",
        "risk_level",
        "predicted",
        "action",
        F.col("risk_score").isNotNull().alias("has_score"),
        "rule_version",
        F.concat_ws(",", "rule_codes").alias("rule_codes"),
    ).agg(F.count("*").alias("n"))
    mapped = map_native_type(cube, "source_type")
    return mapped.select(
        *cube.columns,
        F.when(F.col("source_type").isNotNull(), F.col("normalized_type")).alias(
            "normalized_type"
        ),
    )


# ---------------------------------------------------------------- numbers


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def confusion_matrix(cube: DataFrame, include_missing: bool = False) -> DataFrame:
    """Every scalar count per threshold version: totals, matches, the confusion matrix,
    workload and coverage counts."""
    label, result = F.col("has_label"), F.col("has_result")
    open_label = label & ~F.col("excluded")
    scored = open_label & result
    missing = open_label & ~result
    fraud = F.col("is_fraud")
    hit = F.col("predicted")
    kept_missing = missing & F.lit(include_missing)
    evaluated = scored | kept_missing
    return cube.groupBy("threshold_version").agg(
        _count(label).alias("totalLabels"),
        _count(label & fraud).alias("totalFraudLabels"),
        _count(label & ~fraud).alias("totalNonFraudLabels"),
        _count(result).alias("totalResults"),
        _count(label & result).alias("matchedResults"),
        _count(~label & result).alias("unmatchedResults"),
        _count(label & F.col("excluded")).alias("excludedReplayRejected"),
        _count(missing).alias("missingResults"),
        _count(missing & fraud).alias("missingFraudLabels"),
        _count(missing & ~fraud).alias("missingNonFraudLabels"),
        _count(evaluated).alias("evaluatedEvents"),
        _count(scored & fraud & hit).alias("truePositive"),
        _count(scored & ~fraud & hit).alias("falsePositive"),
        _count((scored & ~fraud & ~hit) | (kept_missing & ~fraud)).alias("trueNegative"),
        _count((scored & fraud & ~hit) | (kept_missing & fraud)).alias("falseNegative"),
        _count(scored & F.col("action").isin("REVIEW", "BLOCK")).alias(
            "reviewCandidateEvents"
        ),
        _count(scored & (F.col("action") == "BLOCK")).alias("blockedCandidateEvents"),
        _count(scored & F.col("has_score")).alias("resultsWithRiskScore"),
        _count(scored & ~F.col("has_score")).alias("resultsWithoutRiskScore"),
        _count(scored & F.col("rule_version").isNotNull()).alias("resultsWithRuleVersion"),
        _count(scored & F.col("rule_version").isNull()).alias("resultsWithoutRuleVersion"),
    )


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Add precision, recall, f1Score, falsePositiveRate, falseNegativeRate, accuracy. A zero
    denominator gives NULL."""
    tp, fp = F.col("truePositive"), F.col("falsePositive")
    tn, fn = F.col("trueNegative"), F.col("falseNegative")
    with_rates = matrix.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "falsePositiveRate": ratio(fp, fp + tn),
            "falseNegativeRate": ratio(fn, fn + tp),
            "accuracy": ratio(tp + tn, F.col("evaluatedEvents")),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    return with_rates.withColumn(
        "f1Score", F.try_divide(F.lit(2.0) * precision * recall, precision + recall)
    )


def rule_version_coverage(matrix: DataFrame) -> DataFrame:
    have = F.col("resultsWithRuleVersion")
    lack = F.col("resultsWithoutRuleVersion")
    readiness = (
        F.when(have == 0, F.lit("contract_level_only"))
        .when(lack > 0, F.lit("contract_level_with_partial_per_result_coverage"))
        .otherwise(F.lit("per_result_verified"))
    )
    return matrix.withColumns(
        {
            "ruleVersionCoverageRate": ratio(have, have + lack),
            "ruleVersionReadiness": readiness,
        }
    )


def risk_score_coverage(matrix: DataFrame) -> DataFrame:
    have = F.col("resultsWithRiskScore")
    lack = F.col("resultsWithoutRiskScore")
    reliability = F.when(lack == 0, F.lit("full_risk_score_coverage")).otherwise(
        F.lit("partial_without_full_risk_score_coverage")
    )
    return matrix.withColumns(
        {
            "riskScoreCoverageRate": ratio(have, have + lack),
            "thresholdRegressionReliability": reliability,
        }
    )


def _budget(versions: tuple[str, ...], field: str) -> Column:
    chain = None
    for version in versions:
        value = F.lit(getattr(threshold_policy(version), field))
        test = F.col("threshold_version") == version
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def workload_summary(matrix: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Add candidate rates and whether they are inside the policy's budget; a NULL rate is."""
    done = F.col("evaluatedEvents")
    out = matrix.withColumns(
        {
            "reviewCandidateRate": ratio(F.col("reviewCandidateEvents"), done),
            "blockedCandidateRate": ratio(F.col("blockedCandidateEvents"), done),
        }
    )
    yes = F.lit(True)
    return out.withColumns(
        {
            "reviewRateWithinBudget": F.coalesce(
                F.col("reviewCandidateRate") <= _budget(versions, "max_review_rate"), yes
            ),
            "blockedRateWithinBudget": F.coalesce(
                F.col("blockedCandidateRate") <= _budget(versions, "max_block_rate"), yes
            ),
        }
    )


# Warning texts of the evaluation report, in report order.
WARNINGS = {
    "no_positive": "No positive prediction was produced; precision is null.",
    "no_events": "No events were evaluated; denominator-based metrics are null.",
    "hidden_rejects": (
        "Replay report payloadRejected is greater than available rejected eventIds; "
        "evaluation denominator may include replay-rejected events."
    ),
    "missing_included": (
        "Missing detection results are included in metrics; "
        "non-fraud missing results are counted as true negatives by policy."
    ),
    "missing_excluded": (
        "Missing detection results are excluded from denominator metrics by default."
    ),
    "no_match": (
        "Detection results exist but do not match any label eventId. "
        "Check --event-id-prefix or result export source."
    ),
    "some_unmatched": (
        "Some detection results do not match any label eventId and were not used in metrics."
    ),
    "no_score": (
        "Some evaluated results do not include riskScore; "
        "threshold policy falls back to riskLevel-based decisions."
    ),
    "no_version": (
        "Some evaluated results do not include per-result ruleVersion; "
        "evaluation uses contract-level ruleVersion."
    ),
    "review_budget": "Review candidate rate exceeds candidate workload budget.",
    "block_budget": "Blocked candidate rate exceeds candidate workload budget.",
}


def evaluation_warnings(
    summary: DataFrame,
    include_missing: bool = False,
    payload_rejected: int | None = None,
    rejected_ids: Column | None = None,
) -> DataFrame:
    """Add ``warnings``. ``payload_rejected`` is the count an imported replay report states;
    ``rejected_ids`` the number of ids it actually lists (default: the excluded labels)."""
    missing = F.col("missingResults") > 0
    no_match = (F.col("totalResults") > 0) & (F.col("matchedResults") == 0)
    listed = F.col("excludedReplayRejected") if rejected_ids is None else rejected_ids
    hidden = F.lit(False) if payload_rejected is None else F.lit(payload_rejected) > listed
    conditions = {
        "no_positive": F.col("truePositive") + F.col("falsePositive") == 0,
        "no_events": F.col("evaluatedEvents") == 0,
        "hidden_rejects": hidden,
        "missing_included": missing & F.lit(include_missing),
        "missing_excluded": missing & F.lit(not include_missing),
        "no_match": no_match,
        "some_unmatched": ~no_match & (F.col("unmatchedResults") > 0),
        "no_score": F.col("resultsWithoutRiskScore") > 0,
        "no_version": F.col("resultsWithoutRuleVersion") > 0,
        "review_budget": ~F.col("reviewRateWithinBudget"),
        "block_budget": ~F.col("blockedRateWithinBudget"),
    }
    texts = F.array(*[F.when(conditions[k], F.lit(t)) for k, t in WARNINGS.items()])
    return summary.withColumn("warnings", F.array_compact(texts))


def distributions(cube: DataFrame, include_missing: bool = False) -> DataFrame:
    """(threshold_version, distribution, item, n): all distributions in one aggregate. The
    three by-level ones are zero-filled for the four levels."""
    label = F.col("has_label") & ~F.col("excluded")
    scored = label & F.col("has_result")
    counted = scored | (label & ~F.col("has_result") & F.lit(include_missing))

    def mark(name: str, item: Column, when: Column) -> Column:
        return F.when(
            when & item.isNotNull(),
            F.struct(F.lit(name).alias("distribution"), item.alias("item"), F.col("n")),
        )

    def zero(name: str, level: str) -> Column:
        return F.struct(
            F.lit(name).alias("distribution"),
            F.lit(level).alias("item"),
            F.lit(0).cast("long").alias("n"),
        )

    level = F.col("risk_level")
    by_level = {
        "riskLevelCounts": scored,
        "fraudByRiskLevel": scored & F.col("is_fraud"),
        "nonFraudByRiskLevel": scored & ~F.col("is_fraud"),
    }
    marks = [mark(name, level, when) for name, when in by_level.items()]
    marks += [zero(name, lv) for name in by_level for lv in RISK_LEVELS]
    marks += [
        mark("actionDecisionDistribution", F.col("action"), scored),
        mark("ruleVersionDistribution", F.col("rule_version"), scored),
        mark("evaluatedNativeTypeDistribution", F.col("source_type"), counted),
        mark("evaluatedNormalizedTypeDistribution", F.col("normalized_type"), counted),
        mark(
            "denominatorExcludedNativeTypeDistribution",
            F.col("source_type"),
            F.col("has_label") & F.col("excluded"),
        ),
    ]
    codes = F.when(scored & (F.col("rule_codes") != ""), F.split("rule_codes", ","))
    code_marks = F.transform(
        F.coalesce(codes, F.array().cast("array<string>")),
        lambda code: F.struct(
            F.lit("ruleCodeCounts").alias("distribution"),
            code.alias("item"),
            F.col("n"),
        ),
    )
    return (
        cube.select(
            "threshold_version",
            F.explode(F.concat(F.array(*marks), code_marks)).alias("mark"),
        )
        .filter("mark IS NOT NULL")
        .groupBy("threshold_version", "mark.distribution", "mark.item")
        .agg(F.sum("mark.n").alias("n"))
    )


def evaluation_summary(
    cube: DataFrame,
    options: EvaluationOptions,
    payload_rejected: int | None = None,
) -> DataFrame:
    """All scalar report fields, one row per threshold version."""
    matrix = confusion_matrix(cube, options.include_missing_results)
    summary = classification_metrics(matrix)
    summary = rule_version_coverage(risk_score_coverage(summary))
    summary = workload_summary(summary, options.threshold_versions)
    return evaluation_warnings(summary, options.include_missing_results, payload_rejected)


def evidence_ids(
    joined: DataFrame, include_missing: bool = False, n: int = EVIDENCE_IDS
) -> DataFrame:
    """The first ``n`` evaluated ids in id order (a top-n, not a full sort)."""
    counted = F.col("has_label") & ~F.col("excluded")
    if not include_missing:
        counted = counted & F.col("has_result")
    return joined.filter(counted).select("event_id").orderBy("event_id").limit(n)


def input_violations(
    labels: DataFrame, results: DataFrame, options: EvaluationOptions | None = None
) -> DataFrame:
    """(part, event_id, problem) for every row an evaluation must not count: labels and
    results without id, repeated ids, unknown levels, scores outside 0 to 100, another rule
    version, labels without a verdict, and fields or values that must not be there."""
    options = options or EvaluationOptions()
    checked = label_violations(labels, strict=False).select(
        F.col("eventId").alias("event_id"), "violations"
    )
    broken = checked.select("event_id", F.explode_outer("violations").alias("problem"))
    broken = broken.filter("problem IS NOT NULL")
    repeated = duplicate_keys(checked.filter("event_id IS NOT NULL"), ["event_id"]).select(
        "event_id", F.lit("DUPLICATE_LABEL").alias("problem")
    )
    prefix = options.event_id_prefix
    other = check_rule_version(results, options.rule_version).select(
        strip_event_id_prefix(F.col("eventId"), prefix).alias("event_id"), "problem"
    )
    found = check_results(results, prefix).unionByName(other)
    return (
        broken.unionByName(repeated)
        .select(F.lit("labels").alias("part"), "event_id", "problem")
        .unionByName(found.select(F.lit("results").alias("part"), "event_id", "problem"))
    )


def _refuse(summary: DataFrame, violations: DataFrame) -> DataFrame:
    """The summary, or a failing job that says which rules are broken how often."""
    counts = violations.groupBy("part", "problem").agg(F.count("*").alias("n"))
    said = F.concat_ws(" ", "part", "problem", F.col("n").cast("string"))
    # One row: the rules are few.
    text = counts.agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("__broken"))
    both = summary.withColumn("__one", F.lit(1)).join(text.withColumn("__one", F.lit(1)), "__one")
    sound = F.when(F.col("__broken") == "", F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("input breaks the contract: "), F.col("__broken"))).cast(
            "boolean"
        )
    )
    return both.filter(sound).drop("__one", "__broken")


def evaluate(
    labels: DataFrame,
    results: DataFrame,
    rejects: DataFrame | None = None,
    options: EvaluationOptions | None = None,
    payload_rejected: int | None = None,
) -> DataFrame:
    """The evaluation report: one row per threshold version, distributions as maps.

    ``rejects`` has (eventId, reason) of events that failed before sending. The job fails on
    input that breaks the contract (``check_inputs``), and with ``require_rule_version`` when
    an evaluated result has no version.
    """
    options = options or EvaluationOptions()
    prefix = options.event_id_prefix
    if options.materialize:
        ensure_checkpoint_dir(labels.sparkSession)
        labels, results = labels.checkpoint(), results.checkpoint()
    ids = None
    if rejects is not None and options.exclude_replay_rejected:
        ids = replay_rejected_ids(rejects, prefix)
    joined = join_labels_results(labels, normalize_results(results, prefix), ids)
    cube = evaluation_cube(joined, options.threshold_versions)
    summary = evaluation_summary(cube, options, payload_rejected)
    if options.check_inputs:
        summary = _refuse(summary, input_violations(labels, results, options))
    if options.require_rule_version:
        lack = F.col("resultsWithoutRuleVersion")
        text = F.concat(
            F.lit("per-result ruleVersion is required but missing for "),
            lack.cast("string"),
            F.lit(" evaluated result row(s)"),
        )
        summary = summary.filter(
            F.when(lack == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
        )
    spread = (
        distributions(cube, options.include_missing_results)
        .groupBy("threshold_version", "distribution")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "n")))).alias("m"))
        .groupBy("threshold_version")
        .agg(F.map_from_entries(F.collect_list(F.struct("distribution", "m"))).alias("d"))
    )
    samples = evidence_ids(joined, options.include_missing_results).agg(
        F.array_sort(F.collect_list("event_id")).alias("sampleEventIds")
    )
    names = (
        "riskLevelCounts",
        "fraudByRiskLevel",
        "nonFraudByRiskLevel",
        "actionDecisionDistribution",
        "ruleCodeCounts",
        "ruleVersionDistribution",
        "evaluatedNativeTypeDistribution",
        "evaluatedNormalizedTypeDistribution",
        "denominatorExcludedNativeTypeDistribution",
    )
    empty = F.create_map().cast("map<string,bigint>")
    # One row of samples for one row per policy: joined on a constant, both sides tiny.
    return (
        summary.join(spread, "threshold_version", "left")
        .withColumn("__one", F.lit(1))
        .join(samples.withColumn("__one", F.lit(1)), "__one", "left")
        .drop("__one")
        .select(
            F.lit(EVALUATION_CONTRACT_VERSION).alias("evaluationContractVersion"),
            F.lit(EVALUATION_POLICY_VERSION).alias("evaluationPolicyVersion"),
            F.lit(options.rule_version).alias("ruleVersion"),
            F.col("threshold_version").alias("thresholdVersion"),
            F.lit(prefix).cast("string").alias("eventIdPrefix"),
            *[c for c in summary.columns if c != "threshold_version"],
            *[F.coalesce(F.col("d")[n], empty).alias(n) for n in names],
            "sampleEventIds",
        )
    )


def threshold_regression(joined: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """The same joined data under each threshold version, in one scan."""
    options = EvaluationOptions(threshold_versions=versions)
    return evaluation_summary(evaluation_cube(joined, versions), options)
