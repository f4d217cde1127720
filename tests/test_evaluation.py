import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import evaluation as ev
from ledgerwatch.operators.quality import (
    check_results,
    check_rule_version,
    duplicate_keys,
    validate_dataset,
)
from ledgerwatch.operators.leaks import holds_raw_id, scan_json_leaks, scan_leaks
from ledgerwatch.operators.paysim import Prepared, normalize_paysim
from ledgerwatch.operators.replay import (
    events_from_json,
    replay_report,
    to_replay_request,
    validate_replay,
)
from ledgerwatch.operators.reports import prepare_report
from ledgerwatch.schemas import PAYSIM_EVENT
from tests.test_prepare import raw_rows

BOTH = ("threshold-v1", "threshold-strict-v1")
VERSION = "rule-v2-baseline-v1"


def labels(spark, *rows):
    return spark.createDataFrame(rows, "eventId string, isFraud boolean, sourceType string")


def results(spark, *rows):
    ddl = (
        "eventId string, riskLevel string, riskScore double, ruleVersion string, "
        "ruleCodes array<string>"
    )
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def golden(spark):
    report = ev.evaluate(
        labels(
            spark,
            ("p1", True, "TRANSFER"),
            ("p2", False, "PAYMENT"),
            ("p3", False, "CASH_OUT"),
            ("p4", True, "DEBIT"),
        ),
        results(
            spark,
            ("p1", "MEDIUM", 60.0, VERSION, ["A"]),
            ("p2", "LOW", 20.0, VERSION, []),
            ("p3", "HIGH", 85.0, VERSION, ["A", "B"]),
        ),
        spark.createDataFrame(
            [("p4", "UNSUPPORTED_NATIVE_TYPE:DEBIT")], "eventId string, reason string"
        ),
        ev.EvaluationOptions(threshold_versions=BOTH),
    )
    return {r["thresholdVersion"]: r for r in report.collect()}


def test_threshold_regression(golden):
    v1, strict = golden[BOTH[0]], golden[BOTH[1]]

    def cells(r):
        return tuple(
            r[c] for c in ("truePositive", "falsePositive", "trueNegative", "falseNegative")
        )

    assert cells(v1) == (1, 1, 1, 0) and cells(strict) == (0, 1, 1, 1)
    assert (v1["evaluatedEvents"], v1["excludedReplayRejected"]) == (3, 1)
    assert (v1["precision"], v1["recall"], round(v1["f1Score"], 6)) == (0.5, 1.0, 0.666667)
    assert (strict["recall"], strict["f1Score"]) == (0.0, None)
    assert (v1["reviewCandidateEvents"], v1["blockedCandidateEvents"]) == (2, 1)
    assert (strict["reviewCandidateEvents"], strict["blockedCandidateEvents"]) == (1, 0)
    assert v1["actionDecisionDistribution"] == {"ALLOW": 1, "REVIEW": 1, "BLOCK": 1}
    assert not v1["reviewRateWithinBudget"] and not v1["blockedRateWithinBudget"]
    assert v1["riskLevelCounts"] == {"LOW": 1, "MEDIUM": 1, "HIGH": 1, "CRITICAL": 0}
    assert v1["ruleCodeCounts"] == {"A": 2, "B": 1}
    assert v1["denominatorExcludedNativeTypeDistribution"] == {"DEBIT": 1}
    assert v1["sampleEventIds"] == ["p1", "p2", "p3"]
    assert v1["ruleVersionReadiness"] == "per_result_verified"


def run(spark, found, **options):
    known = labels(spark, ("a", True, "TRANSFER"), ("b", False, "PAYMENT"))
    return ev.evaluate(known, found, None, ev.EvaluationOptions(**options)).first()


@pytest.mark.parametrize(
    ("versions", "readiness"),
    [
        ((VERSION, VERSION), "per_result_verified"),
        ((None, None), "contract_level_only"),
        ((VERSION, None), "contract_level_with_partial_per_result_coverage"),
    ],
)
def test_version_coverage(spark, versions, readiness):
    found = results(
        spark, ("a", "LOW", 1.0, versions[0], []), ("b", "LOW", 1.0, versions[1], [])
    )
    assert run(spark, found)["ruleVersionReadiness"] == readiness
    if None in versions:
        with pytest.raises(Exception, match="per-result ruleVersion is required"):
            run(spark, found, require_rule_version=True)


def test_missing_results_and_level_fallback(spark):
    found = results(spark, ("run1-a", "HIGH", None, None, None), ("zz", "LOW", None, None, None))
    only = run(spark, found, event_id_prefix="run1")
    assert (only["evaluatedEvents"], only["missingResults"], only["unmatchedResults"]) == (1, 1, 1)
    assert only["truePositive"] == 1 and only["falsePositiveRate"] is None
    counted = run(spark, found, event_id_prefix="run1", include_missing_results=True)
    assert (counted["evaluatedEvents"], counted["trueNegative"]) == (2, 1)
    assert any("true negatives by policy" in w for w in counted["warnings"])
    assert any("falls back" in w for w in counted["warnings"])
    none = run(spark, found)
    assert none["evaluatedEvents"] == 0 and none["accuracy"] is None
    assert any("do not match any label" in w for w in none["warnings"])


def test_result_checks(spark):
    found = results(
        spark,
        ("p-a", "HIGH", 101.0, "other", None),
        ("a", "ODD", 1.0, "", None),
        ("", "LOW", 1.0, VERSION, ["C123456"]),
    )
    got = {tuple(r) for r in check_results(found, "p").collect()}
    assert got == {
        ("a", "RISK_SCORE_RANGE"),
        ("a", "RISK_LEVEL"),
        ("a", "DUPLICATE_RESULT"),
        ("", "BLANK_EVENT_ID"),
        ("", "RAW_IDENTIFIER_VALUE"),
    }
    wrong = {(r["eventId"], r["problem"]) for r in check_rule_version(found).collect()}
    assert wrong == {("p-a", "RULE_VERSION_MISMATCH"), ("a", "BLANK_RULE_VERSION")}
    with pytest.raises(ValueError):
        check_rule_version(found, "rule-v9")
    assert duplicate_keys(found, ["eventId"]).count() == 0


def test_raw_identifier_pattern(spark):
    texts = {
        "C123": True,
        "see M0001.": True,
        "C12": False,
        "AC123": False,
        "C123x": False,
        "éC123": False,
        "_C123": False,
        "(C1234567)": True,
        "C١٢٣": True,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", holds_raw_id(F.col("t")).alias("hit")).collect()
    assert {r["t"]: r["hit"] for r in got} == texts


def test_leaks_in_nested_columns_and_json(spark):
    df = spark.sql(
        "SELECT struct('ok' AS a, array('x C999 y') AS b) AS s, map('token', 'v') AS m, "
        "'x' AS hashSaltSource, 'y' AS mySalt"
    )
    found = scan_leaks(df, forbid_salt=True, forbid_report=True).first()["leaks"]
    assert set(found) == {"RAW_IDENTIFIER_VALUE", "REPORT_FIELD:token", "SALT_FIELD:mySalt"}
    texts = {
        '{"a":{"nameOrig":1}}': ["RAW_IDENTIFIER_FIELD:nameOrig"],
        '{"a":"\\"nameOrig\\": 1"}': [],
        '{"isFraud" : true, "v":["M777"]}': ["LABEL_FIELD:isFraud", "RAW_IDENTIFIER_VALUE"],
        '{"hashSaltSource":"cli"}': [],
        '{"x":{"rawSalt":"s"}}': ["SALT_FIELD"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    leaks = scan_json_leaks(F.col("t"), forbid_labels=True, forbid_salt=True)
    assert {r[0]: r[1] for r in df.select("t", leaks).collect()} == texts


def test_replay_contract(spark):
    types = ("PAYMENT", "TRANSFER", "CASH_OUT")
    parts = Prepared(normalize_paysim(raw_rows(spark, *[{"type": t} for t in types])))
    debit = parts.events.limit(1).withColumns(
        {"eventId": F.lit("p-debit"), "nativeEventType": F.lit("DEBIT")}
    )
    checked = validate_replay(parts.events.unionByName(debit))
    report = replay_report(checked).first()
    assert (report["payloadAccepted"], report["payloadRejected"]) == (3, 1)
    assert report["excludedByType"] == {"DEBIT": 1}
    assert report["acceptedNormalizedTypeDistribution"] == {
        "PAYMENT": 1,
        "TRANSFER": 1,
        "WITHDRAWAL": 1,
    }
    assert report["droppedFields"]["balanceFeatures"] == 3
    sent = to_replay_request(checked.filter("replay_reason IS NULL"), "r1")
    assert all(r["eventId"].startswith("r1-paysim-") for r in sent.collect())


def test_replay_from_json_tells_absent_from_null(spark):
    good = raw_rows(spark, {})
    text = (
        Prepared(normalize_paysim(good))
        .events.drop("row_number")
        .select(F.to_json(F.struct("*")))
        .first()[0]
    )
    cases = {
        text: None,
        text.replace('"currency":"KRW",', ""): "MISSING_FIELD:currency",
        text.replace('"currency":"KRW"', '"currency":null'): "INVALID_CURRENCY",
        text.replace("181.00", "0.00"): "INVALID_AMOUNT",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, value string")
    got = validate_replay(events_from_json(df, PAYSIM_EVENT)).orderBy("i").collect()
    assert [r["replay_reason"] for r in got] == list(cases.values())


def test_sound_dataset_has_no_violations(spark):
    tagged = normalize_paysim(raw_rows(spark, *([{}] * 200), {"step": "x"}))
    parts = Prepared(tagged)
    report = prepare_report(tagged)
    assert validate_dataset(parts.events, parts.labels, parts.rejected, report).count() == 0
    fewer = parts.labels.filter("row_number > 1")
    found = {
        (r["part"], r["code"])
        for r in validate_dataset(parts.events, fewer, parts.rejected, report, "0.001").collect()
    }
    assert found == {
        ("links", "EVENT_WITHOUT_LABEL"),
        ("report", "ACCEPTED_LABELS"),
        ("report", "FRAUD_ROWS"),
        ("report", "REJECT_RATIO"),
    }
    with pytest.raises(Exception, match="EVENT_WITHOUT_LABEL"):
        validate_dataset(parts.events, fewer, parts.rejected, fail_fast=True).collect()


def test_evaluate_refuses_what_breaks_the_contract(spark):
    good = [("p1", True, False, 1, "TRANSFER"), ("p2", False, False, 1, "PAYMENT")]
    label_ddl = "eventId string, isFraud boolean, sourceFlaggedFraud boolean, sourceStep int, sourceType string"
    result_ddl = "eventId string, riskLevel string, riskScore double, ruleVersion string, ruleCodes array<string>"
    version = ev.RULE_VERSION
    fine = [("p1", "HIGH", 85.0, version, ["A"]), ("p2", "LOW", 10.0, None, [])]
    bad = {
        "DUPLICATE_LABEL": (good + good[:1], fine),
        "DUPLICATE_RESULT": (good, fine + fine[:1]),
        "RISK_LEVEL": (good, [("p1", "BOGUS", 85.0, version, [])]),
        "RISK_SCORE_RANGE": (good, [("p1", "HIGH", 150.0, version, [])]),
        "RULE_VERSION_MISMATCH": (good, [("p1", "HIGH", 85.0, "rule-v1", [])]),
        "RAW_IDENTIFIER_VALUE": (good, [("p1", "HIGH", 85.0, version, ["C12345"])]),
    }

    def report(labels, results):
        return ev.evaluate(spark.createDataFrame(labels, label_ddl), spark.createDataFrame(results, result_ddl)).first()

    assert report(good, fine)["truePositive"] == 1
    for problem, (labels, results) in bad.items():
        with pytest.raises(Exception, match=problem):
            report(labels, results)
