"""Queries over simulation data: preparation, replay, quality, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import tables
from checks.base_sql import _EXPECTED, RAW_ID, hmac
from checks.registry import check
from ledgerwatch.functions.digest import pseudonym
from ledgerwatch.config import LOCAL_SALT
from ledgerwatch.operators import evaluation as ev
from ledgerwatch.operators import contract, leaks, quality, replay, reports, sampling, windows
from ledgerwatch.operators.paysim import scoring_columns
from ledgerwatch.operators.results import (
    action_policy as actions_of,
    action_summary as count_actions,
    case_summary as count_cases,
    evidence_summary as summarize_evidence,
    open_cases as cases_of,
)
from ledgerwatch.operators.rules import balance_rules, score_events
from ledgerwatch.operators.typemap import map_native_type
from ledgerwatch.plans.simulation import prepare_and_evaluate
from ledgerwatch.session import ensure_checkpoint_dir
from ledgerwatch.streaming import replay as paced

VERSIONS = ("threshold-v1", "threshold-strict-v1")
OPTIONS = ev.EvaluationOptions(threshold_versions=VERSIONS, event_id_prefix=tables.PREFIX)


@check(
    "paysim_events",
    ("sim_events",),
    """SELECT eventId, userId, accountId, destinationAccountId, eventType, nativeEventType,
         typeSupportLevel, amount, currency, eventTime, traceId, schemaVersion, source,
         sourceStep, oldBalanceOrig, newBalanceOrig, oldBalanceDest, newBalanceDest
       FROM sim_events""",
)
def paysim_events(spark, sf_dir):
    return tables.prepared(spark, sf_dir).events.select(
        "eventId",
        "userId",
        "accountId",
        "destinationAccountId",
        "eventType",
        "nativeEventType",
        "typeSupportLevel",
        "amount",
        "currency",
        "eventTime",
        "traceId",
        "schemaVersion",
        "source",
        "balanceFeatures.*",
    )


@check(
    "paysim_labels",
    ("sim_labels",),
    "SELECT * EXCLUDE (row_number) FROM sim_labels",
)
def paysim_labels(spark, sf_dir):
    return tables.prepared(spark, sf_dir).labels.drop("row_number")


@check(
    "paysim_rejects",
    ("tagged",),
    """SELECT row_number AS rowNumber, reject_reason AS reason, type AS rawType,
         reject_message AS message FROM tagged WHERE problem IS NOT NULL""",
)
def paysim_rejects(spark, sf_dir):
    return tables.prepared(spark, sf_dir).rejected


@check(
    "pseudonyms",
    (),
    f"SELECT c_custkey, {hmac('c_name')} AS pseudonym FROM customer",
)
def pseudonyms(spark, sf_dir):
    customers = tables.read(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey", pseudonym(F.col("c_name"), LOCAL_SALT).alias("pseudonym")
    )


@check(
    "type_mapping",
    ("paysim_raw",),
    f"""SELECT type, {_EXPECTED.replace("nativeEventType", "type")} AS normalized_type,
          CASE WHEN type IN ('CASH_OUT','CASH_IN') THEN 'replay-supported'
            WHEN type IN ('PAYMENT','TRANSFER') THEN 'production-supported'
            ELSE 'unsupported' END AS support_level,
          CASE WHEN type IN ('DEBIT','REFUND') THEN 'excluded' ELSE 'included' END
            AS evaluation_denominator,
          CASE WHEN type IN ('DEBIT','REFUND') THEN 'UNSUPPORTED_NATIVE_TYPE:' || type END
            AS excluded_reason,
          CASE type WHEN 'REFUND' THEN 'unknown' WHEN 'CASH_IN' THEN 'medium'
            WHEN 'CASH_OUT' THEN 'high' WHEN 'DEBIT' THEN 'high' ELSE 'low' END
            AS semantic_loss_risk, count(*) AS n
        FROM paysim_raw GROUP BY type""",
)
def type_mapping(spark, sf_dir):
    mapped = map_native_type(tables.paysim_raw(spark, sf_dir), "type")
    return mapped.groupBy(
        "type",
        "normalized_type",
        "support_level",
        "evaluation_denominator",
        "excluded_reason",
        "semantic_loss_risk",
    ).agg(F.count("*").alias("n"))


@check(
    "prepare_counts",
    ("tagged",),
    """SELECT section, item, count(*) AS n FROM (
         SELECT 'totalRows' AS section, 'rows' AS item FROM tagged
         UNION ALL SELECT 'acceptedRows', 'rows' FROM tagged WHERE problem IS NULL
         UNION ALL SELECT 'rejectedRows', 'rows' FROM tagged WHERE problem IS NOT NULL
         UNION ALL SELECT 'fraudRows', 'rows' FROM tagged WHERE problem IS NULL AND isFraud = '1'
         UNION ALL SELECT 'flaggedFraudRows', 'rows' FROM tagged
           WHERE problem IS NULL AND isFlaggedFraud = '1'
         UNION ALL SELECT 'eventTypeCounts', type FROM tagged WHERE problem IS NULL
         UNION ALL SELECT 'normalizedTypeDistribution', normalized FROM tagged
           WHERE problem IS NULL
         UNION ALL SELECT 'typeSupportLevelDistribution', support FROM tagged
           WHERE problem IS NULL
         UNION ALL SELECT 'excludedByType', 'DEBIT' FROM tagged
           WHERE reject_reason = 'UNSUPPORTED_NATIVE_TYPE:DEBIT'
         UNION ALL SELECT 'rejectReasons', reject_reason FROM tagged WHERE problem IS NOT NULL)
       GROUP BY section, item""",
)
def prepare_counts(spark, sf_dir):
    return reports.prepare_counts(tables.tagged(spark, sf_dir))


@check(
    "prepare_report",
    ("tagged",),
    """SELECT count(*) AS totalRows, count(*) FILTER (WHERE problem IS NULL) AS acceptedRows,
         count(problem) AS rejectedRows,
         count(*) FILTER (WHERE problem IS NULL AND isFraud = '1') AS fraudRows,
         count(*) FILTER (WHERE problem IS NULL AND isFlaggedFraud = '1') AS flaggedFraudRows,
         count(*) FILTER (WHERE problem IS NULL AND type = 'CASH_IN') AS cash_in,
         count(*) FILTER (WHERE problem IS NULL AND type = 'DEBIT') AS debit,
         'HMAC-SHA256' AS hashAlgorithm, 'default-local' AS hashSaltSource
       FROM tagged""",
)
def prepare_report(spark, sf_dir):
    report = reports.prepare_report(tables.tagged(spark, sf_dir))
    return report.select(
        "totalRows",
        "acceptedRows",
        "rejectedRows",
        "fraudRows",
        "flaggedFraudRows",
        F.col("eventTypeCounts")["CASH_IN"].alias("cash_in"),
        F.col("eventTypeCounts")["DEBIT"].alias("debit"),
        "hashAlgorithm",
        "hashSaltSource",
    )


# ---------------------------------------------------------------- replay


@check(
    "replay_validate",
    ("replay_checked",),
    "SELECT row_number, replay_reason FROM replay_checked",
)
def replay_validate(spark, sf_dir):
    checked = replay.validate_replay(tables.replay_input(spark, sf_dir))
    return checked.select("row_number", "replay_reason")


@check(
    "native_mapping",
    ("replay_checked",),
    "SELECT row_number, mapping_reason FROM replay_checked",
)
def native_mapping(spark, sf_dir):
    checked = replay.validate_native_mapping(tables.replay_input(spark, sf_dir))
    return checked.select("row_number", "mapping_reason")


_SPREADS = " ".join(
    f"""UNION ALL SELECT '{scope}{name}', {value} FROM replay_checked
        WHERE {value} IS NOT NULL AND {value} <> '' AND {test}"""
    for scope, test in (
        ("input", "true"),
        ("accepted", "replay_reason IS NULL"),
        ("rejected", "replay_reason IS NOT NULL"),
    )
    for name, value in (
        ("NativeTypeDistribution", "coalesce(nativeEventType, eventType)"),
        ("NormalizedTypeDistribution", "coalesce(normalizedEventType, eventType)"),
        ("TypeSupportLevelDistribution", "typeSupportLevel"),
    )
)


@check(
    "replay_counts",
    ("replay_checked",),
    f"""SELECT section, item, count(*) AS n FROM (
          SELECT 'totalRead' AS section, 'rows' AS item FROM replay_checked
          UNION ALL SELECT 'payloadAccepted', 'rows' FROM replay_checked
            WHERE replay_reason IS NULL
          UNION ALL SELECT 'payloadRejected', 'rows' FROM replay_checked
            WHERE replay_reason IS NOT NULL
          UNION ALL SELECT 'missingMappingMetadata', 'rows' FROM replay_checked
            WHERE coalesce(nativeEventType, normalizedEventType, typeSupportLevel,
                           typeMappingPolicyVersion) IS NULL
          UNION ALL SELECT 'mappingPolicyVersions', typeMappingPolicyVersion FROM replay_checked
            WHERE typeMappingPolicyVersion IS NOT NULL
          UNION ALL SELECT 'excludedByType', split_part(replay_reason, ':', 2)
            FROM replay_checked WHERE replay_reason LIKE 'UNSUPPORTED_NATIVE_TYPE:%'
              OR replay_reason LIKE 'UNSUPPORTED_EVENT_TYPE_FOR_CURRENT_API:%'
          {_SPREADS}) GROUP BY section, item""",
)
def replay_counts(spark, sf_dir):
    return replay.replay_counts(replay.validate_replay(tables.replay_input(spark, sf_dir)))


@check(
    "replay_report",
    ("replay_checked",),
    """SELECT count(*) AS totalRead, count(*) FILTER (WHERE replay_reason IS NULL)
         AS payloadAccepted, count(replay_reason) AS payloadRejected,
         count(*) FILTER (WHERE replay_reason IS NULL AND eventType = 'WITHDRAWAL')
           AS withdrawals,
         count(*) FILTER (WHERE replay_reason IS NULL) AS dropped_source FROM replay_checked""",
)
def replay_report(spark, sf_dir):
    checked = replay.validate_replay(tables.replay_input(spark, sf_dir))
    report = replay.replay_report(checked, prefix=tables.PREFIX)
    return report.select(
        "totalRead",
        "payloadAccepted",
        "payloadRejected",
        F.col("acceptedNormalizedTypeDistribution")["WITHDRAWAL"].alias("withdrawals"),
        F.col("droppedFields")["source"].alias("dropped_source"),
    )


@check(
    "dropped_fields",
    ("replay_checked",),
    """SELECT field, count(*) AS n FROM (
         SELECT unnest(['destinationAccountId', 'schemaVersion', 'source', 'balanceFeatures',
           CASE WHEN nativeEventType IS NOT NULL THEN 'nativeEventType' END,
           CASE WHEN normalizedEventType IS NOT NULL THEN 'normalizedEventType' END,
           CASE WHEN typeSupportLevel IS NOT NULL THEN 'typeSupportLevel' END,
           CASE WHEN typeMappingPolicyVersion IS NOT NULL THEN 'typeMappingPolicyVersion' END])
           AS field FROM replay_checked WHERE replay_reason IS NULL)
       WHERE field IS NOT NULL GROUP BY field""",
)
def dropped_fields(spark, sf_dir):
    checked = replay.validate_replay(tables.replay_input(spark, sf_dir))
    return replay.dropped_field_counts(checked.filter("replay_reason IS NULL"))


@check(
    "replay_requests",
    ("replay_checked",),
    """SELECT 'rp-' || eventId AS eventId, userId, accountId, eventType, amount, currency,
         eventTime, traceId FROM replay_checked WHERE replay_reason IS NULL""",
)
def replay_requests(spark, sf_dir):
    checked = replay.validate_replay(tables.replay_input(spark, sf_dir))
    return replay.to_replay_request(checked.filter("replay_reason IS NULL"), tables.PREFIX)


@check(
    "replay_paced",
    ("replay_checked",),
    """SELECT 'rp-' || eventId AS eventId, batch FROM (
         SELECT *, (row_number() OVER (ORDER BY row_number) - 1) // 5000 AS batch
         FROM replay_checked) WHERE replay_reason IS NULL""",
)
def replay_paced(spark, sf_dir):
    """The written requests of a paced replay, and the micro-batch that sent each."""
    folder = f"{ensure_checkpoint_dir(spark)}/replay_paced-{uuid.uuid4().hex}"
    staged = paced.stage_replay(tables.replay_input(spark, sf_dir), f"{folder}/staged", 5000)
    sent = paced.replay_paced(spark, staged, f"{folder}/sent", f"{folder}/c", tables.PREFIX)
    sent.awaitTermination()
    return spark.read.schema("eventId string, batch long").json(f"{folder}/sent")


@check(
    "replay_failures",
    ("replay_checked",),
    """SELECT row_number AS rowNumber, replay_reason AS reason, eventId FROM replay_checked
       WHERE replay_reason IS NOT NULL ORDER BY row_number LIMIT 50""",
)
def replay_failures(spark, sf_dir):
    return sampling.failures(replay.validate_replay(tables.replay_input(spark, sf_dir)))


@check(
    "strip_prefix",
    ("sim_results",),
    "SELECT eventId, event_id FROM sim_results",
)
def strip_prefix(spark, sf_dir):
    return tables.sim_results(spark, sf_dir).select(
        "eventId",
        replay.strip_event_id_prefix(F.col("eventId"), tables.PREFIX).alias("event_id"),
    )


# ---------------------------------------------------------------- samples


@check(
    "sample_head",
    ("sim_events",),
    """SELECT eventId, row_number() OVER (ORDER BY row_number) AS position
       FROM (SELECT * FROM sim_events ORDER BY row_number LIMIT 100)""",
)
def sample_head(spark, sf_dir):
    return sampling.sample_head(tables.prepared(spark, sf_dir).events, 100)


@check(
    "sample_balanced",
    ("sim_labels",),
    """SELECT eventId, row_number() OVER (ORDER BY isFraud DESC, row_number) AS position
       FROM (SELECT * FROM sim_labels ORDER BY isFraud DESC, row_number LIMIT 1000)""",
)
def sample_balanced(spark, sf_dir):
    return sampling.sample_balanced(tables.prepared(spark, sf_dir).labels, 1000)


@check(
    "select_sample",
    ("sim_events", "sim_labels"),
    """SELECT eventId, amount, userId, row_number() OVER (ORDER BY isFraud DESC, row_number)
         AS position
       FROM (SELECT e.*, l.isFraud FROM sim_events e JOIN sim_labels l USING (eventId)
             ORDER BY l.isFraud DESC, e.row_number LIMIT 300)""",
)
def select_sample(spark, sf_dir):
    parts = tables.prepared(spark, sf_dir)
    sample = sampling.sample_balanced(parts.labels, 300)
    return sampling.select_sample(parts.events, sample).select(
        "eventId", "amount", "userId", "position"
    )


@check(
    "limit_rows",
    ("paysim_raw",),
    "SELECT row_number, type, amount FROM paysim_raw WHERE row_number <= 777",
)
def limit_rows(spark, sf_dir):
    return sampling.limit_rows(tables.paysim_raw(spark, sf_dir), 777).select(
        "row_number", "type", "amount"
    )


@check(
    "class_rank",
    ("sim_labels",),
    """SELECT eventId, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY row_number)
         AS class_rank FROM sim_labels""",
)
def class_rank(spark, sf_dir):
    labels = tables.prepared(spark, sf_dir).labels
    return windows.class_rank(labels, "isFraud", "row_number", bucket_width=1000).select(
        "eventId", "isFraud", "class_rank"
    )


# ---------------------------------------------------------------- quality


@check(
    "referential_check",
    ("ds_events", "ds_labels"),
    """SELECT coalesce(e.eventId, l.eventId) AS eventId,
         CASE WHEN e.eventId IS NULL THEN 'LABEL_WITHOUT_EVENT' ELSE 'EVENT_WITHOUT_LABEL' END
           AS problem
       FROM (SELECT DISTINCT eventId FROM ds_events) e
       FULL JOIN (SELECT DISTINCT eventId FROM ds_labels) l ON e.eventId = l.eventId
       WHERE e.eventId IS NULL OR l.eventId IS NULL""",
)
def referential_check(spark, sf_dir):
    events, labels, _ = tables.dataset(spark, sf_dir)
    return quality.referential_check(events, labels)


@check(
    "duplicate_keys",
    ("ds_events",),
    """SELECT eventId, count(*) AS n FROM ds_events GROUP BY eventId HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    events, _, _ = tables.dataset(spark, sf_dir)
    return quality.duplicate_keys(events, ["eventId"])


_LEAKS = f"""concat_ws(',', CASE WHEN regexp_matches(userId, '{RAW_ID}')
    THEN 'RAW_IDENTIFIER_VALUE' END, CASE WHEN labelled THEN 'LABEL_FIELD:isFraud' END,
    CASE WHEN named THEN 'RAW_IDENTIFIER_FIELD:nameOrig' END)"""


@check(
    "leak_scan",
    ("ds_events",),
    f"SELECT row_number, {_LEAKS} AS leaks FROM ds_events WHERE {_LEAKS} <> ''",
)
def leak_scan(spark, sf_dir):
    events, _, _ = tables.dataset(spark, sf_dir)
    found = leaks.scan_leaks(events, forbid_labels=True, skip=("row_number",))
    return found.filter(F.size("leaks") > 0).select("row_number", "leaks")


@check(
    "leak_scan_text",
    (),
    f"""SELECT 'documents' AS source_table, CAST(doc_id AS BIGINT) AS id FROM documents
          WHERE regexp_matches(text, '{RAW_ID}')
        UNION ALL SELECT 'pages', page_id FROM pages WHERE regexp_matches(html, '{RAW_ID}')
        UNION ALL SELECT 'conversations', conv_id * 1000 + turn FROM conversations
          WHERE regexp_matches(text, '{RAW_ID}')
        UNION ALL SELECT 'customer', c_custkey FROM customer
          WHERE regexp_matches('id C' || c_custkey || ',', '{RAW_ID}')""",
)
def leak_scan_text(spark, sf_dir):
    def hits(name, row_id, text):
        table = tables.read(spark, sf_dir, name)
        return table.filter(leaks.holds_raw_id(text)).select(
            F.lit(name).alias("source_table"), row_id.cast("long").alias("id")
        )

    customer_text = F.concat(F.lit("id C"), F.col("c_custkey").cast("string"), F.lit(","))
    return (
        hits("documents", F.col("doc_id"), F.col("text"))
        .unionByName(hits("pages", F.col("page_id"), F.col("html")))
        .unionByName(
            hits("conversations", F.col("conv_id") * 1000 + F.col("turn"), F.col("text"))
        )
        .unionByName(hits("customer", F.col("c_custkey"), customer_text))
    )


@check(
    "leak_scan_json",
    ("replay_input",),
    f"""SELECT row_number, concat_ws(',',
          CASE WHEN named THEN 'RAW_IDENTIFIER_FIELD:nameOrig' END,
          CASE WHEN labelled THEN 'LABEL_FIELD:isFraud' END,
          CASE WHEN regexp_matches(userId, '{RAW_ID}') THEN 'RAW_IDENTIFIER_VALUE' END) AS leaks
        FROM replay_input""",
)
def leak_scan_json(spark, sf_dir):
    events = tables.replay_input(spark, sf_dir)
    payload = F.to_json(F.struct(*[c for c in events.columns if c != "row_number"]))
    return events.select(
        "row_number", leaks.scan_json_leaks(payload, forbid_labels=True).alias("leaks")
    )


@check(
    "leak_scan_nested",
    ("replay_input",),
    """SELECT row_number, concat_ws(',',
          CASE WHEN r % 5 = 0 THEN 'RAW_IDENTIFIER_FIELD:nameOrig' END,
          CASE WHEN r % 3 = 0 THEN 'LABEL_FIELD:isFraud' END,
          CASE WHEN r % 7 = 0 THEN 'SALT_FIELD' END,
          CASE WHEN r % 11 = 0 OR r % 13 = 0 OR r % 17 = 0 THEN 'RAW_IDENTIFIER_VALUE' END)
          AS leaks, r % 3 = 0 AS labelled, r % 7 = 0 AS salted,
          r % 11 = 0 OR r % 13 = 0 AS named
        FROM (SELECT row_number, row_number AS r FROM replay_input)""",
)
def leak_scan_nested(spark, sf_dir):
    """Leaks in arrays, maps and escaped JSON: labels in an array of structs, salts and
    identifiers in map keys and values, and the same written with escapes."""
    r = F.col("row_number")
    events = tables.replay_input(spark, sf_dir)
    text = lambda test, value, other: F.when(test, F.lit(value)).otherwise(F.lit(other))
    payload = F.concat(
        F.lit('{"list":[{"'),
        text(r % 3 == 0, "isFr\\u0061ud", "kind"),
        F.lit('":true},{"deep":{"'),
        text(r % 5 == 0, "name\\u004frig", "name"),
        F.lit('":"a\\"b:"}}],"'),
        text(r % 7 == 0, "my\\u0053altX", "hashSaltSource"),
        F.lit('":"'),
        text(r % 11 == 0, "x\\nC1234567890", "nC12345x"),
        F.lit('","'),
        text(r % 13 == 0, "by C123456", "by"),
        F.lit('":"'),
        text(r % 17 == 0, "\\u00431234567", "D1234567"),
        F.lit('"}'),
    )
    found = leaks.scan_json_leaks(payload, forbid_labels=True, forbid_salt=True)
    labelled = F.array(F.struct(F.when(r % 3 == 0, F.lit(True)).alias("isFraud")))
    notes = F.create_map(
        text(r % 7 == 0, "mySaltX", "hashSaltSource"),
        text(r % 11 == 0, "x\nC1234567890", "none"),
        text(r % 13 == 0, "by C123456", "by"),
        F.lit("none"),
    )
    typed = events.select(
        "row_number", found.alias("json"), F.array(labelled).alias("lists"), notes.alias("notes")
    )
    scanned = leaks.scan_leaks(
        typed, forbid_labels=True, forbid_salt=True, skip=("row_number", "json")
    )
    has = lambda code: F.array_contains("leaks", code)
    return scanned.select(
        "row_number",
        F.col("json").alias("leaks"),
        has("LABEL_FIELD:isFraud").alias("labelled"),
        has("SALT_FIELD").alias("salted"),
        has("RAW_IDENTIFIER_VALUE").alias("named"),
    )


_EVENT_CODES = {
    "MISSING_FIELD:traceId": "traceId IS NULL",
    "RAW_IDENTIFIER_VALUE": f"regexp_matches(userId, '{RAW_ID}')",
    "LABEL_FIELD:isFraud": "labelled",
    "RAW_IDENTIFIER_FIELD:nameOrig": "named",
    "BLANK:eventId": "eventId = ''",
    "BLANK:traceId": "traceId = ''",
    "HASH_FORMAT:userId": "NOT regexp_matches(userId, '^U-[0-9a-f]{16}$')",
    "EVENT_TYPE": "eventType NOT IN ('PAYMENT','TRANSFER','WITHDRAWAL','DEPOSIT')",
    "CURRENCY": "currency <> 'KRW'",
    "RECEIVED_AT_PRESENT": "received",
    "EVENT_TIME": "eventTime = ''",
}


@check(
    "dataset_violations",
    ("ds_events", "ds_labels", "tagged"),
    "SELECT part, code, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT 'events' AS part, '{code}' AS code FROM ds_events WHERE {test}"
        for code, test in _EVENT_CODES.items()
    )
    + """ UNION ALL SELECT 'labels', 'SOURCE_TYPE' FROM ds_labels WHERE sourceType = 'REFUND'
      UNION ALL SELECT 'rejected', 'REJECT_REASON' FROM tagged
        WHERE problem IS NOT NULL AND row_number % 193 = 0
      UNION ALL SELECT 'events', 'DUPLICATE:eventId' FROM ds_events
        GROUP BY eventId HAVING count(*) > 1
      UNION ALL SELECT 'events', 'DUPLICATE:traceId' FROM ds_events
        WHERE traceId IS NOT NULL GROUP BY traceId HAVING count(*) > 1
      UNION ALL SELECT 'labels', 'DUPLICATE:eventId' FROM ds_labels
        GROUP BY eventId HAVING count(*) > 1
      UNION ALL SELECT 'links', CASE WHEN e.eventId IS NULL THEN 'LABEL_WITHOUT_EVENT'
          ELSE 'EVENT_WITHOUT_LABEL' END
        FROM (SELECT DISTINCT eventId FROM ds_events) e
        FULL JOIN (SELECT DISTINCT eventId FROM ds_labels) l ON e.eventId = l.eventId
        WHERE e.eventId IS NULL OR l.eventId IS NULL) GROUP BY part, code""",
)
def dataset_violations(spark, sf_dir):
    return quality.validate_dataset(*tables.dataset(spark, sf_dir))


@check(
    "validation_summary",
    ("tagged",),
    """SELECT check_name, actual, ok FROM (
         SELECT count(*) AS total, count(*) FILTER (WHERE problem IS NULL) AS accepted,
           count(problem) AS rejected FROM tagged) t,
       LATERAL (VALUES ('TOTAL_ROWS', CAST(total AS VARCHAR), true),
                       ('REJECTED_ROWS', CAST(rejected AS VARCHAR), true),
                       ('ACCEPTED_EVENTS', CAST(accepted AS VARCHAR), true),
                       ('REJECT_RATIO', CAST(rejected > 0.01 * total AS VARCHAR),
                        rejected <= 0.01 * total)) v(check_name, actual, ok)""",
)
def validation_summary(spark, sf_dir):
    marked = tables.tagged(spark, sf_dir)
    parts = tables.prepared(spark, sf_dir)
    found = quality.validation_summary(
        parts.events, parts.labels, parts.rejected, reports.prepare_report(marked)
    )
    wanted = ("TOTAL_ROWS", "REJECTED_ROWS", "ACCEPTED_EVENTS", "REJECT_RATIO")
    over = (F.col("actual").cast("double") > 0.01).cast("string")
    return found.filter(F.col("check_name").isin(*wanted)).select(
        "check_name",
        F.when(F.col("check_name") == "REJECT_RATIO", over)
        .otherwise(F.col("actual"))
        .alias("actual"),
        "ok",
    )


@check(
    "validation_checks",
    ("tagged", "sim_events", "sim_labels"),
    """SELECT check_name, expected, actual, expected = actual AS ok FROM (
         WITH c AS (SELECT
           (SELECT count(*) FROM tagged) AS total, (SELECT count(problem) FROM tagged) AS rejected,
           (SELECT count(*) FROM sim_events) AS events, (SELECT count(*) FROM sim_labels) AS labels,
           (SELECT count(*) FILTER (isFraud) FROM sim_labels) AS fraud,
           (SELECT count(*) FILTER (sourceFlaggedFraud) FROM sim_labels) AS flagged),
         types AS (
           SELECT t, (SELECT count(*) FROM sim_events WHERE nativeEventType = t) AS n
           FROM (SELECT unnest(['CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER']) AS t))
         SELECT 'TOTAL_NOT_EMPTY' AS check_name, 'true' AS expected,
           CASE WHEN total > 0 THEN 'true' ELSE 'false' END AS actual FROM c UNION ALL
         SELECT v.name, v.e::VARCHAR, v.a::VARCHAR FROM c, LATERAL (VALUES
           ('ACCEPTED_EVENTS', total - rejected, events),
           ('ACCEPTED_LABELS', total - rejected, labels),
           ('REJECTED_ROWS', rejected, total - events),
           ('TOTAL_ROWS', total, events + rejected),
           ('FRAUD_ROWS', fraud, fraud), ('FLAGGED_ROWS', flagged, flagged),
           ('TYPE_SUM', total - rejected, events)) v(name, e, a) UNION ALL
         SELECT 'TYPE_COUNT:' || t, n::VARCHAR, n::VARCHAR FROM types)""",
)
def validation_checks(spark, sf_dir):
    """All checks of the summary that compare counts, with both sides."""
    parts = tables.prepared(spark, sf_dir)
    report = reports.prepare_report(tables.tagged(spark, sf_dir))
    found = quality.validation_summary(parts.events, parts.labels, parts.rejected, report)
    return found.filter(F.col("check_name") != "REJECT_RATIO")


@check(
    "check_results",
    ("sim_results", "kept_results"),
    """SELECT event_id, 'RISK_SCORE_RANGE' AS problem FROM sim_results
       WHERE risk_score * 2 > 100 UNION ALL
       SELECT event_id, 'DUPLICATE_RESULT' FROM kept_results k
       JOIN sim_results r ON k.eventId = r.event_id WHERE k.risk_level = 'CRITICAL'""",
)
def check_results(spark, sf_dir):
    """Exported results with doubled scores; critical ones exported a second time."""
    exported = tables.sim_results(spark, sf_dir)
    doubled = (F.col("riskScore") * 2).cast("double")
    own = ~F.col("eventId").startswith("other-")
    again = (F.col("riskLevel") == "CRITICAL") & own
    # Both copies from one row: a second read behind a filter would plan the scoring twice.
    scores = F.when(again, F.array(doubled, F.lit(None).cast("double"))).otherwise(
        F.array(doubled)
    )
    twice = exported.select(
        *[c for c in exported.columns if c != "riskScore"],
        F.explode_outer(scores).alias("riskScore"),
    )
    return quality.check_results(twice, tables.PREFIX)


@check(
    "rule_version_check",
    ("sim_results",),
    """SELECT eventId, CASE WHEN risk_level = 'LOW' THEN 'BLANK_RULE_VERSION'
         ELSE 'RULE_VERSION_MISMATCH' END AS problem
       FROM sim_results WHERE rule_version IS NOT NULL AND risk_level IN ('LOW', 'HIGH')""",
)
def rule_version_check(spark, sf_dir):
    level = F.col("riskLevel")
    given = F.col("ruleVersion")
    exported = tables.sim_results(spark, sf_dir).withColumn(
        "ruleVersion",
        F.when(given.isNotNull() & (level == "LOW"), F.lit(""))
        .when(given.isNotNull() & (level == "HIGH"), F.lit("rule-v1"))
        .otherwise(given),
    )
    return quality.check_rule_version(exported).select("eventId", "problem")


# ---------------------------------------------------------------- evaluation


def _joined(spark, sf_dir):
    found = ev.normalize_results(tables.sim_results(spark, sf_dir), tables.PREFIX)
    ids = ev.replay_rejected_ids(tables.sim_rejects(spark, sf_dir), tables.PREFIX)
    return ev.join_labels_results(tables.sim_labels(spark, sf_dir), found, ids)


def _cube(spark, sf_dir):
    return ev.evaluation_cube(_joined(spark, sf_dir), VERSIONS)


@check(
    "normalize_rule_codes",
    ("sim_results",),
    "SELECT eventId, rule_codes FROM sim_results",
)
def normalize_rule_codes(spark, sf_dir):
    coded = ev.normalize_rule_codes(tables.sim_results(spark, sf_dir))
    return coded.select("eventId", "rule_codes")


@check(
    "label_result_join",
    ("joined",),
    """SELECT event_id, has_label, has_result, excluded, is_fraud, risk_level, risk_score
       FROM joined""",
)
def label_result_join(spark, sf_dir):
    return _joined(spark, sf_dir).select(
        "event_id",
        "has_label",
        "has_result",
        "excluded",
        "is_fraud",
        "risk_level",
        "risk_score",
    )


@check(
    "matched_results",
    ("sim_results", "sim_labels"),
    """SELECT event_id, risk_level FROM sim_results
       WHERE event_id IN (SELECT eventId FROM sim_labels)""",
)
def matched_results(spark, sf_dir):
    found = ev.normalize_results(tables.sim_results(spark, sf_dir), tables.PREFIX)
    return ev.matched_results(tables.sim_labels(spark, sf_dir), found).select(
        "event_id", "risk_level"
    )


@check(
    "unmatched_results",
    ("sim_results", "sim_labels"),
    """SELECT event_id, risk_level FROM sim_results
       WHERE event_id NOT IN (SELECT eventId FROM sim_labels)""",
)
def unmatched_results(spark, sf_dir):
    found = ev.normalize_results(tables.sim_results(spark, sf_dir), tables.PREFIX)
    return ev.unmatched_results(tables.sim_labels(spark, sf_dir), found).select(
        "event_id", "risk_level"
    )


@check(
    "replay_excluded",
    ("sim_labels", "sim_rejects"),
    """SELECT eventId, isFraud FROM sim_labels WHERE eventId NOT IN
         (SELECT event_id FROM sim_rejects WHERE reason NOT LIKE 'HTTP%')""",
)
def replay_excluded(spark, sf_dir):
    kept = ev.exclude_replay_rejected(
        tables.sim_labels(spark, sf_dir), tables.sim_rejects(spark, sf_dir), tables.PREFIX
    )
    return kept.select("eventId", "isFraud")


@check(
    "predictions",
    ("decided",),
    """SELECT event_id, version AS threshold_version, predicted, action FROM decided
       WHERE has_result""",
)
def predictions(spark, sf_dir):
    decided = ev.with_decisions(_joined(spark, sf_dir), VERSIONS)
    return decided.filter("has_result").select(
        "event_id",
        F.col("policy.version").alias("threshold_version"),
        "predicted",
        "action",
    )


_MATRIX_COLUMNS = (
    "SELECT * EXCLUDE (max_review, max_block) FROM "
)


@check("confusion_matrix", ("matrix",), _MATRIX_COLUMNS + "matrix")
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_cube(spark, sf_dir))


@check("confusion_matrix_with_missing", ("matrix_missing",), _MATRIX_COLUMNS + "matrix_missing")
def confusion_matrix_with_missing(spark, sf_dir):
    return ev.confusion_matrix(_cube(spark, sf_dir), include_missing=True)


@check(
    "metrics",
    ("summary",),
    """SELECT threshold_version, precision, recall, f1Score, falsePositiveRate,
         falseNegativeRate, accuracy FROM summary""",
)
def metrics(spark, sf_dir):
    rated = ev.classification_metrics(ev.confusion_matrix(_cube(spark, sf_dir)))
    return rated.select(
        "threshold_version",
        "precision",
        "recall",
        "f1Score",
        "falsePositiveRate",
        "falseNegativeRate",
        "accuracy",
    )


_SCORED = "has_label AND NOT excluded AND has_result"
_ZERO = "(VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) l(risk_level)"


@check(
    "risk_distribution",
    ("decided",),
    f"""SELECT version AS threshold_version, distribution, item, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT version, 'riskLevelCounts' AS distribution, risk_level AS item, 1 AS n
            FROM decided WHERE {_SCORED}
          UNION ALL SELECT version, 'fraudByRiskLevel', risk_level, 1 FROM decided
            WHERE {_SCORED} AND is_fraud
          UNION ALL SELECT version, 'nonFraudByRiskLevel', risk_level, 1 FROM decided
            WHERE {_SCORED} AND NOT is_fraud
          UNION ALL SELECT DISTINCT version, d, l.risk_level, 0 FROM decided, {_ZERO},
            (VALUES ('riskLevelCounts'), ('fraudByRiskLevel'), ('nonFraudByRiskLevel')) v(d)
          UNION ALL SELECT version, 'actionDecisionDistribution', action, 1 FROM decided
            WHERE {_SCORED}
          UNION ALL SELECT version, 'ruleVersionDistribution', rule_version, 1 FROM decided
            WHERE {_SCORED} AND rule_version IS NOT NULL
          UNION ALL SELECT version, 'evaluatedNativeTypeDistribution', source_type, 1
            FROM decided WHERE {_SCORED}
          UNION ALL SELECT version, 'evaluatedNormalizedTypeDistribution', normalized_type, 1
            FROM decided WHERE {_SCORED}
          UNION ALL SELECT version, 'denominatorExcludedNativeTypeDistribution', source_type, 1
            FROM decided WHERE excluded
          UNION ALL SELECT version, 'ruleCodeCounts', unnest(string_split(rule_codes, ',')), 1
            FROM decided WHERE {_SCORED} AND rule_codes <> '')
        GROUP BY version, distribution, item""",
)
def risk_distribution(spark, sf_dir):
    return ev.distributions(_cube(spark, sf_dir))


@check(
    "rule_version_coverage",
    ("summary",),
    """SELECT threshold_version, resultsWithRuleVersion, resultsWithoutRuleVersion,
         ruleVersionCoverageRate, CASE WHEN resultsWithRuleVersion = 0 THEN 'contract_level_only'
           WHEN resultsWithoutRuleVersion > 0
             THEN 'contract_level_with_partial_per_result_coverage'
           ELSE 'per_result_verified' END AS ruleVersionReadiness FROM summary""",
)
def rule_version_coverage(spark, sf_dir):
    covered = ev.rule_version_coverage(ev.confusion_matrix(_cube(spark, sf_dir)))
    return covered.select(
        "threshold_version",
        "resultsWithRuleVersion",
        "resultsWithoutRuleVersion",
        "ruleVersionCoverageRate",
        "ruleVersionReadiness",
    )


@check(
    "risk_score_coverage",
    ("summary",),
    """SELECT threshold_version, resultsWithRiskScore, resultsWithoutRiskScore,
         riskScoreCoverageRate, CASE WHEN resultsWithoutRiskScore = 0
           THEN 'full_risk_score_coverage' ELSE 'partial_without_full_risk_score_coverage' END
           AS thresholdRegressionReliability FROM summary""",
)
def risk_score_coverage(spark, sf_dir):
    covered = ev.risk_score_coverage(ev.confusion_matrix(_cube(spark, sf_dir)))
    return covered.select(
        "threshold_version",
        "resultsWithRiskScore",
        "resultsWithoutRiskScore",
        "riskScoreCoverageRate",
        "thresholdRegressionReliability",
    )


@check(
    "workload",
    ("summary",),
    """SELECT threshold_version, reviewCandidateEvents, reviewCandidateRate,
         blockedCandidateEvents, blockedCandidateRate,
         coalesce(reviewCandidateRate <= max_review, true) AS reviewRateWithinBudget,
         coalesce(blockedCandidateRate <= max_block, true) AS blockedRateWithinBudget
       FROM summary""",
)
def workload(spark, sf_dir):
    loaded = ev.workload_summary(ev.confusion_matrix(_cube(spark, sf_dir)), VERSIONS)
    return loaded.select(
        "threshold_version",
        "reviewCandidateEvents",
        "reviewCandidateRate",
        "blockedCandidateEvents",
        "blockedCandidateRate",
        "reviewRateWithinBudget",
        "blockedRateWithinBudget",
    )


@check(
    "warnings",
    ("summary",),
    f"""SELECT threshold_version, unnest(list_filter([
          CASE WHEN truePositive + falsePositive = 0 THEN '{ev.WARNINGS["no_positive"]}' END,
          CASE WHEN evaluatedEvents = 0 THEN '{ev.WARNINGS["no_events"]}' END,
          CASE WHEN missingResults > 0 THEN '{ev.WARNINGS["missing_excluded"]}' END,
          CASE WHEN totalResults > 0 AND matchedResults = 0 THEN '{ev.WARNINGS["no_match"]}'
            WHEN unmatchedResults > 0 THEN '{ev.WARNINGS["some_unmatched"]}' END,
          CASE WHEN resultsWithoutRiskScore > 0 THEN '{ev.WARNINGS["no_score"]}' END,
          CASE WHEN resultsWithoutRuleVersion > 0 THEN '{ev.WARNINGS["no_version"]}' END,
          CASE WHEN reviewCandidateRate > max_review THEN '{ev.WARNINGS["review_budget"]}' END,
          CASE WHEN blockedCandidateRate > max_block THEN '{ev.WARNINGS["block_budget"]}' END],
          lambda x: x IS NOT NULL)) AS warning FROM summary""",
)
def warnings(spark, sf_dir):
    summary = ev.evaluation_summary(_cube(spark, sf_dir), OPTIONS)
    return summary.select("threshold_version", F.explode("warnings").alias("warning"))


@check(
    "threshold_regression",
    ("summary",),
    """SELECT threshold_version, evaluatedEvents, truePositive, falsePositive, trueNegative,
         falseNegative, recall, reviewCandidateEvents, blockedCandidateEvents FROM summary""",
)
def threshold_regression(spark, sf_dir):
    compared = ev.threshold_regression(_joined(spark, sf_dir), VERSIONS)
    return compared.select(
        "threshold_version",
        "evaluatedEvents",
        "truePositive",
        "falsePositive",
        "trueNegative",
        "falseNegative",
        "recall",
        "reviewCandidateEvents",
        "blockedCandidateEvents",
    )


@check(
    "evaluate_violations",
    ("sim_labels", "sim_results"),
    """SELECT 'labels' AS part, eventId AS event_id, 'DUPLICATE_LABEL' AS problem
       FROM sim_labels WHERE n % 41 = 0
       UNION ALL SELECT 'labels', eventId, 'MISSING_FIELD:isFraud' FROM sim_labels
         WHERE n % 61 = 0
       UNION ALL SELECT 'labels', eventId, 'MISSING_FIELD:isFraud' FROM sim_labels
         WHERE n % 61 = 0 AND n % 41 = 0
       UNION ALL SELECT 'results', event_id, 'RISK_LEVEL' FROM sim_results WHERE n % 43 = 0
       UNION ALL SELECT 'results', event_id, 'RISK_SCORE_RANGE' FROM sim_results
         WHERE n % 47 = 0
       UNION ALL SELECT 'results', event_id, 'RULE_VERSION_MISMATCH' FROM sim_results
         WHERE n % 53 = 0""".replace(
        "FROM sim_labels", "FROM (SELECT *, row_number AS n FROM sim_labels)"
    ).replace(
        "FROM sim_results",
        "FROM (SELECT *, CAST(split_part(event_id, '-', -1) AS BIGINT) AS n FROM sim_results)",
    ),
)
def evaluate_violations(spark, sf_dir):
    """What an evaluation refuses: labels given twice or without verdict, results of unknown
    level, with a score above 100, or of another rule version."""
    n = F.col("row_number")
    labels = tables.sim_labels(spark, sf_dir).withColumn(
        "isFraud", F.when(n % 61 != 0, F.col("isFraud"))
    )
    labels = labels.unionByName(labels.filter(n % 41 == 0))
    k = F.substring_index("eventId", "-", -1).cast("long")
    results = tables.sim_results(spark, sf_dir).withColumns(
        {
            "riskLevel": F.when(k % 43 == 0, F.lit("BOGUS")).otherwise(F.col("riskLevel")),
            "riskScore": F.when(k % 47 == 0, F.lit(150.0)).otherwise(F.col("riskScore")),
            "ruleVersion": F.when(k % 53 == 0, F.lit("rule-v1")).otherwise(F.col("ruleVersion")),
        }
    )
    return ev.input_violations(labels, results, OPTIONS)


@check(
    "evaluate",
    ("summary", "decided"),
    f"""SELECT threshold_version AS thresholdVersion, totalLabels, totalResults, matchedResults,
          evaluatedEvents, excludedReplayRejected, missingResults, precision, recall, f1Score,
          (SELECT count(*) FROM decided d WHERE d.version = threshold_version AND {_SCORED}
             AND risk_level = 'HIGH') AS high_results,
          (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT DISTINCT event_id
             FROM decided WHERE {_SCORED} ORDER BY event_id LIMIT 10)) AS sampleEventIds
        FROM summary""",
)
def evaluate(spark, sf_dir):
    report = ev.evaluate(
        tables.sim_labels(spark, sf_dir),
        tables.sim_results(spark, sf_dir),
        tables.sim_rejects(spark, sf_dir),
        OPTIONS,
    )
    return report.select(
        "thresholdVersion",
        "totalLabels",
        "totalResults",
        "matchedResults",
        "evaluatedEvents",
        "excludedReplayRejected",
        "missingResults",
        "precision",
        "recall",
        "f1Score",
        F.col("riskLevelCounts")["HIGH"].alias("high_results"),
        "sampleEventIds",
    )


def _contract_report(spark, sf_dir):
    report = ev.evaluate(
        tables.sim_labels(spark, sf_dir),
        tables.sim_results(spark, sf_dir),
        tables.sim_rejects(spark, sf_dir),
        OPTIONS,
    )
    return contract.contract_report(report, OPTIONS)


@check(
    "report_contract",
    ("summary",),
    """SELECT threshold_version AS thresholdVersion, '2026-06-v2-phase12' AS reportSchemaVersion,
         evaluatedEvents AS totalEvents, truePositive + falseNegative AS fraudLabeledEvents,
         truePositive + falsePositive AS detectedFraudEvents,
         falsePositive + falseNegative AS misclassifiedEvents,
         excludedReplayRejected AS evaluationExcludedRecords, max_review AS review_budget,
         coalesce(blockedCandidateRate <= max_block, true) AS blocked_within, precision,
         ruleVersionCoverageRate AS rule_coverage, true AS sound FROM summary""",
)
def report_contract(spark, sf_dir):
    """Fields of the report's contract, and whether the report keeps it."""
    report = _contract_report(spark, sf_dir)
    broken = contract.report_violations(report).select("thresholdVersion").distinct()
    work = F.col("operatorWorkloadSummary")
    return report.join(broken.withColumn("broken", F.lit(True)), "thresholdVersion", "left").select(
        "thresholdVersion",
        "reportSchemaVersion",
        "totalEvents",
        "fraudLabeledEvents",
        "detectedFraudEvents",
        "misclassifiedEvents",
        "evaluationExcludedRecords",
        work["workloadBudget"]["maxReviewCandidateRateCandidate"].alias("review_budget"),
        work["budgetStatus"]["blockedCandidateRateWithinBudget"].alias("blocked_within"),
        F.col("metrics")["precision"].alias("precision"),
        F.col("ruleVersionCoverage")["coverageRate"].alias("rule_coverage"),
        F.col("broken").isNull().alias("sound"),
    )


@check(
    "report_violations",
    ("summary",),
    """SELECT threshold_version AS thresholdVersion, unnest(CASE threshold_version
         WHEN 'threshold-v1' THEN ['COUNT:confusionMatrix', 'COUNT:truePositiveEvents',
           'COUNT:fraudLabeledEvents', 'COUNT:evaluatedFraudLabeledEvents',
           'COUNT:detectedFraudEvents', 'RATE:precision', 'RATE:recall', 'RATE:f1Score',
           'RATE:falseNegativeRate', 'RATE:accuracy']
         ELSE ['RAW_IDENTIFIER', 'COUNT:failedRecords', 'FORBIDDEN_TEXT:token'] END) AS problem
       FROM summary""",
)
def report_violations(spark, sf_dir):
    """The two reports with faults: one matrix with more hits than events, one with failed
    records and an account in its warnings."""
    report = _contract_report(spark, sf_dir)
    first = F.col("thresholdVersion") == "threshold-v1"
    more = F.col("confusionMatrix")["truePositive"] + 1 + F.col("totalEvents")
    matrix = F.col("confusionMatrix").withField("truePositive", more)
    leak = F.concat("warnings", F.array(F.lit("token of C1234567 seen")))
    faulty = report.withColumns(
        {
            "confusionMatrix": F.when(first, matrix).otherwise(F.col("confusionMatrix")),
            "failedRecords": F.when(first, F.col("failedRecords")).otherwise(F.lit(3).cast("bigint")),
            "warnings": F.when(first, F.col("warnings")).otherwise(leak),
        }
    )
    return contract.report_violations(faulty)


@check(
    "evidence_ids",
    ("joined",),
    f"SELECT event_id FROM joined WHERE {_SCORED} ORDER BY event_id LIMIT 10",
)
def evidence_ids(spark, sf_dir):
    return ev.evidence_ids(_joined(spark, sf_dir))


@check(
    "prepare_and_evaluate",
    ("balance_scored", "sim_labels"),
    """SELECT count(*) AS totalLabels,
         count(*) FILTER (WHERE CAST(amount AS DECIMAL(18,2)) > 0) AS evaluatedEvents,
         count(*) FILTER (WHERE CAST(amount AS DECIMAL(18,2)) = 0) AS excludedReplayRejected,
         count(*) FILTER (WHERE isFraud AND risk_score >= 50
           AND CAST(amount AS DECIMAL(18,2)) > 0) AS truePositive,
         count(*) FILTER (WHERE NOT isFraud AND risk_score >= 50
           AND CAST(amount AS DECIMAL(18,2)) > 0) AS falsePositive
       FROM balance_scored JOIN sim_labels USING (eventId)""",
)
def evaluated_chain(spark, sf_dir):
    report = prepare_and_evaluate(tables.paysim_raw(spark, sf_dir))
    return report.select(
        "totalLabels",
        "evaluatedEvents",
        "excludedReplayRejected",
        "truePositive",
        "falsePositive",
    )


# ---------------------------------------------------------------- second-generation rules


def _balance_scored(spark, sf_dir):
    events = tables.prepared(spark, sf_dir).events
    return score_events(scoring_columns(events), balance_rules())


@check(
    "balance_rules",
    ("balance_scored",),
    """SELECT eventId AS event_id, risk_score, risk_level, rule_codes AS matched_rules
       FROM balance_scored""",
)
def balance_rule_scores(spark, sf_dir):
    return _balance_scored(spark, sf_dir).select(
        "event_id", "risk_score", "risk_level", "matched_rules"
    )


_POLICY = """(VALUES ('LOW', 'NO_ACTION', 'APPLIED'),
  ('MEDIUM', 'REVIEW_CANDIDATE', 'PENDING'),
  ('HIGH', 'HOLD_TRANSACTION_CANDIDATE', 'REQUIRES_MANUAL_REVIEW'),
  ('CRITICAL', 'BLOCK_TRANSACTION_CANDIDATE', 'REQUIRES_MANUAL_APPROVAL'),
  ('CRITICAL', 'ACCOUNT_RISK_FLAG', 'PENDING')) p(level, action_type, action_status)"""


@check(
    "action_policy",
    ("balance_scored",),
    f"""SELECT eventId AS event_id, action_type, action_status
        FROM balance_scored JOIN {_POLICY} ON risk_level = level""",
)
def action_policy(spark, sf_dir):
    return actions_of(_balance_scored(spark, sf_dir)).select(
        "event_id", "action_type", "action_status"
    )


@check(
    "action_summary",
    ("balance_scored",),
    f"""SELECT action_type, action_status, count(*) AS n
        FROM balance_scored JOIN {_POLICY} ON risk_level = level GROUP BY 1, 2""",
)
def action_summary(spark, sf_dir):
    return count_actions(actions_of(_balance_scored(spark, sf_dir)))


@check(
    "open_cases",
    ("balance_scored",),
    """SELECT eventId AS event_id, userId AS user_id, risk_level, 'OPEN' AS case_status
       FROM balance_scored WHERE risk_level IN ('HIGH', 'CRITICAL')""",
)
def open_cases(spark, sf_dir):
    return cases_of(_balance_scored(spark, sf_dir)).drop("review_reason")


@check(
    "case_summary",
    ("balance_scored",),
    """SELECT 'OPEN' AS case_status, count(*) AS n FROM balance_scored
       WHERE risk_level IN ('HIGH', 'CRITICAL')""",
)
def case_summary(spark, sf_dir):
    return count_cases(cases_of(_balance_scored(spark, sf_dir)))


@check(
    "evidence_summary",
    ("balance_scored", "sim_labels"),
    """SELECT artifact, item, count(*) AS n FROM (
         SELECT 'risk_level' AS artifact, risk_level AS item FROM balance_scored
         UNION ALL SELECT 'rule_match', unnest(string_split(rule_codes, ','))
           FROM balance_scored WHERE rule_codes <> ''
         UNION ALL SELECT 'rule_label', CASE WHEN isFraud THEN
             CASE WHEN risk_level <> 'LOW' THEN 'TP' ELSE 'FN' END
             ELSE CASE WHEN risk_level <> 'LOW' THEN 'FP' ELSE 'TN' END END
           FROM balance_scored JOIN sim_labels USING (eventId)) GROUP BY artifact, item""",
)
def evidence_summary(spark, sf_dir):
    return summarize_evidence(
        _balance_scored(spark, sf_dir), tables.prepared(spark, sf_dir).labels
    )
