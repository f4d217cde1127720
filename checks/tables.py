"""Views of the supplied tables in the shape of our inputs.

The supplied data has no transactions, so ``events`` is read as a transaction topic and
``orders`` with ``customer`` as raw simulation rows. Fixed key residues get fields broken on
purpose, so that every check has something to find. ``checks/base_sql.py`` says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.paysim import Prepared, normalize_paysim
from ledgerwatch.operators.windows import trailing_window
from ledgerwatch.operators.rules import baseline_rules, score_events
from ledgerwatch.operators.windows import first_wins
from ledgerwatch.plans.detection import take_in
from ledgerwatch.plans.simulation import score_prepared
from ledgerwatch.session import prepare_session

DAY_MS = 24 * 60 * 60 * 1000
TOPIC = "transaction-events"


def one_plan(build: Callable) -> Callable:
    """Build each view's plan once per session and folder. Only the plan is kept, no data:
    every query still reads the tables itself."""
    plans: dict[tuple, object] = {}

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str, *rest: str):
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, *rest)
        if key not in plans:
            plans[key] = build(spark, sf_dir, *rest)
        return plans[key]

    return get


@one_plan
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)") / 1000)


def tx_of(events: DataFrame) -> DataFrame:
    """``events`` rows (table or stream) as delivered transaction rows."""
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    kind = (
        F.when(F.col("event_type") == "purchase", "PAYMENT")
        .when(F.col("event_type") == "view", "TRANSFER")
        .when(F.col("event_type") == "click", "DEPOSIT")
        .when(F.col("event_type") == "signup", "WITHDRAWAL")
        .otherwise("DEBIT")
    )
    place = (
        F.when(k % 20 == 0, "UNKNOWN")
        .when(k % 20 == 1, " foreign ")
        .when(k % 20 == 2, "HIGH_RISK")
        .when(k % 20 == 3, F.lit(None).cast("string"))
        .otherwise("KR")
    )
    received = F.when(n % 97 == 0, ts - F.expr("INTERVAL 6 MINUTES")).otherwise(
        ts + millis(n % 7 * 100)
    )
    return events.select(
        F.concat(F.lit("evt-"), n.cast("string")).alias("event_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("acc-"), F.col("user_id").cast("string")).alias("account_id"),
        kind.alias("event_type"),
        (F.col("value").cast("decimal(10,2)") * 10000).cast("decimal(19,2)").alias("amount"),
        F.lit("KRW").alias("currency"),
        F.concat(F.lit("m-"), (n % 50).cast("string")).alias("merchant_id"),
        F.concat(F.lit("dev-"), (k % 7).cast("string")).alias("device_id"),
        place.alias("location"),
        ts.alias("event_time"),
        received.alias("received_at"),
        F.when(n % 3 == 0, " ")
        .otherwise(F.concat(F.lit("trace-evt-"), n.cast("string")))
        .alias("trace_id"),
        F.lit(TOPIC).alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition_no"),
        n.alias("offset_no"),
        n.alias("n"),
    )


@one_plan
def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_of(read(spark, sf_dir, "events"))


@one_plan
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with required fields blanked on some rows."""
    n = F.col("n")

    def broken(name: str, every: int, value: Column) -> Column:
        return F.when(n % every == 0, value).otherwise(F.col(name))

    null = F.lit(None)
    return tx(spark, sf_dir).withColumns(
        {
            "user_id": broken("user_id", 53, F.lit(" ")),
            "currency": F.when(n % 59 == 0, F.lit(""))
            .when(n % 61 == 0, F.lit("USD"))
            .otherwise(F.col("currency")),
            "amount": broken("amount", 67, null),
            "event_time": broken("event_time", 71, null),
            "event_type": broken("event_type", 73, null),
        }
    )


@one_plan
def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted transactions, one in ten delivered twice (the copy at a later offset)."""
    accepted = take_in(tx(spark, sf_dir)).accepted
    copies = accepted.filter(F.col("n") % 10 == 0).withColumns(
        {
            "offset_no": F.col("offset_no") + 10_000_000_000,
            "received_at": F.col("received_at") + F.expr("INTERVAL 1 SECOND"),
        }
    )
    return accepted.unionByName(copies)


@one_plan
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take_in(tx(spark, sf_dir)).accepted


def detected_at() -> Column:
    return F.col("received_at") + millis(F.col("n") % 50 * 40)


@one_plan
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: each event once; one in nineteen was scored without window state."""
    once = first_wins(
        deliveries(spark, sf_dir), ["event_id"], ["partition_no", "offset_no"]
    )
    windowed = trailing_window(once, DAY_MS)
    scored = score_events(windowed, baseline_rules(), degraded=F.col("n") % 19 == 0)
    return scored.withColumn("detected_at", detected_at()).withColumn(
        "rule_version",
        F.when(F.col("n") % 23 == 0, F.lit(None).cast("string"))
        .when(F.col("n") % 29 == 0, F.lit(" "))
        .otherwise(F.col("rule_version")),
    )


@one_plan
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of accepted events; some were never published."""
    return accepted(spark, sf_dir).withColumn(
        "status",
        F.when(F.col("n") % 31 == 0, "PUBLISH_FAILED").otherwise("PUBLISHED"),
    )


@one_plan
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing logs of published deliveries; copies were skipped as duplicates."""
    copy = F.col("offset_no") >= 10_000_000_000
    return (
        deliveries(spark, sf_dir)
        .filter(F.col("n") % 31 != 0)
        .withColumns(
            {
                "status": F.when(copy, "DUPLICATE_SKIPPED").otherwise("PROCESSED"),
                "processed_at": F.col("received_at") + millis(F.col("n") % 50 * 40),
            }
        )
    )


@one_plan
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that reached the table: published, rules did not fail, and not lost on the way
    (withdrawals of device 6); some were stored twice (withdrawals of device 5)."""
    lost = (F.col("event_type") == "WITHDRAWAL") & (F.col("device_id") == "dev-6")
    rows = results(spark, sf_dir).filter((F.col("n") % 31 != 0) & ~rule_failed() & ~lost)
    twice = (F.col("event_type") == "WITHDRAWAL") & (F.col("device_id") == "dev-5")
    return rows.unionByName(rows.filter(twice))


def rule_failed() -> Column:
    """Events whose rules are taken to have failed: deposits, or no location."""
    return (F.col("event_type") == "DEPOSIT") | F.col("location").isNull()


@one_plan
def dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of events whose rules failed, in every state of the workflow."""
    n = F.col("n")
    status = (
        F.when(n % 5 == 0, "REPROCESSED")
        .when(n % 5 == 1, "REPROCESS_FAILED")
        .when(n % 5 == 2, "DISCARDED")
        .otherwise("PENDING")
    )
    payload = F.when(n % 7 == 0, F.lit("not json")).otherwise(
        F.concat(
            F.lit('{"schemaVersion":"v1","eventId":"'),
            F.col("event_id"),
            F.lit('","userId":"'),
            F.col("user_id"),
            F.lit('"}'),
        )
    )
    created = F.col("received_at")
    null_ts = F.lit(None).cast("timestamp")
    failed = accepted(spark, sf_dir).filter((n % 31 != 0) & rule_failed())
    return failed.select(
        n.alias("dlq_id"),
        "event_id",
        "trace_id",
        "user_id",
        F.col("topic").alias("source_topic"),
        F.col("partition_no").alias("source_partition"),
        F.col("offset_no").alias("source_offset"),
        F.lit("transaction-events-dlt").alias("dlt_topic"),
        F.when(n % 3 == 0, "UNKNOWN_ERROR")
        .otherwise("RULE_ENGINE_ERROR")
        .alias("failure_stage"),
        F.lit("MissingRuleInput").alias("error_type"),
        F.lit("amount").alias("error_message"),
        payload.alias("payload_json"),
        status.alias("status"),
        (n % 4).cast("int").alias("reprocess_attempts"),
        null_ts.alias("last_reprocessed_at"),
        null_ts.alias("discarded_at"),
        F.lit(None).cast("string").alias("discard_reason"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


@one_plan
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator commands, one per event: many name no dead letter, some come twice."""
    shaped = tx(spark, sf_dir).select(
        (F.col("n") * 2).alias("command_id"),
        F.col("n").alias("dlq_id"),
        F.when(F.col("n") % 4 == 0, " ")
        .otherwise(F.concat(F.lit("op-"), (F.col("n") % 9).cast("string")))
        .alias("actor"),
        F.when(F.col("n") % 13 == 0, "").otherwise("checked by hand").alias("reason"),
        F.concat(F.lit("trace-cmd-"), F.col("n").cast("string")).alias("trace_id"),
        (F.col("n") % 11 == 0).alias("publish_failed"),
    )
    again = shaped.filter(F.col("dlq_id") % 17 == 0).withColumn(
        "command_id", F.col("command_id") + 1
    )
    return shaped.unionByName(again)


# ---------------------------------------------------------------- simulation


@one_plan
def paysim_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    )
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    old = (F.col("c_acctbal").cast("decimal(18,2)") * 40).cast("decimal(18,2)")
    native = (
        F.when(F.col("o_orderpriority").startswith("1"), "TRANSFER")
        .when(F.col("o_orderpriority").startswith("2"), "CASH_OUT")
        .when(F.col("o_orderpriority").startswith("3"), "PAYMENT")
        .when(F.col("o_orderpriority").startswith("4"), "CASH_IN")
        .otherwise("DEBIT")
    )
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    left = F.greatest(old - money, F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)")
    risky = native.isin("TRANSFER", "CASH_OUT") & (F.col("o_orderstatus") == "F")
    flagged = (native == "TRANSFER") & (money > 400000)

    def text(value: Column) -> Column:
        return value.cast("string")

    def bit(value: Column) -> Column:
        return F.when(value, "1").otherwise("0")

    return joined.select(
        (k + 1).alias("row_number"),
        F.when(k % 211 == 0, "x")
        .when(k % 223 == 0, "-1")
        .otherwise(text(days * 24))
        .alias("step"),
        F.when(k % 227 == 0, "REFUND").otherwise(native).alias("type"),
        F.when(k % 229 == 0, "NaN")
        .when(k % 233 == 0, "-5.00")
        .when(k % 199 == 0, "0.00")
        .otherwise(text(money))
        .alias("amount"),
        F.when(k % 239 == 0, "  ")
        .otherwise(F.concat(F.lit("C"), F.lpad(text(F.col("o_custkey")), 9, "0")))
        .alias("nameOrig"),
        F.when(k % 241 == 0, "abc").otherwise(text(old)).alias("oldbalanceOrg"),
        text(left).alias("newbalanceOrig"),
        F.concat(
            F.when(k % 2 == 0, "M").otherwise("C"), F.lpad(text(k * 7 % 1000003), 9, "0")
        ).alias("nameDest"),
        F.lit("0.00").alias("oldbalanceDest"),
        F.when(k % 251 == 0, "Infinity").otherwise(text(money)).alias("newbalanceDest"),
        F.when(k % 257 == 0, "2").otherwise(bit(risky)).alias("isFraud"),
        F.when(k % 263 == 0, "").otherwise(bit(flagged)).alias("isFlaggedFraud"),
    )


@one_plan
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_paysim(paysim_raw(spark, sf_dir))


@one_plan
def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    return Prepared(tagged(spark, sf_dir))


@one_plan
def replay_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared events with one field broken per residue, so that each check fires."""
    r = F.col("row_number")
    events = prepared(spark, sf_dir).events

    def broken(name: str, every: int, value: str | None) -> Column:
        other = F.lit(value).cast("string")
        return F.when(r % every == 0, other).otherwise(F.col(name))

    swapped = {
        "userId": F.when(r % 83 == 0, F.lit("U-XYZ"))
        .when(r % 89 == 0, F.lit("seen with C123456 today"))
        .otherwise(F.col("userId")),
        "eventId": broken("eventId", 97, ""),
        "traceId": F.when(r % 101 == 0, F.lit(""))
        .when(r % 103 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("traceId")),
        "typeMappingPolicyVersion": broken("typeMappingPolicyVersion", 107, "old-v0"),
        "nativeEventType": broken("nativeEventType", 109, "DEBIT"),
        "eventType": broken("eventType", 113, "DEPOSIT"),
        "normalizedEventType": broken("normalizedEventType", 127, "PAYMENT"),
        "typeSupportLevel": broken("typeSupportLevel", 131, "unsupported"),
        "currency": broken("currency", 137, "USD"),
        "eventTime": broken("eventTime", 139, ""),
    }
    out = events.withColumns(swapped)
    # Extra fields some rows carry: labels, raw names, a receipt time; and rows from a source
    # without mapping fields, one kind of which the API does not know.
    bare = r % 149 == 0
    out = out.withColumns(
        {
            "isFraud": F.when(r % 151 == 0, F.lit(True)),
            "nameOrig": F.when(r % 157 == 0, F.lit("someone")),
            "receivedAt": F.when(r % 163 == 0, F.lit("2026-01-01T00:00:00Z")),
            **{
                c: F.when(~bare, F.col(c))
                for c in (
                    "nativeEventType",
                    "normalizedEventType",
                    "typeSupportLevel",
                    "typeMappingPolicyVersion",
                )
            },
        }
    )
    return out.withColumn(
        "eventType", F.when(bare & (r % 2 == 0), F.lit("REFUND")).otherwise(F.col("eventType"))
    )


@one_plan
def dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepared files with defects: broken events, repeated and missing rows."""
    events = replay_input(spark, sf_dir)
    r = F.col("row_number")
    events = events.unionByName(events.filter(r % 167 == 0)).filter(r % 173 != 0)
    parts = prepared(spark, sf_dir)
    labels = parts.labels.filter(r % 179 != 0).withColumn(
        "sourceType", F.when(r % 181 == 0, "REFUND").otherwise(F.col("sourceType"))
    )
    labels = labels.unionByName(labels.filter(r % 191 == 0))
    rejected = parts.rejected.withColumn(
        "reason",
        F.when(F.col("rowNumber") % 193 == 0, "ODD").otherwise(F.col("reason")),
    )
    return events, labels, rejected


PREFIX = "rp"


@one_plan
def sim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).labels


@one_plan
def sim_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported results: replay prefix on half of them, scores and versions missing here and
    there, some events without a result, some results without a label."""
    n = F.substring_index("eventId", "-", -1).cast("long")
    scored = score_prepared(prepared(spark, sf_dir).events).withColumn("n", n)
    kept = scored.filter(F.col("n") % 13 != 0)
    strange = kept.filter(F.col("n") % 37 == 0).withColumn(
        "eventId", F.concat(F.lit("other-"), F.col("eventId"))
    )
    prefixed = kept.withColumn(
        "eventId",
        F.when(F.col("n") % 2 == 0, F.concat(F.lit(f"{PREFIX}-"), F.col("eventId"))).otherwise(
            F.col("eventId")
        ),
    )
    return prefixed.unionByName(strange).select(
        "eventId",
        "riskLevel",
        F.when(F.col("n") % 5 != 0, F.col("riskScore")).alias("riskScore"),
        F.when(F.col("n") % 11 != 0, F.col("ruleVersion")).alias("ruleVersion"),
        F.when(F.col("n") % 3 != 0, F.col("ruleCodes")).alias("ruleCodes"),
        F.concat_ws(" , ", "ruleCodes").alias("matchedRules"),
    )


@one_plan
def sim_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of a replay: pre-send rejects plus sending errors that do not count."""
    n = F.col("row_number")
    return (
        prepared(spark, sf_dir)
        .events.filter(n % 17 == 0)
        .select(
            F.concat(F.lit(f"{PREFIX}-"), F.col("eventId")).alias("eventId"),
            F.when(n % 3 == 0, "HTTP_503")
            .when(n % 3 == 1, "INVALID_AMOUNT")
            .otherwise("MISSING_FIELD:traceId")
            .alias("reason"),
        )
    )
