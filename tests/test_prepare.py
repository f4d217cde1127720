import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerwatch.config import LOCAL_SALT, PAYSIM_COLUMNS
from ledgerwatch.functions.digest import hmac_sha256, resolve_salt
from ledgerwatch.functions.numbers import is_decimal_text, plain_decimal, strict_int
from ledgerwatch.operators.paysim import Prepared, normalize_paysim
from ledgerwatch.operators.reports import prepare_report
from ledgerwatch.operators.sampling import (
    limit_rows,
    sample_balanced,
    sample_head,
    sample_manifest,
    select_sample,
)
from ledgerwatch.sources.files import (
    input_fingerprint,
    number_file_rows,
    number_rows,
    path_exists,
    read_jsonl,
    read_paysim_csv,
    write_paysim_outputs,
    write_report,
)
from ledgerwatch.schemas import PAYSIM_EVENT, PAYSIM_LABEL

GOOD = ("3", "TRANSFER", "181.00", "C1231006815", "181.0", "0.00", "C1666544295", "0", "0",
        "1", "0")


def raw_rows(spark, *changes):
    rows = []
    for i, change in enumerate(changes, start=1):
        values = dict(zip(PAYSIM_COLUMNS, GOOD, strict=True)) | change
        rows.append((i, *[values[c] for c in PAYSIM_COLUMNS]))
    ddl = "row_number long, " + ", ".join(f"{c} string" for c in PAYSIM_COLUMNS)
    return spark.createDataFrame(rows, ddl)


REASONS = [
    ({}, None),
    ({"step": "x"}, "INVALID_STEP"),
    ({"step": "-1"}, "INVALID_STEP"),
    ({"step": None}, "INVALID_STEP"),
    ({"type": "REFUND"}, "INVALID_TYPE"),
    ({"type": "DEBIT"}, "UNSUPPORTED_NATIVE_TYPE:DEBIT"),
    ({"amount": "abc"}, "INVALID_AMOUNT"),
    ({"amount": "NaN"}, "INVALID_AMOUNT"),
    ({"amount": "Infinity"}, "INVALID_AMOUNT"),
    ({"amount": "-0.01"}, "INVALID_AMOUNT"),
    ({"amount": "0"}, None),
    ({"newbalanceDest": ""}, "INVALID_BALANCE"),
    ({"oldbalanceOrg": "-5"}, None),
    ({"nameDest": " \t"}, "UNSUPPORTED_ROW"),
    ({"isFraud": "2"}, "INVALID_LABEL"),
    ({"isFlaggedFraud": None}, "INVALID_LABEL"),
    ({"step": "x", "amount": "NaN"}, "INVALID_STEP"),
    ({"type": "CASH_IN"}, None),
]


def test_reject_reasons(spark):
    tagged = normalize_paysim(raw_rows(spark, *[c for c, _ in REASONS]))
    got = [r["reject_reason"] for r in tagged.orderBy("row_number").collect()]
    assert got == [r for _, r in REASONS]


def test_event_label_and_no_raw_identifier(spark):
    parts = Prepared(normalize_paysim(raw_rows(spark, {}, {"type": "CASH_IN"}, {"step": "x"})))
    event = parts.events.orderBy("row_number").first().asDict(recursive=True)
    digest = hmac.new(LOCAL_SALT.encode(), b"C1231006815", hashlib.sha256).hexdigest()[:16]
    assert event["userId"] == f"U-{digest}" and event["accountId"] == f"A-{digest}"
    assert event["eventId"] == "paysim-000000001"
    assert event["eventTime"] == "2026-01-01T03:00:00Z" and event["amount"] == "181.00"
    assert event["balanceFeatures"]["oldBalanceOrig"] == "181.0"
    assert {r["eventType"] for r in parts.events.collect()} == {"TRANSFER", "DEPOSIT"}
    label = parts.labels.orderBy("row_number").first()
    assert label["isFraud"] is True and label["sourceType"] == "TRANSFER"
    for df in (parts.events, parts.labels, parts.rejected):
        assert "C1231006815" not in "".join(df.toJSON().collect())


def test_fail_fast(spark):
    with pytest.raises(Exception, match="row 1: INVALID_STEP"):
        normalize_paysim(raw_rows(spark, {"step": "x"}), fail_fast=True).collect()


def test_number_forms(spark):
    forms = {
        "170136.00": "170136.00",
        " 12 ": "12",
        "+5": "5",
        ".5": "0.5",
        "-.5": "-0.5",
        "5.": "5",
        "007.50": "7.50",
        "000": "0",
        "1_000": "1000",
        "1e3": "1000",
        "1.50e1": "15.0",
        "12e-2": "0.12",
        "9" * 40: "9" * 40,
    }
    df = spark.createDataFrame([(k,) for k in forms], "v string")
    got = df.select("v", is_decimal_text(F.col("v")), plain_decimal(F.col("v"))).collect()
    assert {r[0]: r[2] for r in got} == forms and all(r[1] for r in got)
    bad = ["", ".", "+", "e5", "1e", "0x1", "1,5", "NaN", "-Infinity", None]
    df = spark.createDataFrame([(k,) for k in bad], "v string")
    assert not any(r[0] for r in df.select(is_decimal_text(F.col("v"))).collect())
    ints = [("5", 5), (" 7 ", 7), ("5.0", None), ("x", None), ("1_0", 10), ("99999999999", None)]
    df = spark.createDataFrame([(k,) for k, _ in ints], "v string")
    assert [r[0] for r in df.select(strict_int(F.col("v"))).collect()] == [v for _, v in ints]


@pytest.mark.parametrize("key", ["k", "x" * 64, "long key " * 20, "소금"])
def test_hmac_is_standard(spark, key):
    texts = ["", "C1", "ünïcode 값"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hmac_sha256(F.col("t"), key)).collect()]
    assert got == [hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_salt_policy(monkeypatch):
    monkeypatch.delenv("PAYSIM_HASH_SALT", raising=False)
    assert resolve_salt() == (LOCAL_SALT, "default-local")
    assert resolve_salt("s") == ("s", "cli")
    with pytest.raises(ValueError):
        resolve_salt(require_own=True)
    monkeypatch.setenv("PAYSIM_HASH_SALT", "own")
    assert resolve_salt(require_own=True) == ("own", "env:PAYSIM_HASH_SALT")


def write_csv(path, rows, columns=PAYSIM_COLUMNS, bom=True):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as out:
        out.write(",".join(columns) + "\n")
        out.writelines(",".join(r) + "\n" for r in rows)


def test_csv_and_whole_run(spark, folder):
    source = f"{folder}/in.csv"
    rows = [(str(i), *GOOD[1:], "extra") for i in range(500)]
    rows[3] = ("x", *GOOD[1:], "extra")
    write_csv(source, rows, (*PAYSIM_COLUMNS, "more"))
    raw = number_file_rows(read_paysim_csv(spark, source))
    assert [r["step"] for r in raw.orderBy("row_number").collect()] == [r[0] for r in rows]
    tagged = normalize_paysim(raw).persist()
    out = write_paysim_outputs(Prepared(tagged), f"{folder}/out")
    events = read_jsonl(spark, out.events, PAYSIM_EVENT)
    assert events.count() == 499 and read_jsonl(spark, out.labels, PAYSIM_LABEL).count() == 499
    with pytest.raises(FileExistsError):
        write_paysim_outputs(Prepared(tagged), f"{folder}/out")
    write_paysim_outputs(Prepared(tagged), f"{folder}/out", force=True)
    digest = input_fingerprint(spark, source).first()["sha256"]
    assert digest == hashlib.sha256(open(source, "rb").read()).hexdigest()
    report = prepare_report(tagged, "cli", digest)
    write_report(report, out.report)
    part = next(f for f in os.listdir(out.report) if f.startswith("part-"))
    doc = json.load(open(f"{out.report}/{part}"))
    assert (doc["totalRows"], doc["acceptedRows"], doc["rejectedRows"]) == (500, 499, 1)
    assert doc["eventTypeCounts"] == {
        "CASH_IN": 0, "CASH_OUT": 0, "DEBIT": 0, "PAYMENT": 0, "TRANSFER": 499,
    }
    assert list(doc) == sorted(doc) and LOCAL_SALT not in json.dumps(doc)
    tagged.unpersist()


def test_outputs_are_one_pass_and_all_or_none(spark, folder, monkeypatch):
    from ledgerwatch.sources import files

    rows = [(i, str(i), *GOOD[1:]) for i in range(1, 60)] + [(60, "x", *GOOD[1:])]
    schema = "row_number long, " + ", ".join(f"{c} string" for c in PAYSIM_COLUMNS)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/raw")
    prepared = Prepared(normalize_paysim(spark.read.parquet(f"{folder}/raw")))
    plan = prepared.lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1
    out = write_paysim_outputs(prepared, f"{folder}/out")
    for path, table in ((out.events, prepared.events), (out.labels, prepared.labels)):
        found = read_jsonl(spark, path, table.drop("row_number").schema)
        assert sorted(map(str, found.collect())) == sorted(map(str, table.drop("row_number").collect()))
    found = read_jsonl(spark, out.rejected, prepared.rejected.schema)
    assert found.collect() == prepared.rejected.collect() and found.count() == 1
    assert sorted(os.listdir(f"{folder}/out")) == sorted(
        os.path.basename(p) for p in (out.events, out.labels, out.rejected)
    )
    # A failing job leaves no output, and with force the old one stays as it was.
    before = {p: sorted(os.listdir(p)) for p in (out.events, out.labels, out.rejected)}
    failing = Prepared(normalize_paysim(spark.read.parquet(f"{folder}/raw"), fail_fast=True))
    for target, force in ((f"{folder}/none", False), (f"{folder}/out", True)):
        with pytest.raises(Exception, match="row 60"):
            write_paysim_outputs(failing, target, force)
    assert not os.path.exists(f"{folder}/none/paysim-events.jsonl")
    assert {p: sorted(os.listdir(p)) for p in before} == before

    # Nor does a renaming that fails in the middle.
    def second_fails(store, of, moves):
        broken = [*moves[:-1], ("/nowhere/at/all", moves[-1][1])]
        return renamed(store, of, broken)

    renamed = files._rename_all
    monkeypatch.setattr(files, "_rename_all", second_fails)
    with pytest.raises(Exception, match="nowhere"):
        write_paysim_outputs(prepared, f"{folder}/out", force=True)
    assert {p: sorted(os.listdir(p)) for p in before} == before


def test_csv_header_is_required(spark, folder):
    write_csv(f"{folder}/in.csv", [GOOD[:-2]], PAYSIM_COLUMNS[:-2], bom=False)
    with pytest.raises(ValueError, match="isFlaggedFraud, isFraud"):
        read_paysim_csv(spark, f"{folder}/in.csv")


def test_rows_are_numbered_across_files(spark, folder):
    for name, start in (("b", 100), ("a", 0)):
        write_csv(f"{folder}/{name}.csv", [(str(start + i), *GOOD[1:]) for i in range(50)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        raw = number_file_rows(read_paysim_csv(spark, f"{folder}/*.csv"))
        steps = [int(r["step"]) for r in raw.orderBy("row_number").collect()]
        numbers = sorted(r["row_number"] for r in raw.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert steps == [*range(50), *range(100, 150)] and numbers == list(range(1, 101))


def test_number_rows_by_key(spark):
    df = spark.range(0, 1000, 3).repartition(7)
    got = number_rows(df, "id", bucket_width=64).orderBy("row_number").collect()
    assert [r["id"] for r in got] == list(range(0, 1000, 3))
    assert [r["row_number"] for r in got] == list(range(1, 335))


def test_samples(spark):
    fraud = [{"isFraud": "1" if i % 10 == 0 else "0"} for i in range(50)]
    tagged = normalize_paysim(raw_rows(spark, *fraud))
    parts = Prepared(tagged)
    head = sample_head(parts.events, 3).orderBy("position").collect()
    assert [r["eventId"][-2:] for r in head] == ["01", "02", "03"]
    sample = sample_balanced(parts.labels, 8)
    ids = [int(r["eventId"][-2:]) for r in sample.orderBy("position").collect()]
    assert ids == [1, 11, 21, 31, 41, 2, 3, 4]
    events, labels = select_sample(parts.events, sample), select_sample(parts.labels, sample)
    note = sample_manifest(labels, events, prepare_report(tagged), "balanced", 8).first()
    assert (note["sampleEvents"], note["sampleFraudRows"], note["sampleNonFraudRows"]) == (8, 5, 3)
    with pytest.raises(ValueError):
        sample_head(parts.events, 1001)
    assert limit_rows(tagged, 0).count() == 0 and limit_rows(tagged, 7).count() == 7


def test_jsonl_modes(spark, folder):
    with open(f"{folder}/x.jsonl", "w") as out:
        out.write('{"eventId":"a","isFraud":true}\n\n{bad\n')
    with pytest.raises(Exception):
        read_jsonl(spark, f"{folder}/x.jsonl", PAYSIM_LABEL).collect()
    kept = read_jsonl(spark, f"{folder}/x.jsonl", PAYSIM_LABEL, "PERMISSIVE").collect()
    assert [r["_corrupt_record"] for r in kept if r["eventId"] is None] == ["{bad"]
    assert path_exists(spark, f"{folder}/x.jsonl") and not path_exists(spark, f"{folder}/y")
