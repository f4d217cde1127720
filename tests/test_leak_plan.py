"""The scan of JSON texts reads each text once, however many rules there are."""

from pyspark.sql import functions as F

from ledgerwatch.operators.leaks import json_strings, scan_json_leaks


def test_json_is_scanned_once(spark):
    texts = [
        '{"nameOrig" : "x", "a\\"b":["C123456789", "q:"], "c\\u0041":":"}',
        '{"nested":{"isFraud" \n: true, "note":"say \\"nameOrig\\":1"}}',
        '{"n\\u0061meOrig":1, "empty":"", "":"\\\\"}',
        None,
    ]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = table.select("k", scan_json_leaks(F.col("t"), forbid_labels=True).alias("leaks"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    leaks = {r.k: r.leaks for r in found.collect()}
    assert leaks == {
        0: ["RAW_IDENTIFIER_FIELD:nameOrig", "RAW_IDENTIFIER_VALUE"],
        1: ["LABEL_FIELD:isFraud"],
        2: ["RAW_IDENTIFIER_FIELD:nameOrig"],
        3: [],
    }
    keys, values = (json_strings(F.col("t"), k).alias(n) for k, n in ((True, "keys"), (False, "others")))
    rows = {r.k: (r["keys"], r.others) for r in table.select("k", keys, values).collect()}
    assert rows[0] == (["nameOrig", 'a"b', "cA"], ["x", "C123456789", "q:", ":"])
    assert rows[1] == (["nested", "isFraud", "note"], ['say "nameOrig":1'])
    assert rows[2] == (["nameOrig", "empty", ""], ["", "\\"])
