"""Three small inputs with their expected results.  FIXED VALUES: rows and expectations are kept as they are."""
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

import tabscope as ts
from tabscope.operators import patterns, stats

from conftest import by_col


def test_primary_key_detection(spark):
    schema = StructType([StructField("id", StringType(), False), StructField("type", StringType(), True)])
    df = spark.createDataFrame([("ACC-001", "Checking"), ("ACC-002", "Savings"), ("ACC-003", "Loan")], schema)
    for opts in (ts.ProfileOptions(), ts.ProfileOptions(exact=True), ts.ProfileOptions(pk_gate="strict")):
        cols = by_col(ts.column_schema(ts.column_profile(df, opts)), "name")
        assert cols["id"]["is_pk_candidate"] is True
        assert cols["id"]["uniqueness_ratio"] == 1.0
        assert cols["id"]["nullable"] is False


def test_null_rate_and_outlier(spark):
    schema = StructType([StructField("col1", IntegerType(), True), StructField("col2", IntegerType(), True)])
    df = spark.createDataFrame([(10, 100), (20, 200), (30, 300), (None, 1000000)], schema)
    for opts in (ts.ProfileOptions(), ts.ProfileOptions(exact=True)):
        st = by_col(ts.column_stats(ts.column_profile(df, opts)))
        assert st["col1"]["null_pct"] == 0.25
        assert st["col2"]["has_outliers"] is True
    exact = by_col(stats.column_profile(df, ts.ProfileOptions(exact=True)))
    assert (exact["col2"]["q1"], exact["col2"]["q3"]) == (100.0, 300.0)
    assert (exact["col2"]["lower_bound"], exact["col2"]["upper_bound"]) == (-200.0, 600.0)
    assert exact["col2"]["outlier_count"] == 1


def test_pattern_layers(spark):
    df = spark.createDataFrame(
        [
            ("ACC-123456", "DE12345678901234567890", "test@bank.com", "Regular customer"),
            ("ACC-654321", "DE09876543210987654321", "user@domain.org", "High value"),
            ("ACC-999999", "DE55555555555555555555", "admin@corp.net", "New account"),
        ],
        "account_id string, iban string, email string, notes string",
    )
    opts = ts.ProfileOptions()
    found = by_col(patterns.pattern_findings(patterns.pattern_scores(df, opts), stats.column_profile(df, opts)))
    assert "IBAN" in found["iban"]["patterns"]
    assert "EMAIL" in found["email"]["patterns"]
    assert "ACCOUNT_ID" in found["account_id"]["patterns"]
    assert "LIKELY_KEY" in found["account_id"]["heuristics"]
    assert "HIGH_UNIQUENESS_CANDIDATE" in found["account_id"]["heuristics"]
    assert found["account_id"]["uniqueness_score"] == 1.0
