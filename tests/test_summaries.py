"""Reports from daily sums against reports from payments."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from ridelake.operators import aggregates, summaries
from ridelake.operators.changes import process_refunds
from ridelake.sources.feeds import feed

RANGE = {"start": "1997-01-01", "end": "1998-06-30"}
REPORTS = [
    (aggregates.platform_revenue, {}), (aggregates.revenue_report_range, RANGE), (aggregates.revenue_report_admin, RANGE),
    (aggregates.revenue_report_admin, {**RANGE, "end_inclusive": True}), (aggregates.revenue_report_finance, RANGE),
    (aggregates.revenue_totals, RANGE), (aggregates.refund_totals, {}), (aggregates.refund_report, RANGE), (aggregates.dispute_totals, {}),
]


def _same(payments, days):
    for report, fixed in REPORTS:
        scan, summed = report({"payments": payments}, **fixed), report({"payment_days": days}, **fixed)
        assert scan.dtypes == summed.dtypes
        assert rows(scan) == rows(summed), report


def test_reports_in_pieces_late_rows_and_refunds(spark, tables, folder):
    payments = tables["payments"].unionByName(spark.createDataFrame(
        [(9_000_001, None, 1, None, "card", "paid", None), (9_000_002, 1, 1, None, "cash", "failed", dt.datetime(1998, 6, 30)),
         (None, 1, 1, 5, "cash", "paid", dt.datetime(1998, 6, 30)), (9_000_003, 1, 1, 7, None, None, dt.datetime(1998, 6, 30, 0, 0, 1))],
        "payment_id long, ride_id long, user_id long, amount int, payment_method string, payment_status string, transaction_date timestamp_ntz",
    ).withColumn("amount", F.col("amount").cast("decimal(10,2)")), allowMissingColumns=True)
    kept = summaries.kept_days(spark, folder)
    third = F.coalesce(F.col("payment_id"), F.lit(0)) % 3
    for version, part in enumerate((0, 2, 1)):  # every day is added to three times, so twice late
        for _ in range(2):
            summaries.add_payments(kept, payments.where(third == part), version)
    _same(payments, kept.read())
    refunded = process_refunds(payments, feed(tables, "refund_requests"))
    hit = refunded["decided"].where("reject_reason IS NULL").select("payment_id", F.lit("refunded").alias("new_status"))
    kept.merge(summaries.status_deltas(payments, hit), summaries.add_up)
    assert hit.count() > 0
    _same(refunded["snapshot"], kept.read())


def test_a_new_day_touches_its_own_buckets(spark, tables, folder):
    kept = summaries.kept_days(spark, folder)
    summaries.add_payments(kept, tables["payments"])
    before = set(kept.folders())
    day = tables["payments"].agg(F.max("transaction_date")).first()[0] + dt.timedelta(days=1)
    summaries.add_payments(kept, tables["payments"].limit(20).withColumn("transaction_date", F.lit(day).cast("timestamp_ntz")))
    assert len(set(kept.folders()) - before) == 1


def test_a_range_within_a_day_reads_the_payments(tables):
    assert aggregates._days({"payment_days": None}, "1997-01-01 10:00:00") is None
