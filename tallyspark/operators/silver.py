"""Normalized charge view: one cost metric, charge-period grain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.labels import EC2_SERVICE, S3_SERVICE

# Bronze-only bookkeeping that consumers never read.
_DROPPED = {
    "dedupe_key", "ingest_run_id", "x_ingested_at", "billing_account_name", "sub_account_name",
    "billing_period_start", "billing_period_end", "x_focus_version", "x_record_id",
    "x_record_type", "charge_month",
}


def focus_normalized(bill: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Bill lines with day, month and credit/correction/partial-period flags; cost is effective cost.

    Works on any column subset of the bill, so callers can prune before joins.
    """
    have = set(bill.columns)
    out = []
    for name in bill.columns:
        if name == "effective_cost":
            out.append(F.col(name).alias("cost"))
        elif name not in _DROPPED:
            out.append(F.col(name))
    if "charge_period_start" in have:
        day = F.to_date("charge_period_start")
        month = F.trunc(day, "MM")
        out += [
            day.alias("charge_day"),
            month.alias("charge_month"),
            (month == F.trunc(F.lit(str(as_of)).cast("date"), "MM")).alias("is_partial_period"),
        ]
    if {"charge_category", "effective_cost"} <= have:
        out.append(
            ((F.col("charge_category") == "Credit") | (F.col("effective_cost") < 0)).alias("is_credit")
        )
    if "charge_class" in have:
        out.append((F.col("charge_class") == "Correction").alias("is_correction"))
    return bill.select(*out)


def provider_bill(normalized: DataFrame) -> DataFrame:
    """The provider's own bill: infrastructure that backs another platform is reported elsewhere."""
    backing = (F.col("provider_name") == "AWS") & F.col("service_name").isin(S3_SERVICE, EC2_SERVICE)
    return normalized.where(~F.coalesce(backing, F.lit(False)))
