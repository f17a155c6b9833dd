import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import get_session

    session = get_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def bill_rows(spark):
    """Bill lines from a few fields; everything else takes a neutral value."""
    from tallyspark import schemas

    def make(*rows, **common):
        base = {
            "provider_name": "AWS", "service_name": "Amazon Redshift", "charge_category": "Usage", "billing_currency": "USD",
            "tags": "{}", "x_source_connector": "aws", "service_category": "Analytics", "x_effective_is_list": False,
        }
        from decimal import Decimal
        import datetime as dt

        out = []
        for i, row in enumerate(rows):
            r = {**base, **common, **row}
            day = dt.date.fromisoformat(r.pop("day", "2024-05-01"))
            cost = Decimal(str(r.pop("cost", 1)))
            r.setdefault("dedupe_key", f"k{i}-{day}-{cost}-{sorted(row.items())}")
            r["charge_period_start"] = dt.datetime(day.year, day.month, day.day)
            r["charge_period_end"] = r["charge_period_start"] + dt.timedelta(days=1)
            r["charge_month"] = day.strftime("%Y-%m")
            for c in ("effective_cost", "billed_cost", "list_cost", "contracted_cost"):
                r.setdefault(c, cost)
            out.append(tuple(r.get(f.name) for f in schemas.BILL.fields))
        return spark.createDataFrame(out, schemas.BILL)

    return make


@pytest.fixture()
def provider_bill():
    from tallyspark.operators import silver

    return lambda rows, as_of="2024-05-11": silver.provider_bill(silver.focus_normalized(rows, as_of))
