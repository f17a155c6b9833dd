"""Comparison SQL: shared input CTEs and small text helpers."""

from __future__ import annotations

import re

from tallyspark.sources import driver_tables as dt

CTES: dict[str, str] = dict(dt.PLANES)
CTES["bill"] = dt.bill_select()
CTES["silver"] = f"""
SELECT * EXCLUDE (charge_month, effective_cost), effective_cost AS cost,
  CAST(charge_period_start AS DATE) AS charge_day,
  CAST(date_trunc('month', charge_period_start) AS DATE) AS charge_month,
  charge_category = 'Credit' OR effective_cost < 0 AS is_credit,
  coalesce(charge_class = 'Correction', NULL) AS is_correction,
  strftime(charge_period_start, '%Y-%m') = '{dt.AS_OF[:7]}' AS is_partial_period
FROM bill"""
CTES["pbill"] = """
SELECT * FROM silver WHERE provider_name <> 'AWS'
   OR service_name NOT IN ('Amazon Simple Storage Service', 'Amazon Elastic Compute Cloud')"""
CTES["tagrows"] = """
SELECT pbill.*, k.tag_key, json_extract_string(tags, '$."' || k.tag_key || '"') AS tag_value
FROM pbill, unnest(json_keys(tags)) AS k(tag_key)"""


# Complete statements that bring their own inputs.
CLOSED: set[str] = set()


def add(name: str, sql: str, closed: bool = False) -> None:
    if name in CTES:
        raise ValueError(name)
    CTES[name] = sql
    if closed:
        CLOSED.add(name)


def with_ctes(body: str) -> str:
    """Prefix *body* with the CTEs it reaches, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, sql in CTES.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name, sql)

    def visit_name(name: str, sql: str) -> None:
        seen.add(name)
        if name in CLOSED:
            order.append(name)
            return
        for dep, dep_sql in CTES.items():
            if dep != name and dep not in order and dep not in seen and re.search(rf"\b{dep}\b", sql):
                visit_name(dep, dep_sql)
        order.append(name)

    seen: set[str] = set()
    visit(body)
    if not order:
        return body
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    return f"WITH {head}\n{body}"


def fin(body: str, dbl: str = "", big: str = "", r: str = "", r2: str = "", **rounds: int) -> str:
    """Wrap a body: *dbl* as double, *r*/*r2* as double rounded to 4/2 digits, *big* as bigint."""
    items = [f"CAST({c} AS DOUBLE) AS {c}" for c in dbl.split()]
    items += [f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in r.split()]
    items += [f"round(CAST({c} AS DOUBLE), 2) AS {c}" for c in r2.split()]
    items += [f"CAST({c} AS BIGINT) AS {c}" for c in big.split()]
    replace = f" REPLACE ({', '.join(items)})" if items else ""
    return with_ctes(f"SELECT *{replace} FROM (\n{body}\n)")
