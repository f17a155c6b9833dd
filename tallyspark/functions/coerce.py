"""Column-level coercion: messy source text in, typed and bounded values out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The charge-table vocabularies.
CHARGE_CATEGORIES = ("Usage", "Purchase", "Tax", "Credit", "Adjustment")
SERVICE_CATEGORIES = (
    "AI and Machine Learning", "Analytics", "Compute", "Databases", "Developer Tools",
    "Management and Governance", "Networking", "Security, Identity, and Compliance",
    "Storage", "Other",
)
PRICING_CATEGORIES = ("Standard", "Dynamic", "Committed", "Other")
COMMITMENT_CATEGORIES = ("Spend", "Usage")
COMMITMENT_STATUSES = ("Used", "Unused")
NULL_WORDS = ("", "NULL", "NONE", "NAN")

MONEY = "decimal(20,6)"


def nz(c: Column) -> Column:
    """Trimmed text, or NULL when the text only spells 'no value'."""
    t = F.trim(c.cast("string"))
    return F.when(~F.upper(t).isin(*NULL_WORDS), t)


def in_vocabulary(c: Column, words: tuple[str, ...], default: str | None = None) -> Column:
    value = nz(c)
    return F.when(value.isin(*words), value).otherwise(F.lit(default))


def charge_category(c: Column) -> Column:
    return in_vocabulary(c, CHARGE_CATEGORIES, "Usage")


def service_category(c: Column) -> Column:
    return in_vocabulary(c, SERVICE_CATEGORIES, "Other")


def charge_class(c: Column) -> Column:
    return in_vocabulary(c, ("Correction",))


def pricing_category(c: Column) -> Column:
    return in_vocabulary(c, PRICING_CATEGORIES)


def commitment_category(c: Column) -> Column:
    return in_vocabulary(c, COMMITMENT_CATEGORIES)


def commitment_status(c: Column) -> Column:
    return in_vocabulary(c, COMMITMENT_STATUSES)


def money(c: Column) -> Column:
    """Money text to decimal; unreadable amounts count as zero."""
    return F.coalesce(nz(c).try_cast(MONEY), F.lit(0).cast(MONEY))


def number(c: Column) -> Column:
    return nz(c).try_cast("double")


def instant(c: Column) -> Column:
    return nz(c).try_cast("timestamp")


def day(c: Column) -> Column:
    return nz(c).try_cast("date")


def tag_map(c: Column) -> Column:
    """A JSON object of tags as a map; anything else is an empty map."""
    parsed = F.from_json(nz(c), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def valid_tags(c: Column) -> Column:
    """Tags as JSON object text: kept as delivered when well formed, else '{}'."""
    text = nz(c)
    return F.when(F.from_json(text, "map<string,string>").isNotNull(), text).otherwise(F.lit("{}"))


def tags_from_pairs(c: Column) -> Column:
    """An array of (key, value) structs as JSON object text."""
    return F.coalesce(F.to_json(F.map_from_entries(c)), F.lit("{}"))
