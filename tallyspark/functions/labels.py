"""Column-level classification: names, families, identities and resource ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product enums, keyword lists and service names as the sources spell them.
REDSHIFT_SERVICES = ("Amazon Redshift", "Amazon Redshift Spectrum")
S3_SERVICE = "Amazon Simple Storage Service"
EC2_SERVICE = "Amazon Elastic Compute Cloud"

COMPUTE_FAMILIES = {
    "interactive": ("ALL_PURPOSE", "INTERACTIVE", "NOTEBOOKS", "SHARED_SERVERLESS_COMPUTE"),
    "job": ("JOBS", "DLT"),
    "sql_warehouse": ("SQL",),
    "endpoint": ("MODEL_SERVING",),
}
AI_FAMILIES = {
    "model_serving": ("MODEL_SERVING",),
    "vector_search": ("VECTOR_SEARCH",),
    "ai_gateway": ("AI_GATEWAY",),
    "ai_functions": ("AI_FUNCTIONS",),
    "foundation_model_training": ("FOUNDATION_MODEL_TRAINING", "MODEL_TRAINING"),
    "agent_bricks": ("AGENT_BRICKS",),
    "ai_runtime": ("AI_RUNTIME",),
    "agent_evaluation": ("AGENT_EVALUATION",),
    "genie": ("AI_BI_GENIE", "GENIE"),
    "ai_bi_dashboard": ("AI_BI_DASHBOARD", "AI_BI_DASHBOARDS"),
}
# AI products the bill files under another category, and near-AI products that stay out.
AI_EXTRA_SERVICES = ("AI_BI_GENIE", "GENIE", "AI_BI_DASHBOARD", "AI_BI_DASHBOARDS", "MODEL_TRAINING")
AI_EXCLUDED_SERVICES = ("PREDICTIVE_OPTIMIZATION", "LAKEHOUSE_MONITORING", "DATA_QUALITY_MONITORING")
AI_CATEGORY = "AI and Machine Learning"

REDSHIFT_KEYWORDS = {
    "spectrum_scan": ("spectrum", "data scan"),
    "concurrency_scaling": ("concurrency",),
    "storage": ("storage", "backup", "snapshot"),
    "committed": ("unused commitment",),
    "compute": ("compute", "node", "cluster", "instance"),
}
S3_KEYWORDS = {
    "early_delete": ("earlydelete", "early delete", "early deletion"),
    "monitoring": ("monitoring", "automation"),
    "data_transfer": ("datatransfer", "data transfer", "transfer acceleration", "bandwidth"),
    "requests": ("request", "put, copy", "retrieval", "lifecycle transition", "select"),
    "storage": ("timedstorage", "bytehrs", "storage", "sizeoverhead"),
}
SNOWFLAKE_CATEGORIES = {
    "Compute": ("WAREHOUSE_METERING", "CLOUD_SERVICES", "QUERY_ACCELERATION", "SERVERLESS_COMPUTE"),
    "Storage": ("STORAGE",),
    "Networking": ("DATA_TRANSFER", "REPLICATION"),
    AI_CATEGORY: ("AI_SERVICES",),
}
STORAGE_CLOUDS = {
    "AWS": ("s3", "s3a", "s3n"),
    "Microsoft": ("abfss", "abfs", "wasbs"),
    "Google Cloud": ("gs",),
}
# client key -> oldest supported (major, minor, patch)
DRIVER_MINIMUMS = {
    "pythonconnector": (3, 7, 0),
    "snowflakesqlalchemy": (1, 5, 1),
    "go": (1, 7, 2),
    "javascript": (1, 9, 3),
    "jdbc": (3, 14, 5),
    "odbc": (3, 2, 0),
    "dotnetdriver": (2, 2, 0),
    ".netdriver": (2, 2, 0),
    "snowsql": (1, 4, 0),
    "snowflakecli": (2, 4, 0),
    "phppdodriver": (2, 0, 1),
    "snowpark": (1, 0, 0),
    "kafkaconnector": (2, 1, 2),
    "sparkconnector": (2, 14, 0),
}
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def lookup(c: Column, groups: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """The group whose word list holds the value."""
    out = F.lit(default)
    for name, words in reversed(groups.items()):
        out = F.when(c.isin(*words), F.lit(name)).otherwise(out)
    return out


def first_keyword(text: Column, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """Earliest rule with any of its keywords inside the text."""
    out = F.lit(default)
    for name, words in reversed(rules.items()):
        hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def cost_subcategory(service: Column, category: Column, description: Column, sku: Column) -> Column:
    """Usage-mix bucket of a Redshift or S3 charge; credits and commitments are not usage."""
    text = F.lower(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(sku, F.lit(""))))
    redshift = F.nullif(first_keyword(text, REDSHIFT_KEYWORDS, "other"), F.lit("committed"))
    return F.when(F.coalesce(category, F.lit("")) != "Credit",
                  F.when(service.isin(*REDSHIFT_SERVICES), redshift)
                  .when(service == S3_SERVICE, first_keyword(text, S3_KEYWORDS, "other")))


def compute_class(sku: Column) -> Column:
    return F.when(F.upper(sku).contains("SERVERLESS"), "serverless").otherwise("classic")


def compute_family(service: Column) -> Column:
    return lookup(service, COMPUTE_FAMILIES)


def ai_product_family(service: Column) -> Column:
    return lookup(service, AI_FAMILIES)


def is_ai_charge(service: Column, category: Column) -> Column:
    return (~service.isin(*AI_EXCLUDED_SERVICES)) & (
        (category == AI_CATEGORY) | service.isin(*AI_EXTRA_SERVICES)
    )


def fold_tag_key(c: Column) -> Column:
    """Spelling-insensitive tag key: case, padding and '-' versus '_' do not matter."""
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))


def tag_lookup(tags: Column, folded_key: str) -> Column:
    """Value of the first tag whose folded key matches, from a tag map."""
    hits = F.map_filter(tags, lambda k, v: fold_tag_key(k) == folded_key)
    return F.get(F.map_values(hits), F.lit(0))


def strip_reservation_arn(description: Column) -> Column:
    """Replace the first reservation ARN by readable words."""
    return F.regexp_replace(description, r"(?s)^(.*?)arn:aws:\S+", "$1a reservation")


def _captured(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def bucket_of(resource_id: Column) -> Column:
    raw = F.coalesce(_captured(resource_id, "^arn:aws:s3:::([^/]+)"), resource_id)
    return F.nullif(raw, F.lit(""))


def instance_of(resource_id: Column) -> Column:
    raw = F.coalesce(_captured(resource_id, "^arn:aws:ec2:[^:]*:[^:]*:instance/([^/]+)"), resource_id)
    return F.nullif(raw, F.lit(""))


def cluster_of(resource_id: Column) -> Column:
    return F.when(
        resource_id.contains(":cluster:"), F.regexp_extract(resource_id, ":cluster:([^:]+)$", 1)
    ).otherwise("(not assigned to a cluster)")


def folded_identity(c: Column) -> Column:
    return F.lower(F.nullif(F.trim(c), F.lit("")))


def identity_kind(folded: Column, absent: str, present: str = "user") -> Column:
    return (
        F.when(folded.isNull(), absent)
        .when(folded.rlike(UUID), "service_principal")
        .otherwise(present)
    )


def parse_storage_url(url: Column) -> dict[str, Column]:
    """Scheme, billing cloud, bucket and key prefix (NULL prefix means the bucket root)."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    has_authority = raw.contains("://")
    scheme = F.lower(
        F.when(has_authority, F.regexp_extract(raw, "(?s)^(.*?)://", 1))
        .when(raw.contains(":"), F.regexp_extract(raw, "(?s)^([^:]*):", 1))
        .otherwise("other")
    )
    rest = F.regexp_extract(raw, "(?s)://(.*)$", 1)
    bucket = F.when(has_authority, F.nullif(F.regexp_extract(rest, "(?s)^([^/]*)", 1), F.lit("")))
    path = F.trim(F.regexp_extract(rest, "(?s)^[^/]*/(.*)$", 1), F.lit("/"))
    return {
        "scheme": F.when(~has_authority & (scheme == ""), "other").otherwise(scheme),
        "cloud_provider_name": F.when(has_authority, lookup(scheme, STORAGE_CLOUDS)),
        "bucket_name": bucket,
        "key_prefix": F.when(bucket.isNotNull(), F.nullif(path, F.lit(""))),
    }


def version_array(text: Column, pattern: str) -> Column:
    """Three-part version as an array, so comparisons are element by element."""
    return F.array(*[F.regexp_extract(text, pattern, i).try_cast("int") for i in (2, 3, 4)])


def driver_support_status(application: Column) -> Column:
    """'Name X.Y.Z' against the oldest supported version of that driver."""
    pattern = r"(?s)^(.+?)\s+(\d+)\.(\d+)\.(\d+)$"
    text = F.trim(application)
    key = F.lower(F.replace(F.regexp_extract(text, pattern, 1), F.lit(" "), F.lit("")))
    minimums = F.create_map(
        *[x for name, v in DRIVER_MINIMUMS.items()
          for x in (F.lit(name), F.array(*[F.lit(n) for n in v]))]
    )
    minimum = F.try_element_at(minimums, key)
    return (
        F.when(text.rlike(pattern) & minimum.isNotNull(),
               F.when(version_array(text, pattern) >= minimum, "supported").otherwise("unsupported"))
        .otherwise("unknown")
    )
