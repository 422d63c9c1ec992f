"""Column functions on external object ids: ARNs, cloud resource ids, their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an ARN in a text looks like, and what cloud resource ids look like.
ARN_IN_TEXT = r"""arn:[a-z-]+:[a-z0-9-]+:[a-z0-9-]*:[0-9]*:[^\s"'}\]]+"""
AWS_ID = r"(i|vol|snap|ami|vpc|subnet|sg|rtb|igw|nat|eni|acl|eipalloc|lt|asg)-[0-9a-f]{8,17}"
GCP_LINK, AZURE_ID = r"https://www\.googleapis\.com/compute/v1/projects/", r"/subscriptions/[0-9a-f-]+/"


def arns(text: Column) -> Column:
    """All ARNs in a text."""
    return F.regexp_extract_all(text, F.lit(f"({ARN_IN_TEXT})"), F.lit(1))


def arn_parts(arn: Column) -> Column:
    """(partition, service, region, account, resource, resource_type, resource_id); null for other texts."""
    parts = F.split(arn, ":", 6)
    resource = parts[5]
    kind = F.nullif(F.regexp_extract(resource, r"^([^/:]+)[/:]", 1), F.lit(""))
    own = F.regexp_replace(resource, r"^[^/:]+[/:]", "")
    made = F.struct(parts[1].alias("partition"), parts[2].alias("service"), parts[3].alias("region"), parts[4].alias("account"), resource.alias("resource"), kind.alias("resource_type"), own.alias("resource_id"))
    return F.when(arn.rlike(r"^arn:[^:]*:[^:]*:[^:]*:[^:]*:."), made)


def normal_arn(arn: Column) -> Column:
    """Without region and account, in lower case; other texts are trimmed and lowered."""
    p = arn_parts(arn)
    return F.when(p.isNotNull(), F.lower(F.concat(F.lit("arn:"), p["partition"], F.lit(":"), p["service"], F.lit(":::"), p["resource"]))).otherwise(F.lower(F.trim(arn)))


def arn_of(resource_type: Column, name: Column, region: Column, account: Column) -> Column:
    """The ARN of a resource by its type and name, * for an unknown region or account; null for types without one and nameless resources."""
    place = F.concat(F.coalesce(region, F.lit("*")), F.lit(":"), F.coalesce(account, F.lit("*")), F.lit(":"))
    whole = lambda service, middle, kind: F.concat(F.lit(f"arn:aws:{service}:"), middle, F.lit(kind), name)
    own = F.concat(F.lit(":"), F.coalesce(account, F.lit("*")), F.lit(":"))
    chain = (
        F.when(resource_type == "aws_s3_bucket", whole("s3", F.lit("::"), ""))
        .when(resource_type == "aws_iam_role", whole("iam", own, "role/"))
        .when(resource_type == "aws_iam_policy", whole("iam", own, "policy/"))
        .when(resource_type == "aws_lambda_function", whole("lambda", place, "function:"))
        .when(resource_type == "aws_dynamodb_table", whole("dynamodb", place, "table/"))
        .when(resource_type == "aws_sqs_queue", whole("sqs", place, ""))
        .when(resource_type == "aws_sns_topic", whole("sns", place, ""))
    )
    return F.when(F.length(name) > 0, chain)


def arn_confidence(a: Column, b: Column, region: bool = False, account: bool = False) -> Column:
    """0 unless service and resource agree; else the share of partition, service and resource that do, and of region and account where they count."""
    x, y = arn_parts(a), arn_parts(b)
    counted = ["partition", *["region"] * region, *["account"] * account]
    alike = (x["resource"] == y["resource"]) | (x["resource_type"].eqNullSafe(y["resource_type"]) & (x["resource_id"] == y["resource_id"]))
    return F.when((x["service"] == y["service"]) & alike, F.round(100 * (2 + sum(((x[c] == y[c]).cast("int") for c in counted), F.lit(0))) / (2 + len(counted)))).otherwise(0.0)


def arn_regex(pattern: Column) -> Column:
    """A regular expression for an ARN pattern, in which * stands for any text."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))


def provider_of(resource_id: Column) -> Column:
    """aws, gcp, azure or unknown."""
    return F.when(resource_id.rlike(rf"^({AWS_ID}|cluster/[a-zA-Z0-9_-]+)$"), "aws").when(resource_id.rlike(rf"^(projects/|{GCP_LINK})"), "gcp").when(resource_id.rlike(f"^{AZURE_ID}"), "azure").otherwise("unknown")


def resource_ids(text: Column) -> Column:
    """Distinct cloud resource ids in a text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (rf"\b{AWS_ID}\b", rf"{GCP_LINK}[^\s\"']+", rf"{AZURE_ID}resourceGroups/[^\s\"']+")]
    return F.array_distinct(F.concat(*found))


def reference_hash(kind: Column, identifier: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit(":"), F.lower(identifier)), 256)
