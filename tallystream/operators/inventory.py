"""Resources: listings, costs, placement and permissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME_PARTS = ("organization", "project", "environment", "namespace", "kind", "name")


def listed(resources: DataFrame, equal: dict[str, str] | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Resources whose columns and tags equal the wanted ones, in name order."""
    rows = resources
    for column, value in (equal or {}).items():
        rows = rows.filter(F.col(column) == value)
    for tag, value in (tags or {}).items():
        rows = rows.filter(F.col("tags")[tag] == value)
    return rows.orderBy(*NAME_PARTS)


def route(catalog: DataFrame, name: dict[str, str], shard: int) -> DataFrame:
    """The tablet of a shard of a resource that is named by all its parts (columns, ``shard``, ``tablet``)."""
    missing = set(NAME_PARTS) - set(name)
    if missing:
        raise ValueError(f"the name lacks {sorted(missing)}")
    rows = catalog
    for part in NAME_PARTS:
        rows = rows.filter(F.col(part) == name[part])
    return rows.filter(F.col("shard") == shard)


def cost_attribution(resources: DataFrame) -> DataFrame:
    """Resources and shards of each cost center and classification; ungoverned ones are unassigned."""
    center, kind = F.coalesce("cost_center", F.lit("unassigned")), F.coalesce("classification", F.lit("unspecified"))
    rows = resources.groupBy(center.alias("cost_center"), kind.alias("classification"))
    return rows.agg(F.count("*").alias("resources"), F.sum("shards").cast("bigint").alias("shards")).orderBy("cost_center", "classification")


def engine_resources(parts: dict[str, DataFrame]) -> DataFrame:
    """The resources of all kinds, by ``kind:name``."""
    rows = None
    for kind, part in parts.items():
        one = part.select(F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("resource", F.concat_ws(":", "kind", "name")).orderBy("resource")


def health(resources: DataFrame) -> DataFrame:
    """One row: how many resources there are, and their kinds in order."""
    return resources.agg(F.count("*").alias("resources"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.lit("ok").alias("status"))


#: Voters of a cluster at most.
MAX_VOTERS = 64


def admitted(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Placement requests (``request``, ``region``, ``node_class``, ``min_zones``, ``added``) with ``decision``.

    All voters must be in the region and of the class (null allows any), span
    the zones, and have room; the first reason that fails is given.  The voters
    of a cluster are at most ``MAX_VOTERS`` and become constants of the plan.
    """
    found = nodes.select("node_region", "zone", "class", "available").limit(MAX_VOTERS + 1).collect()
    if not 1 <= len(found) <= MAX_VOTERS:
        raise ValueError(f"a cluster has 1 to {MAX_VOTERS} voters")
    ok = lambda wanted, has: F.coalesce(F.col(wanted) == F.lit(has), F.lit(True)) if has is not None else F.lit(True)
    eligible = reduce(lambda a, b: a & b, [ok("region", region) & ok("node_class", kind) for region, kind in {(r["node_region"], r["class"]) for r in found}])
    zones, room = len({r["zone"] for r in found} - {None}), min((r["available"] for r in found if r["available"] is not None), default=None)
    sums = requests.withColumn("eligible", eligible).withColumn("zones", F.lit(zones).cast("bigint")).withColumn("room", F.lit(room).cast(nodes.schema["available"].dataType))
    reason = F.when(~F.col("eligible"), "fixed_voters_ineligible").when(F.col("zones") < F.col("min_zones"), "insufficient_zones").when((F.col("added") > 0) & (F.col("room") < F.col("added")), "consensus_group_capacity").otherwise("admitted")
    return sums.select("request", "zones", "room", reason.alias("decision"))


def allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests with ``allowed``: whether a grant of the principal has the action and covers the scope; null in a grant covers all."""

    def covers(part: str) -> Column:
        return F.col(f"_{part}").isNull() | (F.col(f"_{part}") == F.col(part))

    renamed = grants.select(F.col("principal").alias("_principal"), F.col("action").alias("_action"), *[F.col(p).alias(f"_{p}") for p in ("organization", "project")])
    condition = (F.col("principal") == F.col("_principal")) & (F.col("action") == F.col("_action")) & covers("organization") & covers("project")
    hits = requests.join(renamed, condition, "left_semi").withColumn("allowed", F.lit(True))
    return hits.unionByName(requests.join(renamed, condition, "left_anti").withColumn("allowed", F.lit(False)))
