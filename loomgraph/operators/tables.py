"""Filters, lookups, pages, and writes that replace, merge or append rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenant_rows(df: DataFrame, tenant: str | None) -> DataFrame:
    """The tenant's rows; none without a tenant."""
    return df.filter(F.col("tenant_id") == tenant) if tenant else df.limit(0)


def child_rows(child: DataFrame, parent: DataFrame, key: str, parent_key: str, tenant: str | None) -> DataFrame:
    """The rows of a child table whose parent row is the tenant's."""
    return child.join(tenant_rows(parent, tenant).select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def where(df: DataFrame, equal: dict | None = None, among: dict | None = None, like: dict | None = None, least: dict | None = None, most: dict | None = None) -> DataFrame:
    """Conjunction of conditions; a null value means IS NULL, an empty list no condition."""
    found: list[Column] = [F.col(c).isNull() if v is None else F.col(c) == v for c, v in (equal or {}).items()]
    found += [F.col(c).isin(list(v)) for c, v in (among or {}).items() if v]
    found += [F.col(c).ilike(f"%{v}%") for c, v in (like or {}).items()]
    found += [F.col(c) >= v for c, v in (least or {}).items()] + [F.col(c) <= v for c, v in (most or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def of_kinds(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, column: str = "type") -> DataFrame:
    """Rows whose kind is among `include` and not among `exclude`; an empty list is no condition."""
    if include:
        df = df.filter(F.col(column).isin(include))
    return df.filter(~F.col(column).isin(exclude)) if exclude else df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50, total: str = "total_count") -> DataFrame:
    """Rows of a page, each with the number of all rows, which is counted apart so that no window holds all rows."""
    count = df.agg(F.count("*").alias(total)).withColumn("_one", F.lit(1))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(count), "_one").drop("_one")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def field(column: str, path: str, kind: str = "string") -> Column:
    """A field of a JSON column; null where it is missing or no `kind`."""
    return F.get_json_object(column, f"$.{path}").try_cast(kind)


def last_of(new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the greatest by the columns `order` (by default all others), then by all others."""
    others = [c for c in new.columns if c not in keys]
    if not others:
        return new.distinct()
    by = F.struct(*(order or []), *others)
    return new.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("_v")).select(*[F.col(c) if c in keys else F.col(f"_v.{c}") for c in new.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """`old` with the rows of `new`: columns of `update` (all by default) of rows that exist are replaced, others appended. Of several new rows with one key that of `last_of` counts."""
    update = update if update is not None else [c for c in old.columns if c not in keys]
    o, n = old.withColumn("_o", F.lit(True)), last_of(new, keys, order).select(*old.columns).withColumn("_n", F.lit(True))
    both = o.alias("o").join(n.alias("n"), keys, "full_outer")
    pick = lambda c: F.when(F.col("_o").isNull() | (F.col("_n") & F.lit(c in update)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*[F.col(c) if c in keys else pick(c) for c in old.columns])


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row (inserted, updated): the keys of `new` that an upsert adds, and those that it finds."""
    known = old.select(*keys, F.lit(True).alias("_known")).distinct()
    return new.select(*keys).distinct().join(known, keys, "left").agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count("_known").alias("updated"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` rows whose key `old` lacks, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def update_values(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """`column` replaced for the keys in `updates` (key, column)."""
    changed = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return df.join(changed, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*df.columns)


def rows_of_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The elements of a JSON array as typed rows."""
    return df.select(F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def unnest_rows(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows of parallel arrays."""
    return df.select(F.explode(F.arrays_zip(*arrays)).alias("r")).select("r.*")


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that the condition doesn't hold for; where it is null they stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
