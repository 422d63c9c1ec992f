"""Technical debt: summaries and what to do first, from (id, category, priority, status, hours, file_path, created_at, resolved_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import lookup

# Weight of each priority, and of categories that count for more.
PRIORITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
BOOSTS = {"security-debt": 1.5, "design-debt": 1.2}


def is_open() -> Column:
    return F.col("status").isin("open", "in-progress")


def totals_by(debt: DataFrame, key: str) -> DataFrame:
    """(key, items, hours): all items, and the hours of the open ones."""
    return debt.groupBy(key).agg(F.count("*").alias("items"), F.round(F.sum(F.when(is_open(), F.col("hours")).otherwise(0.0)), 6).alias("hours"))


def summary(debt: DataFrame, now: str) -> DataFrame:
    """One row: open items and their hours, items added and resolved in the 30 days before `now`, and the net change."""
    since = F.lit(now).cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    row = debt.agg(F.count_if(is_open()).alias("items"), F.round(F.sum(F.when(is_open(), F.col("hours")).otherwise(0.0)), 6).alias("hours"), F.count_if(F.col("created_at") >= since).alias("added"), F.count_if(F.col("resolved_at") >= since).alias("resolved"))
    return row.withColumn("net", F.col("added") - F.col("resolved"))


def top_files(debt: DataFrame, n: int = 10) -> DataFrame:
    """(file_path, items, hours): the files with most open hours, ties by path."""
    return totals_by(debt, "file_path").orderBy(F.desc("hours"), "file_path").limit(n)


def prioritized(debt: DataFrame, n: int = 20) -> DataFrame:
    """(id, score): the open items of the highest scores, ties by id: ten times priority and category, over the hours."""
    score = 10 * lookup(PRIORITIES, F.col("priority"), 0) * lookup(BOOSTS, F.col("category"), 1) / F.greatest(F.lit(1.0), "hours")
    return debt.filter(is_open()).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def quick_wins(debt: DataFrame, hours: float = 2, n: int = 10) -> DataFrame:
    """(id, priority, hours): open items of the two upper priorities that take `hours` at most, by priority, hours and id."""
    chosen = debt.filter(is_open() & (F.col("hours") <= hours) & F.col("priority").isin("critical", "high"))
    return chosen.orderBy(F.desc(lookup(PRIORITIES, F.col("priority"), 0)), "hours", "id").select("id", "priority", "hours").limit(n)
