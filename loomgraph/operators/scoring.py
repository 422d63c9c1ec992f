"""Confidence of edges from their evidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructType

from ..functions.graph import confidence_level, lookup

# Weight of each category of evidence, and base times multiplier of the rule for each type.
CATEGORY_WEIGHTS = {"explicit": 1.0, "semantic": 0.9, "structural": 0.8, "syntax": 0.9, "heuristic": 0.6}
RULES = {"depends_on_directive": 40 * 1.2, "explicit_reference": 35 * 1.0, "module_source": 30 * 1.0, "interpolation": 25 * 1.0, "function_call": 20 * 1.0, "label_matching": 25 * 1.0, "naming_convention": 10 * 0.8, "resource_proximity": 5 * 0.7}


def edge_scores(evidence: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """(edge_id, base, multiplier, bonus, penalty, pattern, rules, value, level) from (edge_id, type, category, confidence).

    Everything comes of one aggregate with partial sums. The level is that of
    the score before rounding.
    """
    contribution = lookup(rules if rules is not None else RULES, F.col("type"), 0)
    weighted = F.col("confidence") * lookup(CATEGORY_WEIGHTS, F.col("category"), 1.0)
    by = evidence.groupBy("edge_id").agg(
        F.count("*").alias("n"),
        F.avg(weighted).alias("base"),
        F.count_if(F.col("category") == "explicit").alias("explicit"),
        F.every(F.col("category") == "heuristic").alias("heuristic"),
        F.avg("confidence").alias("average"),
        F.size(F.collect_set("category")).alias("categories"),
        F.size(F.collect_set("type")).alias("types"),
        F.sum(contribution).alias("rules"),
    )
    decay = 0.85
    by = by.withColumns({
        "multiplier": F.least(F.lit(1.5), 1 + 0.1 * decay * (1 - F.pow(F.lit(decay), F.col("n") - 1)) / (1 - decay)),
        "bonus": F.least(F.lit(20), 10 * F.col("explicit")),
        "penalty": F.when(~F.col("heuristic"), 0).when(F.col("average") < 50, 15).otherwise(5),
        "pattern": 5 * ((F.col("categories") >= 2).cast("int") + (F.col("categories") >= 3).cast("int") + (F.col("types") >= 3).cast("int") + (F.col("types") >= 5).cast("int")),
    })
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base") * F.col("multiplier") + F.col("bonus") - F.col("penalty") + F.col("pattern") + 0.1 * F.col("rules")))
    return by.select("edge_id", F.round("base", 6).alias("base"), F.round("multiplier", 6).alias("multiplier"), "bonus", "penalty", "pattern", F.round("rules", 6).alias("rules"), F.round(F.round(score, 9)).alias("value"), confidence_level(F.round(score, 9)).alias("level"))


def scored_edges(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Edges with the confidence of their evidence; without any they keep their own, or 50. Below 80 they are implicit."""
    both = edges.join(scores.select(F.col("edge_id").alias("id"), F.col("value").alias("scored")), "id", "left")
    value = F.coalesce("scored", "confidence", F.lit(50.0))
    return both.withColumn("confidence", value).withColumn("implicit", F.col("confidence") < 80).drop("scored")


def collected(evidence: DataFrame) -> DataFrame:
    """(edge_id, n, average, strongest): evidence of each edge; of equally confident items the one of the greatest id."""
    return evidence.groupBy("edge_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("average"), F.max_by("id", F.struct("confidence", "id")).alias("strongest"))


def merged_scores(scores: DataFrame, key: str) -> DataFrame:
    """(key, value, level): scores weighted by their multipliers."""
    by = scores.groupBy(key).agg((F.sum(F.col("value") * F.col("multiplier")) / F.sum("multiplier")).alias("mean"))
    return by.select(key, F.round("mean").alias("value"), confidence_level(F.round("mean", 9)).alias("level"))


@dataclass(frozen=True)
class Rule:
    """`base` * `multiplier` for each item of evidence of one of `types` that meets all conditions (dotted field, operator, value)."""

    name: str
    types: tuple[str, ...]
    base: float
    multiplier: float = 1.0
    conditions: tuple[tuple[str, str, object], ...] = ()


def _type_at(schema: DataType, field: str) -> DataType | None:
    for part in field.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return None
        schema = schema[part].dataType
    return schema


def meets(evidence: DataFrame, field: str, operator: str, value: object = None) -> Column:
    """Whether a field equals, contains or matches a value, is greater (gt) or less (lt), or exists.

    False for a null, a field that isn't there, an unknown operator, and a
    value of a kind that the operator doesn't take.
    """
    kind = _type_at(evidence.schema, field)
    if kind is None:
        return F.lit(False)
    text, number = isinstance(kind, StringType), isinstance(kind, NumericType)
    given_text, given_number = isinstance(value, str), isinstance(value, (int, float)) and not isinstance(value, bool)
    x = F.col(field)
    found = {
        "equals": lambda: x == value if (text, number) == (given_text, given_number) else F.lit(False),
        "contains": lambda: x.contains(value) if text and given_text else F.lit(False),
        "matches": lambda: x.rlike(value) if text and given_text else F.lit(False),
        "gt": lambda: x > value if number and given_number else F.lit(False),
        "lt": lambda: x < value if number and given_number else F.lit(False),
        "exists": lambda: x.isNotNull(),
    }.get(operator, lambda: F.lit(False))()
    return F.coalesce(found, F.lit(False))


def rule_results(evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """(edge_id, rule, matched, contribution) of each rule that an edge's evidence meets; evidence is read once for all rules."""

    def hit(rule: Rule) -> Column:
        applies = reduce(lambda a, b: a & b, [meets(evidence, *c) for c in rule.conditions], F.col("type").isin(list(rule.types)))
        return F.when(applies, F.struct(F.lit(rule.name).alias("rule"), F.lit(float(rule.base * rule.multiplier)).alias("part")))

    hits = evidence.select("edge_id", F.explode(F.array_compact(F.array(*map(hit, rules)))).alias("h"))
    return hits.groupBy("edge_id", F.col("h.rule").alias("rule")).agg(F.count("*").alias("matched"), F.round(F.sum("h.part"), 6).alias("contribution"))
