"""Pivots: utility, allocation under a budget, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import half_even

# How specific an identifier's type is.
SPECIFICITY = {"email": 1.0, "phone": 0.85, "tracker": 2.5, "ns": 0.25, "org": 0.9, "name": 0.35}


def utility(kind: Column, score: Column, checks: int = 3, rounded: bool = False) -> Column:
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv]), kind), F.lit(0.2))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * weight / calls(kind, checks)
    return half_even(value, 6) if rounded else value


def calls(kind: Column, checks: int = 3) -> Column:
    return F.when(kind == "tracker", 1 + max(0, checks)).otherwise(1)


def gap(kind: Column) -> Column:
    return F.when(kind.isin("org", "name"), "corporate_control").otherwise("asset_discovery")


def first_occurrences(candidates: DataFrame) -> DataFrame:
    """Of each (domain, id_type, value) the candidate that came first."""
    from .evidence import first_of

    return first_of(candidates, ["domain", "id_type", "value"], "ord")


def allocate(pivots: DataFrame, k: int, checks: int = 3, rounded: bool = True) -> DataFrame:
    """Of each domain the ``k`` chosen pivots: the best of either gap first (assets before control), then by utility."""
    x = pivots.withColumn("evidence_gap", gap(F.col("id_type"))).withColumn("utility", utility(F.col("id_type"), F.col("score"), checks, rounded))
    order = [F.desc("utility"), F.desc("score"), "id_type", "value"]
    x = x.withColumn("g", F.row_number().over(Window.partitionBy("domain", "evidence_gap").orderBy(*order)))
    lead = F.when(F.col("g") == 1, F.when(F.col("evidence_gap") == "asset_discovery", 0).otherwise(1)).otherwise(2)
    x = x.withColumn("slot", F.row_number().over(Window.partitionBy("domain").orderBy(lead, *order)))
    return x.where(F.col("slot") <= k).drop("g")


def escalated(pivots: DataFrame, strong: float = 0.75) -> DataFrame:
    """Domains without a strong pivot, which a model may be asked about."""
    return pivots.groupBy("domain").agg(F.max("score").alias("best")).where(F.col("best") < strong)
