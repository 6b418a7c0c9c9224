"""Ordered decision rules as one column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """``outputs`` where ``when`` holds and no rule before it did."""

    name: str
    when: Column
    outputs: dict[str, Column | object] = field(default_factory=dict)


def decide(rows: DataFrame, rules: list[Rule], default: dict[str, Column | object], rule_column: str = "rule") -> DataFrame:
    """``rows`` with the outputs of the first rule that holds, and its name; a null condition doesn't hold. All rules
    make one CASE of structs, so conditions after the first match are not evaluated."""

    def outcome(name: str, values: dict) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(name).alias(rule_column), *[lit(values.get(k, d)).alias(k) for k, d in default.items()])

    out = None
    for r in rules:
        out = F.when(r.when, outcome(r.name, r.outputs)) if out is None else out.when(r.when, outcome(r.name, r.outputs))
    chosen = outcome("default", default) if out is None else out.otherwise(outcome("default", default))
    return rows.withColumn("__d", chosen).select(*rows.columns, "__d.*")


def score_consensus(rows: DataFrame, parts: dict[str, tuple[str, float]], out: str = "conflict") -> DataFrame:
    """``rows`` with the weighted mean of the scores that are present: an absent one weighs neither above nor below
    the line; none present gives 0. ``parts``: name → (column, weight)."""
    top = sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    return rows.withColumn(out, F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0)))
