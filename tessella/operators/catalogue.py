"""The rule dimension: id, default severity, category, tags, tier, kind, needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    tags: tuple[str, ...]
    confidence: str
    needs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    typed: bool = False
    strict_null: bool = False


_RULES: dict[str, Rule] = {}

SCHEMA = "rule_id string, severity string, category string, tags array<string>, confidence string, needs array<string>, typed boolean, strict_null boolean, rule_order int"


def rule(rule_id: str, severity: str, category: str, tags: str, confidence: str = "proven", needs: tuple[str, ...] = (), typed: bool = False, strict_null: bool = False):
    """Registers a function from fact tables to diagnostics; other packages may add their own."""

    def add(f: Callable[[dict[str, DataFrame]], DataFrame]):
        _RULES[rule_id] = Rule(rule_id, severity, category, tuple(tags.split()), confidence, needs, f, typed, strict_null)
        return f

    return add


def all_rules() -> dict[str, Rule]:
    """Every registered rule by id, in registration order."""
    from tessella.operators import rules_cross, rules_node  # noqa: F401  (registration)

    return dict(_RULES)


def metadata(rule_id: str) -> Rule:
    """The rule's metadata; an unknown id is an error."""
    found = all_rules()
    if rule_id not in found:
        raise KeyError(f"no metadata for rule {rule_id!r}")
    return found[rule_id]


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(r.rule_id, r.severity, r.category, list(r.tags), r.confidence, list(r.needs), r.typed, r.strict_null, i) for i, r in enumerate(all_rules().values())]
    return spark.createDataFrame(rows, SCHEMA)
