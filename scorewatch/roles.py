"""Column roles, rules and settings shared by every operator.

Everything here is model-sized Python metadata; data rows never leave
DataFrames.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Comparison operators a rule condition may use.
OPERATORS = (">", ">=", "<", "<=", "==", "!=", "is_null")

# Evidence grades from best to worst.
GRADES = ("Stable", "Local", "Unstable", "Suspicious")

SEED = 42


class ContractError(ValueError):
    """The table does not satisfy its declared column contract."""


@dataclass(frozen=True)
class Roles:
    entity: str
    snapshot: str
    segment: str
    target: str

    @property
    def names(self) -> tuple[str, str, str, str]:
        return (self.entity, self.snapshot, self.segment, self.target)


@dataclass(frozen=True)
class Condition:
    feature: str
    operator: str
    value: float | int | str | None = None

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {self.operator}")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    conditions: tuple[Condition, ...]
    origin: str = "manual"

    @classmethod
    def of(cls, *conditions: tuple, origin: str = "manual") -> Rule:
        """Build a rule with its canonical id from ``(feature, op, value)`` tuples."""
        ordered, text = canonical_conditions(Condition(*c) for c in conditions)
        return cls(rule_id_of(text), ordered, origin)


def canonical_conditions(
    conditions: Iterable[Condition],
) -> tuple[tuple[Condition, ...], str]:
    """Sort conditions and return them with their compact JSON text."""

    def dump(value: object) -> str:
        return json.dumps(value, allow_nan=False, separators=(",", ":"), sort_keys=True)

    ordered = tuple(
        sorted(conditions, key=lambda c: (c.feature, c.operator, dump(c.value)))
    )
    return ordered, dump([vars(c) for c in ordered])


def rule_id_of(expression: str) -> str:
    return hashlib.sha256(expression.encode()).hexdigest()[:12]


@dataclass(frozen=True)
class DiscoveryConfig:
    min_support: float = 0.05
    max_single_rules: int = 100
    beam_width: int = 20
    max_pair_rules: int = 50
    tree_cuts: bool = True
    woe_cuts: bool = False
    woe_max_bins: int = 10
    woe_min_bin_fraction: float = 0.05
    woe_monotonic: str = "none"
    woe_min_iv: float = 0.0
    boosted_cuts: bool = False
    balanced: bool = False


@dataclass(frozen=True)
class ValidationConfig:
    alpha: float = 0.05
    min_segment_consistency: float = 0.6
    max_lift_decay: float = 0.3
    bootstrap_rounds: int = 500
    min_group_size: int = 100


@dataclass(frozen=True)
class Features:
    """Which columns are features: exact list, else catalog list, else prefixes."""

    families: Mapping[str, Sequence[str]] = field(default_factory=dict)
    exact: tuple[str, ...] | None = None
    catalog: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if any(not p for prefixes in self.families.values() for p in prefixes):
            raise ValueError("feature family prefixes must be non-empty")
        if self.exact is not None and (
            not self.exact or len(set(self.exact)) != len(self.exact) or not all(self.exact)
        ):
            raise ValueError("exact column names must be unique and non-empty")

    def select(self, columns: Iterable[str], roles: Roles | None = None) -> list[str]:
        """Sorted feature names, role columns removed; no match means no features."""
        candidates = sorted(set(columns) - set(roles.names if roles else ()))
        wanted = self.exact if self.exact is not None else self.catalog
        if wanted is not None:
            return [c for c in candidates if c in set(wanted)]
        prefixes = tuple(p for group in self.families.values() for p in group)
        return [c for c in candidates if c.startswith(prefixes)] if prefixes else []


def metadata_grade(performance_window_days: int | None, override: str | None = None) -> str:
    """Grade A when the label's performance window is known, else B."""
    return override or ("A" if performance_window_days is not None else "B")


def numeric_columns(schema: T.StructType, names: Iterable[str]) -> list[str]:
    return [n for n in names if isinstance(schema[n].dataType, T.NumericType)]
