"""Verification and detection of data that are no DataFrame, through what their store can answer itself."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from .discover import field_constraints
from .model import Constraint, DatasetConstraints
from .profile import ColumnProfile
from .verify import Verification, as_constraints, holds


class Calculator(ABC):
    """What a store of data must answer, so that constraints can be discovered and verified on it."""

    @abstractmethod
    def types(self) -> dict[str, str]:
        """Columns in their order, with their logical types."""

    @abstractmethod
    def profile(self, name: str) -> ColumnProfile:
        """Statistics of one column; ``n_distinct`` and ``values`` where the store has them."""

    def violations(self, name: str, constraint: Constraint) -> int:
        """How many values break an ``allowed_values`` or ``rex`` constraint, or a bool type on text."""
        raise NotImplementedError(f"{type(self).__name__} doesn't count violations of {constraint.kind}")


class Detector(ABC):
    """A store that can also mark records that break constraints."""

    @abstractmethod
    def detect(self, failing: Iterable[tuple[str, Constraint]]):
        """Marks records, and returns what the verification's ``detection`` is to be: with ``n_passing``, ``n_failing``."""


def _needs_count(c: Constraint, kind: str) -> bool:
    return c.value is not None and (c.kind == "allowed_values" or c.kind == "rex" and kind == "string" or c.kind == "type" and kind == "string" and "bool" in (c.value if isinstance(c.value, list) else [c.value]))


def discover_with(store: Calculator) -> DatasetConstraints | None:
    """Constraints that a store's own statistics satisfy."""
    found = [f for n in store.types() if (f := field_constraints(store.profile(n)))]
    return DatasetConstraints(found) if found else None


def verify_with(store: Calculator, constraints, epsilon: float | None = None, type_checking: str = "sloppy", report: str = "all") -> Verification:
    """Verification by a store's answers; one that is a ``Detector`` marks the records that break what fails."""
    constraints, types = as_constraints(constraints), store.types()
    order = {n: i for i, n in enumerate(types)}
    results: dict[str, dict[str, bool | None]] = {}
    profiles = {f.name: store.profile(f.name) for f in constraints if f.name in types}
    for f in sorted(constraints, key=lambda f: order.get(f.name, -1)):
        counted = {c.kind: store.violations(f.name, c) for c in f if f.name in types and _needs_count(c, types[f.name])}
        results[f.name] = {c.kind: holds(c, profiles.get(f.name), counted.get(c.kind), epsilon or 0.0, type_checking) for c in f}
    out = Verification(results, report, profiles=profiles)
    failing = [(n, constraints[n][k]) for n, kinds in results.items() if n in types for k, r in kinds.items() if r is False]
    if failing and isinstance(store, Detector):
        out.detection = store.detect(failing)
    return out
