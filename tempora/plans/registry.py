"""Features as functions of a context, their dependencies and their hashes."""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame


class FeatureRegistryError(Exception):
    """What goes wrong with a registry."""


class FeatureNotFoundError(FeatureRegistryError):
    """No feature of that name."""


class CyclicDependencyError(FeatureRegistryError):
    """Features that wait for one another."""


class DuplicateFeatureError(FeatureRegistryError):
    """A name that is taken."""


@dataclass
class FeatureContext:
    """What features are computed from. `custom` keeps lazy plans that several features share."""

    observations: DataFrame | None = None
    prices: DataFrame | None = None
    splits: DataFrame | None = None
    catalog: Any = None
    custom: dict[str, Any] = field(default_factory=dict)

    def resolve_prices(self) -> DataFrame:
        if self.prices is not None:
            return self.prices
        if self.catalog is not None:
            return self.catalog.query("SELECT * FROM fact_market_ohlcv_raw")
        raise ValueError("neither prices nor a catalog are given")

    def resolve_splits(self) -> DataFrame | None:
        if self.splits is not None:
            return self.splits
        if self.catalog is not None:
            return self.catalog.query("SELECT sec_id, ex_date, split_ratio, known_from FROM fact_corporate_actions WHERE action_type = 'SPLIT'")
        return None


ComputeFn = Callable[[FeatureContext], DataFrame]


@dataclass(frozen=True)
class FeatureDefinition:
    name: str
    compute_fn: ComputeFn
    version: str = "1.0.0"
    dependencies: tuple[str, ...] = ()
    description: str = ""
    tags: tuple[str, ...] = ()

    def __call__(self, ctx: FeatureContext) -> DataFrame:
        return self.compute_fn(ctx)

    def compute_hash(self) -> str:
        """"sha256:" and the digest of name, version, dependencies and source without white space."""
        try:
            source = inspect.getsource(self.compute_fn)
        except (OSError, TypeError):
            source = getattr(self.compute_fn, "__qualname__", repr(self.compute_fn))
        parts = [self.name, self.version, ",".join(sorted(self.dependencies)), re.sub(r"\s+", "", source)]
        return "sha256:" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


class FeatureRegistry:
    def __init__(self) -> None:
        self._features: dict[str, FeatureDefinition] = {}

    def register(
        self, feature: FeatureDefinition | ComputeFn | None = None, *, name: str | None = None, version: str = "1.0.0", dependencies: Sequence[str] = (), compute_fn: ComputeFn | None = None,
        description: str = "", tags: Sequence[str] = (), overwrite: bool = False,
    ):
        """Add a definition or a function and return its definition, which is callable; without one, a decorator."""

        def add(fn: ComputeFn) -> FeatureDefinition:
            made = FeatureDefinition(name or fn.__name__, fn, version, tuple(dependencies), description or (fn.__doc__ or "").strip(), tuple(tags))
            self._add(made, overwrite)
            return made

        if feature is None:
            return add if compute_fn is None else add(compute_fn)
        if isinstance(feature, FeatureDefinition):
            feature = replace(feature, name=name or feature.name, dependencies=tuple(dependencies) or feature.dependencies, tags=tuple(tags) or feature.tags)
            self._add(feature, overwrite)
            return feature
        return add(feature)

    def _add(self, feature: FeatureDefinition, overwrite: bool) -> None:
        if feature.name in self._features and not overwrite:
            raise DuplicateFeatureError(feature.name)
        self._features[feature.name] = feature

    def get(self, name: str) -> FeatureDefinition:
        if name not in self._features:
            raise FeatureNotFoundError(name)
        return self._features[name]

    def has(self, name: str) -> bool:
        return name in self._features

    def list_features(self) -> list[str]:
        return sorted(self._features)

    def clear(self) -> None:
        self._features.clear()

    def execution_order(self, targets: Sequence[str]) -> list[FeatureDefinition]:
        """The targets and all they need, dependencies first, ties by name."""
        needs: dict[str, set[str]] = {}
        todo = list(targets)
        while todo:
            n = todo.pop()
            if n not in needs:
                needs[n] = set(self.get(n).dependencies)
                todo += needs[n]
        out: list[FeatureDefinition] = []
        while needs:
            ready = sorted(n for n, d in needs.items() if not d & needs.keys())
            if not ready:
                raise CyclicDependencyError(", ".join(sorted(needs)))
            out.append(self._features[ready[0]])
            del needs[ready[0]]
        return out

    def hashes(self, names: Sequence[str] | None = None) -> dict[str, str]:
        return {n: self.get(n).compute_hash() for n in (names or self.list_features())}


_GLOBAL = FeatureRegistry()


def global_registry() -> FeatureRegistry:
    return _GLOBAL


def register(*args, **options):
    return _GLOBAL.register(*args, **options)
