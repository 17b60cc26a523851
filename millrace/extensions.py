"""Registries of what a caller may add: stages, mixing strategies, quality evaluators and source adapters.

Each entry is a function over DataFrames or Columns, so what is added runs as
part of the same plan. A name is given once; unknown names raise with the known
ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame

F_ = TypeVar("F_", bound=Callable)


class Registry(Generic[F_]):
    """Functions of one kind by name."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str) -> Callable[[F_], F_]:
        """A decorator that adds a function under ``name``."""

        def add(function: F_) -> F_:
            if name in self._known:
                raise ValueError(f"{self.kind} {name!r} is registered twice")
            self._known[name] = function
            return function

        return add

    def __getitem__(self, name: str) -> F_:
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name!r}; known: {', '.join(self)}")
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._known))

    def __contains__(self, name: str) -> bool:
        return name in self._known


#: (DataFrame, **params) -> DataFrame.
STAGES: Registry[Callable[..., DataFrame]] = Registry("stage")
#: (documents, key, stratum, total, **params) -> DataFrame of the rows drawn.
STRATEGIES: Registry[Callable[..., DataFrame]] = Registry("mixing strategy")
#: Column of text -> Column of a score from 0 to 1.
EVALUATORS: Registry[Callable[..., Column]] = Registry("quality evaluator")
#: (raw JSON Column, Source) -> Column of a record.
ADAPTERS: Registry[Callable[..., Column]] = Registry("source adapter")


def run_stages(df: DataFrame, stages: list[dict]) -> DataFrame:
    """Stages given as ``{"name": .., "params": {..}}`` one after the other; all names are looked up before any runs."""
    steps = [(STAGES[s["name"]], s.get("params") or {}) for s in stages]
    return reduce(lambda rows, step: rows.transform(step[0], **step[1]), steps, df)
