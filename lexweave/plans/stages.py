"""Pipelines as lists of named stages, and registries that modules extend.

A stage is a function from a table to a table. Stages whose results are worth keeping are written, and a run can
begin after any of them again.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text


@dataclass(frozen=True)
class Stage:
    name: str
    step: Callable[[DataFrame], DataFrame]
    saved: bool = False


@dataclass(frozen=True)
class Pipeline:
    """Stages in order; every change gives a new pipeline. Names are unique, and an unknown one raises ``ValueError``."""

    stages: tuple[Stage, ...] = ()

    def place(self, name: str) -> int:
        for i, s in enumerate(self.stages):
            if s.name == name:
                return i
        raise ValueError(f"unknown stage {name!r}; known: {', '.join(s.name for s in self.stages)}")

    def _with(self, at: int, stage: Stage) -> Pipeline:
        if any(s.name == stage.name for s in self.stages):
            raise ValueError(f"there is a stage {stage.name!r} already")
        return Pipeline((*self.stages[:at], stage, *self.stages[at:]))

    def add(self, name: str, step: Callable[[DataFrame], DataFrame], saved: bool = False) -> Pipeline:
        return self._with(len(self.stages), Stage(name, step, saved))

    def before(self, other: str, stage: Stage) -> Pipeline:
        return self._with(self.place(other), stage)

    def after(self, other: str, stage: Stage) -> Pipeline:
        return self._with(self.place(other) + 1, stage)

    def without(self, name: str) -> Pipeline:
        at = self.place(name)
        return Pipeline((*self.stages[:at], *self.stages[at + 1 :]))

    def moved(self, name: str, before: str) -> Pipeline:
        return self.without(name).before(before, self.stages[self.place(name)])

    def replaced(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        at = self.place(name)
        return Pipeline((*self.stages[:at], replace(self.stages[at], step=step), *self.stages[at + 1 :]))

    def run(self, rows: DataFrame | None, folder: str | None = None, after: str | None = None, last: str | None = None, spark: SparkSession | None = None) -> DataFrame:
        """The result of the stages up to ``last``. Saved ones are written below ``folder``; with ``after``, the run begins from what that stage wrote."""
        first = 0
        if after is not None:
            first, rows = self.place(after) + 1, (spark or rows.sparkSession).read.parquet(f"{folder}/{after}")
        for stage in self.stages[first : self.place(last) + 1 if last else None]:
            rows = stage.step(rows)
            if stage.saved and folder:
                rows.write.mode("overwrite").parquet(f"{folder}/{stage.name}")
                rows = rows.sparkSession.read.parquet(f"{folder}/{stage.name}")
        return rows


#: Features of an observation by name: functions of its columns. New ones can be added.
FEATURES: dict[str, Callable[..., Column]] = {
    "word": lambda w: F.lower(w), "shape": lambda w: text.word_shape(w), "prefix3": lambda w: F.substring(F.lower(w), 1, 3), "suffix3": lambda w: F.right(F.lower(w), F.lit(3)), "length": lambda w: F.least(F.length(w), F.lit(10)).cast("string"),
}


def features(observations: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Observations with ``features``: ``name=value`` of each feature that is not null, in the order of the names."""
    parts = [F.when(FEATURES[n](F.col(column)).isNotNull(), F.concat(F.lit(f"{n}="), FEATURES[n](F.col(column)))) for n in names]
    return observations.withColumn("features", F.filter(F.array(*parts), lambda x: x.isNotNull()))


@dataclass
class Registries:
    """What a module may extend."""

    features: dict = field(default_factory=lambda: FEATURES)
    readers: dict = field(default_factory=lambda: importlib.import_module("lexweave.sources.readers").READERS)
    drivers: dict = field(default_factory=lambda: importlib.import_module("lexweave.sources.readers").DRIVERS)
    writers: dict = field(default_factory=lambda: importlib.import_module("lexweave.sources.sinks").FORMS)
    patterns: dict = field(default_factory=lambda: importlib.import_module("lexweave.plans.patterns").COMPILERS)


def load_module(name: str) -> None:
    """Imports a module and lets its ``register(registries)`` extend the library; a module without one raises ``ValueError``."""
    module = importlib.import_module(name)
    if not hasattr(module, "register"):
        raise ValueError(f"{name} has no function register")
    module.register(Registries())
