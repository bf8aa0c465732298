"""Pipelines of stages, and any function on one collection entry at a time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


class Stage:
    """transform(df), optionally fit(df), resample(df) for targets and inverse_transform(df)."""

    def fit(self, df: DataFrame):
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def resample(self, target: DataFrame) -> DataFrame:
        return target

    def transform_resample(self, df: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.transform(df), self.resample(target)

    def fit_transform_resample(self, df: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.fit(df).transform_resample(df, target)

    def plot_data(self, df: DataFrame, key: str, sample) -> DataFrame:
        return df.filter(df[key] == sample)


class Function(Stage):
    def __init__(self, f: Callable[[DataFrame], DataFrame], resample: Callable[[DataFrame], DataFrame] | None = None, inverse: Callable[[DataFrame], DataFrame] | None = None):
        self.f, self._resample, self._inverse = f, resample, inverse

    def transform(self, df: DataFrame) -> DataFrame:
        return self.f(df)

    def resample(self, target: DataFrame) -> DataFrame:
        return self._resample(target) if self._resample else target

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self._inverse is None:
            raise ValueError("this stage has no inverse")
        return self._inverse(df)


class Pipeline(Stage):
    """Stages one after the other; the result is one lazy plan. Targets pass through the same stages' resample."""

    def __init__(self, steps: list[tuple[str, Stage | Callable]]):
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise ValueError("names of steps repeat")
        self.steps = [(n, s if isinstance(s, Stage) else Function(s)) for n, s in steps]

    def __getitem__(self, name: str) -> Stage:
        return dict(self.steps)[name]

    def fit(self, df: DataFrame) -> Pipeline:
        for _, s in self.steps:
            df = s.fit_transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, s in self.steps:
            df = s.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for _, s in self.steps:
            df = s.fit_transform(df)
        return df

    def resample(self, target: DataFrame) -> DataFrame:
        for _, s in self.steps:
            target = s.resample(target)
        return target

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for _, s in reversed(self.steps):
            df = s.inverse_transform(df)
        return df


def make_pipeline(*stages) -> Pipeline:
    """Steps named after their functions or classes, numbered where names repeat."""
    names: list[str] = []
    for s in stages:
        base = getattr(s, "__name__", type(s).__name__).lower()
        k = sum(n == base or n.startswith(f"{base}-") for n in names)
        names.append(f"{base}-{k + 1}" if k else base)
    return Pipeline(list(zip(names, stages, strict=True)))


def union_of(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Results of several branches on the same input, not joined."""
    return [b(df) for b in branches]


def for_each_entry(df: DataFrame, by: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f on each entry of a collection independently."""
    return df.groupBy(by).applyInPandas(f, schema)
