"""Pipelines by configuration: stages are registered by name and folded over a DataFrame in the order of a list."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import batching, filters

Stage = Callable[..., DataFrame]
STAGES: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    def add(f: Stage) -> Stage:
        if name in STAGES:
            raise ValueError(f"two stages are named {name}")
        STAGES[name] = f
        return f

    return add


def resolve(name: str) -> Stage:
    """A registered stage, or a function given as module:function; an unknown one raises."""
    if name in STAGES:
        return STAGES[name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"unknown stage: {name}")
    return getattr(importlib.import_module(module), function)


def run(df: DataFrame, steps: Iterable[dict]) -> DataFrame:
    """df through all steps; a step names its stage, its other entries are options."""
    return reduce(lambda x, s: x.transform(resolve(s["stage"]), **{k: v for k, v in s.items() if k != "stage"}), steps, df)


@stage("length_filter")
def _length_filter(df: DataFrame, frames: str, tokens: str, **bounds) -> DataFrame:
    return filters.length_filter(df, F.col(frames), F.col(tokens), **bounds)


@stage("sample")
def _sample(df: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    return batching.sampled(df, key, rate, seed)


@stage("shuffle")
def _shuffle(df: DataFrame, key: str, size: int = batching.SHUFFLE_SIZE, seed: int = 0) -> DataFrame:
    return batching.buffered_shuffle(df, key, size, seed)


@stage("sort")
def _sort(df: DataFrame, key: str, length: str, size: int = batching.SORT_SIZE) -> DataFrame:
    return batching.buffered_sort(df, key, length, size)


@stage("batch")
def _batch(df: DataFrame, kind: str, key: str, **options) -> DataFrame:
    return batching.batches(df, kind, key, **options)


@stage("select")
def _select(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)
