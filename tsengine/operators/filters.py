"""Filters between features and model: each is a function of a DataFrame, chained in the order given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.operators import monitor, windows

Filter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """A filter by name and arguments, so that it can be saved with a model; any other function of a DataFrame is a filter, too."""

    name: str
    args: tuple = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        return STEPS[self.name](df, *self.args)


def _names(columns: list, features: list[str]) -> list[str]:
    return [features[c] if isinstance(c, int) else c for c in columns]


def drop_features(columns: list, features: list[str]) -> Filter:
    """By name, or by 0-based place among the features."""
    return Step("drop", (tuple(_names(columns, features)),))


def nullify_features(columns: list | None, features: list[str]) -> Filter:
    return Step("nullify", (tuple(_names(columns or [], features)),))


def drop_unlabelled(label: str) -> Filter:
    """For training only."""
    return Step("drop_unlabelled", (label,))


def fill_zero(columns: list[str]) -> Filter:
    return Step("fill_zero", (tuple(columns),))


def interpolate_linear(columns: list[str]) -> Filter:
    return Step("interpolate", (tuple(columns), False))


def interpolate_extrapolate(columns: list[str]) -> Filter:
    return Step("interpolate", (tuple(columns), True))


def standard_scaler(columns: list[str]) -> Filter:
    return Step("standard_scaler", (tuple(columns),))


def _each(df: DataFrame, columns, trailing: bool) -> DataFrame:
    for c in columns:
        df = windows.interpolate(df, c, trailing=trailing)
    return df


def _scale(df: DataFrame, columns) -> DataFrame:
    scaled = monitor.standardize(df, list(columns))
    return scaled.select(*(F.col(f"{c}_z").alias(c) if c in columns else F.col(c) for c in df.columns))


STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop": lambda df, columns: df.drop(*columns),
    "nullify": lambda df, columns: df.withColumns({c: F.lit(None).cast("double") for c in columns}),
    "drop_unlabelled": lambda df, label: df.filter(F.col(label).isNotNull()),
    "fill_zero": lambda df, columns: df.fillna(0.0, subset=list(columns)),
    "interpolate": _each,
    "standard_scaler": _scale,
}


def to_specs(filters: list[Filter]) -> list[dict]:
    """Filters as plain values; a function that has no name here can't be saved."""
    if not all(isinstance(f, Step) for f in filters):
        raise ValueError("only named filters can be saved with a model")
    return [{"name": f.name, "args": [list(a) if isinstance(a, tuple) else a for a in f.args]} for f in filters]


def from_specs(specs: list[dict]) -> list[Filter]:
    if unknown := [s["name"] for s in specs if s["name"] not in STEPS]:
        raise ValueError(f"unknown filters: {unknown}")
    return [Step(s["name"], tuple(tuple(a) if isinstance(a, list) else a for a in s["args"])) for s in specs]


def chain(df: DataFrame, filters: list[Filter]) -> DataFrame:
    for f in filters:
        df = df.transform(f)
    return df
