"""Retrieve-and-filter definitions on a stream.

A definition that only retrieves, filters and returns has append-only results, so its plan runs unchanged on a
streaming source; aggregates per subject run in update mode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from ..engine import Engine
from ..sources.model import Model


def on_stream(model: Model, entity: str, source: Callable[[], DataFrame]) -> Model:
    """The model with one entity read from a streaming DataFrame."""
    out = Model(model.name)
    out.entities, out.aliases = dict(model.entities), dict(model.aliases)
    out.entities[entity] = replace(model.entities[entity], load=source)
    return out


def evaluate_stream(engine: Engine, entity: str, source: Callable[[], DataFrame], text: str, name: str) -> DataFrame:
    """A definition as a streaming DataFrame, for writeStream."""
    live = Engine(engine.spark, on_stream(engine.model, entity, source), engine.terminology, engine.resolver, engine.externals, engine.now)
    return live.evaluate(text, name)
