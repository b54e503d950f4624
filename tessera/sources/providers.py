"""Calls to outside services behind one interface, with deterministic stand-ins.

A provider is a picklable object with ``answer(prompts) -> answers``; it runs once
per Arrow batch on the executors. Filter before calling: the optimizer does not
know what a call costs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


class Provider(Protocol):
    def answer(self, prompts: Sequence[str | None]) -> list[str | None]: ...


@dataclass(frozen=True)
class Echo:
    prefix: str = ""

    def answer(self, prompts: Sequence[str | None]) -> list[str | None]:
        return [None if p is None else self.prefix + p for p in prompts]


class ProviderFailed(RuntimeError):
    """A provider kept failing."""


@dataclass(frozen=True)
class Retrying:
    """A provider that is asked up to ``attempts`` times, ``wait`` seconds apart; the last failure is passed on."""

    provider: Provider
    attempts: int = 3
    wait: float = 5.0

    def answer(self, prompts: Sequence[str | None]) -> list[str | None]:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.provider.answer(prompts)
            except Exception as e:
                if attempt == self.attempts:
                    raise ProviderFailed(f"{self.attempts} attempts failed") from e
                time.sleep(self.wait)
        raise ValueError("at least one attempt is needed")


def complete(df: DataFrame, provider: Provider, column: str = "prompt", out: str = "answer") -> DataFrame:
    """``df`` with the provider's answers to ``column``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(provider.answer(prompts), pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _vectorised(execute: Callable[[str], str]):
    def run(args: pd.Series) -> pd.Series:
        return args.map(execute, na_action="ignore")

    return pandas_udf(run, "string")


@dataclass
class Tool:
    """A named function of a JSON text, with its domain and parameter schema."""

    name: str
    domain: str
    description: str
    execute: Callable[[str], str]
    parameters: dict = field(default_factory=dict)


class Tools:
    """Tools in the order of their registration; a name is taken once."""

    def __init__(self, *tools: Tool) -> None:
        self.by_name: dict[str, Tool] = {}
        for t in tools:
            self.by_name.setdefault(t.name, t)

    def register(self, spark: SparkSession) -> None:
        """Each tool as a vectorised SQL function."""
        for t in self.by_name.values():
            spark.udf.register(t.name, _vectorised(t.execute))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.name, t.domain, t.description) for i, t in enumerate(self.by_name.values(), 1)]
        return spark.createDataFrame(rows, "ord int, name string, domain string, description string")

    def call(self, name: str, args: str) -> str:
        found = self.by_name.get(name)
        return found.execute(args) if found else f"unknown tool: {name}"
