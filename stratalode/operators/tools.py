"""Tools: named queries with checked arguments. A failure becomes a result, not an exception."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    """A query of the tables: ``run(spark, tables, arguments)``; ``modes`` in which it is offered; JSON-schema parameters."""

    id: str
    label: str
    run: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    modes: tuple[str, ...] = ("chat",)
    parameters: dict = field(default_factory=dict)


class Registry:
    def __init__(self, tools: list[Tool] = ()):
        self._tools: dict[str, Tool] = {}
        for t in tools:
            self.add(t)

    def add(self, tool: Tool) -> None:
        if tool.id in self._tools:
            raise ValueError(f"tool {tool.id} is registered already")
        self._tools[tool.id] = tool

    def catalogue(self, mode: str | None = None) -> list[Tool]:
        return [t for t in self._tools.values() if mode is None or mode in t.modes]

    def enabled(self, mode: str, chosen: list[str]) -> list[str]:
        """Ids offered in a mode among the chosen; Python brings the corpus details that it needs."""
        wanted = set(chosen) | ({"corpus_details"} if "python" in chosen else set())
        return [t.id for t in self.catalogue(mode) if t.id in wanted]

    def definitions(self, ids: list[str]) -> list[dict]:
        return [{"name": t.id, "description": t.label, "parameters": t.parameters} for i in ids if (t := self._tools.get(i))]

    def execute(self, spark: SparkSession, name: str, tables: dict[str, DataFrame], arguments: dict) -> DataFrame:
        """(tool, is_error, content): the result rows as JSON, or one error row."""
        try:
            if name not in self._tools:
                raise KeyError(f"no tool {name}")
            rows = self._tools[name].run(spark, tables, arguments)
            return rows.select(F.lit(name).alias("tool"), F.lit(False).alias("is_error"), F.to_json(F.struct(*rows.columns)).alias("content"))
        except Exception as error:  # the contract of a tool: errors are results
            return spark.createDataFrame([(name, True, str(error))], "tool string, is_error boolean, content string")


def python_tool(rows: DataFrame, code: str, schema: str, *, most_code: int = 24_000) -> DataFrame:
    """Run trusted user code ``transform(pdf) -> pdf`` over batches. Workers are no sandbox: this is for the user's own code only."""
    if len(code) > most_code:
        raise ValueError(f"code is longer than {most_code} characters")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope: dict = {}
        exec(compile(code, "<tool>", "exec"), scope)  # trusted code, see above
        for pdf in batches:
            yield scope["transform"](pdf)

    return rows.mapInPandas(run, schema)


def skill(skills: DataFrame, name: str) -> DataFrame:
    return skills.filter((F.col("name") == name) & F.col("model_invocable"))


def matching_skills(skills: DataFrame, typed: str) -> DataFrame:
    """Skills whose name has the typed text, prefixes first."""
    name, t = F.lower("name"), typed.lower()
    return skills.filter(name.contains(t)).orderBy((~name.startswith(t)).cast("int"), "name")
