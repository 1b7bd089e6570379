"""Models: named components whose DataFrames feed one another; sinks are what runs.

A component is a function of the context. Nothing is computed until a sink asks: Spark plans the whole
chain of components below it as one job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rasterloom.functions.parameters import arithmetic, resolved, step_index
from rasterloom.sources.stored import stored


@dataclass
class Component:
    name: str
    work: Callable[[Context], DataFrame | None]
    level: int = 0  #: components of higher levels run first
    sink: bool = False
    parameters: dict[str, list] = field(default_factory=dict)
    policy: str = "use_up"


@dataclass
class Context:
    spark: SparkSession
    settings: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    step: int = 1
    current: Component | None = None
    log: list[tuple] = field(default_factory=list)

    def parameter(self, name: str):
        """The current component's parameter at this step, with its expressions replaced."""
        values = self.current.parameters[name]
        value = values[step_index(self.current.policy, self.step, len(values), self.step)]
        return resolved(value, self.settings, self.tables, {self.current.name: self.step}) if isinstance(value, str) else value


def run(context: Context, components: list[Component], iterations: int | str = 1, keep_every: int = 8) -> dict[str, DataFrame]:
    """Runs the components level by level in each iteration. The number of iterations may be an expression, which is read anew at each step.

    Results stand in context.tables under their names. Every keep_every steps they are stored, so plans
    don't grow with the number of steps.
    """
    context.step = 1
    while context.step <= (iterations if isinstance(iterations, int) else int(float(arithmetic(resolved(iterations, context.settings, context.tables))))):
        for c in sorted(components, key=lambda c: -c.level):
            context.current = c
            begun = time.time()
            out = c.work(context)
            if out is not None:
                context.tables[c.name] = stored(out) if c.sink or context.step % keep_every == 0 else out
            written = context.tables[c.name].count() if out is not None and c.sink else None
            context.log.append((context.step, c.name, c.level, begun, time.time(), written))
        context.step += 1
    return context.tables


def provenance(context: Context) -> DataFrame:
    """step, component, level, begun and ended of each activity, and the rows that it wrote if it is a sink."""
    return context.spark.createDataFrame(context.log, "step int, component string, level int, begun double, ended double, rows long")


def each_step(steps: list, work: Callable[..., DataFrame]) -> DataFrame:
    """Independent steps side by side: their plans are united and Spark runs their tasks together."""
    out = None
    for s in steps:
        df = work(s)
        out = df if out is None else out.unionByName(df)
    return out
