"""Pipelines (ORC-1 to ORC-3, ORC-9 to ORC-13): a fluent builder over lazy DataFrames.

    Pipeline.extract(reader).transform(fn).apply(mapper).test(pred, "Id").load(Customer, sink, loader)

Nothing runs before ``invoke``; a pipeline can be invoked again.
"""

from __future__ import annotations

import itertools
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..entity import Entity
from ..operators import quality
from ..operators.mapper import Mapper
from ..operators.merge import LoadResult, load_default, load_scd, load_snapshot, load_transaction
from ..params import ExtractParameter, context, user_parameter
from ..sinks import NullSink, Sink
from ..sources.readers import Reader

HIGH, MEDIUM, LOW = 10, 100, 1000
PRE, POST = "pre", "post"


class PipelineError(ValueError):
    pass


@dataclass(frozen=True)
class Task:
    """ORC-9: run before or after the load, by priority and then in the order added."""

    name: str
    run: Callable[[SparkSession], Any]
    when: str = PRE
    priority: int = MEDIUM
    seq: int = 0


@dataclass
class BlockSummary:
    name: str
    rows: int = 0
    inserted: int = 0
    updated: int = 0
    seconds: float = 0.0
    error: str | None = None


@dataclass
class PipelineSummary:
    """ORC-12."""

    name: str
    container: str
    cluster: str
    group: int
    seconds: float
    blocks: list[BlockSummary]

    @property
    def inserted(self) -> int:
        return sum(b.inserted for b in self.blocks)

    @property
    def updated(self) -> int:
        return sum(b.updated for b in self.blocks)

    @property
    def succeeded(self) -> bool:
        return all(b.error is None for b in self.blocks)


Step = Callable[[SparkSession, DataFrame | None], DataFrame]
_counter = itertools.count()


@dataclass
class Pipeline:
    steps: list[tuple[str, Step]] = field(default_factory=list)
    name: str = "pipeline"
    container: str = ""
    cluster: str = "Default"
    group: int = 0
    depends: set[type] = field(default_factory=set)
    target: type | None = None
    sink: Sink | None = None
    loader: Callable[..., LoadResult] | None = None
    loader_args: dict = field(default_factory=dict)
    natural: list[str] = field(default_factory=list)
    tasks: list[Task] = field(default_factory=list)
    parameters: list[ExtractParameter] = field(default_factory=list)
    batch_size: int = 1000
    tests: list[tuple[str, Observation]] = field(default_factory=list)
    after: list[Callable[[], quality.TestOutcome]] = field(default_factory=list)
    outcomes: list[quality.TestOutcome] = field(default_factory=list)

    # Building
    @classmethod
    def extract(cls, reader: Reader, inline: Callable | None = None) -> Pipeline:
        """The first extract; ``inline`` gets the context and the reader."""
        p = cls()

        def read(spark, _):
            params = context(p.batch_size, user=p.parameters)
            return inline(params, reader) if inline else reader.read(spark, params)

        p.steps.append(("extract", read))
        return p

    def then_extract(self, dependent: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """A further extract, as a function of the upstream rows (a join or a lateral query)."""
        return self._add("extract", lambda spark, df: dependent(df))

    def with_parameter(self, name: str, value: Any) -> Pipeline:
        self.parameters.append(user_parameter(name, value))
        return self

    def with_batch_size(self, n: int) -> Pipeline:
        self.batch_size = n
        return self

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """UDF-1, UDF-2, UDF-4: any function of the rows."""
        return self._add("transform", lambda spark, df: fn(df))

    def transform_batches(self, fn: Callable, schema: str) -> Pipeline:
        """UDF-3: a function of pandas batches, where plain columns won't do; batches follow partitions."""

        def run(batches):
            for b in batches:
                yield fn(b)

        return self._add("transform", lambda spark, df: df.mapInPandas(run, schema))

    def apply(self, mapper: Mapper, as_of: Column | None = None) -> Pipeline:
        """PRJ-10."""
        return self._add("apply", lambda spark, df: mapper.apply(df, as_of))

    def test(self, predicate: Column, identifier: str, name: str = "test", level: int = logging.WARNING, max_log_count: int = quality.MAX_LOG_COUNT) -> Pipeline:
        """FLT-5: rows pass; after the load the failing ones are counted and up to ``max_log_count`` ids logged."""

        def run(spark, df):
            out, seen = quality.observe_test(df, f"{name}_{next(_counter)}", predicate, identifier)
            self.tests.append((name, seen))
            self.after.append(lambda: quality.log_failures(df, seen, predicate, identifier, level, max_log_count) if completed(spark, seen) else quality.TestOutcome(0, 0, []))
            return out

        return self._add("test", run)

    def ensure(self, predicate: Column, message: str = "a row failed a test") -> Pipeline:
        """Ends the pipeline in no sink; a failing row raises."""
        self._add("ensure", lambda spark, df: quality.ensure(df, predicate, message))
        self.sink = NullSink()
        return self

    def depends_on(self, *entities: type) -> Pipeline:
        self.depends.update(entities)
        return self

    def with_task(self, run: Callable[[SparkSession], Any], name: str, when: str = PRE, priority: int = MEDIUM) -> Pipeline:
        self.tasks.append(Task(name, run, when, priority, len(self.tasks)))
        return self

    def truncate(self) -> Pipeline:
        """SNK-9."""
        return self.with_task(lambda spark: self.sink.truncate(spark), "Truncate Table", PRE, HIGH)

    def load(self, entity: type, sink: Sink, loader: Callable[..., LoadResult] = load_default, natural: list[str] | None = None, **loader_args) -> Pipeline:
        """The target entity, its sink and how rows are merged into it."""
        if self.target is not None:
            raise PipelineError("a pipeline has one load")
        self.target, self.sink, self.loader, self.loader_args = entity, sink, loader, loader_args
        self.natural = natural or []
        return self

    def _add(self, kind: str, step: Step) -> Pipeline:
        if self.target is not None or self.sink is not None:
            raise PipelineError(f"{kind} after the load")
        self.steps.append((kind, step))
        return self

    # Running
    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows that would be loaded."""
        if not self.steps:
            raise PipelineError("a pipeline starts with an extract")
        df = None
        for kind, step in self.steps:
            df = step(spark, df)
            if not isinstance(df, DataFrame):
                raise PipelineError(f"{kind} gave {type(df).__name__}, not a DataFrame")
        return df

    def invoke(self, spark: SparkSession) -> PipelineSummary:
        if self.sink is None:
            raise PipelineError("a pipeline needs a load or an ensure")
        began, blocks = time.time(), []
        self.tests, self.after = [], []
        create = Task("Create Data Set", lambda s: self.sink.create(s, Entity.of(self.target)), PRE, 1) if self.target else None
        tasks = ([create] if create else []) + self.tasks
        for task in sorted((t for t in tasks if t.when == PRE), key=lambda t: (t.priority, t.seq)):
            blocks.append(self._task(spark, task))
        blocks.append(self._load(spark))
        self.outcomes = [report() for report in self.after]
        for task in sorted((t for t in tasks if t.when == POST), key=lambda t: (t.priority, t.seq)):
            blocks.append(self._task(spark, task))
        return PipelineSummary(self.name, self.container, self.cluster, self.group, time.time() - began, blocks)

    @staticmethod
    def _task(spark: SparkSession, task: Task) -> BlockSummary:
        """A failed task is recorded; the run goes on."""
        began, error = time.time(), None
        try:
            task.run(spark)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        return BlockSummary(task.name, seconds=time.time() - began, error=error)

    def _load(self, spark: SparkSession) -> BlockSummary:
        began = time.time()
        df = self.frame(spark)
        if self.target is None:
            df.write.format("noop").mode("overwrite").save()
            return BlockSummary("Ensure", seconds=time.time() - began)
        seen = Observation(f"extracted_{next(_counter)}")
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        target = self.sink.read(spark) if self.loader in (load_scd, load_snapshot, load_transaction) else None
        result = self.loader(self.target, df, target, **self.loader_args) if self.loader is not load_default else load_default(self.target, df)
        ins, ups = Observation(f"inserted_{next(_counter)}"), Observation(f"updated_{next(_counter)}")
        result = replace(result, inserts=result.inserts.observe(ins, F.count(F.lit(1)).alias("n")))
        if result.updates is not None:
            result = replace(result, updates=result.updates.observe(ups, F.coalesce(F.sum("_updates"), F.lit(0)).alias("n")))
        if result.target is None:
            self.sink.insert(result.inserts)
        else:
            self.sink.commit(spark, result, self.natural)
        updated = observed(spark, ups) if result.updates is not None else 0
        return BlockSummary("Load", rows=observed(spark, seen), inserted=observed(spark, ins), updated=updated, seconds=time.time() - began)


def completed(spark: SparkSession, seen: Observation) -> bool:
    """Whether an action has brought an observation's numbers, once all that it reported has been taken in."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    row = seen._jo.getRowOrEmpty()
    return bool(row.isDefined() and row.get().length())


def observed(spark: SparkSession, seen: Observation) -> int:
    """An observation's number; none where the optimiser found that there are no rows, and dropped it."""
    return int(seen.get["n"] or 0) if completed(spark, seen) else 0
