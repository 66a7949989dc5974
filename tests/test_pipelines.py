"""Pipelines, runner, dependency order, data tests, streaming."""

import sqlite3
import time
from typing import Annotated

import pytest
from pyspark.sql import functions as F

from cairn.entity import Entity, Fact, Identity, Int, Key
from cairn.operators.mapper import Mapper
from cairn.operators.merge import load_snapshot
from cairn.operators.quality import EnsureError, ensure, ensure_now, report_test
from cairn.plans.pipeline import HIGH, LOW, POST, Pipeline, PipelineError
from cairn.plans.runner import CircularDependencyError, cluster, pipeline, report, resolve, run, total_seconds
from cairn.sinks import ListSink, NullSink, TableSink
from cairn.sources.readers import FrameReader
from cairn.streaming import CursorStreamSource, merge_stream


class Line(Fact):
    LineKey: Annotated[Int, Key(), Identity()]
    Id: Int
    Quantity: Int


class A:
    Id: Annotated[Int, Key()]


class B:
    Id: Annotated[Int, Key()]


class C:
    Id: Annotated[Int, Key()]


def mapper():
    return Mapper(Line).map("Id", "Id").map("Quantity", "Quantity").hash("KeyHash", lambda h: h.include("Id")).hash("ChangeHash", lambda h: h.all())


def rows(spark, n=5, q=1):
    return spark.range(n).select(F.col("id").cast("int").alias("Id"), F.lit(q).alias("Quantity"))


def clock():
    return F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")


def to(target, *needs):
    return Pipeline(target=target, sink=NullSink()).depends_on(*needs)


def test_a_pipeline_loads_and_counts(spark, tmp_path):
    sink = TableSink(f"file://{tmp_path}/t", Line)

    def build(n, q):
        return Pipeline.extract(FrameReader(lambda s, args: rows(s, n, q))).transform(lambda df: df.where("Id >= 0")).apply(mapper(), clock()).load(Line, sink, load_snapshot, ["Id"], order=["Id"], as_of=clock())

    first = build(5, 1).invoke(spark)
    assert (first.inserted, first.updated) == (5, 0) and first.blocks[0].name == "Create Data Set"
    p = build(7, 2)
    second = p.invoke(spark)
    assert (second.inserted, second.updated) == (2, 5)
    again = p.invoke(spark)
    assert (again.inserted, again.updated) == (0, 0)
    assert sink.read(spark).where("Quantity = 2").count() == 7


def test_tasks_run_by_priority_and_failures_are_recorded(spark):
    seen, out = [], []
    p = Pipeline.extract(FrameReader(rows(spark))).with_task(lambda s: seen.append("low"), "Low", priority=LOW).with_task(lambda s: seen.append("high"), "Create Index", priority=HIGH)
    p = p.with_task(lambda s: 1 / 0, "Broken", POST).with_task(lambda s: seen.append("post"), "After", POST)
    p.load(A, ListSink(out))
    s = p.invoke(spark)
    assert seen == ["high", "low", "post"] and len(out) == 5
    assert [b.name for b in s.blocks] == ["Create Data Set", "Create Index", "Low", "Load", "Broken", "After"]
    assert not s.succeeded and "ZeroDivisionError" in s.blocks[4].error


def test_rules_of_building(spark):
    p = Pipeline.extract(FrameReader(rows(spark)))
    with pytest.raises(PipelineError):
        p.invoke(spark)
    p.load(A, NullSink())
    with pytest.raises(PipelineError):
        p.transform(lambda df: df)
    with pytest.raises(PipelineError):
        p.load(A, NullSink())
    with pytest.raises(PipelineError):
        Pipeline.extract(FrameReader(rows(spark))).transform(lambda df: 5).load(A, NullSink()).invoke(spark)


def test_parameters_reach_the_reader(spark):
    out: list = []
    p = Pipeline.extract(FrameReader(lambda s, args: s.range(args["BatchSize"] + args["more"]).select(F.col("id").cast("int").alias("Id")))).with_batch_size(3).with_parameter("more", 2)
    p.then_extract(lambda df: df.join(df.sparkSession.range(2).withColumnRenamed("id", "n"), F.lit(True))).transform_batches(lambda b: b[["Id"]], "Id int").load(A, ListSink(out))
    p.invoke(spark)
    assert len(out) == 10


def test_data_tests(spark):
    p = Pipeline.extract(FrameReader(rows(spark, 20))).test(F.col("Id") < 15, "Id").load(A, NullSink())
    p.invoke(spark)
    assert (p.outcomes[0].rows, p.outcomes[0].failed, p.outcomes[0].first_ids) == (20, 5, [15, 16, 17, 18, 19])
    name, seen = p.tests[0]
    assert (seen.get["rows"], seen.get["failed"], seen.get["first"]) == (20, 5, 15)
    got = report_test(rows(spark, 30), F.col("Id") % 2 == 0, "Id")
    assert (got.rows, got.failed, got.first_ids) == (30, 15, list(range(1, 21, 2)))
    assert ensure(rows(spark), F.col("Id") >= 0).count() == 5
    with pytest.raises(EnsureError):
        ensure_now(rows(spark), F.col("Id") > 0)
    with pytest.raises(Exception, match="too small"):
        Pipeline.extract(FrameReader(rows(spark))).ensure(F.col("Id") > 0, "too small").invoke(spark)


@pytest.mark.parametrize(
    "pipelines,groups",
    [([], 0), ([to(A)], 1), ([to(A), to(B)], 1), ([to(B, A), to(A)], 2), ([to(C, B), to(B, A), to(A)], 3), ([to(A, A)], 1), ([to(A), to(A, B), to(B)], 2), ([to(B, A)], 1)],
)
def test_dependency_groups(pipelines, groups):
    got = resolve(pipelines)
    assert len(got) == groups and sum(map(len, got)) == len(pipelines)
    done: set = set()
    own = {p.target for p in pipelines}
    for g in got:
        assert all(d in done or d not in own or d is p.target for p in g for d in p.depends)
        done |= {p.target for p in g}


def test_cycles_are_found():
    for ps in ([to(A, B), to(B, A)], [to(A, B), to(B, C), to(C, A)]):
        with pytest.raises(CircularDependencyError):
            resolve(ps)


def waiting(name):
    @cluster(name)
    class Container:
        @pipeline(tags=["slow"])
        def wait(self):
            return Pipeline.extract(FrameReader(lambda s, a: s.createDataFrame([], "Id int"))).with_task(lambda s: time.sleep(0.5), "Wait").load(A, NullSink())

        @pipeline(tags=["quick"])
        def quick(self):
            return Pipeline.extract(FrameReader(lambda s, a: s.createDataFrame([], "Id int"))).load(B, NullSink())

        def not_one(self):
            return None

    return Container


def test_clusters_run_side_by_side(spark):
    containers = [waiting(f"c{i}")() for i in range(5)]
    run(spark, containers[:1], tags=["slow"], output=None)
    began = time.time()
    got = run(spark, containers, tags=["slow"], output=None)
    assert len(got) == 5 and time.time() - began < 0.8 * sum(s.seconds for s in got)
    assert total_seconds(got) == pytest.approx(max(s.seconds for s in got))
    assert "c3" in report(got) and "Inserts" in report(got)


def test_filters(spark):
    kinds = [waiting("x"), waiting("y")]
    containers = [k() for k in kinds]
    names = lambda **kw: sorted((s.cluster, s.name) for s in run(spark, containers, output=None, **kw))
    assert names(tags=["quick"]) == [("x", "quick"), ("y", "quick")]
    assert names(clusters=["y"], tags=["quick"]) == [("y", "quick")]
    assert names(container=kinds[0], tags=["quick"]) == [("x", "quick")]


def test_errors_are_raised(spark):
    class Bad:
        @pipeline
        def broken(self):
            return Pipeline.extract(FrameReader(lambda s, a: s.sql("SELECT CAST(raise_error('no') AS INT) AS Id"))).load(A, NullSink())

    with pytest.raises(Exception):
        run(spark, [Bad()], output=None)


def test_stream_and_batch_agree(spark, tmp_path):
    for i in range(3):
        rows(spark, 5 + i, i).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        time.sleep(1.1)
    sink = TableSink(f"file://{tmp_path}/t", Line)
    stream = spark.readStream.schema("Id int, Quantity int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = merge_stream(stream, Line, sink, load_snapshot, ["Id"], f"{tmp_path}/check", ["Id"], prepare=lambda df: mapper().apply(df, clock()), as_of=clock())
    q.awaitTermination(120)
    got = sorted((r["Id"], r["Quantity"]) for r in sink.read(spark).collect())
    state = spark.createDataFrame([], Entity.of(Line).schema())
    for i in range(3):
        state = load_snapshot(Line, mapper().apply(rows(spark, 5 + i, i), clock()), state, ["Id"], clock()).next_state(["Id"]).cache()
    assert got == sorted((r["Id"], r["Quantity"]) for r in state.collect()) == [(i, 2) for i in range(7)]


def test_a_batch_that_is_tried_again_adds_nothing(spark, tmp_path):
    from cairn.operators.merge import load_default

    rows(spark, 5).coalesce(1).write.json(f"{tmp_path}/in")
    sink = TableSink(f"file://{tmp_path}/t", Line)
    for _ in range(2):
        # Without its checkpoint's files the stream begins again with batch 0.
        stream = spark.readStream.schema("Id int, Quantity int").json(f"{tmp_path}/in")
        merge_stream(stream, Line, sink, load_default, ["Id"], f"{tmp_path}/check", ["Id"], prepare=lambda df: mapper().apply(df, clock())).awaitTermination(120)
        import shutil

        shutil.rmtree(f"{tmp_path}/check")
    assert sink.read(spark).count() == 5


def test_cursor_stream(spark, tmp_path):
    path = f"{tmp_path}/s.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(1, 26)])
    spark.dataSource.register(CursorStreamSource)

    def go():
        stream = spark.readStream.format(CursorStreamSource.name()).schema("id bigint, name string").options(path=path, query="SELECT * FROM t", cursor="id").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out")

    assert go().count() == 25
    with sqlite3.connect(path) as con:
        con.execute("INSERT INTO t VALUES (26, 'late')")
    assert sorted(r["id"] for r in go().collect()) == list(range(1, 27))
