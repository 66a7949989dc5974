"""Runner (ORC-4 to ORC-8, ORC-12): discovery, dependency order, clusters side by side, a summary."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from .pipeline import Pipeline, PipelineSummary

DEFAULT_CLUSTER = "Default"


class CircularDependencyError(ValueError):
    pass


def pipeline(fn: Callable | None = None, *, tags: Iterable[str] = ()):
    """ORC-6: marks a method that builds a pipeline."""

    def mark(f):
        f._pipeline_tags = tuple(tags)
        return f

    return mark(fn) if fn else mark


def cluster(name: str):
    """ORC-7: the cluster of a container class."""

    def mark(cls):
        cls._cluster = name
        return cls

    return mark


def resolve(pipelines: list[Pipeline]) -> list[list[Pipeline]]:
    """ORC-4: groups in which each pipeline's dependencies come in earlier groups.

    Pipelines with one target are one node; a dependency on itself does not count.
    """
    if not pipelines:
        return []
    nodes: dict[object, set] = {}
    own: dict[object, list[Pipeline]] = {}
    for i, p in enumerate(pipelines):
        node = p.target if p.target is not None else ("no target", i)
        own.setdefault(node, []).append(p)
        nodes.setdefault(node, set()).update(d for d in p.depends if d is not node)
        for d in p.depends:
            nodes.setdefault(d, set())
    left = {n: set(d) for n, d in nodes.items()}
    groups = []
    while left:
        free = [n for n, d in left.items() if not d]
        if not free:
            raise CircularDependencyError("Circular dependency detected")
        group = [p for n in free for p in own.get(n, [])]
        if group:
            groups.append(group)
        for n in free:
            del left[n]
        for d in left.values():
            d.difference_update(free)
    return groups


def discover(containers: Iterable[object], tags: Iterable[str] = (), clusters: Iterable[str] = ()) -> dict[str, list[Pipeline]]:
    """Pipelines of container objects, by cluster; no filter means all."""
    wanted_tags, wanted_clusters = set(tags), set(clusters)
    found: dict[str, list[Pipeline]] = {}
    for c in containers:
        name = getattr(type(c), "_cluster", DEFAULT_CLUSTER)
        if wanted_clusters and name not in wanted_clusters:
            continue
        for attribute in dir(type(c)):
            method = getattr(type(c), attribute)
            marks = getattr(method, "_pipeline_tags", None)
            if marks is None or (wanted_tags and not wanted_tags & set(marks)):
                continue
            p = getattr(c, attribute)()
            p.name, p.container, p.cluster = attribute, type(c).__name__, name
            found.setdefault(name, []).append(p)
    return found


def run(spark: SparkSession, containers: Iterable[object], tags: Iterable[str] = (), clusters: Iterable[str] = (), container: type | None = None, output: Callable[[str], None] | None = print) -> list[PipelineSummary]:
    """ORC-5, ORC-8: clusters side by side, each in a scheduler pool of its own; in a cluster, one pipeline after another."""
    chosen = [c for c in containers if container is None or isinstance(c, container)]
    by_cluster = {name: resolve(ps) for name, ps in discover(chosen, tags, clusters).items()}
    done: dict[str, list[PipelineSummary]] = {name: [] for name in by_cluster}
    failed: list[BaseException] = []

    def one(name: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            for number, group in enumerate(by_cluster[name], 1):
                for p in group:
                    p.group = number
                    done[name].append(p.invoke(spark))
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    threads = [InheritableThread(target=one, args=(name,)) for name in by_cluster]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    summaries = [s for name in sorted(done) for s in done[name]]
    if output:
        output(report(summaries))
    return summaries


def total_seconds(summaries: list[PipelineSummary]) -> float:
    """AGG-5: the longest cluster, its pipelines summed."""
    by: dict[str, float] = {}
    for s in summaries:
        by[s.cluster] = by.get(s.cluster, 0.0) + s.seconds
    return max(by.values(), default=0.0)


def report(summaries: list[PipelineSummary]) -> str:
    """ORC-12: a table of runs."""
    head = ("Cluster", "Group", "Container", "Pipeline", "Runtime", "Inserts", "Updates", "Status")
    rows = [(s.cluster, str(s.group), s.container, s.name, f"{int(s.seconds) // 60:02d}:{int(s.seconds) % 60:02d}", str(s.inserted), str(s.updated), "ok" if s.succeeded else "failed") for s in summaries]
    wide = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in [head, *rows]]
    return "\n".join([*lines, f"Total runtime {total_seconds(summaries):.1f} s"])
