"""Work at whole multiples of an interval: checkpoints, monitors, upkeep."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import stats
from tidegraph.operators.maintain import ticks_between
from tidegraph.plans.graph import Graph, Relation
from tidegraph.sources import checkpoint
from tidegraph.unions import union

log = logging.getLogger(__name__)

#: What is measured of a relation: name -> one row of numbers.
Monitor = Callable[[Relation], DataFrame]


def _quantiles(relation: Relation) -> DataFrame:
    found = stats.length_quantiles(stats.node_counts(relation.edges))
    return found.agg(*[F.max(F.when(F.col("q") == q, F.col("length"))).alias(f"p{q}") for q in range(10, 101, 10)])


#: The monitors every relation has; others are added to a Monitors object by name.
STANDARD: dict[str, Monitor] = {
    "relation": lambda r: stats.relation_stats(r.edges),
    "length": lambda r: stats.average_length(stats.node_counts(r.edges)),
    "quantiles": _quantiles,
    "nodes": lambda r: r.nodes.agg(F.count("*").alias("count"), F.sum("degree").alias("degree")),
}


class Monitors:
    """Measures of all relations of a graph as rows (relation, monitor, name, value)."""

    def __init__(self, graph: Graph, **more: Monitor):
        self.graph, self.monitors = graph, {**STANDARD, **more}

    def add(self, name: str, monitor: Monitor) -> Monitors:
        if name in self.monitors:
            raise ValueError(f"monitor {name!r} is already known")
        self.monitors[name] = monitor
        return self

    def run(self) -> DataFrame:
        out = None
        for relation, own in self.graph.relations.items():
            for monitor, measure in self.monitors.items():
                row = measure(own)
                pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns]))
                each = row.select(F.lit(relation).alias("relation"), F.lit(monitor).alias("monitor"), pairs.alias("p")).select("relation", "monitor", "p.*")
                out = each if out is None else union(out, each)
        if out is None:
            return self.graph.spark.createDataFrame([], "relation string, monitor string, name string, value double")
        return out


@dataclass
class Scheduler:
    """Jobs (interval in seconds, function of the time) that run when a multiple of their interval has passed.

    tick(now) runs what is due since the last tick, each job once; start() ticks in a thread of its own.
    A job that fails is logged and due again at its next multiple.
    """

    jobs: dict[str, tuple[int, Callable[[int], object]]] = field(default_factory=dict)
    last: int | None = None

    def every(self, interval: int, name: str, job: Callable[[int], object]) -> Scheduler:
        if interval < 1 or name in self.jobs:
            raise ValueError("an interval is positive and a job's name new")
        self.jobs[name] = (interval, job)
        return self

    def tick(self, now: int) -> list[str]:
        """The names of the jobs that ran."""
        before, self.last = now if self.last is None else self.last, now
        ran = []
        for name, (interval, job) in self.jobs.items():
            if ticks_between(before, now, interval) > 0:
                try:
                    job(now)
                    ran.append(name)
                except Exception:
                    log.exception("job %s failed at %d", name, now)
        return ran

    def start(self, clock: Callable[[], float] = time.time, pause: float = 1.0) -> Callable[[], None]:
        """Tick every `pause` seconds until the returned function is called."""
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(pause):
                self.tick(int(clock()))

        self.tick(int(clock()))
        thread = threading.Thread(target=loop, daemon=True)
        thread.start()

        def end() -> None:
            stop.set()
            thread.join()

        return end


def checkpoint_job(graph: Graph, root: str) -> Callable[[int], None]:
    """Saves all relations of a graph as the version named by the time."""
    return lambda now: checkpoint.save(root, now, {name: (r.edges, r.nodes) for name, r in graph.relations.items()}, now)


def upkeep_job(graph: Graph, relation: str, interval: int) -> Callable[[int], None]:
    """Expires, decays and makes room in a relation."""

    def run(now: int) -> None:
        kept = graph.relations[relation].expire(now).decay(now - interval, now)
        graph.relations[relation] = kept.stored()

    return run
