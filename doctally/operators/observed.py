"""Figures taken while a plan runs: named observations on its steps, the time that a user's model takes for each call, and a listener that gathers what a stream's batches observed.

Nothing is counted in a pass of its own: the figures come with the action that uses the rows. An observed plan must run as a whole (a write, a count); what a limit cuts off was not seen.
"""

from __future__ import annotations

import threading
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Funnel:
    """Rows of each step of a plan: rows = funnel.step(rows, "sentences"), ...; after an action on the last, funnel.figures()."""

    def __init__(self):
        self.steps: dict[str, Observation] = {}

    def step(self, rows: DataFrame, name: str, **figures: Column) -> DataFrame:
        self.steps[name] = Observation(name)
        return rows.observe(self.steps[name], F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in figures.items()))

    def figures(self) -> dict[str, dict]:
        return {name: dict(o.get) for name, o in self.steps.items()}

    def reductions(self) -> dict[str, float]:
        """By how much each step is smaller than the one before it."""
        counts = [(name, x["rows"]) for name, x in self.figures().items()]
        return {name: round(1 - n / max(before, 1), 4) for (_, before), (name, n) in zip(counts, counts[1:], strict=False)}


def timed_calls(rows: DataFrame, call, inputs: tuple[str, ...], kind: str, into: str = "result") -> DataFrame:
    """rows with `into`, what a user's function of Series gives, and millis: what the call took for each row of its batch."""

    def run(given: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        out = call(*(given[c] for c in inputs))
        took = (time.perf_counter() - began) * 1000 / max(len(out), 1)
        return pd.DataFrame({into: out, "millis": took})

    run.__annotations__ = {"given": pd.DataFrame, "return": pd.DataFrame}
    made = F.pandas_udf(run, f"{into} {kind}, millis double").asNondeterministic()(F.struct(*inputs))
    return rows.withColumn("_call", made).select(*rows.columns, f"_call.{into}", "_call.millis")


def latency(rows: DataFrame, funnel: Funnel, name: str = "latency") -> DataFrame:
    """Observe the times of timed_calls: calls, their sum, mean and largest."""
    return funnel.step(rows, name, total=F.sum("millis"), mean=F.avg("millis"), largest=F.max("millis"))


class Gathered(StreamingQueryListener):
    """Observed figures of all batches of all queries of a session: spark.streams.addListener(Gathered())."""

    def __init__(self):
        self.lock, self.batches = threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            for name, row in event.progress.observedMetrics.items():
                self.batches.setdefault((str(event.progress.id), name), {})[event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self, name: str) -> dict[str, float]:
        """Sums of an observation's figures over batches, each once."""
        out: dict[str, float] = {}
        with self.lock:
            for (_, n), batches in self.batches.items():
                for row in batches.values() if n == name else ():
                    for k, v in row.items():
                        out[k] = out.get(k, 0) + (v or 0)
        return out
