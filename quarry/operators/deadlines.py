"""Deadlines: a tool's or a statement's jobs carry a tag and are cancelled when its time is over; others go on."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from quarry.operators import tools
from quarry.session import cut

#: Milliseconds that a statement may be given.
LEAST_MS, MOST_MS = 1, 30_000


@dataclass
class Outcome:
    status: str
    result: DataFrame | None
    seconds: float


def run_within(spark: SparkSession, seconds: float, work: Callable[[], DataFrame]) -> Outcome:
    """ok, timeout or error of a plan that is built and run to its end in time; the result is read from checkpoint files.

    The work has a thread of its own, whose jobs all carry one tag. What ends after its time is a timeout even if it ended well.
    """
    context = spark.sparkContext
    tag = f"quarry-{uuid.uuid4().hex}"
    ended: dict[str, object] = {}

    def body() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            ended["result"] = cut(spark, work())
        except Exception as e:  # what the tool raises stays inside; the caller learns that it failed
            ended["error"] = e

    began = time.monotonic()
    thread = InheritableThread(target=body)
    thread.start()
    thread.join(seconds)
    over = thread.is_alive()
    while thread.is_alive():  # between two jobs there is nothing to cancel: the next one is met in the next round
        context.cancelJobsWithTag(tag)
        thread.join(0.2)
    took = time.monotonic() - began
    if over or took > seconds:
        return Outcome("timeout", None, took)
    return Outcome("error", None, took) if "error" in ended else Outcome("ok", ended["result"], took)


def statement(spark: SparkSession, sql: str, timeout_ms: int) -> Outcome:
    """A statement under its timeout, from 1 to 30,000 ms."""
    if not LEAST_MS <= timeout_ms <= MOST_MS:
        raise ValueError(f"a timeout is {LEAST_MS} to {MOST_MS} ms")
    return run_within(spark, timeout_ms / 1000, lambda: spark.sql(sql))


def call(spark: SparkSession, name: str, run: Callable[[], DataFrame], roles: tuple[str, ...], market: str | None = None, timeout_s: float | None = None) -> Outcome:
    """A tool's outcome: registered, permitted, then run within its seconds (`tools.TOOLS`, or fewer if the caller says so)."""
    status, _ = tools.call(name, lambda: None, roles, market)
    if status != "ok":
        return Outcome(status, None, 0.0)
    most = next(t for t in tools.TOOLS if t.name == name).timeout_s
    return run_within(spark, min(most, timeout_s or most), run)


def call_all(spark: SparkSession, calls: dict[str, tuple[Callable[[], DataFrame], tuple[str, ...], str | None]], timeout_s: float | None = None) -> dict[str, Outcome]:
    """Several tools at once, each under its own deadline: one that is late takes nobody along."""
    out: dict[str, Outcome] = {}

    def one(name: str) -> None:
        run, roles, market = calls[name]
        out[name] = call(spark, name, run, roles, market, timeout_s)

    threads = [InheritableThread(target=one, args=(n,)) for n in calls]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out
