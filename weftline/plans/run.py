"""Running stages: a ledger of attempts, retries of transient failures, preflight, tables kept while they are needed."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.validate import Assertion


class Changed(RuntimeError):
    """The program of a run isn't the one that it was begun with."""


LEDGER = "run string, stage string, attempt int, state string, error string, start double, end double"


@dataclass
class Runner:
    """Writes each stage's result as a table under ``folder`` and remembers it, so that a restarted run goes on behind it."""

    spark: SparkSession
    folder: str
    run: str
    retries: int = 2
    transient: Sequence[str] = ("OutOfMemory", "ConnectionReset", "timed out")
    wait: float = 0.0
    rows: list[tuple] = field(default_factory=list)
    users: dict[str, set[str]] = field(default_factory=dict)
    program: str | None = None
    retained: set[str] = field(default_factory=set)
    edges: set[tuple[str, str]] = field(default_factory=set)
    finish: Callable[[str], None] | None = None

    def __post_init__(self) -> None:
        """A run that was begun with another program (its canonical text) isn't gone on with."""
        if self.program is None:
            return
        mark = hashlib.sha256(self.program.encode()).hexdigest()
        fs, p = self._fs(f"{self.folder}/{self.run}/_program-{mark}")
        parent = p.getParent()
        old = [str(x.getPath().getName()) for x in fs.listStatus(parent)] if fs.exists(parent) else []
        if others := [n for n in old if n.startswith("_program-") and n != p.getName()]:
            raise Changed(f"run {self.run} was begun with another program ({others[0][9:21]}, now {mark[:12]})")
        if p.getName() not in old:
            fs.create(p, True).close()

    def expect(self, edges: Sequence[tuple[str, str]]) -> None:
        """All (producer, consumer) pairs of the program: a producer's table stays until every consumer is done."""
        for producer, consumer in edges:
            self.edges.add((producer, consumer))
            if not self.done(consumer):
                self.users.setdefault(producer, set()).add(consumer)

    def path(self, stage: str) -> str:
        return f"{self.folder}/{self.run}/{stage}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def done(self, stage: str) -> bool:
        fs, p = self._fs(f"{self.path(stage)}/_SUCCESS")
        return fs.exists(p)

    def stage(self, name: str, make: Callable[[], DataFrame], inputs: Sequence[str] = ()) -> DataFrame:
        """The stage's table; an assertion is never retried, a failure whose text matches ``transient`` is."""
        for i in inputs:
            self.users.setdefault(i, set()).add(name)
        attempt = 0
        while not self.done(name):
            start, state, error = time.time(), "complete", None
            try:
                make().write.mode("overwrite").parquet(self.path(name))
            except Exception as e:
                state, error = ("assert" if isinstance(e, Assertion) or "ASSERT:" in str(e) else "failed"), str(e)[:2000]
                again = state == "failed" and attempt < self.retries and any(re.search(p, error) for p in self.transient)
                if not again:
                    raise
            finally:
                self.rows.append((self.run, name, attempt, state, error, start, time.time()))
            attempt += 1
            if error:
                time.sleep(self.wait)
        for i in inputs:
            self.users[i].discard(name)
        return self.spark.read.parquet(self.path(name))

    def reclaim(self) -> list[str]:
        """Deletes the tables whose users have all finished and that aren't retained."""
        gone = [s for s, left in self.users.items() if not left and s not in self.retained]
        for s in gone:
            fs, p = self._fs(self.path(s))
            fs.delete(p, True)
            del self.users[s]
        return gone

    def ledger(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, LEDGER)

    def save(self) -> DataFrame:
        """Adds this session's ledger to the run's ledger table, and gives that table: attempts of all sessions."""
        path = f"{self.folder}/{self.run}/_ledger"
        self.ledger().coalesce(1).write.mode("append").parquet(path)
        self.rows.clear()
        return self.spark.read.schema(LEDGER).parquet(path)

    def program_stages(self, bodies: dict[str, Callable[..., DataFrame]], edges: Sequence[tuple[str, str]], order: Sequence[str]) -> dict[str, DataFrame]:
        """Runs a program's stages in order: each body gets its producers' tables by name."""
        self.expect(edges)
        made: dict[str, DataFrame] = {}
        for name in order:
            inputs = [a for a, b in edges if b == name]
            made[name] = self.stage(name, lambda name=name, inputs=inputs: bodies[name](**{i: made[i] for i in inputs}), inputs)
        return made

    def close(self) -> None:
        if self.finish:
            self.finish("complete" if all(r[3] == "complete" for r in self.rows[-1:]) else "failed")
