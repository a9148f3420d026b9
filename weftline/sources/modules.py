"""Stages as Python modules: ``main(args, outs)``, and for stages that split ``split(args)`` and ``join(args, outs, chunk_defs, chunk_outs)``.

A module is source text, shipped with the plan, so that executors need no copy of
its file. Its functions get records with an attribute a parameter, and find
``stage``, a helper, among their globals. A fork is a row; each chunk is a row of
its own between split and join, dealt over all tasks. Only a fork's chunk
definitions and outputs meet in one row, as the join asks for them. Values pass
as JSON, in Arrow batches.

``stage.throw(text)`` ends the run with an assertion; ``stage.alarm(text)`` and
the log go to the columns ``alarms`` and ``log``. Outputs whose names weren't
declared are dropped; missing ones are NULL. A null argument is None.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scatter import RESERVED
from ..operators.validate import Assertion
from ..plans.graph import Stage
from ..types import Types
from .invocation import schema_of


class Record:
    """Attributes for the keys that it was made with; others that are set aren't written back."""

    def __init__(self, items: Mapping[str, object]):
        self.__dict__.update(items)
        self.__dict__["_slots"] = tuple(items)

    def items(self) -> dict[str, object]:
        return {k: self.__dict__[k] for k in self._slots}

    def __iter__(self) -> Iterator[str]:
        return iter(self._slots)


class Helper:
    """What a stage's code may ask and tell."""

    def __init__(self, given: Mapping[str, object], resources: Mapping[str, object], folder: str):
        self.given, self.resources, self.folder = dict(given), dict(resources), folder
        self.alarms: list[str] = []
        self.log: list[str] = []
        self.progress: str | None = None

    def make_path(self, name: str) -> str:
        """Where a file output of this name belongs: a folder of the fork's own in the run's shared folder."""
        return f"{self.folder}/{name}"

    def threads(self) -> float:
        return float(self.resources.get("__threads") or 1)

    def memory_gb(self) -> float:
        return float(self.resources.get("__mem_gb") or 1)

    def arguments(self) -> dict[str, object]:
        return dict(self.given)

    def info(self, text: str) -> None:
        self.log.append(f"info: {text}")

    def warn(self, text: str) -> None:
        self.log.append(f"warn: {text}")

    def timed(self, text: str) -> None:
        self.log.append(f"time: {text} {time.time():.3f}")

    def data(self, label: str, value: object) -> None:
        self.log.append(json.dumps({"label": label, "data": value}))

    def update_progress(self, text: str) -> None:
        self.progress = text

    def alarm(self, text: str) -> None:
        self.alarms.append(text)

    def throw(self, text: str) -> None:
        raise Assertion(f"ASSERT: {text}")


def functions(source: str, helper: Helper | None = None) -> dict[str, object]:
    """The names that a module's source defines; for tests of a stage's code as well."""
    space: dict[str, object] = {"__name__": "stage_module", "stage": helper or Helper({}, {}, ".")}
    exec(compile(source, "stage_module", "exec"), space)
    return space


def _plain(value: object) -> object:
    """A value as JSON holds it: NaN and infinities as null, bytes as text, records and tuples by their items."""
    if isinstance(value, Record):
        value = value.items()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, bytes):
        return value.decode("utf-8", "ignore")
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


_SAID = pa.schema([("fork", pa.string()), ("ix", pa.int32()), ("args", pa.string()), ("chunk", pa.string()), ("outs", pa.string()), ("alarms", pa.list_(pa.string())), ("log", pa.list_(pa.string()))])
_FIELDS = "fork string, ix int, args string, chunk string, outs string, alarms array<string>, log array<string>"


def _rows(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [out for row in batch.to_pylist() for out in make(row)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SAID)


def run(df: DataFrame, stage: Stage, source: str, types: Types, keys: Sequence[str], folder: str = ".") -> DataFrame:
    """(keys, outputs, alarms, log): a module's outputs for every row of df, whose columns hold keys (naming a fork) and arguments."""
    outs = tuple(stage.outputs)
    both = (*outs, *stage.chunk_outputs)
    names = functions(source)
    fork = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    given = df.select(fork.alias("fork"), F.lit(-1).alias("ix"), F.to_json(F.struct(*(df[p].cast(types.to_spark(t)).alias(p) for p, t in stage.inputs.items())), {"ignoreNullFields": "false"}).alias("args"), F.lit(None).cast("string").alias("chunk"))

    def call(row: dict, part: str, chunk: dict, wanted: tuple[str, ...], *more: object) -> dict:
        args = json.loads(row["args"])
        own = {k: v for k, v in chunk.items() if k not in RESERVED}
        helper = Helper(args, {**stage.resources, **{k: v for k, v in chunk.items() if k in RESERVED}}, f"{folder}/{row['fork']}/{row['ix']}")
        record = Record(dict.fromkeys(wanted))
        functions(source, helper)[part](Record({**args, **own}), record, *more)
        return {**row, "outs": json.dumps(_plain(record)), "alarms": helper.alarms, "log": helper.log}

    def main(row: dict) -> Iterator[dict]:
        if row["ix"] == -1 and "split" in names:
            yield {**row, "outs": None}  # the fork itself: it carries the join's arguments, and what split had to say
        else:
            yield call(row, "main", json.loads(row["chunk"] or "{}"), both if "split" in names else outs)

    def split(row: dict) -> Iterator[dict]:
        helper = Helper(json.loads(row["args"]), stage.resources, f"{folder}/{row['fork']}/split")
        made = functions(source, helper)["split"](Record(helper.given))
        odd = set(made.get("join") or {}) - set(RESERVED)
        if odd:
            raise ValueError(f"join resources don't include {', '.join(sorted(odd))}")
        yield {**row, "chunk": json.dumps(made.get("join") or {}), "alarms": helper.alarms, "log": helper.log}
        for i, chunk in enumerate(made.get("chunks") or []):
            yield {**row, "ix": i, "chunk": json.dumps(_plain(chunk)), "alarms": [], "log": []}

    if "split" not in names:
        done = given.mapInArrow(lambda b: _rows(b, main), _FIELDS)
    else:
        parts = given.mapInArrow(lambda b: _rows(b, split), _FIELDS)
        called = parts.repartition("fork", "ix").mapInArrow(lambda b: _rows(b, main), _FIELDS)
        chunks = F.sort_array(F.collect_list(F.when(F.col("ix") >= 0, F.struct("ix", "chunk", "outs"))))
        one = F.when(F.col("ix") == -1, F.struct("args", "chunk"))
        met = called.groupBy("fork").agg(F.max(one).alias("own"), F.to_json(chunks).alias("parts"), F.flatten(F.collect_list("alarms")).alias("alarms"), F.flatten(F.collect_list("log")).alias("log"))
        held = met.select("fork", F.lit(-1).alias("ix"), "own.args", "own.chunk", F.col("parts").alias("outs"), "alarms", "log")

        def join(row: dict) -> Iterator[dict]:
            got = json.loads(row["outs"])
            defs = [Record(json.loads(p["chunk"])) for p in got]
            results = [Record(json.loads(p["outs"])) for p in got]
            out = call(row, "join", json.loads(row["chunk"] or "{}"), outs, defs, results)
            yield {**out, "alarms": [*row["alarms"], *out["alarms"]], "log": [*row["log"], *out["log"]]}

        done = held.mapInArrow(lambda b: _rows(b, join), _FIELDS)
    kinds = df.select(*keys).schema
    return done.select(F.from_json("fork", kinds).alias("k"), F.from_json("outs", schema_of(stage.outputs, types)).alias("o"), "alarms", "log").select("k.*", *(F.col("o")[n].alias(n) for n in outs), "alarms", "log")
