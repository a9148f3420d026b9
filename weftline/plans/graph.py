"""Programs as graphs of calls, and their compilation to DataFrame plans.

A stage is a function from Columns to Columns, or three of them (split, main,
join); a pipeline binds calls of stages and pipelines to its inputs and to each
other's outputs. Compiling inlines pipelines, checks every binding against the
declared types, folds constants that disable calls, and fuses a mapped call with
the one whose results alone it maps over. A call stands in the plan once, however
often its outputs are used: as a column for each output (a column of structs the
optimizer would write out again at each use), or inside mapped calls as a lambda's
variable. There is no shuffle; Catalyst sees projections.

Preflight calls have checks instead of outputs. A program's own are evaluated
before its plan is built; those further in guard their pipeline's outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expr, mapcall
from ..operators.expr import let
from ..operators.scatter import RESERVED
from ..operators.validate import Assertion
from ..types import TypeId, TypeMismatch, Types


class CompileError(Exception):
    """A program that may not run."""


@dataclass(frozen=True)
class Ref:
    """``self.name`` (call None) or an output of a call, projected along path; without a name the whole record."""

    call: str | None
    name: str | None = None
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Split:
    """A collection to map the call over."""

    value: object


@dataclass(frozen=True)
class Body:
    """A stage in three parts: split(args) gives an array of chunks (structs), main(args and a chunk's) a chunk's outputs, join(args, chunk_defs, chunk_outs) the stage's."""

    split: Callable[..., Column]
    main: Callable[..., Mapping[str, Column]]
    join: Callable[..., Mapping[str, Column]]


@dataclass
class Stage:
    name: str
    inputs: dict[str, TypeId]
    outputs: dict[str, TypeId]
    body: Callable[..., Mapping[str, Column]] | Body
    chunk_inputs: dict[str, TypeId] = field(default_factory=dict)
    chunk_outputs: dict[str, TypeId] = field(default_factory=dict)
    retain: tuple[str, ...] = ()
    resources: dict[str, object] = field(default_factory=dict)
    source: tuple[str, str] | None = None


@dataclass
class Call:
    target: str
    bindings: dict[str, object]
    alias: str | None = None
    disabled: object = None
    preflight: bool = False
    volatile: bool = False
    local: bool = False

    @property
    def id(self) -> str:
        return self.alias or self.target


@dataclass
class Pipeline:
    name: str
    inputs: dict[str, TypeId]
    outputs: dict[str, TypeId]
    calls: list[Call]
    returns: dict[str, object] = field(default_factory=dict)
    retain: list[Ref] = field(default_factory=list)


@dataclass
class Mapped:
    """A mapped call that hasn't been laid out yet: what it maps over, and its result for an element."""

    source: Column
    over: str
    call: Callable[[Column], Column]

    def column(self) -> Column:
        return mapcall.over_map(self.source, lambda _, v: self.call(v)) if self.over == "map" else mapcall.over_array(self.source, lambda x, _: self.call(x))


def refs(value: object) -> list[Ref]:
    """All references inside an expression."""
    if isinstance(value, Ref):
        return [value]
    if isinstance(value, Split):
        return refs(value.value)
    if isinstance(value, dict):
        return [r for v in value.values() for r in refs(v)]
    if isinstance(value, (list, tuple)):
        return [r for v in value for r in refs(v)]
    return []


def sort_calls(calls: list[Call]) -> list[Call]:
    """Calls after those they depend on, else in the order given; preflight calls first. A cycle is an error."""
    known = {c.id: c for c in calls}
    if len(known) != len(calls):
        raise CompileError("two calls of one name; give one an alias")
    gates = [c.id for c in calls if c.preflight]
    needs = {c.id: {r.call for v in [*c.bindings.values(), c.disabled] for r in refs(v) if r.call} | ({*gates} - {c.id} if not c.preflight else set()) for c in calls}
    for c, on in needs.items():
        if unknown := on - known.keys():
            raise CompileError(f"{c} refers to {', '.join(sorted(unknown))}, which isn't called")
    out: list[Call] = []
    done: set[str] = set()
    while len(out) < len(calls):
        ready = next((c for c in calls if c.id not in done and needs[c.id] <= done), None)
        if ready is None:
            raise CompileError(f"calls depend on each other: {', '.join(sorted(known.keys() - done))}")
        out.append(ready)
        done.add(ready.id)
    return out


@dataclass
class Program:
    types: Types
    callables: dict[str, Stage | Pipeline] = field(default_factory=dict)

    def add(self, *items: Stage | Pipeline) -> Program:
        for c in items:
            if c.name in self.callables:
                raise CompileError(f"{c.name} is declared twice")
            if c.outputs:
                self.types.add(c.name, c.outputs)
            self.callables[c.name] = c
        return self

    def check(self, name: str) -> None:
        """Bindings of a pipeline, and of all it calls."""
        pipe = self.callables.get(name)
        if pipe is None:
            raise CompileError(f"{name} isn't declared")
        if isinstance(pipe, Stage):
            return
        for c in pipe.calls:
            if c.preflight and any(r.call for v in c.bindings.values() for r in refs(v)):
                raise CompileError(f"{c.id} is a preflight call, and depends on another")
        calls = {c.id: c for c in sort_calls(pipe.calls)}
        for c in calls.values():
            target = self.callables.get(c.target)
            if target is None:
                raise CompileError(f"{c.target} isn't declared")
            if missing := target.inputs.keys() - c.bindings.keys():
                raise CompileError(f"{c.id} lacks {', '.join(sorted(missing))}")
            if extra := c.bindings.keys() - target.inputs.keys():
                raise CompileError(f"{c.id} has no input {', '.join(sorted(extra))}")
            if c.preflight and target.outputs:
                raise CompileError(f"{c.id} is a preflight call with outputs")
            if not c.preflight and not target.outputs:
                raise CompileError(f"{c.id} has no outputs and isn't a preflight call")
            for p, v in c.bindings.items():
                c.bindings[p] = self.defaulted(v, target.inputs[p], pipe, calls)
            kinds = set()
            for p, v in c.bindings.items():
                given = self.type_of(v.value if isinstance(v, Split) else v, pipe, calls)
                if isinstance(v, Split) and given and given.name != "null":
                    kinds.add("array" if given.array_dim else "map" if given.map_dim else "none")
                    given = given.element()
                if given and not self.types.assignable(target.inputs[p], given):
                    raise CompileError(f"{c.id}.{p} is a {target.inputs[p]}, not a {given}")
            if len(kinds) > 1:
                raise CompileError(f"{c.id} maps over an array and a map at once")
            each = {"array": TypeId("bool", 1), "map": TypeId("bool", 0, 1)}.get(next(iter(kinds), ""), None)
            if c.disabled is not None and (t := self.type_of(c.disabled, pipe, calls)) and t not in (TypeId("bool"), each):
                raise CompileError(f"{c.id} is disabled by a {t}")
            self.check(c.target)
        for r in pipe.retain:
            if (t := self.type_of(r, pipe, calls)) and self.types.contains_files(t) == "no":
                raise CompileError(f"{name} retains {r.call}.{r.name}, which holds no files")
        for o, t in pipe.outputs.items():
            if o not in pipe.returns:
                raise CompileError(f"{name} doesn't return {o}")
            pipe.returns[o] = self.defaulted(pipe.returns[o], t, pipe, calls)
            given = self.type_of(pipe.returns[o], pipe, calls)
            if given and not self.types.assignable(t, given):
                raise CompileError(f"{name}.{o} is a {t}, not a {given}")

    def defaulted(self, value: object, want: TypeId, pipe: Pipeline, calls: dict[str, Call]) -> object:
        """A whole call where its record doesn't fit, but its output ``default`` does, means that output."""
        if isinstance(value, Ref) and value.call and value.name is None and not self.types.assignable(want, self.type_of(value, pipe, calls)):
            if "default" in self.callables[calls[value.call].target].outputs:
                return Ref(value.call, "default")
        return value

    def over(self, call: Call, pipe: Pipeline, calls: dict[str, Call]) -> str | None:
        for v in call.bindings.values():
            if isinstance(v, Split):
                t = self.type_of(v.value, pipe, calls)
                return "map" if t and t.map_dim and not t.array_dim else "array"
        return None

    def type_of(self, value: object, pipe: Pipeline, calls: dict[str, Call]) -> TypeId | None:
        """The type of an expression; None where a literal fits several."""
        if value is None:
            return TypeId("null")
        if isinstance(value, bool):
            return TypeId("bool")
        if isinstance(value, int):
            return TypeId("int")
        if isinstance(value, float):
            return TypeId("int") if value.is_integer() else TypeId("float")
        if isinstance(value, str):
            return TypeId("string")
        if isinstance(value, (list, tuple)):
            inner = {self.type_of(v, pipe, calls) for v in value} - {None, TypeId("null")}
            if len(inner) == 1 and not (t := inner.pop()).map_dim:
                return TypeId(t.name, t.array_dim + 1, 0)
            return TypeId("float", 1) if inner == {TypeId("int"), TypeId("float")} else None
        if not isinstance(value, Ref):
            return None
        if value.call is None:
            if value.name not in pipe.inputs:
                raise CompileError(f"{pipe.name} has no input {value.name}")
            t = pipe.inputs[value.name]
        else:
            call = calls[value.call]
            outs = self.callables[call.target].outputs
            if value.name is not None and value.name not in outs:
                raise CompileError(f"{call.target} has no output {value.name}")
            t = outs[value.name] if value.name else TypeId(call.target)
            if over := self.over(call, pipe, calls):
                t = t.mapped(over)
        for step in value.path:
            members = self.types.structs.get(t.name)
            if not members or step not in members:
                raise CompileError(f"{t} has no member {step}")
            m = members[step]
            if t.map_dim and m.map_dim:
                raise TypeMismatch(f"projecting {step} through {t} would nest maps")
            if t.map_dim:
                t = TypeId(m.name, t.array_dim, t.map_dim + m.array_dim)
            else:
                t = TypeId(m.name, t.array_dim + m.array_dim, m.map_dim)
        return t

    def compile(self, name: str, args: Mapping[str, Column]) -> dict[str, Column]:
        """The outputs of a callable as Columns of its arguments'."""
        self.check(name)
        target = self.callables[name]
        if isinstance(target, Stage):
            return self._stage(target, args)
        made = self._pipeline(target, args, {})
        return {o: made[o] for o in target.outputs}

    def _stage(self, target: Stage, args: Mapping[str, Column]) -> dict[str, Column]:
        body = target.body
        if not isinstance(body, Body):
            return self._typed(body(**args), target.outputs)
        # a chunk's outputs are the stage's and its own; the reserved keys of a chunk are resources, no arguments
        both = {**target.outputs, **target.chunk_outputs}

        def main(c: Column) -> Column:
            own = {k: c[k] for k in target.chunk_inputs if k not in RESERVED}
            return F.struct(*(x.alias(o) for o, x in self._typed(body.main(**{**args, **own}), both).items()))

        chunks = body.split(**args)
        joined = lambda defs, outs: F.struct(*(x.alias(o) for o, x in self._typed(body.join(**args, chunk_defs=defs, chunk_outs=outs), target.outputs).items()))
        made = let(chunks, lambda defs: let(F.transform(defs, main), lambda outs: joined(defs, outs)))
        return {o: made[o] for o in target.outputs}

    def _typed(self, made: Mapping[str, Column], outputs: Mapping[str, TypeId]) -> dict[str, Column]:
        made = dict(made)
        return {o: made[o].cast(self.types.to_spark(t)) if o in made else F.lit(None).cast(self.types.to_spark(t)) for o, t in outputs.items()}

    def _record(self, target: Stage | Pipeline, args: Mapping[str, Column], fixed: Mapping[str, object]) -> Column:
        """A struct of a callable's outputs; ``fixed`` are the inputs whose values are known now."""
        if isinstance(target, Stage):
            return F.struct(*(x.alias(o) for o, x in self._stage(target, args).items()))
        return self._pipeline(target, args, fixed)

    def _value(self, v: object, target: Pipeline, calls: dict[str, Call], args: Mapping[str, Column], outs: Mapping[str, object], want: TypeId | None = None) -> Column:
        if isinstance(v, Ref):
            given = self.type_of(v, target, calls)
            base = args[v.name] if v.call is None else outs[v.call]
            base = base.column() if isinstance(base, Mapped) else base
            start = target.inputs[v.name] if v.call is None else self.type_of(Ref(v.call), target, calls)
            path = v.path if v.call is None else ((v.name,) if v.name else ()) + v.path
            col, kind = expr.project(base, self.types.to_spark(start), path)
            return expr.narrow(col, kind, self.types.to_spark(want)) if want and want != given else col
        own = lambda x, t: self._value(x, target, calls, args, outs, t)
        kind = self.types.to_spark(want) if want else None
        if isinstance(v, (list, tuple)):
            col = F.array(*(own(x, want.element() if want else None) for x in v))
        elif isinstance(v, dict) and want and want.name in self.types.structs and not want.map_dim:
            col = F.struct(*(own(v.get(m), t).alias(m) for m, t in self.types.structs[want.name].items()))
        elif isinstance(v, dict):
            col = F.create_map(*(c for k, x in v.items() for c in (F.lit(k), own(x, want.element() if want else None))))
        else:
            col = F.lit(v)
        return col.cast(kind) if kind else col

    def _known(self, v: object, fixed: Mapping[str, object]) -> tuple[bool, object]:
        """Whether a binding's value is known now, and which."""
        if isinstance(v, Ref):
            return (v.call is None and v.name in fixed and not v.path, fixed.get(v.name) if v.call is None else None)
        return not refs(v), v

    def _call(self, c: Call, target: Pipeline, calls: dict[str, Call], args: Mapping[str, Column], outs: Mapping[str, object], fixed: Mapping[str, object], uses: Mapping[str, int]) -> Column | Mapped:
        callee = self.callables[c.target]
        value = lambda v, want=None: self._value(v, target, calls, args, outs, want)
        over = self.over(c, target, calls)
        kind = self.types.to_spark(TypeId(c.target).mapped(over) if over else TypeId(c.target))
        splits = {p: v.value for p, v in c.bindings.items() if isinstance(v, Split)}
        empty = [known and v in (None, [], {}) for known, v in (self._known(v, fixed) for v in splits.values())]
        off = self._known(c.disabled, fixed)
        if off == (True, True) or any(empty):  # an empty collection known now disables the call
            return F.lit(None).cast(kind)
        plain = {p: value(v, callee.inputs[p]) for p, v in c.bindings.items() if p not in splits}
        now = {p: v for p, (known, v) in ((p, self._known(v, fixed)) for p, v in c.bindings.items() if p not in splits) if known}
        if not splits:
            made = self._record(callee, plain, now)
        elif len(splits) == 1:
            ((p, v),) = splits.items()
            earlier = outs.get(v.call) if isinstance(v, Ref) and v.call else None
            if isinstance(earlier, Mapped) and uses[v.call] == 1:
                # split of a merge: one pass over the earlier call's source, nothing gathered in between
                record, path = self.types.to_spark(TypeId(calls[v.call].target)), ((v.name,) if v.name else ()) + v.path
                element = self.type_of(v, target, calls).element()

                def fused(x: Column) -> Column:
                    col, given = expr.project(earlier.call(x), record, path)
                    return self._record(callee, {**plain, p: expr.narrow(col, given, self.types.to_spark(callee.inputs[p])) if element != callee.inputs[p] else col}, now)

                made = Mapped(earlier.source, earlier.over, fused)
            else:
                given = (self.type_of(v, target, calls) or callee.inputs[p].mapped(over)).element()
                want = callee.inputs[p]
                fit = lambda x: expr.narrow(x, self.types.to_spark(given), self.types.to_spark(want)) if given != want else x
                made = Mapped(value(v), over, lambda x: self._record(callee, {**plain, p: fit(x)}, now))
        else:
            zipped = mapcall.zipped_by_key if over == "map" else mapcall.zipped
            made = Mapped(zipped(**{p: value(v) for p, v in splits.items()}), over, lambda z: self._record(callee, {**plain, **{p: z[p] for p in splits}}, now))
        if c.disabled is None or off == (True, False):
            return made
        col, flag = made.column() if isinstance(made, Mapped) else made, value(c.disabled)
        given = self.type_of(c.disabled, target, calls)
        if given and given.array_dim:
            return expr.disabled_each(col, flag)
        if given and given.map_dim:
            return F.transform_values(mapcall.zipped_by_key(v=col, d=flag), lambda _, z: expr.disabled(z["v"], z["d"]))
        return expr.disabled(col, flag)

    def _uses(self, target: Pipeline) -> dict[str, int]:
        """How often each call's outputs are referred to."""
        out = {c.id: 0 for c in target.calls}
        for v in [x for c in target.calls for x in (*c.bindings.values(), c.disabled)] + list(target.returns.values()):
            for r in refs(v):
                if r.call:
                    out[r.call] += 1
        return out

    def _pipeline(self, target: Pipeline, args: Mapping[str, Column], fixed: Mapping[str, object]) -> Column:
        """A struct of the outputs; a call used more than once is a lambda's variable."""
        order = sort_calls(target.calls)
        calls, uses = {c.id: c for c in order}, self._uses(target)
        todo = [c for c in order if self.callables[c.target].outputs]

        def go(i: int, outs: dict[str, object]) -> Column:
            if i == len(todo):
                made = F.struct(*(self._value(target.returns[o], target, calls, args, outs, t).alias(o) for o, t in target.outputs.items()))
                for message, check in self._checks(target, calls, args):
                    made = F.when(F.coalesce(check, F.lit(False)), made).otherwise(F.raise_error(F.lit(f"ASSERT: {message}")).cast(self.types.to_spark(TypeId(target.name))))
                return made
            c = todo[i]
            made = self._call(c, target, calls, args, outs, fixed, uses)
            if uses[c.id] < 2:
                return go(i + 1, {**outs, c.id: made})
            return let(made.column() if isinstance(made, Mapped) else made, lambda v: go(i + 1, {**outs, c.id: v}))

        return go(0, {})

    def _checks(self, target: Pipeline, calls: dict[str, Call], args: Mapping[str, Column]) -> list[tuple[str, Column]]:
        """(message, check) of a pipeline's preflight calls; a preflight body gives checks by message."""
        out = []
        for c in target.calls:
            if c.preflight and c.disabled is not True:
                given = {p: self._value(v, target, calls, args, {}, self.callables[c.target].inputs[p]) for p, v in c.bindings.items()}
                out += [(f"{c.id}: {message}", check) for message, check in self.callables[c.target].body(**given).items()]
        return out

    def apply(self, name: str, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """df's columns as arguments, a run a row. Preflight checks run first: where one fails, an Assertion with its message ends the run."""
        self.check(name)
        target = self.callables[name]
        given = {p: df[p].cast(self.types.to_spark(t)) for p, t in target.inputs.items()}
        if isinstance(target, Stage):
            return df.select(*keep, *(c.alias(o) for o, c in self._stage(target, given).items()))
        held = df.select(*(df[k].alias(f"keep#{k}") for k in keep), *(c.alias(f"in#{p}") for p, c in given.items()))
        args = {p: F.col(f"`in#{p}`") for p in given}
        calls = {c.id: c for c in target.calls}
        if checks := self._checks(target, calls, args):
            failed = held.agg(*(F.count_if(~F.coalesce(check, F.lit(False))) for _, check in checks)).first()
            if messages := [message for (message, _), n in zip(checks, failed, strict=True) if n]:
                raise Assertion("; ".join(messages))
        held, made = self._lay(held, target, args, {}, "")
        return held.select(*(F.col(f"`keep#{k}`").alias(k) for k in keep), *(made[o].alias(o) for o in target.outputs))

    def _lay(self, held: DataFrame, target: Pipeline, args: Mapping[str, Column], fixed: Mapping[str, object], prefix: str) -> tuple[DataFrame, dict[str, Column]]:
        """A pipeline outside all mapped calls: its calls as columns, one for each output, of the rows in ``held``; and its outputs."""
        order = sort_calls(target.calls)
        calls, uses, outs = {c.id: c for c in order}, self._uses(target), {}
        for c in order:
            callee, name = self.callables[c.target], f"{prefix}{c.id}"
            if not callee.outputs:
                continue
            if any(isinstance(v, Split) for v in c.bindings.values()) or c.disabled not in (None, False):
                made = self._call(c, target, calls, args, outs, fixed, uses)
                if isinstance(made, Mapped):
                    if uses[c.id] < 2:
                        outs[c.id] = made
                        continue
                    made = made.column()
                held = held.withColumn(name, made)
                outs[c.id] = F.col(f"`{name}`")
                continue
            given = {p: self._value(v, target, calls, args, outs, callee.inputs[p]) for p, v in c.bindings.items()}
            if isinstance(callee, Pipeline):
                now = {p: v for p, (known, v) in ((p, self._known(v, fixed)) for p, v in c.bindings.items()) if known}
                held = held.withColumns({f"{name}<{p}": x for p, x in given.items()}) if given else held
                held, record = self._lay(held, callee, {p: F.col(f"`{name}<{p}`") for p in given}, now, f"{name}.")
            else:
                record = self._stage(callee, given)
            if uses[c.id] > 1:
                held = held.withColumns({f"{name}>{o}": x for o, x in record.items()})
                record = {o: F.col(f"`{name}>{o}`") for o in record}
            outs[c.id] = F.struct(*(x.alias(o) for o, x in record.items()))
        returns = {o: self._value(target.returns[o], target, calls, args, outs, t) for o, t in target.outputs.items()}
        for message, check in self._checks(target, calls, args) if prefix else []:
            returns = {o: F.when(F.coalesce(check, F.lit(False)), x).otherwise(F.raise_error(F.lit(f"ASSERT: {message}")).cast(self.types.to_spark(target.outputs[o]))) for o, x in returns.items()}
        return held, returns

    def run(self, spark: SparkSession, call: Call) -> DataFrame:
        """A top call: one row of outputs; of a mapped call a row a fork, in order, with fork_ix (and fork_key of a map)."""
        target = self.callables[call.target]
        root = Pipeline("top", {}, {}, [call])
        self.check(call.target)
        if missing := target.inputs.keys() - call.bindings.keys():
            raise CompileError(f"{call.id} lacks {', '.join(sorted(missing))}")
        one = spark.range(1)
        splits = {p: v.value for p, v in call.bindings.items() if isinstance(v, Split)}
        kinds = {isinstance(v, dict) for v in splits.values()}
        if len(kinds) > 1:
            raise CompileError(f"{call.id} maps over an array and a map at once")
        over = "map" if kinds == {True} else "array"
        # values that hang on the row: the optimizer writes out literals again at each use before it folds them
        held = lambda x: F.when(F.col("id") >= 0, x)
        fixed = {p: held(self._value(v, root, {}, {}, {}, target.inputs[p])).alias(p) for p, v in call.bindings.items() if p not in splits}
        if not splits:
            return self.apply(call.target, one.select(*fixed.values()))
        given = {p: self._value(v, root, {}, {}, {}, target.inputs[p].mapped(over)) for p, v in splits.items()}
        zipped = (mapcall.zipped_by_key if over == "map" else mapcall.zipped)(**given)
        forks = mapcall.fork(one.select(*fixed.values(), held(zipped).alias("source#")), "source#").where("fork_ix is not null")
        keys = tuple(k for k in ("fork_ix", "fork_key") if k in forks.columns)
        return self.apply(call.target, forks.select(*keys, *fixed, *(F.col("item")[p].alias(p) for p in splits)), keep=keys).orderBy("fork_ix")

    def edges(self, name: str) -> list[tuple[str, str]]:
        """(producer, consumer) of all calls below a pipeline, by dotted names."""
        out: list[tuple[str, str]] = []

        def walk(pipe: Pipeline, prefix: str) -> None:
            for c in pipe.calls:
                out.extend((f"{prefix}.{r.call}", f"{prefix}.{c.id}") for v in [*c.bindings.values(), c.disabled] for r in refs(v) if r.call)
                if isinstance(target := self.callables[c.target], Pipeline):
                    walk(target, f"{prefix}.{c.id}")

        walk(self.callables[name], name)
        return list(dict.fromkeys(out))

    def dot(self, name: str) -> str:
        lines = [f'  "{a}" -> "{b}";' for a, b in self.edges(name)]
        return "\n".join([f'digraph "{name}" {{', *lines, "}"])

    def document(self, name: str) -> dict[str, object]:
        """The graph as data: its calls with what they call, in the order they run, and its edges."""
        nodes: list[dict[str, object]] = []

        def walk(pipe: Pipeline, prefix: str) -> None:
            for c in sort_calls(pipe.calls):
                target = self.callables[c.target]
                mapped = any(isinstance(v, Split) for v in c.bindings.values())
                nodes.append({"name": f"{prefix}.{c.id}", "target": c.target, "kind": type(target).__name__.lower(), "mapped": mapped})
                if isinstance(target, Pipeline):
                    walk(target, f"{prefix}.{c.id}")

        walk(self.callables[name], name)
        return {"name": name, "nodes": nodes, "edges": [{"from": a, "to": b} for a, b in self.edges(name)]}
