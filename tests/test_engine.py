"""Types, programs, mapped calls, validation, runs and streams on small fixtures."""

import dataclasses
import json
import os
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import scalar as fn
from weftline.operators import expr, lineage, mapcall, relations, scatter, stats, telemetry, validate
from weftline.plans import catalog, language
from weftline.plans.graph import Call, CompileError, Pipeline, Program, Ref, Split, Stage, sort_calls
from weftline.plans.run import Runner
from weftline.sources import invocation, outputs
from weftline.types import TypeId, TypeMismatch, Types

P = TypeId.parse
POINTS = Types.of({"POINT": {"x": "int", "y": "float"}, "WIDE": {"y": "float", "x": "int", "z": "string"}, "SET": {"points": "POINT[]", "name": "string"}}, ("json", "bam"))


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("text", ["int", "string[][]", "map<int>", "map<float[]>", "map<POINT[][]>[]"])
def test_type_strings(text):
    assert str(P(text)) == text


def test_type_rules():
    assert P("map<int[]>[]") == TypeId("int", 1, 2)
    with pytest.raises(ValueError):
        P("map<map<int>>")
    with pytest.raises(TypeMismatch):
        P("map<int>").mapped("map")
    assert P("int[]").mapped("map") == P("map<int[]>")
    for to, given, ok in [
        ("float", "int", True), ("int", "float", False), ("file", "string", True), ("json", "file", True), ("json", "bam", False), ("string", "json", True),
        ("POINT", "WIDE", True), ("WIDE", "POINT", False), ("POINT[]", "WIDE[]", True), ("POINT[]", "WIDE", False), ("map", "POINT", True),
        ("map<float>", "POINT", True), ("map<int>", "POINT", False), ("map<float>", "map<int>", True), ("int", "null", True),
    ]:
        assert POINTS.assignable(P(to), P(given)) is ok, (to, given)
    assert POINTS.contains_files(P("map<json>")) == "directory" and POINTS.contains_files(P("string")) == "maybe"
    for bad in ({}, {"a": P("EMPTY")}):
        with pytest.raises(ValueError):
            POINTS.add("EMPTY", bad)


def test_projection_and_narrowing(spark):
    doc = {"foo1": {"bar": 0, "baz": [{"a": 1, "b": {"c": "2"}}, {"a": 3, "b": {"c": "4"}}, None]}, "foo2": None}
    ddl = "m map<string, struct<bar: bigint, baz: array<struct<a: bigint, b: struct<c: string>>>>>"
    df = spark.createDataFrame([(doc,)], ddl)
    got = df.select(expr.path_of(df, "m.bar").alias("p"), expr.path_of(df, "m.baz.a").alias("q"), expr.path_of(df, "m.baz.b.c").alias("r")).first()
    assert got.p == {"foo1": 0, "foo2": None} and got.q == {"foo1": [1, 3, None], "foo2": None} and got.r == {"foo1": ["2", "4", None], "foo2": None}
    to = T.MapType(T.StringType(), T.StructType().add("baz", T.ArrayType(T.StructType().add("a", T.LongType()))))
    small = df.select(expr.narrow(df["m"], df.schema["m"].dataType, to).alias("v")).first().v
    assert small == {"foo1": Row(baz=[Row(a=1), Row(a=3), None]), "foo2": None}
    with pytest.raises(KeyError):
        expr.path_of(df, "m.nothing")


def test_integral(spark):
    assert one(spark, expr.integral(F.lit(2.0))) == 2
    with pytest.raises(Exception, match="not an integer"):
        one(spark, expr.integral(F.lit(2.5)))


def test_nothing_in_three_ways(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "k int, a array<int>")
    forks = mapcall.fork(df, "a").withColumn("v", F.col("item") + 1)
    assert {r.k: r.out for r in mapcall.gather(forks, ["k"], "v", "out").collect()} == {1: [2, None], 2: [], 3: None}
    with pytest.raises(Exception, match="disabled modifier is null"):
        one(spark, expr.disabled(F.lit(1), F.lit(None).cast("boolean")))
    assert one(spark, expr.inherited(F.lit(True), F.lit(None).cast("boolean"))) is True
    with pytest.raises(Exception, match="different lengths"):
        one(spark, mapcall.zipped(a=F.array(F.lit(1)), b=F.array(F.lit(1), F.lit(2))))
    with pytest.raises(Exception, match="out of range"):
        one(spark, mapcall.element(F.array(F.lit(1)), 3))
    with pytest.raises(Exception, match="different keys"):
        one(spark, mapcall.zipped_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("b"), F.lit(1))))


def test_fork_order_and_names(spark):
    forks = one(spark, mapcall.product({"a": F.array(*map(F.lit, "xyz")), "b": F.array(F.lit(1), F.lit(2))}))
    assert [(f.a, f.b) for f in forks] == [("x", 1), ("y", 1), ("z", 1), ("x", 2), ("y", 2), ("z", 2)]
    assert one(spark, mapcall.fork_name(F.lit(7), F.lit(12))) == "fork07"


def test_canonical_stages(spark):
    values = F.array(*(F.lit(float(x)) for x in (1, 3, 4, 5, 7)))
    s = stats.statistics(values)
    assert (one(spark, s["mean"]), one(spark, s["std_dev"])) == (4.0, 2.0)
    squares = F.transform(stats.range_(F.lit(3).cast("long"), F.lit(5).cast("long")), lambda x: stats.pow_(x, 2))
    s = stats.statistics(squares)
    assert (one(spark, squares), one(spark, s["mean"]), one(spark, s["std_dev"])) == ([9.0, 16.0], 12.5, 3.5)
    assert one(spark, stats.range_(F.lit(3).cast("long"), F.lit(2).cast("long"))) == []
    assert one(spark, stats.merge_dicts(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))) == {"a": 2}
    assert one(spark, scatter.chunk_array(F.array(*map(F.lit, range(5))), 2)) == [[0, 1], [2, 3], [4]]


def test_collapse_anchor_does_not_slide(spark):
    df = spark.createDataFrame([("u", t, n) for t, n in [(0, "a"), (6, "a"), (11, "a"), (12, "b"), (13, "a"), (14, "a")]], "u string, t int, n string")
    assert sorted(r.t for r in telemetry.collapse(df, ["u"], "n", "t", ["t"], 10).collect()) == [0, 11, 12, 13]


def test_scalars(spark):
    assert one(spark, fn.path_escape(F.lit("a b/c+d~é"))) == "a%20b%2Fc+d~%C3%A9"
    assert one(spark, fn.strings_inside(F.lit('{"k": ["a/b", {"x": "q\\"r"}], "n": 1}'))) == ["a/b", 'q"r']
    assert [one(spark, fn.legal_output_name(F.lit(n))) for n in ("a.txt", "CON.txt", "a?", "b.", "é" * 128)] == [True, False, False, False, False]
    assert one(spark, fn.round_up(F.lit(-1.001), 100)) == -1.01
    assert one(spark, fn.inside(F.lit("/a/bc"), F.lit("/a/b"))) is False


def test_validation(spark):
    params = {"p": P("POINT"), "n": P("int[]"), "m": P("map<string>")}

    def check(doc, outs=False):
        report = validate.arguments(F.lit(json.dumps(doc)), params, POINTS, outputs=outs)
        return one(spark, report.errors), one(spark, report.alarms)

    assert check({"p": {"x": 1, "y": 2.5, "extra": 0}, "n": [1, None, 2.0], "m": {"a": "b"}}) == ([], [])
    assert check({"p": None, "n": None, "m": None}) == ([], [])
    errors, _ = check({"p": {"x": "s"}, "n": [1.5], "q": 1})
    assert len(errors) == 5 and "missing parameter m" in errors and "unexpected q" in errors
    assert check({"p": None, "n": [], "m": {}, "q": 1}, outs=True) == ([], ["unexpected q"])
    with pytest.raises(Exception, match="too bad"):
        one(spark, validate.enforce(F.array(F.lit("too bad")), "error"))


def test_validation_reads_each_value_once(spark):
    """Members are read once an object and once an array of objects, however deep, and not again in each check."""
    types = Types.of({"IN": {"a": "int", "b": "string"}, "MID": {"in": "IN", "all": "IN[]"}, "OUT": {"mid": "MID"}})
    df = spark.createDataFrame([('{"o": {"mid": {"in": {"a": 1.5}, "all": [{"a": 1, "b": 2}, null, 3, {"b": null, "a": "x"}]}}}',), ('{"o": {"mid": 1}}',), ('{"o": null}',)], "doc string")
    held = df.select(F.try_parse_json("doc").alias("v")).select(validate.arguments(F.col("v"), {"o": P("OUT")}, types, parsed=True).errors.alias("e"))
    assert [r.e for r in held.collect()] == [
        ["o.mid.in.a: not a legal int: DECIMAL(2,1)", "o.mid.in: missing member b", "o.mid.all[].b: not a legal string: BIGINT", "o.mid.all[]: not a IN", "o.mid.all[].a: not a legal int: STRING"],
        ["o.mid: not a MID"],
        [],
    ]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") <= 12


def test_validation_names_keep_their_case(spark):
    types = Types.of({"BOTH": {"a": "int", "A": "string"}})
    check = lambda doc, t: one(spark, validate.arguments(F.lit(json.dumps({"p": doc})), {"p": P(t)}, types).errors)
    assert check({"A": "s", "a": 1}, "BOTH") == check([{"a": 1, "A": "s"}, None], "BOTH[]") == []
    assert check({"a": 1}, "BOTH") == ["p: missing member A"]
    assert check([{"A": 2, "a": 1}], "BOTH[]") == ["p[].A: not a legal string: BIGINT"]


# Programs


def squares():
    square = Stage("SQUARE", {"x": P("float")}, {"y": P("float")}, lambda x: {"y": x * x})
    total = Stage("TOTAL", {"xs": P("float[]")}, {"sum": P("float")}, lambda xs: {"sum": stats.total(xs)})
    pipe = Pipeline(
        "SUM_SQUARES", {"values": P("float[]"), "off": P("bool")}, {"sum": P("float"), "each": P("float[]")},
        [Call("TOTAL", {"xs": Ref("SQUARE", "y")}, disabled=Ref(None, "off")), Call("SQUARE", {"x": Split(Ref(None, "values"))})],
        {"sum": Ref("TOTAL", "sum"), "each": Ref("SQUARE", "y")},
    )
    return Program(Types.of()).add(square, total, pipe)


def test_program(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], False), ([], False), (None, False), ([2.0], True)], "values array<double>, off boolean")
    got = squares().apply("SUM_SQUARES", df).collect()
    assert [(r.sum, r.each) for r in got] == [(14.0, [1.0, 4.0, 9.0]), (0.0, []), (None, None), (None, [4.0])]


def test_program_is_one_projection(spark):
    df = spark.createDataFrame([([1.0], False)], "values array<double>, off boolean")
    plan = squares().apply("SUM_SQUARES", df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_mapped_pipeline_over_map(spark):
    program = squares()
    program.add(Pipeline("ALL", {"sets": P("map<float[]>")}, {"sums": P("map<float>")}, [Call("SUM_SQUARES", {"values": Split(Ref(None, "sets")), "off": False})], {"sums": Ref("SUM_SQUARES", "sum")}))
    df = spark.createDataFrame([({"a": [1.0, 2.0], "b": []},)], "sets map<string, array<double>>")
    assert program.apply("ALL", df).first().sums == {"a": 5.0, "b": 0.0}
    assert ("ALL.SUM_SQUARES.SQUARE", "ALL.SUM_SQUARES.TOTAL") in program.edges("ALL") and "->" in program.dot("ALL")


def test_statically_null_source_is_null(spark):
    program = squares()
    program.add(Pipeline("NONE", {"a": P("int")}, {"y": P("float[]")}, [Call("SQUARE", {"x": Split(None)})], {"y": Ref("SQUARE", "y")}))
    assert program.apply("NONE", spark.createDataFrame([(1,)], "a long")).first().y is None


@pytest.mark.parametrize(
    "calls, message",
    [
        ([Call("SQUARE", {})], "lacks x"),
        ([Call("SQUARE", {"x": 1.0, "z": 1})], "no input z"),
        ([Call("SQUARE", {"x": "s"})], "is a float, not a string"),
        ([Call("OTHER", {})], "isn't declared"),
        ([Call("SQUARE", {"x": Ref("TOTAL", "sum")}), Call("TOTAL", {"xs": [Ref("SQUARE", "y")]})], "depend on each other"),
        ([Call("SQUARE", {"x": Ref("NOBODY", "y")})], "isn't called"),
        ([Call("SQUARE", {"x": 1.0}), Call("SQUARE", {"x": 1.0})], "alias"),
        ([Call("SQUARE", {"x": 1.0}, disabled=Ref(None, "values"))], "disabled by a float"),
    ],
)
def test_compile_errors(calls, message):
    program = squares()
    program.add(Pipeline("BAD", {"values": P("float[]")}, {"y": P("float")}, calls, {"y": 1.0}))
    with pytest.raises(CompileError, match=message):
        program.check("BAD")


def test_calls_keep_their_order():
    calls = [Call("A", {"x": Ref("B", "y")}), Call("C", {}), Call("B", {}), Call("PRE", {}, preflight=True)]
    assert [c.id for c in sort_calls(calls)] == ["PRE", "C", "B", "A"]


# Relations, lineage, sources, runs, streams


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert sorted(r.node for r in lineage.cyclic(e).collect()) == ["a", "b", "c"]
    assert lineage.equivalent(e, e) and not lineage.equivalent(e, e.limit(2))


def test_collapse_paths(spark):
    df = spark.createDataFrame([("/a", 1), ("/a/b", 2), ("/a/b/c", 4), ("/ab", 8)], "p string, n long")
    assert {r.p: r.n for r in relations.collapse_paths(df, "p", "n").collect()} == {"/a": 7, "/ab": 8}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"values": [1, 2],\n "p": {"x": 1, "y": 2}}')
    params = {"values": P("float[]"), "p": P("POINT"), "none": P("string")}
    row = invocation.read_args(spark, str(tmp_path / "a.json"), params, POINTS).first()
    assert row.values == [1.0, 2.0] and row.p.y == 2.0 and row.none is None
    with pytest.raises(Exception, match="over 3 bytes"):
        invocation.read_args(spark, str(tmp_path / "a.json"), params, POINTS, limit=3).collect()
    df = invocation.from_objects(spark, [{"values": [1.0]}], params, POINTS)
    assert json.loads(invocation.to_invocation(df).first().invocation) == {"values": [1.0], "p": None, "none": None}
    assert invocation.split_args('{"a": {"split": [1]}, "b": 2}') == ({"a": [1], "b": 2}, ["a"])
    assert invocation.expand_env("$A/${B}/$C", {"A": "x", "B": "y"}) == "x/y/"


def test_placing_outputs(tmp_path):
    work, out = tmp_path / "w", tmp_path / "o"
    work.mkdir()
    for n in ("a", "b"):
        (work / n).write_text(n)
    types = Types.of({"FILES": {"one": "json", "n": "int"}}, ("json",))
    value = {"k": {"one": str(work / "a"), "n": 3}, "l": {"one": str(work / "missing"), "n": 4}}
    placed = outputs.place_outputs(value, P("map<FILES>"), types, str(out))
    assert placed == {"k": {"one": str(out / "k" / "one.json"), "n": 3}, "l": {"one": None, "n": 4}}
    assert os.path.exists(out / "k" / "one.json") and "- k:" in outputs.summary(placed)
    assert outputs.place_outputs([str(work / "b")], P("json[]"), types, str(out / "x")) == [str(out / "x" / "0")]


def test_default_outs(spark):
    cols = outputs.default_outs({"a": P("int[]"), "m": P("map<int>"), "f": P("json"), "s": P("POINT")}, POINTS, "/out")
    assert spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first() == Row(a=[], m={}, f="/out/f.json", s=None)


def test_runner(spark, tmp_path):
    runner = Runner(spark, f"file://{tmp_path}", "r1", transient=("flaky",))
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("flaky")
        return spark.range(3)

    first = runner.stage("one", flaky)
    assert first.count() == 3 and [r[3] for r in runner.rows] == ["failed", "failed", "complete"]
    runner.stage("two", lambda: first.selectExpr("id + 1 as id"), inputs=["one"])
    assert runner.reclaim() == ["one"] and not runner.done("one") and runner.done("two")
    runner.stage("two", lambda: 1 / 0)  # done already
    with pytest.raises(validate.Assertion):
        runner.stage("three", lambda: (_ for _ in ()).throw(validate.Assertion("flaky")))
    assert runner.rows[-1][3] == "assert" and runner.ledger().count() == 5


def test_streams(spark, tmp_path):
    from weftline.streaming.telemetry import high_water, windowed

    rows = [(1, f"2024-01-01 00:00:{s:02d}", d) for s, d in [(1, 5), (2, -7), (3, 4), (31, 1)]]
    source = str(tmp_path / "in")
    batch = spark.createDataFrame(rows, "k long, t string, d long").withColumn("t", F.col("t").cast("timestamp"))
    batch.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    for name, df, mode in (("w", windowed(stream, "t", "k", "d", "30 seconds", "1 minute"), "complete"), ("h", high_water(stream, "k", "t", "d"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 1), (3, 2)]
    assert [(r.total, r.high_water) for r in spark.table("h").collect()] == [(3, 5)]


def test_documents_and_calls(spark, tmp_path):
    program, _ = language.load(catalog.PROGRAM, catalog.BODIES)
    call = invocation.call_of(program, "SUM_SQUARES", '{"xs": [1, 2]}')
    assert call.bindings == {"xs": [1, 2], "off": None} and json.loads(invocation.document_of(call)) == {"xs": [1, 2], "off": None}
    with pytest.raises(CompileError, match="no parameters"):
        invocation.call_of(program, "SUM_SQUARES", '{"ys": 1}')
    with pytest.raises(CompileError, match="refers"):
        invocation.document_of(Call("TOTAL", {"xs": Ref("SQUARE", "y")}))
    (tmp_path / "a.json").write_text('{"x":\n 1}')
    assert [r.text for r in invocation.read_raw(spark, str(tmp_path)).collect()] == ['{"x":\n 1}']


@dataclasses.dataclass
class Spot:
    x: float
    tags: list[str]


@dataclasses.dataclass
class Shape:
    name: str | None
    spots: dict[str, Spot]


def test_rows_of_dataclasses(spark):
    rows = [Shape("a", {"p": Spot(1.0, ["t", "u"])}), Shape(None, {})]
    got = invocation.from_dataclasses(spark, Shape, rows, Types.of())
    assert got.schema.simpleString() == "struct<name:string,spots:map<string,struct<x:double,tags:array<string>>>>"
    first, second = got.collect()
    assert first.spots["p"].tags == ["t", "u"] and second.name is None and second.spots == {}
    with pytest.raises(TypeError):
        invocation.hinted(bytes, Types.of())


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("args", "{}")
    df = spark.read.format("binaryFile").load(str(tmp_path / "m.zip")).select("path", "content")
    assert [r.text for r in invocation.from_zip(df, "args").collect()] == ["{}"]
    assert [r.text for r in invocation.from_zip(df, "outs").collect()] == [None]


def test_json_paths_through_arrays(spark):
    docs = spark.createDataFrame([('{"a":[{"b":1},[{"b":"x"},{}]]}',), ('{"a":3}',), ("null",), (None,)], "d string")
    assert [r[0] for r in docs.select(expr.json_path_mapped(F.col("d"), "a.b")).collect()] == ['[1,["x",null]]', "3", "null", None]
