"""The text form of programs."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import stats
from weftline.operators.validate import Assertion
from weftline.plans.graph import Body, CompileError
from weftline.plans.language import SyntaxFault, lex, load, unquote

BODIES = {"SQUARE": lambda x: {"y": x * x}, "TOTAL": lambda xs: {"sum": stats.total(xs)}, "SHIFT": lambda p: {"q": p}}
SOURCE = """
# squares
filetype json;
struct POINT(int x, float y "a help text")

stage SQUARE(in float x, out float y, src py "stages/square")
stage TOTAL(in float[] xs, out float sum, src py "stages/total") using (threads = 2, mem_gb = 1)

pipeline SUM(in float[] xs, in bool off, out float sum, out float[] each,)
{
    map call SQUARE as S(x = split self.xs,)
    call TOTAL(xs = S.y) using (disabled = self.off,)
    return (sum = TOTAL.sum, each = S.y,)
}

pipeline PROJECT(in POINT[] points, in bool off, out float sum,)
{
    call SUM(xs = self.points.y, * = self,)
    return (* = SUM,)
}

call SUM(xs = [1, 2.5, -3e0], off = false,)
"""


def test_load_and_run(spark):
    program, top = load(SOURCE, BODIES)
    assert top.target == "SUM" and top.bindings == {"xs": [1, 2.5, -3.0], "off": False}
    df = spark.createDataFrame([([1.0, 2.0], False), ([3.0], True)], "xs array<double>, off boolean")
    assert [(r.sum, r.each) for r in program.apply("SUM", df).collect()] == [(5.0, [1.0, 4.0]), (None, [9.0])]
    df = spark.createDataFrame([([(1, 2.0), (5, 3.0)], False)], "points array<struct<x: bigint, y: double>>, off boolean")
    assert program.apply("PROJECT", df).first().sum == 13.0


def test_includes(tmp_path, spark):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s.txt").write_text('stage SQUARE(in float x, out float y, src py "a")\n')
    program, _ = load('@include "sub/s.txt"\n@include "sub/s.txt"\n', BODIES, str(tmp_path))
    assert list(program.callables) == ["SQUARE"]
    (tmp_path / "loop.txt").write_text('@include "loop.txt"\n')
    with pytest.raises(CompileError, match="includes itself"):
        load('@include "loop.txt"', BODIES, str(tmp_path))


def test_diamond_and_search_path(tmp_path):
    for name, text in (("base.txt", 'stage SQUARE(in float x, out float y, src py "a")'), ("l.txt", '@include "base.txt"'), ("r.txt", '@include "base.txt"')):
        (tmp_path / name).write_text(text + "\n")
    program, _ = load('@include "l.txt"\n@include "r.txt"\n', BODIES, "/nowhere", (str(tmp_path),))
    assert list(program.callables) == ["SQUARE"]
    with pytest.raises(CompileError, match="is in none of"):
        load('@include "m.txt"', BODIES, "/nowhere", (str(tmp_path),))


SPLIT = Body(
    split=lambda values: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(2).alias("__threads"))),
    main=lambda values, value: {"square": value * value},
    join=lambda values, chunk_defs, chunk_outs: {"sum": F.aggregate(chunk_outs, F.lit(0.0), lambda a, o: a + o["square"]), "text": F.to_json(chunk_outs, {"ignoreNullFields": "false"})},
)


def test_split_stage(spark):
    """Chunk outputs hold the stage's outputs too; no chunk at all is joined as well."""
    source = """stage SUM(in float[] values, out float sum, out string text, src py "sum") split (in float value, out float square)
    using (mem_gb = 2) retain (text, sum,)
    pipeline ALL(in map<float[]> sets, out map<SUM> sums) { map call SUM(values = split self.sets) return (sums = SUM) }"""
    program, _ = load(source, {"SUM": SPLIT})
    stage = program.callables["SUM"]
    assert (stage.retain, stage.resources, stage.source) == (("sum", "text"), {"mem_gb": 2}, ("py", "sum"))
    df = spark.createDataFrame([([1.0, 2.0],), ([],)], "values array<double>")
    (one, text), (none, empty) = [(r.sum, r.text) for r in program.apply("SUM", df).collect()]
    assert (one, none, empty) == (5.0, 0.0, "[]") and json.loads(text) == [{"sum": None, "text": None, "square": 1.0}, {"sum": None, "text": None, "square": 4.0}]
    got = program.apply("ALL", spark.createDataFrame([({"a": [3.0], "b": []},)], "sets map<string,array<double>>")).first().sums
    assert {k: v["sum"] for k, v in got.items()} == {"a": 9.0, "b": 0.0}
    with pytest.raises(CompileError, match="needs a split"):
        load(source, {"SUM": lambda values: {}})


CHECKED = """
stage CHECK(in float x, src py "check")
stage SQUARE(in float x, out float y, src py "square")
pipeline INNER(in float x, out float y) { call preflight CHECK(x = self.x) call SQUARE(x = self.x) return (y = SQUARE.y) }
pipeline OUTER(in float[] xs, out float[] ys) { map call INNER(x = split self.xs) return (ys = INNER.y) }
"""


def test_preflight(spark):
    program, _ = load(CHECKED, BODIES | {"CHECK": lambda x: {"x must be positive": x > 0}})
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x double")
    assert [r.y for r in program.apply("INNER", rows(1.0, 2.0)).collect()] == [1.0, 4.0]
    with pytest.raises(Assertion, match="CHECK: x must be positive"):
        program.apply("INNER", rows(1.0, -2.0))
    nested = lambda *v: program.apply("OUTER", spark.createDataFrame([(list(v),)], "xs array<double>"))
    assert nested(3.0).first().ys == [9.0]
    with pytest.raises(Exception, match="ASSERT: CHECK"):
        nested(3.0, -1.0).collect()
    with pytest.raises(CompileError, match="depends on another"):
        load(CHECKED.replace("CHECK(x = self.x)", "CHECK(x = SQUARE.y)"), BODIES | {"CHECK": lambda x: {}})


def test_top_calls(spark):
    program, top = load(SOURCE, BODIES)
    assert tuple(program.run(spark, top).first()) == (16.25, [1.0, 6.25, 9.0])
    program, top = load(SOURCE.replace("call SUM(xs = [1, 2.5, -3e0], off = false,)", "map call SUM(xs = split [[1], [], [2, 3]], off = false)"), BODIES)
    assert [tuple(r) for r in program.run(spark, top).collect()] == [(0, 1.0, [1.0]), (1, 0.0, []), (2, 13.0, [4.0, 9.0])]
    program, top = load(SOURCE.replace("call SUM(xs = [1, 2.5, -3e0], off = false,)", 'map call SUM(xs = split {"b": [1], "a": [2]}, off = split {"a": true, "b": false})'), BODIES)
    assert [tuple(r) for r in program.run(spark, top).collect()] == [(0, "a", None, [4.0]), (1, "b", 1.0, [1.0])]


ZIPS = """
stage ADD(in float a, in float b, out float s, src py "add")
pipeline MAPS(in map<float> l, in map<float> r, in map<bool> off, out map<float> s)
{ map call ADD(a = split self.l, b = split self.r) using (disabled = self.off) return (s = ADD.s) }
pipeline ARRAYS(in float[] l, in float[] r, in bool[] off, out float[] s)
{ map call ADD(a = split self.l, b = split self.r) using (disabled = self.off) return (s = ADD.s) }
pipeline NONE(in float b, out float[] s, out float[] t)
{ call ARRAYS(l = [], r = [], off = []) map call ADD(a = split self.b_, b = self.b) return (s = ARRAYS.s, t = ADD.s) }
"""


def test_zips_and_disabling_each_fork(spark):
    program, _ = load(ZIPS.replace("self.b_", "[1.5]"), {"ADD": lambda a, b: {"s": a + b}})
    df = spark.sql("select map('x', 1d, 'y', 2d) l, map('y', 20d, 'x', 10d) r, map('x', false, 'y', true) off")
    assert program.apply("MAPS", df).first().s == {"x": 11.0, "y": None}
    df = spark.sql("select array(1d, 2d) l, array(10d, 20d) r, array(true, false) off")
    assert program.apply("ARRAYS", df).first().s == [None, 22.0]
    with pytest.raises(Exception, match="different keys"):
        program.apply("MAPS", spark.sql("select map('x', 1d) l, map('z', 1d) r, map('x', false) off")).collect()
    # a collection known to be empty while compiling gives null, not an empty collection
    assert tuple(program.apply("NONE", spark.sql("select 1d b")).first()) == (None, [2.5])


def test_default_outputs(spark):
    source = 'stage A(in int x, out int, src py "a") stage B(in int x, out int y, src py "b") pipeline P(in int x, out int z) { call A(x = self.x) call B(x = A) return (z = B.y) }'
    program, _ = load(source, {"A": lambda x: {"default": x + 1}, "B": lambda x: {"y": x * 10}})
    assert program.apply("P", spark.sql("select 4L x")).first().z == 50


def test_mapped_calls_fuse(spark):
    """A mapped call over another one's results alone runs in the same pass; plans grow with the calls, not with the uses."""
    program, _ = load(
        'stage S(in float x, out float y, src py "s") pipeline P(in float[] xs, out float[] ys) { map call S as A(x = split self.xs) map call S as B(x = split A.y) map call S as C(x = split B.y) return (ys = C.y) }',
        {"S": lambda x: {"y": x * 2}},
    )
    df = program.apply("P", spark.createDataFrame([([1.0, 3.0],), ([],), (None,)], "xs array<double>"))
    assert [r.ys for r in df.collect()] == [[8.0, 24.0], [], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("transform(") <= 3


@pytest.mark.parametrize("inner", [False, True])
def test_plans_stay_linear(spark, inner):
    sizes = []
    for n in (15, 30):
        calls = "".join(f"call ADD as C{i}(a = {f'C{i - 1}.s' if i else 'self.x'}, b = {f'C{i - 1}.s' if i else 'self.x'})\n" for i in range(n))
        source = f'stage ADD(in float a, in float b, out float s, src py "add") pipeline P(in float x, out float s) {{ {calls} return (s = C{n - 1}.s) }} pipeline Q(in float x, out float s) {{ call P(x = self.x) return (s = P.s) }}'
        program, _ = load(source, {"ADD": lambda a, b: {"s": a + b}})
        df = program.apply("Q" if inner else "P", spark.createDataFrame([(1.0,)], "x double"))
        assert df.first().s == 2.0**n
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 4 * sizes[0]


def test_strings():
    assert unquote(r'"a\n\t\"\\\x41\u00e9\101"') == 'a\n\t"\\A\u00e9A'
    assert [t.text for t in lex("a.b = -1.5e3 # rest")] == ["a", ".", "b", "=", "-1.5e3", ""]


@pytest.mark.parametrize(
    "source, message",
    [
        ("stage", "a word expected"),
        ("struct A(int x, int x)", "two members x"),
        ("filetype json", "';' expected"),
        ('stage UNKNOWN(in int x, src py "a")', "no function"),
        (SOURCE.replace("map call", "call"), "go together"),
        (SOURCE.replace("self.off,", "self.xs,"), "disabled by a float"),
        (SOURCE.replace("xs = S.y)", "xs = S.z)"), "no output z"),
        (SOURCE + "call SUM(xs = [], off = true)", "more than one top call"),
        ("pipeline P(out int x) { return (y = 1) }", "doesn't return x"),
        ("$", "unexpected"),
    ],
)
def test_faults(source, message):
    with pytest.raises((SyntaxFault, CompileError), match=message):
        load(source, BODIES)
