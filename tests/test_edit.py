"""Programs as data, and runs of them."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalar as fn
from weftline.plans import edit
from weftline.plans.graph import CompileError, Ref, Split
from weftline.plans.language import load
from weftline.plans.run import Changed, Runner

BODIES = {"A": lambda x: {"y": x + 1, "z": x}, "CHECK": lambda x: {"positive": x > 0}}
SOURCE = """
filetype json;
struct POINT(int x, float y)
stage CHECK(in int x, src py "check")
stage A(in int x, out int y, out int z, src py "a") using (mem_gb = 2, threads = 1) retain (z)
pipeline INNER(in int x, in int spare, out int y, out int w, out int only)
{
    call preflight CHECK(x = self.x)
    call A(x = self.x)
    call A as DEAD(x = A.y)
    call A as W(x = self.x)
    return (y = A.y, w = W.z, only = A.z)
}
pipeline TOP(in int x, out int y)
{
    call INNER(x = self.x, spare = 3)
    return (y = INNER.y)
}
call TOP(x = 4)
"""


@pytest.fixture(scope="module")
def program():
    return load(SOURCE, BODIES)


def test_text_round_trip(program):
    text = edit.format_program(*program)
    again = load(text, BODIES)
    assert edit.format_program(*again) == text and "retain (z,)" in text and "using (mem_gb = 2, threads = 1,)" in text
    assert edit.equivalent(program[0], again[0], "TOP")


def test_equivalence(program):
    other = lambda a, b: load(SOURCE.replace(a, b), BODIES)[0]
    moved = other("    call A(x = self.x)\n    call A as DEAD(x = A.y)\n", "    call A as DEAD(x = A.y)\n    call A(x = self.x)\n")
    assert edit.equivalent(program[0], moved, "TOP") and edit.equivalent(program[0], other("# ", ""), "TOP")
    assert not edit.equivalent(program[0], other("spare = 3", "spare = 4"), "TOP")
    assert edit.equivalent(program[0], other("struct POINT(int x", "struct POINT(float x"), "TOP")  # not used below the top
    assert not edit.equivalent(program[0], program[0], "NONE")


def test_unused_parts(spark, program):
    p = program[0]
    assert edit.unused_outputs(p, ["TOP"]) == {("INNER", "w"), ("INNER", "only")}
    less = edit.without_dead_calls(edit.without_unused_outputs(p, ["TOP"]))
    assert [c.id for c in less.callables["INNER"].calls] == ["CHECK", "A"] and list(less.callables["INNER"].outputs) == ["y"]
    assert [c.id for c in edit.without_dead_calls(p, keep=["DEAD"]).callables["INNER"].calls] == ["CHECK", "A", "DEAD", "W"]
    less = edit.remove_input(less, "INNER", "spare")
    assert less.run(spark, program[1]).first().y == 5
    with pytest.raises(CompileError, match="in use"):
        edit.remove_input(less, "INNER", "x")


def test_renaming(spark, program):
    p = edit.rename(program[0], "A", "PLUS")
    p = edit.rename_input(edit.rename_output(p, "INNER", "y", "result"), "INNER", "x", "start")
    assert p.run(spark, program[1]).first().y == 5
    inner = p.callables["INNER"]
    assert [c.target for c in inner.calls] == ["CHECK", "PLUS", "PLUS", "PLUS"] and [c.id for c in inner.calls] == ["CHECK", "A", "DEAD", "W"]
    assert list(inner.outputs)[0] == "result" and p.callables["TOP"].returns["y"] == Ref("INNER", "result") and inner.calls[1].bindings["x"] == Ref(None, "start")
    with pytest.raises(CompileError):
        edit.rename(p, "PLUS", "TOP")
    load(edit.format_program(p), {"PLUS": BODIES["A"], "CHECK": BODIES["CHECK"]})


def test_visit():
    seen = []
    value = Split([Ref("A", "y"), {"k": [1, Ref(None, "x")], "skip": [2]}])
    edit.visit(value, lambda v, path: edit.SKIP if path[-1:] == ("skip",) else seen.append((path, v)))
    assert [p for p, v in seen if isinstance(v, Ref)] == [(0,), (1, "k", 1)] and not any(v == 2 for _, v in seen)


def test_graph_and_stubs(program):
    graph = json.loads(edit.graph_json(program[0], "TOP"))
    assert graph["edges"] == [["TOP.INNER.A", "TOP.INNER.DEAD"]]
    space: dict = {"__name__": "stubs"}
    import sys
    import types

    sys.modules["stubs"] = types.ModuleType("stubs")
    exec(edit.stubs(program[0]), sys.modules["stubs"].__dict__)
    made = sys.modules.pop("stubs")
    assert made.A_Args(x=3).x == 3 and made.A_Outs().z is None and made.POINT(x=1, y=2.0).y == 2.0 and space


def test_a_changed_program_is_refused(spark, tmp_path, program):
    text = edit.format_program(*program)
    make = lambda t: Runner(spark, f"file://{tmp_path}", "r1", program=t)
    make(text).stage("s", lambda: spark.range(3))
    assert make(text).done("s")
    with pytest.raises(Changed):
        make(text.replace("spare = 3", "spare = 4"))


def test_stages_of_a_program(spark, tmp_path):
    r = Runner(spark, f"file://{tmp_path}", "r2")
    bodies = {"a": lambda: spark.range(4), "b": lambda a: a.where("id > 1"), "c": lambda a, b: a.join(b, "id")}
    edges = [("a", "b"), ("a", "c"), ("b", "c")]
    r.expect(edges)
    a = r.stage("a", bodies["a"])
    r.stage("b", lambda: bodies["b"](a), ["a"])
    assert r.reclaim() == []  # c, which hasn't begun, still needs both
    made = r.program_stages(bodies, edges, ["a", "b", "c"])
    assert sorted(x.id for x in made["c"].collect()) == [2, 3] and set(r.reclaim()) == {"a", "b"}
    assert r.save().count() == 3 and r.rows == []


def test_scalars(spark):
    df = spark.createDataFrame([('{"a": ["x\\ny", {"b": "\\u00e9"}], "c": 1}', "/d/e/f", "COM0.txt")], "j string, p string, n string")
    links = F.array(F.struct(F.lit("/d").alias("folder"), F.lit("/l").alias("alias")), F.struct(F.lit("/x").alias("folder"), F.lit("/y").alias("alias")))
    r = df.select(fn.strings_inside(F.col("j")).alias("s"), fn.aliases(F.col("p"), links).alias("a"), fn.legal_output_name(F.col("n")).alias("ok"), fn.digits_wide(F.lit(101)).alias("w")).first()
    assert (r.s, r.a, r.ok, r.w) == (["x\ny", "\u00e9"], ["/d/e/f", "/l/e/f"], False, 3)
