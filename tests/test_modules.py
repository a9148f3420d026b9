"""Stages as Python modules."""

import pytest

from weftline.plans.language import load
from weftline.sources import modules

SUM = '''
def split(args):
    stage.info(f"{len(args.values)} values")
    return {"chunks": [{"value": v, "__threads": 2} for v in args.values], "join": {"__mem_gb": 4}}

def main(args, outs):
    outs.square = args.value ** 2
    outs.unknown = 1
    if args.value < 0:
        stage.alarm(f"negative {args.value}")
    outs.threads = stage.threads()

def join(args, outs, chunk_defs, chunk_outs):
    assert len(chunk_defs) == len(chunk_outs) and [d.value for d in chunk_defs] == args.values and all(o.sum is None for o in chunk_outs)
    outs.sum = sum(o.square for o in chunk_outs)
    outs.threads = max([o.threads for o in chunk_outs], default=stage.memory_gb())
'''
TEXT = 'stage SUM(in float[] values, out float sum, out float threads, src py "sum") split (in float value, out float square) stage ONE(in int x, out int y, out float bad, src py "one")'


@pytest.fixture(scope="module")
def program():
    from weftline.plans.graph import Body

    return load(TEXT, {"SUM": Body(lambda values: values, lambda **k: {}, lambda **k: {}), "ONE": lambda x: {}})[0]


def test_split_main_join(spark, program):
    df = spark.createDataFrame([(1, "a", [1.0, -2.0, 3.0]), (2, None, []), (3, "c", [4.0])], "id long, kind string, values array<double>")
    got = {r.id: r for r in modules.run(df, program.callables["SUM"], SUM, program.types, ["id", "kind"]).collect()}
    assert {k: (r.kind, r.sum, r.threads) for k, r in got.items()} == {1: ("a", 14.0, 2.0), 2: (None, 0.0, 4.0), 3: ("c", 16.0, 2.0)}
    assert got[1].alarms == ["negative -2.0"] and got[1].log == ["info: 3 values"] and got[2].alarms == []


def test_main_alone(spark, program):
    source = "def main(args, outs):\n    outs.y = None if args.x is None else args.x + 1\n    outs.bad = float('nan')\n"
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, x long")
    assert {r.id: (r.y, r.bad) for r in modules.run(df, program.callables["ONE"], source, program.types, ["id"]).collect()} == {1: (6, None), 2: (None, None)}
    with pytest.raises(Exception, match="ASSERT: too large"):
        modules.run(df, program.callables["ONE"], "def main(args, outs):\n    stage.throw('too large')\n", program.types, ["id"]).collect()
    with pytest.raises(Exception, match="join resources don't include other"):
        modules.run(df, program.callables["ONE"], "def split(args):\n    return {'join': {'other': 1}}\ndef main(args, outs): pass\ndef join(*a): pass\n", program.types, ["id"]).collect()


def test_code_without_spark():
    helper = modules.Helper({"x": 1}, {"__threads": 3}, "/out")
    space = modules.functions("def main(args, outs):\n    outs.y = args.x + stage.threads()\n    outs.path = stage.make_path('f')\n", helper)
    outs = modules.Record({"y": None, "path": None})
    space["main"](modules.Record({"x": 1}), outs)
    assert outs.items() == {"y": 4.0, "path": "/out/f"}
