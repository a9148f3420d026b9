"""Registered queries over the engine's operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import expr, lineage, mapcall, relations, resources, scatter, stats, telemetry, validate
from ..sources import invocation, outputs
from ..types import TypeId, Types
from . import graph, language

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


ORDER = ("l_linenumber", "l_partkey", "l_suppkey")
LINE = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


def lines_by_order(t, *fields: str) -> DataFrame:
    """l_orderkey, lines: the order's lines as structs in fork order."""
    full = (*ORDER, "l_extendedprice", "l_quantity")
    row = F.struct(*full, *(f for f in fields if f not in full))
    return t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("lines"))


def pick(field: str):
    return F.transform("lines", lambda x: x[field])


# Scatter and gather


@query("select l_orderkey, sum(l_quantity * l_quantity) as total from lineitem group by l_orderkey")
def scatter_gather_sum_squares(t):
    return scatter.run(t("lineitem"), ["l_orderkey"], {"square": F.col("l_quantity") * F.col("l_quantity")}, {"total": F.sum("square")})


@query("""select o_orderkey, coalesce(sum(l_quantity * l_quantity), 0.0) as total, count(l_orderkey) as chunks
from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def scatter_zero_chunks(t):
    chunks = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    join = {"total": F.sum("square"), "chunks": F.count("*")}
    return scatter.run(chunks, ["o_orderkey"], {"square": F.col("l_quantity") * F.col("l_quantity")}, join, t("orders").select("o_orderkey"), {"total": 0.0, "chunks": 0})


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority as priority, l_quantity as amount
from lineitem join orders on l_orderkey = o_orderkey""")
def chunk_args_override(t):
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    args = scatter.overlay({"priority": F.col("o_orderpriority"), "amount": F.col("o_totalprice")}, {"amount": F.col("l_quantity"), "__threads": F.lit(2)})
    return both.select("l_orderkey", *ORDER, *(c.alias(n) for n, c in args.items()))


@query("select l_orderkey, sum(l_quantity) as total, max(l_linenumber) as last from lineitem group by l_orderkey")
def scatter_ordered_join(t):
    join = lambda outs: F.struct(F.aggregate(outs, F.lit(0.0), lambda a, o: a + o["q"]).alias("total"), F.element_at(outs, -1)["n"].alias("last"))
    got = scatter.run_ordered(t("lineitem"), ["l_orderkey"], ORDER, {"q": F.col("l_quantity"), "n": F.col("l_linenumber")}, join, "out")
    return got.select("l_orderkey", "out.total", "out.last")


@query(f"""with a as (select l_orderkey, l_quantity as q, {LINE} - 1 as ix from lineitem)
select l_orderkey, (ix // 2)::bigint as chunk, sum(q) as total from a group by all""")
def split_into_chunks(t):
    pairs = lines_by_order(t, "l_quantity").select("l_orderkey", F.posexplode(scatter.chunk_array(pick("l_quantity"), 2)).alias("chunk", "items"))
    return pairs.select("l_orderkey", F.col("chunk").cast("long").alias("chunk"), stats.total(F.col("items")).alias("total"))


# Mapped calls


@query(f"select l_orderkey, ({LINE} - 1)::bigint as ix, l_quantity * 2 + {LINE} - 1 as value from lineitem")
def array_map_call_ordered(t):
    out = mapcall.over_array(pick("l_quantity"), lambda x, i: x * 2 + i)
    return lines_by_order(t, "l_quantity").select("l_orderkey", F.posexplode(out).alias("ix", "value")).withColumn("ix", F.col("ix").cast("long"))


@query(f"""with a as (select o_orderkey, l_quantity, o_orderstatus, {LINE} - 1 as ix, l_orderkey from orders left join lineitem on o_orderkey = l_orderkey)
select o_orderkey, case when l_orderkey is null then -1 else ix end::bigint as ix, case when o_orderstatus = 'F' then null else l_quantity + 1 end as value from a""")
def array_fork_and_gather(t):
    held = t("orders").join(lines_by_order(t, "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    held = held.select("o_orderkey", "o_orderstatus", F.coalesce(pick("l_quantity"), F.array().cast("array<double>")).alias("q"))
    called = mapcall.fork(held, "q").withColumn("v", F.when(F.col("o_orderstatus") != "F", F.col("item") + 1))
    merged = mapcall.gather(called, ["o_orderkey"], "v", "out")
    return merged.select("o_orderkey", F.posexplode_outer("out").alias("ix", "value")).withColumn("ix", F.coalesce(F.col("ix"), F.lit(-1)).cast("long"))


@query("select l_orderkey, l_returnflag as flag, sum(l_quantity) * 10 as value from lineitem group by all")
def map_map_call(t):
    flags = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    maps = flags.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("m"))
    return maps.select("l_orderkey", F.explode(mapcall.over_map(F.col("m"), lambda _, v: v * 10)).alias("flag", "value"))


@query("""with a as (select l_orderkey, l_returnflag as flag, sum(l_quantity) as q from lineitem group by all)
select l_orderkey, flag, (row_number() over (partition by l_orderkey order by flag) - 1)::bigint as ix, q + 1 as value from a""")
def map_fork_and_gather(t):
    flags = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    maps = flags.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("m"))
    forks = mapcall.fork(maps, "m").withColumn("v", F.col("item") + 1)
    merged = mapcall.gather(forks, ["l_orderkey"], "v", "out")
    return merged.select("l_orderkey", F.posexplode(F.array_sort(F.map_entries("out"))).alias("ix", "e")).select("l_orderkey", F.col("e.key").alias("flag"), F.col("ix").cast("long").alias("ix"), F.col("e.value").alias("value"))


@query(f"select l_orderkey, ({LINE} - 1)::bigint as ix, l_extendedprice * (1 - l_discount) as value from lineitem")
def zip_map_call(t):
    both = mapcall.zipped(p=pick("l_extendedprice"), d=pick("l_discount"))
    return lines_by_order(t, "l_extendedprice", "l_discount").select("l_orderkey", F.posexplode(F.transform(both, lambda z: z["p"] * (1 - z["d"]))).alias("ix", "value")).withColumn("ix", F.col("ix").cast("long"))


@query("""select l_orderkey, case when count(*) <> count(distinct l_linenumber)
then 'length mismatch: ' || count(*) || ', ' || count(distinct l_linenumber) end as error from lineitem group by l_orderkey""")
def zip_mismatch_report(t):
    held = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("a"), F.collect_set("l_linenumber").alias("b"))
    return held.select("l_orderkey", mapcall.mismatch(F.size("a"), F.size("b")).alias("error"))


@query("""with s as (select distinct c_mktsegment as segment from customer), r as (select r_name, row_number() over (order by r_name) - 1 as i from region),
g as (select segment, row_number() over (order by segment) - 1 as i from s)
select (g.i * (select count(*) from region) + r.i)::bigint as fork_ix, r_name as region, segment,
'fork' || lpad((g.i * (select count(*) from region) + r.i)::varchar, length((((select count(*) from region) * (select count(*) from s)) - 1)::varchar)::integer, '0') as fork_name from r cross join g""")
def nested_fork_product(t):
    regions = t("region").agg(F.sort_array(F.collect_list("r_name")).alias("regions"))
    segments = t("customer").select("c_mktsegment").distinct().agg(F.sort_array(F.collect_list("c_mktsegment")).alias("segments"))
    forks = mapcall.product({"region": F.col("regions"), "segment": F.col("segments")})
    one = regions.join(F.broadcast(segments))  # one row each
    got = one.select(forks.alias("forks")).select(F.size("forks").alias("n"), F.explode("forks").alias("f"))
    return got.select(F.col("f.fork_ix").cast("long").alias("fork_ix"), "f.region", "f.segment", mapcall.fork_name(F.col("f.fork_ix"), F.col("n")).alias("fork_name"))


@query(f"""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders),
l as (select l_orderkey, l_quantity, {LINE} - 1 as j from lineitem)
select o_custkey, i::bigint as outer_ix, j::bigint as inner_ix, l_quantity + 100 * i + j as value from o join l on o_orderkey = l_orderkey""")
def ragged_nested_forks(t):
    held = t("orders").join(lines_by_order(t, "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inner = F.coalesce(pick("l_quantity"), F.array().cast("array<double>"))
    held = held.select("o_custkey", F.struct("o_orderkey", inner.alias("q")).alias("o")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("os"))
    out = mapcall.nested(F.col("os"), lambda x, i, j: x + 100 * i + j, lambda o: o["q"])
    flat = held.select("o_custkey", F.posexplode(out).alias("outer_ix", "v")).select("o_custkey", "outer_ix", F.posexplode("v").alias("inner_ix", "value"))
    return flat.withColumns({c: F.col(c).cast("long") for c in ("outer_ix", "inner_ix")})


@query("""select o_orderkey, case when o_orderstatus = 'P' then 'null' when count(l_orderkey) = 0 then 'empty' else 'full' end as kind,
case when o_orderstatus = 'P' then null else count(l_orderkey) end::bigint as n from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus""")
def empty_vs_null_map(t):
    held = t("orders").join(lines_by_order(t, "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    lines = F.when(F.col("o_orderstatus") != "P", F.coalesce(pick("l_quantity"), F.array().cast("array<double>")))
    forks = mapcall.fork(held.select("o_orderkey", lines.alias("q")), "q").withColumn("v", F.col("item") * 2)
    out = mapcall.gather(forks, ["o_orderkey"], "v", "out")
    kind = F.when(F.col("out").isNull(), "null").when(F.size("out") == 0, "empty").otherwise("full")
    return out.select("o_orderkey", kind.alias("kind"), F.when(F.col("out").isNotNull(), F.size("out")).cast("long").alias("n"))


@query(f"select l_orderkey, ({LINE} - 1)::bigint as fork_ix, l_quantity * 2 as a, l_extendedprice as b from lineitem")
def fork_alignment(t):
    lines = lines_by_order(t, "l_quantity", "l_extendedprice")
    a = mapcall.fork(lines.select("l_orderkey", pick("l_quantity").alias("x")), "x", "q").select("l_orderkey", "fork_ix", (F.col("q") * 2).alias("a"))
    b = mapcall.fork(lines.select("l_orderkey", pick("l_extendedprice").alias("x")), "x", "b").select("l_orderkey", "fork_ix", "b")
    return mapcall.align(a, b, ["l_orderkey"]).withColumn("fork_ix", F.col("fork_ix").cast("long"))


@query("""select l_orderkey, v.way as way, sum((l_quantity + 1) * 2) as total from lineitem cross join (values ('fused'), ('gathered')) v(way) group by all""")
def split_merge_fusion(t):
    lines = lines_by_order(t, "l_quantity").select("l_orderkey", pick("l_quantity").alias("q"))
    one, two = (lambda x: x + 1), (lambda x: x * 2)
    fused = lines.select("l_orderkey", F.lit("fused").alias("way"), stats.total(mapcall.over_array(F.col("q"), mapcall.fuse(one, two))).alias("total"))
    first = mapcall.gather(mapcall.fork(lines, "q").withColumn("v", one(F.col("item"))), ["l_orderkey"], "v", "q")
    second = mapcall.gather(mapcall.fork(first, "q").withColumn("v", two(F.col("item"))), ["l_orderkey"], "v", "q")
    return fused.unionByName(second.select("l_orderkey", F.lit("gathered").alias("way"), stats.total(F.col("q")).alias("total")))


@query(f"""with a as (select l_orderkey, l_quantity, {LINE} as n from lineitem)
select l_orderkey, max(case when n = 1 then l_quantity end) as first, max(case when n = 2 then l_quantity end) as second from a group by l_orderkey""")
def element_extract(t):
    q = pick("l_quantity")
    return lines_by_order(t, "l_quantity").select("l_orderkey", mapcall.element(q, 0).alias("first"), mapcall.element(q, 1, strict=False).alias("second"))


# Projection and narrowing


def customer_records(t) -> DataFrame:
    """A customer with its orders nested: struct, array of structs and map of structs."""
    orders = t("orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("state"), "o_totalprice"))).alias("orders"),
    )
    who = t("customer").select("c_custkey", F.struct("c_name", F.struct("c_nationkey", "c_mktsegment").alias("home"), "c_acctbal").alias("who"))
    held = who.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return held.withColumn("by_key", F.map_from_entries(F.transform("orders", lambda o: F.struct(o["o_orderkey"].cast("string"), o))))


@query("select c_custkey, c_name, c_mktsegment from customer")
def struct_project(t):
    df = customer_records(t)
    return df.select("c_custkey", expr.path_of(df, "who.c_name").alias("c_name"), expr.path_of(df, "who.home.c_mktsegment").alias("c_mktsegment"))


@query("select o_custkey as c_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::bigint as ix, o_orderstatus as status from orders")
def array_project(t):
    df = customer_records(t)
    return df.select("c_custkey", F.posexplode(expr.path_of(df, "orders.state.o_orderstatus")).alias("ix", "status")).withColumn("ix", F.col("ix").cast("long"))


@query("select o_custkey as c_custkey, o_orderkey::varchar as key, o_orderpriority as priority from orders")
def map_project(t):
    df = customer_records(t)
    return df.select("c_custkey", F.explode(expr.path_of(df, "by_key.state.o_orderpriority")).alias("key", "priority"))


@query("select o_custkey as c_custkey, o_orderkey, o_orderstatus as status, c_mktsegment as segment from orders join customer on o_custkey = c_custkey")
def struct_narrow(t):
    df = customer_records(t)
    types = Types.of({"State": {"o_orderstatus": "string"}, "Order": {"state": "State", "o_orderkey": "int"}, "Home": {"c_mktsegment": "string"}, "Who": {"home": "Home"}})
    orders, who = types.to_spark(TypeId.parse("Order[]")), types.to_spark(TypeId.parse("Who"))
    narrow = df.select("c_custkey", expr.narrow(df["orders"], df.schema["orders"].dataType, orders).alias("orders"), expr.narrow(df["who"], df.schema["who"].dataType, who).alias("who"))
    flat = narrow.select("c_custkey", "who", F.explode("orders").alias("o"))
    return flat.select("c_custkey", "o.o_orderkey", F.col("o.state.o_orderstatus").alias("status"), F.col("who.home.c_mktsegment").alias("segment"))


@query("select c_custkey, c_name, c_acctbal from customer")
def wildcard_bind(t):
    df = customer_records(t)
    return df.select(*expr.wildcard(df, None, ["c_custkey", "other"]), *expr.wildcard(df, "who", ["c_name", "c_acctbal", "unbound"]))


@query("select n_nationkey, k.key as key, case k.key when 'name' then n_name else n_regionkey::varchar end as value from nation cross join (values ('name'), ('region')) k(key)")
def struct_to_map(t):
    df = t("nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")).alias("s"))
    to = Types.of().to_spark(TypeId.parse("map<string>"))
    return df.select("n_nationkey", F.explode(expr.narrow(df["s"], df.schema["s"].dataType, to)).alias("key", "value"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_path_props(t):
    return t("events").select("event_id", expr.json_path(F.col("props"), "k").alias("k"))


@query("""select event_id, case when json_extract_string(props, '$.k') is null then 1 else 0 end::bigint + case when try_cast(json_extract_string(props, '$.k') as bigint) is null and json_extract_string(props, '$.k') is not null then 1 else 0 end::bigint as int_errors,
1::bigint as string_errors, 2::bigint as missing_errors from events""")
def typed_validation(t):
    e = t("events").select("event_id", F.try_parse_json("props").alias("v"))
    none = Types.of()
    n = lambda params: F.size(validate.arguments(F.col("v"), {k: TypeId.parse(v) for k, v in params.items()}, none, parsed=True).errors).cast("long")
    return e.select("event_id", n({"k": "int"}).alias("int_errors"), n({"k": "string"}).alias("string_errors"), n({"other": "float"}).alias("missing_errors"))


@query("""select l_orderkey, (count(*) filter (where l_returnflag = 'R') + count(*) filter (where l_linestatus = 'F') + max(case when l_orderkey % 4 = 0 then 1 else 0 end))::bigint as errors,
count(*) filter (where l_returnflag = 'R')::bigint as quantity_errors from lineitem group by l_orderkey""")
def typed_validation_nested(t):
    """Documents of nested structs: a quantity that is text, a missing member, a whole number with a fraction."""
    line = F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"), F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).alias("q_text"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("status"))
    head = F.struct(F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey") + 0.5).otherwise(F.col("l_orderkey")).alias("id"), "lines")
    docs = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines")).select("l_orderkey", F.try_parse_json(F.replace(F.to_json(head), F.lit('"q_text"'), F.lit('"q"'))).alias("v"))
    types = Types.of({"LINE": {"q": "float", "status": "string"}})
    errors = validate.arguments(F.col("v"), {"id": TypeId.parse("int"), "lines": TypeId.parse("LINE[]")}, types, parsed=True).errors
    found = docs.select("l_orderkey", errors.alias("e"))
    return found.select("l_orderkey", F.size("e").cast("long").alias("errors"), F.size(F.filter("e", lambda x: x.contains(".q: not a legal float"))).cast("long").alias("quantity_errors"))


DOCS = """select o_orderkey, o_orderstatus, o_orderpriority from orders"""


@query(f"""with d as ({DOCS}) select o_orderkey, (case when o_orderstatus = 'F' then 1 else 0 end + case when o_orderpriority like '1%' then 1 else 0 end)::bigint as errors,
case when o_orderstatus = 'P' then 1 else 0 end::bigint as alarms from d""")
def output_validation(t):
    """Outputs: a missing one (status F) and one of another type (priority 1) are errors, an unexpected one (status P) is an alarm."""
    o = t("orders")
    doc = F.struct(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority").startswith("1"), F.lit(1)).alias("name_number"), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderstatus") == "P", F.lit("x")).alias("more"))
    held = o.select("o_orderkey", F.try_parse_json(F.replace(F.to_json(doc), F.lit('"name_number"'), F.lit('"name"'))).alias("v"))
    report = validate.arguments(F.col("v"), {"price": TypeId.parse("float"), "name": TypeId.parse("string")}, Types.of(), outputs=True, parsed=True)
    return held.select("o_orderkey", F.size(report.errors).cast("long").alias("errors"), F.size(report.alarms).cast("long").alias("alarms"))


@query("select o_custkey, count(*) filter (where o_orderstatus = 'P') as alarms, count(*) as records, min(o_orderkey) filter (where o_orderstatus = 'P') as first_alarm from orders group by o_custkey")
def alarm_ledger(t):
    """Alarms of all records of a run, collected without stopping it."""
    held = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.array(F.lit("pending"))).otherwise(F.array().cast("array<string>")).alias("alarms"))
    return validate.collected(held, ["o_custkey"], "alarms", "o_orderkey").select("o_custkey", "alarms", "records", F.col("first").alias("first_alarm"))


@query("select o_orderkey, o_orderstatus = 'P' as failed, case when o_orderstatus = 'F' then null else o_totalprice end as price from orders")
def null_control_reported(t):
    """A NULL control (status P) is an error of its record, neither true nor false."""
    flag = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    held = t("orders").select("o_orderkey", "o_totalprice", flag.alias("off"))
    return held.select("o_orderkey", F.col("off").isNull().alias("failed"), expr.disabled(F.col("o_totalprice"), F.coalesce("off", F.lit(False))).alias("price"))


# Conditional calls


@query("select o_orderkey, case when o_orderstatus = 'F' then null else o_totalprice end as price from orders")
def disabled_value(t):
    return t("orders").select("o_orderkey", expr.disabled(F.col("o_totalprice"), F.col("o_orderstatus") == "F").alias("price"))


@query("select o_orderkey, case when o_orderstatus = 'F' or o_orderpriority like '1%' then null else o_totalprice end as price from orders")
def disabled_inherited(t):
    flag = expr.inherited(F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"))
    return t("orders").select("o_orderkey", expr.disabled(F.col("o_totalprice"), flag).alias("price"))


@query(f"select l_orderkey, ({LINE} - 1)::bigint as ix, case when l_returnflag = 'R' then null else l_quantity end as value from lineitem")
def disabled_per_fork(t):
    flags = F.transform(pick("l_returnflag"), lambda f: f == "R")
    return lines_by_order(t, "l_quantity", "l_returnflag").select("l_orderkey", F.posexplode(expr.disabled_each(pick("l_quantity"), flags)).alias("ix", "value")).withColumn("ix", F.col("ix").cast("long"))


# Canonical stages


@query("""select o_custkey, count(*) as n, round(avg(o_totalprice), 7) as mean, round(stddev_pop(o_totalprice), 7) as std_dev from orders group by o_custkey""")
def statistics_composed(t):
    s = stats.statistics(F.col("x"))
    held = t("orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("x"))
    return held.select("o_custkey", s["n"].alias("n"), F.round(s["mean"], 7).alias("mean"), F.round(s["std_dev"], 7).alias("std_dev"))


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std_dev from events group by event_type")
def statistics_fused(t):
    s = stats.statistics_fused(F.col("value"))
    return t("events").groupBy("event_type").agg(s["n"].alias("n"), F.round(s["mean"], 6).alias("mean"), F.round(s["std_dev"], 6).alias("std_dev"))


@query("select p_partkey, ((p_size - 1) * p_size * (2 * p_size - 1) // 6)::double as total from part")
def range_pow_sum(t):
    return t("part").select("p_partkey", stats.total(F.transform(stats.range_(F.lit(0).cast("long"), F.col("p_size").cast("long")), lambda x: stats.pow_(x, 2))).alias("total"))


@query("select user_id, event_type, arg_max(value, ts) as value from events group by all")
def dict_merge_last_wins(t):
    latest = t("events").groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"))
    dicts = latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("d"))
    merged = stats.merge_dicts(F.transform_values("d", lambda _, v: -v), F.col("d"))
    return dicts.select("user_id", F.explode(merged).alias("event_type", "value"))


@query("select c_custkey, s.pos::bigint as ix, case s.pos when 0 then c_name else c_mktsegment end as value from customer cross join (values (0), (1)) s(pos)")
def literal_concat(t):
    return t("customer").select("c_custkey", F.posexplode(F.array("c_name", "c_mktsegment")).alias("ix", "value")).withColumn("ix", F.col("ix").cast("long"))


# Run history


JOB = "select event_id, user_id, event_type, epoch_us(ts) as us, json_extract_string(props, '$.k')::bigint as k from events"


def jobs(t) -> DataFrame:
    """Events as jobs: k is their duration, its remainders their threads, memory and traffic."""
    return t("events").select("event_id", "user_id", "event_type", "value", telemetry.micros(F.col("ts")).alias("us"), expr.json_path(F.col("props"), "k").cast("long").alias("k"))


@query(f"with j as ({JOB}) select event_id, (k % 4 + 1) * k / 3600 as core_hours, greatest(k * 3 % 101, k * 7 % 97, k) as maxrss, case when k > 0 then (k * 13 % 50) / k end as in_rate from j")
def perf_job_reduce(t):
    k = F.col("k")
    out = telemetry.reduce_job(k % 4 + 1, k, [k * 3 % 101, k * 7 % 97, k], {"in": k * 13 % 50})
    return jobs(t).select("event_id", *(c.alias(n) for n, c in out.items()))


@query(f"""with j as ({JOB}) select event_type, min(us) as start, max(us + k) as "end", max(us + k) - min(us) as walltime, sum(k)::bigint as duration, sum(k * 13 % 50)::bigint as io,
case when sum(k) > 0 then sum(k * 13 % 50)::double / sum(k)::double end as io_rate, max(k * 3 % 101) as rss from j group by event_type""")
def perf_rollup(t):
    k = F.col("k")
    return telemetry.rollup(jobs(t).withColumns({"e": F.col("us") + k, "io": k * 13 % 50, "rss": k * 3 % 101}), ["event_type"], "us", "e", "k", ["io"], ["rss"])


@query(f"""with j as (select *, (k * 13 % 50)::double as x from ({JOB}) where k > 0)
select user_id, round(sqrt(greatest(0.0, sum(x * x / k) / sum(k)::double - (sum(x) / sum(k)::double) ** 2)), 6) as dev from j group by user_id""")
def perf_weighted_dev(t):
    k = F.col("k")
    return jobs(t).where("k > 0").groupBy("user_id").agg(F.round(telemetry.weighted_dev((k * 13 % 50).cast("double"), k.cast("double")), 6).alias("dev"))


@query(f"""with j as ({JOB}), r as (select *, us - lag(us) over w as dt, k - lag(k) over w as dx from j window w as (partition by user_id order by us))
select event_id, user_id, round(case when dt > 0 then dx * 1000000.0 / dt end, 9) as rate, round(max(case when dt > 0 then dx * 1000000.0 / dt end) over (partition by user_id order by us rows unbounded preceding), 9) as max_rate from r""")
def io_rates(t):
    got = telemetry.sampled_rates(jobs(t).withColumn("x", F.col("k") * F.lit(1000000.0)), ["user_id"], "us", "x")
    return got.select("event_id", "user_id", F.round("rate", 9).alias("rate"), F.round("max_rate", 9).alias("max_rate"))


@query(f"""with j as (select *, us // 3600000000 as s, case when k >= 50 then k else -k end as d from ({JOB})),
m as (select *, case when lag(s) over w = s and lag(d >= 0) over w = (d >= 0) then 0 else 1 end as new from j window w as (partition by user_id order by us)),
i as (select *, sum(new) over (partition by user_id order by us rows unbounded preceding) as island from m)
select user_id, min(s) as second, sum(d)::bigint as d, count(*) as n from i group by user_id, island""")
def event_merge_islands(t):
    j = jobs(t).withColumn("d", F.when(F.col("k") >= 50, F.col("k")).otherwise(-F.col("k"))).select("user_id", "us", "d")
    return telemetry.merge_islands(j, ["user_id"], ["us"], F.floor(F.col("us") / F.lit(3600000000)).cast("long"), "d")


@query("""with recursive e as (select user_id, event_id, event_type, epoch_us(ts) as us, row_number() over (partition by user_id order by ts) as n from events),
f as (select user_id, event_id, us, event_type, n, us as anchor, true as kept from e where n = 1 union all
select e.user_id, e.event_id, e.us, e.event_type, e.n, case when e.event_type = f.event_type and e.us - f.anchor < 864000000000 then f.anchor else e.us end,
not (e.event_type = f.event_type and e.us - f.anchor < 864000000000) from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select user_id, event_id, us, event_type from f where kept""")
def event_collapse_fold(t):
    return telemetry.collapse(jobs(t).select("user_id", "us", "event_id", "event_type"), ["user_id"], "event_type", "us", ["us"], 864000000000)


@query(f"""with j as (select *, case when k >= 50 then k else -k end as d from ({JOB})),
r as (select user_id, d, sum(d) over (partition by user_id order by us rows unbounded preceding) as t from j)
select user_id, greatest(max(t), 0)::bigint as high_water, sum(d)::bigint as total from r group by user_id""")
def high_water_mark(t):
    return telemetry.high_water(jobs(t).withColumn("d", F.when(F.col("k") >= 50, F.col("k")).otherwise(-F.col("k"))), ["user_id"], ["us"], "d")


@query(f"""with j as ({JOB}) select event_type, sum(k)::bigint as size, count(*) as count, max(us) as latest, count(distinct user_id) as paths from j group by event_type""")
def kill_report_merge(t):
    return telemetry.merge_reports(jobs(t).withColumn("p", F.col("user_id").cast("string")), ["event_type"], "k", "p", "us")


@query(f"""with j as (select *, us // 3600000000 as s, case when k >= 50 then k else -k end as d from ({JOB})),
m as (select *, case when lag(s) over w = s and (lag(d) over w >= 0) = (d >= 0) then 0 else 1 end as new from j window w as (partition by event_type order by us, d)),
g as (select *, sum(new) over (partition by event_type order by us, d rows unbounded preceding) as island from m)
select event_type, min(s)::bigint as second, sum(d)::bigint as d, count(*) as n from g group by event_type, island""")
def kill_report_events(t):
    """The reports of all users of an event type as one list of events."""
    j = jobs(t).withColumn("d", F.when(F.col("k") >= 50, F.col("k")).otherwise(-F.col("k")))
    return telemetry.merge_report_events(j, ["event_type"], "us", F.floor(F.col("us") / F.lit(3600000000)), "d").select("event_type", F.col("second").cast("long").alias("second"), "d", "n")


@query(f"""with j as ({JOB}), u as (select user_id, min(us) as us from j group by user_id),
t as (select a.user_id, a.user_id // 5 as root from u a), s as (select us // 86400000000 as day, user_id, max(k) as a from j group by all),
x as (select root, day, sum(a) as a from s join t using (user_id) group by all) select root::bigint as root, max(a)::bigint as a from x group by root""")
def process_tree_memory(t):
    """Users as processes of which each but the first of five is a child of the one before; a tree is named by its first one's number / 5."""
    j = jobs(t).withColumns({"day": F.floor(F.col("us") / F.lit(86400000000)), "a": F.col("k")})
    span = j.select("user_id").distinct().agg(F.max("user_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("p"))
    tree = telemetry.roots(span.withColumn("up", F.when(F.col("p") % 5 != 0, F.col("p") - 1)), "p", "up")
    held = j.join(tree, F.col("user_id") == F.col("p")).withColumn("root", F.floor(F.col("root") / 5))
    return telemetry.memory_high_water(held, ["root"], "user_id", "day", ["a"])


@query(f"""with j as ({JOB}), r as (select user_id, (us - lag(us) over w) / 1000000.0 as dt, (k - lag(k) over w)::double as dx from j window w as (partition by user_id order by us)), p as (select * from r where dt > 0)
select user_id, round(max(dx / dt), 6) as max_rate, round(sum(dx) / sum(dt), 6) + 0.0 as rate, round(sqrt(greatest(0.0, sum(dx * dx / dt) / sum(dt) - (sum(dx) / sum(dt)) ** 2)), 4) as rate_dev from p group by user_id""")
def io_rate_stats(t):
    got = telemetry.rate_stats(jobs(t).withColumn("s", F.col("us") / F.lit(1000000.0)), ["user_id"], "s", "k")
    return got.select("user_id", F.round("max_rate", 6).alias("max_rate"), (F.round("rate", 6) + F.lit(0.0)).alias("rate"), F.round("rate_dev", 4).alias("rate_dev"))


@query(f"""with j as ({JOB}), p as (select unnest(['run', 'run.' || event_type, 'run.' || event_type || '.' || user_id]) as node, * from j)
select node, min(us) as start, max(us + k) as "end", max(us + k) - min(us) as walltime, sum(k)::bigint as duration, sum(k * 13 % 50)::bigint as io,
case when sum(k) > 0 then sum(k * 13 % 50)::double / sum(k)::double end as io_rate from p group by node""")
def perf_rollup_tree(t):
    k = F.col("k")
    held = jobs(t).withColumns({"e": F.col("us") + k, "io": k * 13 % 50, "node": F.concat_ws(".", F.lit("run"), "event_type", F.col("user_id").cast("string"))})
    return telemetry.rollup_paths(held, "node", "us", "e", "k", ["io"])


@query(f"""with e as (select event_type, us // 86400000000 as day, user_id, max(k) as a, max(k * 3 % 101) as b from ({JOB}) group by all),
s as (select event_type, day, sum(a) as a, sum(b) as b from e group by all)
select event_type, max(a)::bigint as a, max(b)::bigint as b from s group by event_type""")
def memory_high_water(t):
    j = jobs(t).withColumns({"day": F.floor(F.col("us") / F.lit(86400000000)), "a": F.col("k"), "b": F.col("k") * 3 % 101})
    return telemetry.memory_high_water(j, ["event_type"], "user_id", "day", ["a", "b"])


@query(f"with j as ({JOB}), l as (select user_id, event_type, arg_max(k, us) as k from j group by all) select user_id, sum(k)::bigint as k from l group by user_id")
def dead_process_usage(t):
    return telemetry.dead_usage(jobs(t), ["user_id", "event_type"], "us", "k").groupBy("user_id").agg(F.sum("k").alias("k"))


@query("""select o_custkey, case when bool_or(o_orderstatus = 'F') then 'F' when bool_or(o_orderstatus = 'P') then 'P' when bool_or(o_orderstatus = 'O') then 'O' end as state from orders group by o_custkey""")
def state_reduction(t):
    return t("orders").groupBy("o_custkey").agg(telemetry.reduce_states(F.col("o_orderstatus"), ["F", "P", "O"]).alias("state"))


# Relations of the runtime


@query("select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def queue_reconcile(t):
    return relations.reconcile(t("orders").select("o_orderkey", "o_orderstatus"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""select e.event_id, c_custkey is not null as known from events e left join customer on user_id = c_custkey""")
def journal_lookup(t):
    events = t("events").select("event_id", F.col("user_id").alias("c_custkey"))
    known, odd = relations.journal_lookup(events, t("customer").select("c_custkey"), "c_custkey")
    return known.select("event_id", F.lit(True).alias("known")).unionByName(odd.select("event_id", F.lit(False).alias("known")))


@query("""with b as (select o_orderkey, epoch_us(o_orderdate::timestamp) as d, o_orderstatus, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O') as seen from orders),
s as (select o_orderkey, case when not seen then coalesce(case when o_orderstatus = 'P' then 100 end, 5000) end::bigint as since from b)
select o_orderkey, since, coalesce(5000 - since > 3600, false) as failed from s""")
def queue_grace(t):
    """Jobs (orders) that the cluster (lines of status O) doesn't report: stamped when first missed, failed after the grace period."""
    believed = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(100)).cast("long").alias("since"))
    reported = t("lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relations.missing_since(believed, reported, "o_orderkey", "since", F.lit(5000).cast("long"), F.lit(3600))


@query("""with j as (select event_id, user_id as node, event_type as u from events), n as (select c_custkey as node, case when c_acctbal > 5000 then 'error' else 'signup' end as u from customer)
select event_id, 'current' as entry from j join n using (node, u) union all select event_id, 'unknown' as entry from j where node not in (select node from n)""")
def journal_uniquifiers(t):
    """Journal entries of known nodes; those of an earlier attempt are ignored, those of unknown nodes warned of."""
    journal = t("events").select("event_id", F.col("user_id").alias("node"), F.col("event_type").alias("u"))
    nodes = t("customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") > 5000, "error").otherwise("signup").alias("u"))
    known, odd = relations.journal_lookup(journal, nodes, "node", "u")
    return known.select("event_id", F.lit("current").alias("entry")).unionByName(odd.select("event_id", F.lit("unknown").alias("entry")))


NAMES = "select c_custkey, 'top.' || r_name || '.' || n_name || '.' || c_name as name, r_name, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query(f"""with n as ({NAMES}), o as (select 'top.' || r_name as key, r_regionkey * 100 as value from region where r_name < 'E'
union all select 'top.' || r_name || '.' || n_name, n_nationkey from nation join region on n_regionkey = r_regionkey where n_name > 'NATION_15'),
p as (select c_custkey, value, length(key) as d from n join o on name = key or starts_with(name, key || '.'))
select n.c_custkey, coalesce(arg_max(value, d), -1)::bigint as value from n left join p on n.c_custkey = p.c_custkey group by n.c_custkey""")
def nearest_ancestor_override(t):
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", F.lit("top"), "r_name", "n_name", "c_name").alias("name"))
    top = t("region").where("r_name < 'E'").select(F.concat(F.lit("top."), "r_name").alias("key"), (F.col("r_regionkey") * 100).cast("long").alias("value"))
    low = nation.where("n_name > 'NATION_15'").select(F.concat_ws(".", F.lit("top"), "r_name", "n_name").alias("key"), F.col("n_nationkey").cast("long").alias("value"))
    return relations.nearest_override(names, "name", top.unionByName(low), "key", "value", -1).select("c_custkey", "value")


PATHS = """with f as (select distinct regexp_replace(url, '^[a-z]+://', '') as f from pages), a as (select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') as a from pages)"""


def paths(t) -> tuple[DataFrame, DataFrame]:
    files = t("pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("f")).distinct()
    return files, files.select(F.regexp_replace("f", "/[^/]*$", "").alias("a")).distinct()


@query(f"{PATHS} select f, a from f join a on f = a or starts_with(f, a || '/') or starts_with(a, f || '/')")
def path_containment_join(t):
    files, args = paths(t)
    return relations.containment(files, "f", args, "a")


@query(f"""{PATHS}, b as (select a from a where contains(a, '/en')) select f from f where not exists (select 1 from b where f = a or starts_with(f, a || '/') or starts_with(a, f || '/'))""")
def unreferenced_files(t):
    files, args = paths(t)
    return relations.unreferenced(files, "f", args.where("contains(a, '/en')"), "a")


@query(f"""{PATHS}, u as (select f as p, length(f) as n from f union all select a, length(a) from a), g as (select p, sum(n) as n from u group by p),
t as (select p from g where not exists (select 1 from g h where starts_with(g.p, h.p || '/')))
select t.p as path, sum(g.n)::bigint as size from t join g on g.p = t.p or starts_with(g.p, t.p || '/') group by t.p""")
def collapse_nested_paths(t):
    files, args = paths(t)
    every = files.select(F.col("f").alias("path")).unionByName(args.select(F.col("a").alias("path"))).withColumn("size", F.length("path").cast("long"))
    return relations.collapse_paths(every, "path", "size")


@query("select l_partkey, count(*) filter (where l_linestatus <> 'F') as waiting, bool_and(l_linestatus = 'F') as may_go from lineitem group by l_partkey")
def consumer_refcount(t):
    return relations.refcount(t("lineitem"), "l_partkey", F.col("l_linestatus") == "F")


@query("select l_orderkey as node, bool_and(coalesce(s_acctbal > 0, false)) as ready from lineitem left join supplier on l_suppkey = s_suppkey group by l_orderkey")
def upstream_ready(t):
    states = t("supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_acctbal") > 0, "complete").otherwise("running").alias("state"))
    return relations.ready(t("lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("up")), states, "node", "up", "state", ["complete", "disabled"])


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(case when l_linenumber = 3 then 4.0 end, case when l_returnflag = 'R' then l_discount * 10 when l_returnflag = 'N' then -2.5 end, case when l_linestatus = 'F' then l_tax * 10 end, 1.0) as asked from lineitem),
d as (select *, case when asked = 0 then 1.0 else asked end as a from r), u as (select *, case when a >= 0 then ceil(a * 100) else floor(a * 100) end / 100 as v from d)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when v < 0 then greatest(-v, 6.0) else least(v, 6.0) end as threads from u""")
def resource_resolve(t):
    split = F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 10).when(F.col("l_returnflag") == "N", -2.5)
    threads = resources.resolve(F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 10), split, F.when(F.col("l_linenumber") == 3, 4.0), 1.0, 6.0, 100)
    return t("lineitem").select("l_orderkey", *ORDER, threads.alias("threads"))


@query("""select event_id, case when regexp_matches(event_type || ': ' || props, '^error.*"k": [0-4]') then 'transient' when regexp_matches(event_type || ': ' || props, '^error') then 'fatal' else 'none' end as kind from events""")
def error_classify(t):
    text = F.concat("event_type", F.lit(": "), "props")
    return t("events").select("event_id", fn.classify(text, [('^error.*"k": [0-4]', "transient"), ("^error", "fatal")], "none").alias("kind"))


@query("""with n as (select page_id, url, regexp_extract(url, '[^/]*$') as leaf from pages)
select page_id, (octet_length(url::blob) <= 255 and url not in ('', '.', '..') and not contains(url, '/')) as whole, (octet_length(leaf::blob) <= 255 and leaf not in ('', '.', '..') and not contains(leaf, '/')) as last from n""")
def filename_legal(t):
    leaf = F.regexp_extract("url", "[^/]*$", 0)
    return t("pages").select("page_id", fn.legal_unix_name(F.col("url")).alias("whole"), fn.legal_unix_name(leaf).alias("last"))


@query(f"with n as ({NAMES}) select c_custkey, n_name || '.' || substr(name, length('top.' || r_name || '.' || n_name || '.') + 1) as partial from n")
def partial_name(t):
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return names.select("c_custkey", fn.partial_name(F.concat_ws(".", F.lit("top"), "r_name", "n_name", "c_name")).alias("partial"))


@query("""select event_id, case when user_id % 7 = 0 then null else value end as clean, case when value = floor(value) then value::bigint end as whole,
case when value >= 0 then ceil(value * 4) else floor(value * 4) end / 4 as up, lpad((event_id % 100)::varchar, 2, '0') as padded,
(event_id % 3)::varchar || ' ' || case when event_id % 3 = 1 then 'job' else 'jobs' end as said from events""")
def scalar_functions(t):
    v = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    n = F.col("event_id") % 100
    return t("events").select("event_id", fn.sanitise(v).alias("clean"), fn.int_from_float(F.col("value")).alias("whole"), fn.round_up(F.col("value"), 4).alias("up"), fn.zero_pad(n, F.lit(100)).alias("padded"), fn.plural(F.col("event_id") % 3, "job").alias("said"))


@query("""select event_id, 'run.' || event_type as node, (event_id % 5)::varchar as fork, (event_id % 9)::varchar as chunk, 'complete' as state from events""")
def journal_parse(t):
    name = F.concat(F.lit("run."), "event_type", F.lit(".fork"), (F.col("event_id") % 5).cast("string"), F.lit(".chnk"), (F.col("event_id") % 9).cast("string"), F.lit(".u00ff.complete"))
    return t("events").select("event_id", fn.journal_parts(name).alias("p")).select("event_id", "p.node", "p.fork", "p.chunk", "p.state")


# Program graphs


EDGES = """with recursive e as (select 'world' as src, r_name as dst from region union all select r_name, 'n' || n_nationkey from nation join region on n_regionkey = r_regionkey
union all select distinct 'n' || c_nationkey, 'seg ' || c_mktsegment from customer)"""


def edges(t) -> DataFrame:
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    low = t("customer").select(key("c_nationkey").alias("src"), F.concat(F.lit("seg "), "c_mktsegment").alias("dst")).distinct()
    return t("region").select(F.lit("world").alias("src"), F.col("r_name").alias("dst")).unionByName(nation.select(F.col("r_name").alias("src"), key("n_nationkey").alias("dst"))).unionByName(low)


@query(f"{EDGES}, c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def lineage_closure(t):
    return lineage.closure(edges(t))


@query(f"{EDGES}, s as (select r_name as node from region where r_regionkey < 2 union select e.dst from s join e on s.node = e.src), n as (select src as node from e union select dst from e) select node from n where node not in (select node from s)")
def unused_nodes(t):
    e = edges(t)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return lineage.unused(nodes, e, t("region").where("r_regionkey < 2").select(F.col("r_name").alias("node")))


@query("select distinct n_name as node, c_mktsegment as output from customer join nation on c_nationkey = n_nationkey where (n_nationkey, c_mktsegment) not in (select c_nationkey, c_mktsegment from customer where c_acctbal > 9500)")
def unused_outputs(t):
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node"), F.col("c_mktsegment").alias("output"), "c_acctbal")
    return lineage.unused_outputs(both.select("node", "output").distinct(), both.where("c_acctbal > 9500"))


@query(f"{EDGES}, s as (select 'world' as node union select e.dst from s join e on s.node = e.src) select node from s where node <> 'world'")
def trace_lineage(t):
    return lineage.trace(edges(t), "world")


# Programs


PROGRAM = """
stage SQUARE(in float x, out float y, src py "square")
stage TOTAL(in float[] xs, out float sum, src py "total")
pipeline SUM_SQUARES(in float[] xs, in bool off, out float sum, out float[] each)
{
    map call SQUARE(x = split self.xs)
    call TOTAL(xs = SQUARE.y) using (disabled = self.off)
    return (sum = TOTAL.sum, each = SQUARE.y)
}
pipeline BY_KIND(in map<float[]> sets, in bool off, out map<float> sums)
{
    map call SUM_SQUARES(xs = split self.sets, off = self.off)
    return (sums = SUM_SQUARES.sum)
}
"""
BODIES = {"SQUARE": lambda x: {"y": x * x}, "TOTAL": lambda xs: {"sum": stats.total(xs)}}


@query("select o_orderkey, case when o_orderstatus = 'F' then null else sum(l_quantity * l_quantity) end as sum, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus")
def program_sum_squares(t):
    program, _ = language.load(PROGRAM, BODIES)
    held = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderstatus").agg(F.collect_list("l_quantity").alias("xs"))
    held = held.withColumn("off", F.col("o_orderstatus") == "F")
    return program.apply("SUM_SQUARES", held, keep=("o_orderkey",)).select("o_orderkey", "sum", F.size("each").cast("long").alias("n"))


@query("select l_orderkey, l_returnflag as kind, sum(l_quantity * l_quantity) as sum from lineitem group by all")
def program_mapped_pipeline(t):
    program, _ = language.load(PROGRAM, BODIES)
    kinds = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_quantity").alias("q"))
    held = kinds.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("sets")).withColumn("off", F.lit(False))
    return program.apply("BY_KIND", held, keep=("l_orderkey",)).select("l_orderkey", F.explode("sums").alias("kind", "sum"))


SPLIT_PROGRAM = """
stage SUM_SQUARES(in float[] values, out float sum, out int chunks, src py "sum_squares") split (in float[] part, out float square)
pipeline CHECKED(in float[] values, out float sum, out int chunks)
{
    call preflight CHECK(values = self.values)
    call SUM_SQUARES(values = self.values)
    return (sum = SUM_SQUARES.sum, chunks = SUM_SQUARES.chunks)
}
"""
SPLIT_BODIES = {
    "CHECK": lambda values: {"values may not be null": values.isNotNull()},
    "SUM_SQUARES": graph.Body(
        split=lambda values: F.transform(scatter.chunk_array(values, 3), lambda p: F.struct(p.alias("part"))),
        main=lambda values, part: {"square": F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x)},
        join=lambda values, chunk_defs, chunk_outs: {"sum": F.aggregate(chunk_outs, F.lit(0.0), lambda a, o: a + o["square"]), "chunks": F.size(chunk_defs)},
    ),
}


@query("select l_orderkey, sum(l_quantity * l_quantity) as sum, ((count(*) + 2) // 3)::bigint as chunks from lineitem group by l_orderkey")
def program_split_stage(t):
    """A stage of split, main and join, behind a preflight check."""
    program, _ = language.load('stage CHECK(in float[] values, src py "check")' + SPLIT_PROGRAM, SPLIT_BODIES)
    held = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("values"))
    return program.apply("CHECKED", held, keep=("l_orderkey",))


ZIP_PROGRAM = """
stage ADD(in float a, in float b, out float s, src py "add")
stage TWICE(in float x, out float y, src py "twice")
pipeline EACH(in map<float> l, in map<float> r, in map<bool> off, in float[] xs, out map<float> sums, out float[] eight)
{
    map call ADD(a = split self.l, b = split self.r) using (disabled = self.off)
    map call TWICE as A(x = split self.xs)
    map call TWICE as B(x = split A.y)
    map call TWICE as C(x = split B.y)
    return (sums = ADD.s, eight = C.y)
}
"""


def _zipped(t):
    program, _ = language.load(ZIP_PROGRAM, {"ADD": lambda a, b: {"s": a + b}, "TWICE": lambda x: {"y": x * 2}})
    flags = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("x"))
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct("l_returnflag", v)))
    held = flags.groupBy("l_orderkey").agg(entry(F.col("q")).alias("l"), entry(F.col("x")).alias("r"), entry(F.col("l_returnflag") == "R").alias("off"), F.collect_list("q").alias("xs"))
    return program.apply("EACH", held, keep=("l_orderkey",))


@query("select l_orderkey, l_returnflag as flag, case when l_returnflag = 'R' then null else round(sum(l_quantity) + sum(l_tax), 6) end as sum from lineitem group by l_orderkey, l_returnflag")
def program_zipped_maps(t):
    """Two maps in lock-step, a control for each fork."""
    return _zipped(t).select("l_orderkey", F.explode("sums").alias("flag", "sum")).withColumn("sum", F.round("sum", 6))


@query("select l_orderkey, 8 * sum(l_quantity) as total from lineitem group by l_orderkey")
def program_fused_calls(t):
    """Three mapped calls over each other's results alone: one pass."""
    return _zipped(t).select("l_orderkey", F.aggregate("eight", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select * from (values (0::bigint, 'a', 25.0::double), (1::bigint, 'b', null), (2::bigint, 'c', 0.0::double)) v(fork_ix, fork_key, sum)")
def program_top_call(t):
    """A mapped top call: a row a fork."""
    program, top = language.load(PROGRAM + 'map call SUM_SQUARES(xs = split {"b": [1], "a": [3, 4], "c": []}, off = split {"a": false, "b": true, "c": false})', BODIES)
    got = program.run(t("region").sparkSession, top)
    return got.select(F.col("fork_ix").cast("long").alias("fork_ix"), "fork_key", "sum")


# Documents, names and literals


@query(f"""with l as (select *, {LINE} as n from lineitem)
select l_orderkey, to_json(list(l_returnflag order by n))::varchar as flags, to_json(list(l_linestatus order by n))::varchar as states from l group by l_orderkey""")
def json_path_arrays(t):
    """Paths through arrays of objects, and of arrays of them."""
    doc = F.to_json(F.struct(F.transform("lines", lambda x: F.struct(x["l_returnflag"].alias("flag"), F.struct(x["l_linestatus"].alias("state")).alias("at"))).alias("lines")))
    held = lines_by_order(t, "l_returnflag", "l_linestatus").select("l_orderkey", doc.alias("doc"))
    return held.select("l_orderkey", expr.json_path_mapped(F.col("doc"), "lines.flag").alias("flags"), expr.json_path_mapped(F.col("doc"), "lines.at.state").alias("states"))


@query("""select to_json({'o_orderkey': o_orderkey, 'status': o_orderstatus, 'note': case when o_orderstatus = 'F' then null else o_orderpriority end})::varchar as invocation from orders""")
def invocation_documents(t):
    note = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    return invocation.to_invocation(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), note.alias("note")))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k, null::varchar as note from events""")
def typed_arguments(t):
    """JSON arguments as typed columns; a missing one is NULL."""
    params = {"k": TypeId("int"), "note": TypeId("string")}
    return t("events").select("event_id", invocation.parse_args(F.col("props"), params, Types.of()).alias("a")).select("event_id", "a.k", "a.note")


@query("""select page_id, replace(replace(replace(replace(replace(replace(url_encode(url || ' ~*+$&=@é'), '%24', '$'), '%26', '&'), '%2B', '+'), '%3D', '='), '%3A', ':'), '%40', '@') as escaped from pages""")
def path_escapes(t):
    return t("pages").select("page_id", fn.path_escape(F.concat("url", F.lit(" ~*+$&=@é"))).alias("escaped"))


@query("""select o_orderkey, s.pos::bigint as ix, case s.pos when 0 then o_orderpriority || '"é' || chr(10) || chr(92) || 'n' when 1 then o_orderstatus else '' end as value from orders cross join (values (0), (1), (2)) s(pos)""")
def strings_inside_documents(t):
    """All strings of nested documents, their escapes resolved; keys and numbers are none."""
    odd = F.concat("o_orderpriority", F.lit('"é\n\\n'))
    doc = F.to_json(F.struct("o_orderkey", F.struct(odd.alias("name")).alias("inner"), F.array(F.col("o_orderstatus"), F.lit("")).alias("each")))
    return t("orders").select("o_orderkey", F.posexplode(fn.strings_inside(doc)).alias("ix", "value")).withColumn("ix", F.col("ix").cast("long"))


@query(r"""with n as (select page_id, k.kind, case k.kind when 'leaf' then regexp_extract(url, '[^/]*$') when 'device' then 'com' || len(url) % 12 || '.txt' when 'dot' then 'page.' else regexp_extract(url, '//([^/]*)', 1) end as name
from pages cross join (values ('leaf'), ('device'), ('dot'), ('host')) k(kind))
select page_id, kind, octet_length(encode(name)) <= 255 and name not in ('', '.', '..') and not regexp_matches(name, '[<>:"/\\|?*\x00-\x1f]') and not regexp_matches(name, '[ .]$') and not regexp_matches(upper(name), '^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])([.]|$)') as legal from n""")
def output_names_legal(t):
    """Names that Unix and Windows both take."""
    leaf, device = F.regexp_extract("url", "[^/]*$", 0), F.concat(F.lit("com"), (F.length("url") % 12).cast("string"), F.lit(".txt"))
    names = [("leaf", leaf), ("device", device), ("dot", F.lit("page.")), ("host", F.regexp_extract("url", "//([^/]*)", 1))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("name")) for k, n in names))).alias("x")
    return t("pages").select("page_id", each).select("page_id", "x.kind", fn.legal_output_name(F.col("x.name")).alias("legal"))


@query(f"""{PATHS}, d as (select f, regexp_replace(f, '/[^/]*$', '') as folder from f)
select f, unnest([f, '/link' || substr(f, length(folder) + 1)]) as alias from d""")
def path_aliases(t):
    """A file under the alias of its folder; that of a folder it isn't in doesn't count."""
    files = paths(t)[0].withColumn("folder", F.regexp_replace("f", "/[^/]*$", ""))
    links = F.array(F.struct(F.col("folder").alias("folder"), F.lit("/link").alias("alias")), F.struct(F.concat("folder", F.lit("x")).alias("folder"), F.lit("/no").alias("alias")))
    return files.select("f", F.explode(fn.aliases(F.col("f"), links)).alias("alias"))


@query("select n_nationkey, 0::bigint as n_rows, 0::bigint as n_keys, '/outs/table.csv' as \"table\", null::varchar as note from nation")
def default_outputs(t):
    """Collections empty, files at their default path, all else NULL."""
    made = outputs.default_outs({n: TypeId.parse(k) for n, k in {"rows": "int[]", "keys": "map<float>", "table": "csv", "note": "string"}.items()}, Types.of(filetypes=("csv",)), "/outs")
    return t("nation").select("n_nationkey", F.size(made["rows"]).cast("long").alias("n_rows"), F.size(made["keys"]).cast("long").alias("n_keys"), made["table"].alias("table"), made["note"].alias("note"))


@query("""select o_orderkey, p.level, case when o_orderstatus = 'F' and p.level <> 'disable' then 1 else 0 end::bigint as errors from orders cross join (values ('disable'), ('log'), ('alarm')) p(level)""")
def severity_policy(t):
    found = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("finished"))).otherwise(F.array().cast("array<string>"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.size(validate.enforce(found, k)).cast("long").alias("errors")) for k in ("disable", "log", "alarm"))))
    return t("orders").select("o_orderkey", levels.alias("x")).select("o_orderkey", "x.level", "x.errors")


LITERALS = r"""
struct POINT(float x, string note)
stage SHIFT(in POINT at, in float[] by, in map<float> named, in float price, in string status, out POINT to, src py "shift")
pipeline SHIFTED(in float price, in string status, out POINT whole, out float x, out string note)
{
    call SHIFT(at = {x: 1.5, note: "a\"\té\x41"}, by = [2, 0.25], named = {"k": 4}, * = self)
    return (whole = SHIFT.to, x = SHIFT.to.x, note = SHIFT.to.note)
}
"""


@query("""select o_orderkey, o_totalprice + 7.75 as x, 'a"' || chr(9) || 'éA' || o_orderstatus as note, o_totalprice + 7.75 as whole_x from orders""")
def program_literals(t):
    """Literals of every kind with escapes, parameters bound by name from the pipeline's own, and a whole record."""

    def shift(at, by, named, price, status):
        return {"to": F.struct((at["x"] + by[0] + by[1] + named["k"] + price).alias("x"), F.concat(at["note"], status).alias("note"))}

    program, _ = language.load(LITERALS, {"SHIFT": shift})
    held = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return program.apply("SHIFTED", held, keep=("o_orderkey",)).select("o_orderkey", "x", "note", F.col("whole.x").alias("whole_x"))


@query("""select * from (values ('BY_KIND.SUM_SQUARES', 0::bigint, 'pipeline', true, null), ('BY_KIND.SUM_SQUARES.SQUARE', 1, 'stage', true, null), ('BY_KIND.SUM_SQUARES.TOTAL', 2, 'stage', false, 'BY_KIND.SUM_SQUARES.SQUARE')) v(node, place, kind, mapped, upstream)""")
def program_graph(t):
    """The graph of a program: calls in the order they run, and what each one waits for."""
    spark = t("region").sparkSession
    found = language.load(PROGRAM, BODIES)[0].document("BY_KIND")
    nodes = spark.createDataFrame([(n["name"], i, n["kind"], n["mapped"]) for i, n in enumerate(found["nodes"])], "node string, place long, kind string, mapped boolean")
    waits = spark.createDataFrame([(e["to"], e["from"]) for e in found["edges"]], "node string, upstream string")
    return nodes.join(waits, "node", "left")


@query("select * from (values (0::bigint, 25.0::double), (1::bigint, null), (2::bigint, 0.0::double)) v(fork_ix, sum)")
def invocation_round_trip(t):
    """A mapped call as an invocation document, read back as a typed call and run."""
    program, _ = language.load(PROGRAM, BODIES)
    given = invocation.call_of(program, "SUM_SQUARES", '{"xs": {"split": [[3, 4], [1], []]}, "off": {"split": [false, true, false]}}')
    again = invocation.call_of(program, "SUM_SQUARES", invocation.document_of(given))
    return program.run(t("region").sparkSession, again).select(F.col("fork_ix").cast("long").alias("fork_ix"), "sum")
