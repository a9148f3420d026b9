"""Join-shaped relations of the runtime: reconciliation, ancestors, containment, reference counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(believed: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """Jobs believed running that the cluster doesn't report."""
    return believed.join(reported.select(key).distinct(), key, "left_anti")


def missing_since(believed: DataFrame, reported: DataFrame, key: str, since: str, now: Column, grace: Column) -> DataFrame:
    """The believed jobs, ``since`` stamped with ``now`` where one is first missed and cleared where it is reported, and ``failed`` where it has been missed for longer than the grace period."""
    seen = reported.select(key).distinct().withColumn("_seen", F.lit(True))
    both = believed.join(seen, key, "left")
    stamped = both.withColumn(since, F.when(F.col("_seen").isNull(), F.coalesce(F.col(since), now))).drop("_seen")
    return stamped.withColumn("failed", F.coalesce(now - F.col(since) > grace, F.lit(False)))


def journal_lookup(journal: DataFrame, nodes: DataFrame, key: str, uniquifier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of known nodes, and those to warn of. With a uniquifier, known entries of an earlier attempt (another one than the node's) are ignored."""
    if uniquifier is None:
        return journal.join(nodes, key), journal.join(nodes.select(key), key, "left_anti")
    current = journal[uniquifier].eqNullSafe(nodes[uniquifier])
    known = journal.join(nodes, (journal[key] == nodes[key]) & current).drop(nodes[key], nodes[uniquifier])
    return known, journal.join(nodes.select(key), key, "left_anti")


def prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, the name included: structs of (prefix, depth)."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("prefix"), n.alias("depth")))


def nearest_override(names: DataFrame, name: str, overrides: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """For each name the value at its longest dotted prefix that has one, else the default."""
    expanded = names.select(name).distinct().select(name, F.explode(prefixes(F.col(name))).alias("_p")).select(name, F.col("_p.prefix").alias(key), F.col("_p.depth").alias("_d"))
    found = expanded.join(overrides.select(key, value), key).groupBy(name).agg(F.max_by(value, "_d").alias(value))
    return names.join(found, name, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def path_prefixes(path: Column) -> Column:
    """The path and all its ancestor folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def containment(files: DataFrame, file: str, args: DataFrame, arg: str) -> DataFrame:
    """Pairs where the paths are equal or one is an ancestor folder of the other: two equi-joins on exploded ancestors instead of a theta join."""
    below = files.select(file, F.explode(path_prefixes(F.col(file))).alias("_p")).join(args.select(arg), F.col("_p") == F.col(arg)).select(file, arg)
    above = args.select(arg, F.explode(path_prefixes(F.col(arg))).alias("_p")).join(files.select(file), F.col("_p") == F.col(file)).select(file, arg)
    return below.unionByName(above).distinct()


def unreferenced(files: DataFrame, file: str, args: DataFrame, arg: str) -> DataFrame:
    return files.join(containment(files, file, args, arg).select(file).distinct(), file, "left_anti")


def collapse_paths(files: DataFrame, path: str, size: str) -> DataFrame:
    """Paths that lie in no other one, with the sizes below them added."""
    every = files.groupBy(path).agg(F.sum(size).alias(size))
    tops = every.select(F.col(path).alias("_top"))
    up = every.select(path, size, F.explode(path_prefixes(F.col(path))).alias("_top")).join(tops, "_top")
    return up.groupBy(path).agg(F.first(size).alias(size), F.min_by("_top", F.length("_top")).alias("_top")).groupBy(F.col("_top").alias(path)).agg(F.sum(size).alias(size))


def refcount(edges: DataFrame, producer: str, done: Column) -> DataFrame:
    """Producers with their unfinished consumers and whether their files may go."""
    return edges.groupBy(producer).agg(F.count_if(~done).alias("waiting"), F.every(done).alias("may_go"))


def ready(edges: DataFrame, states: DataFrame, node: str, upstream: str, state: str, done: Sequence[str]) -> DataFrame:
    """Whether all upstream nodes of a node are in one of the states ``done``; an unknown one isn't."""
    known = states.select(F.col(node).alias(upstream), F.col(state).alias("_state"))
    return edges.join(known, upstream, "left").groupBy(node).agg(F.every(F.coalesce(F.col("_state").isin(list(done)), F.lit(False))).alias("ready"))
