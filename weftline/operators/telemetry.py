"""Analytics of run history: reductions, rollups, deviations, merged events, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.expr("1000000") * F.date_part(F.lit("SECOND"), ts)).cast("long")
    return (day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000000 + second


def reduce_job(threads: Column, duration: Column, rss: Sequence[Column], amounts: dict[str, Column]) -> dict[str, Column]:
    """One job's row: core hours, largest memory and a rate a second for each amount (NULL where the duration isn't positive)."""
    out = {"core_hours": threads * duration / 3600, "maxrss": F.greatest(*rss) if len(rss) > 1 else rss[0]}
    return out | {f"{n}_rate": F.when(duration > 0, a / duration) for n, a in amounts.items()}


def rollup(jobs: DataFrame, keys: Sequence[str], start: str, end: str, duration: str, amounts: Sequence[str], maxima: Sequence[str] = ()) -> DataFrame:
    """Children to one row: walltime is last end less first start, duration their sum, rates are sums over the summed duration."""
    d = F.sum(duration)
    return jobs.groupBy(*keys).agg(
        F.min(start).alias("start"), F.max(end).alias("end"), (F.max(end) - F.min(start)).alias("walltime"), d.alias("duration"),
        *(F.sum(a).alias(a) for a in amounts), *(F.when(d > 0, F.sum(a) / d).alias(f"{a}_rate") for a in amounts), *(F.max(m).alias(m) for m in maxima),
    )


def rollup_paths(jobs: DataFrame, path: str, *args, **more) -> DataFrame:
    """``rollup`` for every node of the tree of dotted paths: a job counts for its own path and all above it."""
    from .relations import prefixes

    every = jobs.withColumn("_p", F.explode(prefixes(F.col(path)))).withColumn(path, F.col("_p.prefix")).drop("_p")
    return rollup(every, [path], *args, **more)


def weighted_dev(amount: Column, duration: Column) -> Column:
    """Deviation of children's rates weighted by their durations; children without a duration don't count."""
    x = F.when(duration > 0, amount)
    d = F.when(duration > 0, duration)
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(x * x / d) / F.sum(d) - F.pow(F.sum(x) / F.sum(d), F.lit(2))))


def sampled_rates(samples: DataFrame, keys: Sequence[str], at: str, amount: str) -> DataFrame:
    """The change a second between neighbouring samples of each key, and its running maximum."""
    w = W.partitionBy(*keys).orderBy(at)
    dt, dx = F.col(at) - F.lag(at).over(w), F.col(amount) - F.lag(amount).over(w)
    got = samples.withColumn("rate", F.when(dt > 0, dx / dt))
    return got.withColumn("max_rate", F.max("rate").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def rate_stats(samples: DataFrame, keys: Sequence[str], at: str, amount: str) -> DataFrame:
    """For each key the largest rate between neighbouring samples, the rate over all of them and the deviation of the rates weighted by time."""
    w = W.partitionBy(*keys).orderBy(at)
    steps = samples.select(*keys, (F.col(at) - F.lag(at).over(w)).cast("double").alias("_dt"), (F.col(amount) - F.lag(amount).over(w)).cast("double").alias("_dx")).where("_dt > 0")
    t, mean = F.sum("_dt"), F.sum("_dx") / F.sum("_dt")
    return steps.groupBy(*keys).agg(F.max(F.col("_dx") / F.col("_dt")).alias("max_rate"), mean.alias("rate"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_dx") * F.col("_dx") / F.col("_dt")) / t - mean * mean)).alias("rate_dev"))


def dead_usage(samples: DataFrame, keys: Sequence[str], at: str, amount: str) -> DataFrame:
    """The last total of each process, which stays after it is gone."""
    return samples.groupBy(*keys).agg(F.max_by(amount, at).alias(amount))


def merge_islands(events: DataFrame, keys: Sequence[str], order: Sequence[str], second: Column, delta: str) -> DataFrame:
    """Adjacent events in one truncated second and of one sign become one row with their sum."""
    w = W.partitionBy(*keys).orderBy(*order)
    sign = F.col(delta) >= 0
    marked = events.withColumn("_s", second).withColumn("_g", sign)
    new = (F.lag("_s").over(w) != F.col("_s")) | (F.lag("_g").over(w) != F.col("_g"))
    marked = marked.withColumn("_island", F.sum(F.coalesce(new, F.lit(True)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "_island").agg(F.first("_s").alias("second"), F.sum(delta).alias(delta), F.count("*").alias("n")).drop("_island")


def collapse(events: DataFrame, keys: Sequence[str], name: str, at: str, order: Sequence[str], span: int) -> DataFrame:
    """A sequential fold: an event goes if it has the name of the last kept event and less than ``span`` has passed since that one.

    An event with another name than its predecessor, or at least ``span`` after
    it, is kept whatever came before; the fold runs only between such events.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    new = (F.lag(name).over(w) != F.col(name)) | (F.col(at) - F.lag(at).over(w) >= span)
    cut = events.withColumn("_part", F.sum(F.coalesce(new, F.lit(True)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rest = [c for c in events.columns if c not in (*keys, at, *order)]
    row = F.struct(at, *[c for c in order if c != at], *rest)
    got = cut.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(row)).alias("_all"))
    fold = lambda a, e: F.when(F.size(a) == 0, F.array(e)).when(e[at] - F.element_at(a, -1)[at] >= span, F.concat(a, F.array(e))).otherwise(a)
    start = F.slice("_all", 1, 0)
    return got.select(*keys, F.explode(F.aggregate("_all", start, fold)).alias("_e")).select(*keys, "_e.*")


def high_water(events: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str) -> DataFrame:
    """Running total in order, and its maximum, at least 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("_t", F.sum(delta).over(w)).groupBy(*keys).agg(F.greatest(F.max("_t"), F.lit(0)).alias("high_water"), F.sum(delta).alias("total"))


def merge_reports(reports: DataFrame, keys: Sequence[str], size: str, path: str, at: str) -> DataFrame:
    """Reports as one: sizes and counts added, different paths counted, the latest time. The paths themselves stay rows: ``reports`` deduplicated by path."""
    return reports.groupBy(*keys).agg(F.sum(size).alias("size"), F.count("*").alias("count"), F.count_distinct(path).alias("paths"), F.max(at).alias("latest"))


def merge_report_events(events: DataFrame, keys: Sequence[str], at: str, second: Column, delta: str) -> DataFrame:
    """The events of several reports as one list in order of time, neighbours in one second and of one sign merged."""
    return merge_islands(events, keys, (at, delta), second, delta)


def roots(processes: DataFrame, process: str, parent: str) -> DataFrame:
    """(process, root) of a process table: the ancestor without a known parent, by pointer jumping."""
    links = processes.select(F.col(process).alias("p"), F.col(parent).alias("up")).distinct()
    known = links.select(F.col("p").alias("k"))
    tree = links.join(known, F.col("up") == F.col("k"), "left").select("p", F.coalesce("k", "p").alias("root")).checkpoint()
    while True:
        jump = tree.select(F.col("p").alias("root"), F.col("root").alias("next"))
        new = tree.join(jump, "root").select("p", "root", "next").checkpoint()
        if new.where("root <> next").isEmpty():
            return new.select(F.col("p").alias(process), "root")
        tree = new.select("p", F.col("next").alias("root"))


def memory_high_water(samples: DataFrame, keys: Sequence[str], process: str, at: str, fields: Sequence[str]) -> DataFrame:
    """Each process's largest value at a sample, summed over the process tree (``keys`` hold its root, see ``roots``), then the largest by field."""
    each = samples.groupBy(*keys, at, process).agg(*(F.max(f).alias(f) for f in fields))
    tree = each.groupBy(*keys, at).agg(*(F.sum(f).alias(f) for f in fields))
    return tree.groupBy(*keys).agg(*(F.max(f).alias(f) for f in fields))


def reduce_states(state: Column, priority: Sequence[str]) -> Column:
    """The first state of ``priority`` that any child has."""
    out = F.lit(None).cast("string")
    for s in reversed(priority):
        out = F.when(F.bool_or(state == s), F.lit(s)).otherwise(out)
    return out
