"""Retention: which snapshots to keep, and why.

A period rule keeps the newest snapshot of each of the N newest buckets of its group; every rule counts
its own buckets, and a snapshot stays if any rule keeps it.  Rows are first aggregated to one representative a
(group, rule, bucket), so the ranking window sees buckets, not snapshots.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.filters import any_of, contains_lists, must_delete, must_keep
from stratum.operators.report import snapshot_listing
from stratum.operators.select import newest_first
from stratum.shared import join_null_safe, previous

PERIODS = ("minutely", "hourly", "daily", "weekly", "monthly", "quarter_yearly", "half_yearly", "yearly")


def bucket(period: str, time="time") -> Column:
    time = F.col(time) if isinstance(time, str) else time
    unit = {"minutely": "minute", "hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarter_yearly": "quarter", "yearly": "year"}
    if period == "half_yearly":
        return F.concat(F.year(time).cast("string"), F.when(F.month(time) <= 6, "-1").otherwise("-2"))
    return F.date_trunc(unit[period], time).cast("string")


@dataclass(frozen=True)
class KeepPolicy:
    """Numbers of buckets to keep (-1: all), durations (SQL intervals, counted back from the group's latest), tags and id prefixes."""

    last: int | None = None
    periods: Mapping[str, int] = field(default_factory=dict)
    within: str | None = None
    within_periods: Mapping[str, str] = field(default_factory=dict)
    tags: Sequence[Sequence[str]] = ()
    ids: Sequence[str] = ()
    none: bool = False
    delete_unchanged: bool = False

    def check(self) -> None:
        if not (self.none or self.last is not None or self.periods or self.within or self.within_periods or self.tags or self.ids):
            raise ValueError("no keep option given; use none=True to remove all")
        if odd := {*self.periods, *self.within_periods} - set(PERIODS):
            raise ValueError(f"no such period: {sorted(odd)}")


def reasons(df: DataFrame, policy: KeepPolicy, group: Sequence[str]) -> DataFrame:
    """(id, reasons): the rules that keep a snapshot, in option order."""
    policy.check()
    order = ["last", *PERIODS, "within", *[f"within_{p}" for p in PERIODS], "tags", "ids"]
    found: list[DataFrame] = []
    rule = lambda name: F.lit(order.index(name)).alias("rule")
    slim = df.select("id", "time", *group)
    if policy.last is not None:
        some = slim if policy.last < 0 else slim.withColumn("_n", F.row_number().over(newest_first(*group))).where(F.col("_n") <= policy.last)
        found.append(some.select("id", rule("last")))
    if policy.periods:
        cells = F.array(*[F.struct(rule(p), F.lit(n).alias("n"), bucket(p).alias("bucket")) for p, n in policy.periods.items()])
        best = slim.select("id", "time", *group, F.explode(cells).alias("c")).groupBy(*group, "c").agg(F.max(F.struct("time", "id")).alias("best"))
        ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "c.rule").orderBy(F.desc("c.bucket"))))
        found.append(ranked.where((F.col("c.n") < 0) | (F.col("_n") <= F.col("c.n"))).select(F.col("best.id").alias("id"), F.col("c.rule").alias("rule")))
    if policy.within or policy.within_periods:
        newest = slim.groupBy(*group).agg(F.max("time").alias("newest"))
        aged = join_null_safe(slim, newest if group else F.broadcast(newest), list(group))  # without a group, one row
        if policy.within:
            found.append(aged.where(F.expr(f"time > newest - interval {policy.within}")).select("id", rule("within")))
        for p, span in policy.within_periods.items():
            some = aged.where(F.expr(f"time > newest - interval {span}")).groupBy(*group, bucket(p).alias("_b")).agg(F.max(F.struct("time", "id")).alias("best"))
            found.append(some.select(F.col("best.id").alias("id"), rule(f"within_{p}")))
    if policy.tags:
        found.append(df.where(contains_lists("tags", policy.tags)).select("id", rule("tags")))
    if policy.ids:
        found.append(df.where(any_of([F.col("id").startswith(i) for i in policy.ids])).select("id", rule("ids")))
    if not found:
        return df.select("id", F.array().cast("array<string>").alias("reasons")).limit(0)
    out = found[0]
    for some in found[1:]:
        out = out.unionByName(some)
    names = F.array(*map(F.lit, order))
    return out.groupBy("id").agg(F.array_sort(F.collect_set("rule")).alias("r")).select("id", F.transform("r", lambda i: F.element_at(names, i + 1)).alias("reasons"))


def forget(df: DataFrame, policy: KeepPolicy, group: Sequence[str], now) -> DataFrame:
    """df with keep (boolean) and reasons (array).  Order: protected keeps, expired removes, unchanged removes (unless
    chosen by tag or id), then the policy."""
    now = F.lit(now).cast(df.schema["time"].dataType)
    out = df.join(reasons(df, policy, group), "id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    guard, expired = (must_keep(now), must_delete(now)) if "delete_kind" in df.columns else (F.lit(False), F.lit(False))
    same = F.lit(False)
    if policy.delete_unchanged:
        out = previous(out, group, ("time", "id"), F.col("tree"), "_prior")
        out = out.withColumn("_same", F.coalesce(F.col("_prior.value") == F.col("tree"), F.lit(False))).drop("_prior")
        same = F.col("_same") & ~F.arrays_overlap("reasons", F.array(F.lit("tags"), F.lit("ids")))
    keep = F.when(guard, True).when(expired, False).when(same, False).otherwise(F.size("reasons") > 0)
    why = F.when(guard, F.array(F.lit("protected"))).when(expired, F.array(F.lit("expired"))).when(same, F.array(F.lit("unchanged"))).otherwise(F.col("reasons"))
    return out.withColumn("keep", keep).withColumn("reasons", why).drop("_same")


def forget_rows(plan: DataFrame) -> DataFrame:
    """The rows of a forget table: those of the snapshot table, with what is done and why."""
    return snapshot_listing(plan, F.when(F.col("keep"), "keep").otherwise("remove").alias("action"), F.array_join("reasons", "\n").alias("reason"))


def forget_ids(df: DataFrame, ids: DataFrame, now) -> DataFrame:
    """Explicitly named snapshots are removed without a policy; protection still holds."""
    now = F.lit(now).cast(df.schema["time"].dataType)
    return df.join(ids.select("id").distinct(), "id", "left_semi").withColumn("keep", must_keep(now))
